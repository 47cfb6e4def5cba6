"""Problem 1: a reproducible sample that stays as the data grow.

Method: nested hash buckets.  A key belongs for ever to one of 2^16 fine
buckets (the first 16 bits of an md5 over the normalised key).  The buckets are
ordered by one fixed permutation, position = (bucket * MULTIPLIER + OFFSET) mod
2^16 with an odd multiplier; a sample of a given rate is the list of the first
ceil(rate * 2^16) buckets.  A larger rate only appends buckets, and rows that
come later cannot move a key, so whatever was selected stays selected in every
rerun, layout and growth of the data.

Defined results for odd input: null and blank keys belong to no bucket and are
never selected; keys are compared without surrounding blanks and letter case;
repeated deliveries of a key share its fate; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MULTIPLIER = 40503  # odd, so the map is a permutation; near BUCKETS / golden ratio, so neighbours scatter
OFFSET = 12345
_EDGE = r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$"


def clean_key(col: Column) -> Column:
    """A key without surrounding blanks, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(col.cast("string"), _EDGE, "")), F.lit(""))


def bucket_of(*parts: Column) -> Column:
    """Fine bucket 0..65535 of a key of several parts (null if a part is null)."""
    key = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [p]])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def position_of(bucket: Column) -> Column:
    """Place of a bucket in the append-only list of buckets."""
    return ((bucket.cast("long") * MULTIPLIER + OFFSET) % BUCKETS).cast("int")


def listed(rate: float) -> int:
    """Number of buckets in the list for a rate."""
    return min(BUCKETS, max(0, math.ceil(rate * BUCKETS)))


def select_rows(df: DataFrame, key_cols: list[str], rate: float) -> DataFrame:
    """The rows of df whose key is selected; a pure filter, without a shuffle."""
    pos = position_of(bucket_of(*[clean_key(F.col(f"`{c}`")) for c in key_cols]))
    return df.where(pos < listed(rate))


def sample_keys(tables: dict[str, DataFrame], key_cols: list[str], rate: float) -> DataFrame:
    """Distinct selected keys of several tables with bucket, place and the rows per table (``n_<table>``).

    The filter runs before the shuffle, and counts are combined map-side, so a hot key moves one row per task.
    """
    parts = []
    for name, df in tables.items():
        keys = [clean_key(F.col(f"`{c}`")).alias(c) for c in key_cols]
        one = df.select(*keys).select(*key_cols, bucket_of(*[F.col(c) for c in key_cols]).alias("bucket"))
        one = one.withColumn("bucket_place", position_of(F.col("bucket"))).where(F.col("bucket_place") < listed(rate))
        parts.append(one.select("*", *[F.lit(1 if t == name else 0).cast("long").alias(f"n_{t}") for t in tables]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key_cols, "bucket", "bucket_place").agg(*[F.sum(f"n_{t}").alias(f"n_{t}") for t in tables])
