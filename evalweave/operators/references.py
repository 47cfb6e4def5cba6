"""Problem 6: references to records that are missing, deleted or not yet there.

Method: distributed left anti-join of the distinct non-null foreign keys against
the parent keys, joined back to the references for rows and counts per table and
month.  Each side is first reduced to one row per key by a map-side combine (the
references to their earliest time, the parents to their first beginning and
whether any was deleted), so a hot key moves one row per task; the keys that can
have orphans at all are joined back.

Only for keys with a deleted parent the times matter one by one: beginnings,
ends and references are swept in order of time, a day of a key at a time, with
the number of parents in force carried from day to day.  A hot key is so spread
over its days on either side.

Defined results for odd input: null and blank keys are no references; keys are
compared without surrounding blanks and letter case within the data set; a
reference without a time is judged by presence alone (``missing`` or nothing)
and has a null month; repeated rows each give a row; empty tables give no rows,
an empty parent table makes every reference ``missing``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.session import checkpointed

_EDGE = r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$"


def clean_key(col: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(col.cast("string"), _EDGE, "")), F.lit(""))


def references(df: DataFrame, table_name: str, ref_column: str, row_id: str, at: str, target: str, group: str = "dataset") -> DataFrame:
    """The references of one column in a common form."""
    return df.select(
        F.lit(table_name).alias("table_name"), F.lit(ref_column).alias("ref_column"), F.col(row_id).cast("long").alias("row_id"), F.lit(target).alias("target"), F.col(group).alias("grp"), clean_key(F.col(ref_column)).alias("key"), F.col(at).cast("timestamp_ntz").alias("at")
    ).where("key is not null")


def parents(df: DataFrame, target: str, key: str, begins: str, ends: str | None = None, group: str = "dataset") -> DataFrame:
    """The parent rows in a common form: in force from ``begins`` until before ``ends``."""
    end = F.col(ends).cast("timestamp_ntz") if ends else F.lit(None).cast("timestamp_ntz")
    return df.select(F.lit(target).alias("target"), F.col(group).alias("grp"), clean_key(F.col(key)).alias("key"), F.col(begins).cast("timestamp_ntz").alias("begins"), end.alias("ends")).where("key is not null")


KEYS = ["target", "grp", "key"]
BEGINNING = "0001-01-01"


def _same(a: str, b: str) -> Column:
    """Equal keys; null groups meet null groups."""
    return (F.col(f"{a}.target") == F.col(f"{b}.target")) & F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def suspect_keys(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys with their parents' ``first_begins`` and ``ended``, as far as a reference to them can be an orphan.

    Missing keys (the anti-join of the distinct keys) have a null ``first_begins``.
    """
    asked = refs.groupBy(*KEYS).agg(F.min("at").alias("first_at"))
    known = targets.groupBy(*KEYS).agg(F.min(F.coalesce("begins", F.lit(BEGINNING).cast("timestamp_ntz"))).alias("first_begins"), F.bool_or(F.col("ends").isNotNull()).alias("ended"))
    c, k = asked.alias("c"), known.alias("k")
    none = F.lit(None)
    missing = c.join(k, _same("c", "k"), "left_anti").select(*KEYS, none.cast("timestamp_ntz").alias("first_begins"), none.cast("boolean").alias("ended"))
    doubtful = c.join(k, _same("c", "k")).where("k.ended or c.first_at < k.first_begins").select("c.target", "c.grp", "c.key", "k.first_begins", "k.ended")
    return missing.unionByName(doubtful)


def in_force(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The references (columns of ``refs``) with ``held``: how many parents are in force at their time.

    Works off beginnings (+1), ends (-1) and references in order of time; at the
    same moment the references come last.
    """
    row = [c for c in refs.columns if c not in KEYS]
    begins = F.coalesce("begins", F.lit(BEGINNING).cast("timestamp_ntz"))
    span = targets.where(F.col("ends").isNull() | (F.col("ends") > begins))
    event = span.select(*KEYS, F.explode(F.array(F.struct(begins.alias("t"), F.lit(1).alias("step")), F.struct(F.col("ends").alias("t"), F.lit(-1).alias("step")))).alias("e")).select(*KEYS, "e.*", F.lit(None).alias("r")).where("t is not null")
    asked = refs.select(*KEYS, F.col("at").alias("t"), F.lit(0).alias("step"), F.struct(*row).alias("r"))
    both = asked.unionByName(event.withColumn("r", F.col("r").cast(dict(asked.dtypes)["r"]))).withColumn("day", F.to_date("t"))
    # one row per key and day; their number is bounded by the calendar
    days = both.groupBy(*KEYS, "day").agg(F.sum("step").alias("step"))
    past = F.sum("step").over(Window.partitionBy(*KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select(*KEYS, F.lit(None).cast("timestamp_ntz").alias("t"), past.alias("step"), F.lit(None).cast(dict(asked.dtypes)["r"]).alias("r"), "day")
    order = Window.partitionBy(*KEYS, "day").orderBy(F.asc_nulls_first("t"), F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.unionByName(carried).withColumn("held", F.sum("step").over(order)).where("r is not null")
    return swept.select(*KEYS, "r.*", F.coalesce("held", F.lit(0)).alias("held"))


def orphan_references(refs: list[DataFrame], targets: list[DataFrame]) -> DataFrame:
    """table_name, ref_column, row_id, reason and ref_month of every reference without a parent in force."""
    r = reduce(DataFrame.unionByName, refs)
    p = reduce(DataFrame.unionByName, targets)
    s = suspect_keys(r, p).alias("s")
    a = r.alias("a")
    # read three times below: the references of suspect keys are written once
    back = checkpointed(a.join(s, _same("a", "s")).select(*[f"a.{c}" for c in r.columns], "s.first_begins", "s.ended"))
    early = back.where("first_begins is null or at < first_begins").withColumn("reason", F.when(F.col("first_begins").isNull(), F.lit("missing")).otherwise(F.lit("late")))
    later = back.where("ended and at >= first_begins").drop("first_begins", "ended")
    deleted = p.where("ends is not null").select(*KEYS).distinct().alias("d")
    sweep = p.alias("p").join(deleted, _same("p", "d"), "left_semi")
    gone = in_force(later, sweep).where("held <= 0").withColumn("reason", F.lit("deleted"))
    shown = ["table_name", "ref_column", "row_id", "reason", F.date_format("at", "yyyy-MM").alias("ref_month")]
    return early.select(*shown).unionByName(gone.select(*shown))


def orphan_report(found: DataFrame, refs: list[DataFrame]) -> DataFrame:
    """References, orphans by reason and orphan share per table, column and month."""
    keys = ["table_name", "ref_column", "ref_month"]
    total = reduce(DataFrame.unionByName, refs).groupBy("table_name", "ref_column", F.date_format("at", "yyyy-MM").alias("ref_month")).agg(F.count("*").alias("n_references"))
    bad = found.groupBy(*keys).agg(*[F.count(F.when(F.col("reason") == x, 1)).alias(f"n_{x}") for x in ("missing", "late", "deleted")])
    t, b = total.alias("t"), bad.alias("b")
    on = (F.col("t.table_name") == F.col("b.table_name")) & (F.col("t.ref_column") == F.col("b.ref_column")) & F.col("t.ref_month").eqNullSafe(F.col("b.ref_month"))
    n = [F.coalesce(F.col(f"b.n_{x}"), F.lit(0)).alias(f"n_{x}") for x in ("missing", "late", "deleted")]
    out = t.join(b, on, "left").select("t.table_name", "t.ref_column", "t.ref_month", "t.n_references", *n)
    return out.withColumn("orphan_share", (F.col("n_missing") + F.col("n_late") + F.col("n_deleted")) / F.col("n_references"))
