"""Problem 8: mixing sources to target shares of tokens, with capped repeats and the shares really reached.

Method: multivariate-hypergeometric splitting tree.  Records of a source are
hashed into blocks of about ``block_tokens``; the quota of a source is a number
of block uses (blocks in a hash permutation, round by round for repeats, the
last one in part).  From the root, which holds all these numbers, every node
splits them among its two halves of the output shards by a multivariate
hypergeometric draw; a leaf is a shard with exact numbers per source.  The
shards then draw disjoint ranges of each source's permuted uses, and shuffle
locally by hash.

Blocks and shards grow with the data and stay in the cluster: the driver holds
sums per listed source and splits the tree to at most ``FAN`` groups of shards;
the groups are split further, by their own seeds, where their blocks are placed.

Quotas are filled like water: every source gets its share of the wanted total
up to tokens x max_repeats; what a capped or absent source cannot give is
divided among the others in proportion.

Defined results for odd input: records with null or blank source or of unlisted
sources are not mixed; null and blank texts have no tokens and are not mixed;
listed sources without records get share 0; repeated rows are records of their
own; empty tables give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import running_before
from evalweave.llm.truncation import source_column
from evalweave.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer parts a text before it merges bytes.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAN = 4096


def token_counter(vocabulary: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens by a vocabulary of ranks (``.tiktoken``) or of the tokenizers library (``.json``)."""
    if kind == ".json":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_buffer(vocabulary)
        tok.encode_special_tokens = True
        return lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    enc = tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """id, ``source`` (one spelling) and ``n_tokens`` by a public tokenizer of the records with text.

    The vocabulary is a file on the driver (about a megabyte), sent along with the tasks.
    """
    src = docs.select(F.col(id_col).alias("id"), source_column(F.col(source_col)).alias("source"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    types = dict(src.dtypes)
    vocabulary = docs.sparkSession.sparkContext.broadcast((Path(tokenizer).read_bytes(), Path(tokenizer).suffix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(*vocabulary.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "n_tokens": count(pdf["t"].tolist())})

    return src.mapInPandas(run, f"id {types['id']}, source string, n_tokens long").where("n_tokens > 0").withColumnRenamed("id", id_col)


def fill_quotas(weights: dict[str, float], limit: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: its share of the total, capped by its limit; the rest goes to the others in proportion."""
    quota = {s: 0.0 for s in weights}
    open_ = {s for s in weights if weights[s] > 0 and limit.get(s, 0) > 0}
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / w >= limit[s]]
        if not full:
            for s in open_:
                quota[s] = left * weights[s] / w
            break
        for s in full:
            quota[s] = float(limit[s])
        left = total - sum(quota[s] for s in quota if s not in open_ or s in full)
        open_ -= set(full)
    return quota


def default_total(weights: dict[str, float], tokens: dict[str, int], repeats: dict[str, int]) -> int:
    """Tokens of the mixture where none are given.

    A source whose repeats fill its share only of a smaller mixture sets the
    total, down to half of all tokens; a smaller source is capped instead.
    """
    there = [s for s in weights if weights[s] > 0 and tokens.get(s, 0) * repeats[s] > 0]
    have = sum(tokens.values())
    if not there:
        return have
    w = sum(weights[s] for s in there)
    most = min(tokens[s] * repeats[s] * w / weights[s] for s in there)
    return int(min(have, max(most, have / 2)))


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator, upto: list[int] | None = None) -> np.ndarray:
    """shards x sources matrix of block counts: the quotas divided exactly, each shard within one block of the others.

    ``upto`` (shards + 1 numbers) makes each leaf a group of shards, those from upto[i] to upto[i + 1].
    """
    upto = upto or list(range(shards + 1))
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        n = int(q.sum())
        want = n * (upto[mid] - upto[lo]) // (upto[hi] - upto[lo])
        method = "count" if n < 100_000 else "marginals"
        part = rng.multivariate_hypergeometric(q, want, method=method)
        go(part, lo, mid)
        go(q - part, mid, hi)

    go(np.asarray(quotas, np.int64), 0, shards)
    return out


def _coprime(n: int, rng: np.random.Generator) -> int:
    """A factor by which places 0..n-1 are permuted."""
    while True:
        a = int(rng.integers(1, n + 1))
        if math.gcd(a, n) == 1:
            return a


def place_uses(uses: DataFrame, names: list[str], sizes: list[int], shards: int, seed: int) -> DataFrame:
    """``uses`` (source, _use = 0.. per source) with the ``shard`` that draws each."""
    rng = np.random.default_rng(seed)
    groups = min(shards, FAN)
    first = [g * shards // groups for g in range(groups + 1)]  # first shard of each group
    counts = split_tree(np.array(sizes, np.int64), groups, rng, first)
    ends = np.cumsum(counts, axis=0)  # at most FAN x sources numbers
    turns = {s: (_coprime(max(1, n), rng), int(rng.integers(0, max(1, n)))) for s, n in zip(names, sizes)}
    schema = ", ".join(f"{c} {t}" for c, t in uses.dtypes) + ", shard int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner: dict[int, np.ndarray] = {}
        for pdf in batches:
            shard = np.zeros(len(pdf), np.int64)
            for j, s in enumerate(names):
                at = np.flatnonzero((pdf["source"] == s).to_numpy())
                a, b = turns[s]
                place = np.array([(a * int(u) + b) % sizes[j] for u in pdf["_use"].to_numpy()[at]], np.int64)
                group = np.searchsorted(ends[:, j], place, side="right")
                for i, g, x in zip(at, group.tolist(), place.tolist()):
                    n = first[g + 1] - first[g]
                    if n > 1 and g not in inner:
                        inner[g] = np.cumsum(split_tree(counts[g], n, np.random.default_rng([seed, g])), axis=0)
                    shard[i] = first[g] + (int(np.searchsorted(inner[g][:, j], x - (ends[g, j] - counts[g, j]), side="right")) if n > 1 else 0)
            yield pdf.assign(shard=shard.astype(np.int32))

    return uses.mapInPandas(run, schema)


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    total_tokens: int | None = None,
    shards: int | None = None,
    block_tokens: int = 20_000,
    shard_tokens: int = 20_000_000,
    seed: int = 7,
    tokenizer: str = TOKENIZER,
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: id, source, copy_no, shard, position, n_tokens, one row per use of a record.
    report: per source of the weight table the target and the reached share.
    ``total_tokens`` defaults to the largest total at which every source with
    records reaches its share within its repeats, but at least half and at most
    all of the tokens there are (``default_total``); ``shards`` to one per
    ``shard_tokens``, at least 16.
    """
    spark = docs.sparkSession
    # the weight table is a setting: one row per source
    listed = weights.select(source_column(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).where("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r")).collect()
    w = {x["source"]: max(0.0, x["w"] or 0.0) for x in listed}
    reps = {x["source"]: max(0, x["r"] if x["r"] is not None else 1) for x in listed}
    names = sorted(w)
    counted = count_tokens(docs, id_col, text_col, source_col, tokenizer).where(F.col("source").isin(names) if names else F.lit(False))
    counted = checkpointed(counted.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))))
    have = {x["source"]: (x["t"], x["n"]) for x in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    tokens = {s: have.get(s, (0, 0))[0] for s in names}
    per = lambda d, kind: F.create_map(*[x for s in names for x in (F.lit(s), F.lit(d[s]).cast(kind))])[F.col("source")] if names else F.lit(None).cast(kind)
    parts = counted.withColumn("block", F.pmod(F.col("_h"), per({s: max(1, -(-tokens[s] // block_tokens)) for s in names}, "long")))

    total = total_tokens if total_tokens is not None else default_total(w, tokens, reps)
    quota = {s: round(q) for s, q in fill_quotas(w, {s: float(tokens[s] * reps[s]) for s in names}, float(total)).items()}
    # blocks in permuted order, with the tokens and the number of blocks before each
    blocks = parts.groupBy("source", "block").agg(F.sum("n_tokens").alias("_t")).withColumns({"_order": F.xxhash64("block", F.lit(seed)), "_one": F.lit(1)})
    before = checkpointed(running_before(running_before(blocks, ["source"], "_order", "_t").withColumnRenamed("_before", "_tokens_before"), ["source"], "_order", "_one"))
    n_blocks = {x["source"]: x["n"] for x in before.groupBy("source").agg(F.count("*").alias("n")).collect()}
    # round c of a source uses its blocks again until the quota is reached
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(per(quota, "double") / F.greatest(F.lit(1), per(tokens, "long"))).cast("int") - 1))
    used = before.select("source", "block", "_t", "_tokens_before", "_before", F.explode(rounds).alias("copy_no"))
    left = per(quota, "long") - F.col("copy_no") * per(tokens, "long") - F.col("_tokens_before")
    used = used.withColumn("_left", left).where("_left > 0").select("source", "block", "copy_no", F.when(F.col("_left") < F.col("_t"), F.col("_left")).alias("part"), (F.col("copy_no") * per({s: n_blocks.get(s, 0) for s in names}, "long") + F.col("_before")).alias("_use"))
    used = checkpointed(used)
    n_uses = {x["source"]: x["n"] for x in used.groupBy("source").agg(F.count("*").alias("n")).collect()}
    shards = shards or int(max(16, -(-total // shard_tokens)))
    plan = place_uses(used, names, [n_uses.get(s, 0) for s in names], shards, seed).drop("_use")
    drawn = parts.join(plan, ["source", "block"])
    # the last block of a source is used in part, up to the quota, in hash order
    whole = drawn.where("part is null")
    run = Window.partitionBy("source", "block", "copy_no").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    cut = drawn.where("part is not null").withColumn("_before", F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).where(F.col("_before") < F.col("part")).drop("_before")
    both = whole.unionByName(cut)
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.col(id_col), F.col("copy_no"), F.lit(seed + 1)), id_col, "copy_no")
    mixture = both.select(id_col, "source", "copy_no", "shard", F.row_number().over(place).alias("position"), "n_tokens")
    got = both.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("uses"))
    base = spark.createDataFrame([(s, w[s], reps[s], have.get(s, (0, 0))[1], tokens[s]) for s in names], "source string, target_share double, max_repeats int, n_records long, available_tokens long")
    report = base.join(got, "source", "left").fillna(0, ["mixed_tokens", "uses"])
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())  # one row per listed source
    report = report.withColumn("actual_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(0.0)).withColumn("repeats", F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")))
    return mixture, report.withColumn("capped", F.coalesce(F.col("mixed_tokens") >= F.col("available_tokens") * F.col("max_repeats"), F.lit(True)))
