"""IR metrics of runs against judgements: precision at k, reciprocal rank, nDCG.

Chunks count for their document, at its first rank.  Queries without hits score
0 and stay in the mean; precision divides by k; the ideal gain uses all
judgements of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions import text as T

KS = (1, 3, 5, 10)


def to_documents(run: DataFrame, by: list[str]) -> DataFrame:
    """The ranking of distinct documents: (by, doc_id, doc_rank)."""
    d = run.select(*by, T.parent_of(F.col("chunk_id")).alias("doc_id"), "rank").groupBy(*by, "doc_id").agg(F.min("rank").alias("_r"))
    return d.select(*by, "doc_id", F.row_number().over(Window.partitionBy(*by).orderBy("_r")).cast("bigint").alias("doc_rank"))


def gain(rel):
    return F.pow(F.lit(2.0), rel) - 1


def ideal(qrels: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("dataset", "query_id").orderBy(F.desc("rel"))
    g = qrels.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k)
    return g.groupBy("dataset", "query_id").agg(F.sum(gain(F.col("rel")) / F.log2(F.col("_i") + 1)).alias("idcg"))


def per_query(run: DataFrame, queries: DataFrame, qrels: DataFrame, configs: list[str] | None = None, config_rows: list[tuple[str, ...]] | None = None, ks: tuple[int, ...] = KS, depth: int = 10) -> DataFrame:
    """Metrics per config and query.  ``configs`` are the run's config columns; ``config_rows`` lists the values of all configs, so that a query without hits counts in each."""
    configs = configs or []
    by = [*configs, "dataset", "query_id"]
    judged = qrels.select("dataset", "query_id", "doc_id", "rel")
    docs = to_documents(run, by).join(judged, ["dataset", "query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    good = F.col("rel") > 0
    agg = docs.groupBy(*by).agg(
        *[(F.count(F.when(good & (F.col("doc_rank") <= k), 1)) / k).alias(f"P@{k}") for k in ks],
        F.min(F.when(good, F.col("doc_rank"))).alias("_first"),
        F.sum(F.when(F.col("doc_rank") <= depth, gain(F.col("rel")) / F.log2(F.col("doc_rank") + 1))).alias("_dcg"),
    )
    base = queries.select("dataset", "query_id").distinct()
    if config_rows:
        each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(configs, row)]) for row in config_rows]))
        base = base.withColumn("_c", each).select("dataset", "query_id", "_c.*")
    elif configs:
        base = base.join(run.select(*configs, "dataset").distinct(), "dataset")
    out = base.join(agg, by, "left").join(ideal(qrels, depth), ["dataset", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*by, *[zero(F.col(f"`P@{k}`")).alias(f"P@{k}") for k in ks], zero(1.0 / F.col("_first")).alias("MRR"), zero(F.when(F.col("idcg") > 0, F.col("_dcg") / F.col("idcg"))).alias(f"nDCG@{depth}"))


def summarise(per_query: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Means over queries, prefixed ``ir_``."""
    names = names or [c for c in per_query.columns if c.startswith(("P@", "MRR", "nDCG"))]
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(f"`{c}`").alias(f"ir_{c}") for c in names])
