"""Sampling of queries, pooling of corpora, annotation sheets and the label store."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions import text as T
from evalweave.operators.tables import latest

LABELS = ("context_relevance", "answer_faithfulness", "answer_relevance")


def hash_order(seed: int, *cols: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) for c in cols]))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement, of whatever grade."""
    return queries.join(qrels.select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_semi")


def sample_queries(queries: DataFrame, qrels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n judged queries per data set in hash order."""
    w = Window.partitionBy("dataset").orderBy(hash_order(seed, "query_id"), "query_id")
    return judged_queries(queries, qrels).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def restrict(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """The judgements of the given queries."""
    return qrels.join(queries.select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_semi")


def sample_ids_seeded(ids: list[str], n: int, rng: random.Random) -> set[str]:
    """Parity mode on the driver, for small id lists: the generator's own sample of the sorted ids."""
    ordered = sorted(ids)
    return set(rng.sample(ordered, min(n, len(ordered))))


def pool_corpus(corpus: DataFrame, qrels: DataFrame, max_corpus: int | None, seed: int = 42) -> DataFrame:
    """Relevant documents, always kept, and distractors in hash order up to ``max_corpus`` per data set; None keeps all."""
    if max_corpus is None:
        return corpus
    good = qrels.where("rel > 0").select("dataset", "doc_id").distinct()
    relevant = corpus.join(good, ["dataset", "doc_id"], "left_semi")
    n = relevant.groupBy("dataset").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("dataset").orderBy(hash_order(seed, "doc_id"), "doc_id")
    rest = corpus.join(good, ["dataset", "doc_id"], "left_anti").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_corpus)
    rest = rest.join(F.broadcast(n), "dataset", "left").where(F.col("_r") <= max_corpus - F.coalesce("_n", F.lit(0))).drop("_r", "_n")
    return relevant.unionByName(rest)


def annotation_sheet(generation: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """n rows per data set in hash order with numbered contexts and blank label columns."""
    w = Window.partitionBy("dataset").orderBy(hash_order(seed, "query_id"), "query_id")
    top = generation.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.select("dataset", "query_id", "question", T.numbered(F.col("contexts")).alias("contexts_shown"), "answer", *[F.lit("").alias(x) for x in LABELS])


def upsert_labels(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The label store after new entries: the entry with the larger ``seq`` wins per (dataset, query_id)."""
    return latest(stored.unionByName(new), ["dataset", "query_id"], ["seq", *LABELS])


def remaining(sheet: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of a sheet without a label."""
    return sheet.join(labels.select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_anti")


def parse_label_input(raw):
    """Three 0/1 values divided by commas or blanks, as an array of ints; null for anything else."""
    parts = T.tokens(F.regexp_replace(raw, ",", " "))
    ok = (F.size(parts) == 3) & F.forall(parts, lambda x: x.isin("0", "1"))
    return F.when(ok, F.transform(parts, lambda x: x.cast("int")))
