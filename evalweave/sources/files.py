"""BEIR folders, per-cell results, summaries, labels and the call cache as DataFrames.

All schemas are declared; nothing is inferred, so ids stay strings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators import sampling
from evalweave.sources.settings import DatasetSpec

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"
LABELS = "query_id string, context_relevance int, answer_faithfulness int, answer_relevance int"
GENERATION = "query_id string, question string, answer string, contexts array<string>, latency_ms double, cost_eur double, cached boolean"
MARKS = "query_id string, context_relevance int, answer_faithfulness int, answer_relevance int"
METRICS = "query_id string, `nDCG@10` double"
CACHE = "key string, answer string, tokens_in long, tokens_out long, latency_ms double"
FACTORS = ["dataset", "config_id", "chunking", "retrieval", "rerank"]
SCORES = ["ir_P@1", "ir_P@3", "ir_P@5", "ir_P@10", "ir_MRR", "ir_nDCG@10", "ragas_faithfulness", "ragas_answer_relevancy", "ragas_context_relevancy", "ares_composite", "mean_latency_ms", "cost_eur_per_1k", "ares_ci_lo", "ares_ci_hi"]
SUMMARY = ", ".join([f"{c} string" for c in FACTORS] + [f"`{c}` double" for c in SCORES])


@dataclass
class BeirDataset:
    name: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_beir(spark: SparkSession, folder: str, split: str, name: str) -> BeirDataset:
    """A local BEIR folder: corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""
    tag = F.lit(name).alias("dataset")
    corpus = spark.read.schema(CORPUS).json(f"{folder}/corpus.jsonl").select(tag, F.col("_id").alias("doc_id"), "title", "text")
    # rows carry their place in the file, which Spark numbers in ascending order over the splits of one file
    queries = spark.read.schema(QUERIES).json(f"{folder}/queries.jsonl").select(tag, F.col("_id").alias("query_id"), "text", F.monotonically_increasing_id().alias("file_pos"))
    qrels = spark.read.schema(QRELS).csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True).select(tag, F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel"))
    return BeirDataset(name, corpus, queries, qrels)


def load_dataset(spark: SparkSession, folder: str, spec: DatasetSpec, seed: int = 42) -> BeirDataset:
    """A BEIR folder as an experiment uses it: sampled judged queries, their judgements, and the pooled corpus."""
    raw = read_beir(spark, folder, spec.split, spec.name)
    queries = sampling.judged_queries(raw.queries, raw.qrels) if spec.n_queries is None else sampling.sample_queries(raw.queries, raw.qrels, spec.n_queries, seed)
    qrels = sampling.restrict(raw.qrels, queries)
    return BeirDataset(spec.name, sampling.pool_corpus(raw.corpus, qrels, spec.max_corpus, seed), queries, qrels)


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """One row per <root>/<dataset>/<config>/summary.json, with ``config_ord`` by data set and config."""
    s = spark.read.schema(SUMMARY).option("multiLine", True).json(f"{root}/*/*/summary.json")
    return s.withColumn("config_ord", F.concat_ws("/", "dataset", "config_id"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that may not exist yet (label store, cache): empty with its schema then."""
    try:
        df = spark.read.schema(schema).format(kind).option("header", True).load(path)
        df.limit(0).collect()
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_cells(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of all cells with dataset and config_id: what ``write_cells`` left in <root>/<name>, and files <root>/<dataset>/<config>/<name>.jsonl of cells that it lacks."""
    cols = ["dataset", "config_id"]
    own = read_or_empty(spark, f"{root}/{name}", f"{schema}, dataset string, config_id string")
    try:
        single = read_jsonl(spark, f"{root}/*/*/{name}.jsonl", schema)
    except AnalysisException:
        return own
    part = lambda i: F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+)/[^/]+$", i)
    single = single.select("*", part(1).alias("dataset"), part(2).alias("config_id"))
    return own.unionByName(single.join(own.select(*cols).distinct(), cols, "left_anti"))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Human labels of <root>/human_labels/<dataset>.csv; empty where there are none."""
    try:
        got = spark.read.schema(LABELS).csv(f"{root}/human_labels/*.csv", header=True, enforceSchema=False)
    except AnalysisException:
        return spark.createDataFrame([], f"dataset string, {LABELS}")
    return got.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1).alias("dataset"), "*")


def write_summaries(df: DataFrame, root: str) -> None:
    """One <root>/<dataset>/<config>/summary.json per row, as ``read_summaries`` reads them; cells are few."""
    spark = df.sparkSession
    for r in df.collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r.dataset}/{r.config_id}/summary.json")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(r.asDict(), indent=2).encode()))
        out.close()


def write_cells(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows of many cells, one folder per data set and config; cells that the rows lack stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "config_id").format(kind).save(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result table as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(path)


def append_cache(made: DataFrame, path: str) -> None:
    """New cache entries; a later read finds them by key."""
    made.select("key", "answer", "tokens_in", "tokens_out", "latency_ms").write.mode("append").parquet(path)
