"""Queries of the problems that belong to this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import joined_null_safe
from evalweave.llm import langid, leakage, mixture, pairs, quantiles, splitting, stable_sample, truncation

SAMPLE_RATE = 0.1
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    tables = {"queries": _read(spark, d, "queries"), "generation": _read(spark, d, "generation")}
    return stable_sample.sample_keys(tables, ["dataset", "query_id"], SAMPLE_RATE)


def p1_sample_batches(spark: SparkSession, d: str) -> DataFrame:
    """Selected query deliveries per batch: the sample's part of every batch."""
    q = stable_sample.select_rows(_read(spark, d, "queries"), ["dataset", "query_id"], SAMPLE_RATE)
    return q.groupBy("dataset", "batch_no").agg(F.count("*").alias("n_rows"), F.countDistinct(stable_sample.clean_key(F.col("query_id"))).alias("n_queries"))


def _models(spark: SparkSession, d: str, rows: DataFrame) -> tuple[langid.EcocModel, truncation.EndModel]:
    lm = langid.fit_language_model(_read(spark, d, "documents"))
    return lm, truncation.fit_end_model(rows, lm)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "generation")
    lm, em = _models(spark, d, rows)
    return truncation.score_truncation(rows, em, lm, "gen_id", keep=("source",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ends(spark, d).where("truncated").select("gen_id").distinct()


def p2_source_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_report(_ends(spark, d))


def _calls(spark: SparkSession, d: str, time_col: str | None = None) -> DataFrame:
    return quantiles.distinct_calls(_read(spark, d, "gen_calls"), ["dataset", "config_id"], "latency_ms", "call_id", time_col)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    groups = ["dataset", "config_id"]
    whole = quantiles.merge_sketches(quantiles.build_sketches(_calls(spark, d), groups), groups)
    return quantiles.read_percentiles(whole, groups, PERCENTILES)


def p3_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    groups = ["dataset", "config_id", "day"]
    parts = quantiles.build_sketches(_calls(spark, d, "called_at"), groups)
    return quantiles.read_percentiles(quantiles.merge_sketches(parts, groups, fan_in=1), groups, PERCENTILES)


def p3_days_joined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole, from the merged sketches of the single days."""
    days = quantiles.merge_sketches(quantiles.build_sketches(_calls(spark, d, "called_at"), ["dataset", "config_id", "day"]), ["dataset", "config_id", "day"], fan_in=1)
    groups = ["dataset", "config_id"]
    return quantiles.read_percentiles(quantiles.merge_sketches(days.drop("day"), groups), groups, PERCENTILES)


def _within(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Whether the rank of every percentile is within the stated bound, by counting all rows against it; ``found`` has one row per group."""
    calls = _calls(spark, d).where("value >= 0 and not isnan(value)")
    rows = joined_null_safe(calls, found, ["dataset", "config_id"])
    aggs = [F.count("*").alias("n_valid")]
    for x in PERCENTILES:
        aggs += [F.sum(F.when(F.col("value") < F.col(x), 1).otherwise(0)).alias(f"{x}_below"), F.sum(F.when(F.col("value") <= F.col(x), 1).otherwise(0)).alias(f"{x}_upto"), F.max(f"{x}_rank_error").alias(f"{x}_bound")]
    g = rows.groupBy("dataset", "config_id").agg(*aggs)
    rank = {x: F.ceil(F.col("n_valid") * p) for x, p in PERCENTILES.items()}
    return g.select("dataset", "config_id", "n_valid", *[((F.col(f"{x}_below") + 1 - rank[x] <= F.col(f"{x}_bound")) & (rank[x] - F.col(f"{x}_upto") <= F.col(f"{x}_bound"))).alias(f"{x}_within") for x in PERCENTILES])


def p3_error_check(spark: SparkSession, d: str) -> DataFrame:
    return _within(spark, d, p3_percentiles(spark, d))


def p3_days_error_check(spark: SparkSession, d: str) -> DataFrame:
    """As p3_error_check, for the figures joined from single days."""
    return _within(spark, d, p3_days_joined(spark, d))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key in (("corpus", "load_id"), ("chunks", "chunk_row")):
        p = splitting.split_rows(_read(spark, d, name), key).withColumnRenamed(key, "row_id")
        parts.append(p.select(F.lit(name).alias("table_name"), *p.columns))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0 and n_pieces > 1").select("table_name", "row_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_pieces_check(spark: SparkSession, d: str) -> DataFrame:
    """Per row over a limit: whether every piece is within the limits and the overlap, and the characters that the own parts cover."""
    own = F.coalesce(F.lead("own_start").over(Window.partitionBy("table_name", "row_id").orderBy("piece_no")), F.col("stop"))
    ps = _pieces(spark, d).where("n_pieces > 1").withColumn("_own", own - F.col("own_start"))
    fits = (F.col("n_tokens") <= splitting.MAX_TOKENS) & (F.col("n_chars") <= splitting.MAX_CHARS) & (F.length("piece") == F.col("n_chars"))
    overlap = splitting.token_count(F.substring("piece", F.lit(1), (F.col("own_start") - F.col("start")).cast("int"))) <= splitting.OVERLAP
    return ps.groupBy("table_name", "row_id").agg(F.bool_and(fits & overlap).alias("within"), F.sum("_own").alias("covered"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "generation")
    lm, em = _models(spark, d, rows)
    return pairs.find_defects(rows, lm, em).where("defect is not null").select("gen_id", "defect").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_item_report(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return leakage.find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("largest_share"))


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """The search held against a full scan of all items, on the documents whose id is divisible by 50."""
    return leakage.recall_of_search(_read(spark, d, "documents").where("doc_id % 50 = 0"), _read(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_weights"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_weights"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_findings(_read(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and of each of its single-language stretches."""
    docs = _read(spark, d, "documents")
    got = langid.document_languages(docs, langid.fit_language_model(docs))
    return got.select("doc_id", "main_lang", F.col("confidence").alias("doc_confidence"), F.posexplode_outer("segments").alias("segment_no", "s")).select("doc_id", "main_lang", "doc_confidence", "segment_no", "s.lang", "s.confidence", "s.ambiguous", "s.n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_sample, p1_sample_batches, p2_found, p2_source_report, p3_percentiles, p3_daily_percentiles, p3_days_joined, p3_error_check, p3_days_error_check, p4_found, p4_pieces, p4_pieces_check, p5_found, p7_found, p7_item_report, p7_recall, p8_mixture, p8_report, p9_found, p9_segments)
}

_POS = "((('0x' || substr(md5(dataset || '|' || query_id), 1, 4))::BIGINT * 40503 + 12345) % 65536)"
_KEY = "nullif(lower(regexp_replace({c}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')), '')"
_LISTED = stable_sample.listed(SAMPLE_RATE)
_KEYS = f"SELECT {_KEY.format(c='dataset')} AS dataset, {_KEY.format(c='query_id')} AS query_id"
_TOKENS = "len(regexp_extract_all(text, '[^\\t\\n\\v\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'))"

_BOUND = """
        WITH c AS (SELECT call_id, lower(trim(dataset)) AS dataset, regexp_replace(lower(trim(config_id)), '[ -]+', '_', 'g') AS config_id, max(latency_ms) AS v
                   FROM gen_calls WHERE call_id IS NOT NULL GROUP BY ALL
                   UNION ALL SELECT NULL, lower(trim(dataset)), regexp_replace(lower(trim(config_id)), '[ -]+', '_', 'g'), latency_ms FROM gen_calls WHERE call_id IS NULL)
        SELECT dataset, config_id, count(*) AS n_valid, true AS p50_within, true AS p90_within, true AS p95_within, true AS p99_within, true AS p999_within
        FROM c WHERE v >= 0 AND NOT isnan(v) GROUP BY dataset, config_id"""

ORACLE: dict[str, str] = {
    "p1_sample": f"""
        WITH k AS ({_KEYS}, 1 AS q, 0 AS g FROM queries UNION ALL {_KEYS}, 0, 1 FROM generation)
        SELECT dataset, query_id, ('0x' || substr(md5(dataset || '|' || query_id), 1, 4))::INT AS bucket, {_POS}::INT AS bucket_place, sum(q)::BIGINT AS n_queries, sum(g)::BIGINT AS n_generation
        FROM k WHERE {_POS} < {_LISTED} GROUP BY ALL""",
    "p1_sample_batches": f"""
        WITH k AS ({_KEYS}, dataset AS ds, batch_no FROM queries)
        SELECT ds AS dataset, batch_no, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM k WHERE {_POS} < {_LISTED} GROUP BY ds, batch_no""",
    "p3_error_check": _BOUND,
    "p3_days_error_check": _BOUND,
    "p4_pieces_check": f"""
        SELECT 'corpus' AS table_name, load_id AS row_id, true AS within, length(text) AS covered FROM corpus WHERE {_TOKENS} > 384 OR length(text) > 2600
        UNION ALL SELECT 'chunks', chunk_row, true, length(text) FROM chunks WHERE {_TOKENS} > 384 OR length(text) > 2600""",
    "p4_found": f"""
        SELECT 'corpus' AS table_name, load_id AS row_id FROM corpus WHERE {_TOKENS} > 384 OR length(text) > 2600
        UNION ALL SELECT 'chunks', chunk_row FROM chunks WHERE {_TOKENS} > 384 OR length(text) > 2600""",
}
