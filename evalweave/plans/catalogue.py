"""The queries of the engine, each over whole tables; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions import text as T
from evalweave.functions.stats import exact_percentiles
from evalweave.operators import agreement, chunking, generation, ir, judging, references, retrieval, sampling, tables
from evalweave.operators.providers import HashedWords, WordOverlap
from evalweave.plans import cells, oracles
from evalweave.sources import settings

FRAMEWORKS = ["ir_nDCG@10", "ragas_faithfulness", "ares_composite"]
Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d):
    return tables.current_corpus(_read(spark, d, "corpus"))


def asked(spark, d):
    return tables.current_queries(_read(spark, d, "queries"))


def stated(spark, d):
    """The query set of searches: ids divisible by 50, against all documents."""
    return tables.stated_queries(asked(spark, d))


def judgements(spark, d):
    return tables.current_qrels(_read(spark, d, "qrels"))


def fixed_chunks(spark, d, size=64):
    return chunking.chunk_fixed(corpus(spark, d), size, text_col="doc_text", keep=["dataset"])


def last_answers(spark, d):
    """The last delivery of every answer."""
    g = _read(spark, d, "generation").withColumn("query_id", T.clean_id(F.col("query_id"))).where("query_id is not null")
    return tables.latest(g.select("dataset", "config_id", "query_id", "question", "answer", "contexts", "latency_ms", "cost_eur", "cached", "tokens_in", "tokens_out", "received_at", "gen_id"), ["dataset", "config_id", "query_id"], ["received_at", "gen_id"])


# ---------------------------------------------------------------- references (problem 6)


def _reference_tables(spark, d):
    R = references
    qrels, chunks = _read(spark, d, "qrels"), _read(spark, d, "chunks")
    refs = [
        R.references(qrels, "qrels", "doc_id", "qrel_id", "judged_at", "corpus"),
        R.references(chunks, "chunks", "doc_id", "chunk_row", "built_at", "corpus"),
        R.references(qrels, "qrels", "query_id", "qrel_id", "judged_at", "queries"),
    ]
    targets = [R.parents(_read(spark, d, "corpus"), "corpus", "doc_id", "loaded_at", "deleted_at"), R.parents(_read(spark, d, "queries"), "queries", "query_id", "added_at")]
    return refs, targets


@query
def p6_found(spark, d):
    return references.orphan_references(*_reference_tables(spark, d))


@query
def p6_report(spark, d):
    refs, targets = _reference_tables(spark, d)
    return references.orphan_report(references.orphan_references(refs, targets), refs)


# ---------------------------------------------------------------- scans, samples, chunks


@query
def config_matrix(spark, d):
    return settings.configs_frame(spark, settings.default_experiment())


@query
def document_texts(spark, d):
    return corpus(spark, d).select("dataset", "doc_id", "doc_text", F.size(T.tokens(F.col("doc_text"))).alias("n_tokens"))


@query
def query_sample(spark, d):
    return sampling.sample_queries(asked(spark, d), judgements(spark, d), 100).select("dataset", "query_id", "text")


@query
def corpus_pool(spark, d):
    return sampling.pool_corpus(corpus(spark, d), judgements(spark, d), 300).select("dataset", "doc_id")


@query
def chunk_fixed(spark, d):
    return fixed_chunks(spark, d).select("dataset", "chunk_id", "doc_id", "chunk_ix", "text")


@query
def chunk_sliding(spark, d):
    return chunking.chunk_sliding(corpus(spark, d), 64, 16, text_col="doc_text", keep=["dataset"])


@query
def sentences(spark, d):
    return corpus(spark, d).select("dataset", "doc_id", F.posexplode(T.sentences(F.col("doc_text"))).alias("sentence_no", "sentence"))


@query
def chunk_semantic_packed(spark, d):
    return chunking.chunk_packed(corpus(spark, d), 96, text_col="doc_text", keep=["dataset"])


@query
def chunk_semantic_embed(spark, d):
    return chunking.chunk_semantic(corpus(spark, d), HashedWords(), 384, 0.55, text_col="doc_text", keep=["dataset"])


# ---------------------------------------------------------------- retrieval


@query
def bm25_index_stats(spark, d):
    c = fixed_chunks(spark, d)
    return retrieval.index_stats(c, ["dataset"]).select("dataset", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_document_frequency(spark, d):
    p = retrieval.postings(fixed_chunks(spark, d), ["dataset"])
    return p.groupBy("dataset", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_run(spark, d, k=100):
    return retrieval.bm25(stated(spark, d), fixed_chunks(spark, d), k)


def text_run(spark, d, k=100):
    q = retrieval.embed(stated(spark, d), HashedWords(), ["dataset", "query_id"])
    c = retrieval.embed(fixed_chunks(spark, d), HashedWords(), ["dataset", "chunk_id"])
    return retrieval.dense(q, c, k, "query_id", "chunk_id", group="dataset")


def hybrid_run(spark, d, k=100):
    return retrieval.fuse(bm25_run(spark, d, 2 * k), text_run(spark, d, 2 * k), ["dataset", "query_id"], k)


def reranked_run(spark, d):
    return retrieval.rerank(bm25_run(spark, d), stated(spark, d), fixed_chunks(spark, d), WordOverlap(), ["dataset", "query_id"])


def _shown(run):
    return run.select("dataset", "query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_topk(spark, d):
    return _shown(bm25_run(spark, d))


@query
def dense_topk_text(spark, d):
    return _shown(text_run(spark, d))


@query
def dense_topk(spark, d):
    """Nearest vectors of every fiftieth vector, itself excluded."""
    v = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_vec"), "vec")
    return retrieval.dense(q, v, 20, "query_vec", "vec_id", exclude_self=True).select("query_vec", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def hybrid_rrf(spark, d):
    return _shown(hybrid_run(spark, d))


@query
def rerank_topk(spark, d):
    return _shown(reranked_run(spark, d))


# ---------------------------------------------------------------- IR metrics


@query
def run_to_documents(spark, d):
    return ir.to_documents(bm25_run(spark, d), ["dataset", "query_id"])


def _rounded(df, names):
    return df.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


METRICS = ["P@1", "P@3", "P@5", "P@10", "MRR", "nDCG@10"]


@query
def ir_per_query(spark, d):
    return _rounded(ir.per_query(bm25_run(spark, d), stated(spark, d), judgements(spark, d)), METRICS)


@query
def ir_summary(spark, d):
    return _rounded(ir.summarise(ir.per_query(bm25_run(spark, d), stated(spark, d), judgements(spark, d)), ["dataset"]), [f"ir_{m}" for m in METRICS])


def all_cells(spark, d, embedder=None):
    """All cells; without an embedder, as in the SQL, semantic chunks are sentences packed by size."""
    exp = settings.default_experiment()
    q, c = stated(spark, d), cells.make_chunks(corpus(spark, d), exp, embedder=embedder)
    return exp, q, c, cells.all_runs(q, c, exp)


@query
def cell_ir_per_query(spark, d):
    exp, q, _, runs = all_cells(spark, d)
    return _rounded(cells.ir_cells(runs, q, judgements(spark, d), exp), METRICS)


@query
def cell_ir_summary(spark, d):
    exp, q, _, runs = all_cells(spark, d)
    return _rounded(cells.summary(cells.ir_cells(runs, q, judgements(spark, d), exp)), [f"ir_{m}" for m in METRICS])


@query
def cell_ir_per_query_embed(spark, d):
    """As cell_ir_per_query, the semantic cells on similarity-driven chunks."""
    exp, q, _, runs = all_cells(spark, d, HashedWords())
    return _rounded(cells.ir_cells(runs, q, judgements(spark, d), exp), METRICS)


@query
def cell_ir_summary_embed(spark, d):
    exp, q, _, runs = all_cells(spark, d, HashedWords())
    return _rounded(cells.summary(cells.ir_cells(runs, q, judgements(spark, d), exp)), [f"ir_{m}" for m in METRICS])


# ---------------------------------------------------------------- generation and judging


@query
def contexts_top5(spark, d):
    return generation.contexts(bm25_run(spark, d), fixed_chunks(spark, d), ["dataset", "query_id"]).select("dataset", "query_id", F.size("contexts").alias("n_contexts"), F.array_join("contexts", "\n").alias("joined"))


@query
def prompt_build(spark, d):
    g = last_answers(spark, d)
    return g.select("dataset", "config_id", "query_id", F.md5(generation.prompt(F.col("question"), F.col("contexts"))).alias("prompt_md5"))


@query
def gen_cost_latency(spark, d):
    g = last_answers(spark, d).withColumn("cost_eur", generation.cost_eur(F.col("tokens_in"), F.col("tokens_out")))
    out = generation.cost_summary(g, ["dataset", "config_id"])
    return out.select("dataset", "config_id", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("cost_eur_per_1k", 9).alias("cost_eur_per_1k"), "n_calls")


@query
def llm_cache_misses(spark, d):
    """Distinct calls of the answers that were not cached and have no cached twin."""
    g = last_answers(spark, d).withColumn("key", generation.cache_key("offline", 0.0, F.col("question"), F.col("contexts")))
    known = g.where("cached").select("key").distinct()
    return g.where("not cached").select("key").distinct().join(known, "key", "left_anti")


@query
def judge_prompts(spark, d):
    g = last_answers(spark, d)
    return g.select("dataset", "config_id", "query_id", F.md5(judging.judge_prompt(F.col("question"), F.col("contexts"), F.col("answer"))).alias("prompt_md5"))


def marks(spark, d):
    """Deterministic stand-in marks of the answers."""
    g = last_answers(spark, d)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return g.select("dataset", "config_id", "query_id", yes(F.size("contexts") > 0).alias("context_relevance"), yes(F.length("answer") > 20).alias("answer_faithfulness"), yes(F.col("tokens_out") > 8).alias("answer_relevance"))


def labels(spark, d, every=5):
    """Deterministic stand-in labels of every fifth query, or of all with ``every=None``."""
    q = asked(spark, d)
    if every:
        q = q.where(F.regexp_extract("query_id", r"(\d+)$", 1).cast("long") % every == 0)
    bit = lambda i: (F.conv(F.substring(F.md5("query_id"), i, 1), 16, 10).cast("int") % 2)
    return q.select("dataset", "query_id", *[bit(i + 1).alias(x) for i, x in enumerate(judging.DIMS)])


@query
def judge_parse(spark, d):
    """Marks parsed from replies as judges write them, made from the events' JSON."""
    e = _read(spark, d, "events").select("event_id", F.concat(F.lit('Marks: {"context_relevance": '), (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(', "answer_faithfulness": true')).otherwise(F.lit("")), F.lit(', "answer_relevance": "'), (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 7 == 0, F.lit('"')).otherwise(F.lit('"} as asked'))).alias("reply"))
    return e.select("event_id", *[c.alias(k) for k, c in judging.parse_reply(F.col("reply")).items()])


@query
def judge_composite(spark, d):
    return _rounded(judging.composite(marks(spark, d), ["dataset", "config_id"]), ["ares_composite"])


@query
def ppi_by_config(spark, d):
    return _rounded(judging.ppi(marks(spark, d), labels(spark, d), ["dataset", "config_id"]), ["ares_composite", "ares_ci_lo", "ares_ci_hi"])


@query
def ppi_global(spark, d):
    return _rounded(judging.ppi(marks(spark, d), labels(spark, d), ["dataset", "config_id"], mode="global"), ["ares_composite", "ares_ci_lo", "ares_ci_hi"])


@query
def ragas_faithfulness(spark, d):
    v = judgements(spark, d).select("dataset", "query_id", (F.col("rel") > 0).cast("int").alias("verdict"))
    return _rounded(judging.faithfulness(v, ["dataset", "query_id"]), ["ragas_faithfulness"])


@query
def ragas_context_precision(spark, d):
    j = judgements(spark, d)
    v = j.select("dataset", "query_id", F.row_number().over(Window.partitionBy("dataset", "query_id").orderBy("doc_id")).alias("rank"), (F.col("rel") > 0).cast("int").alias("verdict"))
    return _rounded(judging.context_precision(v, ["dataset", "query_id"]), ["ragas_context_relevancy"])


@query
def ragas_answer_relevancy(spark, d):
    g = last_answers(spark, d).select("dataset", "config_id", "query_id", ((F.coalesce("tokens_out", F.lit(0)) % 100) / 100).alias("similarity"), F.when(F.length("answer") > 20, 0).otherwise(1).alias("noncommittal"))
    return _rounded(judging.answer_relevancy(g, ["dataset", "query_id"]), ["ragas_answer_relevancy"])


# ---------------------------------------------------------------- statistics


def scores(spark, d):
    return _read(spark, d, "summary")


@query
def spearman_matrix(spark, d):
    return _rounded(agreement.spearman_matrix(scores(spark, d), FRAMEWORKS), ["spearman_rho"])


def report(spark, d):
    by = ["dataset", "framework_a", "framework_b"]
    long = agreement.pairs_long(scores(spark, d), FRAMEWORKS, ["dataset"])
    return agreement.spearman(long, by).drop("n").join(agreement.bootstrap_hashed(long, by, settings.default_experiment().bootstrap_iters), by, "left")


@query
def bootstrap_spearman_md5(spark, d):
    return _rounded(report(spark, d), ["spearman_rho", "ci_lo", "ci_hi"])


@query
def bootstrap_spearman_seeded(spark, d):
    long = agreement.pairs_long(scores(spark, d).withColumn("config_ord", F.col("config_id")), FRAMEWORKS, ["dataset", "config_ord"])
    return agreement.bootstrap_seeded(long, ["dataset", "framework_a", "framework_b"])


@query
def agreement_pattern_shift(spark, d):
    return _rounded(agreement.pattern_shift(report(spark, d), "msmarco", "nq"), ["rho_msmarco", "rho_nq", "delta"])


@query
def cross_dataset_stability(spark, d):
    x = agreement.across_datasets(scores(spark, d), FRAMEWORKS, "msmarco", "nq")
    return _rounded(agreement.spearman(x, ["framework"]).withColumnRenamed("spearman_rho", "rho_cross_dataset"), ["rho_cross_dataset"])


def factor_scores(spark, d):
    """Per-query scores with factors: the latencies of the last answers in whole tens of milliseconds."""
    g = last_answers(spark, d).where("latency_ms is not null and not isnan(latency_ms)")
    f = F.split("config_id", "__")
    return g.select("dataset", "query_id", f[0].alias("chunking"), f[1].alias("retrieval"), f[2].alias("rerank"), F.round(F.col("latency_ms") / 10).alias("score"))


@query
def paired_factor_scores(spark, d):
    return _rounded(agreement.paired_scores(factor_scores(spark, d), ["chunking", "retrieval", "rerank"], "score"), ["x", "y"])


@query
def wilcoxon_w(spark, d):
    t = agreement.wilcoxon(agreement.paired_scores(factor_scores(spark, d), ["chunking", "retrieval", "rerank"], "score"), ["dataset", "variable", "a", "b"], 9)
    return _rounded(t.drop("p"), ["W", "effect_r"])


@query
def variable_attribution(spark, d):
    t = agreement.variable_attribution(factor_scores(spark, d), ["chunking", "retrieval", "rerank"], "score", digits=9)
    return _rounded(t, ["W", "p", "effect_r", "p_adj"])


@query
def holm_bonferroni(spark, d):
    """Correction of given p values: the share of late answers of each config, one family per data set."""
    g = last_answers(spark, d).groupBy("dataset", "config_id").agg((F.avg((F.coalesce("tokens_out", F.lit(0)) > 200).cast("int")) / 20).alias("p"))
    return _rounded(agreement.holm(g, ["dataset"], ["config_id"]), ["p", "p_adj"])


@query
def score_cube(spark, d):
    """Mean scores over all subsets of the factors."""
    c = scores(spark, d).cube("chunking", "retrieval", "rerank").agg(F.round(F.avg("`ir_nDCG@10`"), 9).alias("mean_ndcg"), F.round(F.avg("ragas_faithfulness"), 9).alias("mean_faithfulness"), F.count("*").alias("n_cells"))
    return c


@query
def latency_summary(spark, d):
    """Exact percentiles of the answers' latency per config, by linear interpolation."""
    g = last_answers(spark, d).where("latency_ms is not null and not isnan(latency_ms)")
    got = exact_percentiles(g, ["dataset", "config_id"], "latency_ms", {"lo": 0.025, "median": 0.5, "hi": 0.975})
    return got.select("dataset", "config_id", *[F.round(c, 6).alias(c) for c in ("lo", "median", "hi")])


# ---------------------------------------------------------------- annotation


def sheet(spark, d):
    g = last_answers(spark, d).where("config_id = 'fixed__hybrid__cross_encoder'")
    return sampling.annotation_sheet(g)


@query
def annotation_sheet(spark, d):
    s = sheet(spark, d)
    return s.withColumn("contexts_shown", F.md5("contexts_shown"))


def _stores(spark, d):
    q = labels(spark, d, None)
    old = q.withColumn("seq", F.lit(1).cast("bigint"))
    new = q.where(F.col("context_relevance") == 1).withColumn("answer_relevance", 1 - F.col("answer_relevance")).withColumn("seq", F.lit(2).cast("bigint"))
    return old, new


@query
def label_upsert(spark, d):
    return sampling.upsert_labels(*_stores(spark, d)).select("dataset", "query_id", *judging.DIMS, "seq")


@query
def label_inputs(spark, d):
    """Typed labels, made from the events' numbers, parsed or refused."""
    n = F.col("event_id")
    raw = F.concat_ws(",", (n % 2).cast("string"), (n % 3).cast("string"), F.when(n % 5 > 0, F.lit(" 1 ")))
    return _read(spark, d, "events").select("event_id", F.array_join(F.transform(sampling.parse_label_input(raw), lambda x: x.cast("string")), "").alias("marks"))


@query
def labels_remaining(spark, d):
    return sampling.remaining(sheet(spark, d), labels(spark, d)).select("dataset", "query_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over all queries of a small folder, scored per query."""
    qs = asked(spark, d)
    return ir.per_query(retrieval.bm25(qs, fixed_chunks(spark, d)), qs, judgements(spark, d))


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in _ALL}
