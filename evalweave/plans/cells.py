"""All cells of an experiment in one plan: chunk once per chunker, rank once per index, fuse, rerank, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators import chunking, generation, ir, judging, retrieval
from evalweave.operators.providers import Embedder, HashedWords, Scorer, WordOverlap, Writer
from evalweave.session import checkpointed, written
from evalweave.sources.settings import Experiment

BY = ["chunking", "retrieval", "rerank", "dataset", "query_id"]


def make_chunks(docs: DataFrame, exp: Experiment, text_col: str = "doc_text", embedder: Embedder | None = HashedWords()) -> DataFrame:
    """chunking, dataset, chunk_id, doc_id, chunk_ix, text of every chunker of the experiment.

    Indexes, rerankers and contexts all read the chunks, so they are written once to the checkpoint folder, compressed.
    ``embedder=None`` is the reference's run without a model: ``semantic`` packs sentences by size alone.
    """
    parts = [chunking.chunk_by_name(f.name, docs, f.params, embedder, text_col=text_col, keep=["dataset"]).withColumn("chunking", F.lit(f.name)) for f in exp.chunking]
    return written(reduce(DataFrame.unionByName, parts))


def base_runs(queries: DataFrame, chunks: DataFrame, exp: Experiment, embedder: Embedder) -> DataFrame:
    """The runs of every retriever, over all chunkers together; fusion takes twice the depth of each side."""
    names = {f.name for f in exp.retrieval}
    depth, deep = exp.depth, 2 * exp.depth
    by = ["chunking", "dataset"]
    keep = ["chunking", "dataset", "query_id", "chunk_id", "score", "rank"]
    runs = {}
    if names & {"bm25", "hybrid"}:
        runs["bm25"] = retrieval.bm25(queries, chunks, deep, by=by).select(*keep)
    if names & {"dense", "hybrid"}:
        qv = retrieval.embed(queries, embedder, ["dataset", "query_id"])
        cv = retrieval.embed(chunks, embedder, ["chunking", "dataset", "chunk_id"])
        runs["dense"] = retrieval.dense(qv, cv, deep, "query_id", "chunk_id", group="dataset", parts=["chunking"]).select(*keep)
    # each base run is read two or three times; it is written once to the shared folder
    runs = {k: checkpointed(v) for k, v in runs.items()} if "hybrid" in names else runs
    out = [runs[k].where(F.col("rank") <= depth).withColumn("retrieval", F.lit(k)) for k in ("bm25", "dense") if k in names]
    if "hybrid" in names:
        out.append(retrieval.fuse(runs["bm25"], runs["dense"], ["chunking", "dataset", "query_id"], depth).withColumn("retrieval", F.lit("hybrid")).select(*out[0].columns if out else [*keep, "retrieval"]))
    return reduce(DataFrame.unionByName, out)


def all_runs(queries: DataFrame, chunks: DataFrame, exp: Experiment, embedder: Embedder | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Runs of all configs: chunking, retrieval, rerank, dataset, query_id, chunk_id, score, rank."""
    base = checkpointed(base_runs(queries, chunks, exp, embedder or HashedWords()))
    cols = [*BY, "chunk_id", "score", "rank"]
    parts = []
    for x in exp.rerank:
        if x.name == "none":
            parts.append(base.withColumn("rerank", F.lit("none")).select(*cols))
        else:
            r = retrieval.rerank(base, queries, chunks, scorer or WordOverlap(), ["chunking", "retrieval", "dataset", "query_id"], x.params.get("depth", 50), ["chunking", "dataset", "chunk_id"])
            parts.append(r.withColumn("rerank", F.lit(x.name)).select(*cols))
    return reduce(DataFrame.unionByName, parts)


def ir_cells(runs: DataFrame, queries: DataFrame, qrels: DataFrame, exp: Experiment) -> DataFrame:
    """Per-query metrics of all cells; queries without hits count in every config."""
    rows = [(c.chunking, c.retrieval, c.rerank) for c in exp.matrix()]
    q = ir.per_query(runs, queries, qrels, ["chunking", "retrieval", "rerank"], rows, exp.k_values)
    return q.withColumn("config_id", F.concat_ws("__", "chunking", "retrieval", "rerank"))


def answers(runs: DataFrame, queries: DataFrame, chunks: DataFrame, exp: Experiment, writer: Writer, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers of all cells, new cache entries): equal prompts of different configs are asked once."""
    ctx = generation.contexts(runs, chunks, BY, exp.top_k_context, ["chunking", "dataset", "chunk_id"])
    req = ctx.join(queries.select("dataset", "query_id", F.col("text").alias("question")), ["dataset", "query_id"]).withColumn("config_id", F.concat_ws("__", "chunking", "retrieval", "rerank"))
    return generation.generate(req, cache, writer)


def summary(per_query: DataFrame, generated: DataFrame | None = None, marks: DataFrame | None = None, ragas: DataFrame | None = None) -> DataFrame:
    """One row per cell: mean metrics, latency, cost, answer quality and judge composite as far as given."""
    by = ["dataset", "config_id", "chunking", "retrieval", "rerank"]
    out = ir.summarise(per_query, by)
    if generated is not None:
        out = out.join(generation.cost_summary(generated, ["dataset", "config_id"]), ["dataset", "config_id"], "left")
    if ragas is not None:
        names = [c for c in ragas.columns if c.startswith("ragas_")]
        out = out.join(ragas.groupBy("dataset", "config_id").agg(*[F.avg(c).alias(c) for c in names]), ["dataset", "config_id"], "left")
    if marks is not None:
        out = out.join(judging.composite(marks, ["dataset", "config_id"]), ["dataset", "config_id"], "left")
    return out
