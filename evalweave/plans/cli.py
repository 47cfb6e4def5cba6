"""Command line: run the cells of an experiment on a folder of tables, or analyse finished summaries.

    python -m evalweave.plans.cli run (--tables DIR | --beir DIR) --out DIR [--dataset D] [--config C] [--limit N]
    python -m evalweave.plans.cli analyse --results DIR --out DIR

``--beir`` is a folder of one data set; it is sampled, pooled and restricted as
the settings say, and ``--limit`` takes queries in the order of the file.

``analyse`` reads the folder that ``run`` writes, or a folder of the reference:
<dataset>/<config>/summary.json, retrieval and ares_raw per cell, and
human_labels/<dataset>.csv.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions import text as T
from evalweave.operators import judging, tables
from evalweave.operators.providers import FirstSentence, HashedWords, OverlapCritic, OverlapJudge
from evalweave.plans import analysis, cells
from evalweave.session import checkpointed
from evalweave.sources import files, settings


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    exp = settings.load_settings(args.settings) if args.settings else settings.default_experiment()
    if args.beir:
        spec = next((x for x in exp.datasets if x.name == (args.dataset or x.name)), None)
        if spec is None:
            raise ValueError(f"the settings name no data set {args.dataset}")
        data = files.load_dataset(spark, args.beir, spec, exp.seed)
        docs, queries, qrels = data.corpus.withColumn("doc_text", T.document_text(F.col("title"), F.col("text"))), data.queries, data.qrels
    else:
        read = lambda n: spark.read.parquet(f"{args.tables}/{n}.parquet")
        docs, queries, qrels = tables.current_corpus(read("corpus")), tables.current_queries(read("queries")), tables.current_qrels(read("qrels"))
    if args.dataset:
        docs, queries, qrels = (x.where(F.col("dataset") == args.dataset) for x in (docs, queries, qrels))
    if args.limit:
        place = "file_pos" if "file_pos" in queries.columns else "query_id"
        queries = queries.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy(place))).where(F.col("_r") <= args.limit).drop("_r")
    embedder = HashedWords()
    chunks = cells.make_chunks(docs, exp, embedder=embedder)
    runs = cells.all_runs(queries, chunks, exp, embedder)
    if args.config and args.config not in {c.config_id for c in exp.matrix()}:
        raise ValueError(f"no config is called {args.config}")
    if args.config:
        runs = runs.where(F.concat_ws("__", "chunking", "retrieval", "rerank") == args.config)
    per_query = cells.ir_cells(runs, queries, qrels, exp)
    if args.config:
        per_query = per_query.where(F.col("config_id") == args.config)
    per_query = checkpointed(per_query)
    cache = files.read_or_empty(spark, f"{args.out}/cache", files.CACHE)
    generated, made = cells.answers(runs, queries, chunks, exp, FirstSentence(), cache)
    generated = checkpointed(generated)
    marks = checkpointed(judging.judge(generated, OverlapJudge()).select("dataset", "config_id", "query_id", *judging.DIMS))
    ragas = checkpointed(judging.ragas(generated, OverlapCritic(), embedder, ["dataset", "config_id", "query_id"]))
    files.write_cells(per_query, f"{args.out}/retrieval")
    files.write_cells(generated, f"{args.out}/generation")
    files.write_cells(marks, f"{args.out}/ares_raw")
    files.write_cells(ragas, f"{args.out}/ragas")
    files.append_cache(made, f"{args.out}/cache")
    files.write_summaries(cells.summary(per_query, generated, marks, ragas), args.out)


def analyse(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    exp = settings.load_settings(args.settings) if args.settings else settings.default_experiment()
    scores = files.read_summaries(spark, args.results)
    filled = scores.agg(*[F.count(f"`{c}`").alias(c) for c in analysis.FRAMEWORKS]).first()
    scores = scores.drop(*[c for c in analysis.FRAMEWORKS if not filled[c]])
    marks, labels = files.read_cells(spark, args.results, "ares_raw", files.MARKS), files.read_labels(spark, args.results)
    factors = scores.select("dataset", "config_id", "chunking", "retrieval", "rerank")
    per_query = files.read_cells(spark, args.results, "retrieval", files.METRICS).join(F.broadcast(factors), ["dataset", "config_id"])
    pair = [x.name for x in exp.datasets] if len(exp.datasets) == 2 else ["msmarco", "nq"]
    out = analysis.analyse(scores, marks, labels, None if per_query.isEmpty() else per_query, *pair, exp.bootstrap_iters, exp.seed, alpha=exp.alpha)
    for name, df in out.items():
        files.write_table(df, f"{args.out}/{name}")
        df.show(50, False)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run")
    r.add_argument("--out", required=True)
    source = r.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables")
    source.add_argument("--beir")
    for x in ("--dataset", "--config", "--settings"):
        r.add_argument(x)
    r.add_argument("--limit", type=int)
    a = sub.add_parser("analyse")
    for x in ("--results", "--out"):
        a.add_argument(x, required=True)
    a.add_argument("--settings")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("evalweave").getOrCreate()
    run(spark, args) if args.what == "run" else analyse(spark, args)


if __name__ == "__main__":
    main()
