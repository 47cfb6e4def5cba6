import argparse
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalweave.operators.providers import FirstSentence
from evalweave.plans import catalogue, cells, cli
from evalweave.sources import files, settings


def test_settings(tmp_path):
    raw = {"chunking": [{"name": "fixed"}], "retrieval": [{"name": "bm25"}, {"name": "dense"}], "rerank": [{"name": "none"}], "datasets": [{"name": "nq"}], "evaluation": {"ir": {"k_values": [1, 2]}}}
    f = tmp_path / "s.json"
    f.write_text(json.dumps(raw))
    exp = settings.load_settings(f)
    assert [c.config_id for c in exp.matrix(2)] == ["fixed__bm25__none", "fixed__dense__none"] and exp.k_values == (1, 2)
    with pytest.raises(ValueError):
        exp.matrix(12)
    with pytest.raises(ValueError, match="rerank"):
        settings.parse_settings({"chunking": [1], "retrieval": [1]})
    assert len(settings.default_experiment().matrix(12)) == 12


def test_beir_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "001", "title": "T", "text": "x"}\n{"_id": "2", "text": null}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "why"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t001\t2\n")
    d = files.read_beir(spark, str(tmp_path), "test", "nq")
    assert {r.doc_id for r in d.corpus.collect()} == {"001", "2"} and d.qrels.first().rel == 2 and d.queries.first().dataset == "nq"


def test_stores(spark, tmp_path):
    empty = files.read_or_empty(spark, str(tmp_path / "none"), files.CACHE)
    assert empty.count() == 0 and empty.columns[0] == "key"
    row = spark.createDataFrame([("k", "a", 1, 2, 3.0)], files.CACHE)
    files.append_cache(row, str(tmp_path / "cache"))
    files.append_cache(row, str(tmp_path / "cache"))
    assert files.read_or_empty(spark, str(tmp_path / "cache"), files.CACHE).count() == 2
    folder = tmp_path / "r/nq/c"
    folder.mkdir(parents=True)
    (folder / "summary.json").write_text(json.dumps({"dataset": "nq", "config_id": "c", "ir_P@1": 0.5}, indent=2))
    s = files.read_summaries(spark, str(tmp_path / "r")).first()
    assert s["ir_P@1"] == 0.5 and s["ares_ci_lo"] is None and s.config_ord == "nq/c"


def test_whole_matrix(make):
    docs = make("dataset string, doc_id string, doc_text string", *[("a", f"d{i}", f"Word{i} stands here. The cat number {i} sleeps.") for i in range(8)])
    qs = make("dataset string, query_id string, text string", ("a", "q1", "word3 cat"), ("a", "q2", "zzz"))
    qr = make("dataset string, query_id string, doc_id string, rel int", ("a", "q1", "d3", 1), ("a", "q2", "d0", 1))
    exp = settings.default_experiment()
    chunks = cells.make_chunks(docs, exp)
    runs = cells.all_runs(qs, chunks, exp)
    per = cells.ir_cells(runs, qs, qr, exp)
    assert per.count() == 24
    assert {r.config_id: r["P@1"] for r in per.where("query_id = 'q1'").collect()}["fixed__bm25__none"] == 1.0
    made, new = cells.answers(runs, qs, chunks, exp, FirstSentence())
    assert made.select("config_id").distinct().count() == 12
    s = cells.summary(per, made)
    assert s.count() == 12 and {"ir_nDCG@10", "mean_latency_ms"} <= set(s.columns)


def test_semantic_cells_follow_similarity(make):
    docs = make("dataset string, doc_id string, doc_text string", ("a", "d", "The cat sleeps. The cat eats. Rivers flow east."))
    exp = settings.parse_settings({"chunking": [{"name": "fixed", "params": {"chunk_size": 4, "overlap": 2}}, {"name": "semantic", "params": {"max_chunk_size": 384, "similarity_threshold": 0.55, "embed_model": "m"}}], "retrieval": [{"name": "bm25"}], "rerank": [{"name": "none"}]})
    got = {(r.chunking, r.chunk_ix): r.text for r in cells.make_chunks(docs, exp).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "semantic"} == {0: "The cat sleeps. The cat eats.", 1: "Rivers flow east."}
    assert got["fixed", 1] == "sleeps. The cat eats." and ("fixed", 3) in got
    alone = cells.make_chunks(docs, exp, embedder=None).where("chunking = 'semantic'").collect()
    assert [r.text for r in alone] == ["The cat sleeps. The cat eats. Rivers flow east."]
    exp.chunking[1].params["sise"] = 3
    with pytest.raises(ValueError, match="sise"):
        cells.make_chunks(docs, exp)


def test_chunks_are_written_compressed(spark, make):
    """The texts of all chunkers stand on disk at a part of their length, and are read back whole."""
    text = " ".join(f"The old mill of town {i % 50} stands by the river." for i in range(400))
    docs = make("dataset string, doc_id string, doc_text string", *[("a", f"d{i}", text) for i in range(50)])
    cells.make_chunks(docs.limit(1), settings.default_experiment())  # names the folder
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p for p in folder.rglob("*") if p.is_file()}
    chunks = cells.make_chunks(docs, settings.default_experiment())
    on_disk = sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and p not in before)
    back = {(r.doc_id, r.chunking): r.text for r in chunks.groupBy("doc_id", "chunking").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x["text"]), " ").alias("text")).collect()}
    assert len(back) == 100 and set(back.values()) == {text}
    assert 0 < on_disk < 0.5 * len(text) * 100


def test_run_is_analysed(spark, make, tmp_path):
    t = "2024-01-01 00:00:00"
    both = [(d, i) for d in ("msmarco", "nq") for i in range(6)]
    tables = {
        "corpus": make("load_id long, dataset string, doc_id string, title string, text string, loaded_at string, deleted_at string", *[(i, d, f"d{i}", "", f"Word{i} stands here. The cat number {i} sleeps.", t, None) for d, i in both]),
        "queries": make("dataset string, query_id string, text string, batch_no int, added_at string", *[(d, f"q{i}", f"word{i} cat", 1, t) for d, i in both]),
        "qrels": make("qrel_id long, dataset string, query_id string, doc_id string, rel int, judged_at string", *[(i, d, f"q{i}", f"d{i}", 1, t) for d, i in both]),
    }
    for k, v in tables.items():
        v.write.parquet(f"{tmp_path}/in/{k}.parquet")
    args = dict(tables=f"{tmp_path}/in", beir=None, out=f"{tmp_path}/r", settings=None, dataset=None, limit=None)
    cli.run(spark, argparse.Namespace(**args, config="fixed__bm25__none"))
    cli.run(spark, argparse.Namespace(**args, config="semantic__bm25__none"))
    assert {r.config_id for r in files.read_summaries(spark, f"{tmp_path}/r").collect()} == {"fixed__bm25__none", "semantic__bm25__none"}
    (tmp_path / "r/human_labels").mkdir()
    for d in ("msmarco", "nq"):
        (tmp_path / f"r/human_labels/{d}.csv").write_text("query_id,context_relevance,answer_faithfulness,answer_relevance\nq0,1,1,0\nq1,1,1,1\n")
    # a third cell in the reference's layout
    cell = tmp_path / "r/nq/fixed__dense__none"
    cell.mkdir(parents=True)
    (cell / "summary.json").write_text(json.dumps({"dataset": "nq", "config_id": "fixed__dense__none", "chunking": "fixed", "retrieval": "dense", "rerank": "none", "ir_nDCG@10": 0.5, "ares_composite": 0.25}))
    (cell / "retrieval.jsonl").write_text('{"query_id": "q0", "nDCG@10": 0.5}\n')
    exp = tmp_path / "s.json"
    exp.write_text(json.dumps({"chunking": [{"name": "fixed"}], "retrieval": [{"name": "bm25"}], "rerank": [{"name": "none"}], "stats": {"bootstrap_iters": 20, "alpha": 0.2}}))
    out = cli.analyse(spark, argparse.Namespace(results=f"{tmp_path}/r", out=f"{tmp_path}/a", settings=str(exp)))
    tidy = {(r.dataset, r.config_id): r for r in out["tidy_config_scores"].collect()}
    assert len(tidy) == 5 and tidy["nq", "fixed__dense__none"].ares_composite == 0.25
    # the judged marks are shifted by the labels of the labelled queries
    marks = {r.query_id: r for r in files.read_cells(spark, f"{tmp_path}/r", "ares_raw", files.MARKS).where("dataset = 'nq' and config_id = 'fixed__bm25__none'").collect()}
    want = sum(sum(m[d] for m in marks.values()) / 6 + sum(lab - marks[q][d] for q, lab in (("q0", a), ("q1", b))) / 2 for d, a, b in (("context_relevance", 1, 1), ("answer_faithfulness", 1, 1), ("answer_relevance", 0, 1))) / 3
    r = tidy["nq", "fixed__bm25__none"]
    assert abs(r.ares_composite - want) < 1e-9 and r.ares_ci_lo < want < r.ares_ci_hi and sum(m.context_relevance for m in marks.values()) > 0
    assert 0 <= r.ragas_faithfulness <= 1 and r.ragas_answer_relevancy is not None and r.ragas_context_relevancy is not None
    got = {(r.dataset, r.variable): r for r in out["variable_attribution"].collect()}
    assert got["nq", "chunking"].n == 6 and got["nq", "retrieval"].n == 1 and ("msmarco", "chunking") in got
    assert tidy["nq", "fixed__dense__none"].ragas_faithfulness is None and out["framework_agreement"].count() == 6


def test_the_writer_is_asked_once_per_prompt(make, tmp_path):
    from evalweave.operators import generation

    class Counting(FirstSentence):
        """Notes every prompt in a file."""

        def __init__(self, path):
            self.path = path

        def load(self):
            write = FirstSentence.load(self)

            def noted(prompts):
                with open(self.path, "a") as f:
                    f.write("x" * len(prompts))
                return write(prompts)

            return noted

    req = make("query_id string, question string, contexts array<string>", *[(str(i), f"q{i % 3}", ["Yes it is. More."]) for i in range(9)])
    rows, made = generation.generate(req, None, Counting(str(tmp_path / "n")))
    assert rows.count() == 9 and made.count() == 3 and rows.agg({"tokens_out": "sum"}).first()[0] > 0
    assert len((tmp_path / "n").read_text()) == 3


def test_ragas(make):
    from evalweave.operators import judging
    from evalweave.operators.providers import HashedWords, OverlapCritic

    rows = [("1", "who built the mill", "The mill was built by Arden. Pigs can surely fly.", ["In 1880 the mill was built by Arden.", "Other things."]), ("2", None, None, None), ("3", "why", "No", [None])]
    got = {r.query_id: r for r in judging.ragas(make("query_id string, question string, answer string, contexts array<string>", *rows), OverlapCritic(), HashedWords(), ["query_id"]).collect()}
    assert got["1"].ragas_faithfulness == 0.5 and got["1"].ragas_context_relevancy == 1.0 and 0 < got["1"].ragas_answer_relevancy < 1
    assert got["2"].ragas_faithfulness is None and got["2"].ragas_context_relevancy == 0.0 and got["3"].ragas_answer_relevancy == 0.0


def test_dataset_of_an_experiment(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "title": "", "text": f"Word{i} stands here."}) + "\n" for i in range(20)))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{9 - i}", "text": f"word{i}"}) + "\n" for i in range(10)))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{9 - i}\td{i}\t1\n" for i in range(8)))
    d = files.load_dataset(spark, str(tmp_path), settings.DatasetSpec("nq", n_queries=5, max_corpus=9))
    kept = {r.query_id for r in d.queries.collect()}
    assert len(kept) == 5 and {r.query_id for r in d.qrels.collect()} == kept
    assert d.corpus.count() == 9 and {r.doc_id for r in d.qrels.collect()} <= {r.doc_id for r in d.corpus.collect()}
    exp = tmp_path / "s.json"
    exp.write_text(json.dumps({"chunking": [{"name": "fixed"}], "retrieval": [{"name": "bm25"}], "rerank": [{"name": "none"}], "datasets": [{"name": "nq"}]}))
    cli.main(["run", "--beir", str(tmp_path), "--out", str(tmp_path / "r"), "--dataset", "nq", "--limit", "3", "--settings", str(exp)])
    got = files.read_cells(spark, str(tmp_path / "r"), "retrieval", files.METRICS).collect()
    assert {r.query_id for r in got} == {"q9", "q8", "q7"} and all(r["nDCG@10"] == 1.0 for r in got)


def test_full_queries_take_all_draws_and_entries(spark, make, tmp_path):
    scores = [(d, f"c{i}", float(i), float((i * i) % 7), float((3 * i) % 5)) for d in ("msmarco", "nq") for i in range(6)]
    make("dataset string, config_id string, `ir_nDCG@10` double, ragas_faithfulness double, ares_composite double", *scores).write.parquet(f"{tmp_path}/summary.parquet")
    q = catalogue.queries()
    # a few draws are all of one config and have no rank correlation
    assert min(r.n_boot for r in q["bootstrap_spearman_md5"](spark, str(tmp_path)).collect()) > 9_900
    assert q["agreement_pattern_shift"](spark, str(tmp_path)).count() == 3
    make("dataset string, query_id string, text string, batch_no int, added_at string", *[("nq", f"q{i}", "why", 1, "2024-01-01") for i in range(11)]).write.parquet(f"{tmp_path}/queries.parquet")
    assert {r.query_id for r in q["label_upsert"](spark, str(tmp_path)).collect()} == {f"q{i}" for i in range(11)}
