import math
from collections import Counter

import numpy as np
import pytest

from evalweave.operators import ir, retrieval, sampling, tables
from evalweave.operators.providers import WordOverlap

CH = "dataset string, chunk_id string, text string"
QU = "dataset string, query_id string, text string"
CHUNKS = [("a", "d1::c0", "the cat sat on the mat"), ("a", "d2::c0", "the dog chased the cat"), ("a", "d3::c0", "quantum computing uses qubits entangled"), ("a", "d4::c0", None)]


def plain_bm25(query, chunks, k1=0.9, b=0.4):
    docs = {c: (t or "").lower().split() for _, c, t in chunks}
    avg = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = Counter()
    for w in query.lower().split():
        for c, d in docs.items():
            f = d.count(w)
            if f:
                out[c] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avg))
    return out


def test_bm25_against_plain_python(make):
    qs = [("a", "1", "cat mat"), ("a", "2", "quantum qubits"), ("a", "3", "the the cat"), ("a", "4", "nothing here"), ("a", "5", ""), ("b", "6", "cat")]
    run = retrieval.bm25(make(QU, *qs), make(CH, *CHUNKS)).collect()
    for _, q, t in qs[:5]:
        want = plain_bm25(t, CHUNKS)
        got = {r.chunk_id: r.score for r in run if r.query_id == q}
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-8) for c in got)
    assert not [r for r in run if r.query_id == "6"]  # another data set
    assert [r.chunk_id for r in run if r.query_id == "1" and r.rank == 1] == ["d1::c0"]


def test_bm25_empty_tables(make):
    assert retrieval.bm25(make(QU), make(CH, *CHUNKS)).count() == 0
    assert retrieval.bm25(make(QU, ("a", "1", "cat")), make(CH)).count() == 0


def test_bm25_shuffles_only_the_best_of_each_task(make):
    """No posting and no pair of a query and a chunk is moved; blocks and ties agree with plain Python."""
    rng = np.random.default_rng(4)
    chunks = [("a", f"d{i}::c0", " ".join(rng.choice(["the", "The", "old", "mill", "of", f"w{i % 7}"], rng.integers(1, 9)))) for i in range(300)]
    qs = [("a", str(i), " ".join(rng.choice(["the", "mill", "of", "w3", "w5", "none"], 4))) for i in range(9)]
    run = retrieval.bm25(make(QU, *qs), make(CH, *chunks).repartition(5), 20)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan
    want = []
    for _, q, t in qs:
        first = {c: next(i for i, w in enumerate(t.split()) if w in x.lower().split()) for _, c, x in chunks if set(t.split()) & set(x.lower().split())}
        best = sorted((-round(s, 9), first[c], c) for c, s in plain_bm25(t, chunks).items())[:20]
        want += [(q, c, i + 1) for i, (_, _, c) in enumerate(best)]
    for got in (run, retrieval.bm25(make(QU, *qs), make(CH, *chunks).repartition(5), 20, block=4)):
        assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == sorted(want)


def test_dense_is_exact_and_blocks_agree(make):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    items = make("id long, vec array<double>", *[(i, v[i].tolist()) for i in range(60)])
    qs = make("q long, vec array<double>", *[(i, v[i].tolist()) for i in range(0, 60, 10)])
    sims = v[::10] @ v.T
    for block in (2, 2048):
        got = retrieval.dense(qs, items, 5, "q", "id", exclude_self=True, block=block).collect()
        for j, q in enumerate(range(0, 60, 10)):
            order = [i for i in np.argsort(-sims[j], kind="stable") if i != q][:5]
            assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == order


def test_fusion_and_tie(make):
    s = "dataset string, query_id string, chunk_id string, score double, rank int"
    one = make(s, *[("a", "1", c, 1.0, i + 1) for i, c in enumerate("abc")])
    two = make(s, *[("a", "1", c, 1.0, i + 1) for i, c in enumerate("bac")])
    got = sorted(retrieval.fuse(one, two, ["dataset", "query_id"]).collect(), key=lambda r: r.rank)
    assert [r.chunk_id for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(0.03252247488, abs=1e-10) and got[2].score == pytest.approx(0.031746031746, abs=1e-10)


def test_rerank_cuts_and_keeps_order_of_ties(make):
    run = make("dataset string, query_id string, chunk_id string, score double, rank int", ("a", "1", "d2::c0", 9.0, 1), ("a", "1", "d1::c0", 8.0, 2), ("a", "1", "d3::c0", 7.0, 3))
    got = retrieval.rerank(run, make(QU, ("a", "1", "mat")), make(CH, *CHUNKS), WordOverlap(), ["dataset", "query_id"], depth=2)
    assert [r.chunk_id for r in sorted(got.collect(), key=lambda r: r.rank)] == ["d1::c0", "d2::c0"]


def test_metrics(make):
    s = "dataset string, query_id string, chunk_id string, score double, rank int"
    run = make(s, *[("a", "1", c, 1.0, i + 1) for i, c in enumerate(["docA::c0", "docA::c1", "docB::c0", "docC::c0"])])
    qs = make(QU, ("a", "1", "x"), ("a", "2", "no hits"))
    qr = make("dataset string, query_id string, doc_id string, rel int", ("a", "1", "docB", 1), ("a", "2", "docZ", 1))
    got = {r.query_id: r for r in ir.per_query(run, qs, qr, ks=(1, 2)).collect()}
    assert (got["1"]["P@1"], got["1"]["P@2"], got["1"]["MRR"]) == (0.0, 0.5, 0.5) and got["1"]["nDCG@10"] == pytest.approx(0.6309297535714575)
    assert (got["2"]["P@2"], got["2"]["MRR"], got["2"]["nDCG@10"]) == (0.0, 0.0, 0.0)
    graded = make("dataset string, query_id string, doc_id string, rel int", ("a", "1", "docB", 2), ("a", "1", "docC", 1), ("a", "1", "docD", 2))
    assert [r["nDCG@10"] for r in ir.per_query(run, qs, graded).collect() if r.query_id == "1"] == [pytest.approx(0.4437016069115603)]


def test_pool_keeps_relevant(make):
    corpus = make("dataset string, doc_id string", *[("a", f"d{i}") for i in range(100)])
    qr = make("dataset string, query_id string, doc_id string, rel int", ("a", "q", "d0", 1), ("a", "q", "d1", 2), ("a", "q", "gone", 1), ("a", "q", "d5", 0))
    for cap, want in ((10, 10), (None, 100), (1, 2)):
        got = {r.doc_id for r in sampling.pool_corpus(corpus, qr, cap).collect()}
        assert len(got) == want and {"d0", "d1"} <= got


def test_latest_wins_and_deleted_goes(make):
    rows = [(1, "a", " D1 ", "t", "old", "2024-01-01", None), (2, "a", "d1", "t", "new", "2024-02-01", None), (3, "a", "d2", None, "x", "2024-01-01", "2024-03-01"), (4, "a", None, "t", "x", "2024-01-01", None), (5, "a", "  ", "t", "x", "2024-01-01", None)]
    df = make("load_id long, dataset string, doc_id string, title string, text string, loaded_at string, deleted_at string", *rows)
    df = df.selectExpr("load_id", "dataset", "doc_id", "title", "text", "timestamp(loaded_at) loaded_at", "timestamp(deleted_at) deleted_at")
    assert [(r.doc_id, r.doc_text) for r in tables.current_corpus(df).collect()] == [("d1", "t new")]


def test_labels(make):
    s = "dataset string, query_id string, context_relevance int, answer_faithfulness int, answer_relevance int, seq long"
    got = sampling.upsert_labels(make(s, ("a", "1", 0, 0, 0, 1), ("a", "2", 1, 1, 1, 1)), make(s, ("a", "1", 1, 1, 1, 2))).collect()
    assert {(r.query_id, r.seq) for r in got} == {("1", 2), ("2", 1)}
    parsed = make("t string", ("1,0 1",), ("1 2 0",), ("1 0",), (None,)).select(sampling.parse_label_input(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("v")).collect()
    assert [r.v for r in parsed] == [[1, 0, 1], None, None, None]
