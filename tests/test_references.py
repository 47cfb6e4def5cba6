from pyspark.sql import functions as F

from evalweave.operators import references as R

REF = "row long, dataset string, doc_id string, at string, begins int"
PAR = "dataset string, doc_id string, b string, e string, key string"


def _judge(make, refs, parents):
    r = make(REF, *refs).withColumn("at", F.col("at").cast("timestamp"))
    p = make(PAR, *parents).withColumn("b", F.col("b").cast("timestamp")).withColumn("e", F.col("e").cast("timestamp"))
    rr = R.references(r, "t", "doc_id", "row", "at", "corpus")
    pp = R.parents(p, "corpus", "doc_id", "b", "e")
    return rr, R.orphan_references([rr], [pp])


def test_reasons_spelling_ties_and_repeats(make):
    refs = [
        (1, "a", " D1 ", "2024-02-01", 0),
        (2, "a", "d2", "2024-02-01", 0),
        (3, "a", "nope", "2024-02-01", 0),
        (4, "a", "d1", "2023-12-01", 0),
        (5, "b", "d1", "2024-02-01", 0),
        (6, "a", None, "2024-02-01", 0),
        (7, "a", "  ", "2024-02-01", 0),
        (8, "a", "d3", "2024-01-15", 0),
        (9, "a", "d1", "2024-01-01", 0),
        (10, "a", "d2", "2024-01-10", 0),
        (3, "a", "nope", "2024-02-01", 0),
        (11, "a", "nope", None, 0),
        (12, "a", "d1", None, 0),
    ]
    parents = [("a", "d1", "2024-01-01", None, "x"), ("a", "D2", "2024-01-01", "2024-01-10", "x"), ("a", "d3", "2024-01-01", "2024-01-10", "x"), ("a", "d3", "2024-02-01", None, "x"), ("a", "d1", "2024-01-01", None, "x")]
    rr, got = _judge(make, refs, parents)
    rows = sorted((r.row_id, r.reason, r.ref_month) for r in got.collect() if r.ref_month)
    assert rows == [(2, "deleted", "2024-02"), (3, "missing", "2024-02"), (3, "missing", "2024-02"), (4, "late", "2023-12"), (5, "missing", "2024-02"), (8, "deleted", "2024-01"), (10, "deleted", "2024-01")]
    assert [(r.row_id, r.reason) for r in got.collect() if r.ref_month is None] == [(11, "missing")]
    rep = {r.ref_month: r for r in R.orphan_report(got, [rr]).collect()}
    assert rep["2024-02"].n_references == 5 and rep["2024-02"].n_missing == 3 and rep[None].n_missing == 1 and rep["2024-01"].n_deleted == 2


def test_empty_tables(make):
    assert _judge(make, [], [("a", "d", "2024-01-01", None, "x")])[1].count() == 0
    assert [r.reason for r in _judge(make, [(1, "a", "d", "2024-01-01", 0)], [])[1].collect()] == ["missing"]


def test_hot_key(make):
    refs = [(i, "a", "hot" if i % 3 else f"k{i}", "2024-02-01", 0) for i in range(600)]
    got = _judge(make, refs, [("a", "hot", "2024-03-01", None, "x")])[1]
    c = {r.reason: r["count"] for r in got.groupBy("reason").count().collect()}
    assert c == {"late": 400, "missing": 200}


def test_sweep_against_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(4)
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 90))
    keys = ["hot"] * 30 + [f"k{i}" for i in range(12)]
    pars = []
    for i in range(160):
        b = when() if rng.random() < 0.95 else None
        e = rng.choice([None, when(), b])
        pars.append((i, rng.choice(["a", None]), rng.choice(keys), b, e))
    rows = [(i, rng.choice(["a", None]), rng.choice([*keys, "none", None, " HOT "]), when() if rng.random() < 0.95 else None) for i in range(1500)]
    rows += [(2000 + i, g, k, t) for i, (_, g, k, b, e) in enumerate(pars) for t in (b, e)]  # the very moments of change
    p = spark.createDataFrame(pars, "i int, dataset string, doc_id string, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame(rows, "row_id long, dataset string, doc_id string, at timestamp")
    want = []
    for i, g, k, t in rows:
        if k is None:
            continue
        k = k.strip().lower()
        mine = [(b or dt.datetime.min, e) for _, pg, pk, b, e in pars if (pg, pk) == (g, k)]
        if not mine:
            why = "missing"
        elif t is None or any(b <= t and (e is None or t < e) for b, e in mine):
            continue
        else:
            why = "late" if min(b for b, _ in mine) > t else "deleted"
        want.append((i, why, t.strftime("%Y-%m") if t else None))
    got = R.orphan_references([R.references(r, "x", "doc_id", "row_id", "at", "t")], [R.parents(p, "t", "doc_id", "loaded_at", "deleted_at")])
    key = lambda x: (x[0], x[1], x[2] or "")
    assert sorted(((x.row_id, x.reason, x.ref_month) for x in got.collect()), key=key) == sorted(want, key=key)
    assert len({w for _, w, _ in want}) == 3
