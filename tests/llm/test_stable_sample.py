
from evalweave.llm import stable_sample as S

Q = "dataset string, query_id string, text string, bucket int"


def _ids(df):
    return {(r.dataset, r.query_id) for r in df.collect()}


def test_same_in_every_layout_and_growth(make):
    rows = [("a", f"q{i}", "t", 0) for i in range(3000)]
    df = make(Q, *rows)
    one = S.sample_keys({"q": df}, ["dataset", "query_id"], 0.2)
    base = _ids(one)
    assert base == _ids(S.sample_keys({"q": df.repartition(7)}, ["dataset", "query_id"], 0.2))
    grown = make(Q, *rows, *[("a", f"r{i}", "t", 0) for i in range(3000)], *rows[:500])
    after = _ids(S.sample_keys({"q": grown}, ["dataset", "query_id"], 0.2))
    assert base == {k for k in after if k[1].startswith("q")}
    assert base < _ids(S.sample_keys({"q": df}, ["dataset", "query_id"], 0.35))
    assert 0.17 < len(base) / 3000 < 0.23


def test_spelling_nulls_empty_and_rates(make):
    df = make(Q, ("a", " Q1 ", "t", 0), ("A", "q1", "t", 0), ("a", None, "t", 0), (None, "q1", "t", 0), ("a", "   ", "t", 0))
    got = S.sample_keys({"x": df}, ["dataset", "query_id"], 1.0).collect()
    assert [(r.dataset, r.query_id, r.n_x) for r in got] == [("a", "q1", 2)]
    assert S.sample_keys({"x": df}, ["dataset", "query_id"], 0.0).count() == 0
    assert S.sample_keys({"x": df.where("false")}, ["dataset", "query_id"], 1.0).count() == 0
    assert S.select_rows(df, ["dataset", "query_id"], 1.0).count() == 2  # other columns, also one named bucket, pass through


def test_permutation_is_one():
    assert len({(b * S.MULTIPLIER + S.OFFSET) % S.BUCKETS for b in range(S.BUCKETS)}) == S.BUCKETS
    assert S.listed(1.0) == S.BUCKETS and S.listed(0) == 0


def test_filter_needs_no_shuffle(make):
    plan = S.select_rows(make(Q, ("a", "q", "t", 0)), ["query_id"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_both_tables_meet(make):
    a, b = make(Q, ("a", "q1", "t", 0)), make("dataset string, query_id string", ("a", "Q1"), ("a", "q2"))
    got = {r.query_id: (r.n_a, r.n_b) for r in S.sample_keys({"a": a, "b": b}, ["dataset", "query_id"], 1.0).collect()}
    assert got == {"q1": (1, 1), "q2": (0, 1)}
