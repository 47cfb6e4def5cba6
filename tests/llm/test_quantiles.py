import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.llm import quantiles as Q

PS = (0.01, 0.25, 0.5, 0.9, 0.99, 0.999)


def _check(x, sketch, k):
    xs = np.sort(x)
    for p in PS:
        v = sketch.quantiles([p])[0]
        rank = int(np.ceil(p * len(x)))
        below, upto = np.searchsorted(xs, v, "left"), np.searchsorted(xs, v, "right")
        off = max(0, below + 1 - rank, rank - upto)
        assert off <= Q.rank_error(len(x), p, k)


@pytest.mark.parametrize("order", ["random", "up", "down"])
@pytest.mark.parametrize("n", [1, 50, 5_000, 200_000])
def test_bound_over_merged_parts(n, order):
    x = np.random.default_rng(n).lognormal(6, 1, n).round(1)
    x = np.sort(x) if order == "up" else np.sort(x)[::-1] if order == "down" else x
    for parts in (1, 13):
        total = None
        for part in np.array_split(x, parts):
            s = Q.RelativeSketch()
            s.add(part)
            s = Q.RelativeSketch.load(s.dump())
            total = s if total is None else (total.merge(s) or total)
        assert total.n == n and total.weighted()[1][-1] == n
        assert total.quantiles([0.0, 1.0]) == [x.min(), x.max()]
        _check(x, total, Q.K)
        assert len(total.dump()) < 60_000


def _orders(n):
    x = np.arange(n, dtype=float)
    yield "zoom in", np.concatenate([x[: n // 2], x[: n // 2 - 1 : -1]]).reshape(2, -1).T.ravel()
    yield "zoom out", np.concatenate([x[: n // 2], x[: n // 2 - 1 : -1]]).reshape(2, -1).T.ravel()[::-1]
    yield "organ pipe", np.concatenate([x[::2], x[1::2][::-1]])
    yield "blocks upside down", x.reshape(-1, 500)[::-1].ravel()
    yield "every second twice", np.repeat(x[::2], 2)
    yield "sawtooth", np.concatenate([x[i::97] for i in range(97)])
    yield "one value and a tail", np.where(x % 10 > 0, 5.0, x)


def test_bound_over_adversarial_orders_and_lopsided_merges():
    n = 100_000
    for name, x in _orders(n):
        one = Q.RelativeSketch()
        one.add(x)
        _check(x, one, Q.K)
        single = Q.RelativeSketch()  # value by value: every compaction by the schedule
        for v in x[:6_000]:
            single.add(np.array([v]))
        _check(x[:6_000], single, Q.K)
        total = Q.RelativeSketch()
        total.add(x[: n // 2])
        for part in np.array_split(x[n // 2 :], 700):  # a large sketch and many tiny ones
            s = Q.RelativeSketch()
            s.add(part)
            total.merge(s)
        assert total.n == n, name
        _check(x, total, Q.K)
        level = [Q.RelativeSketch() for _ in range(64)]
        for s, part in zip(level, np.array_split(x, 64)):
            s.add(part)
        while len(level) > 1:  # a balanced tree of merges
            level = [a.merge(b) or a for a, b in zip(level[::2], level[1::2])]
        _check(x, level[0], Q.K)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1e9), min_size=1, max_size=400))
def test_small_inputs_are_exact(values):
    s = Q.RelativeSketch()
    s.add(np.array(values[:150]))
    assert s.quantiles([0.5])[0] == sorted(values[:150])[int(np.ceil(0.5 * len(values[:150]))) - 1]


S = "dataset string, config_id string, latency_ms double, call_id long, called_at string, n long"


def _calls(make, rows):
    return make(S, *rows).withColumn("called_at", F.col("called_at").cast("timestamp"))


def test_groups_copies_nulls_and_days(make):
    rows = [("a", "X y", float(i), i, f"2024-01-0{1 + i % 3} 10:00:00", 1) for i in range(1, 101)]
    rows += rows[:40]  # delivered twice
    rows += [("a", "x_Y ", None, 900, "2024-01-01 10:00:00", 1), ("a", "x-y", float("nan"), 901, "2024-01-01 10:00:00", 1), ("a", "x_y", -5.0, 902, "2024-01-01 10:00:00", 1), ("b", "z", None, 903, "2024-01-01 10:00:00", 1)]
    g = ["dataset", "config_id"]
    df = _calls(make, rows)
    whole = Q.merge_sketches(Q.build_sketches(Q.distinct_calls(df, g, "latency_ms", "call_id"), g), g)
    got = {r.dataset: r for r in Q.read_percentiles(whole, g, {"p50": 0.5, "p99": 0.99}).collect()}
    assert (got["a"].n, got["a"].n_left_out, got["a"].p50, got["a"].p99) == (100, 3, 50.0, 99.0)
    assert got["b"].n == 0 and got["b"].p50 is None and got["b"].n_left_out == 1
    days = [*g, "day"]
    daily = Q.merge_sketches(Q.build_sketches(Q.distinct_calls(df, g, "latency_ms", "call_id", "called_at"), days), days, fan_in=1)
    assert daily.where("n > 0").count() == 3
    joined = Q.read_percentiles(Q.merge_sketches(daily.drop("day"), g), g, {"p50": 0.5}).where("dataset = 'a'").first()
    assert (joined.n, joined.p50) == (100, 50.0)


def test_calls_without_an_id_all_count(make, spark, tmp_path):
    from evalweave.llm import queries

    rows = [("a", "x", v, None, f"2024-01-0{1 + i % 2} 10:00:00", 1) for i, v in enumerate([5.0] * 30 + [9.0] * 10)]
    rows += [("a", "x", None, None, "2024-01-01 10:00:00", 1)] * 2 + [("a", "x", 7.0, 1, "2024-01-01 10:00:00", 1)] * 2
    _calls(make, rows).write.parquet(f"{tmp_path}/gen_calls.parquet")
    for q in (queries.p3_percentiles, queries.p3_days_joined):
        r = q(spark, str(tmp_path)).first()
        assert (r.n, r.n_left_out, r.p50, r.p90) == (41, 2, 5.0, 9.0)
    assert [r.n for r in queries.p3_daily_percentiles(spark, str(tmp_path)).orderBy("day").collect()] == [21, 20]
    check = queries.p3_error_check(spark, str(tmp_path)).first()
    assert check.n_valid == 41 and check.p50_within and check.p999_within


def test_empty_table(make):
    g = ["dataset", "config_id"]
    parts = Q.build_sketches(Q.distinct_calls(_calls(make, []), g, "latency_ms", "call_id"), g)
    assert Q.read_percentiles(Q.merge_sketches(parts, g), g, {"p50": 0.5}).count() == 0
