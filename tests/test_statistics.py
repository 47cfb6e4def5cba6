import math
import random

import numpy as np
import pytest

from evalweave.operators import agreement as A
from evalweave.operators import judging
from evalweave.plans import analysis

def test_spearman_perfect_constant_and_ties(make):
    rows = [("a", f"c{i}", float(i), float(i * i), 1.0, float(i // 2)) for i in range(8)]
    df = make("dataset string, config_id string, x1 double, x2 double, const double, tied double", *rows)
    got = {(r.framework_a, r.framework_b): r.spearman_rho for r in A.spearman_matrix(df, ["x1", "x2", "const", "tied"]).collect()}
    assert got["x1", "x2"] == pytest.approx(1.0) and got["x1", "const"] is None and got["const", "const"] is None
    assert got["x1", "tied"] == pytest.approx(np.corrcoef(range(8), [0.5, 0.5, 2.5, 2.5, 4.5, 4.5, 6.5, 6.5])[0, 1])


def test_seeded_bootstrap_is_the_plain_loop(make):
    rng = random.Random(1)
    rows = [("a", i, rng.random(), rng.random()) for i in range(12)]
    df = make("dataset string, config_ord int, x double, y double", *rows)
    got = A.bootstrap_seeded(df, ["dataset"], n_boot=300).first()
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    g = np.random.default_rng(42)

    def rank(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    boots = []
    for _ in range(300):
        i = g.integers(0, 12, 12)
        a, b = rank(x[i]), rank(y[i])
        if a.std() and b.std():
            boots.append(np.corrcoef(a, b)[0, 1])
    lo, hi = np.percentile(boots, [2.5, 97.5])
    assert got.ci_lo == pytest.approx(lo) and got.ci_hi == pytest.approx(hi) and got.ci_lo <= got.spearman_rho <= got.ci_hi


def test_published_wilcoxon_example(make):
    d = [0.1, -0.2, 0.2, 0.3, 0.0, 0.4]
    df = make("g string, x double, y double", *[("a", v, 0.0) for v in d])
    r = A.wilcoxon(df, ["g"]).first()
    assert (r.W, r.n) == (2.5, 6) and r.effect_r == pytest.approx(2 / 3) and r.p == pytest.approx(0.17555430277322986)


def test_wilcoxon_without_difference_and_empty(make):
    s = "g string, x double, y double"
    r = A.wilcoxon(make(s, ("a", 1.0, 1.0), ("a", 2.0, 2.0 + 1e-12)), ["g"]).first()
    assert (r.W, r.p, r.effect_r, r.n) == (None, 1.0, 0.0, 2)
    assert A.wilcoxon(make(s), ["g"]).count() == 0


def test_effect_and_holm(make):
    rng = random.Random(4)
    rows = []
    for q in range(60):
        base = rng.random()
        for r in ("bm25", "dense"):
            for c in ("fixed", "sliding"):
                rows.append(("a", str(q), c, r, "none", base + (0.15 if r == "dense" else 0) + rng.gauss(0, 0.05)))
    df = make("dataset string, query_id string, chunking string, retrieval string, rerank string, score double", *rows)
    got = {r.variable: r for r in A.variable_attribution(df, ["chunking", "retrieval"], "score").collect()}
    assert got["retrieval"].p < 0.01 and got["retrieval"].effect_r < -0.5 and got["retrieval"].significant and got["retrieval"].n == 60
    assert got["chunking"].p_adj >= got["chunking"].p


def test_published_holm(make):
    # Published p (before correction) and p_adj of one data set's five tests.
    p = [1e-10, 0.04, 0.03, 0.9, 0.02]
    got = A.holm(make("d string, p double, i int", *[("a", v, i) for i, v in enumerate(p)]), ["d"], ["i"]).orderBy("p").collect()
    want, top = [], 0.0
    for i, v in enumerate(sorted(p)):
        top = max(top, min(1.0, v * (5 - i)))
        want.append(top)
    assert [r.p_adj for r in got] == pytest.approx(want) and [r.significant for r in got] == [w < 0.05 for w in want]


def test_shift(make):
    s = "dataset string, framework_a string, framework_b string, spearman_rho double, ci_lo double, ci_hi double"
    rep = make(s, ("m", "x", "y", 0.5, 0.4, 0.6), ("n", "x", "y", -0.1, -0.2, 0.1), ("m", "x", "z", 0.1, None, None), ("n", "x", "z", 0.2, 0.1, 0.3), ("m", "q", "z", 0.1, 0.0, 0.2))
    got = {(r.framework_a, r.framework_b): r for r in A.pattern_shift(rep, "m", "n").collect()}
    assert got["x", "y"].delta == pytest.approx(-0.6) and not got["x", "y"].ci_overlap and got["x", "z"].ci_overlap and got["q", "z"].rho_n is None


def test_ppi(make):
    m = "dataset string, config_id string, query_id string, context_relevance int, answer_faithfulness int, answer_relevance int"
    all_ = [1, 1, 0, 1, 1, 0, 1, 1]
    marks = make(m, *[("a", "c", str(i), v, v, v) for i, v in enumerate(all_)], *[("b", "c", str(i), v, v, v) for i, v in enumerate(all_)])
    human = make("dataset string, query_id string, context_relevance int, answer_faithfulness int, answer_relevance int", *[("a", str(i), v, v, v) for i, v in enumerate([1, 0, 0, 1])])
    got = {r.dataset: r for r in judging.ppi(marks, human, ["dataset", "config_id"]).collect()}
    judged, lab = np.array(all_, float), np.array([1, 0, 0, 1.0])
    rect = lab - judged[:4]
    half = 1.959963984540054 * math.sqrt(judged.var(ddof=1) / 8 + rect.var(ddof=1) / 4)
    assert got["a"].ares_composite == pytest.approx(0.5) and got["a"].ares_ci_lo == pytest.approx(0.5 - half) and got["a"].ares_ci_hi == pytest.approx(0.5 + half)
    assert got["b"].ares_composite == pytest.approx(0.75) and got["b"].ares_ci_lo is None  # no labels: raw, no interval
    assert judging.ppi(marks, human, ["dataset", "config_id"], mode="global").count() == 2


def test_answer_ratios(make):
    v = make("q string, rank int, verdict int", ("1", 1, 1), ("1", 2, 0), ("1", 3, 1), ("2", 1, 0))
    assert {r.q: r.ragas_context_relevancy for r in judging.context_precision(v, ["q"]).collect()} == {"1": pytest.approx((1 + 2 / 3) / 2), "2": 0.0}
    assert {r.q: r.ragas_faithfulness for r in judging.faithfulness(v, ["q"]).collect()} == {"1": pytest.approx(2 / 3), "2": 0.0}
    s = make("q string, similarity double, noncommittal int", ("1", 0.5, 0), ("1", 0.7, 1), ("2", 0.9, 1))
    assert {r.q: r.ragas_answer_relevancy for r in judging.answer_relevancy(s, ["q"]).collect()} == {"1": pytest.approx(0.6), "2": 0.0}


def test_analysis_sizes(make):
    rng = random.Random(2)
    rows = [(d, f"c{i}", i, rng.random(), rng.random(), rng.random()) for d in ("msmarco", "nq") for i in range(18)]
    df = make("dataset string, config_id string, config_ord int, `ir_nDCG@10` double, ragas_faithfulness double, ares_composite double", *rows)
    out = analysis.analyse(df, n_boot=50)
    assert out["framework_agreement"].count() == 6 and out["cross_dataset_stability"].count() == 3 and out["agreement_pattern_shift"].count() == 3
