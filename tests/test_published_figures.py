"""Published figures of an experiment are reproduced from its scores."""

import pytest

from evalweave.operators import agreement as A
from evalweave.plans import analysis

# Data set, config, nDCG@10, faithfulness, calibrated judge composite, in published order.
SCORES = """
msmarco fixed__bm25__cross_encoder 0.8040653933457452 0.6722348484848485 0.83
msmarco fixed__hybrid__cross_encoder 0.9484468510455291 0.7304031746031746 0.8123333333333332
msmarco fixed__bm25__none 0.61087011612337 0.6517848484848484 0.832
msmarco semantic__dense__cross_encoder 0.9196993994954448 0.6334391774891773 0.7936666666666666
msmarco semantic__bm25__cross_encoder 0.7667866710360424 0.5940714285714287 0.81
msmarco fixed__dense__none 0.907771571142479 0.7404976190476191 0.8206666666666668
msmarco semantic__dense__none 0.8690283886539515 0.6446896825396825 0.8226666666666667
msmarco fixed__hybrid__none 0.7836259620910091 0.6960119047619048 0.8386666666666667
msmarco fixed__dense__cross_encoder 0.9475386889179965 0.7361542124542125 0.8126666666666665
msmarco semantic__bm25__none 0.5893671573097929 0.5868222222222224 0.8183333333333334
msmarco semantic__hybrid__none 0.7738357868561897 0.6176063492063493 0.826
msmarco semantic__hybrid__cross_encoder 0.9210715236052492 0.6359730158730159 0.8073333333333332
nq fixed__bm25__cross_encoder 0.8489332829238831 0.6734006493506494 0.8053333333333335
nq fixed__hybrid__cross_encoder 0.9451105344040361 0.6906976190476192 0.7853333333333333
nq fixed__bm25__none 0.6805360345310751 0.6254333333333333 0.7936666666666667
nq semantic__dense__cross_encoder 0.9028665112378694 0.5609833333333334 0.7936666666666667
nq semantic__bm25__cross_encoder 0.8109220053959646 0.5524857142857142 0.8073333333333332
nq fixed__dense__none 0.921561305139936 0.7092095238095238 0.7906666666666666
nq semantic__dense__none 0.9064779899237764 0.6003333333333334 0.7896666666666666
nq fixed__hybrid__none 0.835711380645648 0.6702642857142858 0.7813333333333334
nq fixed__dense__cross_encoder 0.9450116455497213 0.7051031746031746 0.774
nq semantic__bm25__none 0.6667385332486986 0.5706666666666668 0.8113333333333332
nq semantic__hybrid__none 0.822266718934946 0.5560499999999999 0.7886666666666667
nq semantic__hybrid__cross_encoder 0.9043277755127421 0.5716142857142857 0.7920000000000001
"""
# Rho, lower and upper end per data set and pair (N nDCG@10, F faithfulness, J judge), 10,000 draws, seed 42.
AGREEMENT = """
msmarco N F 0.5874125874125874 -0.02857142857142857 0.9151943462897527
msmarco N J -0.4895104895104896 -0.885304659498208 0.09677419354838711
msmarco F J 0.2657342657342658 -0.2903225806451613 0.7163636363636363
nq N F 0.6433566433566434 0.13355006922609114 0.8857142857142857
nq N J -0.6409817185295869 -0.9554452710353447 -0.08362126681982299
nq F J -0.49737379252022584 -0.8631281791565896 0.10565782951412406
"""
# Rho across the data sets with its interval.
STABILITY = """
N 0.9440559440559443 0.6967509025270759 1.0
F 0.9510489510489512 0.7283018867924529 1.0
J -0.18914214645135352 -0.7153530568928923 0.4035404550720826
"""
# Data set, p and corrected p of the five tests of each.
TESTS = """
msmarco 1.4189897237177375e-45 7.094948618588687e-45
msmarco 1.2236580251806543e-43 4.894632100722617e-43
msmarco 5.002897747045568e-39 1.5008693241136704e-38
msmarco 1.697797921593499e-14 3.395595843186998e-14
msmarco 1.4923848848668793e-06 1.4923848848668793e-06
nq 1.0304130745989395e-40 5.1520653729946974e-40
nq 1.0930133033132376e-33 4.37205321325295e-33
nq 2.3713649887743607e-29 7.114094966323082e-29
nq 5.380655213907401e-12 1.0761310427814802e-11
nq 5.305126259053195e-07 5.305126259053195e-07
"""
NAME = {"N": "ir_nDCG@10", "F": "ragas_faithfulness", "J": "ares_composite"}


def table(text):
    return [line.split() for line in text.strip().split("\n")]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(d, c, i, float(n), float(f), float(j)) for i, (d, c, n, f, j) in enumerate(table(SCORES))]
    df = spark.createDataFrame(rows, "dataset string, config_id string, config_ord int, `ir_nDCG@10` double, ragas_faithfulness double, ares_composite double")
    return {k: v.collect() for k, v in analysis.analyse(df).items()}


def test_agreement(results):
    got = {(r.dataset, r.framework_a, r.framework_b): r for r in results["framework_agreement"]}
    for d, a, b, *want in table(AGREEMENT):
        r = got[d, NAME[a], NAME[b]]
        assert [r.spearman_rho, r.ci_lo, r.ci_hi] == pytest.approx([float(x) for x in want], abs=1e-12)


def test_stability(results):
    got = {r.framework: r for r in results["cross_dataset_stability"]}
    for f, *want in table(STABILITY):
        r = got[NAME[f]]
        assert [r.rho_cross_dataset, r.ci_lo, r.ci_hi] == pytest.approx([float(x) for x in want], abs=1e-12)


def test_shift(results):
    got = {(r.framework_a, r.framework_b): r for r in results["agreement_pattern_shift"]}
    want = {("N", "F"): 0.05594405594405605, ("N", "J"): -0.15147122901909726, ("F", "J"): -0.7631080582544916}
    assert {k: (got[NAME[k[0]], NAME[k[1]]].delta, got[NAME[k[0]], NAME[k[1]]].ci_overlap) for k in want} == {k: (pytest.approx(v, abs=1e-12), True) for k, v in want.items()}


def test_correction(make):
    rows = [(d, float(p), i, float(a)) for i, (d, p, a) in enumerate(table(TESTS))]
    got = A.holm(make("dataset string, p double, i int, want double", *rows), ["dataset"], ["i"]).collect()
    assert all(r.p_adj == pytest.approx(r.want, rel=1e-12) and r.significant for r in got) and len(got) == 10
