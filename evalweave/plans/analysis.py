"""The analysis of finished cells: calibration, agreement, stability, shift, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators import agreement, judging

FRAMEWORKS = ["ir_nDCG@10", "ragas_faithfulness", "ares_composite"]


def analyse(scores: DataFrame, marks: DataFrame | None = None, labels: DataFrame | None = None, per_query: DataFrame | None = None, a: str = "msmarco", b: str = "nq", n_boot: int = 10_000, seed: int = 42, order: str = "config_ord", alpha: float = 0.05) -> dict[str, DataFrame]:
    """Result tables by name.  Score columns that are absent are left out; marks and labels calibrate the judge composite first; cells without marks keep theirs.  ``alpha`` is that of the calibration and of the attribution."""
    if marks is not None and labels is not None:
        cal = judging.ppi(marks, labels, ["dataset", "config_id"], alpha).withColumnRenamed("ares_composite", "_cal")
        raw = F.col("ares_composite") if "ares_composite" in scores.columns else F.lit(None)
        scores = scores.drop("ares_ci_lo", "ares_ci_hi").join(cal, ["dataset", "config_id"], "left").withColumn("ares_composite", F.coalesce("_cal", raw)).drop("_cal")
    cols = [c for c in FRAMEWORKS if c in scores.columns]
    by = ["dataset", "framework_a", "framework_b"]
    long = agreement.pairs_long(scores, cols, ["dataset", order])
    report = agreement.bootstrap_seeded(long, by, n_boot, seed, order=order)
    out = {
        "tidy_config_scores": scores,
        "framework_agreement": report,
        "cross_dataset_stability": agreement.bootstrap_seeded(agreement.across_datasets(scores, cols, a, b, order), ["framework"], 10_000, 42, order=order).withColumnRenamed("spearman_rho", "rho_cross_dataset"),
        "agreement_pattern_shift": agreement.pattern_shift(report, a, b),
        "spearman_matrix": agreement.spearman_matrix(scores, cols),
    }
    if per_query is not None:
        out["variable_attribution"] = agreement.variable_attribution(per_query, ["chunking", "retrieval", "rerank"], alpha=alpha)
    return out
