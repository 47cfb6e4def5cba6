"""Do frameworks rank configs alike?  Spearman, bootstrap, stability, shift, Wilcoxon, Holm."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import average_rank, pearson, running_before, two_sided_p


def pairs_long(scores: DataFrame, cols: list[str], by: list[str], all_pairs: bool = False) -> DataFrame:
    """(by, config_id, framework_a, framework_b, x, y) of the pairs of score columns."""
    names = [(a, b) for a in cols for b in cols] if all_pairs else list(combinations(cols, 2))
    items = [F.struct(F.lit(a).alias("framework_a"), F.lit(b).alias("framework_b"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in names]
    return scores.select(*by, "config_id", F.explode(F.array(*items)).alias("_p")).select(*by, "config_id", "_p.*")


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    """rho per group; a constant side or a single row gives null.  Rows with a null on either side are left out."""
    p = pairs.where("x is not null and y is not null")
    r = p.withColumn("_rx", average_rank("x", by)).withColumn("_ry", average_rank("y", by))
    return r.groupBy(*by).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman_rho"), F.count("*").alias("n"))


def spearman_matrix(scores: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs of columns, the diagonal too, per data set."""
    return spearman(pairs_long(scores, cols, ["dataset"], True), ["dataset", "framework_a", "framework_b"])


def bootstrap_hashed(pairs: DataFrame, by: list[str], n_boot: int = 1000, seed: int = 42, alpha: float = 0.05, order: str = "config_id") -> DataFrame:
    """Percentile interval of rho; the draw of a slot is a hash of iteration, slot and seed, so it can be checked in SQL.

    Groups are small tables of configs; the iterations are spread over the cluster.
    """
    p = pairs.where("x is not null and y is not null")
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = p.select(*by, "x", "y", (F.row_number().over(w) - 1).alias("_i"), n.alias("_n"))
    items = rows.groupBy(*by, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", "x", "y"))).alias("_rows"))
    it = items.withColumn("_it", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).repartition(*by, "_it")
    slots = it.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("_it").cast("string"), F.col("_slot").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = slots.select(*by, "_it", F.element_at("_rows", (draw + 1).cast("int")).alias("_r")).select(*by, "_it", F.col("_r.x").alias("x"), F.col("_r.y").alias("y"))
    rho = spearman(drawn, [*by, "_it"]).where("spearman_rho is not null")
    return rho.groupBy(*by).agg(F.count("*").alias("n_boot"), F.percentile("spearman_rho", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("spearman_rho", F.lit(1 - alpha / 2)).alias("ci_hi"))


def _average_ranks(m: np.ndarray) -> np.ndarray:
    """Average ranks along the rows of a matrix."""
    less = (m[:, :, None] > m[:, None, :]).sum(-1)
    same = (m[:, :, None] == m[:, None, :]).sum(-1)
    return less + (same + 1) / 2.0


def rho_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = _average_ranks(x), _average_ranks(y)
    a -= a.mean(1, keepdims=True)
    b -= b.mean(1, keepdims=True)
    d = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(d > 0, (a * b).sum(1) / d, np.nan)


def bootstrap_seeded(pairs: DataFrame, by: list[str], n_boot: int = 10_000, seed: int = 42, alpha: float = 0.05, order: str = "config_ord") -> DataFrame:
    """rho and percentile interval with numpy's seeded generator, drawing in row order: reproduces published intervals.

    The groups are the configs of an experiment (tens of rows), one Arrow group each.
    """
    types = dict(pairs.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values(order, kind="stable")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        n = len(x)
        if not n:
            return pd.DataFrame([(*key, None, None, None)], columns=[*by, "spearman_rho", "ci_lo", "ci_hi"])
        rng = np.random.default_rng(seed)
        idx = np.stack([rng.integers(0, n, n) for _ in range(n_boot)])
        boots = np.concatenate([rho_rows(x[i], y[i]) for i in np.array_split(idx, max(1, n_boot // 1000))])
        boots = boots[~np.isnan(boots)]
        point = rho_rows(x[None], y[None])[0]
        lo, hi = np.percentile(boots, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if len(boots) else (None, None)
        return pd.DataFrame([(*key, None if np.isnan(point) else point, lo, hi)], columns=[*by, "spearman_rho", "ci_lo", "ci_hi"])

    return pairs.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", spearman_rho double, ci_lo double, ci_hi double")


def across_datasets(scores: DataFrame, cols: list[str], a: str, b: str, order: str | None = None) -> DataFrame:
    """(framework, config_id, x, y): each framework's score of a config in data set a against that in b."""
    keep = ["config_id", *([order] if order else [])]
    one = scores.where(F.col("dataset") == a).select(*keep, *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(cols)])
    two = scores.where(F.col("dataset") == b).select("config_id", *[F.col(f"`{c}`").alias(f"y{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("framework"), F.col(f"x{i}").cast("double").alias("x"), F.col(f"y{i}").cast("double").alias("y")) for i, c in enumerate(cols)]
    return one.join(two, "config_id").select(*keep, F.explode(F.array(*items)).alias("_p")).select(*keep, "_p.*")


def pattern_shift(report: DataFrame, a: str, b: str) -> DataFrame:
    """Change of every pair's rho from data set a to b, and whether the intervals overlap (unknown ends count as overlap).

    A pair of a that b lacks has nulls for b.
    """
    keys = ["framework_a", "framework_b"]
    x = report.where(F.col("dataset") == a).select(*keys, F.col("spearman_rho").alias(f"rho_{a}"), F.col("ci_lo").alias("_al"), F.col("ci_hi").alias("_ah"))
    y = report.where(F.col("dataset") == b).select(*keys, F.col("spearman_rho").alias(f"rho_{b}"), F.col("ci_lo").alias("_bl"), F.col("ci_hi").alias("_bh"))
    apart = F.coalesce(F.col("_ah") < F.col("_bl"), F.lit(False)) | F.coalesce(F.col("_bh") < F.col("_al"), F.lit(False))
    return x.join(y, keys, "left").select(*keys, f"rho_{a}", f"rho_{b}", (F.col(f"rho_{b}") - F.col(f"rho_{a}")).alias("delta"), (~apart).alias("ci_overlap"))


def paired_scores(per_query: DataFrame, variables: list[str], score: str, units: list[str] | None = None) -> DataFrame:
    """(dataset, variable, a, b, query_id, x, y): mean score of a query at each pair of levels of each variable."""
    units = units or ["query_id"]
    items = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("level")) for v in variables]
    long = per_query.select("dataset", *units, F.explode(F.array(*items)).alias("_v"), F.col(f"`{score}`").cast("double").alias("_s")).select("dataset", *units, "_v.*", "_s")
    m = long.groupBy("dataset", "variable", "level", *units).agg(F.avg("_s").alias("_m"))
    # the levels of one query are few; they are paired inside a row, without a self-join
    g = m.where("_m is not null").groupBy("dataset", "variable", *units).agg(F.array_sort(F.collect_list(F.struct("level", "_m"))).alias("_l"))
    combos = F.flatten(F.transform("_l", lambda p, i: F.transform(F.slice(F.col("_l"), i + 2, F.size("_l")), lambda q: F.struct(p["level"].alias("a"), q["level"].alias("b"), p["_m"].alias("x"), q["_m"].alias("y")))))
    return g.select("dataset", "variable", *units, F.explode(combos).alias("_c")).select("dataset", "variable", *units, "_c.*")


def wilcoxon(paired: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Signed-rank test per group: W, p (normal approximation with tie correction, zeros dropped), effect_r, n.

    Groups whose sides are all close give W null, p 1, effect 0.  ``digits``
    rounds differences first, so that ties of averaged scores stay ties.
    """
    d = F.col("x") - F.col("y")
    rows = paired.withColumn("_d", F.round(d, digits) if digits is not None else d)
    close = F.abs(d) <= 1e-8 + 1e-5 * F.abs(F.col("y"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(close).alias("_close"))
    # equal differences are counted first; ranks then follow from running counts of few rows
    v = rows.where("_d != 0").groupBy(*by, F.abs("_d").alias("_v")).agg(F.count("*").alias("_t"), F.count(F.when(F.col("_d") > 0, 1)).alias("_pos"))
    r = running_before(v, by, "_v", "_t").withColumn("_rank", F.col("_before") + (F.col("_t") + 1) / 2.0)
    s = r.groupBy(*by).agg(F.sum(F.col("_rank") * F.col("_pos")).alias("_plus"), F.sum(F.col("_rank") * F.col("_t")).alias("_all"), F.sum("_t").cast("double").alias("_m"), F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_ties"))
    w = F.least(F.col("_plus"), F.col("_all") - F.col("_plus"))
    se = F.sqrt((F.col("_m") * (F.col("_m") + 1) * (2 * F.col("_m") + 1) - F.col("_ties") / 2) / 24)
    z = F.try_divide(w - F.col("_m") * (F.col("_m") + 1) / 4, se)
    j = totals.join(s, by, "left")
    alike = F.col("_close") | F.col("_all").isNull()
    return j.select(*by, F.when(~alike, w).alias("W"), F.when(alike, 1.0).otherwise(two_sided_p(z)).alias("p"), F.when(alike, 0.0).otherwise(2 * F.col("_plus") / F.col("_all") - 1).alias("effect_r"), "n")


def holm(tests: DataFrame, by: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """p_adj and significance per family (``by``); equal p follow ``order``."""
    w = Window.partitionBy(*by).orderBy("p", *order)
    step = F.least(F.lit(1.0), F.col("p") * (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1))
    out = tests.withColumn("_s", step)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("p_adj", F.max("_s").over(run)).drop("_s").withColumn("significant", F.col("p_adj") < alpha)


def variable_attribution(per_query: DataFrame, variables: list[str], score: str = "nDCG@10", alpha: float = 0.05, digits: int | None = 12) -> DataFrame:
    """Tests of all level pairs of all variables, corrected per data set."""
    tests = wilcoxon(paired_scores(per_query, variables, score), ["dataset", "variable", "a", "b"], digits)
    return holm(tests, ["dataset"], ["variable", "a", "b"], alpha)
