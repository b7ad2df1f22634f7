"""Fitted models: each step of a fit is one aggregation, for all groups at once.

Only sums leave the executors: gradient and Hessian of at most a few dozen coefficients for each
group. Groups are models (features, score columns), not data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..sources.staging import staged
from . import stats

L2 = 1e-4
STEPS = 30


class Logistic:
    """Coefficients of one model per group on standardised features."""

    def __init__(self, features: list[str], models: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]) -> None:
        self.features, self.models = features, models

    def table(self, spark) -> DataFrame:
        """model, feature, weight, mean, sd, n, gradient_norm; the bias is a feature of its own."""
        rows = []
        for name, (w, mu, sd, n, g) in self.models.items():
            rows += [(name, f, float(w[i + 1]), float(mu[i]), float(sd[i]), int(n), float(g)) for i, f in enumerate(self.features)]
            rows.append((name, "bias", float(w[0]), 0.0, 1.0, int(n), float(g)))
        return spark.createDataFrame(rows, "model string, feature string, weight double, mean double, sd double, n long, gradient_norm double")

    def probability(self, columns: dict[str, Column] | None = None, name: str = "all") -> Column:
        """The model's probability as a column expression."""
        w, mu, sd, *_ = self.models[name]
        z = F.lit(float(w[0]))
        for i, f in enumerate(self.features):
            x = (columns or {}).get(f, F.col(f))
            z = z + float(w[i + 1] / sd[i]) * (x - float(mu[i]))
        return 1 / (1 + F.exp(-z))


def logistic_fit(rows: DataFrame, features: Sequence[str], label: str, key: str | None = None, l2: float = L2) -> Logistic:
    """L2-penalised logistic regression by Newton's method; the bias is not penalised.

    Rows with nulls take no part. Groups with one class get no model.
    """
    features = list(features)
    k = len(features)
    name = F.col(key).cast("string") if key else F.lit("all")
    data = rows.select(name.alias("_k"), F.col(label).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features))).dropna().persist()
    x = [F.col(f"_x{i}") for i in range(k)]
    first = data.groupBy("_k").agg(F.count("*").alias("n"), F.sum("_y").alias("pos"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).collect()
    state = {}
    for r in first:
        if 0 < r["pos"] < r["n"]:
            mu = np.array([r[f"m{i}"] for i in range(k)])
            sd = np.array([r[f"s{i}"] or 1.0 for i in range(k)])
            state[r["_k"]] = [np.zeros(k + 1), mu, sd, r["n"], np.inf]
    open_ = set(state)
    for _ in range(STEPS):
        if not open_:
            break
        told = [(g, *map(float, state[g][0]), *map(float, state[g][1]), *map(float, state[g][2])) for g in sorted(open_)]
        names = [f"{p}{i}" for p, c in (("w", k + 1), ("m", k), ("s", k)) for i in range(c)]
        coefficients = F.broadcast(data.sparkSession.createDataFrame(told, "_k string, " + ", ".join(f"{c} double" for c in names)))
        z = [F.lit(1.0), *((x[i] - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(k))]
        joined = data.join(coefficients, "_k").select("_k", "_y", *(c.alias(f"z{i}") for i, c in enumerate(z)), *(f"w{i}" for i in range(k + 1)))
        p = 1 / (1 + F.exp(-sum((F.col(f"w{i}") * F.col(f"z{i}") for i in range(1, k + 1)), F.col("w0"))))
        q = joined.withColumn("e", p - F.col("_y")).withColumn("v", p * (1 - p))
        zs = [F.col(f"z{i}") for i in range(k + 1)]
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        sums = q.groupBy("_k").agg(*(F.sum(F.col("e") * zs[i]).alias(f"g{i}") for i in range(k + 1)), *(F.sum(F.col("v") * zs[i] * zs[j]).alias(f"h{i}_{j}") for i, j in pairs)).collect()
        for r in sums:
            w, _, _, n, _ = state[r["_k"]]
            penalty = np.r_[0.0, np.full(k, l2)]
            g = np.array([r[f"g{i}"] for i in range(k + 1)]) / n + penalty * w
            h = np.zeros((k + 1, k + 1))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"] / n
            state[r["_k"]][4] = float(np.abs(g).max())
            if state[r["_k"]][4] < 1e-9:
                open_.discard(r["_k"])
                continue
            state[r["_k"]][0] = w - np.linalg.solve(h + np.diag(penalty + 1e-12), g)
    data.unpersist()
    return Logistic(features, {g: tuple(v) for g, v in state.items()})


def calibrate(cohort: DataFrame, features: Sequence[str], label: str = "y", key: str = "subject_id") -> tuple[DataFrame, Logistic]:
    """Held-out auc, ece, brier and n_test of a 70/30 split, and the model fitted to all."""
    split = stats.holdout_split(cohort, key)
    model = logistic_fit(split.where("is_train"), features, label)
    scored = split.where("not is_train").withColumn("p", model.probability())
    a = stats.auc(scored, "p", label).select(F.col("n").alias("n_test"), rounded(F.col("auc"), 4).alias("auc"))
    return a.crossJoin(stats.ece_brier(scored, "p", label).drop("n")), logistic_fit(cohort, features, label)


def adjusted_coefficients(rows: DataFrame, key: str, value: str, label: str, covariates: Sequence[str] = ("age", "male")) -> DataFrame:
    """key, n, adj_coef: the standardised weight of value in a model with the covariates, for every group at once."""
    fit = logistic_fit(rows, [value, *covariates], label, key)
    return fit.table(rows.sparkSession).where(F.col("feature") == value).select(F.col("model").alias(key), "n", F.col("weight").alias("adj_coef"))


def feature_association(long: DataFrame, min_n: int = 300, lag: float = 24) -> DataFrame:
    """feature, n, deaths, auc, adj_coef, adj_coef_landmark of long rows (feature, alignment, age, male, deceased, permth_exm), most protective first by rank.

    The rows are made once and written to the shared folder, as the counts, the ranks and both fits read them.
    """
    long = staged(long.select("feature", "alignment", "age", "male", "deceased", "permth_exm"), "association")
    large = long.groupBy("feature").agg(F.count("alignment").alias("c"), F.min("deceased").alias("a"), F.max("deceased").alias("b")).where((F.col("c") >= min_n) & (F.col("a") < F.col("b"))).select("feature")
    rows = long.join(F.broadcast(large), "feature").withColumn("survived", 1 - F.col("deceased"))
    a = stats.auc(rows, "alignment", "survived", ["feature"]).select("feature", "n", (F.col("n") - F.col("events")).alias("deaths"), rounded(F.col("auc"), 4).alias("auc_align_to_survival"))
    every = adjusted_coefficients(rows, "feature", "alignment", "deceased").select("feature", rounded(F.col("adj_coef"), 4).alias("adj_coef"))
    late = adjusted_coefficients(stats.landmark_filter(rows, lag), "feature", "alignment", "deceased").select("feature", rounded(F.col("adj_coef"), 4).alias("adj_coef_landmark"), F.col("n").alias("n_landmark"))
    return a.join(every, "feature").join(late, "feature", "left")


def ablation(wide: DataFrame, scores: Sequence[str], label: str = "deceased") -> DataFrame:
    """score, n, deaths, auc to survival and adjusted coefficient of each score column; those under 50 rows go. The wide rows are made once, for ranks and fit."""
    wide = staged(wide.select(*(c for c in ("subject_id", "age", "male", label, "permth_exm") if c in wide.columns), *scores), "ablation")
    long = wide.unpivot([c for c in ("subject_id", "age", "male", label, "permth_exm") if c in wide.columns], list(scores), "score", "value").where("value is not null")
    rows = long.withColumn("survived", 1 - F.col(label))
    a = stats.auc(rows, "value", "survived", ["score"]).where("n >= 50")
    fit = adjusted_coefficients(rows, "score", "value", label).select("score", rounded(F.col("adj_coef"), 4).alias("adj_coef"))
    return a.select("score", "n", (F.col("n") - F.col("events")).alias("deaths"), rounded(F.col("auc"), 4).alias("auc_to_survival")).join(fit, "score", "left")


def incremental_value(wide: DataFrame, candidates: Sequence[str], label: str = "y", key: str = "subject_id", most: int = 12, base: Sequence[str] = ("age", "male")) -> DataFrame:
    """step, added, auc, gain: greedy forward selection by held-out AUC; a missing value counts 0.5.

    All candidates of a step are fitted and scored together, keyed by candidate.
    """
    rows = stats.holdout_split(wide.fillna(0.5, list(candidates)), key).persist()
    spark = wide.sparkSession

    def score_all(fixed: list[str], options: list[str]) -> dict[str, float]:
        names = [*base, *fixed, *([] if not options else ["_x"])]
        if options:
            pair = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in options)))
            long = rows.withColumn("_p", pair).withColumn("_c", F.col("_p.c")).withColumn("_x", F.col("_p.v"))
        else:
            long = rows.withColumn("_c", F.lit("base"))
        fit = logistic_fit(long.where("is_train"), names, label, "_c")
        p = F.lit(None).cast("double")
        for c in fit.models:
            p = F.when(F.col("_c") == c, fit.probability(name=c)).otherwise(p)
        return {r["_c"]: r["auc"] for r in stats.auc(long.where("not is_train").withColumn("p", p), "p", label, ["_c"]).collect() if r["auc"] is not None}

    best = score_all([], []).get("base", 0.5)
    out, chosen = [(0, "base", float(best), 0.0)], []
    while len(chosen) < most:
        found = score_all(chosen, [c for c in candidates if c not in chosen])
        if not found:
            break
        top = max(sorted(found), key=found.__getitem__)
        if found[top] <= best + 1e-9:
            break
        chosen.append(top)
        out.append((len(chosen), top, float(found[top]), float(found[top] - best)))
        best = found[top]
    rows.unpersist()
    return spark.createDataFrame(out, "step int, added string, auc double, gain double").select("step", "added", rounded(F.col("auc"), 6).alias("auc"), rounded(F.col("gain"), 6).alias("gain"))


def std_beta(rows: DataFrame, outcome: str, value: str, covariates: Sequence[str] = ("age", "male"), min_n: int = 200) -> DataFrame:
    """n, beta: the standardised OLS coefficient of value for outcome, from one aggregation of cross-products."""
    names = [value, *covariates, outcome]
    given = rows.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = given.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names))).first()
    if means["n"] < min_n:
        return rows.sparkSession.createDataFrame([(means["n"], None)], "n long, beta double")
    z = [F.col(c) - F.lit(float(means[f"m{i}"])) for i, c in enumerate(names)]
    r = given.agg(*(F.sum(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    c = np.zeros((k, k))
    for i, j in pairs:
        c[i, j] = c[j, i] = r[f"c{i}_{j}"]
    sd = np.sqrt(np.diag(c))
    sd[sd == 0] = 1.0
    c = c / np.outer(sd, sd)
    beta = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0][0]
    return rows.sparkSession.createDataFrame([(means["n"], float(beta))], "n long, beta double").select("n", rounded(F.col("beta"), 6).alias("beta"))


def discrete_hazard(periods: DataFrame) -> Logistic:
    """Pooled logistic hazard on t, t squared, age, sex and score over person-periods."""
    return logistic_fit(periods, ["t", "t2", "age", "male", "score"], "y")


def risk_to_horizon(model: Logistic, horizon: int) -> Column:
    """1 minus the product of (1 - hazard) over the years to the horizon, as one expression."""
    return 1 - F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.lit(1.0), lambda s, t: s * (1 - model.probability({"t": t.cast("double"), "t2": (t * t).cast("double")}))
    )
