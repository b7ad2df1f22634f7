"""Queries of the cohort and validation part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import rounded
from ..operators import fits, scoring, stats
from ..plans import fixtures, model
from ..sources.staging import staged
from .sqltext import CTES, rnd, sql


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.horizon_label(fixtures.cohort(spark, sf_dir))


def with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = expr.calibrated_risk(F.col("score"), F.col("age").cast("double"), F.col("sex"))
    return labelled(spark, sf_dir).withColumn("p", F.round(p, 6))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.cohort(spark, sf_dir).withColumn("survived", 1 - F.col("deceased"))
    return stats.auc(c, "score", "survived").select("n", "events", rounded(F.col("auc"), 6).alias("auc"))


def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reliability_table(with_p(spark, sf_dir), "p", "y")


def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ece_brier(with_p(spark, sf_dir), "p", "y")


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_distribution(fixtures.cohort(spark, sf_dir), "score", ["age_band"])


def group_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_auc(fixtures.cohort(spark, sf_dir), "score", "deceased", "age_band")


def horizon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("subject_id", "y")


def landmark_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.landmark_filter(fixtures.cohort(spark, sf_dir)).select("subject_id", "deceased", "permth_exm")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.holdout_split(fixtures.cohort(spark, sf_dir), "subject_id").select("subject_id", "is_train")


def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.subjects(spark, sf_dir).groupBy(expr.age_band(F.col("age")).alias("age_band"), "sex").agg(F.count("*").alias("n"), F.min("age").alias("youngest"), F.max("age").alias("oldest"))


def egfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.table(spark, sf_dir, "orders").join(fixtures.subjects(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
    value = F.when(F.pmod("o_orderkey", F.lit(13)) == 0, None).otherwise(F.pmod("o_orderkey", F.lit(40)) / 10.0)
    return o.select(F.col("o_orderkey").alias("reading"), rounded(expr.egfr(value, F.col("age"), F.col("sex")), 4).alias("egfr"))


def phq9(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [F.pmod(F.col("o_orderkey") * (3 + i), F.lit(5 + i % 3)) for i in range(9)]
    return fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reading"), expr.phq9(items).alias("phq9"))


MARKERS = {"albumin": (30, 20), "creatinine": (40, 90), "glucose": (4, 6), "crp": (0, 3), "lymphocyte_pct": (10, 40), "mcv": (80, 20), "rdw": (11, 6), "alp": (40, 90), "wbc": (3, 9)}


def phenoage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.table(spark, sf_dir, "orders").join(fixtures.subjects(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
    c = {m: F.lit(float(lo)) + width * (F.pmod(F.col("o_orderkey") * (2 * i + 3), F.lit(97)) / 97.0) for i, (m, (lo, width)) in enumerate(MARKERS.items())}
    c["wbc"] = F.when(F.pmod("o_orderkey", F.lit(17)) == 0, None).otherwise(c["wbc"])
    value = expr.phenoage(c | {"age": F.col("age").cast("double")})
    return o.select(F.col("o_orderkey").alias("reading"), rounded(value, 3).alias("phenoage"), rounded(value - F.col("age"), 3).alias("acceleration"))


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation(fixtures.cohort(spark, sf_dir), "score", "age")


def std_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.std_beta(fixtures.cohort(spark, sf_dir), "permth_exm", "score")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = fixtures.subjects(spark, sf_dir).where("subject_id % 3 <> 0").select("subject_id", (F.col("subject_id") % 10 + 1).cast("int").alias("ucod_leading"))
    return stats.cause_specific_event(fixtures.cohort(spark, sf_dir).drop("t_years"), causes)


def cause_specific_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("subject_id", "event", F.round("t_years", 6).alias("t_years"))


def person_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.person_period(events(spark, sf_dir)).select("subject_id", "t", "t2", "y")


def td_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = events(spark, sf_dir).withColumn("risk", 2.0 * F.col("age") - F.col("score"))
    a, b, c = (stats.td_auc(risk, "risk", h) for h in (5, 10, 15))
    return a.unionByName(b).unionByName(c)


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.logistic_fit(labelled(spark, sf_dir), ["score", "age", "male"], "y").table(spark)


def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.select("subject_id", rounded(fits.logistic_fit(rows, ["score", "age", "male"], "y").probability(), 6).alias("p"))


def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures, final = fits.calibrate(labelled(spark, sf_dir), ["score", "age", "male"])
    return figures.crossJoin(F.broadcast(final.table(spark)))  # one row of figures


def groups() -> dict[str, Column]:
    return {"age_band": F.col("age_band"), "sex": F.col("sex"), "outcome": F.when(F.col("deceased") == 1, "deceased").otherwise("survived")}


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the score tells survivors, overall and by subgroup, and how it is spread: all of the report that is not fitted."""
    return stats.report(fixtures.cohort(spark, sf_dir).withColumn("survived", 1 - F.col("deceased")), "score", "survived", groups())


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section, name, value: the summary, the calibration model and how well it is calibrated."""
    c = staged(fixtures.cohort(spark, sf_dir).withColumn("survived", 1 - F.col("deceased")), "report")
    fit = fits.logistic_fit(c, ["score", "age", "male"], "deceased")
    weights = fit.table(spark).select(F.lit("calibration_model").alias("section"), F.col("feature").alias("name"), F.col("weight").alias("value"))
    return stats.report(c, "score", "survived", groups()).unionByName(weights).unionByName(stats.calibration(c.withColumn("p", fit.probability()), "p", "deceased"))


def fit_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, at_zero: whether the penalised log-loss of the fitted model has no slope there; from its coefficients, on all rows.

    The slope at each coefficient is summed over the rows anew, so it does not rest on what the fit says of itself.
    """
    rows = labelled(spark, sf_dir).select(F.col("score").cast("double").alias("score"), F.col("age").cast("double").alias("age"), F.col("male").cast("double").alias("male"), F.col("y").cast("double").alias("y")).dropna()
    fit = fits.logistic_fit(rows, ["score", "age", "male"], "y")
    w, mu, sd, *_ = fit.models["all"]
    off = fit.probability() - F.col("y")
    slopes = {"bias": F.avg(off)} | {f: F.avg(off * (F.col(f) - float(mu[i])) / float(sd[i])) + fits.L2 * float(w[i + 1]) for i, f in enumerate(fit.features)}
    one = rows.agg(*(x.alias(n) for n, x in slopes.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), (F.abs(n) < 1e-8).alias("at_zero")) for n in slopes))).alias("r")).select("r.*")


def given_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the published model's probabilities are calibrated."""
    return stats.calibration(with_p(spark, sf_dir), "p", "y")


def wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = scoring.tier_mean_score(fixtures.clinical(spark, sf_dir), model.features(spark))
    return fixtures.cohort(spark, sf_dir).join(tiers.drop("n"), "subject_id", "left")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.ablation(wide_scores(spark, sf_dir), ["score", "labs", "anthropometric", "tier3"])


def feature_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fixtures.clinical(spark, sf_dir).join(fixtures.cohort(spark, sf_dir), "subject_id")
    return fits.feature_association(long)


def incremental_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.horizon_label(wide_scores(spark, sf_dir)).withColumn("score", F.col("score") / 100)
    return fits.incremental_value(wide, ["score", "labs", "anthropometric", "tier3"])


def aged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort with the biological age of each subject's last order that has one, and its acceleration."""
    readings = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reading"), F.col("o_custkey").cast("long").alias("subject_id"))
    last = phenoage(spark, sf_dir).where("phenoage is not null").join(readings, "reading").groupBy("subject_id").agg(F.max_by(F.struct("phenoage", "acceleration"), "reading").alias("b"))
    return wide_scores(spark, sf_dir).join(last.select("subject_id", "b.*"), "subject_id")


def phenoage_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample AUC of mortality by age and sex, with the acceleration of the biological age, with the score, with blocks of measures."""
    rows = aged_scores(spark, sf_dir).where("deceased is not null").withColumns({"risk_score": -F.col("score"), "labs": F.coalesce("labs", F.lit(0.5)), "tier3": F.coalesce("tier3", F.lit(0.5))})
    rows = staged(stats.holdout_split(rows, "subject_id"), "increment")
    ladder = {"age_sex": [], "plus_acceleration": ["acceleration"], "plus_score": ["risk_score"], "plus_labs": ["acceleration", "labs"], "plus_blocks": ["acceleration", "labs", "tier3"]}
    out = None
    for name, more in ladder.items():
        fit = fits.logistic_fit(rows.where("is_train"), ["age", "male", *more], "deceased")
        a = stats.auc(rows.where("not is_train").withColumn("p", fit.probability()), "p", "deceased").select(F.lit(name).alias("model"), "n", rounded(F.col("auc"), 4).alias("auc"))
        out = a if out is None else out.unionByName(a)
    return out


def phenoage_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the biological age and the score by themselves tell deaths, and how they go together."""
    rows = staged(aged_scores(spark, sf_dir).withColumn("risk_score", -F.col("score")), "aged")
    raw = lambda c: stats.auc(rows, c, "deceased").select(F.lit(c).alias("measure"), "n", rounded(F.col("auc"), 4).alias("value"))
    together = stats.correlation(rows, "acceleration", "score").select(F.lit("spearman").alias("measure"), "n", rounded(F.col("spearman"), 4).alias("value"))
    return raw("phenoage").unionByName(raw("risk_score")).unionByName(together)


def discrete_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.discrete_hazard(stats.person_period(events(spark, sf_dir))).table(spark)


def risk_to_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    hazard = fits.discrete_hazard(stats.person_period(rows))
    return rows.select("subject_id", *(rounded(fits.risk_to_horizon(hazard, h), 6).alias(f"risk_{h}y") for h in (5, 10, 15)))


def bootstrap_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_auc_ci(with_p(spark, sf_dir).withColumn("s", F.round("p", 3)), "s", "y")


QUERIES = {
    f.__name__: f
    for f in (
        auc, reliability_table, ece_brier, score_distribution, group_auc, horizon_label, landmark_filter, holdout_split, age_band, egfr, phq9, phenoage, correlation, std_beta,
        cause_specific_event, person_period, td_auc, logistic_fit, predict_proba, calibrate, validation_summary, given_calibration, fit_gradient, validation_report, ablation, feature_association, incremental_value,
        phenoage_increment, phenoage_auc, discrete_hazard, risk_to_horizon, bootstrap_auc_ci,
    )
}

CTES["labelled"] = "SELECT * FROM (SELECT *, CASE WHEN deceased = 1 AND permth_exm <= 120 THEN 1 WHEN permth_exm >= 120 THEN 0 END AS y FROM cohort) WHERE y IS NOT NULL"
CTES["graded"] = " UNION ALL ".join(f"SELECT {n} AS name, score AS s, 1 - deceased AS y FROM cohort" for n in ("'all'", "'age_band: ' || age_band", "'sex: ' || sex", "'outcome: ' || CASE WHEN deceased = 1 THEN 'deceased' ELSE 'survived' END"))
CTES["with_p"] = """SELECT *, round(1 / (1 + exp(-(-2.669034 + -0.555394 * (score - 79.243819) / 8.621566 + 1.868387 * (age - 48.064055) / 20.266637 + 0.281035 * (male - 0.486379) / 0.499814))), 6) AS p FROM labelled"""
CTES["followed"] = """SELECT c.* EXCLUDE t_years, (deceased = 1 AND NOT coalesce(ucod_leading = 4, FALSE))::INTEGER AS event, greatest(0.1::DOUBLE, permth_exm / 12.0::DOUBLE) AS t_years
  FROM cohort c LEFT JOIN (SELECT subject_id, (subject_id % 10 + 1)::INTEGER AS ucod_leading FROM subjects WHERE subject_id % 3 <> 0) USING (subject_id)"""
_auc = lambda score, label, source, key="": f"""SELECT {key}{"," if key else ""} any_value(p) + any_value(n) AS n, any_value(p) AS events, sum(r) FILTER (WHERE y = 1) AS s, any_value(p) AS p, any_value(n) AS q FROM (
  SELECT *, rank() OVER ({f"PARTITION BY {key} " if key else ""}ORDER BY s) + (count(*) OVER (PARTITION BY {f"{key}, " if key else ""}s) - 1) / 2.0::DOUBLE AS r, count(*) FILTER (WHERE y = 1) OVER ({f"PARTITION BY {key}" if key else ""}) AS p,
    count(*) FILTER (WHERE y = 0) OVER ({f"PARTITION BY {key}" if key else ""}) AS n FROM (SELECT {key}{"," if key else ""} {score} AS s, {label} AS y FROM {source})) {f"GROUP BY {key}" if key else ""}"""  # noqa: E731
_value = "CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * q::DOUBLE) END"
_td = " UNION ALL ".join(f"SELECT {h} AS horizon, n, events, {rnd(_value, 4)} AS auc FROM (" + _auc("2.0 * age - score", f"(event = 1 AND t_years <= {h})::INTEGER", f"followed WHERE t_years >= {h} OR (event = 1 AND t_years <= {h})") + ")" for h in (5, 10, 15))
_bins = f"SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, {rnd('avg(p)', 4)} AS mean_predicted, {rnd('avg(y)', 4)} AS observed_freq FROM with_p GROUP BY 1"
_phq = ", ".join(f"(o_orderkey * {3 + i}) % {5 + i % 3}" for i in range(9))
_m = {m: f"({float(lo)} + {width} * (((o_orderkey * {2 * i + 3}) % 97) / 97.0::DOUBLE))" for i, (m, (lo, width)) in enumerate(MARKERS.items())}
_m["wbc"] = f"(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {_m['wbc']} END)"
_xb = f"-19.907 - 0.0336 * {_m['albumin']} + 0.0095 * {_m['creatinine']} + 0.1953 * {_m['glucose']} + 0.0954 * ln(CASE WHEN {_m['crp']} <= 0 THEN 0.01 ELSE {_m['crp']} END) - 0.0120 * {_m['lymphocyte_pct']} + 0.0268 * {_m['mcv']} + 0.3306 * {_m['rdw']} + 0.00188 * {_m['alp']} + 0.0554 * {_m['wbc']} + 0.0804 * age"
_nearest = lambda q: f"max(round(s, 2)) FILTER (WHERE i = round_even({q} * (m - 1), 0))"
CTES["graded_auc"] = f"SELECT name, n, events, {rnd(_value, 4)} AS auc FROM (" + _auc("s", "y", "graded", "name") + ")"
CTES["phenoaged"] = f"""SELECT o_orderkey AS reading, o_orderkey, o_custkey, {rnd('a', 3)} AS phenoage, {rnd('a - age', 3)} AS acceleration FROM (SELECT *, 141.50225 + ln(-0.00553 * ln(1 - least(greatest(m, 1e-7), 1 - 1e-7))) / 0.090165 AS a FROM (
      SELECT *, 1 - exp(-exp(xb) * ((exp(120 * 0.0076927::DOUBLE) - 1) / 0.0076927::DOUBLE)) AS m FROM (SELECT *, {_xb} AS xb FROM orders JOIN subjects ON o_custkey = subject_id))) WHERE TRUE""".replace("least(greatest(m, 1e-7), 1 - 1e-7)", "CASE WHEN m IS NULL THEN NULL ELSE least(greatest(m, 1e-7), 1 - 1e-7) END")
CTES["aged_cohort"] = f"""SELECT c.*, b.phenoage, b.acceleration FROM cohort c JOIN (SELECT o_custkey::BIGINT AS subject_id, arg_max(phenoage, o_orderkey) AS phenoage, arg_max(acceleration, o_orderkey) AS acceleration FROM phenoaged WHERE phenoage IS NOT NULL GROUP BY 1) b USING (subject_id)"""
SQL = {k: sql(v) for k, v in {
    "validation_summary": f"""WITH w AS (SELECT name, {", ".join(f"{x} AS {f}" for f, x in {"min": "round(min(s), 2)", "p25": _nearest(0.25), "median": _nearest(0.5), "p75": _nearest(0.75), "max": "round(max(s), 2)", "mean": rnd("avg(s)", 2)}.items())} FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY name) AS m FROM graded WHERE s IS NOT NULL) GROUP BY name)
      SELECT section, name, value FROM (SELECT name, unnest([{{'section': 'auc', 'value': auc}}, {{'section': 'n', 'value': n::DOUBLE}}, {{'section': 'event_rate', 'value': {rnd("events / n", 4)}}}], recursive := TRUE) FROM graded_auc
      UNION ALL SELECT name, unnest([{", ".join(f"{{'section': '{f}', 'value': {f}::DOUBLE}}" for f in ("min", "p25", "median", "p75", "max", "mean"))}], recursive := TRUE) FROM w)""",
    "given_calibration": f"""WITH b AS ({_bins}) SELECT 'reliability_n' AS section, bin::VARCHAR AS name, n::DOUBLE AS value FROM b UNION ALL SELECT 'reliability_predicted', bin::VARCHAR, mean_predicted FROM b UNION ALL SELECT 'reliability_observed', bin::VARCHAR, observed_freq FROM b
      UNION ALL SELECT 'calibration', 'ece', {rnd("sum(n * abs(observed_freq - mean_predicted)) / sum(n)", 4)} FROM b UNION ALL SELECT 'calibration', 'brier', {rnd("avg((p - y) * (p - y))", 4)} FROM with_p UNION ALL SELECT 'calibration', 'auc', {rnd(_value, 4)} FROM ({_auc("p", "y", "with_p")})""",
    "fit_gradient": "SELECT feature, TRUE AS at_zero FROM (SELECT unnest(['bias', 'score', 'age', 'male']) AS feature) WHERE (SELECT count(DISTINCT y) FROM labelled) = 2",
    "phenoage_auc": f"""SELECT 'phenoage' AS measure, n, {rnd(_value, 4)} AS value FROM ({_auc("phenoage", "deceased", "aged_cohort")}) UNION ALL SELECT 'risk_score', n, {rnd(_value, 4)} FROM ({_auc("-score", "deceased", "aged_cohort")})
      UNION ALL SELECT 'spearman', count(*), {rnd("corr(ra, rb)", 4)} FROM (SELECT rank() OVER (ORDER BY acceleration) + (count(*) OVER (PARTITION BY acceleration) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rb FROM aged_cohort)""",
    "auc": f"SELECT n, events, {rnd(_value, 6)} AS auc FROM ({_auc('score', '1 - deceased', 'cohort')})",
    "reliability_table": _bins,
    "ece_brier": f"WITH t AS ({_bins}) SELECT (SELECT {rnd('sum(n * abs(observed_freq - mean_predicted)) / sum(n)', 4)} FROM t) AS ece, {rnd('avg((p - y) * (p - y))', 4)} AS brier, count(*) AS n FROM with_p",
    "score_distribution": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY age_band ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY age_band) AS n FROM cohort WHERE score IS NOT NULL)
      SELECT age_band, any_value(n) AS n, round(min(score), 2) AS min, max(round(score, 2)) FILTER (WHERE i = round_even(0.25 * (n - 1), 0)) AS p25, max(round(score, 2)) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS median,
      max(round(score, 2)) FILTER (WHERE i = round_even(0.75 * (n - 1), 0)) AS p75, round(max(score), 2) AS max, {rnd('avg(score)', 2)} AS mean FROM r GROUP BY age_band""",
    "group_auc": f"SELECT age_band, n, {rnd('events / n', 4)} AS event_rate, {rnd(_value, 4)} AS auc FROM ({_auc('score', 'deceased', 'cohort', 'age_band')})",
    "horizon_label": "SELECT subject_id, y FROM labelled",
    "landmark_filter": "SELECT subject_id, deceased, permth_exm FROM cohort WHERE NOT coalesce(deceased = 1 AND permth_exm < 24, FALSE)",
    "holdout_split": "SELECT subject_id, ('0x' || substr(md5(subject_id::VARCHAR || ':1'), 1, 8))::BIGINT % 10 < 7 AS is_train FROM cohort",
    "age_band": "SELECT CASE WHEN age < 50 THEN '18-49' WHEN age < 65 THEN '50-64' WHEN age < 75 THEN '65-74' ELSE '75+' END AS age_band, sex, count(*) AS n, min(age) AS youngest, max(age) AS oldest FROM subjects GROUP BY 1, 2",
    "egfr": f"""SELECT o_orderkey AS reading, CASE WHEN v > 0 THEN {rnd('142 * pow(least(v / k, 1), a) * pow(greatest(v / k, 1), -1.2) * pow(0.9938, age) * f', 4)} END AS egfr FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 40) / 10.0::DOUBLE END AS v,
      CASE WHEN sex = 'F' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS k, CASE WHEN sex = 'F' THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END AS a, CASE WHEN sex = 'F' THEN 1.012::DOUBLE ELSE 1.0::DOUBLE END AS f FROM orders JOIN subjects ON o_custkey = subject_id)""",
    "phq9": f"SELECT reading, CASE WHEN len(x) >= 7 THEN list_sum(x)::INTEGER END AS phq9 FROM (SELECT o_orderkey AS reading, list_filter([{_phq}], lambda v: v BETWEEN 0 AND 3) AS x FROM orders)",
    "phenoage": "SELECT reading, phenoage, acceleration FROM phenoaged",
    "correlation": f"""WITH r AS (SELECT score AS a, age::DOUBLE AS b, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0::DOUBLE AS rb FROM cohort)
      SELECT count(*) AS n, {rnd('corr(a, b)', 6)} AS pearson, {rnd('corr(ra, rb)', 6)} AS spearman FROM r""",
    "std_beta": f"""WITH z AS (SELECT count(*) AS n, corr(score, age) AS sa, corr(score, male) AS sm, corr(age, male) AS am, corr(score, permth_exm) AS sy, corr(age, permth_exm) AS ay, corr(male, permth_exm) AS my FROM cohort)
      SELECT n, {rnd('(sy * (1 - am * am) - ay * (sa - sm * am) + my * (sa * am - sm)) / (1 + 2 * sa * sm * am - sa * sa - sm * sm - am * am)', 6)} AS beta FROM z""",
    "cause_specific_event": "SELECT subject_id, event, round(t_years, 6) AS t_years FROM followed",
    "person_period": "SELECT subject_id, t::INTEGER AS t, (t * t)::INTEGER AS t2, (t = k AND event = 1)::INTEGER AS y FROM (SELECT subject_id, event, k, unnest(range(1, k + 1)) AS t FROM (SELECT *, least(18, greatest(1, ceil(t_years)))::BIGINT AS k FROM followed))",
    "td_auc": _td,
}.items()}
