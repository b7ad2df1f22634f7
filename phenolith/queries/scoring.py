"""Queries of the batch scoring part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import context, scoring
from ..plans import fixtures, model
from .sqltext import CTES, rnd, sql


def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.similarity_score(fixtures.items(spark, sf_dir))


def similarity_score_layer2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.similarity_score(fixtures.items(spark, sf_dir, 2))


def interp_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.readings(spark, sf_dir)
    return scoring.interpolated(r, model.segments(spark)).select("subject_id", "feature", "alignment")


def map_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.map_panel(fixtures.readings(spark, sf_dir), model.mappers(spark), model.segments(spark), model.features(spark))


def clock_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(c) for c in model.CLOCKS))
    o = fixtures.table(spark, sf_dir, "orders").join(fixtures.subjects(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
    c = F.element_at(names, (F.pmod("o_orderkey", F.lit(12)) + 1).cast("int"))
    raw = F.pmod(F.col("o_orderkey") * 7, F.lit(100))
    value = F.when(raw == 99, None).when(c.isin("dunedinpace_2022", "telomere_length"), raw / 40.0).when(c == "frailty_index", raw / 80.0).when(c.isin("phenoage_2018", "grimage_2019"), raw / 4.0 - 10).otherwise(raw.cast("double"))
    age = F.when(raw % 10 == 3, None).otherwise(F.col("age").cast("double"))
    return o.select("subject_id", c.alias("clock_name"), value.alias("value"), age.alias("chronological_age"), "sex", F.col("o_orderkey").alias("reading"))


def clock_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.clock_panel(clock_readings(spark, sf_dir), model.clocks(spark), model.segments(spark))


def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.validation_report(fixtures.raw_answers(spark, sf_dir), model.options(spark))


def build_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fixtures.items(spark, sf_dir)
    return i.select("subject_id", "feature", "domain", "layer", "alignment", "basis", "gwas", F.round("eff_weight", 6).alias("eff_weight"))


def evidence_basis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.evidence_basis_mix(fixtures.items(spark, sf_dir))


def driver_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.driver_topk(fixtures.items(spark, sf_dir))


def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.domain_scores(fixtures.items(spark, sf_dir), model.domain_rules(spark))


def class_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.class_posteriors(fixtures.items(spark, sf_dir))


def completeness_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = fixtures.answers(spark, sf_dir).select("subject_id").unionByName(fixtures.clinical(spark, sf_dir).select("subject_id"))
    scored = given.groupBy("subject_id").agg(F.count("*").alias("scored_count"))
    return scoring.completeness_confidence(fixtures.items(spark, sf_dir), scored, model.qualities(spark), 32 + len(model.CORE_PANEL))


def missing_inputs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.missing_inputs_topk(fixtures.subjects(spark, sf_dir), fixtures.answers(spark, sf_dir), fixtures.clinical(spark, sf_dir), model.questions(spark), model.features(spark))


def tier_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tier_mean_score(fixtures.clinical(spark, sf_dir), model.features(spark))


def composite_with_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.items(spark, sf_dir, 2).select("subject_id", "weight", "alignment")
    extra = fixtures.clinical(spark, sf_dir).where(F.col("feature").isin("dunedinpace_2022", "telomere_length")).select("subject_id", F.lit(0.66).alias("weight"), "alignment")
    return scoring.composite_with_extra(own, extra)


def lifetable_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.lifetable_baseline(fixtures.life_tables(spark, sf_dir))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("subject_id")
    named = fixtures.subjects(spark, sf_dir).join(F.broadcast(fixtures.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("country") == F.col("n_nationkey"))
    place = F.when(key % 3 == 0, F.col("country").cast("string")).when(key % 3 == 1, F.lower("n_name")).otherwise("uk")
    scored = scoring.similarity_score(fixtures.items(spark, sf_dir, 2)).select("subject_id", "score_pct")
    sex = F.when(key % 5 == 0, None).when(key % 2 == 0, "Female").otherwise("m")
    return named.select("subject_id", "age", place.alias("country"), sex.alias("sex"), ((key % 21) - 10).cast("double").alias("bio_age_delta")).join(scored, "subject_id")


def longevity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = context.lifetable_baseline(fixtures.life_tables(spark, sf_dir))
    aliases = spark.createDataFrame([("uk", "23"), ("united states", "24")], "alias string, code string")
    return context.longevity_context(people(spark, sf_dir), base, aliases)


def calibrated_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.cohort(spark, sf_dir)
    p, ratio = expr.calibrated_risk(F.col("score"), F.col("age").cast("double"), F.col("sex"))
    return c.select("subject_id", expr.rounded(p, 4).alias("p_10yr"), expr.rounded(ratio, 3).alias("ratio_to_average"))


QUERIES = {
    f.__name__: f
    for f in (
        similarity_score, similarity_score_layer2, interp_mapper, map_panel, clock_panel, validate_inputs, build_items, evidence_basis_mix, driver_topk, domain_scores,
        class_posteriors, completeness_confidence, missing_inputs_topk, tier_mean_score, composite_with_extra, lifetable_baseline, longevity_context, calibrated_risk,
    )
}

S = "wa / w"
SE = "sqrt(greatest(waa / w - (wa / w) * (wa / w), 0) / greatest(n_items, 1))"
_score = f"""SELECT subject_id, {rnd(f"100 * ({S})", 1)} AS score_pct, {rnd(f"100 * least(greatest({S} - 1.96 * {SE}, 0), 1)", 1)} AS ci_lower_pct,
  {rnd(f"100 * least(greatest({S} + 1.96 * {SE}, 0), 1)", 1)} AS ci_upper_pct, {rnd("100 * (gw / w)", 1)} AS gwas_share_pct, n_items,
  CASE layer WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 80 END AS depth_pct FROM """
_logs = ", ".join(f"ln({p}) - (waa - 2 * {mu} * wa + {mu} * {mu} * w) / (2 * 0.18 * 0.18) AS l{i}" for i, (p, mu) in enumerate(model.CLASSES.values()))
_classes = ", ".join(f"CASE WHEN n_items >= 4 THEN {rnd(f'exp(l{i} - m) / (exp(l0 - m) + exp(l1 - m) + exp(l2 - m) + exp(l3 - m))', 4)} END AS {c}" for i, c in enumerate(model.CLASSES))
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
CTES["baseline"] = """SELECT country_code, country_name, sex, year, round(max(CASE WHEN age = 60 THEN ex END), 2) AS ex60, round(max(CASE WHEN age = 65 THEN ex END), 2) AS ex65,
  round(max(CASE WHEN age = 90 THEN lx END) / max(CASE WHEN age = 65 THEN lx END) + 1e-9, 5) AS p_reach_90_from_65, round(max(CASE WHEN age = 100 THEN lx END) / max(CASE WHEN age = 65 THEN lx END) + 1e-9, 5) AS p_reach_100_from_65,
  round(max(CASE WHEN age = 100 THEN lx END) / max(CASE WHEN age = 80 THEN lx END) + 1e-9, 5) AS p_reach_100_from_80, bool_or(warning) AS quality_warning
  FROM (SELECT *, max(year) OVER (PARTITION BY country_code, sex) AS last FROM life) WHERE year = last GROUP BY country_code, country_name, sex, year"""
CTES["people"] = f"""SELECT subject_id, age, CASE WHEN subject_id % 3 = 0 THEN country::VARCHAR WHEN subject_id % 3 = 1 THEN lower(n_name) ELSE 'uk' END AS country,
  CASE WHEN subject_id % 5 = 0 THEN NULL WHEN subject_id % 2 = 0 THEN 'Female' ELSE 'm' END AS sex, (subject_id % 21 - 10)::DOUBLE AS bio_age_delta, score AS score_pct
  FROM subjects JOIN nation ON country = n_nationkey JOIN scores2 USING (subject_id)"""
CTES["clock_readings"] = """SELECT o_custkey::BIGINT AS subject_id, c AS clock_name, CASE WHEN raw = 99 THEN NULL WHEN c IN ('dunedinpace_2022', 'telomere_length') THEN raw / 40.0::DOUBLE WHEN c = 'frailty_index' THEN raw / 80.0::DOUBLE
  WHEN c IN ('phenoage_2018', 'grimage_2019') THEN raw / 4.0::DOUBLE - 10 ELSE raw::DOUBLE END AS value, CASE WHEN raw % 10 = 3 THEN NULL ELSE age::DOUBLE END AS chronological_age, sex, o_orderkey AS reading
  FROM (SELECT *, """ + "([" + ", ".join(f"'{c}'" for c in model.CLOCKS) + """])[o_orderkey % 12 + 1] AS c, (o_orderkey * 7) % 100 AS raw FROM orders JOIN subjects ON o_custkey = subject_id)"""

CTES["clock_rows"] = f"""SELECT subject_id, clock_name, reading, value, CASE WHEN ready THEN delta END AS delta, CASE WHEN ready THEN CASE WHEN output_type = 'index' THEN {rnd('1 - least(greatest(value, 0), 1)', 4)} ELSE {rnd('s.a0 + s.slope * (x - greatest(s.x0, -1e9))', 4)} END END AS alignment, scoreable,
      CASE WHEN status = 'pending' THEN 'pending' WHEN value IS NULL THEN 'missing' WHEN output_type = 'biological_age' AND chronological_age IS NULL THEN 'needs_age' WHEN raw <> x THEN 'clamped' END AS warning
      FROM (SELECT *, CASE WHEN hi IS NULL THEN raw WHEN raw IS NULL THEN NULL ELSE least(greatest(raw, lo), hi) END AS x FROM (
        SELECT r.*, c.output_type, c.mapper, c.scoreable, c.status, m.lo, m.hi, c.status = 'available' AND value IS NOT NULL AS ready,
        {rnd("CASE WHEN c.output_type = 'biological_age' THEN value - chronological_age WHEN c.output_type = 'age_acceleration' THEN value END", 2)} AS delta,
        CASE WHEN c.output_type = 'biological_age' THEN value - chronological_age WHEN c.output_type = 'index' THEN NULL ELSE value END AS raw
        FROM clock_readings r JOIN dim_clock c USING (clock_name) LEFT JOIN dim_mapper m ON m.feature = c.mapper)) y
      LEFT JOIN dim_segment s ON s.feature = y.mapper AND s.sex = CASE WHEN y.sex = 'F' THEN 'F' ELSE 'M' END AND y.x >= s.x0 AND y.x < s.x1"""
SQL = {k: sql(v) for k, v in {
    "similarity_score": _score + "totals3",
    "similarity_score_layer2": _score + "(SELECT subject_id, count(*) AS n_items, sum(eff_weight) AS w, sum(eff_weight * alignment) AS wa, sum(eff_weight * alignment * alignment) AS waa, 0.0::DOUBLE AS gw, max(layer) AS layer FROM quiz2 GROUP BY subject_id)",
    "interp_mapper": f"SELECT subject_id, r.feature, {rnd('s.a0 + s.slope * (value - greatest(s.x0, -1e9))', 4)} AS alignment FROM readings r LEFT JOIN dim_segment s ON s.feature = r.feature AND s.sex = CASE WHEN r.sex = 'F' THEN 'F' ELSE 'M' END AND value >= x0 AND value < x1",
    "map_panel": "SELECT * FROM mapped",
    "clock_panel": "SELECT subject_id, clock_name, delta, alignment, scoreable, warning FROM clock_rows",
    "validate_inputs": "SELECT subject_id, count(*) FILTER (WHERE reason IS NULL) AS n_valid, count(*) FILTER (WHERE reason = 'unknown') AS n_unknown, count(*) FILTER (WHERE reason = 'invalid') AS n_invalid, count(*) FILTER (WHERE reason = 'out_of_range') AS n_out_of_range, count(reason) > 0 AS rejected FROM checked GROUP BY subject_id",
    "build_items": "SELECT subject_id, feature, domain, layer, alignment, basis, gwas, round(eff_weight, 6) AS eff_weight FROM items3",
    "evidence_basis_mix": f"SELECT subject_id, basis, {rnd('100 * sum(eff_weight) / any_value(w)', 1)} AS share_pct FROM items3 JOIN totals3 USING (subject_id) GROUP BY subject_id, basis",
    "driver_topk": f"""WITH s AS (SELECT i.*, round((alignment - t.wa / t.w) * eff_weight, 9) AS signed, CASE WHEN basis IN ('genomic', 'heritability') OR domain = 'genetic_family_history' THEN 'non_modifiable'
      WHEN domain IN {_in(model.MODIFIABLE_DOMAINS)} OR feature IN {_in(model.MODIFIABLE_FEATURES)} THEN 'modifiable' ELSE 'context' END AS kind FROM items3 i JOIN totals3 t USING (subject_id)),
      l AS (SELECT *, 'positive' AS list, -signed AS o FROM s WHERE signed > 0 UNION ALL SELECT *, 'negative', signed FROM s WHERE signed < 0
      UNION ALL SELECT *, 'modifiable', signed FROM s WHERE signed < 0 AND kind = 'modifiable' UNION ALL SELECT *, 'non_modifiable', 0 FROM s WHERE kind = 'non_modifiable'),
      r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, list ORDER BY o, feature) AS rank FROM l)
      SELECT subject_id, list, rank::INTEGER AS rank, regexp_replace(feature, '^q_', '') AS feature, {rnd('100 * alignment', 0)} AS alignment_pct FROM r WHERE rank <= 5""",
    "domain_scores": f"""WITH m AS (SELECT DISTINCT subject_id, feature, alignment, eff_weight, name FROM items3 JOIN dim_rule ON (kind = 'feature' AND key = feature) OR (kind = 'domain' AND key = domain)
      UNION ALL SELECT subject_id, feature, alignment, eff_weight, 'disease_escape_similarity' FROM items3 WHERE basis IN ('disease_escape', 'clinical_literature') AND domain NOT IN ('body_composition', 'cholesterol')
      UNION ALL SELECT subject_id, feature, alignment, eff_weight, 'genetic_longevity_context' FROM items3 WHERE gwas OR basis IN ('genomic', 'heritability') OR domain = 'genetic_family_history'
      UNION ALL SELECT subject_id, feature, alignment, eff_weight, 'epigenetic_youthfulness_slow_pace_context' FROM items3 WHERE basis = 'epigenetic')
      SELECT subject_id, name, {rnd('100 * sum(eff_weight * alignment) / sum(eff_weight)', 1)} AS score_pct, count(*) AS n_features, {rnd('100 * sum(eff_weight) / any_value(w)', 1)} AS weight_share_pct
      FROM m JOIN totals3 USING (subject_id) GROUP BY subject_id, name""",
    "class_posteriors": f"SELECT subject_id, {_classes} FROM (SELECT *, greatest(l0, l1, l2, l3) AS m FROM (SELECT *, {_logs} FROM totals3))",
    "completeness_confidence": f"""WITH c AS (SELECT subject_id, count(*) AS scored_count FROM (SELECT subject_id FROM answers UNION ALL SELECT subject_id FROM clinical) GROUP BY subject_id),
      q AS (SELECT subject_id, sum(eff_weight * coalesce(quality, 0.5)) / sum(eff_weight) AS quality, max(layer) AS layer FROM items3 LEFT JOIN dim_quality USING (basis) GROUP BY subject_id),
      s AS (SELECT *, least(1.0, scored_count / 45.0::DOUBLE) AS share, CASE layer WHEN 2 THEN 50 ELSE 80 END AS depth FROM q JOIN c USING (subject_id))
      SELECT subject_id, {rnd('100 * share', 1)} AS response_completeness_pct, {rnd('depth * share * quality', 1)} AS evidence_confidence_pct, share >= 0.5 AND scored_count >= 3 AS usable FROM s""",
    "missing_inputs_topk": f"""WITH w AS (SELECT DISTINCT question_id AS input, 'question' AS kind, weight, q AS ord FROM dim_option WHERE layer = 2
      UNION ALL SELECT feature, 'clinical', weight, 100 + list_position({"[" + ", ".join(f"'{c}'" for c in model.CORE_PANEL) + "]"}, feature) FROM dim_feature WHERE feature IN {_in(model.CORE_PANEL)}),
      h AS (SELECT subject_id, question_id AS input FROM answers UNION SELECT subject_id, feature FROM clinical),
      r AS (SELECT s.subject_id, w.*, row_number() OVER (PARTITION BY s.subject_id ORDER BY weight DESC, ord) AS rank FROM subjects s, w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.subject_id = s.subject_id AND h.input = w.input))
      SELECT subject_id, rank::INTEGER AS rank, input, kind, weight FROM r WHERE rank <= 6""",
    "tier_mean_score": f"SELECT subject_id, {rnd('''sum(weight * alignment) FILTER (WHERE access = 'lab') / sum(weight) FILTER (WHERE access = 'lab')''', 6)} AS labs, {rnd('''sum(weight * alignment) FILTER (WHERE access = 'anthropometric') / sum(weight) FILTER (WHERE access = 'anthropometric')''', 6)} AS anthropometric, {rnd('sum(weight * alignment) / sum(weight)', 6)} AS tier3, count(*) AS n FROM clinical JOIN dim_feature USING (feature) GROUP BY subject_id",
    "composite_with_extra": f"""WITH e AS (SELECT subject_id, 0.66::DOUBLE AS weight, alignment FROM clinical WHERE feature IN ('dunedinpace_2022', 'telomere_length')),
      b AS (SELECT subject_id, weight, alignment, FALSE AS extra FROM quiz2 UNION ALL SELECT *, TRUE FROM e)
      SELECT subject_id, {rnd('sum(weight * alignment) FILTER (WHERE NOT extra) / sum(weight) FILTER (WHERE NOT extra)', 6)} AS without, {rnd('sum(weight * alignment) / sum(weight)', 6)} AS "with" FROM b WHERE subject_id IN (SELECT subject_id FROM e) GROUP BY subject_id""",
    "lifetable_baseline": "SELECT * FROM baseline",
    "longevity_context": f"""WITH a AS (SELECT 'uk' AS alias, '23' AS code UNION ALL SELECT 'united states', '24'), n AS (SELECT DISTINCT lower(country_name) AS name, country_code::VARCHAR AS code FROM baseline),
      r AS (SELECT p.*, CASE WHEN lower(trim(p.sex)) IN ('f', 'female', 'woman', 'w') THEN 'female' WHEN lower(trim(p.sex)) IN ('m', 'male', 'man') THEN 'male' ELSE 'both' END AS s,
        coalesce((SELECT code FROM n WHERE n.code = p.country), a.code, n.code) AS code FROM people p LEFT JOIN a ON a.alias = lower(p.country) LEFT JOIN n ON n.name = lower(p.country))
      SELECT subject_id, code AS country_code, s AS sex, CASE WHEN age >= 73 THEN b.p_reach_100_from_80 ELSE b.p_reach_100_from_65 END AS p_reach_target, CASE WHEN b.sex IS NULL THEN NULL WHEN age >= 73 THEN 80 ELSE 65 END AS from_age, b.quality_warning,
        CASE WHEN score_pct >= 85 THEN 'exceptional' WHEN score_pct >= 70 THEN 'typical_range' WHEN score_pct >= 55 THEN 'approaching_typical' ELSE 'below_typical' END AS band,
        CASE WHEN bio_age_delta < 0 THEN 'younger' WHEN bio_age_delta IS NOT NULL THEN 'older' END AS biological_age,
        {rnd('least(0.95, CASE WHEN age >= 73 THEN b.p_reach_100_from_80 ELSE b.p_reach_100_from_65 END * CASE WHEN score_pct >= 85 THEN 2.0 WHEN score_pct >= 70 THEN 1.5 WHEN score_pct >= 55 THEN 1.0 ELSE 0.6 END)', 4)} AS illustrative_p
      FROM r LEFT JOIN baseline b ON b.country_code::VARCHAR = r.code AND b.sex = r.s""",
    "calibrated_risk": f"""SELECT subject_id, {rnd('p', 4)} AS p_10yr, {rnd('p / pa', 3)} AS ratio_to_average FROM (SELECT subject_id, 1 / (1 + exp(-(-2.669034 + -0.555394 * (score - 79.243819) / 8.621566 + r))) AS p, 1 / (1 + exp(-(-2.669034 + r))) AS pa
      FROM (SELECT *, 1.868387 * (age - 48.064055) / 20.266637 + 0.281035 * (male - 0.486379) / 0.499814 AS r FROM cohort))""",
}.items()}
