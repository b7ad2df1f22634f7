"""Queries of the meta-analysis and evidence part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import rounded
from ..operators import evidence, meta
from ..plans import fixtures
from ..plans.lexicon import AMBIGUOUS_NAMES, CANONICAL, DROPPED_NAMES, FOREIGN_PARTS, GARBAGE_NAMES, STRIPPED_PHRASES, STRIPPED_WORDS
from ..sources.staging import staged
from .sqltext import CTES, literal, rnd, sql, values


def contrast_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.with_contrast(fixtures.mentions(spark, sf_dir)).groupBy("effect_measure", "subject_class", "contrast_type").agg(F.count("*").alias("n"))


def study_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = meta.study_collapse(meta.with_contrast(fixtures.mentions(spark, sf_dir)))
    return s.select(*meta.STRATUM, "study_id", rounded(F.col("value"), 6).alias("value"), rounded(F.col("ci_lower"), 6).alias("ci_lower"), rounded(F.col("ci_upper"), 6).alias("ci_upper"), "has_ci")


def dl_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = staged(meta.study_collapse(meta.with_contrast(fixtures.mentions(spark, sf_dir))), "studies")  # read twice
    p = meta.dl_pool(studies, meta.STRATUM)
    return p.select(*meta.STRATUM, *(rounded(F.col(c), 5).alias(c) for c in ("mu", "se", "pooled", "ci_lower", "ci_upper", "i_squared", "tau_squared")), "n_ci", "same_direction")


def strata_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.strata(fixtures.mentions(spark, sf_dir))


def biomarker_unstratified_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.unstratified_pool(fixtures.mentions(spark, sf_dir))


def primary_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.mentions(spark, sf_dir)
    return meta.primary_stratum(meta.strata(m), m)


#: Starts of raw names of biomarkers, with what is stripped, dropped or doubtful.
RAW_NAMES = [
    "HDL cholesterol HR CI", "Type diabetes IVW", "All-cause mortality", "IGF-1 or insulin", "overt hyperthyroidism", "riscos de morir", "weighting but not diabetes", "physical frailty", "each component was",
    "Serum urea adj", "nothing", "Multivariate analysis of grip", "stroke hr ci depression", "usual daily",
]


def named_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions under raw clinical names: one of RAW_NAMES, which some names are as a whole, and a word."""
    start = F.element_at(F.array(*map(F.lit, RAW_NAMES)), (F.col("study_id") % len(RAW_NAMES) + 1).cast("int"))
    name = F.when(F.col("study_id") % 5 == 0, start).otherwise(F.concat(start, F.lit(" "), F.lower(F.split("biomarker_name", " ")[0])))
    return fixtures.mentions(spark, sf_dir).withColumn("biomarker_name", name)


def biomarker_name_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = named_mentions(spark, sf_dir)
    return meta.canonical_names(m).join(m.groupBy("biomarker_name").agg(F.count("*").alias("n")), "biomarker_name")


def canonical_repool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta.canonical(named_mentions(spark, sf_dir))
    m = m.drop("biomarker_name").withColumnRenamed("canonical", "biomarker_name")
    return meta.primary_stratum(meta.strata(m), m)


def biomarker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = named_mentions(spark, sf_dir).withColumn("country", F.pmod("ord", F.lit(4))).withColumn("sample_size", F.pmod("ord", F.lit(997)))
    return meta.biomarker_summary(m, ("cholesterol", "diabetes", "urea", "grip"), ("igf", "insulin", "diabetes", "mortality"))


def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = fixtures.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("k"), F.count("*").alias("n"))
    low, high = expr.wilson(F.col("k"), F.col("n"))
    return by.select("l_suppkey", "k", "n", rounded(low, 6).alias("low"), rounded(high, 6).alias("high"))


def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("w"), "l_returnflag", "l_discount", "l_tax", "l_linestatus")
    d, t = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    valid = F.col("l_returnflag") != "N"
    return evidence.weighted_prevalence(rows, "w", {"discounted": (d > 0.05, valid), "taxed": (t >= 0.04, valid), "open": (F.col("l_linestatus") == "O", F.lit(True)), "nobody": (F.lit(True), F.lit(False))})


def weighted_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence(spark, sf_dir)


def trait_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("trait")).agg(F.count("*").alias("total"), F.count(F.when(F.col("p_size") > 20, 1)).alias("cases"), F.min("p_partkey").alias("k"))
    indicator = F.element_at(F.array(*map(F.lit, ("discounted", "taxed", "open", "none"))), (F.col("k") % 4 + 1).cast("int"))
    return p.withColumn("indicator", indicator).withColumn("method", F.when(F.col("k") % 2 == 0, "status_composition").otherwise("mention_rate"))


def prevalence_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.prevalence_association(trait_rows(spark, sf_dir), prevalence(spark, sf_dir))


def scored_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("trait")).agg(F.count("*").alias("individuals"), F.count_distinct("p_brand").alias("papers"), F.min("p_size").alias("m"))
    tier = F.element_at(F.array(*map(F.lit, ("gold", "silver", "bronze"))), (F.col("m") % 3 + 1).cast("int"))
    ratio = F.when(F.col("m") % 2 == 0, F.col("m") / 10.0 + 0.1)
    return evidence.evidence_score(p.select("trait", tier.alias("tier"), "individuals", "papers", ratio.alias("ratio")))


def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_traits(spark, sf_dir).select("trait", "tier", "individuals", "papers", "evidence_score")


def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.domain_rollup(scored_traits(spark, sf_dir).withColumn("domain", F.element_at(F.split("trait", " "), 1)))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    trait = F.element_at(F.array(*map(F.lit, ("Longevity", "Parental lifespan", "COVID-19 ageing", "Height", "Age at death"))), (k % 5 + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "part").select(
        trait.alias("trait"), F.concat(F.lit("rs"), (k % 300).cast("string"), F.when(k % 7 == 0, F.lit("; rs9")).otherwise(F.lit(""))).alias("snps"), F.concat((k % 9 + 1).cast("string"), F.lit("e-"), (k % 6 + 5).cast("string")).alias("p_value"),
        F.when(k % 11 == 0, F.lit("NR")).otherwise(((k % 40) / 20.0 - 0.5).cast("string")).alias("effect"), (k % 22 + 1).cast("string").alias("chr"), (k % 300).cast("string").alias("pos"), k.cast("long").alias("ord"),
    )


def gwas_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gwas_panel(catalogue(spark, sf_dir)).select("snp", "trait", "p_value", "direction", "chr", "pos")


def variant_freq_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    f = fixtures.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 22 + 1).cast("string").alias("chr"), (F.col("l_partkey") % 300).cast("string").alias("pos"), F.col("l_returnflag").alias("a1"),
        F.col("l_discount").cast("double").alias("f_case"), F.col("l_tax").cast("double").alias("f_ctrl"), F.struct(line, "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice").alias("line"),
    )
    return evidence.variant_freq_join(evidence.gwas_panel(catalogue(spark, sf_dir)), f).select("snp", "chr", "pos", "f_case", "f_ctrl", "freq_diff")


def layer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    traits = scored_traits(spark, sf_dir).select(F.col("trait").alias("feature"), F.lit("positive").alias("direction"))
    snps = evidence.gwas_panel(catalogue(spark, sf_dir)).select(F.col("snp").alias("feature"), "direction")
    m = fixtures.mentions(spark, sf_dir)
    markers = meta.primary_stratum(meta.strata(m), m).where(F.col("model_use").isin("similarity_primary", "prognostic_supporting")).select(F.col("biomarker_name").alias("feature"), F.when(F.col("pooled") >= 1, "higher").otherwise("lower").alias("direction"))
    return evidence.layer_assignment((traits, 1, "behavioural"), (markers, 3, "biomarker"), (snps, 3, "variant"))


QUERIES = {
    f.__name__: f
    for f in (
        contrast_type, study_collapse, dl_pool, strata_grade, biomarker_unstratified_pool, primary_stratum, biomarker_name_canon, canonical_repool, biomarker_summary, wilson_interval,
        weighted_prevalence, prevalence_association, evidence_score, domain_rollup, gwas_panel, variant_freq_join, layer_assignment,
    )
}

Z = "1.959963984540054::DOUBLE"
_contrast = "CASE WHEN regexp_matches(lower(biomarker_name), 'mortalit|surviv|death|fatal|lethal') THEN 'prognostic_outcome' WHEN effect_measure = 'HR' THEN 'prognostic_mortality' WHEN effect_measure = 'OR' AND subject_class IN ('centenarian', 'nonagenarian', 'supercentenarian') THEN 'prevalence_longlived' ELSE 'disease_risk' END"
_keys = "biomarker_name, effect_measure, contrast_type, subject_class"
CTES["effects"] = f"SELECT *, {_contrast} AS contrast_type FROM mentions"


def _studies(source: str, keys: str) -> str:
    return f"""SELECT {keys}, study_id, CASE WHEN m IS NULL THEN a ELSE value END AS value, ci_lower, ci_upper, m IS NOT NULL AS has_ci FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys}, study_id ORDER BY ci_lower IS NULL, round(abs(value - m), 9), ord, value, ci_lower) AS rn FROM (
        SELECT *, median(value) FILTER (WHERE ci_lower IS NOT NULL) OVER (PARTITION BY {keys}, study_id) AS m, median(value) OVER (PARTITION BY {keys}, study_id) AS a FROM {source})) WHERE rn = 1"""


def _pools(source: str, keys: str) -> str:
    return f"""SELECT {keys}, mu, se, exp(mu) AS pooled, exp(mu - {Z} * se) AS ci_lower, exp(mu + {Z} * se) AS ci_upper, i2 AS i_squared, tau2 AS tau_squared, k AS n_ci, up OR down AS same_direction FROM (
      SELECT {keys}, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu, 1 / sqrt(sum(1 / (v + tau2))) AS se, any_value(i2) AS i2, any_value(tau2) AS tau2, any_value(k) AS k, any_value(up) AS up, any_value(down) AS down FROM (
        SELECT *, CASE WHEN w - ww / w > 0 THEN greatest(0, (q - k + 1) / (w - ww / w)) ELSE 0 END AS tau2, CASE WHEN q > 1e-9 THEN greatest(0, (q - k + 1) / q) * 100 ELSE 0 END AS i2 FROM (
          SELECT *, greatest(wyy - wy * wy / w, 0) AS q FROM (SELECT *, count(*) OVER p AS k, sum(1 / v) OVER p AS w, sum(y / v) OVER p AS wy, sum(y * y / v) OVER p AS wyy, sum(1 / (v * v)) OVER p AS ww, min(y) OVER p > 0 AS up, max(y) OVER p < 0 AS down
            FROM (SELECT *, ln(value) AS y, pow((ln(ci_upper) - ln(ci_lower)) / (2 * {Z}), 2) AS v FROM {source} WHERE has_ci) WINDOW p AS (PARTITION BY {keys})) WHERE k > 1)) GROUP BY {keys})"""


def _strata(tag: str) -> str:
    good = "CASE WHEN n_ci_all >= 2 THEN contrast_type <> 'prognostic_outcome' AND same_direction AND i_squared <= 75 WHEN n_ci_all = 1 THEN contrast_type <> 'prognostic_outcome' ELSE FALSE END"
    return f"""SELECT {_keys}, n_studies, n_ci_all AS n_ci, {rnd("coalesce(CASE WHEN n_ci_all >= 2 THEN p.pooled WHEN n_ci_all = 1 THEN o.value END, point)", 5)} AS pooled, {rnd("CASE WHEN n_ci_all >= 2 THEN p.ci_lower WHEN n_ci_all = 1 THEN o.lo END", 5)} AS ci_lower,
      {rnd("CASE WHEN n_ci_all >= 2 THEN p.ci_upper WHEN n_ci_all = 1 THEN o.hi END", 5)} AS ci_upper, {rnd("i_squared", 4)} AS i_squared, {rnd("tau_squared", 6)} AS tau_squared, good AS commensurable, grade,
      CASE WHEN NOT good THEN 'directional_only' WHEN contrast_type = 'prevalence_longlived' AND grade IN ('A', 'B') THEN 'similarity_primary' WHEN contrast_type = 'prevalence_longlived' THEN 'similarity_supporting' WHEN grade IN ('A', 'B') THEN 'prognostic_supporting' ELSE 'directional_only' END AS model_use
      FROM (SELECT *, CASE WHEN NOT good THEN 'C' WHEN n_ci_all = 1 THEN 'B' WHEN n_ci_all >= 3 AND i_squared <= 50 THEN 'A' WHEN n_ci_all >= 2 THEN 'B' ELSE 'C' END AS grade FROM (SELECT *, {good} AS good FROM (
        SELECT {_keys}, count(*) AS n_studies, count(*) FILTER (WHERE has_ci) AS n_ci_all, median(value) AS point FROM studies{tag} GROUP BY {_keys}) LEFT JOIN pools{tag} USING ({_keys}))) p
      LEFT JOIN (SELECT {_keys}, max(value) FILTER (WHERE has_ci) AS value, max(ci_lower) AS lo, max(ci_upper) AS hi FROM studies{tag} GROUP BY {_keys}) o USING ({_keys})"""


def _primary(tag: str, source: str) -> str:
    n = "(SELECT count(DISTINCT study_id) FROM " + source + ")"
    p, c, h = f"(n_sources / {n}::DOUBLE)", f"((n_sources / {n}::DOUBLE) + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})", f"{Z} * sqrt((n_sources / {n}::DOUBLE) * (1 - n_sources / {n}::DOUBLE) / {n} + {Z} * {Z} / (4 * {n}::DOUBLE * {n})) / (1 + {Z} * {Z} / {n})"
    return f"""WITH s AS (SELECT biomarker_name, count(DISTINCT study_id) AS n_sources FROM {source} GROUP BY biomarker_name),
      b AS (SELECT *, row_number() OVER (PARTITION BY biomarker_name ORDER BY CASE model_use WHEN 'similarity_primary' THEN 0 WHEN 'prognostic_supporting' THEN 1 WHEN 'similarity_supporting' THEN 2 ELSE 3 END, grade, -n_ci, contrast_type, effect_measure, subject_class) AS rn FROM strata{tag} WHERE commensurable),
      c AS (SELECT biomarker_name, count(*) AS n_strata, count(*) FILTER (WHERE commensurable) AS n_commensurable FROM strata{tag} GROUP BY biomarker_name)
      SELECT s.biomarker_name, n_sources, coalesce(n_strata, 0) AS n_strata, coalesce(n_commensurable, 0) AS n_commensurable, b.effect_measure AS measure, b.contrast_type AS contrast, b.subject_class AS class, b.pooled, coalesce(b.grade, 'C') AS grade,
      coalesce(b.model_use, CASE WHEN n_strata IS NULL THEN 'qualitative_baserate' ELSE 'directional_only' END) AS model_use, {rnd(p, 6)} AS base_rate, {rnd(f"greatest(0, {c} - {h})", 6)} AS base_low, {rnd(f"least(1, {c} + {h})", 6)} AS base_high
      FROM s LEFT JOIN c USING (biomarker_name) LEFT JOIN b ON b.biomarker_name = s.biomarker_name AND rn = 1"""


_snake = "regexp_replace(regexp_replace(lower(biomarker_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_low = "lower(biomarker_name)"
for _phrase in STRIPPED_PHRASES:
    _low = f"replace({_low}, {literal(_phrase)}, ' ')"
_in = lambda words: "(" + ", ".join(map(literal, words)) + ")"
_left = f"array_to_string(list_filter(regexp_split_to_array({_low}, '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN {_in(STRIPPED_WORDS)}), '_')"
_doubts = ["garbage", "ambiguous", "foreign_", "unmatched"]
_notes = ["EXTRACTION_GARBAGE: no clear clinical term", "AMBIGUOUS: multiple candidate terms / negation", "NON_ENGLISH: mapped from es/pt phrasing", "NO_CANONICAL_MATCH: kept stripped term, verify"]
CTES |= {
    "dim_trigger": values([(t, c, i) for i, (c, t) in enumerate((c, t) for c, ts in CANONICAL for t in ts)], "trigger, canonical, ord"),
    "named_mentions": f"SELECT m.* EXCLUDE biomarker_name, CASE WHEN study_id % 5 = 0 THEN r ELSE r || ' ' || lower(string_split(biomarker_name, ' ')[1]) END AS biomarker_name FROM (SELECT *, ([{', '.join(map(literal, RAW_NAMES))}])[study_id % {len(RAW_NAMES)} + 1] AS r FROM mentions) m",
    "studies": _studies("effects", _keys),
    "pools": _pools("studies", _keys),
    "strata": _strata(""),
    "canon_hits": "SELECT biomarker_name, arg_min(canonical, ord) AS name, 'matched:' || arg_min(trigger, ord) AS how FROM (SELECT DISTINCT biomarker_name FROM named_mentions) JOIN dim_trigger ON contains(lower(biomarker_name), trigger) GROUP BY biomarker_name",
    "canon_names": f"""SELECT biomarker_name, canonical, rule, name_changed, CASE WHEN {" OR ".join(_doubts)} THEN 'high' WHEN name_changed THEN 'low' ELSE 'none' END AS review_priority,
      coalesce(nullif(concat_ws('; ', CASE WHEN name_changed THEN rule END, {", ".join(f"CASE WHEN {d} THEN {literal(n)} END" for d, n in zip(_doubts, _notes, strict=True))}), ''), 'formatting_only') AS note
      FROM (SELECT *, name_changed AND rule = 'fallback_stripped' AS unmatched, biomarker_name IN {_in(GARBAGE_NAMES)} AS garbage, biomarker_name IN {_in(AMBIGUOUS_NAMES)} AS ambiguous, {" OR ".join(f"contains(lower(biomarker_name), {literal(x)})" for x in FOREIGN_PARTS)} AS foreign_
      FROM (SELECT *, canonical <> {_snake} AS name_changed FROM (SELECT n.biomarker_name, coalesce(h.name, nullif({_left.replace("biomarker_name", "n.biomarker_name")}, ''), {_snake.replace("biomarker_name", "n.biomarker_name")}) AS canonical, coalesce(h.how, 'fallback_stripped') AS rule
      FROM (SELECT DISTINCT biomarker_name FROM named_mentions) n LEFT JOIN canon_hits h USING (biomarker_name))))""",
    "canon_mentions": f"SELECT c.canonical AS biomarker_name, m.* EXCLUDE biomarker_name FROM named_mentions m JOIN canon_names c USING (biomarker_name) WHERE biomarker_name NOT IN {_in(DROPPED_NAMES)}",
    "canon_effects": f"SELECT *, {_contrast} AS contrast_type FROM canon_mentions",
    "studies_canon": _studies("canon_effects", _keys),
    "pools_canon": _pools("studies_canon", _keys),
    "strata_canon": _strata("_canon"),
    "studies_plain": _studies("mentions", "biomarker_name"),
    "pools_plain": _pools("studies_plain", "biomarker_name"),
}
_wilson = lambda k, n, z: (f"(({k}) / {n}::DOUBLE + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})", f"{z} * sqrt((({k}) / {n}::DOUBLE) * (1 - ({k}) / {n}::DOUBLE) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n})) / (1 + {z} * {z} / {n})")
_c, _h = _wilson("k", "n", Z)
_c2, _h2 = _wilson("p / v * n", "n", "1.96::DOUBLE")
CTES["prevalence"] = f"""SELECT indicator, n, round(v, 0) AS n_weighted, {rnd("100 * CASE WHEN v > 0 THEN p / v END", 2)} AS prevalence_pct, {rnd(f"100 * CASE WHEN v > 0 THEN greatest(0, {_c2} - ({_h2})) END", 2)} AS ci_low, {rnd(f"100 * CASE WHEN v > 0 THEN least(1, {_c2} + ({_h2})) END", 2)} AS ci_high FROM (
  SELECT 'discounted' AS indicator, count(*) FILTER (WHERE l_returnflag <> 'N') AS n, coalesce(sum(l_quantity::DOUBLE) FILTER (WHERE l_returnflag <> 'N'), 0) AS v, coalesce(sum(l_quantity::DOUBLE) FILTER (WHERE l_returnflag <> 'N' AND l_discount::DOUBLE > 0.05), 0) AS p FROM lineitem
  UNION ALL SELECT 'taxed', count(*) FILTER (WHERE l_returnflag <> 'N'), sum(l_quantity::DOUBLE) FILTER (WHERE l_returnflag <> 'N'), sum(l_quantity::DOUBLE) FILTER (WHERE l_returnflag <> 'N' AND l_tax::DOUBLE >= 0.04) FROM lineitem
  UNION ALL SELECT 'open', count(*), sum(l_quantity::DOUBLE), sum(l_quantity::DOUBLE) FILTER (WHERE l_linestatus = 'O') FROM lineitem UNION ALL SELECT 'nobody', 0, 0.0::DOUBLE, 0.0::DOUBLE)"""
CTES["trait_rows"] = """SELECT *, (['discounted', 'taxed', 'open', 'none'])[k % 4 + 1] AS indicator, CASE WHEN k % 2 = 0 THEN 'status_composition' ELSE 'mention_rate' END AS method FROM (
  SELECT p_brand AS trait, count(*) AS total, count(*) FILTER (WHERE p_size > 20) AS cases, min(p_partkey) AS k FROM part GROUP BY p_brand)"""
CTES["traits"] = "SELECT p_type AS trait, (['gold', 'silver', 'bronze'])[min(p_size) % 3 + 1] AS tier, count(*) AS individuals, count(DISTINCT p_brand) AS papers, CASE WHEN min(p_size) % 2 = 0 THEN min(p_size) / 10.0::DOUBLE + 0.1 END AS ratio FROM part GROUP BY p_type"
_mm = lambda x: f"CASE WHEN max({x}) OVER () > min({x}) OVER () THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) WHEN {x} IS NOT NULL THEN 0.5 END"
CTES["scored_traits"] = f"""SELECT trait, tier, individuals, papers, {rnd("CASE WHEN nr IS NOT NULL THEN b + 0.15 * nr ELSE b / 0.85 END", 4)} AS evidence_score FROM (SELECT *, 0.35 * CASE tier WHEN 'gold' THEN 1.0 WHEN 'silver' THEN 0.66 ELSE 0.33 END + 0.25 * ni + 0.25 * na AS b FROM (
  SELECT *, {_mm("i")} AS ni, {_mm("a")} AS na, {_mm("r")} AS nr FROM (SELECT *, ln(1 + individuals) AS i, ln(1 + papers) AS a, CASE WHEN ratio > 0 THEN abs(ln(ratio)) END AS r FROM traits)))"""
CTES["panel"] = """SELECT snp, trait, p AS p_value, chr, pos, CASE WHEN (contains(t, 'age at death') OR contains(t, 'parental')) THEN CASE WHEN e > 0 THEN 'longevity_associated' WHEN e < 0 THEN 'longevity_adverse' ELSE 'reported' END
  WHEN regexp_matches(t, 'longevity|lifespan|long-lived|extreme age|attained age|centenarian|exceptional long') AND e > 1 THEN 'longevity_associated' WHEN regexp_matches(t, 'longevity|lifespan|long-lived|extreme age|attained age|centenarian|exceptional long') AND e > 0 AND e < 1 THEN 'longevity_adverse' ELSE 'reported' END AS direction
  FROM (SELECT *, lower(trait) AS t, row_number() OVER (PARTITION BY snp ORDER BY p, k) AS rn FROM (SELECT p_partkey AS k, (['Longevity', 'Parental lifespan', 'COVID-19 ageing', 'Height', 'Age at death'])[p_partkey % 5 + 1] AS trait, 'rs' || (p_partkey % 300)::VARCHAR AS snp,
    ((p_partkey % 9 + 1)::VARCHAR || 'e-' || (p_partkey % 6 + 5)::VARCHAR)::DOUBLE AS p, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 40) / 20.0::DOUBLE - 0.5 END AS e, (p_partkey % 22 + 1)::VARCHAR AS chr, (p_partkey % 300)::VARCHAR AS pos FROM part)
    WHERE p <= 5e-8 AND trait NOT IN ('COVID-19 ageing', 'Height')) WHERE rn = 1"""
_odds = lambda p: f"(least(greatest({p}, 1e-6), 1 - 1e-6) / (1 - least(greatest({p}, 1e-6), 1 - 1e-6)))"
SQL = {k: sql(v) for k, v in {
    "contrast_type": "SELECT effect_measure, subject_class, contrast_type, count(*) AS n FROM effects GROUP BY ALL",
    "study_collapse": f"SELECT {_keys}, study_id, {rnd('value', 6)} AS value, {rnd('ci_lower', 6)} AS ci_lower, {rnd('ci_upper', 6)} AS ci_upper, has_ci FROM studies",
    "dl_pool": f"SELECT {_keys}, " + ", ".join(f"{rnd(c, 5)} AS {c}" for c in ("mu", "se", "pooled", "ci_lower", "ci_upper", "i_squared", "tau_squared")) + ", n_ci, same_direction FROM pools",
    "strata_grade": "SELECT * FROM strata",
    "biomarker_unstratified_pool": f"""SELECT biomarker_name, n_studies, n_with_ci, CASE WHEN n_with_ci >= 2 THEN 'pooled_DL' WHEN n_with_ci = 1 THEN 'single_study' ELSE 'point_no_ci' END AS effect_model, {rnd('coalesce(pooled, one, point)', 5)} AS effect,
      CASE WHEN n_with_ci >= 3 AND ci_upper / ci_lower <= 3 THEN 'A' WHEN n_with_ci >= 2 THEN 'B' ELSE 'C' END AS grade FROM (SELECT biomarker_name, count(*) AS n_studies, count(*) FILTER (WHERE has_ci) AS n_with_ci, max(value) FILTER (WHERE has_ci) AS one, median(value) AS point FROM studies_plain GROUP BY biomarker_name)
      LEFT JOIN pools_plain USING (biomarker_name)""",
    "primary_stratum": _primary("", "mentions"),
    "biomarker_name_canon": "SELECT * FROM canon_names JOIN (SELECT biomarker_name, count(*) AS n FROM named_mentions GROUP BY 1) USING (biomarker_name)",
    "canonical_repool": _primary("_canon", "canon_mentions"),
    "biomarker_summary": """SELECT *, CASE WHEN w AND (in_survey OR in_gwas) THEN 'A' WHEN in_survey AND in_gwas AND (n_sources >= 3 OR n_mentions >= 5) AND f THEN 'A' WHEN w THEN 'B' WHEN n_sources >= 2 AND (in_survey OR in_gwas) AND f THEN 'B' WHEN n_sources >= 3 AND f THEN 'B' ELSE 'C' END AS grade FROM (
      SELECT *, n_sources >= 3 AND n_countries >= 2 AS w, len(string_split(biomarker_name, ' ')) <= 4 AS f, list_has_any(t, ['cholesterol', 'diabetes', 'urea', 'grip']) AS in_survey, list_has_any(t, ['igf', 'insulin', 'diabetes', 'mortality']) AS in_gwas FROM (SELECT biomarker_name, count(*) AS n_mentions, count(DISTINCT study_id) AS n_sources, count(DISTINCT ord % 4) AS n_countries,
      string_agg(DISTINCT subject_class, '|' ORDER BY subject_class) AS classes, string_agg(DISTINCT effect_measure, '|' ORDER BY effect_measure) AS value_types, floor(median(ord % 997))::INTEGER AS median_n, regexp_split_to_array(lower(biomarker_name), '[^a-z0-9]+') AS t FROM named_mentions GROUP BY biomarker_name))""",
    "wilson_interval": f"SELECT l_suppkey, k, n, {rnd(f'greatest(0, {_c} - ({_h}))', 6)} AS low, {rnd(f'least(1, {_c} + ({_h}))', 6)} AS high FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)",
    "weighted_prevalence": "SELECT * FROM prevalence",
    "prevalence_association": f"""SELECT trait, indicator, {rnd('100 * cp', 2)} AS case_pct, prevalence_pct, {rnd('CASE WHEN pp > 0 THEN cp / pp END', 3)} AS ratio, CASE WHEN pp IS NULL THEN NULL ELSE {rnd(f'ln({_odds("cp")} / {_odds("pp")})', 3)} END AS log_odds_ratio, d AS direction, method = 'status_composition' AND d IN ('enriched', 'depleted') AS gold FROM (
      SELECT *, CASE WHEN pp IS NULL OR pp <= 0 THEN 'unavailable' WHEN cp / pp > 1.1 THEN 'enriched' WHEN cp / pp < 0.9 THEN 'depleted' ELSE 'neutral' END AS d FROM (SELECT t.*, prevalence_pct, cases / total AS cp, prevalence_pct / 100 AS pp FROM trait_rows t LEFT JOIN prevalence USING (indicator)))""",
    "evidence_score": "SELECT * FROM scored_traits",
    "domain_rollup": f"SELECT string_split(trait, ' ')[1] AS domain, {rnd('sum(evidence_score * greatest(individuals, 1)) / sum(greatest(individuals, 1))', 4)} AS evidence_score, string_agg(trait, '|' ORDER BY individuals DESC, trait) AS traits, first(trait ORDER BY individuals DESC, trait) AS strongest, sum(individuals)::BIGINT AS mentions, count(*) AS n_traits FROM scored_traits GROUP BY 1",
    "gwas_panel": "SELECT snp, trait, p_value, direction, chr, pos FROM panel",
    "variant_freq_join": f"""SELECT snp, chr, pos, f_case, f_ctrl, {rnd('f_case - f_ctrl', 4)} AS freq_diff FROM panel LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chr, pos ORDER BY line DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM (
      SELECT (l_partkey % 22 + 1)::VARCHAR AS chr, (l_partkey % 300)::VARCHAR AS pos, l_discount::DOUBLE AS f_case, l_tax::DOUBLE AS f_ctrl, l_orderkey * 10 + l_linenumber AS line, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM lineitem)) f USING (chr, pos) WHERE rn = 1 OR rn IS NULL""",
    "layer_assignment": "SELECT trait AS feature, 'behavioural' AS kind, 1 AS layer, 'positive' AS direction FROM traits UNION ALL SELECT snp, 'variant', 3, direction FROM panel UNION ALL SELECT biomarker_name, 'biomarker', 3, CASE WHEN pooled >= 1 THEN 'higher' ELSE 'lower' END FROM (" + _primary("", "mentions").replace("WITH s AS", "WITH s AS", 1) + ") WHERE model_use IN ('similarity_primary', 'prognostic_supporting')",
}.items()}
SQL["biomarker_summary"] = SQL["biomarker_summary"].replace("SELECT *, CASE WHEN w AND", "SELECT * EXCLUDE (w, f, t), CASE WHEN w AND")
