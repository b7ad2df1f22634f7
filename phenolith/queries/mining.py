"""Queries of the mention and cohort-assembly part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, mining, scoring, subjects, tagging
from ..operators.dictionary import words_pattern
from ..plans import fixtures, model
from ..plans.lexicon import COMPARED, CONTROL_PERCENT, CUES, DESIGN, FARTHEST_NAME, LARGEST_AGE, LEAST_AGE, LONG_LIVES, PERSON_AGES, SUFFIXES, SYNONYMS, TAG_TRAITS, TRAITS
from .scoring import clock_readings
from .sqltext import CTES, around, literal, place, rnd, sql, values
from .text import corpus


PEOPLE = ["Maria Rossi", "Jos\u00e9 \u00c1lvarez", "Al Bo", "Anna Schmidt Jr", None]
LATER = [" Then ROSSI, said so. ", " alvarez spoke. ", " Maria went home, Anna too. ", " ", ' "Schmidt" and \u00c1lvarez\'s. ']
ASCII = "[^\\x00-\\x7F]"  # engines differ on word ends beside other letters


def pick(values: list[str | None], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles about people, with tags, tiers and whether they are profiles."""
    k = F.col("doc_id")
    text = F.concat(pick(HABITS, k), pick(LATER, k), F.regexp_replace("text", ASCII, ""), pick(LATER, k + 2), pick(HABITS, k + 3))
    tagged = tagging.keyword_tags(corpus(spark, sf_dir), "abstract")
    return tagged.select(
        "doc_id", pick(PEOPLE, k).alias("person"), (k % 2 == 0).alias("verified"), (k % 3 != 0).alias("is_profile"), F.when(k % 4 == 0, "source").alias("source"),
        F.when(k % 5 < 3, pick(["nonagenarian", "centenarian"], k)).alias("tier"), F.when(k % 97 != 0, text).alias("story"), *TAG_TRAITS,
    )


def mention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.mention_windows(articles(spark, sf_dir), text="story", subject="person").select("doc_id", "window", F.md5("text").alias("digest"))


NAMES = ["maria rossi", "anna schmidt", "paul nobody"]


def name_in_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.element_at(F.array(*map(F.lit, ("Maria the Rossi", "Anna Schmidt", "Paul is far from being Nobody", "Rossi"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = corpus(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), who).alias("text"))
    return mining.name_in_text_join(docs, spark.createDataFrame([(n,) for n in NAMES], "clean string"))


#: What people do, so that the invented prose has some of it.
HABITS = [
    "She does yoga and eats fish.", "He never smoked, and sleeps eight hours.", "They walk to church with friends.", "A glass of wine, no stress, and a nap.",
    "She still works in the garden and plays chess.", "He reads, laughs and drinks coffee.", "Nothing is known.",
]


def trait_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    windows = subjects.mention_windows(rows, text="story", subject="person")
    return mining.trait_mentions(rows, windows, {t: (p, c) for p, t, c in TRAITS})


def tagged_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.tagged_traits(tagging.keyword_tags(corpus(spark, sf_dir), "abstract"))


def phrase_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.phrase_context(corpus(spark, sf_dir), ["the", "les", "die"])


DIRECTED = [" walking was higher than salt.", " walking was less, less and more.", " never any walking but unsalted, moderate food.", " balanced and normal salt intake, never high."]


def direction_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = corpus(spark, sf_dir).select("doc_id", F.concat(F.regexp_replace("text", ASCII, ""), pick(DIRECTED, F.col("doc_id"))).alias("text"))
    return mining.direction_annotate(told, ["walking daily", "salt intake", "food", "of"])


#: What papers say of ways to live, of controls and of their own design.
PAPERS = [
    " Longevity of centenarians: walking 30 minutes and wine with friends, OR 1.2, 40% of cases. Controls matched by age.",
    " Long-lived people in community-based cohorts report reading and music; in controls 35% smoked and walking was rare.",
    " Lifespan study sample recruited for exercise; the comparison group had 12.5% controls with exercise.",
    " No such context: walking, 50% of controls.",
    " Longevity: dancing. Far from it and after a long pause, all of the many different people of the town that were asked, were in the study sample of a control arm with 8 % who sang. Chocolate.",
    " supercentenarian faith and religion kept 22 % against 11 % controls; grandchildren and family history aside. Family.",
    " nothing",
]
WAYS = {t: c for _, t, c in TRAITS if t in SYNONYMS} | {"odd (new) trait": "sleep"}


def ways_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.regexp_replace("text", ASCII, ""), pick(PAPERS, k))
    return corpus(spark, sf_dir).select("doc_id", text.alias("text"), (k % 2 == 0).alias("has_effect"), (k % 3 != 0).alias("has_percent"))


def corroboration_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.corroboration_lock(ways_papers(spark, sf_dir), WAYS)


def control_pct_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.control_pct_mine(ways_papers(spark, sf_dir), list(WAYS))


AGED = [
    " Maria Rossi, a 104-year-old, met Anna Schmidt, aged 99.", " At the age of 103 Anna Schmidt sang. Maria the Rossi turned 101.", " The 120 people took 130 mg on page 101.", " She is 97 years old; who was 99 and who is 140.",
    " Maria Rossi." + " so" * 250 + " He turned 111 and was aged 98.", " A supercentenarian aged 113 saw Paul of Nobody who was 105 years old.",
]


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.concat(F.regexp_replace("text", ASCII, ""), pick(AGED, F.col("doc_id"))).alias("text"))


def age_person_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = aged(spark, sf_dir)
    return mining.age_person_mentions(docs, mining.name_positions(docs, spark.createDataFrame([(n,) for n in NAMES], "clean string")))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    n = lambda m: (k % m).cast("string")
    tail = F.concat(F.lit(" Longevity and controls. Smoking in "), n(90), F.lit("% of controls. Body mass OR 1."), n(60), F.lit(" (95% CI 0."), n(90), F.lit("-2."), n(9), F.lit("); glucose HR 1.2"), n(10), F.lit(". CRP 1."), n(60), F.lit(" (0.5 - 3."), n(9), F.lit(")"))
    return corpus(spark, sf_dir).select("doc_id", F.concat("text", F.when(k % 3 != 0, tail).otherwise(F.lit(" nothing"))).alias("text"))


def biomarker_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.biomarker_mentions(papers(spark, sf_dir))


def unit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    told = F.concat(F.lit(". Mean fasting glucose was "), (k % 90 + 60).cast("string"), F.lit(" mg/dL, serum CRP 1."), (k % 60).cast("string"), F.lit(" - 3.5 mg/L; the hall is 90 percent full."))
    return mining.unit_mentions(corpus(spark, sf_dir).select("doc_id", F.concat("text", F.when(k % 3 != 0, told).otherwise(F.lit(" nothing"))).alias("text")))


def ci_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    found = mining.biomarker_mentions(p).select("doc_id", "ord", "value").where("value is not null")
    return mining.ci_recover(found, p)


def survey_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = fixtures.subjects(spark, sf_dir)
    k = F.col("subject_id")
    old = people.where("subject_id % 2 = 0").select("subject_id", F.col("age").alias("AGE_A"), (k % 30 / 10.0).alias("CRP_A"), F.when(k % 4 == 0, None).otherwise(k % 90 + 60).alias("GLU_A"), (k % 90 + 50).alias("GLU_B"))
    new = people.where("subject_id % 2 = 1").select("subject_id", F.col("age").alias("RIDAGE"), (k % 30).alias("HSCRP"), (k % 90 + 60).alias("LBXGLU"))
    return cohort.union_cycles(
        {"2005": (old, {"age": ["AGE_A"], "crp": ["CRP_A"], "glucose": ["GLU_A", "GLU_B"]}, {"crp": 10.0}), "2015": (new, {"age": ["RIDAGE"], "crp": ["HSCRP"], "glucose": ["LBXGLU"]}, {})}, "subject_id"
    )


#: Survey codes: number of values and the smallest.
CODES = {
    "smq020": (3, 1), "smq040": (3, 1), "alq101": (2, 1), "alq111": (2, 1), "alq130": (8, 1), "dbq700": (7, 1), "sld012": (8, 4), "sld010h": (8, 4), "paq655": (8, 0), "paq670": (8, 0),
    "dpq010": (5, 0), "dpq020": (4, 0), "dpq030": (4, 0), "dpq040": (5, 0), "dpq050": (4, 0), "dpq060": (4, 0), "dpq070": (4, 0), "dpq080": (5, 0), "dpq090": (4, 0), "huq010": (7, 0), "hsd010": (7, 1),
    "dmdmartl": (7, 1), "bmxbmi": (20, 16), "bmxwaist": (45, 70), "diq010": (4, 1), "bpq020": (3, 1), "bpq040a": (2, 1), "bpq080": (3, 1), "mcq160e": (3, 1), "mcq160f": (3, 1), "mcq220": (3, 1), "pfq061b": (5, 1), "osq060": (3, 1),
}


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's survey codes, with gaps."""
    k = F.col("subject_id")
    codes = (F.when((k + i) % 6 != 0, k * (2 * i + 3) % n + lo).alias(c) for i, (c, (n, lo)) in enumerate(CODES.items()))
    return fixtures.subjects(spark, sf_dir).select("subject_id", "sex", *codes)


#: Alignments that stand in the cohort as columns.
COHORT_COLUMNS = ["q_smoking", "q_sleep", "q_body_mass_index", "body_mass_index", "hba1c"]


def cohort_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cycles with their own columns and units to answers, measures, three scores, outcomes and feature columns."""
    k = F.col("subject_id")
    died = fixtures.subjects(spark, sf_dir).select("subject_id", (k % 3 % 2 + 1).cast("int").alias("eligstat"), (k % 2).cast("int").alias("mortstat"), (k % 200).cast("int").alias("permth_exm"))
    coded = survey_cycles(spark, sf_dir).join(survey(spark, sf_dir), "subject_id")
    return cohort.assemble_cohort(coded, fixtures.clinical(spark, sf_dir), died, model.options(spark), model.features(spark), model.constructs(spark), COHORT_COLUMNS, ["crp", "glucose"])


def survey_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.survey_answers(survey(spark, sf_dir))


def cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_scores(survey_answers(spark, sf_dir), fixtures.clinical(spark, sf_dir), model.options(spark), model.features(spark), model.constructs(spark))


def epi_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clock_readings(spark, sf_dir)
    last = r.groupBy("subject_id", "clock_name", "sex").agg(F.max_by(F.struct("value", "chronological_age"), "reading").alias("v")).select("subject_id", "clock_name", "sex", "v.*")
    panel = scoring.clock_panel(last, model.clocks(spark), model.segments(spark)).where("scoreable and alignment is not null")
    names = [c for c, x in model.CLOCKS.items() if x[2]]
    wide = cohort.feature_columns(panel.select("subject_id", F.col("clock_name").alias("feature"), "alignment"), names)
    return cohort.epi_cohort(fixtures.cohort(spark, sf_dir).select("subject_id", "age", "score"), wide)


QUERIES = {
    f.__name__: f
    for f in (mention_windows, name_in_text_join, trait_mentions, tagged_traits, phrase_context, direction_annotate, corroboration_lock, control_pct_mine, age_person_mentions, biomarker_mentions, unit_mentions, ci_recover, cohort_build, survey_answers, cohort_scores, epi_cohort)
}
CTES["named"] = "SELECT doc_id, text || ' ' || (['Maria the Rossi', 'Anna Schmidt', 'Paul is far from being Nobody', 'Rossi'])[doc_id % 4 + 1] AS text FROM documents"
_names = " UNION ALL ".join(f"SELECT doc_id, {literal(n)} AS match FROM named WHERE regexp_matches(lower(text), {literal(r'\b' + n.split()[0] + r'\b.{0,15}\b' + n.split()[-1] + r'\b')})" for n in NAMES)
_pick = lambda values, k: f"([{', '.join(map(literal, values))}])[({k}) % {len(values)} + 1]"
_ascii = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"
CTES["articles"] = f"""SELECT doc_id, abstract, {_pick(PEOPLE, "doc_id")} AS person, doc_id % 2 = 0 AS verified, doc_id % 3 <> 0 AS is_profile, CASE WHEN doc_id % 4 = 0 THEN 'source' ELSE 'unknown' END AS source, CASE WHEN doc_id % 5 < 3 THEN {_pick(["nonagenarian", "centenarian"], "doc_id")} END AS tier,
  CASE WHEN doc_id % 97 <> 0 THEN {_pick(HABITS, "doc_id")} || {_pick(LATER, "doc_id")} || {_ascii} || {_pick(LATER, "doc_id + 2")} || {_pick(HABITS, "doc_id + 3")} END AS story FROM corpus"""
_plainly = lambda x: f"translate(lower({x}), {literal(subjects.ACCENTED)}, {literal(subjects.PLAIN)})"
CTES["told_words"] = rf"""SELECT *, CASE WHEN length(n[-1]) > 2 THEN n[-1] END AS last_, CASE WHEN length(n[1]) > 2 THEN n[1] END AS first_ FROM (SELECT doc_id, string_split(trim(regexp_replace(story, '\s+', ' ', 'g')), ' ') AS w,
  list_filter(regexp_split_to_array({_plainly("coalesce(person, '')")}, '[^a-z]+'), lambda x: x <> '' AND x NOT IN ({", ".join(map(literal, SUFFIXES))})) AS n FROM articles WHERE trim(regexp_replace(story, '\s+', ' ', 'g')) <> '')"""
CTES["told_places"] = f"""SELECT doc_id, w, unnest(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE [0] END) AS i FROM (SELECT doc_id, w, list_filter(range(0, len(p)), lambda i: contains(p[i + 1], last_)) AS a, list_filter(range(0, len(p)), lambda i: contains(p[i + 1], first_)) AS b
  FROM (SELECT *, list_transform(w, lambda x: trim({_plainly("x")}, {literal(".,;:!?'" + chr(34) + "()")})) AS p FROM told_words))"""
CTES["told"] = """SELECT doc_id, "window", array_to_string(w[greatest(min(i) - 20, 0) + 1 : least(max(i) + 20, len(any_value(w)))], ' ') AS text FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "window" FROM (
  SELECT *, coalesce((i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 40)::INTEGER, 1) AS new FROM told_places)) GROUP BY doc_id, "window", w"""
CTES["told_of"] = "SELECT * FROM articles WHERE person IS NOT NULL AND (is_profile OR coalesce(tier = 'nonagenarian', FALSE))"
CTES["lowered"] = "SELECT doc_id, lower(abstract) AS t FROM corpus"
_heads = {"walking daily": "walking", "salt intake": "salt", "food": "food"}
CTES["directed"] = f"SELECT doc_id, lower({_ascii} || {_pick(DIRECTED, 'doc_id')}) AS t FROM documents"
CTES["directed_windows"] = " UNION ALL ".join(f"SELECT {literal(p)} AS phrase, doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {around(80, 80)} AS x FROM (SELECT doc_id, t, regexp_extract_all(t, {literal(rf'\b{w}\b')}) AS h, regexp_split_to_array(t, {literal(rf'\b{w}\b')}) AS g FROM directed))" for p, w in _heads.items())
_cues = ", ".join(f"{{'c': len(regexp_extract_all(x, {literal(p)})), 'o': {-i}, 'n': {literal(n)}}}" for i, (n, p) in enumerate(CUES.items()))
_votes = ", ".join(f"{{'c': count(*) FILTER (WHERE vote = {literal(n)}), 'o': {-i}, 'n': {literal(n)}}}" for i, n in enumerate(CUES))
CTES["ways_papers"] = f"SELECT doc_id, lower({_ascii} || {_pick(PAPERS, 'doc_id')}) AS t, doc_id % 2 = 0 AS has_effect, doc_id % 3 <> 0 AS has_percent FROM documents"
_ways = {t: words_pattern(SYNONYMS.get(t) or ["odd", "new", "trait"]) for t in WAYS}
CTES["ways_hits"] = " UNION ALL ".join(f"SELECT {literal(t)} AS trait, doc_id, t, has_effect, has_percent, regexp_extract_all(t, {literal(p)}) AS h, regexp_split_to_array(t, {literal(p)}) AS g FROM ways_papers WHERE regexp_matches(t, {literal(LONG_LIVES)}) AND regexp_matches(t, {literal(p)})" for t, p in _ways.items())
CTES["ways"] = values([(t, c, mining.survey_module(t, c) or "", "who" if "alcohol" in t or "drink" in t or c == "physical_activity" else "") for t, c in WAYS.items()], "trait, category, module, who")
_control = lambda g: f"nullif(regexp_extract(x, {literal(CONTROL_PERCENT)}, {g}), '')"
CTES["aged_people"] = f"SELECT doc_id, lower({_ascii} || {_pick(AGED, 'doc_id')}) AS t FROM documents"
_starts = f"list_transform(range(1, len(h) + 1), lambda i: {{'at': {place('i')}, 'hit': h[i]}})"
_found = lambda p, more: f"SELECT doc_id, {more}, unnest({_starts}) AS s FROM (SELECT doc_id, regexp_extract_all(t, {literal(p)}) AS h, regexp_split_to_array(t, {literal(p)}) AS g FROM aged_people)"
CTES["age_spots"] = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, s.at AS pos, regexp_extract(s.hit, {literal(p)}, 1)::INTEGER AS age FROM ({_found(p, '0')}) WHERE regexp_extract(s.hit, {literal(p)}, 1)::INTEGER BETWEEN {LEAST_AGE} AND {LARGEST_AGE}" for i, p in enumerate(PERSON_AGES))
CTES["name_spots"] = " UNION ALL ".join(f"SELECT doc_id, {literal(n)} AS name, s.at AS pos FROM ({_found(r'\b' + n.split()[0] + r'\b.{0,15}\b' + n.split()[-1] + r'\b', '0')})" for n in NAMES)
_codes = ", ".join(f"CASE WHEN (subject_id + {i}) % 6 <> 0 THEN subject_id * {2 * i + 3} % {n} + {lo} END AS {c}" for i, (c, (n, lo)) in enumerate(CODES.items()))
CTES["survey"] = f"SELECT subject_id, sex, {_codes} FROM subjects"
_dpq = ", ".join(f"dpq0{i}0" for i in range(1, 10))
CTES["blues"] = f"SELECT *, CASE WHEN len(v) >= 7 THEN list_sum(v) END AS blue, coalesce(sld012, sld010h) AS hours, CASE WHEN huq010 IS NULL OR huq010 = 0 THEN hsd010 ELSE huq010 END AS health, CASE WHEN paq655 IS NULL THEN paq670 WHEN paq670 IS NULL THEN paq655 ELSE greatest(paq655, paq670) END AS days FROM (SELECT *, list_filter([{_dpq}], lambda x: x BETWEEN 0 AND 3) AS v FROM survey)"
_recodes = {
    "q_smoking": "WHEN smq020 = 2 THEN 0 WHEN smq020 = 1 AND smq040 IN (1, 2) THEN 2 WHEN smq020 = 1 THEN 1",
    "q_alcohol": "WHEN coalesce(alq101, alq111) = 2 THEN 0 WHEN alq130 <= 2 THEN 1 WHEN alq130 <= 4 THEN 2 WHEN alq130 > 4 THEN 3",
    "q_diet": "WHEN dbq700 <= 2 THEN 0 WHEN dbq700 = 3 THEN 1 WHEN dbq700 <= 5 THEN 2",
    "q_sleep": "WHEN hours BETWEEN 7 AND 9 THEN 1 WHEN hours IS NOT NULL THEN 2",
    "q_pa_frequency": "WHEN days >= 5 THEN 0 WHEN days >= 3 THEN 1 WHEN days >= 1 THEN 2 WHEN days = 0 THEN 3",
    "q_depression": "WHEN blue < 5 THEN 0 WHEN blue < 10 THEN 1 WHEN blue >= 10 THEN 2",
    "q_self_rated_health": "WHEN health = 1 THEN 0 WHEN health IN (2, 3) THEN 1 WHEN health = 4 THEN 2 WHEN health = 5 THEN 3",
    "q_family_partner": "WHEN dmdmartl = 1 THEN 0 WHEN dmdmartl = 6 THEN 1 WHEN dmdmartl = 2 THEN 2 WHEN dmdmartl IN (3, 4, 5) THEN 3",
    "q_body_mass_index": "WHEN bmxbmi < 18.5 OR bmxbmi >= 30 THEN 3 WHEN bmxbmi < 25 THEN 0 WHEN bmxbmi < 30 THEN 2",
    "q_waist_circumference": "WHEN bmxwaist < CASE WHEN sex = 'F' THEN 80 ELSE 94 END THEN 0 WHEN bmxwaist < CASE WHEN sex = 'F' THEN 88 ELSE 102 END THEN 1 WHEN bmxwaist IS NOT NULL THEN 2",
    "q_diabetes": "WHEN diq010 = 2 THEN 0 WHEN diq010 = 3 THEN 1 WHEN diq010 = 1 THEN 2",
    "q_hypertension": "WHEN bpq020 = 2 THEN 0 WHEN bpq020 = 1 AND bpq040a = 1 THEN 2 WHEN bpq020 = 1 THEN 3",
    "q_cholesterol": "WHEN bpq080 = 2 THEN 0 WHEN bpq080 = 1 THEN 2",
    "q_cardiovascular_event": "WHEN mcq160e = 1 OR mcq160f = 1 THEN 2 WHEN mcq160e = 2 OR mcq160f = 2 THEN 0",
    "q_cancer_history": "WHEN mcq220 = 1 THEN 1 WHEN mcq220 = 2 THEN 0",
    "q_functional_mobility": "WHEN pfq061b = 1 THEN 0 WHEN pfq061b = 2 THEN 1 WHEN pfq061b IN (3, 4) THEN 2",
    "q_bone_health": "WHEN osq060 = 1 THEN 2 WHEN osq060 = 2 THEN 0",
}
CTES["recoded"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT subject_id, {literal(q)} AS question_id, (CASE {w} END)::INTEGER AS option_index FROM blues" for q, w in _recodes.items()) + ") WHERE option_index IS NOT NULL"
_mean = lambda where: rnd(f"100 * sum(w * alignment) FILTER (WHERE {where}) / sum(w) FILTER (WHERE {where})", 1)
CTES["scored_parts"] = """WITH q AS (SELECT subject_id, question_id AS feature, weight AS w, alignment FROM recoded JOIN dim_option o USING (question_id, option_index) WHERE o.layer = 2)
  SELECT *, NOT EXISTS (SELECT 1 FROM clinical c JOIN dim_construct d USING (feature) WHERE c.subject_id = q.subject_id AND d.question_id = q.feature) AS stays, FALSE AS lab FROM q
  UNION ALL SELECT subject_id, feature, weight * (1 + CASE WHEN gwas THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), alignment, TRUE, TRUE FROM clinical JOIN dim_feature USING (feature)"""
CTES["papers"] = """SELECT doc_id, text || CASE WHEN doc_id % 3 <> 0 THEN ' Longevity and controls. Smoking in ' || (doc_id % 90)::VARCHAR || '% of controls. Body mass OR 1.' || (doc_id % 60)::VARCHAR || ' (95% CI 0.' || (doc_id % 90)::VARCHAR || '-2.' || (doc_id % 9)::VARCHAR
  || '); glucose HR 1.2' || (doc_id % 10)::VARCHAR || '. CRP 1.' || (doc_id % 60)::VARCHAR || ' (0.5 - 3.' || (doc_id % 9)::VARCHAR || ')' ELSE ' nothing' END AS text FROM documents"""
_hit = lambda g: f"regexp_extract(hit, {literal(mining.EFFECT)}, {g})"
_ratio = " ".join(f"WHEN lower({_hit(2)}) = {literal(n)} THEN {literal(short)}" for n, short in mining.RATIOS.items())
CTES["effects"] = f"""SELECT doc_id, ord, nullif(trim({_hit(1)}), '') AS name, CASE {_ratio} ELSE {_hit(2)} END AS measure, TRY_CAST({_hit(3)} AS DOUBLE) AS value, TRY_CAST({_hit(4)} AS DOUBLE) AS ci_lower, TRY_CAST({_hit(5)} AS DOUBLE) AS ci_upper FROM (
  SELECT doc_id, unnest(h) AS hit, (generate_subscripts(h, 1) - 1)::INTEGER AS ord FROM (SELECT doc_id, regexp_extract_all(text, {literal(mining.EFFECT)})[1:80] AS h FROM papers))"""
_all = lambda p, g: f"regexp_extract_all(text, {literal(p)}, {g})"
_fields = lambda kind, p: f"{_all(p, 1)} AS v{kind}, {_all(p, 2)} AS g{kind}, {_all(p, 3)} AS lo{kind}, {_all(p, 4)} AS hi{kind}"
_intervals = lambda k: f"list_transform(range(1, len(v{k}) + 1), lambda i: {{'kind': {k}, 'far': length(g{k}[i]), 'v': v{k}[i]::DOUBLE, 'lo': lo{k}[i]::DOUBLE, 'hi': hi{k}[i]::DOUBLE}})"
CTES["intervals"] = f"SELECT doc_id, list_concat({_intervals(0)}, {_intervals(1)}) AS found FROM (SELECT doc_id, {_fields(0, mining.LABELLED)}, {_fields(1, mining.BRACKETED)} FROM papers)"
_near = lambda p: rf"(?i)((?:\S+\s+){{0,5}}\b{p}\b(?:\s+\S+){{0,5}})"
SQL = {k: sql(v) for k, v in {
    "survey_answers": "SELECT * FROM recoded",
    "epi_cohort": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY subject_id, clock_name ORDER BY reading DESC) AS rn FROM clock_rows)
      SELECT subject_id, age, score, f.* EXCLUDE (subject_id) FROM cohort JOIN (SELECT subject_id, {", ".join(f"max(alignment) FILTER (WHERE clock_name = {literal(c)}) AS f_{c}" for c, x in model.CLOCKS.items() if x[2])} FROM l WHERE rn = 1 AND scoreable AND alignment IS NOT NULL GROUP BY subject_id) f USING (subject_id)""",
    "cohort_scores": f"""SELECT subject_id, {_mean('stays')} AS score_full, {_mean('NOT lab')} AS score_selfreport, {_mean('lab')} AS score_labs, (count(*) FILTER (WHERE NOT lab))::INTEGER AS n_answers, (count(*) FILTER (WHERE lab))::INTEGER AS n_clinical FROM scored_parts GROUP BY subject_id""",
    "mention_windows": "SELECT doc_id, \"window\", md5(text) AS digest FROM told",
    "age_person_mentions": f"""WITH pairs AS (SELECT a.doc_id, min({{'far': abs(n.pos - a.pos), 'kind': kind, 'at': a.pos, 'p': n.pos, 'name': name, 'age': age}}) AS best FROM age_spots a JOIN name_spots n ON n.doc_id = a.doc_id AND abs(n.pos - a.pos) < {FARTHEST_NAME} GROUP BY a.doc_id)
      SELECT doc_id, best.name AS name, coalesce(best.age, CASE WHEN doc_id IN (SELECT doc_id FROM name_spots) THEN first END, largest) AS age FROM (SELECT doc_id, arg_min(age, {{'kind': kind, 'at': pos}}) AS first, max(age) AS largest FROM age_spots GROUP BY doc_id) LEFT JOIN pairs USING (doc_id)""",
    "phrase_context": "SELECT phrase, rank::INTEGER AS rank, '[' || doc_id::VARCHAR || '] ' || s AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY doc_id) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT {literal(p)} AS phrase, doc_id, substr(regexp_extract(text, {literal(_near(p))}, 1), 1, 220) AS s FROM documents WHERE contains(lower(text), {literal(p)})" for p in ("the", "les", "die"))
    + ") WHERE s <> '') WHERE rank <= 5",
    "corroboration_lock": f"""WITH h AS (SELECT trait, count(*) AS raw, count(*) FILTER (WHERE len(list_filter({around(80, 80)}, lambda x: NOT regexp_matches(x, {literal(DESIGN)}))) > 0) AS topical, bool_or(has_effect AND has_percent AND regexp_matches(t, {literal(COMPARED)})) AS compared FROM ways_hits GROUP BY trait),
      c AS (SELECT w.*, coalesce(raw, 0) AS paper_count_raw, CASE WHEN raw > 100 THEN topical ELSE coalesce(raw, 0) END AS paper_count, CASE WHEN module <> '' THEN 'nhanes' ELSE who END AS known, coalesce(compared, FALSE) AS compared FROM ways w LEFT JOIN h USING (trait))
      SELECT trait, category, paper_count_raw, paper_count, module, CASE WHEN known <> '' THEN known WHEN compared THEN 'corpus_control' ELSE 'none' END AS baseline_source, CASE WHEN paper_count >= 2 THEN 'silver' ELSE 'bronze' END AS tier, paper_count >= 2 AND known <> '' AS gold_eligible FROM c""",
    "control_pct_mine": f"""WITH h AS (SELECT trait, doc_id, list_filter(list_transform({around(120, 40)}, lambda x: coalesce({_control(1)}, {_control(2)})), lambda x: x IS NOT NULL) AS found FROM ways_hits WHERE regexp_matches(t, {literal(COMPARED)})),
      k AS (SELECT trait, count(*) AS papers, sum(len(found))::BIGINT AS n, array_to_string(flatten(list(found ORDER BY doc_id))[1:3], '|') AS example FROM h GROUP BY trait)
      SELECT trait, coalesce(papers, 0) AS n_control_papers, coalesce(n, 0) AS control_pct_found, coalesce(example, '') AS example_pct, CASE WHEN n > 0 THEN 'materialized' ELSE 'silver_pending' END AS status FROM ways LEFT JOIN k USING (trait)""",
    "biomarker_mentions": "SELECT * FROM effects",
    "ci_recover": """SELECT doc_id, ord, value, best['lo'] AS found_lower, best['hi'] AS found_upper FROM (SELECT doc_id, ord, value, list_min(list_filter(found,
      lambda x: abs(x['v'] - value) <= greatest(0.03::DOUBLE, 0.03::DOUBLE * abs(value)) AND x['lo'] < x['hi'] AND value BETWEEN x['lo'] AND x['hi'])) AS best FROM effects LEFT JOIN intervals USING (doc_id) WHERE value IS NOT NULL)""",
    "name_in_text_join": _names,
    "trait_mentions": "WITH q AS (SELECT doc_id, arg_max(text, {'n': length(text), 'w': -\"window\"}) AS quote FROM told GROUP BY doc_id) "
    + " UNION ALL ".join(f"SELECT person, verified, {literal(t)} AS trait, {literal(c)} AS category, source, coalesce(quote, '') AS quote, 'boolean' AS method FROM told_of LEFT JOIN q USING (doc_id) WHERE " + " OR ".join(f"contains(lower(abstract), {literal(w)})" for w in tagging.TAGS[tag]) for tag, (t, c) in TAG_TRAITS.items())
    + " UNION ALL SELECT person, verified, trait, category, source, quote, 'keyword' FROM told_of JOIN (SELECT doc_id, trait, category, arg_min(text, \"window\") AS quote FROM told JOIN (VALUES " + ", ".join(f"({literal(p)}, {literal(t)}, {literal(c)})" for p, t, c in TRAITS) + ") v(pattern, trait, category) ON regexp_matches(lower(text), pattern) GROUP BY ALL) USING (doc_id)",
    "tagged_traits": " UNION ALL ".join(f"SELECT doc_id, {literal(t)} AS trait, {literal(c)} AS category FROM lowered WHERE " + " OR ".join(f"contains(t, {literal(w)})" for w in tagging.TAGS[tag]) for tag, (t, c) in TAG_TRAITS.items()),
    "direction_annotate": f"""SELECT phrase, windows, CASE WHEN total = 0 THEN '' WHEN best.c / total >= 0.4 THEN best.n || ' (' || round_even(100.0 * best.c / total, 0)::INTEGER::VARCHAR || '%)' ELSE 'mixed' END AS direction FROM (SELECT phrase, count(*) AS windows, count(vote) AS total, list_max([{_votes}]) AS best FROM (
      SELECT phrase, CASE WHEN b.c > 0 THEN b.n END AS vote FROM (SELECT phrase, list_max([{_cues}]) AS b FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS r FROM directed_windows) WHERE r <= 300)) GROUP BY phrase)""",
    "cohort_build": f"""WITH c AS (SELECT subject_id, '2005' AS cycle, age::DOUBLE AS age, (subject_id % 30 / 10.0)::DOUBLE * 10 AS crp, CASE WHEN subject_id % 4 = 0 THEN subject_id % 90 + 50 ELSE subject_id % 90 + 60 END::DOUBLE AS glucose FROM subjects WHERE subject_id % 2 = 0
      UNION ALL SELECT subject_id, '2015', age::DOUBLE, (subject_id % 30)::DOUBLE, (subject_id % 90 + 60)::DOUBLE FROM subjects WHERE subject_id % 2 = 1),
      f AS (SELECT subject_id, {_mean('stays')} AS score_full, {_mean('NOT lab')} AS score_selfreport, {_mean('lab')} AS score_labs, {", ".join(f"max(alignment) FILTER (WHERE feature = {literal(x)}) AS f_{x}" for x in COHORT_COLUMNS)} FROM scored_parts GROUP BY subject_id)
      SELECT c.*, sex, CASE WHEN age < 50 THEN '18-49' WHEN age < 65 THEN '50-64' WHEN age < 75 THEN '65-74' ELSE '75+' END AS age_band, f.* EXCLUDE (subject_id), CASE WHEN subject_id % 3 % 2 = 0 THEN subject_id % 2 END::INTEGER AS deceased, CASE WHEN subject_id % 3 % 2 = 0 THEN subject_id % 200 END::INTEGER AS permth_exm
      FROM c JOIN (SELECT subject_id, sex FROM subjects) USING (subject_id) LEFT JOIN f USING (subject_id) WHERE age >= 18""",
}.items()}
