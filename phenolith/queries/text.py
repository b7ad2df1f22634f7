"""Queries of the corpus part: tagging and near duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import dedup, tagging
from ..plans import fixtures
from ..plans.lexicon import BOILERPLATE, CODE_COUNTRIES, CONSTRUCTS, DOMAIN_COUNTRIES, GLUED, JUNK_SUBSTRINGS, SMOKE, SMOKING, SOURCE_COUNTRIES
from ..sources.staging import spread
from .sqltext import CTES, literal, rnd, sql


SITES = ["bbc.co.uk", "Reuters.com", "example.net", "site.org", "lemonde.fr", "news.com.au", "aarp.org", "Globo.com.br"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers and news: title, url, abstract with figures, source type, subject."""
    k = F.col("doc_id")
    n = lambda a, m: (F.lit(a) + k % m).cast("string")
    study = F.concat(
        F.col("text"), F.lit(" A prospective study in Japan of n="), n(100, 900), F.lit(" people aged "), n(85, 40), F.lit(" and "), n(70, 60), F.lit(": OR 1."), n(0, 90), F.lit(", HR 0."), n(0, 80),
        F.lit(" (95% CI 1.01-2."), n(0, 7), F.lit("), p<0.0"), n(0, 9), F.lit(", "), n(0, 100), F.lit("% had diabetes. German survey. Subscribe to our newsletter. Cookie settings here now. He smoked cigars, quit at age 50."),
    )
    d = spread(fixtures.table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "lang", "source", "n_chars", F.col("text"), study.alias("abstract"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"),
        F.concat(F.lit("https://www."), F.element_at(F.array(*map(F.lit, SITES)), (k % len(SITES) + 1).cast("int")), F.when(k % 5 == 0, "/tag/").otherwise("/story/"), k.cast("string")).alias("url"),
    )


def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.keyword_tags(corpus(spark, sf_dir), "abstract").select("doc_id", *tagging.TAGS)


def stat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.stat_extract(corpus(spark, sf_dir), "abstract").select("doc_id", *(f"stat_{n}" for n in (*tagging.STATS, "confidence_interval")))


def study_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tagging.study_type(F.col("abstract")).alias("study_type"))


def country_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.array_join(tagging.countries(F.col("abstract")), ",").alias("countries"))


def ages_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus(spark, sf_dir).select("doc_id", tagging.ages(F.col("abstract")).alias("a"))
    return a.select("doc_id", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("ages"), F.array_max("a").alias("max_age"), (F.size("a") > 0).alias("has_age"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.lit("Maria Rossi, 104, of Rome, Italy. ")).when(k % 3 == 1, F.lit("A 112-year-old Anna Schmidt lives in Berlin. ")).otherwise(F.lit("no one here "))
    return corpus(spark, sf_dir).withColumn("story", F.concat(name, F.col("text"))).withColumn("headline", F.when(k % 7 == 0, F.lit("Turning 105 now")).otherwise(F.lit("a day")))


def subject_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.subject_extract(profiles(spark, sf_dir), "headline", "story").select("doc_id", "subject_name", "subject_age", "subject_city", "subject_country")


def profile_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("doc_id", tagging.profile_flag(F.col("story")).alias("is_profile"))


def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.relevance_filter(corpus(spark, sf_dir), ["the", "die", "les"]).select("doc_id", "url")


SOURCES = ["The Korea Herald", "Haaretz", "BBC News", "O Globo", "nobody", "RTE.ie"]
CODES = ["US", "ch ", "zz", None, "RP", "Sf"]


def source_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of sources by their names, and of records by their codes."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    d = fixtures.table(spark, sf_dir, "documents").select(pick(SOURCES, F.col("doc_id")).alias("source_name"), pick(CODES, F.floor(F.col("doc_id") / 7)).alias("code"))
    return d.groupBy("source_name", tagging.source_country(F.col("source_name")).alias("country"), tagging.code_country(F.col("code")).alias("of_code")).agg(F.count("*").alias("n"))


def domain_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(tagging.domain_country(F.col("url")).alias("country")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def clean_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tagging.clean_boilerplate(F.col("abstract")).alias("clean"))


def doc_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("academic", "news", "other"))), (k % 3 + 1).cast("int"))
    study = F.element_at(F.array(*map(F.lit, ("meta-analysis", "cohort", "review", "other"))), (k % 4 + 1).cast("int"))
    size = F.when(k % 5 == 0, None).otherwise((k % 2000).cast("double"))
    age = F.when(k % 6 == 0, None).otherwise((85 + k % 40).cast("double"))
    return corpus(spark, sf_dir).select("doc_id", expr.rounded(expr.doc_weight(kind, study, size, k % 2 == 0, (k % 10) / 100.0, k % 4 == 0, age), 6).alias("weight"))


def subject_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).withColumn("a", tagging.ages(F.col("abstract")))
    return c.select("doc_id", tagging.subject_class(F.col("a"), F.array_max("a"), F.col("title"), F.col("text")).alias("subject_class"))


def construct_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    return tagging.construct_screen(corpus(spark, sf_dir).withColumn("told", F.concat("abstract", F.lit(" "), said)), CONSTRUCTS, F.col("n_chars") > 2000, "told")


#: What studies are about, so that the invented prose has some of it.
SAID = ["Hearing loss and cataracts.", "Dental care.", "Sleep apnoea was screened.", "VO2 max and gait speed.", "Household income.", "25-hydroxyvitamin D.", "A wheelchair.", "Nothing."]


def smoking_status_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagging.window_mine(corpus(spark, sf_dir).withColumn("subject", F.col("source")), SMOKE, SMOKING, "subject", "abstract")
    return found.withColumn("examples", F.array_join("examples", " | "))


def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(fixtures.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size(dedup.shingle_hashes(F.col("text"))).alias("n_shingles"))


def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dup_candidates(corpus(spark, sf_dir))


def dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dup_classes(corpus(spark, sf_dir)).rows.select("doc_id", "rep")


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.containment_pairs(dedup.dup_classes(corpus(spark, sf_dir)))


def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_clusters(corpus(spark, sf_dir))


def dup_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cluster_report(dup_clusters(spark, sf_dir))


def apply_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.apply_blacklist(corpus(spark, sf_dir), dup_clusters(spark, sf_dir)).select("doc_id", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_tags, stat_extract, study_type_classify, country_mentions, ages_mentioned, subject_extract, profile_flag, relevance_filter, domain_country, source_country, clean_boilerplate, doc_weight,
        subject_class, construct_screen, smoking_status_mine, word_shingles, dup_candidates, dup_classes, containment_pairs, dup_clusters, dup_cluster_report, apply_blacklist,
    )
}

_n = lambda a, m: f"({a} + doc_id % {m})::VARCHAR"
CTES["corpus"] = f"""SELECT doc_id, lang, source, n_chars, text, text || ' A prospective study in Japan of n=' || {_n(100, 900)} || ' people aged ' || {_n(85, 40)} || ' and ' || {_n(70, 60)} || ': OR 1.' || {_n(0, 90)} || ', HR 0.' || {_n(0, 80)}
  || ' (95% CI 1.01-2.' || {_n(0, 7)} || '), p<0.0' || {_n(0, 9)} || ', ' || {_n(0, 100)} || '% had diabetes. German survey. Subscribe to our newsletter. Cookie settings here now. He smoked cigars, quit at age 50.' AS abstract,
  array_to_string(string_split(text, ' ')[1:8], ' ') AS title, 'https://www.' || ([{', '.join(map(literal, SITES))}])[doc_id % {len(SITES)} + 1] || CASE WHEN doc_id % 5 = 0 THEN '/tag/' ELSE '/story/' END || doc_id::VARCHAR AS url FROM documents"""
_said = ", ".join(map(literal, SAID))
CTES["told"] = f"SELECT n_chars, abstract || ' ' || ([{_said}])[doc_id % {len(SAID)} + 1] AS told FROM corpus"
CTES["profiles"] = """SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Maria Rossi, 104, of Rome, Italy. ' WHEN doc_id % 3 = 1 THEN 'A 112-year-old Anna Schmidt lives in Berlin. ' ELSE 'no one here ' END || text AS story,
  CASE WHEN doc_id % 7 = 0 THEN 'Turning 105 now' ELSE 'a day' END AS headline FROM corpus"""
_any = lambda text, words: "(" + " OR ".join(f"contains({text}, {literal(w)})" for w in words) + ")"
_first = lambda text, kinds, other: "CASE " + " ".join(f"WHEN {_any(text, w)} THEN {literal(n)}" for n, w in kinds.items()) + f" ELSE {literal(other)} END"
CTES["aged"] = f"SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(abstract, {literal(tagging.AGES)}, 1), lambda a: a::INTEGER), lambda a: a >= 85))) AS a FROM corpus"
_hits = ", ".join(f"nullif(array_to_string(regexp_extract_all(abstract, {literal(p)}, 1)[1:5], '; '), '') AS stat_{n}" for n, p in tagging.STATS.items())
_fit = lambda p, g: f"coalesce(TRY_CAST(regexp_extract(c, {literal(p)}, {g}) AS INTEGER) BETWEEN 85 AND 130, FALSE)"
_before, _after = r"([A-Z][a-z]+\s+[A-Z][a-z]+),?\s*(?:age\s*)?(\d{2,3})", r"(\d{3})-?year-?old\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"
_place = r"(?:of|from|in|lives? in|based in)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?:,\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?))?"
_century = r"'\b(1[0-2][0-9])\b'"
_leads = ", ".join(f"lead(t, {k}) OVER k" for k in range(1, 7))
CTES["shingles"] = f"""SELECT DISTINCT doc_id, hash(g) AS h FROM (SELECT doc_id, i, n, concat_ws(' ', t, {_leads}) AS g FROM (
  SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)) WINDOW k AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= n - 6"""
CTES["set_sizes"] = "SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id"
CTES["bucketed"] = """SELECT doc_id, key FROM (SELECT doc_id, unnest([CASE WHEN len(t) >= 4 THEN 't:' || array_to_string(t[1:4], ' ') END, CASE WHEN length(l) >= 80 THEN 'l:' || substr(l, 1, 80) END]) AS key FROM (
  SELECT doc_id, regexp_extract_all(lower(title), '[a-z]+') AS t, regexp_replace(lower(text), '[^a-z]+', '', 'g') AS l FROM corpus WHERE len(regexp_extract_all(lower(text), '[a-z]+')) >= 7)) WHERE key IS NOT NULL"""
CTES["all_pairs"] = "SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bucketed x JOIN bucketed y ON x.key = y.key AND x.doc_id < y.doc_id"
CTES["dup_sets"] = """SELECT doc_id, list(h ORDER BY h) AS s FROM shingles GROUP BY doc_id"""
CTES["dup_keys"] = """SELECT doc_id, list(key ORDER BY key) AS keys FROM bucketed WHERE key IN (SELECT key FROM bucketed GROUP BY key HAVING count(*) > 1) GROUP BY doc_id"""
CTES["dup_reps"] = "SELECT doc_id, min(doc_id) OVER (PARTITION BY keys, s) AS rep FROM dup_keys JOIN dup_sets USING (doc_id)"
CTES["contained"] = """SELECT a, b, round(k / least(x.n, y.n), 6) AS containment FROM (SELECT p.a, p.b, count(*) AS k FROM all_pairs p JOIN shingles s ON s.doc_id = p.a JOIN shingles t ON t.doc_id = p.b AND t.h = s.h GROUP BY p.a, p.b)
  JOIN set_sizes x ON x.doc_id = a JOIN set_sizes y ON y.doc_id = b WHERE round(k / least(x.n, y.n), 6) >= 0.6"""
_clusters = """WITH RECURSIVE g AS (SELECT a, b FROM contained UNION SELECT b, a FROM contained), r AS (SELECT a, a AS b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
  k AS (SELECT a AS doc_id, min(b) AS cluster FROM r GROUP BY a) """
_bucket = lambda kind: f"SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS bucket, count(*) OVER (PARTITION BY key) AS n FROM bucketed WHERE key LIKE '{kind}:%'"
CTES["smoke_hits"] = f"""SELECT doc_id, source, t, length(h) AS n, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, source, t, unnest(h) AS h, unnest(g[1 : len(h)]) AS g, generate_subscripts(h, 1) AS i FROM (
  SELECT doc_id, source, abstract AS t, regexp_extract_all(abstract, {literal(SMOKE)}) AS h, regexp_split_to_array(abstract, {literal(SMOKE)}) AS g FROM corpus))"""
CTES["smoke_windows"] = "SELECT source, substr(t, greatest(b - n - 90, 0)::BIGINT + 1, (b + 90 - greatest(b - n - 90, 0))::BIGINT) AS w FROM smoke_hits"
_apart = "coalesce(abstract, '')"
for _pattern, _parts in GLUED:
    _apart = f"regexp_replace({_apart}, {literal(_pattern)}, {literal(_parts.replace('$', chr(92)))}, 'g')"
for _junk in JUNK_SUBSTRINGS:
    _apart = f"regexp_replace({_apart}, {literal('(?i)' + re.escape(_junk))}, ' ', 'g')"
_one_space = f"trim(regexp_replace({_apart}, '\\s+', ' ', 'g'))"
SQL = {k: sql(v) for k, v in {
    "smoking_status_mine": "SELECT pattern, count(*) AS mentions, count(DISTINCT source) AS individuals, array_to_string(list_sort(list_distinct(list(substr(trim(regexp_replace(w, '\\s+', ' ', 'g')), 1, 160))))[1:3], ' | ') AS examples FROM ("
    + " UNION ALL ".join(f"SELECT {literal(n)} AS pattern, * FROM smoke_windows WHERE regexp_matches(w, {literal(p)})" for n, p in SMOKING.items()) + ") GROUP BY pattern",
    "keyword_tags": "SELECT doc_id, " + ", ".join(f"{_any('t', w)} AS {n}" for n, w in tagging.TAGS.items()) + " FROM (SELECT doc_id, lower(abstract) AS t FROM corpus)",
    "stat_extract": f"""SELECT doc_id, {_hits}, nullif(array_to_string(list_transform(range(1, least(5, len(lo)) + 1), lambda i: lo[i] || '|' || hi[i]), '; '), '') AS stat_confidence_interval
      FROM (SELECT *, regexp_extract_all(abstract, {literal(tagging.INTERVAL)}, 1) AS lo, regexp_extract_all(abstract, {literal(tagging.INTERVAL)}, 2) AS hi FROM corpus)""",
    "study_type_classify": f"SELECT doc_id, {_first('t', tagging.STUDY_TYPES, 'other')} AS study_type FROM (SELECT doc_id, lower(abstract) AS t FROM corpus)",
    "country_mentions": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(abstract, {literal(rf'\b(?:{p})\b')}) THEN {literal(c)} END" for c, p in tagging.COUNTRIES.items()) + ") AS countries FROM corpus",
    "ages_mentioned": "SELECT doc_id, array_to_string(a, ',') AS ages, list_max(a) AS max_age, len(a) > 0 AS has_age FROM aged",
    "subject_extract": f"""WITH c AS (SELECT doc_id, headline, headline || ' ' || substr(story, 1, 800) AS c FROM profiles),
      n AS (SELECT *, CASE WHEN {_fit(_before, 2)} THEN regexp_extract(c, {literal(_before)}, 1) WHEN {_fit(_after, 1)} THEN regexp_extract(c, {literal(_after)}, 2) END AS subject_name FROM c)
      SELECT doc_id, subject_name, coalesce(nullif(regexp_extract(headline, {_century}, 1), ''), nullif(regexp_extract(substr(c, greatest(1, instr(c, subject_name) - 50), instr(c, subject_name) + 100 - greatest(1, instr(c, subject_name) - 50)), {_century}, 1), ''))::INTEGER AS subject_age,
      nullif(regexp_extract(c, {literal(_place)}, 1), '') AS subject_city, nullif(regexp_extract(c, {literal(_place)}, 2), '') AS subject_country FROM n""",
    "profile_flag": "SELECT doc_id, " + _any("lower(story)", tagging.PROFILE) + " AS is_profile FROM profiles",
    "relevance_filter": "SELECT doc_id, url FROM corpus WHERE len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) >= 80 AND " + _any("lower(text)", ["the", "die", "les"]) + " AND NOT regexp_matches(url, '/(?:tag|category|video|login|subscribe)/')",
    "clean_boilerplate": f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace({_one_space}, '([.!?])\\s+([A-Z"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)),
      lambda s: length(s) >= 12 AND NOT regexp_matches(s, {literal("(?i)(?:" + "|".join(BOILERPLATE) + ")")})), ' '), '') AS clean FROM corpus""",
    "source_country": f"""SELECT source_name, CASE {" ".join(f"WHEN contains(lower(source_name), {literal(d)}) THEN {literal(c)}" for d, c in SOURCE_COUNTRIES.items())} ELSE 'Unknown' END AS country,
      CASE upper(trim(code)) {" ".join(f"WHEN {literal(d)} THEN {literal(c)}" for d, c in CODE_COUNTRIES.items())} ELSE coalesce(code, 'Unknown') END AS of_code, count(*) AS n
      FROM (SELECT ([{", ".join(map(literal, SOURCES))}])[doc_id % {len(SOURCES)} + 1] AS source_name, ([{", ".join(map(literal, CODES))}])[doc_id // 7 % {len(CODES)} + 1] AS code FROM documents) GROUP BY ALL""",
    "domain_country": "SELECT CASE " + " ".join(f"WHEN contains(lower(url), '{d}') THEN '{c}'" for d, c in DOMAIN_COUNTRIES.items()) + " WHEN contains(lower(url), '.com') THEN 'USA' ELSE 'Unknown' END AS country, count(*) AS n, min(doc_id) AS first FROM corpus GROUP BY 1",
    "doc_weight": f"""SELECT doc_id, {rnd('''CASE kind WHEN 'academic' THEN least(20.0, base * size * CASE WHEN doc_id % 2 = 0 THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN (doc_id % 10) / 100.0::DOUBLE < 0.05 THEN 1.2::DOUBLE ELSE 1.0 END)
      WHEN 'news' THEN CASE WHEN doc_id % 4 = 0 THEN 2.0::DOUBLE ELSE 0.5 END * CASE WHEN age IS NULL THEN 1.0 ELSE greatest(1.0, 1 + least(1.0, (age - 100) / 15)) END ELSE 1.0 END''', 6)} AS weight
      FROM (SELECT doc_id, (['academic', 'news', 'other'])[doc_id % 3 + 1] AS kind, (ARRAY[5.0, 3.0, 1.5, 1.0]::DOUBLE[])[doc_id % 4 + 1] AS base, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE least(3.0, greatest(0.5, ln(greatest(2, doc_id % 2000)) / ln(1000))) END AS size,
      CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (85 + doc_id % 40)::DOUBLE END AS age FROM corpus)""",
    "subject_class": """SELECT doc_id, CASE WHEN nona AND NOT cent AND NOT sup THEN 'nonagenarian' WHEN cent THEN 'centenarian' WHEN sup THEN 'supercentenarian' ELSE 'general' END AS subject_class FROM (
      SELECT doc_id, len(list_filter(a, lambda x: x >= 90 AND x < 100)) > 0 OR contains(h, 'nonagenarian') AS nona, len(list_filter(a, lambda x: x >= 100 AND x < 110)) > 0 OR contains(h, 'centenarian') AS cent,
      len(list_filter(a, lambda x: x >= 110)) > 0 OR contains(h, 'supercentenarian') AS sup FROM (SELECT *, lower(substr(title || ' ' || text, 1, 4000)) AS h FROM aged))""",
    "construct_screen": " UNION ALL ".join(f"SELECT {literal(n)} AS construct, count(*) FILTER (WHERE h) AS n_all, count(*) FILTER (WHERE h AND n_chars > 2000) AS n_focus FROM (SELECT n_chars, regexp_matches(told, {literal(p)}) AS h FROM told)" for n, p in CONSTRUCTS.items()),
    "word_shingles": "SELECT doc_id, coalesce(n, 0)::INTEGER AS n_shingles FROM documents LEFT JOIN set_sizes USING (doc_id)",
    "dup_candidates": f"""SELECT p.doc_id, t.bucket AS title_bucket, l.bucket AS lede_bucket, n_candidates FROM (SELECT a AS doc_id, count(*) AS n_candidates FROM (SELECT a, b FROM all_pairs UNION ALL SELECT b, a FROM all_pairs) GROUP BY a) p
      LEFT JOIN (SELECT * FROM ({_bucket('t')}) WHERE n > 1) t ON t.doc_id = p.doc_id LEFT JOIN (SELECT * FROM ({_bucket('l')}) WHERE n > 1) l ON l.doc_id = p.doc_id""",
    "dup_classes": "SELECT doc_id, rep FROM dup_reps",
    "containment_pairs": "SELECT c.* FROM contained c JOIN dup_reps x ON x.doc_id = a AND x.rep = a JOIN dup_reps y ON y.doc_id = b AND y.rep = b",
    "dup_clusters": _clusters + "SELECT *, count(*) OVER (PARTITION BY cluster) AS n_members FROM k",
    "dup_cluster_report": _clusters + "SELECT cluster, count(*) AS n_members, max(doc_id) AS last FROM k GROUP BY cluster",
    "apply_blacklist": _clusters + "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE doc_id <> cluster)",
}.items()}
