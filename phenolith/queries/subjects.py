"""Queries of the ingest, subject and phrase part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import phrases, subjects, tagging
from ..plans import fixtures
from ..plans.lexicon import ATTRIBUTION, CODEBOOK, FUNCTION_WORDS, JUNK_WORDS, NICKNAMES, NO_NAMES, RUN_TOGETHER, SUFFIXES
from ..sources import ingest
from ..sources.staging import spread
from .sqltext import CTES, literal, rnd, sql
from .text import corpus


def read_table_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = c.select(
        k.cast("string").alias("id"), F.when(k % 7 == 0, "5.397605346934028e-79").when(k % 11 == 0, ".").when(k % 13 == 0, "nan").otherwise(F.col("c_acctbal").cast("double").cast("string")).alias("balance"),
        F.element_at(F.array(*map(F.lit, ("True", "1.0", "0", "false"))), (k % 4 + 1).cast("int")).alias("flag"), F.when(k % 5 == 0, "no date").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("day"),
    )
    return ingest.coerced(raw, numbers=["balance"], integers=["id"], flags=["flag"], dates=["day"])


def read_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    months = F.concat(F.lpad((k % 400).cast("string"), 3, "0"), F.when(k % 6 == 0, "  .").otherwise(F.lpad((k % 230).cast("string"), 3, "0")))
    line = F.concat(F.lpad(k.cast("string"), 6, " "), F.lit(" " * 8), (k % 3 + 1).cast("string"), F.when(k % 9 == 0, ".").otherwise((k % 2).cast("string")), F.lpad((k % 11).cast("string"), 3, "0"), (k % 2).cast("string"), F.lit("."), F.lit("   "), months)
    return ingest.fixed_width(fixtures.table(spark, sf_dir, "customer").select(line.alias("value")))


def read_whitespace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life tables of ten columns, a file for each country and sex; every other has its columns in another order."""
    lt = fixtures.life_tables(spark, sf_dir)
    n = lambda x: F.when(F.col("age") == 61, ".").otherwise(x.cast("string"))
    mx, deaths = (F.col("age") - 59) / 1000.0, (F.col("lx") / 10).cast("int")
    first = [F.col("year").cast("string"), F.when(F.col("age") == 110, "110+").otherwise(F.col("age").cast("string"))]
    usual = [*first, n(mx), n(mx), F.lit("0.5"), F.col("lx").cast("string"), n(deaths), n(deaths), F.lit("1e5"), n(F.col("ex"))]
    other = [*first, n(F.col("ex")), F.col("lx").cast("string"), n(mx), n(deaths)]
    odd = F.col("country_code") % 2 == 1
    line = F.struct("year", "age", F.when(odd, F.concat_ws("  ", *other)).otherwise(F.concat(F.lit("  "), F.concat_ws("   ", *usual))).alias("x"))
    lines = lt.groupBy("country_code", "sex").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["x"]), "\n").alias("body"))
    head = F.when(odd, "Year Age ex lx qx dx").otherwise("  Year   Age   mx   qx   ax   lx   dx   Lx   Tx   ex")
    return ingest.whitespace_tables(lines.select("country_code", "sex", F.concat(F.lit("A country, life tables\n\n"), head, F.lit("\n"), "body", F.lit("\n\nend of file")).alias("content")), ["country_code", "sex"])


def two_corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(spark, sf_dir)
    papers = c.where("doc_id % 2 = 0").select("title", F.col("text").alias("abstract"), F.lit("cohort").alias("study_type"), "doc_id")
    return papers, c.where("doc_id % 2 = 1").select("title", F.col("text").alias("body"), "url", "doc_id")


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, news = two_corpora(spark, sf_dir)
    out = ingest.corpus_union(papers.withColumnRenamed("abstract", "text"), news.withColumnRenamed("body", "text"), "doc_id")
    return out.select("record_id", "source_type", "title", "url", "study_type", F.length("text").alias("n"), "doc_id")


def registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = fixtures.table(spark, sf_dir, "customer")
    month = F.element_at(F.array(*map(F.lit, ("January", "May", "December"))), (k % 3 + 1).cast("int"))
    wiki = c.where("c_custkey % 3 <> 0").select(F.concat((k % 400).cast("string"), F.lit(" Name[a]")).alias("name"), F.concat((k % 28 + 1).cast("string"), F.lit(" "), month, F.lit(" 1900[9]")).alias("birth"), F.concat((110 + k % 10).cast("string"), F.lit(" years, "), (k % 365).cast("string"), F.lit(" days[b]")).alias("age"), F.when(k % 2 == 0, "Woman").otherwise("m").alias("gender"), k.cast("long").alias("ord"))
    other = c.where("c_custkey % 3 = 0").select(F.concat((k % 400).cast("string"), F.lit(" Name")).alias("name"), F.concat(F.lit("1900-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("birth"), (100 + k % 12).cast("string").alias("age"), F.lit("x").alias("gender"), k.cast("long").alias("ord"))
    return wiki, other


def registry_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.registry_merge(*registries(spark, sf_dir)).select("name", "birth_date", rounded(F.col("age_years"), 4).alias("age_years"), "gender", "dataset_source")


#: Buckets of the tables that are joined as a star; a cluster takes as many as its tasks can hold.
STAR_BUCKETS = 16


def star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and what their orders say, in tables of the same buckets."""
    people = ingest.bucketed(fixtures.subjects(spark, sf_dir), "subject_id", STAR_BUCKETS)
    o = fixtures.table(spark, sf_dir, "orders").withColumn("subject_id", F.col("o_custkey").cast("long"))
    a = o.groupBy("subject_id").agg(F.count("*").alias("ORD01"), F.lit(1).alias("age"))
    b = o.where("o_orderstatus = 'F'").groupBy("subject_id").agg(F.max("o_orderkey").alias("ORD02"), F.lit("x").alias("file"))
    files = [ingest.bucketed(f, "subject_id", STAR_BUCKETS) for f in (a, b)]
    return ingest.star_join(people, files, "subject_id", drop=["file"], names={"ORD01": "n_orders", "ORD02": "last_filled"}).select("subject_id", "age", "n_orders", "last_filled")


def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coverage(star_left_join(spark, sf_dir))


TRAIT_NAMES = ["Longevity", "Parental lifespan", "Height", "Ageing of skin", "Long-lived kin", "Mortality, all", "Coffee"]


def trait_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    trait = F.concat(F.element_at(F.array(*map(F.lit, TRAIT_NAMES)), (k % len(TRAIT_NAMES) + 1).cast("int")), F.lit(" in "), F.lower("p_type"))
    rows = fixtures.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(k % 11 != 0, trait).alias("trait"))
    return ingest.common_traits(ingest.trait_table(rows))


def indicator_union_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: fixtures.table(spark, sf_dir, n) for n in ("customer", "supplier")}
    frames = {"customers": parts["customer"].select(F.col("c_nationkey").alias("country"), F.col("c_acctbal").cast("double").alias("value")), "suppliers": parts["supplier"].select(F.col("s_nationkey").alias("country"), F.col("s_acctbal").cast("double").alias("value"))}
    return ingest.indicator_union(frames, ["country", "value"])


def flag_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = fixtures.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("int").alias("country_code"), F.lit(True).alias("flag"))
    return ingest.flag_join(fixtures.life_tables(spark, sf_dir), flags, "country_code").groupBy("country_code", "flag").agg(F.count("*").alias("n"))


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events")
    seen = e.where("ts < timestamp '2024-01-15'")
    return ingest.unseen(e, seen, "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def html_to_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.html_to_profile(fixtures.table(spark, sf_dir, "pages")).select("page_id", "n_words", F.md5("profile").alias("digest"))


def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr class='r'>"), cell(k.cast("string")), cell(F.when(k % 10 == 0, "N/A").otherwise(F.concat(F.lit("<b>Name</b> "), (k % 50).cast("string")))), cell(F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/01/1900"))), cell(F.when(k % 3 == 0, "Living").otherwise("01/02/2010")), cell((100 + k % 20).cast("string")), cell(F.lit("3")), cell(F.when(k % 2 == 0, "Female").otherwise("male")), cell(F.lit("Japan")), F.lit("</tr>"))
    pages = fixtures.table(spark, sf_dir, "customer").select(F.floor(k / 5).alias("page_id"), k.alias("k"), row.alias("row"))
    html = pages.groupBy("page_id").agg(F.concat(F.lit("<table><tr><th>Rank</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
    return ingest.html_table_rows(html)


def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a report in each format to the shared folder and gives the rows read back."""
    by = fixtures.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return ingest.round_trip(by)


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("Dr. Bob ", "José ", "Mary-Ann (Sis) ", "The "))), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Smith[9]", "O'Néill Jr", "Müller"))), (k % 3 + 1).cast("int")), F.lit(" "), F.element_at(F.array(*map(F.lit, ("", "III", "x"))), (k % 3 + 1).cast("int")))
    return fixtures.table(spark, sf_dir, "customer").select(k.alias("id"), subjects.clean_name(raw).alias("clean"), F.array_join(subjects.name_tokens(subjects.clean_name(raw)), " ").alias("tokens"), subjects.is_personlike(subjects.clean_name(raw)).alias("personlike"), subjects.slug(raw).alias("slug"))


def people_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer "), F.translate((k % 90).cast("string"), "0123456789", "abcdefghij"), F.lit(" Last")).alias("name"), F.when(k % 4 == 0, None).otherwise(90 + k % 30).cast("double").alias("age"), k.cast("long").alias("ord"))
    b = fixtures.table(spark, sf_dir, "supplier").select(F.concat(F.lit("CUSTOMER "), F.translate((s % 120).cast("string"), "0123456789", "abcdefghij"), F.lit(" Last")).alias("name"), (100 + s % 20).cast("double").alias("age"), (1_000_000 + s).cast("long").alias("ord"))
    return subjects.registry_master([a, b])


def registry_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people_master(spark, sf_dir)


def subject_age_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    c = corpus(spark, sf_dir).withColumn("ages", tagging.ages(F.col("abstract")))
    age = subjects.subject_age(F.when(k % 3 == 0, 60 + k % 60), F.when(k % 4 == 0, 70 + k % 60), F.col("ages"))
    return c.select("doc_id", age.alias("age"), subjects.age_tier(age).alias("tier"))


def trait_mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w.isin("the", "and", "of", "die", "und", "les", "las", "that")))).alias("trait")
    k = F.col("doc_id")
    age = F.when(k % 5 == 0, None).otherwise(90 + k % 25)
    rows = corpus(spark, sf_dir).select(F.concat(F.lit("p"), (k % 301).cast("string")).alias("person"), subjects.age_tier(age).alias("tier"), words, F.substring("title", 1, 40).alias("quote"), F.when(k % 9 == 0, "boolean").otherwise("keyword").alias("method"), (k % 2 == 0).alias("is_profile"))
    return rows.withColumn("tier", F.when(F.substring("person", 2, 9).cast("int") % 4 == 0, None).when(F.substring("person", 2, 9).cast("int") % 3 == 0, "supercentenarian").otherwise("centenarian"))


def trait_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.trait_frequency(trait_mention_rows(spark, sf_dir))


def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.top_subjects(trait_mention_rows(spark, sf_dir))


def profile_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.profile_delta(trait_mention_rows(spark, sf_dir).withColumnRenamed("trait", "category"))


def fuzzy_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = people_master(spark, sf_dir)
    k = F.col("s_suppkey")
    plain = F.concat(F.element_at(F.array(*map(F.lit, ("customer ", "c ", "customer mid "))), (k % 3 + 1).cast("int")), F.translate((k % 60).cast("string"), "0123456789", "abcdefghij"), F.lit(" last"))
    at = (k % 17 + 1).cast("int")  # a wrong letter at every place in turn, the last word included
    wrong = F.concat(plain.substr(F.lit(1), at - 1), F.lit("q"), plain.substr(at + 1, F.lit(99)))
    q = fixtures.table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), F.when(k % 2 == 0, wrong).otherwise(plain).alias("clean"))
    return subjects.fuzzy_name_join(q, m)


#: Sentences with a reason given for a long life, %d standing for a number.
REASONS = [
    " Her secret to longevity is walking %d miles daily. She attributes her long life to olive oil and rest.",
    " He credits %d friends for his longevity. They owe their long life to garden soup.",
    " She says her secret is tea with %d spoons of honey. He believes his longevity is due to never smoking.",
    " The key to her long life was a nap of %d minutes. She lived to 104 by eating fish.",
    " He puts his long life down to %d prayers. She attributed her longevity to plain luck.",
]


def story() -> Column:
    """A document's text with what one of REASONS says."""
    each = F.array(*(F.concat(F.lit(r.split("%d")[0]), (F.col("doc_id") % 9).cast("string"), F.lit(r.split("%d")[1])) for r in REASONS))
    return F.concat(F.col("text"), F.element_at(each, (F.col("doc_id") % len(REASONS) + 1).cast("int")))


def phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fixtures.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = spread(fixtures.table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("focus"), F.least(F.col("n_chars") / 1000.0, F.lit(20.0)).alias("weight"), F.col("lang").alias("country"), F.col("source").alias("individual"), phrases.candidate_phrases(F.col("text")).alias("noun_phrase"), phrases.attribution_phrases(story()).alias("attribution"))


def candidate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_rows(spark, sf_dir).select("doc_id", F.size("noun_phrase").alias("n_phrases"))


def lifted(spark: SparkSession, sf_dir: str, floors: dict[str, tuple[int, float]]) -> DataFrame:
    docs = spread(fixtures.table(spark, sf_dir, "documents"))
    labels = fixtures.table(spark, sf_dir, "labels").select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("focus"))
    rows = docs.select("doc_id", F.least(F.col("n_chars") / 1000.0, F.lit(20.0)).alias("weight"), F.col("lang").alias("country"), F.col("source").alias("individual"), F.col("text").alias("noun_phrase"), phrases.attribution_phrases(story()).alias("attribution"))
    return phrases.phrase_lift(rows, floors, ["noun_phrase"], labels)


def phrase_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifted(spark, sf_dir, {"noun_phrase": (5, 1.1), "attribution": (3, 1.0)})


def phrase_topk_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lift = lifted(spark, sf_dir, {"noun_phrase": (3, 1.0), "attribution": (3, 1.0)})
    return phrases.topk_registry(lift, 20).select("feature_type", "rank", "phrase")


#: Concepts of the invented prose, after those of the codebook.
CONCEPTS = {"connectives": (1, "prose", ["and", "und"]), "articles": (2, "prose", ["the", "les"]), "endings": (3, "prose", ["ing"])}


def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lift = lifted(spark, sf_dir, {"noun_phrase": (3, 1.0), "attribution": (3, 1.0)}).select("phrase")
    return phrases.concept_match(lift, CODEBOOK | CONCEPTS)


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = phrases.topk_registry(lifted(spark, sf_dir, {"noun_phrase": (3, 1.0), "attribution": (3, 1.0)}), 20)
    docs = spread(fixtures.table(spark, sf_dir, "documents"))  # finding phrases again costs less than writing all of them
    vectors, _ = phrases.feature_vectors(docs.select("doc_id", "text", phrases.attribution_phrases(story()).alias("phrases")), registry, text="text")
    return vectors.select("doc_id", F.array_join("columns", ",").alias("columns"), F.size("columns").alias("n_features"), "cross_cultural")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.feature_matrix(spread(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")), ["the", "and", "les", "und", "que"])


def attribution_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.array_join(phrases.attribution_phrases(story()), "|").alias("phrases"))


QUERIES = {
    f.__name__: f
    for f in (
        read_table_coerced, read_fixed_width, read_whitespace_table, corpus_union, registry_merge_dedup, star_left_join, join_coverage, trait_table_filter, indicator_union_select, flag_map_join,
        incremental_append, html_to_profile, html_table_rows, sink_table, name_normalize, registry_master, subject_age_tier, trait_frequency, top_subjects, profile_delta, fuzzy_name_join,
        candidate_phrases, phrase_lift, phrase_topk_registry, concept_match, feature_matrix, feature_vectors, attribution_phrases,
    )
}
CTES["lift_rows"] = """SELECT d.doc_id, coalesce(quality = 1, FALSE) AS focus, least(n_chars / 1000.0::DOUBLE, 20.0) AS weight, lang AS country, source AS individual, text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
CTES["tokens"] = "SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)"
_these = lambda words: "(" + ", ".join(map(literal, words)) + ")"
CTES["good"] = f"SELECT *, length(t) > 2 AND length(t) <= 18 AND t NOT IN {_these(FUNCTION_WORDS)} AND NOT regexp_matches(t, {literal('|'.join(RUN_TOGETHER))}) AS ok FROM tokens"
_gram = lambda n: "CASE WHEN ok" + "".join(f" AND lead(ok, {k}) OVER k" for k in range(1, n)) + " THEN t" + "".join(f" || ' ' || lead(t, {k}) OVER k" for k in range(1, n)) + " END"
CTES["grams"] = "SELECT DISTINCT doc_id, phrase FROM (" + " UNION ALL ".join(f"SELECT doc_id, {_gram(n)} AS phrase FROM good WINDOW k AS (PARTITION BY doc_id ORDER BY i)" for n in range(2, 6)) + f") WHERE phrase IS NOT NULL AND len(list_filter(string_split(phrase, ' '), lambda w: w NOT IN {_these(JUNK_WORDS)})) > 0"
_told = ", ".join(literal(r) for r in REASONS)
CTES["stories"] = f"SELECT doc_id, text || replace(([{_told}])[doc_id % {len(REASONS)} + 1], '%d', (doc_id % 9)::VARCHAR) AS story FROM documents"
_reasons = "list_concat(" * (len(ATTRIBUTION) - 1) + f"regexp_extract_all(story, {literal(ATTRIBUTION[0])}, 1)" + "".join(f", regexp_extract_all(story, {literal(p)}, 1))" for p in ATTRIBUTION[1:])
CTES["reasons"] = f"SELECT doc_id, phrase, i FROM (SELECT doc_id, unnest(x) AS phrase, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform({_reasons}, lambda p: trim(p)) AS x FROM stories)) WHERE length(phrase) BETWEEN 4 AND 80 AND NOT regexp_matches(phrase, {literal(phrases.ADS)})"
CTES["typed"] = "SELECT 'noun_phrase' AS feature_type, doc_id, phrase FROM grams UNION ALL SELECT DISTINCT 'attribution', doc_id, phrase FROM reasons"
CTES["lifted"] = """SELECT *, round(l + 1e-9, 3) AS lift, round(l * ln(n_individuals + 1) + 1e-9, 4) AS population_score FROM (SELECT *, (freq_focus / greatest(nf, 1)) / (freq_all / greatest(na, 1)) AS l FROM
  (SELECT feature_type, phrase, count(*) FILTER (WHERE focus) AS freq_focus, count(*) AS freq_all, round(sum(weight) + 1e-9, 2) AS weighted, count(DISTINCT CASE WHEN focus THEN country END) AS n_countries, count(DISTINCT individual) AS n_individuals FROM typed JOIN lift_rows USING (doc_id) GROUP BY ALL),
  (SELECT count(*) FILTER (WHERE focus) AS nf, count(*) AS na FROM lift_rows))"""
_tier = "CASE WHEN {0} >= 110 THEN 'supercentenarian' WHEN {0} >= 100 THEN 'centenarian' WHEN {0} >= 90 THEN 'nonagenarian' END"
CTES["trait_mentions"] = """SELECT 'p' || (doc_id % 301)::VARCHAR AS person, CASE WHEN doc_id % 301 % 4 = 0 THEN NULL WHEN doc_id % 301 % 3 = 0 THEN 'supercentenarian' ELSE 'centenarian' END AS tier, trait, substr(title, 1, 40) AS quote,
  CASE WHEN doc_id % 9 = 0 THEN 'boolean' ELSE 'keyword' END AS method, doc_id % 2 = 0 AS is_profile FROM (SELECT doc_id, title, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('the', 'and', 'of', 'die', 'und', 'les', 'las', 'that')))) AS trait FROM corpus)"""
CTES["people"] = """WITH p AS (SELECT 'Customer ' || translate((c_custkey % 90)::VARCHAR, '0123456789', 'abcdefghij') || ' Last' AS name, CASE WHEN c_custkey % 4 <> 0 THEN 90 + c_custkey % 30 END::DOUBLE AS age, c_custkey::BIGINT AS ord FROM customer
      UNION ALL SELECT 'CUSTOMER ' || translate((s_suppkey % 120)::VARCHAR, '0123456789', 'abcdefghij') || ' Last', (100 + s_suppkey % 20)::DOUBLE, (1000000 + s_suppkey)::BIGINT FROM supplier)
      SELECT replace(lower(name), ' ii ', ' ') AS clean, arg_min(name, ord) AS display, arg_min(age, ord) FILTER (WHERE age IS NOT NULL) AS age, min(ord) AS ord FROM p GROUP BY 1"""
_full = lambda words: f"list_transform(list_filter(string_split({words}, ' '), lambda w: w <> ''), lambda w: CASE w " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in NICKNAMES.items()) + " ELSE w END)"
_within = lambda words: "(" + ", ".join(map(literal, sorted(words))) + ")"
CTES["raw_names"] = f"""SELECT id, translate(lower(raw), {literal(subjects.ACCENTED)}, {literal(subjects.PLAIN)}) AS plain FROM (SELECT c_custkey AS id, (['Dr. Bob ', 'José ', 'Mary-Ann (Sis) ', 'The '])[c_custkey % 4 + 1] || (['Smith[9]', 'O''Néill Jr', 'Müller'])[c_custkey % 3 + 1] || ' ' || (['', 'III', 'x'])[c_custkey % 3 + 1] AS raw FROM customer)"""
CTES["clean_names"] = rf"""SELECT id, regexp_replace(regexp_replace(plain, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(plain, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[^a-z]+', ' ', 'g')), ' +'),
  lambda w: w <> '' AND w NOT IN {_within(SUFFIXES)}), ' ') AS clean FROM raw_names"""
CTES["asked_names"] = f"SELECT id, clean, {_full('clean')} AS t FROM (SELECT id, CASE WHEN id % 2 = 0 THEN substr(plain, 1, place - 1) || 'q' || substr(plain, place + 1) ELSE plain END AS clean FROM (SELECT s_suppkey::BIGINT AS id, (s_suppkey % 17 + 1)::INTEGER AS place, (['customer ', 'c ', 'customer mid '])[s_suppkey % 3 + 1] || translate((s_suppkey % 60)::VARCHAR, '0123456789', 'abcdefghij') || ' last' AS plain FROM supplier))"
CTES["known_names"] = f"SELECT clean AS match, ord, {_full('clean')} AS u FROM people"
_inside = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0"
_joined = "array_to_string(t, ' ')", "array_to_string(u, ' ')"
CTES["paragraphs"] = r"""SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS p FROM pages"""
CTES["page_profiles"] = r"""SELECT page_id, coalesce(array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' '), '') AS profile FROM (SELECT page_id, list_filter(p, lambda t: length(t) >= 40 AND NOT starts_with(lower(t), '(source') AND NOT starts_with(lower(t), 'source:')
  AND NOT (length(t) < 90 AND (regexp_matches(lower(t), '^in \d{4},? aged') OR contains(lower(t), '(source:')))) AS k FROM paragraphs)"""
_starred = "SELECT subject_id, age, n_orders, last_filled FROM subjects LEFT JOIN (SELECT o_custkey AS subject_id, count(*) AS n_orders FROM orders GROUP BY 1) USING (subject_id) LEFT JOIN (SELECT o_custkey AS subject_id, max(o_orderkey) AS last_filled FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (subject_id)"
CTES["starred"] = _starred
SQL = {k: sql(v) for k, v in {
    "read_table_coerced": """SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 7 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE c_acctbal::DOUBLE END AS balance, c_custkey % 4 < 2 AS flag,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ('2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0'))::DATE END AS day FROM customer""",
    "read_fixed_width": """SELECT c_custkey::BIGINT AS seqn, (c_custkey % 3 + 1)::INTEGER AS eligstat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 2 END::INTEGER AS mortstat, (c_custkey % 11)::INTEGER AS ucod_leading, (c_custkey % 2)::INTEGER AS diabetes, NULL::INTEGER AS hyperten,
      (c_custkey % 400)::INTEGER AS permth_int, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 230 END::INTEGER AS permth_exm FROM customer""",
    "read_whitespace_table": """SELECT country_code, sex, year::INTEGER AS year, age::INTEGER AS age, CASE WHEN country_code % 2 = 0 AND age <> 61 THEN (age - 59) / 1000.0::DOUBLE END AS mx, CASE WHEN age <> 61 THEN (age - 59) / 1000.0::DOUBLE END AS qx, CASE WHEN country_code % 2 = 0 THEN 0.5::DOUBLE END AS ax, lx,
      CASE WHEN age <> 61 THEN floor(lx / 10) END AS dx, CASE WHEN country_code % 2 = 0 AND age <> 61 THEN floor(lx / 10) END AS years_lived, CASE WHEN country_code % 2 = 0 THEN 1e5::DOUBLE END AS years_left, CASE WHEN age <> 61 THEN ex END AS ex FROM life""",
    "corpus_union": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'AP_' ELSE 'NA_' END || printf('%05d', doc_id) AS record_id, CASE WHEN doc_id % 2 = 0 THEN 'academic' ELSE 'news' END AS source_type, title, CASE WHEN doc_id % 2 = 1 THEN url END AS url,
      CASE WHEN doc_id % 2 = 0 THEN 'cohort' END AS study_type, length(text)::INTEGER AS n, doc_id FROM corpus""",
    "registry_merge_dedup": """WITH a AS (SELECT (c_custkey % 400)::VARCHAR || ' Name' AS name, make_date(1900, ([1, 5, 12])[c_custkey % 3 + 1], (c_custkey % 28 + 1)::INTEGER) AS birth_date, round(110 + c_custkey % 10 + (c_custkey % 365) / 365.25, 4)::DOUBLE AS age_years, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 'wiki' AS dataset_source, 0 AS s, c_custkey AS ord FROM customer WHERE c_custkey % 3 <> 0
      UNION ALL SELECT (c_custkey % 400)::VARCHAR || ' Name', make_date(1900, 1, (c_custkey % 28 + 1)::INTEGER), (100 + c_custkey % 12)::DOUBLE, NULL, 'other', 1, c_custkey FROM customer WHERE c_custkey % 3 = 0)
      SELECT name, birth_date, age_years, gender, dataset_source FROM (SELECT *, row_number() OVER (PARTITION BY name, birth_date ORDER BY s, ord) AS rn FROM a) WHERE rn = 1""",
    "star_left_join": "SELECT * FROM starred",
    "join_coverage": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100 * count({c}) / count(*), 4) AS filled_pct FROM starred" for c in ("subject_id", "age", "n_orders", "last_filled")),
    "html_to_profile": r"SELECT page_id, n_words, md5(profile) AS digest FROM (SELECT *, len(list_filter(regexp_split_to_array(profile, '\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM page_profiles) WHERE n_words >= 20",
    "name_normalize": f"""SELECT id, clean, array_to_string({_full('clean')}, ' ') AS tokens, len(string_split(clean, ' ')) BETWEEN 2 AND 4 AND len(list_filter(string_split(clean, ' '), lambda w: length(w) < 2 OR w IN {_within(NO_NAMES)})) = 0 AS personlike, slug FROM clean_names""",
    "fuzzy_name_join": f"""SELECT id, clean, arg_min(match, ord) AS match FROM asked_names JOIN known_names ON clean = match OR {_inside('t', 'u')} OR {_inside('u', 't')} OR (t[-1] = u[-1] AND t[1][1] = u[1][1])
      OR 1 - levenshtein({_joined[0]}, {_joined[1]}) / greatest(length({_joined[0]}), length({_joined[1]})) >= 0.9 GROUP BY id, clean""",
    "trait_table_filter": f"SELECT trait, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 <> 0 THEN ([{', '.join(map(literal, TRAIT_NAMES))}])[p_partkey % {len(TRAIT_NAMES)} + 1] || ' in ' || lower(p_type) END AS trait FROM part) WHERE regexp_matches(trait, {literal(ingest.LONG_LIFE_TRAITS)}) GROUP BY 1 ORDER BY n DESC, trait LIMIT 15",
    "indicator_union_select": "SELECT 'customers' AS indicator, c_nationkey AS country, c_acctbal::DOUBLE AS value FROM customer UNION ALL SELECT 'suppliers', s_nationkey, s_acctbal::DOUBLE FROM supplier",
    "flag_map_join": "SELECT country_code, country_code % 4 = 0 AS flag, count(*) AS n FROM life GROUP BY 1, 2",
    "incremental_append": "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    "sink_table": "SELECT o_orderstatus, count(*) AS n, format FROM orders, (SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS format) GROUP BY o_orderstatus, format",
    "html_table_rows": """SELECT name, birth_date, rank::INTEGER AS rank, death_date, age_years::INTEGER AS age_years, gender, 'Japan' AS country FROM (SELECT 'Name ' || (c_custkey % 50)::VARCHAR AS name, '1900-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS birth_date, c_custkey AS rank,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2010-02-01' END AS death_date, 100 + c_custkey % 20 AS age_years, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, row_number() OVER (PARTITION BY c_custkey % 50, c_custkey % 28 ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey % 10 <> 0) WHERE rn = 1""",
    "subject_age_tier": f"""SELECT doc_id, age, {_tier.format('age')} AS tier FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 AND 60 + doc_id % 60 >= 90 THEN 60 + doc_id % 60 END, CASE WHEN doc_id % 4 = 0 AND 70 + doc_id % 60 >= 90 THEN 70 + doc_id % 60 END,
      list_max(list_filter(a, lambda x: x BETWEEN 90 AND 130)))::DOUBLE AS age FROM aged)""",
    "trait_frequency": """WITH t AS (SELECT trait, count(DISTINCT person) AS individuals, count(DISTINCT person) FILTER (WHERE tier = 'supercentenarian') AS n_supercentenarian, count(DISTINCT person) FILTER (WHERE tier = 'centenarian') AS n_centenarian, count(DISTINCT person) FILTER (WHERE tier = 'nonagenarian') AS n_nonagenarian,
      count(*) AS mentions, first(quote ORDER BY length(quote) DESC, quote DESC) AS sample_quote, CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'mixed' END AS method FROM trait_mentions GROUP BY trait),
      u AS (SELECT *, n_supercentenarian + n_centenarian + n_nonagenarian AS total, greatest(n_supercentenarian, n_centenarian, n_nonagenarian) AS top FROM t WHERE individuals >= 3)
      SELECT * EXCLUDE (total, top), n_supercentenarian + n_centenarian AS core, CASE WHEN total = 0 THEN 'untiered' WHEN n_supercentenarian = top THEN 'supercentenarian' WHEN n_centenarian = top THEN 'centenarian' ELSE 'nonagenarian' END AS primary_tier,
      CASE WHEN total = 0 THEN 'untiered' WHEN (n_supercentenarian > 0)::INTEGER + (n_centenarian > 0)::INTEGER + (n_nonagenarian > 0)::INTEGER = 1 THEN 'single_tier' WHEN top / total >= 0.6 THEN 'concentrated' ELSE 'spread' END AS concentration FROM u""",
    "top_subjects": "SELECT person, count(*) AS mentions, count(DISTINCT trait) AS traits FROM trait_mentions GROUP BY person ORDER BY mentions DESC, person LIMIT 10",
    "profile_delta": """WITH k AS (SELECT person, trait AS category, max(is_profile::INTEGER) AS p, max((NOT is_profile)::INTEGER) AS o FROM trait_mentions GROUP BY 1, 2)
      SELECT category, sum((p = 1 AND o = 0)::INTEGER)::BIGINT AS gained, count(*) AS people FROM k WHERE person IN (SELECT person FROM k GROUP BY person HAVING max(p) = 1 AND max(o) = 1) GROUP BY category""",
    "candidate_phrases": "SELECT doc_id, coalesce(n, 0)::INTEGER AS n_phrases FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1) USING (doc_id)",
    "phrase_lift": "SELECT feature_type, phrase, freq_focus, freq_all, weighted, lift, n_countries, n_individuals, population_score FROM lifted WHERE CASE feature_type WHEN 'attribution' THEN freq_focus >= 3 AND l >= 1.0 ELSE freq_focus >= 5 AND l >= 1.1 END",
    "phrase_topk_registry": """SELECT * FROM (SELECT feature_type, row_number() OVER (PARTITION BY feature_type ORDER BY round(population_score * sqrt(weighted), 6) DESC, phrase)::INTEGER AS rank, phrase FROM lifted WHERE freq_focus >= 3 AND l >= 1.0) WHERE rank <= 20""",
    "concept_match": "SELECT phrase, arg_min(concept, ord) AS concept, arg_min(tier, ord) AS tier, arg_min(category, ord) AS category FROM (SELECT DISTINCT phrase FROM lifted WHERE freq_focus >= 3 AND l >= 1.0) JOIN (VALUES " + ", ".join(f"({literal(c)}, {literal(k)}, {t}, {literal(g)}, {i})" for i, (c, (t, g, ks)) in enumerate((CODEBOOK | CONCEPTS).items()) for k in ks) + ") v(concept, keyword, tier, category, ord) ON contains(phrase, keyword) GROUP BY phrase",
    "feature_vectors": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY feature_type ORDER BY round(population_score * sqrt(weighted), 6) DESC, phrase) AS rank FROM lifted WHERE freq_focus >= 3 AND l >= 1.0),
      v AS (SELECT phrase, max(n_countries) AS n, row_number() OVER (ORDER BY phrase) - 1 AS c FROM r WHERE rank <= 20 GROUP BY phrase),
      h AS (SELECT doc_id, string_agg(c::VARCHAR, ',' ORDER BY c) AS columns, count(*)::INTEGER AS n, bool_or(v.n >= 2) AS cross_cultural FROM (SELECT DISTINCT doc_id, phrase FROM typed) JOIN v USING (phrase) GROUP BY doc_id)
      SELECT doc_id, coalesce(columns, '') AS columns, coalesce(n, 0) AS n_features, coalesce(cross_cultural, FALSE) AS cross_cultural FROM documents LEFT JOIN h USING (doc_id)""",
    "feature_matrix": "SELECT *, f_the + f_and + f_les + f_und + f_que > 0 AS any_feature FROM (SELECT doc_id, " + ", ".join(f"list_contains(w, '{x}')::INTEGER AS f_{x}" for x in ("the", "and", "les", "und", "que")) + " FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents))",
    "attribution_phrases": "SELECT doc_id, coalesce(p, '') AS phrases FROM documents LEFT JOIN (SELECT doc_id, string_agg(phrase, '|' ORDER BY i) AS p FROM (SELECT doc_id, phrase, min(i) AS i FROM reasons GROUP BY doc_id, phrase) GROUP BY doc_id) USING (doc_id)",
    "registry_master": "SELECT * FROM people",
}.items()}
