"""Mentions in text: names, traits, phrases with their surroundings, effects with their intervals, values with units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lexicon import (
    BIOMEDICAL, COMPARED, CONNECTING, CONTROL_PERCENT, CUES, DESIGN, FARTHEST_NAME, LARGEST_AGE, LEAST_AGE, LONG_LIVES, NOT_IN_NAMES, PERSON_AGES, SURVEY_BY_CATEGORY, SURVEY_BY_NAME, SYNONYMS, TAG_TRAITS, UNITS, WHO_BY_CATEGORY, WHO_BY_NAME,
)
from .dictionary import MOST_KEYWORDS, contained, matching, words_pattern
from .tagging import any_of, holds, mentions, spans_of, told_stretches, windows_around, windows_at


def name_candidates(docs: DataFrame, registry: DataFrame, text: str, gap: int) -> DataFrame:
    """doc_id, t, clean, first, pattern: lower-cased texts with the registry names whose first word they may hold.

    One walk finds the first words of a registry that can be sent to the tasks; words of the texts meet those of a larger one
    in an equi-join. Names of one word are left out.
    """
    parts = F.split("clean", " ")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    names = registry.where((F.size(parts) > 1) & (first != "")).select("clean", first.alias("first"), F.concat(F.lit(r"\b"), first, F.lit(rf"\b.{{0,{gap}}}\b"), last, F.lit(r"\b")).alias("pattern")).distinct()
    low = docs.select("doc_id", F.lower(text).alias("t"))
    given = names.limit(MOST_KEYWORDS + 1).collect()
    if len(given) > MOST_KEYWORDS:
        words = F.array_distinct(F.regexp_extract_all("t", F.lit("([a-z]+)"), 1))
        return low.select("doc_id", F.explode(words).alias("first")).join(names, "first").join(low, "doc_id").select("doc_id", "t", "clean", "first", "pattern")
    table = docs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(given)], "i int, clean string, first string, pattern string")
    return low.select("doc_id", "t", F.explode(contained(F.col("t"), [[r["first"]] for r in given])).alias("i")).join(F.broadcast(table), "i").drop("i")


def name_in_text_join(docs: DataFrame, registry: DataFrame, text: str = "text", gap: int = 15) -> DataFrame:
    """doc_id, match: registry names whose first and last word stand within ``gap`` characters in a text."""
    found = name_candidates(docs, registry, text, gap).where(F.rlike("t", F.col("pattern")))
    return found.select("doc_id", F.col("clean").alias("match")).distinct()


def trait_mentions(articles: DataFrame, windows: DataFrame, traits: dict[str, tuple[str, str]], tags: dict[str, tuple[str, str]] = TAG_TRAITS) -> DataFrame:
    """person, verified, trait, category, source, quote, method: what articles say of the people they are about.

    articles has doc_id, person, verified, tier, is_profile, source and boolean tag columns; windows has doc_id, window and text
    (``mention_windows``). Profiles are taken whatever the tier, other articles only if the person
    is a nonagenarian; rows without a person are left out. A tag's quote is the article's longest window (the first of
    equally long ones), a trait's the first window that its pattern (name: pattern, category) matches. Each
    document gives a trait once by each method.
    """
    gate = F.col("person").isNotNull() & (F.col("is_profile") | F.coalesce(F.col("tier") == "nonagenarian", F.lit(False)))
    kept = articles.where(gate).withColumn("source", F.coalesce("source", F.lit("unknown")))
    head = ["doc_id", "person", "verified", "source"]
    longest = windows.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("window"))).alias("quote"))
    marked = tagged_traits(kept, tags).join(kept.select(*head), "doc_id").join(longest, "doc_id", "left").withColumn("quote", F.coalesce("quote", F.lit("")))
    low = windows.withColumn("__low", F.lower("text"))
    hits = matching(low, "__low", {t: p for t, (p, _) in traits.items()}, "trait")
    category = F.create_map(*(F.lit(x) for t, (_, c) in traits.items() for x in (t, c)))
    first = hits.groupBy("doc_id", "trait").agg(F.min_by("text", "window").alias("quote"))
    told = first.withColumn("category", F.element_at(category, F.col("trait"))).join(kept.select(*head), "doc_id")
    columns = ["person", "verified", "trait", "category", "source", "quote"]
    return marked.select(*columns, F.lit("boolean").alias("method")).unionByName(told.select(*columns, F.lit("keyword").alias("method")))


def tagged_traits(docs: DataFrame, tags: dict[str, tuple[str, str]] = TAG_TRAITS) -> DataFrame:
    """doc_id, trait, category: the traits that boolean columns of docs stand for."""
    each = F.array_compact(F.array(*(F.when(F.col(c), F.struct(F.lit(t).alias("trait"), F.lit(k).alias("category"))) for c, (t, k) in tags.items())))
    return docs.select("doc_id", F.explode(each).alias("t")).select("doc_id", "t.*")


def phrase_context(docs: DataFrame, phrases: list[str], text: str = "text", most: int = 5, words: int = 5) -> DataFrame:
    """phrase, rank, snippet: up to ``most`` stretches of five words around each phrase, with the document's id.

    The texts are walked once for all phrases.
    """

    def found(p: str) -> Column:
        pattern = rf"(?i)((?:\S+\s+){{0,{words}}}\b{p}\b(?:\s+\S+){{0,{words}}})"
        s = F.substring(F.regexp_extract(text, pattern, 1), 1, 220)
        return F.when(F.col("__low").contains(p) & (s != ""), F.struct(F.lit(p).alias("phrase"), s.alias("s")))

    each = docs.withColumn("__low", F.lower(text)).select("doc_id", F.explode(F.array_compact(F.array(*(found(p) for p in phrases)))).alias("f")).select("f.*", "doc_id")
    # ranks within parts first, so that a phrase of very many documents is no single sort
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    first = each.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("phrase", "part").orderBy("doc_id"))).where(F.col("r") <= most)
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("doc_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("phrase", "rank", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("s")).alias("snippet"))


def name_positions(docs: DataFrame, registry: DataFrame, text: str = "text", gap: int = 15) -> DataFrame:
    """doc_id, name, at: where the registry's names (first word, up to ``gap`` characters, last word) stand in a text, from 0.

    A text is walked from shortly before the first place of a name's first word on.
    """
    found = name_candidates(docs, registry, text, gap).withColumn("from", F.greatest(F.instr("t", F.col("first")) - 32, F.lit(1)))
    spans = spans_of(F.substr("t", F.col("from")), F.col("pattern"))
    return found.select("doc_id", F.col("clean").alias("name"), "from", F.explode(spans["a"]).alias("at")).select("doc_id", "name", (F.col("at") + F.col("from") - 1).alias("at")).distinct()


def age_positions(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, kind, at, age: ages of people in context, with the number of the pattern that found each and its place, from 0.

    No pattern's match holds a full stop, so only stretches between those that have two digits are walked.
    """
    near = told_stretches(F.lower(text), lambda x: x.rlike(r"\d\d"))
    each = docs.select("doc_id", F.explode(near).alias("z")).select("doc_id", F.col("z.at").alias("from"), F.col("z.s").alias("s"))

    def of(kind: int, pattern: str) -> Column:
        one = lambda x: F.struct(F.lit(kind).alias("kind"), (F.col("from") + x["a"]).alias("at"), F.regexp_extract(F.substring("s", x["a"] + 1, x["b"] - x["a"]), pattern, 1).cast("int").alias("age"))
        return F.transform(spans_of(F.col("s"), pattern), one)

    ages = F.filter(F.concat(*(of(i, p) for i, p in enumerate(PERSON_AGES))), lambda x: x["age"].between(LEAST_AGE, LARGEST_AGE))
    return each.select("doc_id", F.explode(ages).alias("x")).select("doc_id", "x.*")


def age_person_mentions(docs: DataFrame, persons: DataFrame, text: str = "text", farthest: int = FARTHEST_NAME) -> DataFrame:
    """doc_id, name, age of each document with an age in context: the name and age that stand nearest to each other.

    Both kinds of mention of a document are put in one order of places, in which the last name before and the first
    one after each age are carried to it: no pairs are made. A pair counts below ``farthest`` characters; of equally near
    ones the first kind of age, then the first age, then the first name. If names stand only farther away, the first age without a name;
    if there are none, the largest. persons has doc_id, name, at.
    """
    ages = age_positions(docs, text)
    people = persons.groupBy("doc_id", "at").agg(F.min("name").alias("name"))
    both = ages.select("doc_id", "at", F.lit(1).alias("side"), "kind", "age", F.lit(None).cast("string").alias("name"))
    both = both.unionByName(people.select("doc_id", "at", F.lit(0).alias("side"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("age"), "name"))
    order = Window.partitionBy("doc_id").orderBy("at", "side", "kind")
    person = F.when(F.col("side") == 0, F.struct("at", "name"))
    before = F.last(person, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(person, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = both.withColumns({"b": before, "n": after}).where("side = 1")
    pair = lambda p: F.when(p["at"].isNotNull() & (F.abs(p["at"] - F.col("at")) < farthest), F.struct(F.abs(p["at"] - F.col("at")).alias("far"), "kind", F.col("at").alias("at"), p["at"].alias("p"), p["name"].alias("name"), "age"))
    any_person = F.max(F.col("b").isNotNull() | F.col("n").isNotNull())
    best = near.groupBy("doc_id").agg(
        F.min(F.array_min(F.array_compact(F.array(pair(F.col("b")), pair(F.col("n")))))).alias("best"), F.min_by("age", F.struct("kind", "at")).alias("first"), F.max("age").alias("largest"), any_person.alias("named"),
    )
    return best.select("doc_id", F.col("best.name").alias("name"), F.coalesce("best.age", F.when(F.col("named"), F.col("first")).otherwise(F.col("largest"))).alias("age"))


def direction_annotate(docs: DataFrame, phrases: list[str], text: str = "text", width: int = 80, share: float = 0.4, most: int = 300) -> DataFrame:
    """phrase, windows, direction: how often a direction's cues lead within ``width`` characters of a phrase's first word.

    Each mention votes once, for the direction with most cues in its window, the first of equal ones; without a cue it
    does not. The first ``most`` mentions by document and place count. A direction with ``share`` of the votes is named with it in percent, else mixed;
    without votes it is empty. Phrases of fewer than four letters are left out.
    """
    low = F.lower(text)
    heads = {p: rf"\b{re.escape(p.split()[0].lower())}\b" for p in phrases if len(p) >= 4}
    one = lambda p: F.transform(windows_around(low, heads[p], width), lambda x, i: F.struct(F.lit(p).alias("phrase"), i.alias("i"), x.alias("x")))
    told = [F.when(low.contains(p.split()[0].lower()), one(p)).otherwise(F.array()) for p in heads]
    hits = docs.select("doc_id", F.explode(F.concat(*told)).alias("r")).select("doc_id", "r.*")
    # ranks within parts first, so that a phrase of very many mentions is no single sort
    order = ["doc_id", "i"]
    part = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("phrase", "part").orderBy(*order))).where(F.col("r") <= most)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy(*order))).where(F.col("r") <= most)
    counts = F.array(*(F.struct(F.regexp_count("x", F.lit(p)).alias("c"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, p) in enumerate(CUES.items())))
    votes = first.select("phrase", F.array_max(counts).alias("best")).select("phrase", F.when(F.col("best.c") > 0, F.col("best.n")).alias("vote"))
    sums = votes.groupBy("phrase").agg(F.count("*").alias("windows"), F.count("vote").alias("total"), F.array_max(F.array(*(F.struct(F.count(F.when(F.col("vote") == n, 1)).alias("c"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(CUES)))).alias("best"))
    ratio = F.col("best.c") / F.col("total")
    label = F.when(F.col("total") == 0, "").when(ratio >= share, F.concat("best.n", F.lit(" ("), F.bround(100 * ratio, 0).cast("int").cast("string"), F.lit("%)"))).otherwise("mixed")
    return sums.select("phrase", "windows", label.alias("direction"))


def survey_module(trait: str, category: str) -> str | None:
    """The survey module that a trait's population share comes from, if there is one."""
    return next((m for w, m in SURVEY_BY_NAME.items() if w in trait.lower()), SURVEY_BY_CATEGORY.get(category))


def corroboration_lock(papers: DataFrame, traits: dict[str, str], synonyms: dict[str, list[str]] = SYNONYMS, many: int = 100) -> DataFrame:
    """trait, category, paper_count_raw, paper_count, module, baseline_source, tier, gold_eligible of each trait (name: category).

    Papers (doc_id, text, has_effect, has_percent) on long lives that use a word for the trait. Of a trait with more than ``many`` of
    them, those count in which one mention has no sign of a study's design within 80 characters on either side. Two papers make it
    silver. Its baseline is a survey, a health statistic, or else papers with an effect, a percentage and a comparison.
    Traits without synonyms go by the words of their name. Papers are scanned once and walked once for all words.
    """
    words = {t: synonyms.get(t) or [w for w in re.split(r"[/()\s]+", t) if len(w) > 2] or [t] for t in traits}
    low = papers.select("doc_id", F.lower("text").alias("t"), F.coalesce("has_effect", F.lit(False)).alias("has_effect"), F.coalesce("has_percent", F.lit(False)).alias("has_percent")).where(holds(F.col("t"), LONG_LIVES))
    hits = mentions(low.withColumn("told", F.col("has_effect") & F.col("has_percent") & holds(F.col("t"), COMPARED)), "t", {t: words_pattern(w) for t, w in words.items()}, "trait")
    topical = F.exists(windows_at(F.col("t"), F.col("spans"), 80), lambda x: ~x.rlike(DESIGN))
    by = hits.groupBy("trait").agg(F.count("*").alias("raw"), F.count(F.when(topical, 1)).alias("topical"), F.max("told").alias("compared"))
    spark = papers.sparkSession
    rows = [(t, c, survey_module(t, c) or "", next((x for w, x in WHO_BY_NAME.items() if w in t.lower()), WHO_BY_CATEGORY.get(c)) or "") for t, c in traits.items()]
    all_ = spark.createDataFrame(rows, "trait string, category string, module string, who string")
    joined = all_.join(by, "trait", "left")
    raw = F.coalesce("raw", F.lit(0))
    count = F.when(raw > many, F.col("topical")).otherwise(raw)
    known = F.when(F.col("module") != "", "nhanes").when(F.col("who") != "", "who").otherwise("")
    source = F.when(known != "", known).when(F.coalesce("compared", F.lit(False)), "corpus_control").otherwise("none")
    return joined.select("trait", "category", raw.alias("paper_count_raw"), count.alias("paper_count"), "module", source.alias("baseline_source"), F.when(count >= 2, "silver").otherwise("bronze").alias("tier"), ((count >= 2) & (known != "")).alias("gold_eligible"))


def control_pct_mine(papers: DataFrame, traits: list[str], synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """trait, n_control_papers, control_pct_found, example_pct, status: percentages of control groups beside mentions of a trait.

    Of papers (doc_id, text) on long lives that mention a comparison: a mention's window, 120 characters before it
    to 40 after, gives one if a percentage stands beside "control" within a sentence. Examples are the first three by document and place.
    """
    words = {t: synonyms.get(t) or [w for w in re.split(r"[/()\s]+", t) if len(w) > 2] or [t] for t in traits}
    low = papers.select("doc_id", F.lower("text").alias("t")).where(holds(F.col("t"), LONG_LIVES) & holds(F.col("t"), COMPARED))
    hits = mentions(low, "t", {t: words_pattern(w) for t, w in words.items()}, "trait")
    group = lambda x, g: F.nullif(F.regexp_extract(x, CONTROL_PERCENT, g), F.lit(""))
    found = F.array_compact(F.transform(windows_at(F.col("t"), F.col("spans"), 120, 40), lambda x: F.coalesce(group(x, 1), group(x, 2))))
    counted = hits.select("trait", "doc_id", found.alias("found"))
    by = counted.groupBy("trait").agg(F.count("*").alias("papers"), F.sum(F.size("found")).alias("n"))
    first = counted.where(F.size("found") > 0).withColumn("r", F.row_number().over(Window.partitionBy("trait").orderBy("doc_id"))).where("r <= 3")
    examples = first.groupBy("trait").agg(F.array_join(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "found"))), lambda x: x["found"])), 1, 3), "|").alias("example_pct"))
    all_ = papers.sparkSession.createDataFrame([(t,) for t in traits], "trait string")
    n = F.coalesce("n", F.lit(0))
    return all_.join(by, "trait", "left").join(examples, "trait", "left").select("trait", F.coalesce("papers", F.lit(0)).alias("n_control_papers"), n.alias("control_pct_found"), F.coalesce("example_pct", F.lit("")).alias("example_pct"), F.when(n > 0, "materialized").otherwise("silver_pending").alias("status"))


EFFECT = r"(?:([A-Za-z][A-Za-z0-9 -]{1,40}?)\s*[:(,]?\s*)?\b(OR|HR|RR|(?i:odds ratio|hazard ratio|relative risk))\s*[=:]?\s*(\d+\.?\d*)(?:\s*[(,;]\s*95%\s*CI:?\s*(\d+\.?\d*)\s*(?:-|to|,)\s*(\d+\.?\d*))?"


# Ratios by their names.
RATIOS = {"odds ratio": "OR", "hazard ratio": "HR", "relative risk": "RR"}


def ratio_kind(measure: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(measure) == name, short) for name, short in RATIOS.items()), measure)


def biomarker_mentions(papers: DataFrame, most: int = 80, text: str = "text") -> DataFrame:
    """doc_id, ord, name, measure, value, ci_lower, ci_upper: the first ratios of each paper, with the words before them."""
    # no match holds a full stop that follows no digit, so each stretch between those is walked by itself, and only if it has a measure
    stretches = F.filter(F.split(text, r"(?<![0-9])\."), lambda x: any_of(x, ["OR", "HR", "RR"]) | any_of(F.lower(x), list(RATIOS)))
    hits = F.slice(F.flatten(F.transform(stretches, lambda x: F.regexp_extract_all(x, F.lit(EFFECT), 0))), 1, most)
    each = papers.select("doc_id", F.posexplode(hits).alias("ord", "hit"))
    each = each.select("doc_id", "ord", *(F.regexp_extract("hit", EFFECT, g).alias(n) for g, n in enumerate(("name", "measure", "value", "ci_lower", "ci_upper"), 1)))
    return each.select("doc_id", "ord", F.nullif(F.trim("name"), F.lit("")).alias("name"), ratio_kind(F.col("measure")).alias("measure"), *(F.col(c).try_cast("double").alias(c) for c in ("value", "ci_lower", "ci_upper")))


NUMBER = r"\d{1,4}(?:,\d{3})*(?:\.\d+)?"
UNIT = "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))
VALUE = rf"(?i:\b{NUMBER}(?:\s*(?:±|\+/-|–|—|-|to)\s*{NUMBER})?\s*(?:{UNIT}))(?![A-Za-z0-9])"


def name_before(before: Column) -> Column:
    """The last words of the sentence that name what a value is of, null without one.

    Connecting words right before the value are passed over. Of the six words before them those up to a word
    that no name holds are taken, four at most.
    """
    back = F.reverse(F.regexp_extract_all(F.element_at(F.split(before, "[.;!?]"), -1), F.lit(r"([A-Za-z][A-Za-z0-9αβγ·-]{1,40})"), 1))
    start = F.struct(F.array().cast("array<string>").alias("name"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        n = F.when((s["n"] == 0) & F.lower(x).isin(CONNECTING), 0).otherwise(s["n"] + 1)  # words since the last connecting one
        stop = (n > 0) & F.lower(x).isin(NOT_IN_NAMES)
        taken = F.when((n == 0) | (n > 6) | s["done"] | stop, s["name"]).otherwise(F.concat(s["name"], F.array(x)))
        return F.struct(taken.alias("name"), n.cast("int").alias("n"), (s["done"] | stop | (F.size(taken) >= 4)).alias("done"))

    name = F.array_join(F.reverse(F.aggregate(back, start, step)["name"]), " ")
    return F.when(F.length(name).between(2, 60), name)


def biomedical(name: Column) -> Column:
    """Whether a name has one of the biomedical words; those of five letters or more may be part of a word."""
    short, long = ("|".join(re.escape(w) for w in BIOMEDICAL if (len(w) > 4) is x) for x in (False, True))
    return F.coalesce(name.rlike(rf"(?i)(?:^|[\s/-])(?:{short})(?:$|[\s/-])|{long}"), F.lit(False))


def unit_mentions(papers: DataFrame, text: str = "text", back: int = 100, ahead: int = 60) -> DataFrame:
    """doc_id, ord, name, value, value_high, unit, value_type of every value with a unit and a biomedical name before it.

    ord counts a text's values with a unit from 0, those without such a name too. Null texts have none.
    """
    each = papers.select("doc_id", F.col(text).alias("t"), F.posexplode(spans_of(F.col(text), VALUE)).alias("ord", "s"))
    begin = F.greatest(F.col("s.a") - back, F.lit(0))
    parts = each.select("doc_id", "ord", F.substring("t", begin + 1, F.col("s.a") - begin).alias("left"), F.substring("t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("hit"), F.substring("t", F.col("s.b") + 1, F.lit(ahead)).alias("right"))
    whole = rf"(?i)^({NUMBER})(?:\s*(±|\+/-|–|—|-|to)\s*({NUMBER}))?\s*({UNIT})$"
    group = lambda g: F.regexp_extract("hit", whole, g)
    number = lambda g: F.regexp_replace(group(g), ",", "").try_cast("double")
    around, sep = F.concat("left", F.lit(" "), "right"), F.lower(group(2))
    kind = (
        F.when(around.rlike(r"(?i)\b(?:mean|average|avg)\b"), "mean")
        .when(around.rlike(r"(?i)\bmedian\b"), "median")
        .when(sep.isin("±", "+/-"), "mean_sd")
        .when((sep != "") | around.rlike(r"(?i)\brange\b|\biqr\b|interquartile"), "range")
        .when(around.rlike(r"(?i)\b95\s*%?\s*ci\b|confidence interval"), "ci")
        .otherwise("point_estimate")
    )
    named = parts.withColumn("name", name_before(F.col("left"))).where(biomedical(F.col("name")))
    return named.select("doc_id", "ord", "name", number(1).alias("value"), number(3).alias("value_high"), group(4).alias("unit"), kind.alias("value_type"))


DECIMAL = r"(\d+\.\d+)"
LABELLED = rf"{DECIMAL}(.{{0,45}}?)(?:95%\s*CI|confidence interval)\D{{0,6}}{DECIMAL}\s*(?:-|to|,|–)\s*{DECIMAL}"
BRACKETED = rf"{DECIMAL}(.{{0,6}}?)[(\[]\s*{DECIMAL}\s*(?:-|to|,|–)\s*{DECIMAL}\s*[)\]]"


def ci_recover(mentions: DataFrame, papers: DataFrame, text: str = "text") -> DataFrame:
    """mentions (doc_id, ord, value) with the nearest interval of their paper that contains the value.

    A labelled interval up to 45 characters after the value comes before one in brackets up to six
    after it. Values match within 0.03 or 3 %.
    """
    def found(pattern: str, kind: int) -> Column:
        v, gap, lo, hi = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (1, 2, 3, 4))
        return F.transform(F.arrays_zip(v.alias("v"), gap.alias("g"), lo.alias("lo"), hi.alias("hi")), lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("far"), x["v"].cast("double").alias("v"), x["lo"].cast("double").alias("lo"), x["hi"].cast("double").alias("hi")))

    texts = papers.select("doc_id", F.concat(found(LABELLED, 0), found(BRACKETED, 1)).alias("found"))
    joined = mentions.join(texts, "doc_id", "left")
    fits = F.filter("found", lambda x: (F.abs(x["v"] - F.col("value")) <= F.greatest(F.lit(0.03), 0.03 * F.abs("value"))) & (x["lo"] < x["hi"]) & F.col("value").between(x["lo"], x["hi"]))
    best = F.array_min(fits)
    return joined.select(*mentions.columns, best["lo"].alias("found_lower"), best["hi"].alias("found_upper"))
