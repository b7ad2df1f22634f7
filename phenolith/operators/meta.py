"""Meta-analysis of effect mentions: studies, contrasts, random-effects pools, grades and roll-ups.

Pools are two passes of sums; no group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import Z95, rounded
from ..plans.lexicon import AMBIGUOUS_NAMES, CANONICAL, DROPPED_NAMES, FOREIGN_PARTS, GARBAGE_NAMES, STRIPPED_PHRASES, STRIPPED_WORDS
from ..sources.staging import staged
from .dictionary import contained
from .stats import medians

STRATUM = ["biomarker_name", "effect_measure", "contrast_type", "subject_class"]
LONG_LIVED = ("centenarian", "nonagenarian", "supercentenarian")
OUTCOME = "mortalit|surviv|death|fatal|lethal"
A_MAX, USABLE_MAX = 50.0, 75.0


def contrast_type(name: Column, measure: Column, subject_class: Column) -> Column:
    return (
        F.when(F.coalesce(F.lower(name).rlike(OUTCOME), F.lit(False)), "prognostic_outcome")
        .when(measure == "HR", "prognostic_mortality")
        .when((measure == "OR") & subject_class.isin(*LONG_LIVED), "prevalence_longlived")
        .otherwise("disease_risk")
    )


def with_contrast(mentions: DataFrame) -> DataFrame:
    known = mentions.withColumn("subject_class", F.coalesce("subject_class", F.lit("unspecified")))
    return known.withColumn("contrast_type", contrast_type(F.col("biomarker_name"), F.col("effect_measure"), F.col("subject_class")))


def median(values: Column) -> Column:
    """The median of an array of numbers, halfway between the middle two; null if it has none."""
    at = lambda v, i: F.get(v, i.cast("int"))
    of = lambda v: 0.5 * at(v, F.floor((F.size(v) - 1) / 2)) + 0.5 * at(v, F.floor(F.size(v) / 2))
    return F.element_at(F.transform(F.array(F.array_sort(F.array_compact(values))), lambda v: F.when(F.size(v) > 0, of(v))), 1)  # bound as a variable, it is sorted once


def study_collapse(mentions: DataFrame, keys: list[str] = STRATUM) -> DataFrame:
    """One estimate for each study of a stratum: of those with an interval the one nearest their median, else the median."""
    by = [*keys, "study_id"]
    has = F.col("ci_lower").isNotNull()
    # the mentions of one study of a stratum meet once, in one row
    rows = mentions.groupBy(*by).agg(F.collect_list(F.struct("ord", "value", "ci_lower", "ci_upper")).alias("every"))
    rows = rows.withColumn("g", F.filter("every", lambda x: x["ci_lower"].isNotNull()))
    rows = rows.withColumns({"m": median(F.transform("g", lambda x: x["value"])), "all": median(F.transform("every", lambda x: x["value"]))})
    # the median may lie between two values; distances that differ in a last bit are ties
    near = lambda x: F.struct(F.round(F.abs(x["value"] - F.col("m")), 9).alias("far"), x["ord"].alias("ord"), x["value"].alias("value"), x["ci_lower"].alias("ci_lower"), x["ci_upper"].alias("ci_upper"))
    pick = rows.withColumn("p", F.array_min(F.transform("g", near)))
    return pick.select(*by, F.coalesce("p.value", "all").alias("value"), F.col("p.ci_lower").alias("ci_lower"), F.col("p.ci_upper").alias("ci_upper"), F.col("p").isNotNull().alias("has_ci"))


def dl_pool(studies: DataFrame, keys: list[str]) -> DataFrame:
    """DerSimonian-Laird pool of the studies with an interval, for each group of two or more."""
    given = studies.where("has_ci").withColumn("y", F.log("value")).withColumn("v", F.pow((F.log("ci_upper") - F.log("ci_lower")) / (2 * Z95), F.lit(2)))
    w = 1 / F.col("v")
    sums = given.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"), F.sum(w * w).alias("ww"),
        (F.min("y") > 0).alias("up"), (F.max("y") < 0).alias("down"),
    ).where("k > 1")
    q = F.greatest(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.lit(0.0))
    c = F.col("w") - F.col("ww") / F.col("w")
    first = sums.withColumn("q", q).withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (q - F.col("k") + 1) / c)).otherwise(0.0))
    first = first.withColumn("i2", F.when(F.col("q") > 1e-9, F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / F.col("q")) * 100).otherwise(0.0))
    star = 1 / (F.col("v") + F.col("tau2"))
    second = given.join(first, keys).groupBy(*keys).agg(F.sum(star).alias("ws"), F.sum(star * F.col("y")).alias("wsy"))
    mu, se = F.col("wsy") / F.col("ws"), 1 / F.sqrt("ws")
    return first.join(second, keys).select(
        *keys, mu.alias("mu"), se.alias("se"), F.exp(mu).alias("pooled"), F.exp(mu - Z95 * se).alias("ci_lower"), F.exp(mu + Z95 * se).alias("ci_upper"),
        F.col("i2").alias("i_squared"), F.col("tau2").alias("tau_squared"), F.col("k").alias("n_ci"), (F.col("up") | F.col("down")).alias("same_direction"),
    )


def strata(mentions: DataFrame) -> DataFrame:
    """One row per stratum: pool or single study or point, commensurability, grade and use."""
    studies = staged(study_collapse(with_contrast(mentions)), "studies")  # read four times
    pools = dl_pool(studies, STRATUM)
    counts = studies.groupBy(*STRATUM).agg(
        F.count("*").alias("n_studies"), F.count(F.when(F.col("has_ci"), 1)).alias("n_ci_all"),
        F.max(F.when(F.col("has_ci"), F.struct("value", "ci_lower", "ci_upper"))).alias("one"),
    )
    rows = counts.join(medians(studies, STRATUM, "value", "point"), STRATUM, "left").join(pools, STRATUM, "left")
    single, many = F.col("n_ci_all") == 1, F.col("n_ci_all") >= 2
    ok = F.col("contrast_type") != "prognostic_outcome"
    good = F.when(many, ok & F.col("same_direction") & (F.col("i_squared") <= USABLE_MAX)).when(single, ok).otherwise(False)
    grade = F.when(~good, "C").when(single, "B").when((F.col("n_ci_all") >= 3) & (F.col("i_squared") <= A_MAX), "A").when(many, "B").otherwise("C")
    high = grade.isin("A", "B")
    use = (
        F.when(~good, "directional_only")
        .when((F.col("contrast_type") == "prevalence_longlived") & high, "similarity_primary")
        .when(F.col("contrast_type") == "prevalence_longlived", "similarity_supporting")
        .when(high, "prognostic_supporting")
        .otherwise("directional_only")
    )
    of = lambda pool, one: F.when(many, F.col(pool)).when(single, F.col(f"one.{one}"))
    return rows.select(
        *STRATUM, "n_studies", F.col("n_ci_all").alias("n_ci"), rounded(F.coalesce(of("pooled", "value"), "point"), 5).alias("pooled"),
        rounded(of("ci_lower", "ci_lower"), 5).alias("ci_lower"), rounded(of("ci_upper", "ci_upper"), 5).alias("ci_upper"), rounded(F.col("i_squared"), 4).alias("i_squared"),
        rounded(F.col("tau_squared"), 6).alias("tau_squared"), good.alias("commensurable"), grade.alias("grade"), use.alias("model_use"),
    )


# Which stratum stands for a biomarker.
USES = {"similarity_primary": 0, "prognostic_supporting": 1, "similarity_supporting": 2, "directional_only": 3}


def primary_stratum(strata_: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each biomarker's best commensurable stratum, the number of strata, and the base rate of its studies with its interval."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in USES.items() for x in kv]), F.col("model_use"))
    best = F.min_by(F.struct("effect_measure", "contrast_type", "subject_class", "pooled", "grade", "model_use"), F.when(F.col("commensurable"), F.struct(order, "grade", -F.col("n_ci"), "contrast_type", "effect_measure", "subject_class")))
    rolled = strata_.groupBy("biomarker_name").agg(F.count("*").alias("n_strata"), F.count(F.when(F.col("commensurable"), 1)).alias("n_commensurable"), F.when(F.max(F.col("commensurable").cast("int")) == 1, best).alias("b"))
    sources = mentions.groupBy("biomarker_name").agg(F.count_distinct("study_id").alias("n_sources"))
    corpus = mentions.select("study_id").distinct().agg(F.count("*").alias("n_corpus"))
    low, high = expr.wilson(F.col("n_sources"), F.col("n_corpus"))
    return sources.join(rolled, "biomarker_name", "left").crossJoin(F.broadcast(corpus)).select(  # one row
        "biomarker_name", "n_sources", F.coalesce("n_strata", F.lit(0)).alias("n_strata"), F.coalesce("n_commensurable", F.lit(0)).alias("n_commensurable"),
        F.col("b.effect_measure").alias("measure"), F.col("b.contrast_type").alias("contrast"), F.col("b.subject_class").alias("class"), F.col("b.pooled").alias("pooled"),
        F.coalesce("b.grade", F.lit("C")).alias("grade"),
        F.coalesce("b.model_use", F.when(F.coalesce("n_strata", F.lit(0)) == 0, "qualitative_baserate").otherwise("directional_only")).alias("model_use"),
        rounded(F.col("n_sources") / F.col("n_corpus"), 6).alias("base_rate"), rounded(low, 6).alias("base_low"), rounded(high, 6).alias("base_high"),
    )


def unstratified_pool(mentions: DataFrame) -> DataFrame:
    """Each biomarker's pool over all its studies: pooled, single_study, point_no_ci, and a grade by number and width."""
    studies = staged(study_collapse(mentions, ["biomarker_name"]), "studies")
    pools = dl_pool(studies, ["biomarker_name"])
    counts = studies.groupBy("biomarker_name").agg(F.count("*").alias("n_studies"), F.count(F.when(F.col("has_ci"), 1)).alias("n_with_ci"), F.max(F.when(F.col("has_ci"), F.struct("value", "ci_lower", "ci_upper"))).alias("one"))
    counts = counts.join(medians(studies, ["biomarker_name"], "value", "point"), "biomarker_name", "left")
    n = F.col("n_with_ci")
    kind = F.when(n >= 2, "pooled_DL").when(n == 1, "single_study").otherwise("point_no_ci")
    narrow = F.col("ci_upper") / F.col("ci_lower") <= 3
    return counts.join(pools, "biomarker_name", "left").select(
        "biomarker_name", "n_studies", "n_with_ci", kind.alias("effect_model"), rounded(F.coalesce("pooled", "one.value", "point"), 5).alias("effect"),
        F.when((n >= 3) & narrow, "A").when(n >= 2, "B").otherwise("C").alias("grade"),
    )


def snake(name: Column) -> Column:
    """A name in snake case."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stripped(name: Column) -> Column:
    """A name in snake case without the phrases and words of methods and statistics."""
    low = F.lower(name)
    for phrase in STRIPPED_PHRASES:
        low = F.replace(low, F.lit(phrase), F.lit(" "))
    return F.array_join(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(STRIPPED_WORDS)), "_")


def canonical_names(names: DataFrame, canonical: Sequence[tuple[str, Sequence[str]]] = CANONICAL) -> DataFrame:
    """biomarker_name, canonical, rule, name_changed, review_priority, note of each distinct name.

    The first trigger of the ordered table that the lower-cased name holds gives its canonical name; one walk a name finds
    all of them. Names without one keep what ``stripped`` leaves, or else their snake case. The note says how, and what makes a name
    doubtful; doubtful ones have high priority for review, other changed ones low. Null names are left out.
    """
    pairs = [(name, t) for name, triggers in canonical for t in triggers]
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("matched:" + t).alias("how")) for n, t in pairs))
    first = F.array_min(contained(F.lower("biomarker_name"), [[t] for _, t in pairs]))
    found = names.select("biomarker_name").where("biomarker_name is not null").distinct().withColumn("i", first).withColumn("hit", F.when(F.col("i").isNotNull(), F.element_at(table, F.col("i") + 1)))
    raw = F.col("biomarker_name")
    left = found.withColumns({"canonical": F.coalesce("hit.name", F.nullif(stripped(raw), F.lit("")), snake(raw)), "rule": F.coalesce("hit.how", F.lit("fallback_stripped"))})
    changed = F.col("canonical") != snake(raw)
    foreign = F.lower(raw).rlike("|".join(re.escape(x) for x in FOREIGN_PARTS).replace("\\ ", " "))
    doubts = [
        F.when(raw.isin(GARBAGE_NAMES), "EXTRACTION_GARBAGE: no clear clinical term"), F.when(raw.isin(AMBIGUOUS_NAMES), "AMBIGUOUS: multiple candidate terms / negation"), F.when(foreign, "NON_ENGLISH: mapped from es/pt phrasing"),
        F.when(changed & (F.col("rule") == "fallback_stripped"), "NO_CANONICAL_MATCH: kept stripped term, verify"),
    ]
    note = F.concat_ws("; ", F.when(changed, F.col("rule")), *doubts)
    priority = F.when(F.coalesce(*doubts).isNotNull(), "high").when(changed, "low").otherwise("none")
    return left.select("biomarker_name", "canonical", "rule", changed.alias("name_changed"), priority.alias("review_priority"), F.when(note == "", "formatting_only").otherwise(note).alias("note"))


def canonical(mentions: DataFrame, dropped: Sequence[str] = DROPPED_NAMES) -> DataFrame:
    """mentions under canonical names (``canonical``), without the raw names that are no biomarker."""
    kept = mentions.where(~F.col("biomarker_name").isin(list(dropped)))
    return kept.join(canonical_names(kept), "biomarker_name")


def biomarker_summary(mentions: DataFrame, survey_words: tuple[str, ...], gwas_words: tuple[str, ...]) -> DataFrame:
    """Counts, sets and the breadth grade of each biomarker."""
    tokens = F.split(F.lower("biomarker_name"), "[^a-z0-9]+")
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    rows = mentions.groupBy("biomarker_name").agg(
        F.count("*").alias("n_mentions"), F.count_distinct("study_id").alias("n_sources"), F.count_distinct("country").alias("n_countries"),
        F.array_join(F.array_sort(F.collect_set("subject_class")), "|").alias("classes"), F.array_join(F.array_sort(F.collect_set("effect_measure")), "|").alias("value_types"),
    )
    middle = medians(mentions, ["biomarker_name"], "sample_size", "median_n").withColumn("median_n", F.floor("median_n").cast("int"))
    rows = rows.join(middle, "biomarker_name", "left").withColumns({"in_survey": has(survey_words), "in_gwas": has(gwas_words)})
    n, well = F.col("n_sources"), F.size(F.split("biomarker_name", r"\s+")) <= 4
    either, both = F.col("in_survey") | F.col("in_gwas"), F.col("in_survey") & F.col("in_gwas")
    wide = (n >= 3) & (F.col("n_countries") >= 2)
    grade = (
        F.when(wide & either, "A").when(both & ((n >= 3) | (F.col("n_mentions") >= 5)) & well, "A").when(wide, "B").when((n >= 2) & both & well, "B").when((n >= 2) & either & well, "B").when((n >= 3) & well, "B").otherwise("C")
    )
    return rows.withColumn("grade", grade)


