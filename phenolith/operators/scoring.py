"""Scoring of all subjects at once: validation, items, similarity with interval, drivers, domains, posteriors.

Every operator keeps the long form (subject, item) and one shuffle by subject; dimensions are small
tables that Spark broadcasts by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import rounded
from ..plans import model


# -- inputs --------------------------------------------------------------------------------------


def checked_answers(answers: DataFrame, options: DataFrame, layer: int = 2) -> DataFrame:
    """answers with ``reason``: unknown, invalid (no index), out_of_range, or null if valid."""
    asked = options.where(F.col("layer") == layer).select("question_id", "n_options").distinct()
    reason = (
        F.when(F.col("n_options").isNull(), "unknown")
        .when(F.col("option_index").isNull(), "invalid")
        .when(~F.col("option_index").between(0, F.col("n_options") - 1), "out_of_range")
    )
    return answers.join(F.broadcast(asked), "question_id", "left").withColumn("reason", reason).select("subject_id", "question_id", "option_index", "reason")


def valid_answers(answers: DataFrame, options: DataFrame, layer: int = 2, strict: bool = False) -> DataFrame:
    """Answers without faults. Strict: nothing of a subject with any fault."""
    checked = checked_answers(answers, options, layer)
    good = checked.where("reason is null")
    if strict:
        good = good.join(checked.where("reason is not null").select("subject_id").distinct(), "subject_id", "left_anti")
    return good.select("subject_id", "question_id", "option_index")


def validation_report(answers: DataFrame, options: DataFrame, layer: int = 2) -> DataFrame:
    """One row per subject: numbers of valid, unknown, invalid and out-of-range inputs, and whether strict mode rejects it."""
    n = lambda r: F.count(F.when(F.col("reason") == r, 1))
    out = checked_answers(answers, options, layer).groupBy("subject_id").agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("n_valid"),
        n("unknown").alias("n_unknown"),
        n("invalid").alias("n_invalid"),
        n("out_of_range").alias("n_out_of_range"),
    )
    return out.withColumn("rejected", F.col("n_unknown") + F.col("n_invalid") + F.col("n_out_of_range") > 0)


def interpolated(values: DataFrame, segments: DataFrame, value: str = "value", feature: str = "feature", sex: str = "sex") -> DataFrame:
    """values with ``alignment``: piecewise linear between anchors, flat beyond them.

    An equi-join on the measure with the segment's range as its condition. Without a sex the
    cut-offs of males hold.
    """
    s = segments.select(F.col("feature").alias("_f"), F.col("sex").alias("_s"), "x0", "x1", "a0", "slope")
    v = F.col(value)
    on = (F.col(feature) == F.col("_f")) & (F.when(F.col(sex) == "F", "F").otherwise("M") == F.col("_s")) & (v >= F.col("x0")) & (v < F.col("x1"))
    x0 = F.greatest(F.col("x0"), F.lit(-1e9))
    return values.join(F.broadcast(s), on, "left").withColumn("alignment", rounded(F.col("a0") + F.col("slope") * (v - x0), 4)).drop("_f", "_s", "x0", "x1", "a0", "slope")


def map_panel(readings: DataFrame, mappers: DataFrame, segments: DataFrame, features: DataFrame) -> DataFrame:
    """subject_id, feature, target, alignment, status, warnings of raw measures.

    Values are clamped to the accepted range. status: scored, not_scoreable, unmapped or missing.
    """
    known = readings.join(F.broadcast(mappers.select("feature", "lo", "hi", "sex_adjusted")), "feature", "left")
    clamped = known.withColumn("v", expr.clip(F.col("value"), F.col("lo"), F.col("hi")))
    out = F.col("v") != F.col("value")
    mapped = interpolated(clamped, segments, "v")
    target = F.col("feature")
    for a, b in model.ALIASES.items():
        target = F.when(F.col("feature") == a, b).otherwise(target)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("value").isNull(), "missing"),
            F.when(out, "clamped"),
            F.when(F.col("sex_adjusted") & ~F.coalesce(F.col("sex").isin("M", "F"), F.lit(False)) & F.col("value").isNotNull(), "pooled_sex"),
        )
    )
    scored = features.select(F.col("feature").alias("target"), F.lit(True).alias("scored"))
    status = F.when(F.col("lo").isNull(), "unmapped").when(F.col("value").isNull(), "missing").when(F.col("scored"), "scored").otherwise("not_scoreable")
    return (
        mapped.withColumn("target", target)
        .join(F.broadcast(scored), "target", "left")
        .select("subject_id", "feature", "target", "alignment", status.alias("status"), F.array_join(warnings, ",").alias("warnings"))
    )


def scoreable_alignments(mapped: DataFrame) -> DataFrame:
    """subject_id, feature, alignment of the scored measures; an alias gives way to the measure itself."""
    best = F.min_by("alignment", F.when(F.col("feature") == F.col("target"), 0).otherwise(1))
    return mapped.where("status = 'scored'").groupBy("subject_id", F.col("target").alias("feature")).agg(best.alias("alignment"))


def clock_panel(readings: DataFrame, clocks: DataFrame, segments: DataFrame) -> DataFrame:
    """readings of ageing clocks with delta, alignment and warning."""
    kind, value = F.col("output_type"), F.col("value")
    known = readings.join(F.broadcast(clocks), "clock_name")
    delta = F.when(kind == "biological_age", value - F.col("chronological_age")).when(kind == "age_acceleration", value)
    raw = F.when(kind.isin("biological_age", "age_acceleration"), delta).when(kind != "index", value)
    lo = {m: r for m, *r in ((f, lo, hi) for _, f, lo, hi, _ in model.mapper_rows())}
    clamped = raw
    for m in ("epigenetic_age_acceleration", "dunedinpace_2022", "telomere_length"):
        clamped = F.when(F.col("mapper") == m, expr.clip(raw, *lo[m])).otherwise(clamped)
    mapped = interpolated(known.withColumn("delta", rounded(delta, 2)).withColumn("x", clamped), segments, "x", "mapper")
    ready = (F.col("status") == "available") & value.isNotNull()
    index = rounded(1 - expr.clip(value, 0.0, 1.0), 4)
    warning = (
        F.when(F.col("status") == "pending", "pending")
        .when(value.isNull(), "missing")
        .when((kind == "biological_age") & F.col("chronological_age").isNull(), "needs_age")
        .when(raw != F.col("x"), "clamped")
    )
    return mapped.select(
        "subject_id",
        "clock_name",
        F.when(ready, F.col("delta")).alias("delta"),
        F.when(ready, F.when(kind == "index", index).otherwise(F.col("alignment"))).alias("alignment"),
        "scoreable",
        warning.alias("warning"),
    )


# -- items and score -----------------------------------------------------------------------------


def build_items(
    answers: DataFrame, options: DataFrame, layer: int = 2, clinical: DataFrame | None = None, features: DataFrame | None = None, constructs: DataFrame | None = None, flagged: bool = False
) -> DataFrame:
    """subject_id, feature, domain, weight, alignment, basis, gwas, layer, eff_weight.

    A subject's self-report goes if its construct is measured (deepest wins). The bonus of
    genetically corroborated features holds only for subjects with measures. Answers and measures are read once and meet in one
    exchange by subject, which later aggregations by subject share. With ``flagged``, what goes stays, marked by ``superseded``.
    """
    columns = ["subject_id", "feature", "domain", "weight", "alignment", "basis", "gwas", "layer"]
    own = options.where(F.col("layer") == layer).select("question_id", "option_index", "domain", "weight", "alignment", "basis")
    if clinical is not None:
        own = own.join(F.broadcast(constructs.groupBy("question_id").agg(F.collect_set("feature").alias("by"))), "question_id", "left")
    quiz = answers.join(F.broadcast(own), ["question_id", "option_index"])
    quiz = quiz.withColumns({"feature": F.col("question_id"), "gwas": F.lit(False), "layer": F.lit(layer)})
    if clinical is None:
        rows = quiz.select(*columns, *([F.lit(False).alias("superseded")] if flagged else []))
    else:
        # measures that the model does not score supersede too
        deep = clinical.join(F.broadcast(features), "feature", "left").withColumns({"layer": F.lit(3), "by": F.lit(None).cast("array<string>"), "measure": F.col("feature")})
        both = quiz.select(*columns, "by", F.lit(None).cast("string").alias("measure")).unionByName(deep.select(*columns, "by", "measure"))
        have = F.collect_set("measure").over(Window.partitionBy("subject_id"))  # as many as there are measures
        rows = both.withColumn("superseded", F.coalesce(F.arrays_overlap("by", have), F.lit(False))).where("domain is not null")
        rows = rows.select(*columns, "superseded") if flagged else rows.where("not superseded").select(*columns)
    return rows.withColumn("eff_weight", F.col("weight") * (1 + F.when(F.col("gwas"), model.BONUS).otherwise(0.0)))


def sums() -> list[Column]:
    w, a = F.col("eff_weight"), F.col("alignment")
    return [F.count("*").alias("n_items"), F.sum(w).alias("w"), F.sum(w * a).alias("wa"), F.sum(w * a * a).alias("waa"), F.sum(F.when(F.col("gwas"), w).otherwise(0.0)).alias("gw"), F.max("layer").alias("layer")]


def similarity_score(items: DataFrame) -> DataFrame:
    """Score, interval, genetic share and depth of each subject: one aggregation by subject."""
    s = F.col("wa") / F.col("w")
    var = F.greatest(F.col("waa") / F.col("w") - s * s, F.lit(0.0))
    se = F.sqrt(var / F.greatest(F.col("n_items"), F.lit(1)))
    pct = lambda x: rounded(100 * x, 1)
    depth = F.element_at(F.create_map(*[F.lit(x) for kv in model.DEPTH.items() for x in kv]), F.col("layer"))
    return items.groupBy("subject_id").agg(*sums()).select(
        "subject_id",
        pct(s).alias("score_pct"),
        pct(expr.clip(s - 1.96 * se, 0.0, 1.0)).alias("ci_lower_pct"),
        pct(expr.clip(s + 1.96 * se, 0.0, 1.0)).alias("ci_upper_pct"),
        pct(F.col("gw") / F.col("w")).alias("gwas_share_pct"),
        F.col("n_items"),
        depth.alias("depth_pct"),
    )


def evidence_basis_mix(items: DataFrame) -> DataFrame:
    """subject_id, basis, share_pct of the weight."""
    by = items.groupBy("subject_id", "basis").agg(F.sum("eff_weight").alias("w"))
    return by.select("subject_id", "basis", rounded(100 * F.col("w") / F.sum("w").over(Window.partitionBy("subject_id")), 1).alias("share_pct"))


def kind_of(domain: Column, feature: Column, basis: Column) -> Column:
    fixed = basis.isin("genomic", "heritability") | (domain == "genetic_family_history")
    return F.when(fixed, "non_modifiable").when(domain.isin(model.MODIFIABLE_DOMAINS) | feature.isin(model.MODIFIABLE_FEATURES), "modifiable").otherwise("context")


def driver_topk(items: DataFrame, k: int = 5) -> DataFrame:
    """subject_id, list, rank, feature, alignment_pct: the strongest drivers of each kind.

    positive and negative by signed contribution, modifiable below the mean, non_modifiable.
    """
    subject = Window.partitionBy("subject_id")
    mean = F.sum(F.col("eff_weight") * F.col("alignment")).over(subject) / F.sum("eff_weight").over(subject)
    signed = items.withColumn("mean", mean).withColumn("signed", F.round((F.col("alignment") - F.col("mean")) * F.col("eff_weight"), 9)).withColumn("kind", kind_of(F.col("domain"), F.col("feature"), F.col("basis")))
    lists = {
        "positive": (F.col("signed") > 0, -F.col("signed")),
        "negative": (F.col("signed") < 0, F.col("signed")),
        "modifiable": ((F.col("kind") == "modifiable") & (F.col("signed") < 0), F.col("signed")),
        "non_modifiable": (F.col("kind") == "non_modifiable", F.lit(0.0)),
    }
    member = F.explode(F.array_compact(F.array(*(F.when(on, F.struct(F.lit(name).alias("list"), order.alias("o"))) for name, (on, order) in lists.items()))))
    ranked = signed.select("subject_id", "feature", "alignment", member.alias("m")).select("*", "m.*")
    rank = F.row_number().over(Window.partitionBy("subject_id", "list").orderBy("o", "feature"))
    label = F.regexp_replace("feature", "^q_", "")
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("subject_id", "list", "rank", label.alias("feature"), rounded(100 * F.col("alignment"), 0).alias("alignment_pct"))


def domain_scores(items: DataFrame, rules: DataFrame) -> DataFrame:
    """subject_id, name, score_pct, n_features, weight_share_pct of the interpretive domains an item may share.

    Each item carries the names of its domains, and one that stands for all items: sums by subject and name give both.
    """
    rule = lambda kind: F.broadcast(rules.where(F.col("kind") == kind).groupBy(F.col("key").alias(kind)).agg(F.collect_set("name").alias(f"by_{kind}")))
    escape = F.col("basis").isin("disease_escape", "clinical_literature") & ~F.col("domain").isin("body_composition", "cholesterol")
    genetic = F.col("gwas") | F.col("basis").isin("genomic", "heritability") | (F.col("domain") == "genetic_family_history")
    named = {"disease_escape_similarity": escape, "genetic_longevity_context": genetic, "epigenetic_youthfulness_slow_pace_context": F.col("basis") == "epigenetic"}
    none, all_ = F.array().cast("array<string>"), "*"
    names = F.concat(F.coalesce("by_feature", none), F.coalesce("by_domain", none), F.array_compact(F.array(*(F.when(on, F.lit(n)) for n, on in named.items()))), F.array(F.lit(all_)))
    listed = items.join(rule("feature"), "feature", "left").join(rule("domain"), "domain", "left").select("subject_id", "alignment", "eff_weight", F.explode(F.array_distinct(names)).alias("name"))
    w, wa = F.sum("eff_weight"), F.sum(F.col("eff_weight") * F.col("alignment"))
    by = listed.groupBy("subject_id", "name").agg(w.alias("w"), wa.alias("wa"), F.count("*").alias("n_features"))
    total = F.max(F.when(F.col("name") == all_, F.col("w"))).over(Window.partitionBy("subject_id"))
    return by.withColumn("total", total).where(F.col("name") != all_).select(
        "subject_id", "name", rounded(100 * F.col("wa") / F.col("w"), 1).alias("score_pct"), "n_features", rounded(100 * F.col("w") / F.col("total"), 1).alias("weight_share_pct")
    )


def class_posteriors(items: DataFrame) -> DataFrame:
    """Class probabilities of each subject; null with fewer than four items of positive weight."""
    given = items.groupBy("subject_id").agg(*sums(), F.count(F.when(F.col("eff_weight") > 0, 1)).alias("n"))
    p = expr.posteriors(F.col("w"), F.col("wa"), F.col("waa"))
    return given.select("subject_id", *(F.when(F.col("n") >= model.MIN_ITEMS, rounded(x, 4)).alias(c) for c, x in p.items()))


def completeness_confidence(items: DataFrame, scored: DataFrame, qualities: DataFrame, expected: int) -> DataFrame:
    """Response and evidence confidence of each subject. scored: subject_id, scored_count of valid inputs."""
    depth = F.element_at(F.create_map(*[F.lit(x) for kv in model.DEPTH.items() for x in kv]), F.col("layer"))
    quality = F.coalesce("quality", F.lit(0.5))
    by = items.join(F.broadcast(qualities), "basis", "left").groupBy("subject_id").agg((F.sum(F.col("eff_weight") * quality) / F.sum("eff_weight")).alias("quality"), F.max("layer").alias("layer"))
    share = F.least(F.lit(1.0), F.col("scored_count") / F.lit(float(expected)))
    return by.join(scored, "subject_id").select(
        "subject_id",
        rounded(100 * share, 1).alias("response_completeness_pct"),
        rounded(depth * share * F.col("quality"), 1).alias("evidence_confidence_pct"),
        ((share >= 0.5) & (F.col("scored_count") >= 3)).alias("usable"),
    )


def missing_inputs_topk(subjects: DataFrame, answers: DataFrame, clinical: DataFrame, questions: DataFrame, features: DataFrame, k: int = 6) -> DataFrame:
    """subject_id, rank, input, kind, weight: what would add most; rank 1 is the next step."""
    wanted = questions.select(F.col("question_id").alias("input"), F.lit("question").alias("kind"), "weight", F.col("q").alias("ord"))
    core = features.where(F.col("feature").isin(model.CORE_PANEL)).select(F.col("feature").alias("input"), F.lit("clinical").alias("kind"), "weight", (F.lit(100) + F.array_position(F.array(*map(F.lit, model.CORE_PANEL)), F.col("feature"))).cast("int").alias("ord"))
    have = answers.select("subject_id", F.col("question_id").alias("input")).unionByName(clinical.select("subject_id", F.col("feature").alias("input")))
    all_ = subjects.select("subject_id").crossJoin(F.broadcast(wanted.unionByName(core)))
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("weight"), "ord"))
    return all_.join(have, ["subject_id", "input"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= k).select("subject_id", "rank", "input", "kind", "weight")


def tier_mean_score(clinical: DataFrame, features: DataFrame) -> DataFrame:
    """Weighted mean of the available features by access class."""
    w, a = F.col("weight"), F.col("alignment")

    def mean(on: Column) -> Column:
        return rounded(F.sum(F.when(on, w * a)) / F.sum(F.when(on, w)), 6)

    lab, body = F.col("access") == "lab", F.col("access") == "anthropometric"
    return clinical.join(F.broadcast(features), "feature").groupBy("subject_id").agg(mean(lab).alias("labs"), mean(body).alias("anthropometric"), mean(F.lit(True)).alias("tier3"), F.count("*").alias("n"))


def composite_with_extra(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Scores with and without extra features for the subjects that have any: base and extra are (subject_id, weight, alignment)."""
    have = extra.select("subject_id").distinct()
    both = base.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True))).join(have, "subject_id", "left_semi")
    w, a = F.col("weight"), F.col("alignment")
    plain = F.sum(F.when(~F.col("extra"), w * a)) / F.sum(F.when(~F.col("extra"), w))
    return both.groupBy("subject_id").agg(rounded(plain, 6).alias("without"), rounded(F.sum(w * a) / F.sum(w), 6).alias("with"))
