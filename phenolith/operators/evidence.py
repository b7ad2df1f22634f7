"""Population baselines and evidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import rounded

TIER = {"gold": 1.0, "silver": 0.66, "bronze": 0.33}


def weighted_prevalence(rows: DataFrame, weight: str, indicators: dict[str, tuple[Column, Column]]) -> DataFrame:
    """indicator, n, n_weighted, prevalence_pct, ci_low, ci_high of all indicators (positive, valid) in one scan.

    A missing answer is not valid, and a positive one only if valid. Intervals are on unweighted numbers.
    """
    w, no = F.col(weight), F.lit(False)
    sums = []
    for i, (pos, valid) in enumerate(indicators.values()):
        v = F.coalesce(valid, no)
        sums += [F.count(F.when(v, 1)).alias(f"n{i}"), F.sum(F.when(v, w).otherwise(0)).alias(f"v{i}"), F.sum(F.when(v & F.coalesce(pos, no), w).otherwise(0)).alias(f"p{i}")]
    pick = F.explode(F.array(*(F.struct(F.lit(name).alias("indicator"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v"), F.col(f"p{i}").alias("p")) for i, name in enumerate(indicators))))
    r = rows.agg(*sums).select(pick.alias("r")).select("r.*")
    share = F.when(F.col("v") > 0, F.col("p") / F.col("v"))
    low, high = expr.wilson(share * F.col("n"), F.col("n"), 1.96)
    return r.select("indicator", "n", F.round("v", 0).alias("n_weighted"), rounded(100 * share, 2).alias("prevalence_pct"), rounded(100 * low, 2).alias("ci_low"), rounded(100 * high, 2).alias("ci_high"))


def prevalence_association(traits: DataFrame, prevalence: DataFrame) -> DataFrame:
    """traits (trait, indicator, cases, total, method) against the population: ratio, log odds ratio, direction, gold."""
    joined = traits.join(F.broadcast(prevalence.select("indicator", "prevalence_pct")), "indicator", "left")
    cp, pp = F.col("cases") / F.col("total"), F.col("prevalence_pct") / 100.0
    odds = lambda p: expr.clip(p, 1e-6, 1 - 1e-6) / (1 - expr.clip(p, 1e-6, 1 - 1e-6))
    ratio = F.when(pp > 0, cp / pp)
    direction = F.when(ratio.isNull(), "unavailable").when(ratio > 1.1, "enriched").when(ratio < 0.9, "depleted").otherwise("neutral")
    return joined.select(
        "trait", "indicator", rounded(100 * cp, 2).alias("case_pct"), "prevalence_pct", rounded(ratio, 3).alias("ratio"), rounded(F.log(odds(cp) / odds(pp)), 3).alias("log_odds_ratio"),
        direction.alias("direction"), ((F.col("method") == "status_composition") & direction.isin("enriched", "depleted")).alias("gold"),
    )


def evidence_score(traits: DataFrame) -> DataFrame:
    """traits (trait, tier, individuals, papers, ratio) with evidence_score.

    Logs are scaled by the extremes of all traits, found in one aggregation; a scale without width
    gives 0.5. Without a ratio its share is spread over the other parts.
    """
    cols = {"i": F.log1p("individuals"), "a": F.log1p("papers"), "r": F.when(F.col("ratio") > 0, F.abs(F.log("ratio")))}
    rows = traits.withColumns({f"_{k}": c for k, c in cols.items()})
    ends = rows.agg(*(f(f"_{k}").alias(f"{k}_{n}") for k in cols for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = rows.crossJoin(F.broadcast(ends))  # one row
    mm = lambda k: F.when(F.col(f"{k}_hi") > F.col(f"{k}_lo"), (F.col(f"_{k}") - F.col(f"{k}_lo")) / (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).otherwise(F.when(F.col(f"_{k}").isNotNull(), 0.5))
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv]), F.col("tier"))
    base = 0.35 * tier + 0.25 * mm("i") + 0.25 * mm("a")
    return scaled.select(*traits.columns, rounded(F.when(F.col("_r").isNotNull(), base + 0.15 * mm("r")).otherwise(base / 0.85), 4).alias("evidence_score"))


def domain_rollup(scored: DataFrame) -> DataFrame:
    """domain, evidence_score weighted by individuals, traits in order, the strongest one."""
    w = F.greatest("individuals", F.lit(1))
    order = F.array_sort(F.collect_list(F.struct((-F.col("individuals")).alias("n"), "trait")))
    return scored.groupBy("domain").agg(
        rounded(F.sum(F.col("evidence_score") * w) / F.sum(w), 4).alias("evidence_score"), F.array_join(F.transform(order, lambda x: x["trait"]), "|").alias("traits"),
        F.element_at(F.transform(order, lambda x: x["trait"]), 1).alias("strongest"), F.sum("individuals").cast("long").alias("mentions"), F.count("*").alias("n_traits"),
    )


def effect_direction(trait: Column, effect: Column) -> Column:
    t = F.lower(trait)
    on_age = t.contains("age at death") | t.contains("parental")
    longer = t.rlike("longevity|lifespan|long-lived|extreme age|attained age|centenarian|exceptional long")
    return (
        F.when(on_age & (effect > 0), "longevity_associated").when(on_age & (effect < 0), "longevity_adverse").when(on_age, "reported")
        .when(longer & (effect > 1), "longevity_associated").when(longer & (effect > 0) & (effect < 1), "longevity_adverse").otherwise("reported")
    )


def gwas_panel(catalogue: DataFrame, p_max: float = 5e-8) -> DataFrame:
    """snp, trait, p_value, effect, direction, chr, pos: the most significant row of each longevity variant."""
    t = F.lower("trait")
    wanted = t.rlike("longevity|lifespan|extreme age|attained age|age at death|aging|ageing|centenarian|long-lived|exceptional long") & ~t.rlike("covid|emphysema|amyloid deposition")
    snp = F.trim(F.element_at(F.split(F.element_at(F.split("snps", ";"), 1), ","), 1))
    rows = catalogue.where(wanted).withColumn("p_value", F.col("p_value").try_cast("double")).where(F.col("p_value") <= p_max).withColumn("snp", snp).where(F.col("snp").startswith("rs"))
    best = rows.groupBy("snp").agg(F.min_by(F.struct("trait", "p_value", "effect", "chr", "pos"), F.struct("p_value", "ord")).alias("b")).select("snp", "b.*")
    return best.withColumn("direction", effect_direction(F.col("trait"), F.col("effect").try_cast("double")))


def variant_freq_join(panel: DataFrame, frequencies: DataFrame) -> DataFrame:
    """panel with the case and control frequencies at its position; of repeated rows the last line counts."""
    last = frequencies.groupBy("chr", "pos").agg(F.max_by(F.struct("a1", "f_case", "f_ctrl"), "line").alias("f"))
    return panel.join(last, ["chr", "pos"], "left").select(*panel.columns, "f.a1", "f.f_case", "f.f_ctrl", rounded(F.col("f.f_case") - F.col("f.f_ctrl"), 4).alias("freq_diff"))


def layer_assignment(*parts: tuple[DataFrame, int, str]) -> DataFrame:
    """feature, kind, layer, direction: the rows of all parts (feature, direction), tagged."""
    out = None
    for df, layer, kind in parts:
        rows = df.select("feature", F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), "direction")
        out = rows if out is None else out.unionByName(rows)
    return out
