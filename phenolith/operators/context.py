"""Demographic context of scored subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rounded


def lifetable_baseline(life_tables: DataFrame) -> DataFrame:
    """One row per country and sex from its latest year: expectations at 60 and 65, survival ratios, any warning."""
    last = F.max("year").over(Window.partitionBy("country_code", "sex"))
    at = lambda c, age: F.max(F.when(F.col("age") == age, F.col(c)))
    rows = life_tables.withColumn("last", last).where("year = last").groupBy("country_code", "country_name", "sex", "year")
    return rows.agg(
        F.round(at("ex", 60), 2).alias("ex60"),
        F.round(at("ex", 65), 2).alias("ex65"),
        rounded(at("lx", 90) / at("lx", 65), 5).alias("p_reach_90_from_65"),
        rounded(at("lx", 100) / at("lx", 65), 5).alias("p_reach_100_from_65"),
        rounded(at("lx", 100) / at("lx", 80), 5).alias("p_reach_100_from_80"),
        F.bool_or("warning").alias("quality_warning"),
    )


def normal_sex(sex):
    s = F.lower(F.trim(sex))
    return F.when(s.isin("f", "female", "woman", "w"), "female").when(s.isin("m", "male", "man"), "male").otherwise("both")


def longevity_context(people: DataFrame, baseline: DataFrame, aliases: DataFrame) -> DataFrame:
    """Baseline, band and biological-age note of each subject.

    A country is taken as a code, else an alias, else a name. Without a row for the sex the one for
    both holds, where there is one. Baselines are small dimensions.
    """
    text = baseline.withColumn("code", F.col("country_code").cast("string"))
    codes = F.broadcast(text.select(F.col("code").alias("by_code")).distinct())
    names = F.broadcast(text.select(F.lower("country_name").alias("name"), F.col("code").alias("by_name")).distinct())
    known = (
        people.join(codes, F.col("country") == F.col("by_code"), "left")
        .join(F.broadcast(aliases), F.lower("country") == F.col("alias"), "left")
        .join(names, F.lower("country") == F.col("name"), "left")
        .withColumn("resolved", F.coalesce("by_code", aliases["code"], "by_name"))
        .withColumn("s", normal_sex(F.col("sex")))
        .drop("code", "sex")
    )
    cols = ["p_reach_100_from_65", "p_reach_100_from_80", "quality_warning"]
    own = F.broadcast(text.select(F.col("code").alias("c1"), F.col("sex").alias("s1"), *cols))
    both = F.broadcast(text.where("sex = 'both'").select(F.col("code").alias("c2"), *(F.col(c).alias(f"{c}_both") for c in cols)))
    joined = known.join(own, (F.col("resolved") == F.col("c1")) & (F.col("s") == F.col("s1")), "left").join(both, F.col("resolved") == F.col("c2"), "left")
    pick = {c: F.coalesce(c, f"{c}_both") for c in cols}
    p = F.when(F.col("age") >= 73, pick[cols[1]]).otherwise(pick[cols[0]])
    score = F.col("score_pct")
    band = lambda *v: F.when(score >= 85, v[0]).when(score >= 70, v[1]).when(score >= 55, v[2]).otherwise(v[3])
    return joined.select(
        "subject_id",
        F.col("resolved").alias("country_code"),
        F.col("s").alias("sex"),
        p.alias("p_reach_target"),
        F.when(p.isNotNull(), F.when(F.col("age") >= 73, 80).otherwise(65)).alias("from_age"),
        pick["quality_warning"].alias("quality_warning"),
        band("exceptional", "typical_range", "approaching_typical", "below_typical").alias("band"),
        F.when(F.col("bio_age_delta") < 0, "younger").when(F.col("bio_age_delta").isNotNull(), "older").alias("biological_age"),
        rounded(F.least(F.lit(0.95), p * band(2.0, 1.5, 1.0, 0.6)), 4).alias("illustrative_p"),
    )


