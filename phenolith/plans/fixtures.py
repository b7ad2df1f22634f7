"""The domain's inputs derived from the star-schema tables, so that every query runs on whole tables.

Only integer arithmetic on keys, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from . import model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, age, sex, country."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("subject_id"),
        (18 + F.pmod("c_custkey", F.lit(72))).cast("int").alias("age"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, "F").otherwise("M").alias("sex"),
        F.col("c_nationkey").cast("int").alias("country"),
    )


def raw_answers(spark: SparkSession, sf_dir: str, layer: int = 2) -> DataFrame:
    """subject_id, question_id, option_index: with gaps, wrong indices and unknown questions."""
    key = F.col("subject_id")
    given = subjects(spark, sf_dir).select("subject_id").crossJoin(F.broadcast(model.questions(spark, layer)))
    index = F.when((key % 97 == 0) & (F.col("q") == 0), 99).otherwise((key * 7 + F.col("q") * 3) % F.col("n_options"))
    name = F.when((key % 89 == 0) & (F.col("q") == 1), "q_unknown").otherwise(F.col("question_id"))
    return given.where((key + F.col("q")) % 5 != 0).select("subject_id", name.alias("question_id"), index.cast("int").alias("option_index"))


def answers(spark: SparkSession, sf_dir: str, layer: int = 2) -> DataFrame:
    return scoring.valid_answers(raw_answers(spark, sf_dir, layer), model.options(spark), layer)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, sex, feature, value: the last reading of each measure."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    dated = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(F.broadcast(model.mappers(spark)), F.pmod("l_partkey", F.lit(18)) == F.col("f"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("l_quantity") / 50.0)
    last = dated.groupBy(F.col("o_custkey").cast("long").alias("subject_id"), "feature").agg(F.max_by(value, F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity")).alias("value"))
    sex = F.when(F.col("subject_id") % 11 == 0, None).when(F.col("subject_id") % 2 == 0, "F").otherwise("M")
    return last.select("subject_id", sex.alias("sex"), "feature", "value")


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, feature, alignment of measures that the model scores."""
    mapped = scoring.map_panel(readings(spark, sf_dir), model.mappers(spark), model.segments(spark), model.features(spark))
    return scoring.scoreable_alignments(mapped)


def items(spark: SparkSession, sf_dir: str, layer: int = 3) -> DataFrame:
    given = answers(spark, sf_dir, 1 if layer == 1 else 2)
    if layer < 3:
        return scoring.build_items(given, model.options(spark), layer)
    return scoring.build_items(given, model.options(spark), 2, clinical(spark, sf_dir), model.features(spark), model.constructs(spark))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, age, sex, male, age_band, score, deceased, permth_exm, t_years: a followed cohort."""
    from ..functions import expr

    key = F.col("subject_id")
    scored = scoring.similarity_score(items(spark, sf_dir, 2)).select("subject_id", F.col("score_pct").alias("score"))
    people = subjects(spark, sf_dir).join(scored, "subject_id")
    months = (1 + F.pmod(key * 31, F.lit(230))).cast("int")
    return people.select(
        "subject_id", "age", "sex", (F.col("sex") == "M").cast("int").alias("male"), expr.age_band(F.col("age")).alias("age_band"), "score",
        (F.pmod(key * 13 + F.col("age"), F.lit(100)) < F.col("age") - 15).cast("int").alias("deceased"),
        months.alias("permth_exm"), F.greatest(F.lit(0.1), months / 12.0).alias("t_years"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """biomarker_name, study_id, ord, effect_measure, subject_class, value, ci_lower, ci_upper."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    value = F.lit(0.5) + F.col("l_quantity") / 25.0
    k = F.lit(1.2) + F.col("l_discount").cast("double")
    has_ci = F.col("l_returnflag") != "N"
    return lines.select(
        F.col("p_type").alias("biomarker_name"),
        F.floor(F.col("l_orderkey") / 8).cast("long").alias("study_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"),
        F.element_at(F.array(F.lit("OR"), F.lit("HR"), F.lit("RR")), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int")).alias("effect_measure"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "centenarian").otherwise("unspecified").alias("subject_class"),
        value.alias("value"),
        F.when(has_ci, value / k).alias("ci_lower"),
        F.when(has_ci, value * k).alias("ci_upper"),
    )


def life_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country_code, country_name, sex, year, age, lx, ex, warning: two years for each nation and sex."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sexes = F.explode(F.array(*map(F.lit, ("female", "male", "both")))).alias("sex")
    grid = n.select("*", sexes).select("*", F.explode(F.array(F.lit(2019), F.lit(2021))).alias("year")).select("*", F.explode(F.sequence(F.lit(60), F.lit(110))).alias("age"))
    lx = F.greatest(F.lit(1), 100000 - 12 * (F.col("age") - 60) * (F.col("age") - 60) * (1 + F.col("n_nationkey") % 5) - (F.col("year") - 2019)).cast("double")
    return grid.select(
        F.col("n_nationkey").cast("int").alias("country_code"), F.col("n_name").alias("country_name"), "sex", "year", "age", lx.alias("lx"),
        (F.floor(lx / 40) / 100).alias("ex"), ((F.col("n_nationkey") % 7 == 0) & (F.col("age") == 110)).alias("warning"),
    )
