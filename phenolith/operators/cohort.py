"""Cohorts from survey cycles with their own columns and units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import rounded
from . import scoring


def union_cycles(cycles: dict[str, tuple[DataFrame, dict[str, list[str]], dict[str, float]]], key: str) -> DataFrame:
    """All cycles on shared columns: for each the first known of its own columns, times its unit factor.

    cycles: name -> (table, shared column -> its columns in order, shared column -> factor).
    """
    wanted = sorted({c for _, columns, _ in cycles.values() for c in columns})
    out = None
    for name, (df, columns, factors) in cycles.items():

        def column(c: str, df=df, columns=columns, factors=factors) -> Column:
            given = [F.col(x).cast("double") for x in columns.get(c, []) if x in df.columns]
            value = F.coalesce(*given) if given else F.lit(None).cast("double")
            return (value * factors.get(c, 1.0)).alias(c)

        rows = df.select(key, F.lit(name).alias("cycle"), *(column(c) for c in wanted))
        out = rows if out is None else out.unionByName(rows)
    return out


def build_cohort(cycles: DataFrame, scores: DataFrame, mortality: DataFrame, key: str = "subject_id", min_age: int = 18) -> DataFrame:
    """Adults of all cycles with their scores, age band and, if eligible, what became of them."""
    adults = cycles.where(F.col("age") >= min_age).withColumn("age_band", expr.age_band(F.col("age")))
    eligible = mortality.where("eligstat = 1").select(key, F.col("mortstat").alias("deceased"), "permth_exm")
    return adults.join(scores, key, "left").join(eligible, key, "left")


def feature_columns(clinical: DataFrame, features: list[str], key: str = "subject_id") -> DataFrame:
    """One column f_<feature> for each feature, the values given so that no extra pass finds them."""
    wide = clinical.groupBy(key).pivot("feature", features).agg(F.first("alignment"))
    return wide.withColumnsRenamed({f: f"f_{f}" for f in features})


def epi_cohort(cohort: DataFrame, panel: DataFrame, key: str = "subject_id") -> DataFrame:
    """cohort rows with clocks: one column for each scored clock's alignment."""
    return cohort.join(panel, key)


def survey_recodes(rows: DataFrame) -> dict[str, Column]:
    """Option index of each question from the survey's own codes, null where they say nothing.

    Codes that a cycle has not are null, as are refusals and "don't know".
    """
    have = {c.lower() for c in rows.columns}
    code = lambda c: (F.col(c) if c in have else F.lit(None)).try_cast("double")
    # a fixed option for each code; other codes say nothing
    coded = lambda x, to: F.coalesce(*(F.when(x == c, i) for c, i in to.items()))
    drinks, bmi, waist = code("alq130"), code("bmxbmi"), code("bmxwaist")
    hours = F.coalesce(code("sld012"), code("sld010h"))
    days = F.greatest(code("paq655"), code("paq670"))
    blue = expr.phq9([code(f"dpq0{i}0") for i in range(1, 10)])
    health = F.coalesce(F.nullif(code("huq010"), F.lit(0.0)), code("hsd010"))
    female = F.coalesce((F.col("sex") if "sex" in have else F.lit(None).cast("string")) == "F", F.lit(False))
    mid, high = F.when(female, 80).otherwise(94), F.when(female, 88).otherwise(102)
    hearts = [code("mcq160e"), code("mcq160f")]
    either = lambda v: F.coalesce(hearts[0] == v, F.lit(False)) | F.coalesce(hearts[1] == v, F.lit(False))
    return {
        "q_smoking": F.when(code("smq020") == 2, 0).when(code("smq020") == 1, F.when(code("smq040").isin(1.0, 2.0), 2).otherwise(1)),
        "q_alcohol": F.when(F.coalesce(code("alq101"), code("alq111")) == 2, 0).when(drinks <= 2, 1).when(drinks <= 4, 2).when(drinks.isNotNull(), 3),
        "q_diet": coded(code("dbq700"), {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}),
        "q_sleep": F.when(hours.between(7, 9), 1).when(hours.isNotNull(), 2),
        "q_pa_frequency": F.when(days >= 5, 0).when(days >= 3, 1).when(days >= 1, 2).when(days.isNotNull(), 3),
        "q_depression": F.when(blue < 5, 0).when(blue < 10, 1).when(blue.isNotNull(), 2),
        "q_self_rated_health": coded(health, {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}),
        "q_family_partner": coded(code("dmdmartl"), {1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 1}),
        "q_body_mass_index": F.when(bmi < 18.5, 3).when(bmi < 25, 0).when(bmi < 30, 2).when(bmi.isNotNull(), 3),
        "q_waist_circumference": F.when(waist < mid, 0).when(waist < high, 1).when(waist.isNotNull(), 2),
        "q_diabetes": coded(code("diq010"), {1: 2, 2: 0, 3: 1}),
        "q_hypertension": F.when(code("bpq020") == 2, 0).when(code("bpq020") == 1, F.when(code("bpq040a") == 1, 2).otherwise(3)),
        "q_cholesterol": coded(code("bpq080"), {1: 2, 2: 0}),
        "q_cardiovascular_event": F.when(either(1), 2).when(either(2), 0),
        "q_cancer_history": coded(code("mcq220"), {1: 1, 2: 0}),
        "q_functional_mobility": coded(code("pfq061b"), {1: 0, 2: 1, 3: 2, 4: 2}),
        "q_bone_health": coded(code("osq060"), {1: 2, 2: 0}),
    }


def survey_answers(rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """key, question_id, option_index: what each row's survey codes answer."""
    each = F.array(*(F.struct(F.lit(q).alias("question_id"), i.cast("int").alias("option_index")) for q, i in survey_recodes(rows).items()))
    return rows.select(key, F.explode(F.filter(each, lambda x: x["option_index"].isNotNull())).alias("a")).select(key, "a.*")


def cohort_scores(answers: DataFrame, clinical: DataFrame, options: DataFrame, features: DataFrame, constructs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """subject_id, score_full, score_selfreport, score_labs, n_answers, n_clinical, and f_<column> for each of ``columns``.

    Full is of answers and measures, where measures supersede; without measures it is the self-report's. The columns are alignments
    of questions and measures by name, superseded ones too. One aggregation by subject gives all.
    """
    items = scoring.build_items(answers, options, 2, clinical, features, constructs, flagged=True)
    lab, w, a = F.col("layer") == 3, F.col("eff_weight"), F.col("alignment")
    score = lambda on: rounded(100 * F.sum(F.when(on, w * a)) / F.sum(F.when(on, w)), 1)
    return items.groupBy("subject_id").agg(
        score(~F.col("superseded")).alias("score_full"), score(~lab).alias("score_selfreport"), score(lab).alias("score_labs"), F.count(F.when(~lab, 1)).cast("int").alias("n_answers"), F.count(F.when(lab, 1)).cast("int").alias("n_clinical"),
        *(F.max(F.when(F.col("feature") == c, a)).alias(f"f_{c}") for c in columns),
    )


def assemble_cohort(cycles: DataFrame, clinical: DataFrame, mortality: DataFrame, options: DataFrame, features: DataFrame, constructs: DataFrame, columns: Sequence[str], carried: Sequence[str] = (), key: str = "subject_id") -> DataFrame:
    """One row for each adult of all cycles: cycle, age, sex, band, carried columns, three scores, what became of them, and f_<column>.

    cycles are the rows of ``union_cycles`` with survey codes, from which the answers come; clinical has the measures'
    alignments. Subjects without answers and measures have no scores; those who are not eligible or not linked, no outcome.
    """
    answers = survey_answers(cycles.where("age >= 18"), key)
    scored = cohort_scores(answers, clinical, options, features, constructs, columns).drop("n_answers", "n_clinical")
    return build_cohort(cycles.select(key, "cycle", "age", "sex", *carried), scored.withColumnRenamed("subject_id", key), mortality, key)
