"""Column expressions of the domain: all run inside Spark's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import CLASSES, RISK, RISK_BIAS, SPREAD

Z95 = 1.959963984540054


def rounded(x: Column, digits: int) -> Column:
    """Rounds ties up, whatever the last bit of a binary fraction."""
    return F.round(x + F.lit(1e-9), digits)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (F.lit(v) if isinstance(v, int | float) else v for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))  # they pass over nulls


def truthy(x: Column) -> Column:
    """A flag in any of its spellings: true, 1, 1.0."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def missing_as_null(x: Column, sentinel: float = 5.397605346934028e-79) -> Column:
    """Numbers written as text: blanks, dots, nan and the survey's sentinel zero."""
    number = x.try_cast("double")
    return F.when(F.isnan(number), None).when(number == sentinel, F.lit(0.0)).otherwise(number)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper limit of a proportion k of n; null without cases."""
    p = k / n
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def age_band(age: Column) -> Column:
    return F.when(age < 50, "18-49").when(age < 65, "50-64").when(age < 75, "65-74").when(age.isNotNull(), "75+")


def egfr(creatinine: Column, age: Column, sex: Column) -> Column:
    """CKD-EPI 2021 from serum creatinine in mg/dL; null without a positive value."""
    female = sex == "F"
    kappa, alpha = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    ratio = creatinine / kappa
    low, high = F.least(ratio, F.lit(1.0)), F.greatest(ratio, F.lit(1.0))
    value = 142 * F.pow(low, alpha) * F.pow(high, F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)
    return F.when((creatinine > 0) & age.isNotNull(), value)


def phq9(items: list[Column]) -> Column:
    """Sum of the nine items valid from 0 to 3; null with fewer than seven."""
    valid = F.filter(F.array(*[i.cast("int") for i in items]), lambda x: x.between(0, 3))
    return F.when(F.size(valid) >= 7, F.aggregate(valid, F.lit(0), lambda a, x: a + x))


def phenoage(c: dict[str, Column]) -> Column:
    """Published clinical biological age from nine markers and age; null if any is missing.

    Keys: albumin (g/L), creatinine (umol/L), glucose (mmol/L), crp (mg/dL), lymphocyte_pct, mcv, rdw, alp, wbc, age.
    """
    crp = F.log(F.when(c["crp"] <= 0, 0.01).otherwise(c["crp"]))
    xb = (
        F.lit(-19.907) - 0.0336 * c["albumin"] + 0.0095 * c["creatinine"] + 0.1953 * c["glucose"] + 0.0954 * crp
        - 0.0120 * c["lymphocyte_pct"] + 0.0268 * c["mcv"] + 0.3306 * c["rdw"] + 0.00188 * c["alp"] + 0.0554 * c["wbc"] + 0.0804 * c["age"]
    )
    gamma = 0.0076927
    m = clip(1 - F.exp(-F.exp(xb) * ((math.exp(120 * gamma) - 1) / gamma)), 1e-7, 1 - 1e-7)
    return F.when(crp.isNotNull(), 141.50225 + F.log(-0.00553 * F.log(1 - m)) / 0.090165)


def calibrated_risk(score: Column, age: Column, sex: Column) -> tuple[Column, Column]:
    """Ten-year risk, and its ratio to that of a person with the average score."""
    male = F.when(F.lower(F.trim(sex)).isin("m", "male", "man"), 1.0).otherwise(0.0)

    def risk(s: Column) -> Column:
        z = F.lit(RISK_BIAS)
        for x, (w, mean, spread) in zip((s, age, male), RISK.values(), strict=True):
            z = z + w * (x - mean) / spread
        return 1 / (1 + F.exp(-z))

    p = risk(score)
    return p, p / risk(F.lit(RISK["score"][1]))


def posteriors(w: Column, wa: Column, waa: Column) -> dict[str, Column]:
    """Class probabilities from the sums of weight, weight * alignment and weight * alignment**2."""
    logs = {c: F.lit(math.log(prior)) - (waa - 2 * mu * wa + mu * mu * w) / (2 * SPREAD * SPREAD) for c, (prior, mu) in CLASSES.items()}
    top = F.greatest(*logs.values())
    total = sum((F.exp(x - top) for x in logs.values()), F.lit(0.0))
    return {c: F.exp(x - top) / total for c, x in logs.items()}


# Evidence weight of a study type; anything else counts 1.
STUDY_WEIGHT = {"meta_analysis": 5.0, "meta-analysis": 5.0, "rct": 4.0, "randomized_trial": 4.0, "cohort": 3.0, "cross_sectional": 2.0, "review": 1.5}


def doc_weight(source_type: Column, study_type: Column, sample_size: Column, has_effect: Column, p_value: Column, is_profile: Column, age: Column) -> Column:
    """Evidence weight of a document, at most 20 for papers.

    Papers: by study type, size, an effect estimate and significance. News: by whether it is a
    profile, and its subject's age beyond 100.
    """
    base = F.lit(1.0)
    for kind, value in STUDY_WEIGHT.items():
        base = F.when(F.lower(F.trim(study_type)) == kind, value).otherwise(base)
    size = F.when(sample_size.isNotNull(), clip(F.log(F.greatest(sample_size, F.lit(2.0))) / math.log(1000), 0.5, 3.0)).otherwise(1.0)
    paper = F.least(base * size * F.when(has_effect, 1.5).otherwise(1.0) * F.when(p_value < 0.05, 1.2).otherwise(1.0), F.lit(20.0))
    old = F.when(age.isNotNull(), F.greatest(1 + F.least((age - 100) / 15, F.lit(1.0)), F.lit(1.0))).otherwise(1.0)
    return F.when(source_type == "academic", paper).when(source_type == "news", F.when(is_profile, 2.0).otherwise(0.5) * old).otherwise(1.0)
