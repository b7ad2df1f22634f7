"""Validation statistics as aggregations: discrimination, calibration, distributions, associations.

Ranks come from counts per distinct value and prefix sums in two levels, so nothing is sorted as a
whole and no unpartitioned window meets fact data. ``keys`` makes each statistic one per group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..sources.staging import staged

#: Ranges that the values of a large group are cut into, and values up to which a group is one range.
RANGES, RANGE_ROWS = 256, 4096
#: Error of a cut's rank as a part of all: far below a range.
CUT_ERROR = 1e-4


def range_of(value: Column, cuts: Column) -> Column:
    """How many of the ascending cuts are below a value, by halving; cuts has fewer than RANGES numbers."""
    step, steps = lambda lo, s: F.when(F.coalesce(F.get(cuts, lo + s - 1) < value, F.lit(False)), lo + s).otherwise(lo), []
    size = RANGES // 2
    while size:
        steps.append(size)
        size //= 2
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def running(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """counts (one row per keys and value) with ``<sum>_before`` over smaller values and ``<sum>_all``.

    The values of each group are cut into ranges at quantiles that a sketch tells, so that ranges hold about as many values
    however they are spread; sums over ranges come first, those within a range after. counts and cuts are
    written once: all that follows must see the same cuts.
    """
    keys = list(keys)
    counts = staged(counts, "counts")
    at = F.percentile_approx(F.col(value).cast("double"), [i / RANGES for i in range(1, RANGES)], int(1 / CUT_ERROR))
    none = F.array().cast("array<double>")
    span = staged(counts.groupBy(*keys).agg(F.when(F.count("*") > RANGE_ROWS, F.array_distinct(at)).otherwise(none).alias("_cuts"), *(F.sum(s).alias(f"{s}_all") for s in sums)), "cuts")
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))  # without keys b is one row
    dealt = join(counts, span).withColumn("_b", F.when(F.size("_cuts") > 0, range_of(F.col(value).cast("double"), F.col("_cuts"))).otherwise(F.lit(0))).drop("_cuts")
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*keys, "_b").agg(*(F.sum(s).alias(s) for s in sums))
    blocks = blocks.select(*keys, "_b", *(F.coalesce(F.sum(s).over(over), F.lit(0)).alias(f"_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_w_{s}") for s in sums))
    out = within.join(blocks, [*keys, "_b"])
    return out.select(*counts.columns, *((F.col(f"_{s}") + F.col(f"_w_{s}")).alias(f"{s}_before") for s in sums), *(f"{s}_all" for s in sums))


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, name: the exact median of each group with a value, from counts of values; no task holds a group's values.

    Groups whose key is null have none.
    """
    ranked = running(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")), keys, value, ["_c"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c_before") <= rank) & (rank < F.col("_c_before") + F.col("_c")), F.col(value)))

    middle = (at(F.floor((F.col("_c_all") - 1) / 2)) + at(F.floor(F.col("_c_all") / 2))) / 2
    return ranked.groupBy(*keys).agg(middle.alias(name))


def auc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """keys, n, events, auc: tie-corrected; null with one class. Rows with nulls take no part."""
    w = F.lit(1) if weight is None else weight
    y = F.col(label) == 1
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(y, w).otherwise(0)).alias("pos"), F.sum(F.when(y, 0).otherwise(w)).alias("neg"))
    ranked = running(counts, keys, score, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    p, n = F.sum("pos"), F.sum("neg")
    return ranked.groupBy(*keys).agg((p + n).alias("n"), p.alias("events"), F.when((p > 0) & (n > 0), wins / (p.cast("double") * n)).alias("auc"))


def reliability_table(rows: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, observed_freq; a probability of 1 is in the last bin."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), rounded(F.avg(prob), 4).alias("mean_predicted"), rounded(F.avg(label), 4).alias("observed_freq")
    )


def ece_brier(rows: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """ece from the rounded bin means, and the Brier score."""
    table = reliability_table(rows, prob, label, bins)
    e = table.agg((F.sum(F.col("n") * F.abs(F.col("observed_freq") - F.col("mean_predicted"))) / F.sum("n")).alias("e"))
    brier = rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).agg(rounded(F.avg((F.col(prob) - F.col(label)) ** 2), 4).alias("brier"), F.count("*").alias("n"))
    return e.crossJoin(brier).select(rounded(F.col("e"), 4).alias("ece"), "brier", "n")  # one row each


def score_distribution(rows: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, min, p25, median, p75, max, mean; quantiles by nearest rank round(p * (n - 1))."""
    given = rows.where(F.col(score).isNotNull())
    counts = given.groupBy(*keys, score).agg(F.count("*").alias("c"))
    ranked = running(counts, keys, score, ["c"])

    def quantile(p: float) -> Column:
        at = F.bround(F.lit(p) * (F.col("c_all") - 1), 0)
        return F.max(F.when((F.col("c_before") <= at) & (at < F.col("c_before") + F.col("c")), F.round(score, 2)))

    return ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.round(F.min(score), 2).alias("min"),
        quantile(0.25).alias("p25"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("p75"),
        F.round(F.max(score), 2).alias("max"),
        rounded(F.sum(F.col(score) * F.col("c")) / F.sum("c"), 2).alias("mean"),
    )


def report(rows: DataFrame, score: str, label: str, groups: dict[str, Column]) -> DataFrame:
    """section, name, value: how a score tells the label's 1 from 0, overall and by group, and how it is spread.

    ``groups`` are the kinds of subgroups, each a column. One scan: every row counts once for all and once for its group of
    each kind, by score and label; all figures come from those counts. Sections: auc, n, event_rate, min, p25,
    median, p75, max, mean; names: ``all``, or kind and group. Rows without score or label take no part, null groups have no figures.
    """
    kinds = F.array(F.lit("all"), *(F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in groups.items()))
    given = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = given.select(F.col(score).alias("s"), (F.col(label) == 1).cast("int").alias("y"), F.explode(F.array_compact(kinds)).alias("name")).groupBy("name", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running(counts, ["name"], "s", ["pos", "neg"])
    c, before, total = F.col("pos") + F.col("neg"), F.col("pos_before") + F.col("neg_before"), F.col("pos_all") + F.col("neg_all")

    def quantile(p: float) -> Column:
        at = F.bround(F.lit(p) * (total - 1), 0)
        return F.max(F.when((before <= at) & (at < before + c), F.round("s", 2)))

    p, n = F.sum("pos"), F.sum("neg")
    auc_ = F.when((p > 0) & (n > 0), F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)) / (p.cast("double") * n))
    figures = {
        "auc": rounded(auc_, 4), "n": (p + n).cast("double"), "event_rate": rounded(p / (p + n), 4), "min": F.round(F.min("s"), 2), "p25": quantile(0.25), "median": quantile(0.5), "p75": quantile(0.75),
        "max": F.round(F.max("s"), 2), "mean": rounded(F.sum(F.col("s") * c) / F.sum(c), 2),
    }
    wide = ranked.groupBy("name").agg(*(x.cast("double").alias(f) for f, x in figures.items()))
    return wide.select("name", F.explode(F.array(*(F.struct(F.lit(f).alias("section"), F.col(f).alias("value")) for f in figures))).alias("r")).select("r.section", "name", "r.value")


def calibration(rows: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """section, name, value: AUC, ECE, Brier score and reliability of a probability, from one scan."""
    given = rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    counts = given.groupBy(F.col(prob).alias("s")).agg(F.sum((F.col(label) == 1).cast("int")).alias("pos"), F.sum((F.col(label) != 1).cast("int")).alias("neg"))
    ranked = running(counts, [], "s", ["pos", "neg"])
    c = F.col("pos") + F.col("neg")
    by_bin = ranked.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum(c).alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), rounded(F.sum(F.col("s") * c) / F.sum(c), 4).alias("predicted"), rounded(F.sum("pos") / F.sum(c), 4).alias("observed"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("wins"), F.sum(F.col("pos") * (1 - F.col("s")) ** 2 + F.col("neg") * F.col("s") ** 2).alias("squares"),
    )
    parts = staged(by_bin, "bins")  # a row for each bin
    p, n, all_ = F.sum("pos"), F.sum("neg"), F.sum("n")
    overall = parts.agg(F.when((p > 0) & (n > 0), rounded(F.sum("wins") / (p.cast("double") * n), 4)).alias("auc"), rounded(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / all_, 4).alias("ece"), rounded(F.sum("squares") / all_, 4).alias("brier"))
    one = lambda df, section, name, v: df.select(F.lit(section).alias("section"), name.alias("name"), F.col(v).cast("double").alias("value"))
    out = None
    for df in [one(overall, "calibration", F.lit(v), v) for v in ("auc", "ece", "brier")] + [one(parts, f"reliability_{v}", F.col("bin").cast("string"), v) for v in ("n", "predicted", "observed")]:
        out = df if out is None else out.unionByName(df)
    return out


def group_auc(rows: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """by, n, event_rate, auc of each subgroup."""
    a = auc(rows, score, label, [by])
    return a.select(by, "n", rounded(F.col("events") / F.col("n"), 4).alias("event_rate"), rounded(F.col("auc"), 4).alias("auc"))


def horizon_label(rows: DataFrame, months: int = 120) -> DataFrame:
    """rows with y: 1 for a death by then, 0 if followed so long; others go."""
    dead, m = F.col("deceased") == 1, F.col("permth_exm")
    return rows.withColumn("y", F.when(dead & (m <= months), 1).when(m >= months, 0)).where("y is not null")


def landmark_filter(rows: DataFrame, lag: float = 24) -> DataFrame:
    """rows without deaths before the lag; deaths without a time stay."""
    return rows.where(~F.coalesce((F.col("deceased") == 1) & (F.col("permth_exm") < lag), F.lit(False)))


def holdout_split(rows: DataFrame, key: str, seed: str = "1", tenths: int = 7) -> DataFrame:
    """rows with is_train, by a hash of the key: the same on every run and at every size."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("is_train", F.pmod(h, F.lit(10)) < tenths)


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman (on average ranks)."""
    given = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))

    def ranks(c: str) -> DataFrame:
        counts = running(given.groupBy(c).agg(F.count("*").alias("n")), (), c, ["n"])
        return counts.select(c, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))

    ranked = given.join(ranks("a"), "a").join(ranks("b"), "b")
    return ranked.agg(F.count("*").alias("n"), rounded(F.corr("a", "b"), 6).alias("pearson"), rounded(F.corr("ra", "rb"), 6).alias("spearman"))


def person_period(rows: DataFrame, t: str = "t_years", event: str = "event", most: int = 18) -> DataFrame:
    """One row per subject and year t up to event or censoring; y is 1 only in the last year of an event."""
    k = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(t))).cast("int")
    years = rows.withColumn("k", k).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return years.withColumn("y", ((F.col("t") == F.col("k")) & (F.col(event) == 1)).cast("int")).withColumn("t2", F.col("t") * F.col("t")).drop("k")


def cause_specific_event(rows: DataFrame, causes: DataFrame, excluded: int = 4) -> DataFrame:
    """rows with event: deaths of the excluded cause are censored; and t_years of at least 0.1."""
    joined = rows.join(causes, "subject_id", "left")
    event = (F.col("deceased") == 1) & ~F.coalesce(F.col("ucod_leading") == excluded, F.lit(False))
    return joined.withColumn("event", event.cast("int")).withColumn("t_years", F.greatest(F.lit(0.1), F.col("permth_exm") / 12.0))


def td_auc(rows: DataFrame, risk: str, horizon: int, t: str = "t_years", event: str = "event") -> DataFrame:
    """horizon, n, events, auc among those observed to the horizon."""
    hit = (F.col(event) == 1) & (F.col(t) <= horizon)
    eligible = rows.where((F.col(t) >= horizon) | hit).withColumn("_y", hit.cast("int"))
    return auc(eligible, risk, "_y").select(F.lit(horizon).alias("horizon"), "n", "events", rounded(F.col("auc"), 4).alias("auc"))


#: Tries of the sampler for means from LARGE_MEAN on. Each accepts with a probability above 0.7, so all fail with one below 1e-16.
LARGE_MEAN, TRIES = 12, 32


def _log_factorial(k: Column) -> Column:
    """ln k! to about 1e-12: Stirling's series eight places on, less the factors between."""
    x = k + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    product = k + 1.0
    for i in range(2, 9):
        product = product * (k + float(i))
    return series - F.log(product)


def poisson(mean: Column, uniform: Callable[[Column | str], Column]) -> Column:
    """A Poisson draw of a mean by hash-random numbers: ``uniform`` gives one in (0, 1) for each name.

    Small means by inversion; others by transformed rejection, whose draws have the exact distribution: a point of a wide hat is
    taken if its height is below the probability of its number, else the next pair of random numbers is tried.
    """
    m = mean.cast("double")
    u = uniform("small")
    start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.struct((s["p"] * m / i).alias("p"), (s["c"] + s["p"] * m / i).alias("c"), (s["k"] + (u > s["c"]).cast("int")).alias("k"))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(5 * LARGE_MEAN)), start, step, lambda s: s["k"])
    b = 0.931 + 2.53 * F.sqrt(m)
    a = -0.059 + 0.02483 * b
    inverse, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def attempt(drawn: Column, i: Column) -> Column:
        x, v = uniform(F.concat(F.lit("x"), i.cast("string"))) - 0.5, uniform(F.concat(F.lit("v"), i.cast("string")))
        edge = 0.5 - F.abs(x)
        k = F.floor((2 * a / edge + b) * x + m + 0.43).cast("double")
        sure, never = (edge >= 0.07) & (v <= squeeze), (k < 0) | ((edge < 0.013) & (v > edge))
        below = F.log(v) + F.log(inverse) - F.log(a / (edge * edge) + b) <= -m + k * F.log(m) - _log_factorial(k)
        return F.when(drawn >= 0, drawn).when(sure & (k >= 0), k.cast("long")).when(never, drawn).when(below, k.cast("long")).otherwise(drawn)

    large = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1).cast("long"), attempt)
    return F.when(m == 0, F.lit(0).cast("long")).when(m < LARGE_MEAN, small.cast("long")).otherwise(large)


def bootstrap_auc_ci(rows: DataFrame, score: str, label: str, resamples: int = 300, seed: int = 11) -> DataFrame:
    """resamples, low, high: Poisson bootstrap over the counts of each score, 2.5 and 97.5 percentiles.

    Rows of one score and label are drawn together: their number is Poisson with their count as mean, an exact
    draw at every count (``poisson``).
    """
    y = F.col(label) == 1
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(y.cast("int")).alias("p0"), F.sum((~y).cast("int")).alias("n0"))
    drawn = counts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def draw(mean: str) -> Column:
        def uniform(name: Column | str) -> Column:
            h = F.xxhash64(F.col(score), F.col("b"), F.lit(f"{mean}{seed}"), F.lit(name) if isinstance(name, str) else name)
            return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

        return poisson(F.col(mean), uniform)

    resampled = drawn.withColumn("pos", draw("p0")).withColumn("neg", draw("n0")).select("b", score, "pos", "neg")
    ranked = running(resampled, ["b"], score, ["pos", "neg"])
    p, n = F.sum("pos"), F.sum("neg")
    each = ranked.groupBy("b").agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)) / (p.cast("double") * n)).alias("auc"))
    return each.agg(F.count("auc").alias("resamples"), rounded(F.percentile("auc", 0.025), 4).alias("low"), rounded(F.percentile("auc", 0.975), 4).alias("high"))
