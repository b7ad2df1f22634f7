"""Mixing sources to target weights with DataFrame operations only.

Documents get a hash-random key. Each source's keys are dealt into ranges, the ranges' token sums
are added up first and the documents within each range after that, so no source is one group.
The prefix sums say which documents lie within the source's budget; what a source has too little of
is taken in whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
RANGE_ROWS = 5_000
KEY_BITS = 60
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, n of every source of (source, size).

    Sources in order of their code points, null last, get the weights in turn and share the total
    size by them. A target stops at ``most`` times its source's size and what is over is shared
    again: with the sources in order of size by weight, those that stop come first, and one pass
    over the sources finds where that ends.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        total.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("stops", F.col("cap") * F.col("weights") < F.col("left") * F.col("weight"))
        .withColumn("free", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source", "left", "weights"))).over(everything))
        .withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("free.left").cast("double") * F.col("weight") / F.col("free.weights")))
        .select("source", "source_size", "n", "target")
    )


def key(doc_id: Column, seed: str = SEED) -> Column:
    """A hash-random number below 2**KEY_BITS that depends on seed and doc_id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, whole: bool = False, range_rows: int = RANGE_ROWS, row: str | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    ``taken`` words of a document go into the mix: its size for each whole epoch that fits in the
    target, and once more for documents that lie, in order of their keys, within what is then left.
    The document at the cut gives just the words up to it, or, if ``whole``, all of them. Empty and
    null texts have size 0 and none taken. A null source is a source. Rows that repeat a doc_id are
    documents each; ``row``, a column that tells them apart, is carried if given. Reruns agree. An empty
    table gives an empty one; other columns are not carried.
    """
    more = [] if row is None else [row]
    source = F.col("source").cast("string").alias("source")
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, n_words(F.col("text")).alias("size"), *more), "mix-sizes")
    of_source = written(targets(sizes, weights, most), "mix-targets")
    keyed = sizes.withColumn("key", key(F.col("doc_id"), seed))
    same = keyed["source"].eqNullSafe(of_source["source"])
    # ranges of about range_rows keys; their number follows from the source's rows alone
    ranges = F.ceil(F.col("n") / range_rows).cast("long")
    dealt = keyed.join(of_source, same).drop(of_source["source"]).withColumn("range", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * ranges))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("source", "range")
        .agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(up_to), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    left = F.pmod(budget, F.col("source_size")) - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    part = F.when(part > 0, F.col("size")).otherwise(F.lit(0)) if whole else part
    return (
        dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("before", F.col("before") + F.col("within"))
        .withColumn("taken", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.col("source_size")) * F.col("size") + part).cast("long"))
        .select("doc_id", "size", "source_size", "target", "taken", *more)
    )
