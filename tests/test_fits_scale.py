"""Fits read their rows from a table that is made once."""

from pyspark.sql import functions as F

from phenolith.operators import fits


def test_rows_of_fits_are_made_once(spark):
    """Ranks and both fits go over rows that are written: none is made more often than once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    k = F.col("id")
    rows = spark.range(400).select(k.alias("subject_id"), (20 + k % 60).alias("age"), (k % 2).alias("male"), (k * 7 % 10 < 4).cast("int").alias("deceased"), (1 + k % 90).alias("permth_exm"), counted((k * 13 % 101) / 10.0).alias("alignment")).coalesce(1)
    assert [r["n"] for r in fits.feature_association(rows.withColumn("feature", F.lit("f"))).collect()] == [400]
    assert made.value == 400
    assert [r["n"] for r in fits.ablation(rows, ["alignment"]).collect()] == [400]
    assert made.value == 800
