"""Life tables by header from plain files and archives, joins of buckets, and statistics at larger sizes."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolith.operators import stats
from phenolith.sources import ingest

TABLE = """Sweden, Life tables (period 1x1), Females

  Year          Age         mx       qx    ax      lx      dx      Lx       Tx     ex
  1751           0      0.21    0.187  0.31  100000   18713   87117  3839000  38.39
  1751         100      0.55        .  0.50      12       7       9       15   1.22
  1751        110+      1.40    1.000  0.71       1       1       1        1   0.71
"""


def test_life_table_files(spark, tmp_path):
    (tmp_path / "SWE" / "STATS").mkdir(parents=True)
    (tmp_path / "SWE" / "STATS" / "fltper_1x1.txt").write_text(TABLE)
    (tmp_path / "SWE" / "STATS" / "Deaths_1x1.txt").write_text(TABLE)
    with zipfile.ZipFile(tmp_path / "JPN.zip", "w") as z:
        z.writestr("STATS/mltper_1x1.txt", "Year Age ex lx\r\n2019 65 20.5 90000\r\n\r\nnotes\r\n")
        z.writestr("STATS/bltper_1x1.csv", "no")
    rows = {(r["country_code"], r["sex"], r["age"]): r for r in ingest.life_table_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {("SWE", "female", 0), ("SWE", "female", 100), ("SWE", "female", 110), ("JPN", "male", 65)}
    first = rows["SWE", "female", 0]
    assert (first["year"], first["lx"], first["ex"], first["mx"], first["years_lived"]) == (1751, 100000.0, 38.39, 0.21, 87117.0)
    assert rows["SWE", "female", 100]["qx"] is None and rows["SWE", "female", 110]["ex"] == 0.71
    assert (rows["JPN", "male", 65]["lx"], rows["JPN", "male", 65]["ex"], rows["JPN", "male", 65]["mx"]) == (90000.0, 20.5, None)


def test_tables_without_rows(spark):
    files = spark.createDataFrame([("a", ""), ("b", None), ("c", "title\n\nYear Age lx"), ("d", "x\ny\nYEAR age\nno year")], "k string, content string")
    assert ingest.whitespace_tables(files, ["k"]).count() == 0


def test_fifteen_files_join_without_an_exchange(spark):
    base = ingest.bucketed(spark.range(50).select("id", (F.col("id") * 2).alias("age")), "id", 4)
    files = [ingest.bucketed(spark.range(0, 50, i + 1).select("id", F.lit(i).alias(f"C{i:02d}"), F.lit("x").alias("admin"), F.lit(7).alias("age")), "id", 4) for i in range(15)]
    joined = ingest.star_join(base, files, "id", drop=["admin"], names={f"C{i:02d}": f"value_{i}" for i in range(15)})
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 15 and "Exchange" not in plan
    assert joined.columns == ["id", "age", *(f"value_{i}" for i in range(15))]
    row = joined.where("id = 6").first()
    assert row["age"] == 12 and [i for i in range(15) if row[f"value_{i}"] is not None] == [i for i in range(15) if 6 % (i + 1) == 0]
    cover = {r["column"]: r["filled_pct"] for r in ingest.coverage(joined).collect()}
    assert cover["value_0"] == 100.0 and cover["value_9"] == 10.0


def test_repeated_keys_of_a_file(spark):
    base = spark.createDataFrame([(1,), (2,)], "id long")
    file = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (None, "c", 3)], "id long, s string, n int")
    assert sorted(map(tuple, ingest.star_join(base, [file], "id", first=True).collect())) == [(1, "a", 9), (2, None, None)]


def test_ranks_of_heavy_tails(spark):
    """A million log-normal scores: exact ranks, and no range of more than a twentieth of them."""
    n = 1_000_000
    counts = spark.range(n).select(F.exp(F.lit(3.0) * F.expr("randn(7)")).alias("v"), F.lit(1).alias("c")).groupBy("v").agg(F.sum("c").alias("c"))
    ranked = stats.running(counts, [], "v", ["c"])
    values = np.array([(r["v"], r["c_before"], r["c_all"]) for r in ranked.select("v", "c_before", "c_all").toLocalIterator()])
    values = values[np.argsort(values[:, 0])]
    assert (values[:, 1] == np.arange(len(values))).all() and (values[:, 2] == len(values)).all() and len(values) > 0.99 * n
    cuts = spark.range(1).select(F.array(*(F.lit(float(x)) for x in np.quantile(values[:, 0], np.arange(1, stats.RANGES) / stats.RANGES))).alias("cuts"))
    dealt = spark.createDataFrame([(float(x),) for x in values[::500, 0]], "v double").crossJoin(cuts).select("v", stats.range_of(F.col("v"), F.col("cuts")).alias("b"), "cuts").collect()
    assert all(r["b"] == sum(c < r["v"] for c in r["cuts"]) for r in dealt)
    assert max(np.bincount([r["b"] for r in dealt])) < len(dealt) / 20


@pytest.mark.parametrize("mean", [0.5, 11.9, 13, 100, 10_000])
def test_poisson_draws(spark, mean):
    n = 40_000

    def uniform(name):
        h = F.xxhash64("id", F.lit(f"seed{mean}"), F.lit(name) if isinstance(name, str) else name)
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    drawn = np.array([r["k"] for r in spark.range(n).select(stats.poisson(F.lit(mean), uniform).alias("k")).collect()])
    assert drawn.min() >= 0 and abs(drawn.mean() - mean) < 5 * math.sqrt(mean / n)
    assert abs(drawn.var() / mean - 1) < 5 * math.sqrt((2 + 1 / mean) / n)
    skew = ((drawn - mean) ** 3).mean() / mean**1.5
    assert abs(skew - 1 / math.sqrt(mean)) < 0.1
    # the whole distribution, tails included, against its formula
    logs = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(int(mean + 12 * math.sqrt(mean) + 20))]
    cdf = np.cumsum(np.exp(logs))
    empirical = np.searchsorted(np.sort(drawn), np.arange(len(cdf)), side="right") / n
    assert np.abs(empirical - cdf).max() < 1.95 / math.sqrt(n)
    tail = int(mean + 3 * math.sqrt(mean))
    assert abs((drawn > tail).mean() - (1 - cdf[tail])) < 5 * math.sqrt((1 - cdf[tail]) / n) + 1e-4


def test_report_in_one_scan(spark):
    rows = [(float(i % 7), i % 3 == 0, "a" if i % 2 else None) for i in range(60)] + [(None, True, "a"), (1.0, None, "a")]
    df = spark.createDataFrame(rows, "s double, y boolean, g string").withColumn("y", F.col("y").cast("int"))
    found = {(r["section"], r["name"]): r["value"] for r in stats.report(df, "s", "y", {"g": F.col("g")}).collect()}
    given = [(s, y) for s, y, _ in rows if s is not None and y is not None]
    pairs = [(a > b) + (a == b) / 2 for a, y in given if y for b, z in given if not z]
    assert found["auc", "all"] == round(sum(pairs) / len(pairs), 4) and found["n", "all"] == 60 and found["n", "g: a"] == 30
    assert {n for _, n in found} == {"all", "g: a"} and found["median", "all"] == sorted(s for s, _ in given)[round(0.5 * 59)]
