"""The streamed ingest appends every key once, however often rows come again."""

import shutil

from phenolith.streaming import append_unseen


def test_append_unseen(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "url int, t string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (None, "n")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet
    append_unseen(stream(source), table, "url", state).awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.mode("append").parquet(source)
    query = append_unseen(stream(source), table, "url", state)
    query.awaitTermination()
    urls = lambda: sorted(str(r["url"]) for r in spark.read.parquet(table).collect())
    assert urls() == ["1", "2", "3", "None"]
    # the batch looked up its own keys in state; nothing scanned the table
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4 and "out" not in str(query.lastProgress["sources"])
    append_unseen(stream(source), table, "url", state + "2").awaitTermination()  # a new checkpoint starts from the table
    assert urls() == ["1", "2", "3", "None"]


def test_a_batch_that_runs_again_appends_nothing(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = spark.readStream.schema("url int").parquet
    spark.createDataFrame([(1,), (2,)], "url int").write.parquet(source)
    append_unseen(stream(source), table, "url", state).awaitTermination()
    shutil.rmtree(f"{state}/commits")  # as if the driver was lost between the write and its note
    append_unseen(stream(source), table, "url", state).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(table).collect()) == [1, 2]
