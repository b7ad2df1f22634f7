"""Incremental ingest as a stream with keyed state."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The processor travels to the executors by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: The partition column of ingested tables: stream and micro-batch.
INGEST = "ingest"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Passes the first row of each key on and remembers the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        first = next(iter(rows))
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def close(self) -> None:
        pass


def append_unseen(stream: DataFrame, path: str, key: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the rows of a stream whose key the table at path does not have yet, one for a key; null is a key.

    What was seen is state by key, in the checkpoint: a micro-batch looks up its own keys and never reads the table. Only a
    stream with a new checkpoint starts from the keys that the table has. A batch writes one
    partition of the table (column ``ingest``) and, run again after a failure, the same one again, so nothing comes twice. The
    table is to be written by this function alone.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(STATE_STORE, ""):
        spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        seen = spark.read.parquet(path).select(key)
    except AnalysisException:  # the table begins with this stream
        seen = spark.createDataFrame([], stream.select(key).schema)
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    fresh = stream.groupBy(key).transformWithState(FirstOfKey(), stream.schema, "append", "none", seen.groupBy(key))

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(INGEST, F.lit(f"{name}-{number:09d}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(INGEST).parquet(path)

    writer = fresh.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
