"""Progress of runs while their results arrive (J2): keyed state of a stream, a row after every tenth result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracekit.streaming.incremental import BYTES_PER_TRIGGER

EVERY = 10
STATE = "n bigint, ok bigint"
PROGRESS = "run string, module string, results bigint, successes bigint"


class RunProgress(StatefulProcessor):
    """State of a (run, module): results and successes so far. New results are taken in the order of their completion."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])   # one micro-batch of one key
        n, ok = (int(x) for x in self.totals.get()) if self.totals.exists() else (0, 0)
        at = pd.Series(range(n + 1, n + len(new) + 1))
        successes = ok + new["ok"].astype("int64").cumsum().reset_index(drop=True)
        self.totals.update((n + len(new), int(successes.iloc[-1])))
        out = pd.DataFrame({"run": key[0], "module": key[1], "results": at, "successes": successes})
        yield out[at % EVERY == 0]

    def close(self) -> None:
        pass


def run_progress(spark: SparkSession, src: str, schema, sink: str, checkpoint: str, state_partitions: int | None = None) -> None:
    """Process the result files now in ``src`` (``run, module, ts, event_id, ok``), appending PROGRESS rows to the Parquet ``sink``.

    Results of a run arrive in files in the order of their completion; inside a micro-batch they are sorted by time. A restart
    goes on with the totals that the checkpoint holds, so it changes nothing. The state lies in as many
    partitions as the shuffle had at the first start.
    """
    own = spark.newSession()  # its settings are not seen by other queries
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    stream = own.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(src)
    totals = stream.groupBy("run", "module").transformWithStateInPandas(RunProgress(), PROGRESS, "Append", "None")
    q = totals.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(sink)
    q.awaitTermination()
