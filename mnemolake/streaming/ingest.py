"""Streaming ingest of memory events: windowed counts, deduplication, store upserts, stateful admission."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from mnemolake.operators import admission as A
from mnemolake.operators.store import MemoryStore

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
MEMORY_EVENT = "event_id string, ts timestamp, scope string, content string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT, kind: str = "parquet", files: int = 8) -> DataFrame:
    """New files of a folder as a stream; at most `files` in a micro batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def windowed_counts(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Operations and their value for each window and kind; events later than `late` behind the latest are dropped by the watermark."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_into(store: MemoryStore, name: str | None = None):
    """A foreachBatch function: memories (id, ...) of a batch that the store lacks are added, the others updated, in one write. A batch that
    is delivered again after a failure changes nothing. name: of the query; give the same one when it is started again from its
    checkpoint, as batches are told apart by it. Without one, batches of this very function are.
    """
    name = name or f"stream {uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, f"{name} batch {batch_id}")

    return write


class _Admit(StatefulProcessor):
    """A scope's active memories as a map in the state store: a batch writes the memories it changes, not the scope's whole state."""

    def init(self, handle) -> None:
        self.memories = handle.getMapState("memories", "id string", "memory string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: v[0] for k, v in self.memories.iterator()}
        store = A.Store([A.Memory(**json.loads(v)) for v in held.values()])
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for r in events.itertuples():
            op = A.admit(A.Memory(str(r.event_id), r.content or "", scope=key[0]), store, "", key[0])
            out.append((key[0], str(r.event_id), op, len(store.active())))
        active = {m.id: json.dumps(vars(m)) for m in store.active()}
        for i in held.keys() - active.keys():
            self.memories.removeKey((i,))
        for i, v in active.items():
            if held.get(i) != v:
                self.memories.updateValue((i,), (v,))
        yield pd.DataFrame(out, columns=["scope", "event_id", "op", "memories"])

    def close(self) -> None:
        pass


def admissions(events: DataFrame) -> DataFrame:
    """(scope, event_id, op, memories) of memory events, decided one after another within each scope against the scope's memories
    so far. The state is the scope's active memories; it lives in the state store (RocksDB, which map state needs and which
    this sets for the session) and is restored after a failure.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.where("scope is not null").groupBy("scope").transformWithStateInPandas(_Admit(), "scope string, event_id string, op string, memories long", "append", "none")
