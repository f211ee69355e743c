"""Structured Streaming into a store: each micro-batch becomes one version, once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import DocumentStore


def ingest(stream: DataFrame, store: DocumentStore, checkpoint: str, op: str = "post", order: str = "seq", **trigger) -> StreamingQuery:
    """Applies a stream of (id, hash, data_json, `order`) to the store, exactly once: the manifest that holds a micro-batch
    also names it, by the stream's id in its checkpoint and the batch's number, so one that is repeated after a
    failure is passed over, whatever others have written since."""

    def write(batch: DataFrame, number: int) -> None:
        name = json.loads(store.spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        store.apply(batch, op, order, (name, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_counts(log_stream: DataFrame, minutes: int = 5, late: int = 10) -> DataFrame:
    """Entries of each kind in tumbling windows of the event time `ts`; later ones than `late` minutes are left out."""
    return log_stream.withWatermark("ts", f"{late} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "op").agg(F.count("*").alias("entries"))
