"""Pure plans over the operation log: current state, responses, state as of an entry.

The key of an entry exists after it iff the key's last post or delete is a post; put never changes that. A living
key's value is that of its last post or put. So state is one aggregate by key, combined before its shuffle, and
hot keys cost one row for each task; no entry is replayed one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NOT_FOUND, OK


def _carried(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("seq", "op", "id")]


def since_clear(log: DataFrame) -> DataFrame:
    """Entries after the last clear."""
    cleared = log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-(1 << 62)))).scalar()
    return log.where((F.col("op") != "clear") & (F.col("seq") > cleared))


def state(log: DataFrame) -> DataFrame:
    """(id, hash, data_json and what else an entry carries) of the living documents. The log has no clear after its first wanted entry; see
    since_clear()."""
    carried = _carried(log)
    exists = F.max(F.when(F.col("op").isin("post", "delete"), F.struct("seq", "op")))
    value = F.max_by(F.struct(*carried), F.when(F.col("op").isin("post", "put"), F.col("seq")))
    folded = log.where("op in ('post', 'put', 'delete')").groupBy("id").agg(exists.alias("e"), value.alias("v"))
    return folded.where("e.op = 'post'").select("id", *[F.col(f"v.{c}").alias(c) for c in carried])


def state_with_clear(log: DataFrame) -> DataFrame:
    return state(since_clear(log))


def as_of(log: DataFrame, seq: int | Column) -> DataFrame:
    """The state after entry `seq`, a number or the one value of a scalar subquery."""
    return state_with_clear(log.where(F.col("seq") <= seq))


def with_snapshot(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """A log whose fold is that of the snapshot's documents followed by the tail."""
    carried = _carried(tail)
    base = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit("post").alias("op"), "id", *carried)
    return base.unionByName(tail.select("seq", "op", "id", *carried))


def responses(log: DataFrame) -> DataFrame:
    """(seq, op, id, status) of each entry: a post is Ok; put, delete and get are Ok iff the key exists just before."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("post", "delete"), F.col("op")), ignorenulls=True).over(before)
    return log.withColumn("last", last).select("seq", "op", "id", F.when((F.col("op") == "post") | (F.col("last") == "post"), OK).otherwise(NOT_FOUND).alias("status"))
