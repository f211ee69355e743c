"""The store's operations on whole batches, as plans from a state (id, hash, data_json) to results and a new state.

A batch equals its rows applied one after the other in the order of `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codec import well_formed_column
from ..schema import DATABASE_ERROR, NOT_FOUND, OK, key_problem


def last_of_each(batch: DataFrame, order: list[Column | str] = ("seq",)) -> DataFrame:
    """The last row of each key."""
    others = [c for c in batch.columns if c != "id"]
    rank = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = batch.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(*rank)).alias("row"))
    return kept.select("id", *[F.col(f"row.{c}").alias(c) for c in others])


def get_all(state: DataFrame) -> DataFrame:
    """All documents by ascending bytes of their key."""
    return state.orderBy("id")


def get_by_id(state: DataFrame, id_: str) -> DataFrame:
    """The document under exactly this key; the filter reaches the Parquet scan."""
    return state.where(F.col("id") == F.lit(id_))


def get_many(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key of `keys` with status, and the document's hash and data where it is found."""
    found = keys.join(state, "id", "left")
    return found.withColumn("status", F.when(F.col("data_json").isNull() & F.col("hash").isNull(), NOT_FOUND).otherwise(OK))


def _one_of_each(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each key by `order`; in a batch without that column, the greatest by hash and data."""
    return last_of_each(batch, [order] if order in batch.columns else ["hash", "data_json"]).select("id", "hash", "data_json")


def post(state: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """State after an upsert: documents of the batch replace those of the same key as a whole. Of repeated keys the
    last by `order` counts."""
    new = _one_of_each(batch, order)
    return state.join(new.select("id"), "id", "left_anti").select("id", "hash", "data_json").unionByName(new)


def put(state: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """State after an update of existing keys only; never merges data. Repeated keys as in post()."""
    return post(state, batch.join(state.select("id"), "id", "left_semi"), order)


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("id"), "id", "left_anti").select("id", "hash", "data_json")


def existence(state: DataFrame, keys: DataFrame, found: Column, missing: Column) -> DataFrame:
    """(id, status, message) for distinct keys, by whether they exist."""
    there = state.select("id").withColumn("there", F.lit(True))
    hit = F.coalesce("there", F.lit(False))
    return keys.join(there, "id", "left").select("id", F.when(hit, OK).otherwise(NOT_FOUND).alias("status"), F.when(hit, found).otherwise(missing).alias("message"))


def get_responses(state: DataFrame, keys: DataFrame) -> DataFrame:
    return existence(state, keys, F.lit("found"), F.concat(F.lit("No model found with id: "), "id"))


def put_responses(state: DataFrame, batch: DataFrame) -> DataFrame:
    return existence(state, batch.select("id"), F.lit("updated"), F.lit("Model not found for update"))


def delete_responses(state: DataFrame, keys: DataFrame) -> DataFrame:
    return existence(state, keys.select("id"), F.lit("Record deleted successfully"), F.concat(F.lit("No record found with id: "), "id"))


def clear(state: DataFrame) -> DataFrame:
    """How many documents a clear removes."""
    return state.agg(F.count("*").alias("cleared"))


def check_keys(batch: DataFrame) -> DataFrame:
    """The batch with (status, message): Ok, or the database error of a key that can't be written."""
    problem = key_problem(F.col("id"))
    return batch.withColumn("status", F.when(problem.isNull(), OK).otherwise(DATABASE_ERROR)).withColumn("message", F.coalesce(problem, F.lit("")))


def valid_rows(stored: DataFrame) -> DataFrame:
    """A scan passes over rows whose data can't be read; lookup_strict() judges by the same test."""
    return stored.where(well_formed_column(F.col("data_json")))


def lookup_strict(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, status): a lookup tells of data that can't be read."""
    checked = stored.select("id", well_formed_column(F.col("data_json")).alias("valid"))
    return keys.join(checked, "id", "left").select("id", F.when(F.col("valid").isNull(), NOT_FOUND).when(F.col("valid"), OK).otherwise(DATABASE_ERROR).alias("status"))


def batch_responses(state: DataFrame, batch: DataFrame, op: str, order: str = "seq") -> DataFrame:
    """(`order`, id, status, message) of every row of a batch of one op, as its rows one by one would be answered: keys that
    can't be written are errors, put and delete need the key, and only the first delete of a key finds it."""
    checked = check_keys(batch.select(order, "id"))
    if op == "post":
        return checked.withColumn("message", F.when(F.col("status") == OK, "stored").otherwise(F.col("message")))
    there = checked.join(state.select("id", F.lit(True).alias("there")), "id", "left")
    hit = F.coalesce("there", F.lit(False))
    if op == "delete":
        first = checked.groupBy("id").agg(F.min(order).alias("first"))
        there = there.join(first, "id", "left")
        hit = hit & (F.col(order) == F.col("first"))
    found, missing = ("Record deleted successfully", F.concat(F.lit("No record found with id: "), "id")) if op == "delete" else ("updated", F.lit("Model not found for update"))
    bad = F.col("status") != OK
    return there.select(order, "id", F.when(bad, F.col("status")).when(hit, OK).otherwise(NOT_FOUND).alias("status"), F.when(bad, F.col("message")).when(hit, F.lit(found)).otherwise(missing).alias("message"))


def variants(state: DataFrame) -> DataFrame:
    """The query view: `data` as a variant, for variant_get and any other DataFrame operation."""
    return state.select("id", "hash", F.parse_json("data_json").alias("data"))
