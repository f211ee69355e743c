"""Samples of labelled rows whose expected size is a parameter, whatever the size of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, group: str, per_group: int, seed: int) -> DataFrame:
    """(doc_id, `group`): of each value of `group` about `per_group` rows (all, if fewer), picked by a hash of doc_id.

    The groups are classes of a label, a short list; the result is per_group rows each, so it may be broadcast."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("rows_of_group"))
    kept = rows.join(F.broadcast(sizes), group).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_STEPS)) < F.lit(_STEPS) * F.lit(float(per_group)) / F.col("rows_of_group"))
    return kept.select("doc_id", group)
