"""Strict reading and canonical writing of JSON records {id, hash, data}.

Spark's JSON readers coerce types and accept trailing text, single quotes and NaN, so raw text passes through one
validator here; typed rows never do. Canonical text has sorted keys and keeps the difference of 1 and 1.0."""

from __future__ import annotations

import json
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

MAX_DEPTH = 127
_INT = (-(1 << 63), (1 << 64) - 1)


class InvalidRecord(ValueError):
    pass


def _number(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise InvalidRecord("number out of range")
    return x


def _whole(text: str):
    n = int(text) if len(text) < 25 else None
    return n if n is not None and _INT[0] <= n <= _INT[1] and text != "-0" else _number(text)


def _constant(text: str):
    raise InvalidRecord(f"{text} is not JSON")


def _depth(value) -> int:
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, d)
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


class _Top(dict):
    """An object that remembers which keys came twice."""


def _pairs(items):
    out = _Top(items)
    out.repeated = {k for k, n in Counter(k for k, _ in items).items() if n > 1} if len(out) < len(items) else set()
    return out


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def parse_record(text: str) -> tuple[str, str, str]:
    """(id, hash, canonical data) of a record's JSON text; InvalidRecord if it isn't one.

    Unknown members are ignored; a member missing, of the wrong type or given twice at the top is an error. Inside
    data the last of equal keys counts. An array [id, hash, data] is a record too."""
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_number, parse_int=_whole)
    except InvalidRecord:
        raise
    except (ValueError, RecursionError) as e:
        raise InvalidRecord(str(e)) from e
    if _depth(value) > MAX_DEPTH:
        raise InvalidRecord("recursion limit exceeded")
    if isinstance(value, list):
        if len(value) != 3:
            raise InvalidRecord(f"invalid length {len(value)}, expected 3 elements")
        value = dict(zip(("id", "hash", "data"), value))
    elif not isinstance(value, dict):
        raise InvalidRecord("expected a record")
    for name in ("id", "hash", "data"):
        if name not in value:
            raise InvalidRecord(f"missing field `{name}`")
        if name in getattr(value, "repeated", ()):
            raise InvalidRecord(f"duplicate field `{name}`")
        if name != "data" and not isinstance(value[name], str):
            raise InvalidRecord(f"invalid type for `{name}`, expected a string")
    try:
        out = value["id"], value["hash"], canonical(value["data"])
        "".join(out).encode()
    except UnicodeEncodeError as e:
        raise InvalidRecord("lone surrogate in a string") from e
    return out


def well_formed(text: str | None) -> bool:
    """Whether a text is JSON of any size: what a scan passes over otherwise, and a lookup tells of. Repeated keys are
    fine; text after the value, NaN and nesting beyond what Python's reader takes (some thousand levels) are not."""
    try:
        json.loads(text, parse_constant=_constant)
        text.encode()
    except (TypeError, ValueError, RecursionError):
        return False
    return True


def well_formed_column(column: Column) -> Column:
    """well_formed() as one Arrow UDF: Spark's own readers turn down long strings, long or repeated keys and deep nesting,
    and accept text after the value."""
    ship(SparkSession.active())

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return pd.Series([well_formed(t) for t in texts], dtype=bool)

    return check(column)


def record_json(id_: str, hash_: str, data_json: str) -> str:
    """The record's JSON text, with members in the order id, hash, data."""
    q = lambda s: json.dumps(s, ensure_ascii=False)
    return f'{{"id":{q(id_)},"hash":{q(hash_)},"data":{data_json}}}'


def record_json_column(id_: Column, hash_: Column, data_json: Column) -> Column:
    """record_json() as a column expression; strings are quoted by to_json of a one-member object."""
    q = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.concat(F.lit('{"id":'), q(id_), F.lit(',"hash":'), q(hash_), F.lit(',"data":'), data_json, F.lit("}"))


_PARSED = "struct<id:string,hash:string,data_json:string,error:string>"


def parse_records(raw: DataFrame, column: str = "value") -> DataFrame:
    """Adds `record`: the parts of each JSON text, or the error. Null text is an error. One Arrow UDF, at the border only."""
    ship(raw.sparkSession)

    @F.pandas_udf(_PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((*parse_record(t), None) if isinstance(t, str) else (None, None, None, "no text"))
            except InvalidRecord as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["id", "hash", "data_json", "error"], dtype=object)

    return raw.withColumn("record", parse(F.col(column)))
