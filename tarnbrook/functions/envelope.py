"""The response envelope: one of six tags with a string, its JSON and display forms, for Python values and columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and the words before the message in the display form.
DISPLAY = {
    "DatabaseError": "Database error",
    "SerializationError": "Serialization error",
    "NotFound": "Not found",
    "ValidationError": "Validation error",
    "BadRequest": "Bad Request",
    "Ok": "Ok",
}
#: Storage conditions, with their tag and message.
STORAGE_ERRORS = {
    "KeyExist": ("BadRequest", "Key already exists"),
    "NotFound": ("NotFound", "Record not found"),
    "Corrupted": ("DatabaseError", "Database is corrupted"),
    "Panic": ("DatabaseError", "Database panic occurred"),
    "MapFull": ("DatabaseError", "Database map is full"),
    "DbsFull": ("DatabaseError", "Maximum databases reached"),
    "ReadersFull": ("DatabaseError", "Maximum readers reached"),
    "TxnFull": ("DatabaseError", "Transaction is full"),
    "CursorFull": ("DatabaseError", "Cursor stack is full"),
    "PageFull": ("DatabaseError", "Page is full"),
    "MapResized": ("DatabaseError", "Database map was resized"),
    "Incompatible": ("DatabaseError", "Database is incompatible"),
    "BadRslot": ("DatabaseError", "Bad reader locktable slot"),
    "BadTxn": ("DatabaseError", "Invalid transaction"),
    "BadValSize": ("DatabaseError", "Value size is invalid"),
    "BadDbi": ("DatabaseError", "Invalid database handle"),
    "PageNotFound": ("DatabaseError", "Page not found"),
    "VersionMismatch": ("DatabaseError", "Version mismatch"),
    "Invalid": ("DatabaseError", "Invalid LMDB file"),
    "TlsFull": ("DatabaseError", "TLS keys full"),
}


class StoreError(Exception):
    """A failed store operation: a named storage condition, or a text of our own for the others."""

    def __init__(self, condition: str, text: str | None = None):
        super().__init__(text or condition)
        self.condition, self.text = condition, text


@dataclass(frozen=True)
class Response:
    status: str
    message: str

    @classmethod
    def success(cls, message) -> Response:
        return cls("Ok", str(message))

    @classmethod
    def of_error(cls, error: StoreError) -> Response:
        status, message = STORAGE_ERRORS.get(error.condition, ("DatabaseError", f"LMDB error code: {error.condition}"))
        return cls(status, error.text or message)

    @classmethod
    def of_parse_error(cls, error: Exception) -> Response:
        return cls("SerializationError", f"JSON serialization error: {error}")

    def to_json(self) -> str:
        return json.dumps({self.status: self.message}, ensure_ascii=False, separators=(",", ":"))

    def __str__(self) -> str:
        return f"{DISPLAY[self.status]}: {self.message}"


def display(status: Column, message: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return F.concat(words[status], F.lit(": "), message)


def envelope_json(status: Column, message: Column) -> Column:
    return F.to_json(F.create_map(status, message))
