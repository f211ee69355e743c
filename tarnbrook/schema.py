"""Row types: a document, an entry of the operation log, a response; and the rules for keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A document: key, opaque hash of the caller, canonical JSON text of the data.
DOCUMENT = "id string, hash string, data_json string"
#: A document in the store's files, with whether its data is JSON, found when it was written.
STORED = f"{DOCUMENT}, valid boolean"
#: A log entry in the store's files. seq is a total order; op is post, put, delete, get or clear (which has no id).
LOG = f"seq long, op string, {STORED}"
RESPONSE = "seq long, op string, id string, status string, message string"
#: Bytes of the longest key.
MAX_KEY = 511

NOT_FOUND, OK, DATABASE_ERROR = "NotFound", "Ok", "DatabaseError"


def key_problem(id_: Column) -> Column:
    """Null for a key that can be written, else the text of the database error."""
    return F.when(id_.isNull() | (F.octet_length(id_) == 0) | (F.octet_length(id_) > MAX_KEY), F.lit("Value size is invalid"))
