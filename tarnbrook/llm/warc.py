"""WARC archives as a PySpark Python data source, and web pages written to them with revisit records.

Reading plans a partition for each archive file, takes predicates on record_type and other header columns, parses
the headers of a record first, and passes over the block of a record that the predicates turn down or whose payload
isn't asked for (option payload=false) without reading it. An archive that ends within a record is an error with any
options; with verify=true stored payloads are read and must have the length and digest that their headers tell. Writing is an Arrow writer whose commit publishes a list
of the files of the attempts that Spark has committed; readers go by these lists, so files of lost or repeated
attempts are never seen."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from . import storage
from .common import materialize, new_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: The header of each header column, and the profile of a revisit.
HEADER_OF = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task starts another file; date of the records written here, so that files are reproducible.
FILE_BYTES, DATE = 64 << 20, "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record, or with `refers_to` the revisit record of an equal payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {page_record_id(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


CUT = "the archive ends within a record"


def _end(f) -> None:
    """The line end after a block, which is missing if the archive was cut, also within a block that was passed over."""
    if f.readline() not in (b"\r\n", b"\n"):
        raise ValueError(CUT)


def _headers(f) -> dict[bytes, bytes]:
    found, last = {}, None
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise ValueError(CUT)
        if line[:1] in b" \t" and last:
            found[last] += b" " + line.strip()
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found


def records(f, wanted=None, payloads: bool = True, verify: bool = False):
    """The records of an archive as tuples of SCHEMA; `wanted(headers)` is asked before the block is looked at."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        h = _headers(f)
        left = int(h.get(b"content-length", b"0"))
        if wanted is not None and not wanted(h):
            f.seek(left, io.SEEK_CUR)
            _end(f)
            continue
        size, stored = left, h.get(b"warc-type") != b"revisit"
        if h.get(b"content-type", b"").startswith(b"application/http"):
            begin = f.tell()
            f.readline()
            size = int(_headers(f).get(b"content-length", b"-1"))
            left -= f.tell() - begin
            size = left if size < 0 else size
        payload = None
        if stored and (payloads or verify):
            payload = f.read(left)
            if len(payload) < left:
                raise ValueError(CUT)
        else:
            f.seek(left, io.SEEK_CUR)
        _end(f)
        text = {c: h[n].decode("utf-8", "replace") if n in h else None for c, n in HEADER_OF.items()}
        digest = (text["payload_digest"] or "").rpartition(":")[2] or None
        if verify and stored and ((digest or digest_of(payload)) != digest_of(payload) or size != len(payload)):
            raise ValueError(f"the payload of {text['record_id']} is not what its headers tell")
        payload = payload if payloads else None
        yield text["record_id"], text["record_type"], text["target_uri"], text["date"], digest, text["refers_to"], size, payload


def _open(path: str):
    f = storage.open_input(path)
    return gzip.open(f) if path.endswith(".gz") else f


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[bytes, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self):
        names = storage.list_names(self.path)
        lists = [n for n in names if n.startswith("commit-") and n.endswith(".json")]
        if lists:
            files = [x for n in sorted(lists) for x in json.loads(storage.open_input(f"{self.path}/{n}").read())]
        else:
            files = sorted(n for n in names if n.endswith((".warc", ".warc.gz")))
        return [InputPartition(f"{self.path}/{n}") for n in files] or [InputPartition(None)]

    def _wanted(self, h: dict) -> bool:
        for name, kind, value in self.tests:
            if name not in h:
                return False
            own = h[name].decode("utf-8", "replace")
            if name == b"warc-payload-digest":
                own = own.rpartition(":")[2]
            if kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition):
        if partition.value is None:
            return
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        rows, size = [], 0
        with _open(partition.value) as f:
            for r in records(f, self._wanted if self.tests else None, self.payloads, self.verify):
                rows.append(r)
                size += len(r[-1] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Takes columns page_id, url, payload and refers_to (the page with an equal payload, or null)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        names: list[str] = []
        rows = (r for b in iterator for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            name, size = f"pages-{uuid.uuid4().hex}.warc", 0
            with storage.create(f"{self.path}/{name}") as out:
                while row is not None and size < self.most:
                    page_id, url, payload, refers_to = row
                    size += out.write(record(page_id, url, payload or b"", refers_to))
                    row = next(rows, None)
            names.append(name)
        return Written(names)

    def commit(self, messages):
        names = [n for m in messages if m is not None for n in m.names]
        with storage.create(f"{self.path}/commit-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        for m in messages:
            for n in m.names if m is not None else ():
                storage.remove(f"{self.path}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are appended to; give a new folder instead of overwriting one")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads of at least `least_bytes`, all but the one
    with the smallest page_id refer to it. Only digests and ids are grouped and joined on the digest. The digests that
    more than one page has are written first, so that the join on them, where one digest may be that of a third of all
    pages, is not tied to the aggregate's partitions and can be split. So is the list of pages that refer to others:
    it is broadcast below the session's limit, and only beyond that payloads move, once, by page."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    ids = src.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least_bytes)
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where(F.col("last") > F.col("refers_to")).select("digest", "refers_to")
    later = ids.join(materialize(first, "warc-digests"), "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", F.col("digest").alias("same"), "refers_to").distinct()
    own = src.withColumn("same", F.unhex(F.sha1("payload")))
    return own.join(materialize(later, "warc-revisits"), ["page_id", "same"], "left").select("page_id", "url", "payload", "refers_to")


def write_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> str:
    """Writes a record for each page (null html: an empty payload) and returns the folder of the archives.

    Rows without page_id are responses; repeated rows are written as often as they come, each as its page's record. A
    null url has no target header. No rows: no archives. Other columns are not read."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or new_path(spark, "warc")
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(folder)
    return folder


def read_records(spark: SparkSession, folder: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(folder)


def page_of(record_id):
    """The page_id in a record id written here."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as least from p group by h)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(p.h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint), 1)), '') as payload_digest,
       case when page_id > least then 'revisit' else 'response' end as record_type,
       case when page_id > least then least end as refers_to
from p join f on p.h = f.h
"""
