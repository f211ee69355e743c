"""A document store on immutable files: an append-only operation log under versioned manifests.

A manifest names a snapshot (documents sorted by key), log parts, and the newest entries themselves while they are few.
A commit writes manifest v(n+1), which fails if it exists; the loser reads again and decides anew, so versions are
the single order of all writes and readers that hold a version see one state. Deleting or clearing never touches
published files; compaction folds all into a new snapshot, and vacuum() removes what no kept version names. Whether a
document's data is JSON is found once, when it is written, and stored beside it: scans pass over documents whose data
isn't, lookups tell of it."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import well_formed, well_formed_column
from .functions.envelope import StoreError
from .operators import fold, ops
from .schema import LOG, MAX_KEY, STORED

#: Entries and bytes kept in a manifest before they become a log part; parts before a compaction.
INLINE_ROWS, INLINE_BYTES, MAX_PARTS = 500, 1 << 18, 16
#: Manifests that stay, and the commits after which older ones are removed.
KEPT_VERSIONS, EXPIRE_EVERY = 1000, 200
CLOSED = "the store is closed"


@dataclass(frozen=True)
class Record:
    id: str
    hash: str
    data_json: str


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    snapshot: str | None = None
    parts: tuple[str, ...] = ()
    inline: tuple[tuple, ...] = ()
    next_seq: int = 0
    #: The last batch of each stream that is in here.
    streams: tuple[tuple[str, int], ...] = ()

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "snapshot": self.snapshot, "parts": self.parts, "inline": self.inline, "next_seq": self.next_seq, "streams": self.streams})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        v = json.loads(text)
        return cls(v["version"], v["snapshot"], tuple(v["parts"]), tuple(map(tuple, v["inline"])), v["next_seq"], tuple(map(tuple, v["streams"])))


@dataclass
class DocumentStore:
    spark: SparkSession
    name: str
    root: str = "."
    opened: bool = field(default=False, init=False)

    @classmethod
    def init(cls, spark: SparkSession, name: str, root: str = ".") -> DocumentStore:
        """Opens the store, and makes it first if there is none."""
        store = cls(spark, name, root)
        store._open()
        return store

    # -- files -------------------------------------------------------------------------------------------------

    @property
    def path(self) -> str:
        return os.path.join(self.root, f"{self.name}.store")

    def _open(self) -> None:
        try:
            os.makedirs(os.path.join(self.path, "manifest"), exist_ok=True)
        except (OSError, ValueError) as e:
            raise StoreError("2", f"LMDB error code: 2 ({e})") from e
        self.opened = True
        if not self._versions():
            self._publish(Manifest())

    def _require_open(self) -> None:
        if not self.opened:
            raise StoreError("1", CLOSED)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in os.listdir(os.path.join(self.path, "manifest")) if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or a given one."""
        self._require_open()
        v = self._versions()[-1] if version is None else version
        with open(os.path.join(self.path, "manifest", f"v{v}.json"), encoding="utf-8") as f:
            return Manifest.from_json(f.read())

    def _publish(self, m: Manifest) -> bool:
        """Makes `m` the manifest of its version; False if another writer was first. Readers never see half a file."""
        if (self._versions() or [m.version - 1])[-1] != m.version - 1:
            return False
        folder = os.path.join(self.path, "manifest")
        part = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as f:
            f.write(m.to_json())
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, os.path.join(folder, f"v{m.version}.json"))
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(part)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(os.path.abspath(self.path), name))
        return name

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(os.path.join(os.path.abspath(self.path), name))

    # -- reading -----------------------------------------------------------------------------------------------

    def log(self, m: Manifest) -> DataFrame:
        """The entries after the snapshot."""
        rows = self.spark.createDataFrame([tuple(r) for r in m.inline], LOG) if m.inline else None
        if m.parts:
            paths = [os.path.join(os.path.abspath(self.path), p) for p in m.parts]
            parts = self.spark.read.schema(LOG).parquet(*paths)
            rows = parts if rows is None else parts.unionByName(rows)
        return rows if rows is not None else self.spark.createDataFrame([], LOG)

    def _stored(self, m: Manifest) -> DataFrame:
        snapshot = self._read(m.snapshot, STORED) if m.snapshot else self.spark.createDataFrame([], STORED)
        if not m.parts and not m.inline:
            return snapshot
        return fold.state(fold.with_snapshot(snapshot, self.log(m)) if m.snapshot else self.log(m))

    def get(self, version: int | None = None) -> DataFrame:
        """All documents, as of a version if given; rows whose data can't be read are passed over."""
        return self._stored(self.manifest(version)).where("valid").select("id", "hash", "data_json")

    def _newest(self, m: Manifest, id_: str) -> tuple[bool, tuple | None] | None:
        """What the manifest's own entries say of a key: (exists, last value), or None if the files must be asked."""
        exists = value = None
        for _, op, key, hash_, data, valid in m.inline:
            if key == id_:
                exists = {"post": True, "delete": False}.get(op, exists)
                value = (hash_, data, valid) if op in ("post", "put") else value
        if exists is False or exists and value:
            return exists, value
        return None if m.parts or m.snapshot else (bool(exists), value)

    def _lookup(self, m: Manifest, id_: str) -> tuple[Record, bool] | None:
        """(document, whether its data is JSON)."""
        known = self._newest(m, id_)
        if known is None:
            rows = ops.get_by_id(self._stored(m), id_).take(1)
            known = (True, (rows[0]["hash"], rows[0]["data_json"], rows[0]["valid"])) if rows else (False, None)
        return (Record(id_, *known[1][:2]), bool(known[1][2])) if known[0] and known[1] else None

    def get_by_id(self, id_: str) -> Record | None:
        """The document of exactly this key; data that can't be read is an error."""
        self._require_open()
        if id_ == "":
            raise StoreError("BadValSize")
        found = self._lookup(self.manifest(), id_)
        if found is not None and not found[1]:
            raise StoreError("1", f"the stored value of {id_!r} can't be read")
        return found[0] if found else None

    # -- writing -----------------------------------------------------------------------------------------------

    def _append(self, m: Manifest, entries: list[tuple]) -> Manifest:
        seq = m.next_seq
        inline = m.inline + tuple((seq + i, *e) for i, e in enumerate(entries))
        new = replace(m, version=m.version + 1, inline=inline, next_seq=seq + len(entries))
        if len(inline) > INLINE_ROWS or sum(len(x or "") for r in inline for x in r[2:5]) > INLINE_BYTES:
            part = self._write(self.spark.createDataFrame([tuple(r) for r in inline], LOG).coalesce(1), "log")
            new = replace(new, inline=(), parts=m.parts + (part,))
        return new

    def _commit(self, decide) -> object:
        """decide(manifest) gives (result, new manifest or None); repeated until it is published on what it saw."""
        while True:
            m = self.manifest()
            result, new = decide(m)
            if new is None or self._publish(new):
                if new is not None and len(new.parts) > MAX_PARTS:
                    self.compact()
                if new is not None and new.version % EXPIRE_EVERY == 0:
                    self._expire(KEPT_VERSIONS)
                return result

    def post(self, record: Record) -> Record:
        """Inserts or replaces a document."""
        self._require_open()
        if not 0 < len(record.id.encode()) <= MAX_KEY:
            raise StoreError("BadValSize")
        return self._commit(lambda m: (record, self._append(m, [("post", record.id, record.hash, record.data_json, well_formed(record.data_json))])))

    def put(self, record: Record) -> Record | None:
        """Replaces an existing document as a whole; None and no write if there is none."""
        self._require_open()
        if record.id == "":
            raise StoreError("BadValSize")
        return self._commit(lambda m: (record, self._append(m, [("put", record.id, record.hash, record.data_json, well_formed(record.data_json))])) if self._lookup(m, record.id) else (None, None))

    def delete_by_id(self, id_: str) -> bool:
        """Whether there was a document to delete."""
        self._require_open()
        if id_ == "":
            raise StoreError("BadValSize")
        return self._commit(lambda m: (True, self._append(m, [("delete", id_, None, None, None)])) if self._lookup(m, id_) else (False, None))

    def clear_all_records(self) -> int:
        """Removes all documents and returns how many they were."""
        self._require_open()
        return self._commit(lambda m: (self._stored(m).count(), Manifest(m.version + 1, next_seq=m.next_seq, streams=m.streams)))

    def apply(self, batch: DataFrame, op: str, order: str = "seq", stream: tuple[str, int] | None = None) -> DataFrame | None:
        """Commits a batch (id, hash, data_json, and `order`) of one op as one version, equal to its rows one by one, and
        returns the response to each row: (`order`, id, status, message), a plan over the batch and the state before
        it. Rows whose key can't be written are errors there and not in the store.

        The rows stay distributed: they are written as a log part, numbered by their order within the key. With `stream`
        (name, number) a batch that is already in the store is passed over, and None returned."""
        self._require_open()
        if op not in ("post", "put", "delete"):
            raise ValueError(op)
        value = [F.col("hash"), F.col("data_json"), well_formed_column(F.col("data_json")).alias("valid")] if op != "delete" else [F.lit(None).cast(t).alias(c) for c, t in (("hash", "string"), ("data_json", "string"), ("valid", "boolean"))]
        good = ops.check_keys(batch.select("id", *(("hash", "data_json") if op != "delete" else ()), F.col(order).cast("long").alias("seq"))).where("status = 'Ok'").drop("status", "message")
        last = ops.last_of_each(good).select("id", "seq", *value)

        def decide(m: Manifest):
            if stream and dict(m.streams).get(stream[0], -1) >= stream[1]:
                return None, None
            rows = last.select(F.lit(m.next_seq).cast("long").alias("seq"), F.lit(op).alias("op"), "id", "hash", "data_json", "valid")
            if m.inline:
                rows = self.spark.createDataFrame([tuple(r) for r in m.inline], LOG).unionByName(rows)
            streams = tuple({**dict(m.streams), stream[0]: stream[1]}.items()) if stream else m.streams
            return m, replace(m, version=m.version + 1, inline=(), parts=m.parts + (self._write(rows, "log"),), next_seq=m.next_seq + 1, streams=streams)

        before = self._commit(decide)
        return None if before is None else ops.batch_responses(self._stored(before), batch, op, order)

    def compact(self) -> None:
        """Folds everything into a snapshot sorted by key, so that lookups skip most row groups."""

        def decide(m: Manifest):
            return None, Manifest(m.version + 1, self._write(self._stored(m).repartitionByRange("id").sortWithinPartitions("id"), "snapshot"), next_seq=m.next_seq, streams=m.streams)

        self._commit(decide)

    def _expire(self, keep: int) -> None:
        for v in self._versions()[:-keep]:
            try:
                os.remove(os.path.join(self.path, "manifest", f"v{v}.json"))
            except FileNotFoundError:
                pass

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> int:
        """Removes manifests but the newest `keep`, and the files that these do not name and that are older than
        `older_than` seconds (younger ones may belong to a commit on its way); returns how many files went. Readers of
        removed versions fail."""
        self._require_open()
        self._expire(max(keep, 1))
        named = {x for v in self._versions() for m in [self.manifest(v)] for x in (m.snapshot, *m.parts)}
        gone = 0
        for entry in os.scandir(self.path):
            if entry.name != "manifest" and entry.name not in named and entry.stat().st_mtime <= time.time() - older_than:
                shutil.rmtree(entry.path, ignore_errors=True)
                gone += 1
        return gone

    # -- lifecycle ---------------------------------------------------------------------------------------------

    def close_database(self) -> None:
        """Every commit is durable already; later operations fail. Closing twice is fine."""
        self.opened = False

    def reset_database(self, name: str) -> bool:
        """Removes this store's files and opens the store `name` instead, whose documents stay if it exists. Works on a
        closed handle too. The new store is opened first unless it is the same one."""
        old = self.path
        target = DocumentStore(self.spark, name, self.root)
        self.opened = False
        if os.path.abspath(target.path) == os.path.abspath(old):
            shutil.rmtree(old, ignore_errors=True)
            target._open()
        else:
            target._open()
            shutil.rmtree(old, ignore_errors=True)
        self.name, self.opened = name, True
        return True
