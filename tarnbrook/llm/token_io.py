"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are counted over all documents once; the ranking, from the most frequent id to the rarest, is a file of the folder
(at most the vocabulary), and every shard is written in it, so the 256 most frequent ids of the corpus take one byte
everywhere. Each document is coded on its own: a control byte for each four ids (two bits an id: its number of data
bytes less one), and the data bytes of the ranks; so coded documents travel through the shuffle and a shard only puts
them one after the other.

Format of a shard (little-endian): 8 bytes magic, u32 version, u32 CRC-32 of the ranking, u64 number of documents, u64
number of ids, then the doc_ids (i64) with a byte each for null, the number of ids of each document (u32), all control
bytes, all data bytes, and the CRC-32 of all this. The ranking: 8 bytes magic, u64 number of ids, the ids (u32), CRC-32.

Shards are written in ascending order of doc_id: ranges of doc_id are dealt to tasks, each sorts its own, and cuts
it into shards of a bounded number of ids. A doc_id (or null) of more rows than a range is dealt over as many tasks
as it fills, by its rows' ids."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .common import materialize, new_path, partitions_for, release, trimmed
from .tokens import default_path, encoder

MAGIC, VERSION, RANKING, RANKING_FILE = b"RANKIDS\0", 2, b"RANKING\0", "ranking.bin"
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def _slots(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each id of documents of these sizes its place in their control bytes, end of each document's bytes)."""
    control_ends = np.cumsum(-(-sizes // 4), dtype=np.int64)
    first = 4 * (control_ends + sizes // -4)
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), control_ends


def encode_documents(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their end for each document, data bytes, their end for each document) of the unsigned 32-bit
    ranks of documents of these sizes, one after the other."""
    sizes, ranks = np.asarray(sizes, dtype=np.int64), np.ascontiguousarray(ranks, dtype="<u4")
    slots, control_ends = _slots(sizes)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(4 * int(control_ends[-1]) if len(sizes) else 0, dtype=np.uint8)
    padded[slots] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) <= extra[:, None]
    bytes_to = np.concatenate(([0], np.cumsum(extra + np.int64(1))))
    return control.astype(np.uint8), control_ends, ranks.view(np.uint8).reshape(-1, 4)[kept], bytes_to[np.cumsum(sizes)]


def decode_documents(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks back: a table lookup gives the four lengths of each control byte, sums of them the places."""
    lengths = _LENGTHS[control].reshape(-1)[_slots(np.asarray(sizes, dtype=np.int64))[0]]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 3, 4), (1, 1))
    taken = np.ascontiguousarray(words[ends - lengths]).view("<u4").reshape(-1)
    return taken & _MASKS[lengths - 1]


def _checked(body: bytes, magic: bytes) -> memoryview:
    if body[:8] != magic:
        raise ValueError("not a token file of this kind")
    if zlib.crc32(memoryview(body)[:-4]) != np.frombuffer(body, "<u4", 1, len(body) - 4)[0]:
        raise ValueError("the token file is damaged: its checksum differs")
    return memoryview(body)[:-4]


def ranking_body(id_of: np.ndarray) -> bytes:
    body = RANKING + np.array([len(id_of)], "<u8").tobytes() + id_of.astype("<u4").tobytes()
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def read_ranking(body: bytes) -> np.ndarray:
    """The ids by rank."""
    return np.frombuffer(_checked(body, RANKING), "<u4", -1, 16)


def write_shard(out, doc_ids: list, sizes: list[int], control: list[bytes], data: list[bytes], ranking_crc: int) -> int:
    """Writes coded documents to a binary file object; returns the number of ids."""
    total = sum(sizes)
    body = b"".join([
        MAGIC, np.array([VERSION, ranking_crc], "<u4").tobytes(), np.array([len(doc_ids), total], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(sizes, "<u4").tobytes(), *control, *data,
    ])
    out.write(body)
    out.write(np.array([zlib.crc32(body)], "<u4").tobytes())
    return total


def read_shard(body: bytes, id_of: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids) of a shard, by the ranking it was written in."""
    _checked(body, MAGIC)
    version, crc = np.frombuffer(body, "<u4", 2, 8).tolist()
    if version != VERSION or crc != zlib.crc32(id_of.astype("<u4").tobytes()):
        raise ValueError("a token shard of another version or ranking")
    docs, n = np.frombuffer(body, "<u8", 2, 16).tolist()
    doc_ids, null = np.frombuffer(body, "<i8", docs, 32), np.frombuffer(body, np.uint8, docs, 32 + 8 * docs)
    at = 32 + 9 * docs
    sizes = np.frombuffer(body, "<u4", docs, at)
    at += 4 * docs
    control = np.frombuffer(body, np.uint8, int((-(-sizes.astype(np.int64) // 4)).sum()), at)
    data = np.frombuffer(body, np.uint8, len(body) - 4 - at - len(control), at + len(control))
    ranks = decode_documents(control, data, sizes)
    if len(ranks) != n:
        raise ValueError("a token shard of another number of ids")
    return [None if z else d for d, z in zip(doc_ids.tolist(), null)], sizes, id_of[ranks]


#: Ids of a shard.
SHARD_IDS = 4_000_000
#: What a row without doc_id is ordered as.
NULL_ID = -(1 << 63)


def _slices(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the stretches of `flat` that end at `ends` (items)."""
    to = np.concatenate(([0], ends)).astype(np.int64) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(to), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _encode(path: str, width: str, cuts):
    """Ids of each document, with the range of doc_id that it falls in; documents without doc_id are in the first. Equal
    cuts are ranges of one doc_id, over which its rows are spread. At the end a row with the task's counts of ids."""

    def run(batches):
        counts = np.zeros(0, dtype=np.int64)
        for b in batches:
            ids_of = b.column("doc_id")
            keys = ids_of.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts.value, keys, side="left").astype(np.int32)
            spread = np.maximum(np.searchsorted(cuts.value, keys, side="right") - part, 1)
            at = 0
            for ids, sizes in encoder(path).encode(b.column("text")):
                here = slice(at, at + len(sizes))
                at += len(sizes)
                ends = np.cumsum(sizes)
                for i in np.flatnonzero(spread[here] > 1).tolist():
                    part[here.start + i] += zlib.crc32(ids[ends[i] - sizes[i] : ends[i]].tobytes()) % int(spread[here.start + i])
                found = np.bincount(ids, minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
                yield pa.RecordBatch.from_arrays([pa.array(part[here]), ids_of.slice(here.start, len(sizes)), _slices(ids.astype(width), ends), pa.nulls(len(sizes), pa.binary())], ["part", "doc_id", "ids", "counts"])
        some = np.flatnonzero(counts)
        own = some.astype("<u4").tobytes() + counts[some].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([own], pa.binary())], ["part", "doc_id", "ids", "counts"])

    return trimmed(run)


def _unpack(batches):
    for b in batches:
        for own in b.column("counts").to_pylist():
            n = len(own) // 12
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(own, "<u8", n, 4 * n).astype(np.int64))], ["id", "n"])


def _code(width: str, rank_of):
    def run(batches):
        for b in batches:
            ids = b.column("ids")
            offsets = np.frombuffer(ids.cast(pa.large_binary()).buffers()[1], np.int64)[: len(ids) + 1]
            sizes = np.diff(offsets) // np.dtype(width).itemsize
            flat = np.frombuffer(b"".join(ids.to_pylist()), width)
            control, control_ends, data, data_ends = encode_documents(rank_of.value[flat], sizes)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), pa.array(sizes), _slices(control, control_ends), _slices(data, data_ends)], ["part", "doc_id", "n", "control", "data"])

    return trimmed(run)


def _write(folder: str, ranking_crc: int, most: int):
    def run(batches):
        part, seq, held, size = None, 0, [], 0
        made = []

        def flush():
            path = f"{folder}/ids-{part:06d}-{seq:05d}.bin"
            with storage.create(path) as out:
                made.append((path, part, seq, len(held), write_shard(out, *map(list, zip(*held)), ranking_crc)))

        for b in batches:
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "control", "data"))):
                if held and (p != part or size >= most):
                    flush()
                    seq = seq + 1 if p == part else 0
                    held, size = [], 0
                part = p
                held.append(row)
                size += row[1]
        if held:
            flush()
        cols = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["path", "part", "seq", "documents", "n_ids"])

    return trimmed(run)


def write_ids(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the texts and writes the ranking and the shards to `folder` (of its own in the shared folder if not given);
    returns (path, part, seq, documents, n_ids), a row for each shard.

    A document's ids end with id 0; a null or empty text is that one id. Rows without doc_id come first. Repeated
    rows are written as often as they come, next to each other. No rows: no shards. Other columns are not read. A
    second attempt of a task writes the same files again."""
    spark = docs.sparkSession
    path, folder = tokenizer or default_path(), folder or new_path(spark, "token-ids")
    vocabulary = encoder(path).tokenizer.get_vocab_size()
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = partitions_for(src)
    shares = F.lit(np.arange(1, max(n, 2)) / max(n, 2))
    found = src.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NULL_ID)), shares, max(10_000, 4 * n))).first()[0] or []
    cuts = spark.sparkContext.broadcast(np.array(sorted(found), dtype=np.int64))
    raw = materialize(src.mapInArrow(_encode(path, width, cuts), "part int, doc_id long, ids binary, counts binary"), "token-raw")
    counts = raw.where("counts is not null").select("counts").mapInArrow(_unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, times = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    id_of = ids[np.lexsort((ids, -times))].astype("<u4")
    with storage.create(f"{folder}/{RANKING_FILE}") as out:
        out.write(ranking_body(id_of))
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, dtype="<u4")
    rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
    coded = raw.where("ids is not null").select("part", "doc_id", "ids").mapInArrow(_code(width, spark.sparkContext.broadcast(rank_of)), "part int, doc_id long, n long, control binary, data binary")
    ordered = coded.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n", "control", "data")
    shards = materialize(ordered.mapInArrow(_write(folder, zlib.crc32(id_of.tobytes()), shard_ids), "path string, part int, seq int, documents long, n_ids long"), "token-shards")
    release(spark, raw)
    return shards


@lru_cache(4)
def _ranking_of(folder: str) -> np.ndarray:
    with storage.open_input(f"{folder}/{RANKING_FILE}") as f:
        return read_ranking(f.read())


def _read(batches):
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            with storage.open_input(path) as f:
                doc_ids, lengths, ids = read_shard(f.read(), _ranking_of(path.rpartition("/")[0]))
            ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            flat = np.ascontiguousarray(ids, dtype="<u4")
            for i in range(0, len(doc_ids), 2000):
                e = ends[i : i + 2001]
                own = pa.Array.from_buffers(pa.large_binary(), len(e) - 1, [None, pa.py_buffer((e - e[0]) * 4), pa.py_buffer(flat[e[0] : e[-1]].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i : i + 2000], pa.int64()), pa.array(start + e[:-1]), own], ["doc_id", "start", "ids"])


def read_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents in the shards that write_ids() tells of: `start` counts the ids of all
    documents before it, `ids` are little-endian unsigned 32-bit. The running sum is over shards, not documents."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.select("path", "start").repartition(partitions_for(shards, 1), "path").mapInArrow(_read, "doc_id long, start long, ids binary")
