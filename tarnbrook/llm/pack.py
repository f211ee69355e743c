"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: pieces come in input order, those of a look-ahead of a fixed number from long to short; at
most `open_bins` sequences are open, kept in a bitset over their free space, so the tightest that still fits is the
lowest set bit at or above the piece's length. When no open sequence fits and all are in use, the fullest closes. Each task packs its own split and at its
end closes all but the `open_bins` emptiest sequences. What those hold goes, as pieces from long to short, to a next
level of tasks, each of which takes over from FAN_IN tasks and so has FAN_IN times as many open sequences, a fixed
number that holds all it can be given; the last level is one task. Only there sequences end partly filled for want
of input, so the result hardly depends on how the input is split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed
from .tokens import default_path, encoder

LENGTH, OPEN_BINS, FAN_IN = 2048, 512, 32
#: Pieces looked ahead for each open sequence. Many more would let long pieces close sequences before short ones fill them.
LOOK_AHEAD = 2
SCHEMA = "doc_id long, piece int, start long, length long, sequence_id long, offset long, still_open boolean, ids binary"


class OpenBins:
    """Sequences that still take pieces, under a bitset keyed by free space."""

    def __init__(self, length: int = LENGTH, limit: int = OPEN_BINS):
        self.length, self.limit = length, limit
        self.mask = self.count = 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        own = self.by_free[free]
        items = own.pop()
        if not own:
            del self.by_free[free]
            self.mask ^= 1 << free
        self.count -= 1
        return items

    def _store(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.mask |= 1 << free
        self.count += 1

    def add(self, size: int, item) -> list | None:
        """Places an item; returns the items of a sequence that this closes, if it does."""
        closed = None
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.count >= self.limit:
                closed = self._take((self.mask & -self.mask).bit_length() - 1)
            free, items = self.length, []
        items.append(item)
        if free == size:
            return items if closed is None else closed + [None] + items
        self._store(free - size, items)
        return closed

    def rest(self) -> list[list]:
        return [items for free in sorted(self.by_free) for items in self.by_free[free]]


def pieces_of(doc_id, ids: bytes, length: int) -> list[tuple]:
    """(doc_id, piece, start, length, ids): only a document longer than `length` is cut; its first piece takes the
    remainder, the others are full."""
    n = len(ids) // 4
    cuts = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
    return [(doc_id, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


class _Writer:
    def __init__(self, level: int):
        self.base = (level << 56) | ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 28)
        self.made, self.rows = 0, []

    def put(self, items: list, still_open: bool) -> None:
        for one in _split(items):
            at = 0
            for doc_id, piece, start, n, ids in one:
                self.rows.append((doc_id, piece, start, n, self.base + self.made, at, still_open, ids))
                at += n
            self.made += 1

    def batches(self, least: int):
        if len(self.rows) > least:
            cols = list(zip(*self.rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            self.rows = []
            for i in range(0, len(cols[0]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 2000], k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "sequence_id", "offset", "still_open", "ids"])


def _split(items: list):
    one: list = []
    for x in items:
        if x is None:
            yield one
            one = []
        else:
            one.append(x)
    yield one


def looked_ahead(pieces, size_of, most: int):
    """The pieces, those of each `most` in a row from long to short."""
    held: list = []
    for p in pieces:
        held.append(p)
        if len(held) >= most:
            held.sort(key=size_of, reverse=True)
            yield from held
            held = []
    held.sort(key=size_of, reverse=True)
    yield from held


def _pack(source, level: int, length: int, open_bins: int, handed_on: int):
    """source(batch) gives the pieces of an Arrow batch; the `handed_on` emptiest sequences stay open at the end."""

    def run(batches):
        bins, out = OpenBins(length, open_bins), _Writer(level)
        for p in looked_ahead((p for b in batches for p in source(b)), lambda p: p[3], 1 if level else LOOK_AHEAD * open_bins):
            closed = bins.add(p[3], p)
            if closed:
                out.put(closed, False)
            if len(out.rows) > 2000:
                yield from out.batches(2000)
        for i, items in enumerate(reversed(bins.rest())):
            out.put(items, i < handed_on)
        yield from out.batches(0)

    return trimmed(run)


def _tokenised(path: str, length: int):
    def source(b):
        doc_ids = iter(b.column("doc_id").to_pylist())
        for ids, sizes in encoder(path).encode(b.column("text")):
            body, at = ids.tobytes(), 0
            for n in (4 * sizes).tolist():
                yield from pieces_of(next(doc_ids), body[at : at + n], length)
                at += n

    return source


def _again(b):
    return zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids")))


def pack(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, ids): one row for each piece of a document, placed in a
    sequence of at most `length` tokens; `ids` are the piece's token ids, little-endian unsigned 32-bit.

    A document's ids end with id 0. Null and empty texts are that one id. Repeated rows are packed as often as
    they come; a null doc_id stays null. No rows: an empty table. Other columns are not read. The rows of a task
    and so its sequences are the same on every attempt: the first level follows the order of its split, later
    levels sort what they take."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n, level, done = src.rdd.getNumPartitions(), 0, None
    placed = src.mapInArrow(_pack(_tokenised(tokenizer or default_path(), length), 0, length, open_bins, open_bins), SCHEMA)
    while level == 0 or n > 1:
        table = materialize(placed, f"packed-{level}")
        closed = table.where("not still_open")
        done = closed if done is None else done.unionByName(closed)
        n, level = max(1, -(-n // FAN_IN)), level + 1
        task = F.shiftright("sequence_id", 28).bitwiseAND((1 << 28) - 1)
        ordered = table.where("still_open").repartitionById(n, F.pmod(task, F.lit(n)).cast("int")).sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
        placed = ordered.mapInArrow(_pack(_again, level, length, FAN_IN * open_bins, open_bins if n > 1 else 0), SCHEMA)
    out = done.unionByName(placed)
    return out.drop("still_open")
