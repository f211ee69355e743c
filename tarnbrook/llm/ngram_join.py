"""N-gram Jaccard join: which texts share at least 75 % of their distinct word shingles, and the groups they form.

A blocked sparse product of the document by n-gram incidence matrix, in which a pair of rows is dropped as soon as
bounds from sizes show that its overlap can't reach the threshold:

1. Scan: the distinct shingles of each text; texts with the same set are one row of the matrix from then on. A bounded
   sample of the rows tells which columns are hot. Their counts are estimated, which changes the order of columns and
   never a result; so no column's postings meet in one task beyond a small share of the rows.
2. Column blocks (hash ranges, each of a size that fits one task) count the other columns; a column that only one row
   holds can't add to an overlap and goes.
3. Row blocks: each row sorts its columns from rare to frequent. A row of n shingles can reach the threshold only with
   rows that share one of its first n - ceil(t n) + 1 columns (unshared ones first), so a row whose unshared columns
   fill that prefix is settled here. Only the product of these prefixes makes candidates.
4. The overlap of a candidate pair is summed up column block by column block; the pair goes when what it has and all
   that is left of either row stay below the bound. Candidates are first each row and one pivot per column; then,
   where a column still holds rows of different groups, the rows outside the column's largest group and those that
   their size and position leave possible. Rows that a pivot has joined are not compared with each other, so a group
   of n copies costs about n products and no link between groups is lost. Groups are merged after each round, and
   later rounds see merged groups only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_shuffles, materialize, partitions_for, trimmed
from .graph import connected_components
from .words import chunks, hash_prefix, mix64, span_hash, string_buffers, word_spans

_U = np.uint64
_SPACE = np.ones(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Rows of the sample that tells of hot columns, most of them from a task, most shingles of one; a column is hot if at
#: least HOT_ROWS and a HOT_SHARE of the sample hold it, so there are at most shingles per row / HOT_SHARE of them.
SAMPLE_ROWS, SAMPLE_OF_TASK, SAMPLE_SHINGLES, HOT_ROWS, HOT_SHARE = 65_536, 128, 100_000, 4, 1 / 4096
#: Bits of the hash that number the column blocks in which overlaps are summed up.
BLOCK_BITS = 3
#: Hashes held before a task emits its blocks, and hashes for each block at least, so that blocks are worth a row:
#: bounds its memory, not its work.
FLUSH, PER_BLOCK = 500_000, 4


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending. With fewer words than `words` the whole sequence is
    the one shingle; without words the set is empty."""
    out: list[np.ndarray] = []
    none = np.zeros(0, dtype=_U)
    for lo, hi in chunks(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at, _SPACE)
        h = span_hash(hash_prefix(part), starts, ends)
        weights = mix64(np.arange(1, words + 1, dtype=_U))
        grams = h[: max(0, len(h) - words + 1)] * weights[0]
        for j in range(1, words):
            grams = grams + h[j : len(h) - words + 1 + j] * weights[j]
        grams = mix64(grams)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                s = np.sort(grams[a : b - words + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                total = (h[a:b] * weights[: b - a]).sum(dtype=_U)
                out.append(mix64(np.array([total + _U(b - a)], dtype=_U)))
            else:
                out.append(none)
    return out


def set_digest(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit digests of a shingle set; the first, cut to `bits` bits, is its key while that tells sets apart."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    key = int.from_bytes(d[:8], "little", signed=True)
    return (key if bits == 64 else key & ((1 << bits) - 1)), int.from_bytes(d[8:], "little", signed=True)


def _renamed(key: int, check: int) -> int:
    """The key of a set whose first digest another set has too."""
    return int.from_bytes(hashlib.blake2b(f"{key},{check}".encode(), digest_size=8).digest(), "little", signed=True)


_SCANNED = "doc_id long, n_shingles long, key long, check long, column long, held long"


def _scan(words: int, texts: str, sample: int, bits: int):
    """A row for each text; then the columns of the task's sample with their counts, and (n_shingles -1) its size. The
    sample is of the rows with the least keys."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        worst = -1

        def rows(doc, n, key, check, has, column, count):
            mask = ~np.asarray(has, bool)
            return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(key, pa.int64(), mask=mask), pa.array(check, pa.int64(), mask=mask), column, count], ["doc_id", "n_shingles", "key", "check", "column", "held"])

        def others(n, column, count):
            z, none = np.zeros(len(n), dtype=np.int64), pa.nulls(len(n), pa.int64())
            return rows(none, n, z, z, z > 0, none if column is None else pa.array(column, pa.int64()), pa.array(count, pa.int64()))

        for b in batches:
            sets = shingle_sets(*string_buffers(b.column(texts)), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            key, check = (np.array(x, dtype=np.int64) for x in zip(*(set_digest(s, bits) for s in sets))) if sets else (n, n)
            yield rows(b.column("doc_id").cast(pa.int64()), n, key, check, n > 0, pa.nulls(len(n), pa.int64()), b.column("digest").cast(pa.int64()))
            for k, s in zip(key.view(_U).tolist(), sets):
                if 0 < len(s) <= SAMPLE_SHINGLES and k not in held and (len(held) < sample or k < worst):
                    held[k] = s
                    if len(held) > sample:
                        del held[worst]
                    worst = max(held)
        if held:
            column, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            for i in range(0, len(column), 50_000):
                part = slice(i, i + 50_000)
                yield others(np.zeros(len(column[part]), np.int64), column[part].view(np.int64), count[part])
            yield others(np.array([-1]), None, np.array([len(held)]))

    return trimmed(run)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the 64-bit values as numbers below n."""
    return (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.uint16 if n <= 1 << 16 else np.uint32)


_BLOCK = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def _block_rows(to, kind, bodies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(bodies, pa.binary())], schema=_BLOCK)


def _by_row(keys: np.ndarray, h: np.ndarray, df: np.ndarray, n_rows: int) -> tuple[list[int], list[bytes]]:
    """Postings dealt by row block: (block, body), with a body of keys, columns and counts."""
    to = _bucket(keys, n_rows)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1)) if len(order) else []
    blocks, bodies = [], []
    for i, at in enumerate(cuts):
        sel = order[at : cuts[i + 1] if i + 1 < len(cuts) else len(order)]
        blocks.append(int(to[sel[0]]))
        bodies.append(np.uint64(len(sel)).tobytes() + keys[sel].tobytes() + h[sel].tobytes() + df[sel].astype(np.uint32).tobytes())
    return blocks, bodies


def _open_by_row(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, _U, 1)[0])
    return np.frombuffer(body, _U, n, 8), np.frombuffer(body, _U, n, 8 + 8 * n), np.frombuffer(body, np.uint32, n, 8 + 16 * n)


def _run_body(keys: np.ndarray, counts: np.ndarray, columns: np.ndarray) -> bytes:
    """Postings of a column block: rows, how many columns each has there (a byte, if that is enough for all), columns."""
    width = np.uint8 if counts.max() < 1 << 8 else np.uint32
    return np.array([len(keys), np.dtype(width).itemsize], _U).tobytes() + keys.tobytes() + counts.astype(width).tobytes() + columns.tobytes()


def _open_run(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each posting."""
    n, width = np.frombuffer(body, _U, 2).tolist()
    counts = np.frombuffer(body, f"<u{width}", n, 16 + 8 * n)
    at = 16 + (8 + width) * n
    return np.repeat(np.frombuffer(body, _U, n, 16), counts), np.frombuffer(body, _U, (len(body) - at) // 8, at)


def _postings(words: int, texts: str, shared, n_cols: int, n_rows: int, bits: int):
    """Blocks by column (kind 0: columns that aren't hot) and by row (kind 1: hot columns with their estimated counts,
    and under count 0 the size of each row). `shared` has the hot columns in ascending order, their counts, and new
    keys by the digests of sets whose key is taken."""

    def run(batches):
        hot, estimate, renames = shared.value
        held: list[np.ndarray] = []
        keys: list[int] = []
        seen: set[int] = set()
        size = 0

        def flush():
            key = np.array(keys, dtype=np.int64).view(_U)
            counts = np.array([len(s) for s in held], dtype=np.int64)
            h, d = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), counts)
            place = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
            is_hot = hot[place] == h if len(hot) else np.zeros(len(h), bool)
            blocks, bodies = _by_row(np.concatenate((key, key[d[is_hot]])), np.concatenate((counts.astype(_U), h[is_hot])), np.concatenate((np.zeros(len(key), np.uint32), estimate[place[is_hot]] if len(hot) else estimate)), n_rows)
            yield _block_rows([b % n_cols for b in blocks], [1 + b for b in blocks], bodies)
            h, d = h[~is_hot], d[~is_hot]
            to = _bucket(h, n_cols)
            order = np.argsort(to, kind="stable")
            h, d, to = h[order], d[order], to[order]
            cuts = np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1))
            blocks, bodies = [], []
            for i, at in enumerate(cuts):
                end = cuts[i + 1] if i + 1 < len(cuts) else len(h)
                own = d[at:end]
                rows = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
                blocks.append(int(to[at]))
                bodies.append(_run_body(key[own[rows]], np.diff(np.append(rows, len(own))), h[at:end]))
            if blocks:
                yield _block_rows(blocks, [0] * len(blocks), bodies)

        for b in batches:
            for s in shingle_sets(*string_buffers(b.column(texts)), words):
                if not len(s):
                    continue
                both = set_digest(s, bits)
                k = renames.get(both, both[0])
                if k in seen:
                    continue
                seen.add(k)
                keys.append(k)
                held.append(s)
                size += len(s)
                if size >= max(FLUSH, PER_BLOCK * n_cols):
                    yield from flush()
                    held, keys, size = [], [], 0
        if held:
            yield from flush()

    return trimmed(run)


def _count_columns(n_rows: int):
    """A block of columns: drops those of one row, deals the others to the row blocks with their counts."""

    def run(batches):
        h, k = [], []
        for b in batches:
            through = []
            for kind, body in zip(b.column("kind").to_pylist(), b.column("body")):
                body = body.as_py()
                if kind:
                    through.append((kind - 1, body))
                    continue
                keys, columns = _open_run(body)
                k.append(keys)
                h.append(columns)
            if through:
                yield _block_rows([t for t, _ in through], [1] * len(through), [x for _, x in through])
        if not h:
            return
        h, k = np.concatenate(h), np.concatenate(k)
        order = np.argsort(h)
        h, k = h[order], k[order]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        h, k = h[keep], k[keep]
        del same, keep, order
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[fresh], k[fresh]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(at, len(h))), np.diff(np.append(at, len(h))))
        many = df > 1
        blocks, bodies = _by_row(k[many], h[many], df[many], n_rows)
        if blocks:
            yield _block_rows(blocks, [1] * len(blocks), bodies)

    return trimmed(run)


_ROWS = "key long, n long, alone long, prefix array<long>, blocks array<array<long>>"


def _rows(percent: int):
    """A block of rows: for each row that its unshared columns don't settle its size, how many of its columns no other row
    has, its prefix from rare to frequent, and its shared columns by column block."""

    def run(batches):
        k, h, df = [], [], []
        for b in batches:
            for body in b.column("body"):
                for out, x in zip((k, h, df), _open_by_row(body.as_py())):
                    out.append(x)
        if not k:
            return
        k, h, df = np.concatenate(k), np.concatenate(h), np.concatenate(df)
        order = np.lexsort((h, df, k))
        k, h, df = k[order], h[order], df[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (df[1:] != df[:-1]) | (h[1:] != h[:-1])
        k, h, df = k[fresh], h[fresh], df[fresh]
        at = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))
        n, shared = h[at[:-1]].astype(np.int64), np.diff(at) - 1  # count 0 sorts first: the size of the row
        most = n - (percent * n + 99) // 100 + 1 - (n - shared)
        for part in np.array_split(np.flatnonzero(most > 0), max(1, -(-int((most > 0).sum()) // 2000))):
            if not len(part):
                continue
            lists = [h[at[i] + 1 : at[i + 1]] for i in part.tolist()]
            prefix = np.minimum(most[part], shared[part])
            columns, row = np.concatenate(lists), np.repeat(np.arange(len(part)), shared[part])
            cell = row * (1 << BLOCK_BITS) + (columns >> _U(64 - BLOCK_BITS)).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=len(part) << BLOCK_BITS)))).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(columns[np.argsort(cell, kind="stable")].view(np.int64)))
            heads = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(prefix))).astype(np.int32)), pa.array(np.concatenate([x[:m] for x, m in zip(lists, prefix.tolist())]).view(np.int64)))
            blocks = pa.ListArray.from_arrays(pa.array((np.arange(len(part) + 1) << BLOCK_BITS).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([pa.array(k[at[part]].view(np.int64)), pa.array(n[part]), pa.array((n - shared)[part]), heads, blocks], ["key", "n", "alone", "prefix", "blocks"])

    return trimmed(run)


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, and more) those that reach the threshold. The overlap is summed up block by block, and no further
    once it can't reach the bound with all that is left of either row."""
    x = rows.select(F.col("key").alias("a"), F.col("n").alias("na"), (F.col("n") - F.col("alone")).alias("sa"), F.col("blocks").alias("ba"))
    y = rows.select(F.col("key").alias("b"), F.col("n").alias("nb"), (F.col("n") - F.col("alone")).alias("sb"), F.col("blocks").alias("bb"))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    state = lambda o, a, b: F.struct(o.cast("long").alias("o"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def add(s, block):
        more = state(s.o + F.size(F.array_intersect(block.ba, block.bb)), s.a - F.size(block.ba), s.b - F.size(block.bb))
        return F.when(s.o + F.least(s.a, s.b) < need, s).otherwise(more)

    overlap = F.aggregate(F.arrays_zip("ba", "bb"), state(F.lit(0), F.col("sa"), F.col("sb")), add, lambda s: s.o)
    both = pairs.join(x, "a").join(y, "b").withColumn("both", overlap)
    return both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select(pairs.columns)


def _mixed(open_: DataFrame) -> DataFrame:
    """(col, major): columns that rows of different groups hold, with the group of most rows. Written apart, as pivots are."""
    sizes = open_.groupBy("col", "label").agg(F.count("*").alias("size"))
    both = sizes.groupBy("col").agg(F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
    return materialize(both.select("col", F.col("m.label").alias("major")), "ngram-mixed")


def _with_pivots(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each row and the pivot of each of its columns, if they are of different groups. Rows with few columns of
    their own lie in the middle of their group and are pivots first; later rounds try others. The pivots are written
    apart, so that the join on a hot column is not tied to the aggregate's partitions and can be split."""
    rank = F.col("alone") / F.col("n") if turn == 0 else F.xxhash64("key", F.lit(turn))
    best = open_.groupBy("col").agg(F.min(F.struct(rank.alias("r"), "key", "n", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    pivot = materialize(best.select("col", F.col("p.key").alias("key2"), F.col("p.n").alias("n2"), F.col("p.label").alias("label2")), "ngram-pivots")
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return open_.join(pivot, "col").where((F.col("label") != F.col("label2")) & alike)


def _across_groups(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of different groups that share a column. Those outside the column's largest group look for partners
    in classes of size; the largest size that a partner can have follows from what is left of the row after the
    column, so that rows which only share a common passage meet no others of their size."""
    class_of = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) * 4).cast("int")
    room = F.col("n") - F.col("pos")
    rows = (open_ if "major" in open_.columns else open_.join(_mixed(open_), "col")).withColumn("reach", F.floor(room * (100 + percent) / percent) - F.col("n"))
    least, most = F.ceil(percent * F.col("n") / 100), F.least(F.floor(100 * F.col("n") / percent), F.col("reach"))
    minor = rows.where(F.col("label") != F.col("major")).withColumn("least", least).withColumn("most", most).where("most >= least")
    probe = minor.withColumn("class", F.explode(F.sequence(class_of(F.col("least")), class_of(F.col("most")))))
    other = rows.select("col", class_of(F.col("n")).alias("class"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("reach").alias("reach2"))
    fits = (F.col("n2") >= F.col("least")) & (F.col("n2") <= F.col("most")) & (F.col("n") <= F.col("reach2"))
    return probe.join(other, ["col", "class"]).where((F.col("label") != F.col("label2")) & fits)


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text", star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id): the groups of documents that links join, component_id being the smallest
    doc_id of the group.

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r; A-Z counts as a-z. Two documents link when
    100 * intersection >= percent * union of their distinct shingles. Null, empty and blank texts: n_shingles 0, a
    group of their own. Repeated rows are returned as often as they come and share a group. A null doc_id stays null
    and is nobody's component_id unless all of its group are null. No rows: an empty table. Other columns are not
    read. Shingles are identified by 64-bit hashes, sets by 128 bits."""
    return _groups(docs, words, percent, text, star_rounds).select("doc_id", "n_shingles", "component_id")


def _groups(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text", star_rounds: int = 2, key_bits: int = 64) -> DataFrame:
    """What jaccard_groups() returns, with a digest of the row's text and the label of its group (null: no words)."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = max(1, min(SAMPLE_OF_TASK, -(-SAMPLE_ROWS // max(1, src.rdd.getNumPartitions()))))
    scanned = materialize(src.withColumn("digest", F.xxhash64("text")).mapInArrow(_scan(words, "text", sample, key_bits), _SCANNED), "ngram-scan")
    per_doc = scanned.where("column is null and n_shingles >= 0").select("doc_id", "n_shingles", "key", "check", F.col("held").alias("digest"))
    sets = materialize(per_doc.where("key is not null").groupBy("key", "check").agg(F.min("doc_id").alias("least")), "ngram-sets")

    # Sets whose key another set has: about n^2 / 2^65 of n sets.
    taken = sets.groupBy("key").agg(F.min("check").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    renames = {(r["key"], r["check"]): _renamed(r["key"], r["check"]) for r in sets.join(taken, "key").where("check <> first").select("key", "check").collect()}
    if renames:
        named = spark.createDataFrame([(k, c, new) for (k, c), new in renames.items()], "key long, check long, new long")
        rename = lambda d: d.join(F.broadcast(named), ["key", "check"], "left").withColumn("key", F.coalesce("new", "key")).drop("new")
        per_doc, sets = rename(per_doc), rename(sets)

    sampled = scanned.where("n_shingles = -1").agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    found = scanned.where("column is not null").groupBy("column").agg(F.sum("held").alias("held")).where(F.col("held") >= max(HOT_ROWS, int(sampled * HOT_SHARE))).toArrow()
    hot, held = found.column("column").to_numpy().view(_U), found.column("held").to_numpy()
    order = np.argsort(hot)
    estimate = np.clip(held[order] * (sets.count() / max(sampled, 1)), 2, (1 << 32) - 1).astype(np.uint32)
    shared = spark.sparkContext.broadcast((hot[order], estimate, renames))
    n_blocks = partitions_for(src, 1.5)
    blocks = src.select("text").mapInArrow(_postings(words, "text", shared, n_blocks, n_blocks, key_bits), "to int, kind int, body binary")
    counted = blocks.repartition(n_blocks, "to").mapInArrow(_count_columns(n_blocks), "to int, kind int, body binary")
    rows = materialize(counted.repartition(n_blocks, "to").mapInArrow(_rows(percent), _ROWS), "ngram-rows")
    del blocks, counted
    forget_shuffles(spark)
    placed = rows.select("key", "n", "alone", F.posexplode("prefix").alias("pos", "col"))
    open_ = materialize(placed.select("col", "key", "n", "alone", (F.col("alone") + F.col("pos")).cast("int").alias("pos"), F.col("key").alias("label")), "ngram-postings")

    moves = []
    for turn in range(star_rounds + 1):
        near = _with_pivots(open_, turn, percent) if turn < star_rounds else _across_groups(open_, percent)
        swap = F.col("key") > F.col("key2")
        of = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one))  # noqa: E731, B023
        pairs = near.select(of("key", "key2").alias("a"), of("key2", "key").alias("b"), of("label", "label2").alias("la"), of("label2", "label").alias("lb")).distinct()
        links = _linked(pairs, rows, percent).select("la", "lb").distinct()
        step = connected_components(links, "la", "lb")
        moves.append(step)
        if turn < star_rounds:
            to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            merged = materialize(open_.drop("major").join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "ngram-merged")
            open_ = materialize(merged.join(_mixed(merged), "col"), "ngram-open")

    forget_shuffles(spark)
    named = sets.select("key", "least", F.col("key").alias("label"))
    for step in moves:
        to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        named = named.join(to, "label", "left").select("key", "least", F.coalesce("to", "label").alias("label"))
    named = materialize(named, "ngram-labels")
    # Written apart, so that the join on a hot label is not tied to the aggregate's partitions and can be split.
    groups = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "ngram-groups")
    by_key = named.join(groups, "label").select("key", "component_id", "label")
    blank = per_doc.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "digest", F.lit(None).cast("long").alias("label"))
    return per_doc.where("key is not null").join(by_key, "key").select("doc_id", "n_shingles", "component_id", "digest", "label").unionByName(blank)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id; of its repeated rows one, and of texts of the group
    that share this doc_id that with the least digest. Texts of different groups stay, also under one doc_id. Rows
    without doc_id can't be told apart and stay. The columns as they came."""
    first = _groups(docs).where("doc_id = component_id").select("doc_id", "digest", "label")
    linked = first.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("f")).select("f.doc_id", "f.digest")
    kept = linked.unionByName(first.where("label is null").select("doc_id", "digest")).select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    names, digest = docs.columns, "digest of the text"
    with_digest = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))
    found = with_digest.join(kept, (with_digest["doc_id"].cast("long") == kept["kept_id"]) & (with_digest[digest] == kept["kept_digest"]), "left_semi")
    return found.dropDuplicates(["doc_id", digest]).select(names).unionByName(docs.where("doc_id is null"))


SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as held from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * held >= 75 * (x.n + y.n - held)
),
reach(node, reached) as (
  select doc_id, doc_id from documents
  union
  select r.node, l.b from reach r join (select a, b from links union all select b, a from links) l on l.a = r.reached
)
select d.doc_id, coalesce(n, 0) as n_shingles, (select min(reached) from reach where node = d.doc_id) as component_id
from documents d left join sizes using (doc_id)
"""
