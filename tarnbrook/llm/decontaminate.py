"""Benchmark decontamination: pigeonhole edit matching of test items in documents.

An item of m words may differ from a passage by k = floor(rate * m) word edits. Cut into k + 1 pieces, at least one
piece then stands in the passage as it is, so one Aho-Corasick pass over a document finds every place worth a look,
and Myers' bit-parallel distance over words settles it on the window around. In scripts that are written without spaces each
letter, with its marks, is a word. Items go to the tasks in blocks of
bounded size, one broadcast after the other, so the benchmark may be large; documents are never shuffled."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Word edits allowed for each word of an item; characters of the items of one broadcast block.
ERROR_RATE, BLOCK_CHARS = 0.2, 8_000_000
#: First and last characters of the blocks of scripts without spaces between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF),
)


def _word_pattern() -> str:
    letters = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
    marks = "".join(chr(c) for a, b in UNSPACED if b < 0x3000 or 0xA980 <= a < 0xAA80 for c in range(a, b + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
    return rf"(?![\W_])[{letters}][{marks}\u3099\u309a]*|[^\W_{letters}]+"


_ascii_words = re.compile(r"[^\W_]+").findall
_words = re.compile(_word_pattern()).findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; single letters of scripts without spaces."""
    text = (text or "").lower()
    return _ascii_words(text) if text.isascii() else _words(text)


def pieces_of(words: list[str], errors: int) -> list[tuple[int, int]]:
    """errors + 1 ranges of words, of sizes that differ by one at most, that cover all words."""
    n, k = len(words), errors + 1
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def myers(pattern_bits: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of `text`, end of the first such stretch)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text):
        eq = pattern_bits.get(w, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp = minus | ~(d0 | plus) & full
        hm = plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus = (hm | ~(d0 | hp)) & full
        minus = hp & d0
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """The items of a block, ready to be found."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: list[tuple[int, list[str], dict[str, int], dict[str, int], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            errors = int(rate * len(words))
            bits, back = {}, {}
            for i, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << i
                back[w] = back.get(w, 0) | 1 << (len(words) - 1 - i)
            number = len(self.items)
            self.items.append((item_id, words, bits, back, errors))
            for a, b in pieces_of(words, errors):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (p.count(" ") - 1, places))
        self.ready = bool(pieces)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, end word) of the closest passage of each item within its budget."""
        if not self.ready:
            return []
        words = words_of(text)
        line = f" {' '.join(words)} "
        hits: dict[int, set[int]] = {}
        place = at = 0
        for end, (size, where) in self.automaton.iter(line):
            place += line.count(" ", at, end)
            at = end
            for number, offset in where:
                hits.setdefault(number, set()).add(place - size - offset)
        out = []
        for number, starts in hits.items():
            item_id, own, bits, back, errors = self.items[number]
            best = None
            m, seen = len(own), None
            for s in sorted(starts):
                if seen is not None and s <= seen:
                    continue
                seen = s + errors
                a, b = max(0, s - errors), min(len(words), s + m + 2 * errors)
                d, e = myers(bits, m, words[a:b])
                if d <= errors and (best is None or d < best[0]):
                    lo = max(a, a + e - m - errors)
                    _, back_len = myers(back, m, words[lo : a + e][::-1])
                    best = (d, a + e - back_len, a + e)
            if best:
                out.append((item_id, *best))
        return sorted(out)


_MATCHERS: dict[int, Matcher] = {}


def _matcher(block) -> Matcher:
    if block.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[block.id] = Matcher(*block.value)
    return _MATCHERS[block.id]


class Block:
    """A broadcast of items, with a number by which a worker keeps its automaton from task to task."""

    def __init__(self, spark, items, rate):
        self.shared = spark.sparkContext.broadcast((items, rate))
        self.id = self.shared._jbroadcast.id()

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def blocks(benchmark: DataFrame, rate: float, most: int = BLOCK_CHARS) -> list[Block]:
    """The items in blocks of about `most` characters; only a block at a time is on the driver."""
    out, held, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= most:
            out.append(Block(benchmark.sparkSession, held, rate))
            held, size = [], 0
    if held:
        out.append(Block(benchmark.sparkSession, held, rate))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word): for each document and test item, the closest passage of the
    document that is within the item's budget of floor(rate * words) word edits. Case, white space and punctuation
    don't count; words are runs of letters and digits, and single letters of scripts without spaces between words.

    Null and empty texts and items without words match nothing. Items of fewer than 1 / rate words must be there
    word for word. Of several passages at the least distance the first is returned. Repeated documents are matched
    each, repeated equal items once. A null doc_id stays null; items without id are left out. Empty tables: no rows.
    Other columns are not read."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, first_word int, end_word int"
    out = None
    for block in blocks(benchmark, rate):

        def run(batches, block=block):
            matcher = _matcher(block)
            for b in batches:
                rows = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for f in matcher.find(t)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "first_word", "end_word"])

        one = src.mapInArrow(trimmed(run), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents without a passage of a test item, as find_leaks() finds them; the columns as they came.

    Null and empty texts stay, and all texts if the benchmark is empty. Repeated rows stay or go together."""
    names = docs.columns
    for block in blocks(benchmark, rate):

        def run(batches, block=block):
            matcher = _matcher(block)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t) for t in b.column("text").to_pylist()], pa.bool_())).select(names)

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
