"""Language identification: script ranges narrow the candidates of each word, per-word scores come from letter
trigrams, and Viterbi with a switching penalty labels spans of mixed-language text.

Training counts hashed letter trigrams (with word borders) of a bounded sample of labelled documents for each
language, and which scripts the language is written in. Prediction runs over whole texts in one Arrow pass: all
trigrams of a batch are scored by table lookup, summed by word, and the Viterbi steps of all its documents run
side by side. A text whose scores would not fit the bound on memory is read in parts, forward for the scores at their
borders and backward for the labels."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .sampling import bounded_sample, crc_of_id

#: Documents for each language in the training sample; slots of the trigram table; cost of a change of language.
PER_LANGUAGE, SLOTS, SWITCH = 1500, 1 << 16, 8.0
NO_LANGUAGE = "und"
#: A language is a candidate for a word if at least this share of its training letters is of the word's script.
SCRIPT_SHARE = 0.01
_OUT = 60.0

#: Code point ranges of scripts.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("gurmukhi", [(0xA00, 0xA7F)]),
    ("gujarati", [(0xA80, 0xAFF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("kannada", [(0xC80, 0xCFF)]),
    ("malayalam", [(0xD00, 0xD7F)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("hiragana", [(0x3040, 0x309F)]),
    ("katakana", [(0x30A0, 0x30FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]),
]
N_SCRIPTS = len(SCRIPTS) + 1  # 0: any other
#: Characters times languages whose scores are held at a time.
CELLS = 48_000_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = np.array([chr(i).isalpha() for i in range(0x10000)])
    mark = np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x10000)])
    script = np.zeros(0x10000, dtype=np.uint8)
    for i, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = i + 1
    return letter, mark, script


_CACHE: dict[str, tuple] = {}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "t" not in _CACHE:
        _CACHE["t"] = _tables()
    return _CACHE["t"]


@dataclass
class Features:
    """Words of a few texts: trigram slots by letter, first letter of each word, script and document of each word."""

    slots: np.ndarray
    word_at: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    words_of: np.ndarray


def features(texts: list[str | None]) -> Features:
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    letter, mark, script = _classes()
    small = np.minimum(code, 0xFFFF).astype(np.uint16)
    is_letter = letter[small]
    for i in np.flatnonzero(code > 0xFFFF):
        is_letter[i] = chr(code[i]).isalpha()
    marks = mark[small]
    if marks.any():  # a mark belongs to the letter before it
        last = np.maximum.accumulate(np.where(marks, 0, np.arange(len(code))))
        is_letter |= marks & is_letter[last]
    c = np.where(is_letter, code, 0)
    at = np.flatnonzero(is_letter)
    before, after = c[np.maximum(at, 1) - 1], c[np.minimum(at + 1, len(c) - 1)]
    if len(at) and at[0] == 0:
        before[0] = 0
    mixed = before * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    slots = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    word_at = np.flatnonzero(before == 0)
    first = at[word_at]
    letters = np.diff(np.append(word_at, len(at)))
    return Features(slots, word_at, letters, script[small[first]], np.diff(np.searchsorted(first, ends), prepend=0))


def groups(texts: list, most: int):
    """Ranges of texts of about `most` characters together."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _label_type(labels: int):
    return np.uint8 if labels <= 1 << 8 else np.uint16 if labels <= 1 << 16 else np.uint32


def viterbi(scores: np.ndarray, words_of: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: the sum of its words' scores less `switch` for each change of label, for all
    texts at once. Ties keep the label, or go to the first one."""
    total, labels = scores.shape
    kind = _label_type(labels)
    if labels < 2 or not total:
        return np.zeros(total, dtype=kind)
    by_size = np.argsort(-words_of, kind="stable")
    sizes = words_of[by_size]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts of more than t words
    off = np.concatenate(([0], np.cumsum(active)))
    start = np.concatenate(([0], np.cumsum(words_of)))[:-1]
    rank = np.empty(len(words_of), dtype=np.int64)
    rank[by_size] = np.arange(len(words_of))
    place = off[np.arange(total) - np.repeat(start, words_of)] + np.repeat(rank, words_of)
    timed = np.empty_like(scores)
    timed[place] = scores
    back = np.empty((total, labels), dtype=kind)
    own = np.arange(labels, dtype=kind)
    v = timed[: active[0]].copy()
    for t in range(1, steps):
        n = active[t]
        now = v[:n]
        top = now.argmax(axis=1)
        moved = (now[np.arange(n), top] - np.float32(switch))[:, None]
        back[off[t] : off[t + 1]] = np.where(now >= moved, own, top[:, None].astype(kind))
        np.maximum(now, moved, out=now)
        now += timed[off[t] : off[t + 1]]
    state = v.argmax(axis=1)
    path = np.empty(total, dtype=kind)
    for t in range(steps - 1, 0, -1):
        n = active[t]
        path[off[t] : off[t + 1]] = state[:n]
        state[:n] = back[np.arange(off[t], off[t + 1]), state[:n]]
    path[: active[0]] = state
    return path[place]


def viterbi_in_parts(parts: int, scores_of, switch: float) -> np.ndarray:
    """viterbi() of one text whose scores come in parts: scores_of(i) is called twice for each part, and only the scores
    at the borders are held between."""
    borders, v = [], None
    for i in range(parts):
        borders.append(v)
        for row in scores_of(i):
            v = row.copy() if v is None else np.maximum(v, v.max() - np.float32(switch)) + row
    state, found = (0 if v is None else int(v.argmax())), []
    for i in reversed(range(parts)):
        scores, v = scores_of(i), borders[i]
        own = np.arange(scores.shape[1], dtype=_label_type(scores.shape[1]))
        back = np.empty(scores.shape, dtype=own.dtype)
        for t, row in enumerate(scores):
            if v is None:
                v = row.copy()
                continue
            top = int(v.argmax())
            moved = v[top] - np.float32(switch)
            back[t] = np.where(v >= moved, own, own.dtype.type(top))
            v = np.maximum(v, moved) + row
        path = np.empty(len(scores), dtype=own.dtype)
        first = 1 if borders[i] is None else 0
        for t in range(len(scores) - 1, -1, -1):
            path[t] = state
            if t >= first:
                state = back[t, state]
        found.append(path)
    return np.concatenate(found[::-1]) if found else np.zeros(0, np.uint8)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [languages, slots]: log of the probability over the mean of all languages
    scripts: np.ndarray  # [scripts, languages]: whether a language is a candidate

    def word_scores(self, f: Features) -> np.ndarray:
        if not len(f.word_at):
            return np.zeros((0, len(self.languages)), np.float32)
        s = np.empty((len(f.word_at), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            s[:, i] = np.add.reduceat(self.weights[i][f.slots], f.word_at)
        candidates = self.scripts[f.script]
        some = candidates.any(axis=1)[:, None]
        return s - np.float32(_OUT) * (some & ~candidates)

    def chars(self) -> int:
        """Characters whose scores are held at a time."""
        return max(1, CELLS // max(len(self.languages), 1))

    def _paths(self, texts: list[str | None], switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of each word, letters of each word, words of each text)."""
        if len(texts) == 1 and len(texts[0] or "") > self.chars():
            parts = list(_word_parts(texts[0], self.chars()))
            path = viterbi_in_parts(len(parts), lambda i: self.word_scores(features([parts[i]])), switch)
            letters = np.concatenate([features([p]).letters for p in parts])
            return path, letters, np.array([len(letters)])
        parts = [features(texts[a:b]) for a, b in groups(texts, 1_000_000)]
        scores = np.concatenate([self.word_scores(f) for f in parts])
        letters, words_of = np.concatenate([f.letters for f in parts]), np.concatenate([f.words_of for f in parts])
        return viterbi(scores, words_of, switch), letters, words_of

    def label(self, texts: list[str | None], switch: float = SWITCH, framed: bool = False) -> tuple[list[str], list[float], list[list[tuple]]]:
        """For each text its language, the share of its letters in spans of that language, and the spans as
        (first word, number of words, language). With `framed` a text that begins and ends in one language is of that
        language, whatever stands between."""
        if not self.languages:
            return [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        languages, shares, spans = [], [], []
        for lo, hi in groups(texts, self.chars()):
            for part in (part for part in (texts[lo : hi - 1], texts[hi - 1 : hi]) if part):  # the last one may be long
                for out, own in zip((languages, shares, spans), self._label(part, switch, framed)):
                    out += own
        return languages, shares, spans

    def _label(self, texts: list[str | None], switch: float, framed: bool):
        path, letters, words_of = self._paths(texts, switch)
        n = len(self.languages)
        doc = np.repeat(np.arange(len(texts)), words_of)
        held = np.bincount(doc * n + path, weights=letters, minlength=len(texts) * n).reshape(-1, n)
        total, best = held.sum(axis=1), held.argmax(axis=1)
        start = np.concatenate(([0], np.cumsum(words_of)))
        if framed:
            some = np.flatnonzero(words_of)
            frame = path[start[some]] == path[start[some + 1] - 1]
            best[some[frame]] = path[start[some[frame]]]
        share = held[np.arange(len(texts)), best] / np.maximum(total, 1)
        turn = np.flatnonzero(np.diff(path.astype(np.int64), prepend=-1) | np.diff(doc, prepend=-1))
        size = np.diff(np.append(turn, len(path)))
        spans: list[list[tuple]] = [[] for _ in texts]
        for d, first, k, l in zip(doc[turn].tolist(), (turn - start[doc[turn]]).tolist(), size.tolist(), path[turn].tolist()):
            spans[d].append((first, k, self.languages[l]))
        return [self.languages[b] if t else NO_LANGUAGE for b, t in zip(best.tolist(), total.tolist())], share.tolist(), spans


def _word_parts(text: str, most: int):
    """A text in parts of about `most` characters that are cut outside words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        while end < len(text) and (text[end].isalpha() or unicodedata.category(text[end])[0] == "M"):
            end += 1
        yield text[at:end]
        at = end


def _count(slot_count: int):
    def run(batches):
        for b in batches:
            by_language: dict[str, list[str]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by_language.setdefault(lang, []).append(text)
            for lang, texts in by_language.items():
                f = features(texts)
                found = np.bincount(f.slots, minlength=slot_count)
                at = np.flatnonzero(found)
                scripts = np.bincount(f.script, weights=f.letters, minlength=N_SCRIPTS).astype(np.int64)
                slot, n = np.concatenate((at, slot_count + np.arange(N_SCRIPTS))), np.concatenate((found[at], scripts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])

    return trimmed(run)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", fold: int = 1) -> Model:
    """Learns from documents with a text and a language whose crc32(doc_id) mod 3 is not `fold`."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = src.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.pmod(crc_of_id(), F.lit(3)) != fold))
    picked = bounded_sample(usable.select("doc_id", "lang"), "lang", per_language, 3)
    texts = usable.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "lang")
    counts = texts.mapInArrow(_count(SLOTS), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    place = counts["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy(dtype=np.int64)
    slot, n = counts["slot"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.float64)
    table, scripts = np.full((len(languages), SLOTS), 0.5), np.zeros((len(languages), N_SCRIPTS))
    is_slot = slot < SLOTS
    np.add.at(table, (place[is_slot], slot[is_slot]), n[is_slot])
    np.add.at(scripts, (place[~is_slot], slot[~is_slot] - SLOTS), n[~is_slot])
    if not languages:
        return Model([], np.zeros((0, SLOTS), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    p = table / table.sum(axis=1, keepdims=True)
    weights = np.log(p) - np.log(p.mean(axis=0))
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, weights.astype(np.float32), candidates.T.copy())


def _predict(model, switch: float):
    def run(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            lang, share, spans = model.value.label(texts, switch)
            kinds = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            rows = [[{"first_word": a, "words": n, "lang": l} for a, n, l in s] for s in spans]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(rows, kinds)], ["doc_id", "lang_pred", "score", "spans"])

    return trimmed(run)


def identify(docs: DataFrame, model: Model | None = None, switch: float = SWITCH, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language that most letters of a text are labelled with, its share of the
    letters, and the spans of words by language.

    A text that is null or has no letter is `und` with score 0 and no spans, and so is every text if nothing could
    be learned. Repeated rows are labelled each; a null doc_id stays null and is not learned from. No rows: an
    empty table. Only doc_id, the text and (for training) lang are read."""
    model = model or train(docs, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_predict(shared, switch), "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told; the columns as they came.

    Null texts and texts without a letter go, and all texts if no row has a text and a language to learn from. Repeated
    rows stay or go together; a null doc_id stays null. No rows: an empty table."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns

    def run(batches):
        for b in batches:
            found = model.value.label(b.column("text").to_pylist())[0]
            yield b.filter(pa.array([l != NO_LANGUAGE for l in found], pa.bool_())).select(names)

    return docs.mapInArrow(trimmed(run), docs.schema)
