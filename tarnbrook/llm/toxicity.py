"""Toxicity: a linear-chain conditional random field tags toxic spans; the forward-backward marginals of a text give
its score and the offending offsets.

Labels are by document, so token labels come first: over a bounded sample of labelled documents, features (a word,
its prefixes of 4, 5 and 6 bytes) that occur in toxic documents beyond chance and hardly in others mark the tokens
of toxic documents that hold one. The field (two states, a weight for each such feature, bias and transitions) is
fitted to windows around tokens with features, which in clean documents are negative examples, and a last logistic
step maps the noisy-or of the marginals to a score. At prediction, words without any feature only carry messages
along the chain, so runs of them are taken in one step by powers of the transition matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed
from .ngram_join import shingle_sets
from .sampling import bounded_sample, crc_of_id
from .words import chunks, hash_prefix, mix64, span_hash, string_buffers, word_spans

#: Documents of each label in the training sample, and about as many windows of them as the field is fitted to.
PER_LABEL, WINDOWS = 8000, 10_000
#: Words on each side of a token in a window.
SIDE = 6
PREFIXES = (4, 5, 6)
#: A feature's share among toxic documents must be this many times its share among the others.
LEAST_ODDS = 20.0
_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[words, 1 + prefixes] feature hashes; 0 where a word is not longer than the prefix."""
    sums = hash_prefix(raw)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), dtype=_U)
    out[:, 0] = span_hash(sums, starts, ends)
    for i, n in enumerate(PREFIXES):
        long = ends - starts > n
        out[long, i + 1] = mix64(span_hash(sums, starts[long], starts[long] + n) + _U(n))
    return out


def _texts(column):
    """(first row, bytes, offsets from 0) of runs of texts of about a megabyte."""
    raw, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


class Lookup:
    """Places of 64-bit hashes in a small set, -1 for others: a bit table first, then exact search."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(hashes >> _U(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        maybe = np.nonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        found = h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = (self.hashes[at] == found) & (found != 0)
        out[tuple(m[hit] for m in maybe)] = self.order[at[hit]]
        return out


@dataclass
class Field:
    """The fitted field: features, their weights, bias of the toxic state, transitions [from, to], calibration."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float
    shift: float

    def neutral(self) -> np.ndarray:
        """Step over a word without features: transition, then its bias."""
        return np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])

    def marginals(self, at: np.ndarray, unary: np.ndarray, n: int) -> np.ndarray:
        """Probability of the toxic state at the words `at` (ascending) of a chain of n words, of which only these
        have features, with `unary` the sum of their weights."""
        m = self.neutral()
        values, vectors = np.linalg.eig(m)
        inverse = np.linalg.inv(vectors)

        def power(k: int) -> np.ndarray:
            p = ((vectors * (values / values.max()) ** k) @ inverse).real
            return np.maximum(p, 1e-300)

        boost = np.exp(np.clip(unary, -30, 30))
        start = np.array([1.0, np.exp(self.bias)])
        alphas, a, last = [], None, 0
        for i, t in enumerate(at.tolist()):
            a = (start if t == 0 else start @ power(t)) if a is None else a @ power(t - last)
            a = a * np.array([1.0, boost[i]])
            a = a / a.sum()
            alphas.append(a)
            last = t
        out = np.empty(len(at))
        b, ahead = np.ones(2), n - 1
        for i in range(len(at) - 1, -1, -1):
            t = int(at[i])
            if i == len(at) - 1:
                b = power(ahead - t) @ np.ones(2) if ahead > t else np.ones(2)
            else:
                b = power(int(at[i + 1]) - t) @ (np.array([1.0, boost[i + 1]]) * b)
            b = b / b.sum()
            p = alphas[i] * b
            out[i] = p[1] / p.sum()
        return out

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _evidence(marginals) + self.shift, -50, 50))))


def _evidence(marginals: np.ndarray) -> float:
    """Log-odds of the noisy-or, bounded."""
    none = float(np.sum(np.log1p(-np.minimum(marginals, 1 - 1e-9)))) if len(marginals) else 0.0
    some = -np.expm1(none)
    return float(np.clip(np.log(max(some, 1e-9)) - none, -12, 12))


def chain_gradient(theta: np.ndarray, tokens: np.ndarray, labels: np.ndarray, n_features: int) -> np.ndarray:
    """Gradient of the log-likelihood of label windows in theta (weights, bias, the four transitions): the labels' counts
    less those that forward and backward messages expect. Windows as for fit_chain()."""
    n, steps, _ = tokens.shape
    inside, has = tokens[:, :, 0] != -2, tokens >= 0
    both = inside[:, 1:] & inside[:, :-1]
    pair = labels[:, :-1] * 2 + labels[:, 1:]
    w, bias, moves = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
    u = (np.append(w, 0.0)[np.where(has, tokens, n_features)]).sum(axis=2) + bias
    step = np.exp(moves)
    e1 = np.exp(np.clip(u, -30, 30))
    alpha, beta = np.empty((n, steps, 2)), np.ones((n, steps, 2))
    a = np.ones((n, 2))
    for t in range(steps):
        if t:
            a = np.where(both[:, t - 1 : t], a @ step, 1.0)
        a = a * np.stack((np.ones(n), e1[:, t]), axis=1)
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * np.stack((np.ones(n), e1[:, t + 1]), axis=1)) @ step.T
        beta[:, t] = np.where(both[:, t : t + 1], b / b.sum(axis=1, keepdims=True), 1.0)
    p = alpha * beta
    p = p[:, :, 1] / p.sum(axis=2)
    after = np.stack((np.ones_like(e1[:, 1:]), e1[:, 1:]), axis=2) * beta[:, 1:]
    joint = alpha[:, :-1, :, None] * step * after[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    off = np.where(inside, labels - p, 0.0)
    g = np.zeros_like(theta)
    if n_features:
        g[:n_features] = np.bincount(tokens[has], weights=np.broadcast_to(off[:, :, None], has.shape)[has], minlength=n_features)[:n_features]
    g[n_features] = off.sum()
    g[n_features + 1 :] = [(both & (pair == k)).sum() for k in range(4)] - (joint * both[:, :, None, None]).sum(axis=(0, 1)).reshape(-1)
    return g


def fit_chain(tokens: np.ndarray, labels: np.ndarray, n_features: int, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions of a two-state field by gradient ascent (Adam) on the likelihood of label
    windows. tokens [windows, words, features of a word] holds feature numbers, -1 for none and -2 in the first
    place for a position outside the text; labels [windows, words] is 0 or 1."""
    theta = np.zeros(n_features + 5)
    theta[n_features] = -3.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        g = chain_gradient(theta, tokens, labels, n_features) / len(tokens) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta += rate * (1 - turn / (rounds + 1)) * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.999**turn)) + 1e-9)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def _signed(batches):
    """Three min-hashes of the five-word shingles of each text: copies and near copies would count one find many
    times, so of texts with an equal one the sample keeps one, a toxic one if there is one, of the least id."""
    for b in batches:
        sets = shingle_sets(*string_buffers(b.column("text")))
        least = [[int(mix64(x + _U(k * 0x1F3D)).min()) if len(x) else 0 for x in sets] for k in range(1, 4)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("toxic"), *(pa.array(np.array(x, dtype=_U).view(np.int64)) for x in least)], ["doc_id", "text", "toxic", "s0", "s1", "s2"])


def _document_features(batches):
    for b in batches:
        toxic = b.column("toxic").to_pylist()
        kept: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for lo, raw, offsets in _texts(b.column("text")):
            starts, ends, first = word_spans(raw, offsets, _WORD)
            h = _hashes(raw, starts, ends)
            for i in range(len(offsets) - 1):
                kept[toxic[lo + i]].append(np.unique(h[first[i] : first[i + 1]]))
        for label, found in kept.items():
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                h, n = h[h != 0], n[h != 0]
                for i in range(0, len(h), 200_000):
                    part = pa.array(h[i : i + 200_000].view(np.int64))
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), label, np.int32)), pa.array(n[i : i + 200_000])], ["feature", "toxic", "n"])


def _windows(shared, side: int):
    """Windows around tokens with features; one around the first word of a text without any."""
    width = 2 * side + 1

    def run(batches):
        look = Lookup(shared.value)
        for b in batches:
            toxic, ids = b.column("toxic").to_pylist(), b.column("doc_id").to_pylist()
            rows = []
            for lo, raw, offsets in _texts(b.column("text")):
                starts, ends, first = word_spans(raw, offsets, _WORD)
                f = look(_hashes(raw, starts, ends))
                for i in range(len(offsets) - 1):
                    own = f[first[i] : first[i + 1]]
                    if not len(own):
                        continue
                    padded = np.full((len(own) + 2 * side, own.shape[1]), -2, dtype=np.int32)
                    padded[side : side + len(own)] = own
                    hits = np.flatnonzero((own >= 0).any(axis=1))
                    last = -width
                    for at in hits.tolist() or [0]:
                        if at - last >= side:
                            last = at
                            rows.append((ids[lo + i], at, toxic[lo + i], padded[at : at + width].tobytes()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "at", "toxic", "tokens"])

    return trimmed(run)


def _tag(field, spans: bool):
    kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        f = field.value
        look = Lookup(f.features)
        base = f.score(np.zeros(0))
        for b in batches:
            scores = np.full(len(b), base)
            found: list[list[dict]] = [[] for _ in range(len(b))]
            for lo, raw, offsets in _texts(b.column("text")):
                starts, ends, first = word_spans(raw, offsets, _WORD)
                hits = look(_hashes(raw, starts, ends))
                at = np.flatnonzero((hits >= 0).any(axis=1))
                unary = np.append(f.weights, 0.0)[hits[at]].sum(axis=1)
                doc, chars = np.searchsorted(first, at, side="right") - 1, None  # code points before each byte, once they are asked for
                for d in np.unique(doc).tolist():
                    own = doc == d
                    place = at[own]
                    p = f.marginals(place - first[d], unary[own], int(first[d + 1] - first[d]))
                    scores[lo + d] = f.score(p)
                    if spans and p.max() >= 0.5:
                        if chars is None:
                            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                        found[lo + d] = _spans(place, chars[starts[place]] - chars[offsets[d]], chars[ends[place]] - chars[offsets[d]], p)
            cols = [b.column("doc_id"), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kinds)] if spans else cols, ["doc_id", "score", "spans"] if spans else ["doc_id", "score"])

    return trimmed(run)


def _spans(place: np.ndarray, begins: np.ndarray, ends: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring words tagged toxic, with their code point offsets."""
    out: list[dict] = []
    last = None
    for w, a, z, q in zip(place.tolist(), begins.tolist(), ends.tolist(), p.tolist()):
        if q < 0.5:
            continue
        if last == w - 1:
            out[-1]["end"], out[-1]["probability"] = z, max(out[-1]["probability"], q)
        else:
            out.append({"begin": a, "end": z, "probability": q})
        last = w
    return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, windows: int = WINDOWS, fold: int = 0, text: str = "text") -> Field:
    """Learns from documents with a label whose crc32(doc_id) mod 5 is not `fold`. Of several labels of a document
    the higher counts. Without documents of both labels every text scores 0."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.pmod(crc_of_id(), F.lit(5)) != fold)
    picked = bounded_sample(known, "toxic", per_label, 5)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = src.join(F.broadcast(picked), "doc_id").mapInArrow(_signed, "doc_id long, text string, toxic int, s0 long, s1 long, s2 long")
    for i in range(3):
        kept = sample.groupBy(f"s{i}").agg(F.min_by(F.struct(*[c for c in sample.columns if c != f"s{i}"]), F.struct(-F.col("toxic"), "doc_id", "text")).alias("row"))
        sample = kept.select(f"s{i}", "row.*")
    sample = materialize(sample.select("doc_id", "text", "toxic"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    blank = Field(np.zeros(0, _U), np.zeros(0), -20.0, np.zeros((2, 2)), 1.0, -20.0)
    if not n.get(0) or not n.get(1):
        return blank
    counted = sample.select("text", "toxic").mapInArrow(_document_features, "feature long, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    share = n[1] / (n[0] + n[1])
    both = F.col("n1") + F.col("n0")
    rate = F.col("n1") / both
    gain = 2 * (F.col("n1") * F.log(rate / share) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    odds = (F.col("n1") + 0.5) / n[1] / ((F.col("n0") + 0.5) / n[0])
    # A chance find among the features of so many documents stays under this.
    least = 2 * float(np.log(30.0 * (n[0] + n[1])))
    chosen = counted.where((F.col("n1") >= 3) & (odds >= LEAST_ODDS) & (gain >= least)).select("feature").toPandas()
    features = np.sort(chosen["feature"].to_numpy(dtype=np.int64).view(_U))
    if not len(features):
        return blank
    shared = spark.sparkContext.broadcast(features)
    cut = materialize(sample.mapInArrow(_windows(shared, SIDE), "doc_id long, at int, toxic int, tokens binary"), "toxic-windows")
    share_of = min(1.0, windows / max(cut.count(), 1))
    picks = F.pmod(F.xxhash64("doc_id", "at", "tokens"), F.lit(1 << 30)) <= F.lit(int(share_of * (1 << 30)))
    got = cut.where(picks).toPandas().sort_values(["doc_id", "at", "tokens"], kind="stable")
    width = 2 * SIDE + 1
    tokens = np.frombuffer(b"".join(got["tokens"]), dtype=np.int32).reshape(-1, width, 1 + len(PREFIXES))
    marked = (tokens >= 0).any(axis=2) & (got["toxic"].to_numpy()[:, None] == 1)
    weights, bias, moves = fit_chain(tokens, marked.astype(np.int64), len(features))
    field = Field(features, weights, bias, moves, 1.0, 0.0)
    scored = sample.select("doc_id", "text").mapInArrow(_tag(spark.sparkContext.broadcast(field), False), "doc_id long, score double").join(F.broadcast(picked), "doc_id").select("score", "toxic").toPandas()
    x, y = np.log(np.clip(scored["score"], 1e-9, 1 - 1e-9) / (1 - np.clip(scored["score"], 1e-9, 1 - 1e-9))).to_numpy(), scored["toxic"].to_numpy(dtype=float)
    slope, shift = _logistic(x, y)
    return Field(features, weights, bias, moves, max(slope, 0.05), shift)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift by Newton's method with a small ridge."""
    z, at = np.stack((x, np.ones(len(x)))), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -50, 50)))
        bend = (z * (p * (1 - p))) @ z.T + ridge * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, z @ (y - p) - ridge * (at - [1.0, 0.0])), -2, 2)
    return float(at[0]), float(at[1])


def score(docs: DataFrame, labels: DataFrame | None = None, field: Field | None = None, text: str = "text") -> DataFrame:
    """(doc_id, score, spans): how likely a text is toxic (0 to 1), and the code point offsets of the tagged words with
    their marginal probabilities.

    Null and empty texts have the score of a text without evidence and no spans. Repeated rows are scored each; a
    null doc_id stays null. No rows: an empty table. Of `docs` only doc_id and the text are read."""
    field = field or train(docs, labels, text=text)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_tag(docs.sparkSession.sparkContext.broadcast(field), True), "doc_id long, score double, spans array<struct<begin:int,end:int,probability:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5; the columns as they came.

    Null and empty texts stay, as does every text if no label marks a toxic one to learn from. Labels without doc_id or
    value are left out. Repeated rows stay or go together; a null doc_id stays null. No rows: an empty table."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches):
        for b in batches:
            one = pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column("text")], ["doc_id", "text"])
            for scored in _tag(field, False)([one]):
                yield b.filter(pa.array(scored.column("score").to_numpy() < 0.5)).select(names)

    return docs.mapInArrow(trimmed(run), docs.schema)
