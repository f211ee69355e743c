"""Language ID and toxicity: held-out accuracy, chains against brute force, hard cases."""

import random
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tarnbrook.llm import langid, queries, toxicity
from tarnbrook.llm.sampling import bounded_sample
from tests.llm.util import NASTY, SCHEMA, clashing, documents, empty, prose

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = np.array([0, 4, 1, 6, 5])
    scores = rng.normal(size=(int(sizes.sum()), 3)).astype(np.float32)
    got, at = langid.viterbi(scores, sizes, 0.7), 0
    for n in sizes:
        own = scores[at : at + n].astype(float)
        value = lambda p: sum(own[i, l] for i, l in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        if n:
            assert value(got[at : at + n].tolist()) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))), abs=1e-5)
        at += n


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_languages(spark, change):
    docs = documents(spark)
    got = langid.identify(change(docs)).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: r.lang for r in docs.collect()}
    by_id = {r.doc_id: r for r in got}
    for d in (3000, 3001, 3002, 3005):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].spans) == ("und", 0.0, [])
    real = [r for r in got if r.doc_id is not None and r.doc_id < 3000]
    assert all(r.lang_pred == want[r.doc_id] and 0.5 < r.score <= 1 for r in real)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_mixed_text_has_spans(spark):
    rng = random.Random(5)
    model = langid.train(documents(spark))
    lang, share, spans = model.label([prose(rng, "en", 40) + " " + prose(rng, "de", 60)])
    assert lang == ["de"] and [s[2] for s in spans[0]] == ["en", "de"] and abs(spans[0][1][0] - 40) <= 2


def test_a_framed_text_is_of_most_of_its_letters():
    rng = random.Random(6)
    texts = {l: [prose(rng, l, 40) for _ in range(60)] for l in ("en", "de")}
    model = trained(texts)
    mixed = f"{prose(rng, 'en', 8)} {prose(rng, 'de', 400)} {prose(rng, 'en', 8)}"
    (lang,), (share,), (spans,) = model.label([mixed])
    assert lang == "de" and share > 0.9 and [x[2] for x in spans] == ["en", "de", "en"]
    assert model.label([mixed], framed=True)[0] == ["en"]


def trained(texts):
    """A model by the rule of train(), without Spark."""
    names = sorted(texts)
    table, scripts = np.full((len(names), langid.SLOTS), 0.5), np.zeros((len(names), langid.N_SCRIPTS))
    for i, l in enumerate(names):
        f = langid.features(texts[l])
        table[i] += np.bincount(f.slots, minlength=langid.SLOTS)
        scripts[i] += np.bincount(f.script, weights=f.letters, minlength=langid.N_SCRIPTS)
    p = table / table.sum(axis=1, keepdims=True)
    return langid.Model(names, (np.log(p) - np.log(p.mean(axis=0))).astype(np.float32), (scripts >= 0.01 * scripts.sum(axis=1, keepdims=True)).T)


def test_word_scores_equal_brute_force(spark):
    rows = documents(spark, extra=False)
    model = langid.train(rows)
    counts = {l: {} for l in model.languages}
    picked = {r.doc_id for r in rows.selectExpr("doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) as f").collect() if r.f != 1}

    def slots(word):
        padded = [0, *map(ord, word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
            yield ((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16

    words = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    for r in rows.collect():
        if r.doc_id in picked:
            for w in words(r.text):
                for s in slots(w):
                    counts[r.lang][s] = counts[r.lang].get(s, 0) + 1
    total = {l: sum(c.values()) + 0.5 * langid.SLOTS for l, c in counts.items()}
    text = "the house zwischen forêt élève x"
    got = model.word_scores(langid.features([text]))
    for w, row in zip(words(text), got):
        for l, x in zip(model.languages, row):
            p = {k: [(counts[k].get(s, 0) + 0.5) / total[k] for s in slots(w)] for k in counts}
            expected = sum(np.log(p[l][i]) - np.log(np.mean([q[i] for q in p.values()])) for i in range(len(w)))
            assert x == pytest.approx(expected, abs=1e-3)


def test_many_languages():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 0.1, (300, langid.SLOTS)).astype(np.float32)
    text = "some words of a language that comes late in the list"
    weights[280, langid.features([text]).slots] += 3
    model = langid.Model([f"l{i:03}" for i in range(300)], weights, np.ones((langid.N_SCRIPTS, 300), bool))
    lang, share, spans = model.label([text, None, text])
    assert lang == ["l280", "und", "l280"] and share == [1.0, 0.0, 1.0] and spans[2] == [(0, 11, "l280")]


@pytest.mark.parametrize("cells", [200, 1000, 5000])
def test_long_texts_in_parts(monkeypatch, cells):
    rng = random.Random(8)
    model = trained({l: [prose(rng, l, 40) for _ in range(40)] for l in ("en", "de", "fr")})
    texts = [prose(rng, "en", 30), None, " ".join(prose(rng, l, rng.randint(20, 60)) for l in ("en", "de", "fr", "de")), "x", prose(rng, "fr", 200), ""]
    whole = model.label(texts)
    monkeypatch.setattr(langid, "CELLS", cells)
    assert model.label(texts) == whole


def test_marks_belong_to_words():
    assert langid.features(["हिन्दी में लिखा हुआ"]).words_of.tolist() == [4] and langid.features(["\u0301\u0302 \u0301"]).words_of.tolist() == [0]


def test_op3_query(spark):
    got = queries.op3_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows, truth = got.collect(), {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(truth)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9 and any(len(r.spans) > 1 for r in rows)


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate([("привет мир", "ru"), ("hello world", "en")] * 30)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    f = langid.features(["мост"])
    assert model.languages == ["en", "ru"] and model.scripts[f.script[0]].tolist() == [False, True]


def test_no_training_rows(spark):
    assert langid.identify(empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "text", None, "s", 4)], SCHEMA)
    assert [tuple(r)[:3] for r in langid.identify(docs).collect()] == [(1, "und", 0.0)]


def labelled(spark, n=400):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words, bad = prose(rng, "en", 30).split(), i % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(NASTY))
        rows.append((i, " ".join(words) + f" id{i}", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_equal_brute_force():
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0), -1.5, np.array([[0.3, -0.4], [-0.2, 0.9]]), 1.0, 0.0)
    at, unary, n = np.array([1, 2, 5]), np.array([2.0, -1.0, 3.0]), 7
    extra = dict(zip(at.tolist(), unary.tolist()))
    weight = {}
    for path in product((0, 1), repeat=n):
        s = sum((field.bias + extra.get(i, 0.0)) * y for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
        weight[path] = np.exp(s)
    total = sum(weight.values())
    assert field.marginals(at, unary, n) == pytest.approx([sum(w for p, w in weight.items() if p[i]) / total for i in at], abs=1e-9)


def test_gradient_equals_differences_of_the_brute_force_likelihood():
    rng = np.random.default_rng(4)
    tokens = rng.integers(-1, 3, (3, 5, 2)).astype(np.int32)
    tokens[0, :2], tokens[1, 4:] = -2, -2
    labels = (rng.random((3, 5)) < 0.4).astype(np.int64) * (tokens[:, :, 0] != -2)
    theta = rng.normal(0, 0.7, 3 + 5)

    def likelihood(th):
        total = 0.0
        for x, y in zip(tokens, labels):
            own = [i for i in range(5) if x[i, 0] != -2]
            u = [sum(th[f] for f in x[i] if f >= 0) + th[3] for i in own]
            value = lambda p: sum(a * b for a, b in zip(u, p)) + sum(th[4 + 2 * a + b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            total += value([int(y[i]) for i in own]) - np.log(sum(np.exp(value(p)) for p in product((0, 1), repeat=len(own))))
        return total

    step = 1e-6 * np.eye(len(theta))
    expected = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-6 for d in step]
    assert toxicity.chain_gradient(theta, tokens, labels, 3) == pytest.approx(expected, abs=1e-5)


def test_fit_raises_the_likelihood_to_its_peak():
    rng = np.random.default_rng(5)
    tokens = rng.integers(-1, 4, (200, 7, 1)).astype(np.int32)
    labels = ((tokens[:, :, 0] == 2) & (rng.random((200, 7)) < 0.9)).astype(np.int64)
    w, bias, moves = toxicity.fit_chain(tokens, labels, 4, rounds=600)
    g = toxicity.chain_gradient(np.concatenate((w, [bias], moves.reshape(-1))), tokens, labels, 4) / 200
    assert np.abs(g).max() < 2e-3 and w[2] > 2 + max(w[0], w[1], w[3])


def test_spans_take_linear_time():
    field = toxicity.Field(np.sort(toxicity._hashes(np.frombuffer(b"scum", np.uint8), np.array([0]), np.array([4]))[0, :1]), np.array([9.0]), -3.0, np.zeros((2, 2)), 1.0, 0.0)

    class Shared:
        value = field

    text = "é " + "scum ok " * 40_000
    began = time.perf_counter()
    (out,) = toxicity._tag(Shared, True)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])
    spans = out.column("spans").to_pylist()[0]
    assert time.perf_counter() - began < 8 and len(spans) == 40_000 and all(text[x["begin"] : x["end"]] == "scum" for x in spans)


def test_op6_query(spark):
    got = queries.op6_toxicity(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= s.begin < s.end <= len(docs[r.doc_id]) for r in rows for s in r.spans)
    assert sum(len(r.spans) > 0 for r in rows if r.predicted) >= 0.8 * sum(r.predicted for r in rows) > 0


def test_of_equal_texts_the_sample_keeps_a_toxic_one(spark):
    docs, labels = labelled(spark, 100)
    twice = docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    clean = labels.selectExpr("doc_id + 1000 as doc_id", "quality", "0 as toxic")
    a = toxicity.train(twice.repartition(5), labels.unionByName(clean))
    b = toxicity.train(twice.repartition(2), labels.unionByName(clean))
    assert len(a.features) and a.features.tolist() == b.features.tolist() and a.weights == pytest.approx(b.weights) and (a.slope, a.shift) == pytest.approx((b.slope, b.shift))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    field = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(clashing(docs), field=field).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(got[d].score >= 0.5) == bool(t) for d, t in truth.items()]) > 0.98
    for d, r in got.items():
        assert 0 <= r.score <= 1
        assert all(w.strip(".,") in NASTY for s in r.spans if truth[d] for w in text[d][s.begin : s.end].split())
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 320) <= 5
    hard = toxicity.score(documents(spark), field=field)
    assert hard.count() == documents(spark).count() and hard.where("score is null").count() == 0
    assert toxicity.score(empty(spark), field=field).count() == 0


def test_no_labels(spark):
    docs, labels = labelled(spark, 20)
    assert toxicity.score(docs, labels.where("false")).where("score < 0.01").count() == 20
    assert toxicity.score(docs, labels.where("toxic = 1")).where("score < 0.01").count() == 20


def test_sample_is_bounded(spark):
    ids = spark.range(5000).selectExpr("id as doc_id", "if(id < 20, 'rare', 'common') as lang")
    sizes = {r.lang: r["count"] for r in bounded_sample(ids, "lang", 300, 1).groupBy("lang").count().collect()}
    assert sizes["rare"] == 20 and 200 < sizes["common"] < 400
