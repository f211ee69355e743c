import random
import re
from itertools import combinations

import numpy as np
import pytest

from tarnbrook.llm import ngram_join
from tarnbrook.llm.graph import connected_components
from tarnbrook.llm.ngram_join import jaccard_groups, keep_one_of_each
from tarnbrook.llm.queries import op2_ngram_jaccard_join
from tests.llm.util import clashing, documents, empty, rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def brute(docs, percent=75):
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[top(i)] = top(j)
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if top(j) == top(i) and sets[j][0] is not None]
        out.append((d, len(s), min(ids, default=None) if s else d))
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark):
    docs = documents(spark)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == expected
    assert rows(jaccard_groups(clashing(docs)), "doc_id", "n_shingles", "component_id") == expected


def test_sets_of_one_key_are_told_apart(spark):
    docs = documents(spark)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(ngram_join._groups(docs, key_bits=3), "doc_id", "n_shingles", "component_id") == expected


def test_rounds_change_nothing(spark):
    docs = documents(spark)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(jaccard_groups(docs, star_rounds=0), "doc_id", "n_shingles", "component_id") == expected


@pytest.mark.parametrize("seed, percent", [(0, 75), (1, 75), (2, 50)])
def test_random_texts_that_share_passages(spark, seed, percent):
    """Rows made of common passages in all proportions, so that pairs lie on both sides of every bound."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(8, 40))] for k in range(6)]
    texts = []
    for _ in range(150):
        t = [w for k in rng.sample(range(6), rng.randint(1, 3)) for w in passages[k]]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(t[rng.randint(0, 3) :] + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 5, 12]))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows(jaccard_groups(docs, percent=percent, star_rounds=2 * (seed % 2)), "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), percent)


def test_op2_query(spark):
    got = op2_ngram_jaccard_join(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(got, *got.columns) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [words[i : i + 25] for i in range(0, 12)]  # 21 shingles each; a shift of 3 shares 18 of 24
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == brute([(i, " ".join(t)) for i, t in enumerate(texts)])


def test_group_of_near_copies_and_a_common_passage(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        t = list(base)
        for at in rng.integers(0, 80, 2):
            t[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(t))
    texts += [" ".join(["p%d" % i for i in range(12)] + [f"u{rng.integers(1 << 30)}" for _ in range(30)]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)))


def test_empty_table_and_kept(spark):
    assert jaccard_groups(empty(spark)).count() == 0
    docs = documents(spark)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in jaccard_groups(docs).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(groups)
    assert kept.where("doc_id is null").count() == 1


def test_one_doc_id_of_different_texts(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    texts = [(5, "one text of its own under id five"), (5, near), (5, near + " more"), (5, near + " more"), (9, near + " other"), (2, "a text that has the least id of all"), (5, "A text that has the least id of all"), (7, ""), (7, None), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    kept = sorted(((r.doc_id, r.text) for r in keep_one_of_each(docs).collect()), key=str)
    assert [t for t in kept if t[1] not in (near, near + " more")] == sorted([(5, texts[0][1]), (2, texts[5][1]), (7, ""), (7, None)], key=str)
    assert len(kept) == 5 and kept == sorted(((r.doc_id, r.text) for r in keep_one_of_each(docs.repartition(1)).collect()), key=str)


@pytest.mark.parametrize("most", [3, 300])
def test_posting_blocks_round_trip(most):
    rng = np.random.default_rng(most)
    keys, counts = rng.integers(0, 1 << 63, 20).astype(np.uint64), rng.integers(1, most + 1, 20)
    columns = rng.integers(0, 1 << 63, int(counts.sum())).astype(np.uint64)
    k, h = ngram_join._open_run(ngram_join._run_body(keys, counts, columns))
    assert k.tolist() == np.repeat(keys, counts).tolist() and h.tolist() == columns.tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.where("false")).count() == 0
