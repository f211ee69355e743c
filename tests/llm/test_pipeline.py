"""The pipeline against a brute-force version of each of its stages."""

import pytest

from tarnbrook.llm import decontaminate, langid, ngram_join, pack, toxicity
from tests.llm.test_ngram_join import brute
from tests.llm.util import SCHEMA, clashing, documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    table = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, table = table, stage(spark, table, DATA).cache()
        assert table.columns == docs.columns
        if name == "language_id":
            kept = [(d, t) for (d, t), l in zip(kept, langid.train(before).label([t for _, t in kept])[0]) if l != "und"]
        elif name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(before, labels).collect()}
            kept = [(d, t) for d, t in kept if scores[d] < 0.5]
        elif name == "ngram_jaccard_join":
            first = {c for _, _, c in brute(kept)}
            kept = [(d, t) for d, t in kept if d in first]
        else:
            bad = set()
            for item_id, text in items:
                own = decontaminate.words_of(text)
                bits = {w: sum(1 << i for i, x in enumerate(own) if x == w) for w in own}
                bad |= {d for d, t in kept if decontaminate.myers(bits, len(own), decontaminate.words_of(t))[0] <= int(0.2 * len(own))}
            kept = [(d, t) for d, t in kept if d not in bad]
        assert sorted((r.doc_id, r.text) for r in table.collect()) == sorted(kept), name
    packed = corpus_pipeline.STAGES[4][1](spark, table, DATA)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in kept}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_empty_documents(spark):
    table = clashing(spark.createDataFrame([], SCHEMA))
    for _, stage in corpus_pipeline.STAGES[:4]:
        table = stage(spark, table, DATA)
        assert table.count() == 0 and table.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[4][1](spark, table, DATA).count() == 0


def test_hard_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns through every filtering stage."""
    table = clashing(documents(spark))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x"), (2, documents(spark).where("doc_id = 8").first().text)], "item_id long, text string")
    count = lambda d: sorted((str(r.doc_id), r.text or "") for r in d.collect())
    before = count(table)
    told = langid.keep_identified(table)
    assert count(told) == [r for r in before if r[0] not in ("3000", "3001", "3002", "3005")]
    clean = toxicity.keep_clean(table, labels)
    assert count(clean) == before  # no toxic example: nothing is toxic
    one = ngram_join.keep_one_of_each(table)
    kept = count(one)
    with_id = sorted({r for r in before if r[0] != "None"})
    least = {c for _, _, c in brute([(int(d), t) for d, t in with_id])}
    assert kept == sorted([r for r in with_id if int(r[0]) in least] + [r for r in before if r[0] == "None"])
    free = decontaminate.drop_leaks(table, clashing(items))
    assert count(free) == [r for r in before if r[0] != "8"]
    assert told.columns == clean.columns == one.columns == free.columns == table.columns
    assert {str(r.doc_id) for r in pack.pack(table).select("doc_id").collect()} == {d for d, _ in before}
