import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnbrook.llm import pack, token_io, tokens
from tests.llm.util import clashing, documents, empty

PATH = tokens.default_path()
FRESH = Tokenizer.from_file(PATH)


def by_library(text):
    return FRESH.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 \n\t'sdmtlrve.,é½×Ω中🦀_|<> ")) | st.text(max_size=30), max_size=5))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [x[:-1].tolist() for x in tokens.encode_each(PATH, texts)] == [by_library(t) for t in texts]


def test_added_tokens_are_those_of_a_fresh_tokenizer():
    texts = ["plain", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "|> it's", "é<|endoftext|><|endoftext|>é", "<|endoftext|", None, "end<|endoftext|>", "<|endoftext|>中"] * 2
    got = [x[:-1].tolist() for x in tokens.encode_each(PATH, texts)]
    assert got == [FRESH.encode(t or "", add_special_tokens=False).ids for t in texts] and got[1] == [64, 220, 50256, 275]
    for t in texts:
        assert [x[:-1].tolist() for x in tokens.encode_each(PATH, [t])] == [FRESH.encode(t or "", add_special_tokens=False).ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "a", "'s", "é", "中", "\n"])).map("".join), max_size=5))
def test_ids_equal_a_fresh_tokenizer(texts):
    assert [x[:-1].tolist() for x in tokens.encode_each(PATH, texts)] == [FRESH.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_letter_and_mark():
    texts = [f"a{chr(i)} b {chr(i)}{chr(i)} 1{chr(i)}c\n {chr(i)}d" for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000]
    assert [x[:-1].tolist() for x in tokens.encode_each(PATH, texts)] == tokens.encoder(PATH).library(texts)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    own = tokens.Encoder(PATH)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(50)]
    for i in range(0, 50, 5):
        for ids, sizes in own.encode(texts[i : i + 5], None):
            assert ids.tolist() == [x for t in texts[i : i + 5] for x in by_library(t)]


def test_lookup_overflow():
    m = tokens.Memory()
    h = np.array([7, 7 | 1 << 20, 7 | 1 << 21], dtype=np.uint64)  # one first slot for all
    m.add(h, np.array([1, 2, 0]), np.array([5, 6, 7], dtype="<u4"))
    assert m.find(h).tolist() == [0, 1, 2] and m.find(np.array([9], np.uint64)).tolist() == [-1]
    assert m.gather(np.array([1, 2, 0, 1]))[0].tolist() == [6, 7, 5, 6, 7]


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_packing(spark, change):
    docs = documents(spark)
    got = pack.pack(change(docs.repartition(5)), length=128, open_bins=8).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len({r.sequence_id for r in got}) <= 1.1 * sum(r.length for r in got) / 128 + 2
    places = {}
    for r in got:
        assert len(r.ids) == 4 * r.length <= 512
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 128
    for doc_id, own in texts.items():
        ids = np.array(by_library(own[0]) + [0], dtype="<u4").tobytes()
        mine = sorted({(r.piece, r.start, r.length, bytes(r.ids)) for r in got if r.doc_id == doc_id})
        assert b"".join(x[3] for x in mine) == ids and [x[1] for x in mine] == [sum(y[2] for y in mine[:i]) for i in range(len(mine))]
        assert sum(r.doc_id == doc_id for r in got) == len(mine) * len(own)
        if len(ids) > 512:
            assert {x[2] for x in mine[1:]} == {128}
    assert pack.pack(empty(spark)).count() == 0


def test_every_level_has_a_fixed_number_of_open_bins(spark, monkeypatch):
    limits = []
    own = pack._pack
    monkeypatch.setattr(pack, "_pack", lambda source, level, length, open_bins, handed_on: limits.append((open_bins, handed_on)) or own(source, level, length, open_bins, handed_on))
    pack.pack(documents(spark).repartition(40), length=128, open_bins=8)
    assert limits == [(8, 8), (8 * pack.FAN_IN, 8), (8 * pack.FAN_IN, 0)]


@pytest.mark.parametrize("splits", [1, 33])
def test_sequences_are_few_in_spark(spark, splits):
    got = pack.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(splits)).agg(F.countDistinct("sequence_id").alias("made"), F.sum("length").alias("ids")).first()
    assert got.made <= 1.01 * got.ids / pack.LENGTH + 1


def pieces_in(sizes, length):
    return [n for s in sizes for n in ([s] if s <= length else [s % length] * (s % length > 0) + [length] * (s // length))]


@pytest.mark.parametrize("splits", [1, 2, 33, 40, 64, 200])
def test_sequences_are_few_however_the_input_is_split(splits):
    """The levels of pack() as they run in tasks, on the piece lengths of sf0.1; at most 1 % over the floor."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text")
    sizes = [n for c in texts.chunks for _, own in tokens.encoder(PATH).encode(c) for n in own.tolist()]
    own = pieces_in(sizes, pack.LENGTH)
    tasks = [own[i * len(own) // splits : (i + 1) * len(own) // splits] for i in range(splits)]
    made, level = 0, 0
    while True:
        last = level and len(tasks) == 1
        handed = []
        for task in tasks:
            bins = pack.OpenBins(pack.LENGTH, pack.OPEN_BINS * (pack.FAN_IN if level else 1))
            for n in pack.looked_ahead(sorted(task, reverse=True) if level else task, int, pack.LOOK_AHEAD * bins.limit):
                made += len(list(pack._split(c))) if (c := bins.add(n, n)) else 0
            rest = bins.rest()[::-1]
            made += len(rest[0 if last else pack.OPEN_BINS :])
            handed.append([n for items in rest[: 0 if last else pack.OPEN_BINS] for n in items])
        if last:
            break
        tasks = [sum(handed[i :: -(-len(tasks) // pack.FAN_IN)], []) for i in range(-(-len(tasks) // pack.FAN_IN))]
        level += 1
    assert made <= 1.001 * sum(own) / pack.LENGTH + 1


def test_look_ahead():
    assert list(pack.looked_ahead([3, 1, 2, 5, 4, 6, 7], int, 3)) == [3, 2, 1, 6, 5, 4, 7] and list(pack.looked_ahead([], int, 3)) == []


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = pack.OpenBins(10, 2)
    assert bins.add(6, "a") is None and bins.add(8, "b") is None
    assert bins.add(2, "c") == ["b", "c"]
    assert bins.add(7, "d") is None and bins.add(9, "e") == ["d"]
    assert bins.rest() == [["e"], ["a"]]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
    sizes = np.diff(np.unique(np.concatenate(([0, n], rng.integers(0, n + 1, 5)))), prepend=0)
    sizes = np.concatenate((sizes[:1], [0], sizes[1:], [0]))
    control, control_ends, data, data_ends = token_io.encode_documents(x, sizes)
    assert token_io.decode_documents(control, data, sizes).tolist() == x.tolist()
    first = np.cumsum(sizes) - sizes
    for i, k in enumerate(sizes.tolist()):  # each document by itself, in plain Python
        own, c, d = x[first[i] : first[i] + k].tolist(), bytearray(-(-k // 4)), b""
        for j, v in enumerate(own):
            size = max(1, -(-v.bit_length() // 8))
            c[j // 4] |= (size - 1) << 2 * (j % 4)
            d += v.to_bytes(size, "little")
        lo = [0, *control_ends.tolist()][i], [0, *data_ends.tolist()][i]
        assert (bytes(control[lo[0] : control_ends[i]]), bytes(data[lo[1] : data_ends[i]])) == (bytes(c), d)


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_files_round_trip(spark, tmp_path, change):
    docs = documents(spark)
    shards = token_io.write_ids(change(docs.repartition(3)), f"file://{tmp_path}/ids", shard_ids=2000)
    assert shards.count() > 2
    got = sorted(token_io.read_ids(shards).collect(), key=lambda r: r.start)
    expected = sorted(((r.doc_id, np.array(by_library(r.text) + [0], dtype="<u4").tobytes()) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.doc_id, bytes(r.ids)) for r in got] == expected
    assert [r.start for r in got] == [sum(len(x[1]) // 4 for x in expected[:i]) for i in range(len(expected))]
    assert token_io.read_ids(token_io.write_ids(empty(spark))).count() == 0


def test_a_hot_doc_id_is_dealt_over_tasks(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of many") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    shards = token_io.write_ids(docs, f"file://{tmp_path}/hot")
    assert max(r.documents for r in shards.collect()) < 200
    got = sorted(token_io.read_ids(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array(by_library(t) + [0], dtype="<u4").tobytes() for _, t in rows)
    assert [r.start for r in got] == [sum(len(x.ids) // 4 for x in got[:i]) for i in range(len(got))]


def test_op1_query(spark):
    from tarnbrook.llm.queries import op1_best_fit_packing

    got = op1_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kinds = dict(got.dtypes)
    assert kinds["piece"] == "int" and {kinds[c] for c in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"bigint"}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    seen = {}
    for r in got.collect():
        ids = np.array(by_library(texts[r.doc_id]) + [0], dtype="<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length <= 2048 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append(r.length)
    assert {d: sum(x) for d, x in seen.items()} == {d: len(by_library(t)) + 1 for d, t in texts.items()}


def test_damage_is_noticed(tmp_path):
    id_of = np.array([9, 5], "<u4")
    sizes = [3, 0]
    control, _, data, _ = token_io.encode_documents(np.array([1, 1, 0]), np.array(sizes))
    with open(tmp_path / "x", "wb") as f:
        token_io.write_shard(f, [1, None], sizes, [control.tobytes(), b""], [data.tobytes(), b""], zlib.crc32(id_of.tobytes()))
    body = (tmp_path / "x").read_bytes()
    ids, lengths, all_ids = token_io.read_shard(body, id_of)
    assert (ids, lengths.tolist(), all_ids.tolist()) == ([1, None], [3, 0], [5, 5, 9])
    for bad, ranking in ((body[:-6] + b"\xff" + body[-5:], id_of), (body, id_of[::-1])):
        with pytest.raises(ValueError):
            token_io.read_shard(bad, ranking)
    ranking = token_io.ranking_body(id_of)
    assert token_io.read_ranking(ranking).tolist() == [9, 5]
    with pytest.raises(ValueError):
        token_io.read_ranking(ranking[:-1] + b"\x00")


def test_the_ranking_counts_all_documents(spark, tmp_path):
    docs = documents(spark)
    token_io.write_ids(docs.repartition(6), f"file://{tmp_path}/ids")
    counts = {}
    for r in docs.collect():
        for x in [*by_library(r.text), 0]:
            counts[x] = counts.get(x, 0) + 1
    got = token_io.read_ranking((tmp_path / "ids" / token_io.RANKING_FILE).read_bytes()).tolist()
    assert got == sorted(counts, key=lambda x: (-counts[x], x))


def test_query_digest(spark):
    from tarnbrook.llm.queries import op10_token_ids

    r = op10_token_ids(spark, "/root/testdata/sf0.001").where(F.col("doc_id") == 0).first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first().text
    assert (r.start, r.ids_crc32) == (0, zlib.crc32(np.array(by_library(text) + [0], "<u4").tobytes()))
