"""Decontamination, chat formatting, WARC, HTML text, top-k: brute force, SQL, round trips, hard cases."""

import base64
import hashlib
import random

import duckdb
import pytest

from tarnbrook.llm import chat, cover_tree, decontaminate, html_text, queries, warc
from tests.llm.util import clashing, documents, empty, prose, rows

DATA = "/root/testdata/sf0.001"


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, "en", rng.randint(8, 30))) for i in range(12)]
    docs = []
    for i in range(80):
        words = prose(rng, "en", 40).split()
        if i % 2:
            own = items[i % 12][1].split()
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(["zzz", "the", "yyy"])
            if i % 3 == 0:
                own.pop(rng.randrange(len(own)))
            words[20:20] = own
        docs.append((i, (" " if i % 4 else "\n").join(words).upper() if i % 5 == 0 else " ".join(words)))
    expected = set()
    for d, t in docs:
        for k, x in items:
            a, b = decontaminate.words_of(x), decontaminate.words_of(t)
            if (n := distance(a, b)) <= int(0.2 * len(a)):
                expected.add((d, k, n))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected and len(found) == len(expected) > 20
    for r in found:
        a, b = decontaminate.words_of(items[r.item_id][1]), decontaminate.words_of(docs[r.doc_id][1])
        assert distance(a, b[r.first_word : r.end_word]) == r.distance


def test_leak_cases(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, docs.where("doc_id = 7").first().text), (None, "x y"), (5, "absent words only")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(clashing(docs), clashing(items)).collect()} >= {(7, 4, 0)}
    assert not decontaminate.find_leaks(docs, items).where("item_id <> 4").count()
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0 == decontaminate.find_leaks(empty(spark), items).count()
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and 7 not in {r.doc_id for r in kept.collect()} and kept.count() < docs.count()


@pytest.mark.parametrize("item, letters", [("今天天气很好我们一起去公园散步然后回家吃饭", 21), ("わたしは昨日ともだちと映画を見に行きました", 21), ("วันนี้อากาศดีมากเราไปเดินเล่นที่สวนกันเถอะ", None)])
def test_leaks_without_spaces_between_words(item, letters):
    own = decontaminate.words_of(item)
    assert "".join(own) == item and len(own) == (letters or len(own)) >= 20
    matcher = decontaminate.Matcher([(1, item)], 0.2)
    for k in (3, len(own) // 2):
        changed = "".join([*own[:k], own[k + 1] if own[k + 1] != own[k] else own[k + 2], *own[k + 1 :]])
        assert [f[:2] for f in matcher.find(f"{own[5]}{own[2]}x{changed}{own[7]}{own[1]} plain words")] == [(1, 1)]
    assert [f[:2] for f in matcher.find(own[9] * 3 + item + own[9] * 3)] == [(1, 0)] and matcher.find("".join(own[::-1])) == []
    assert decontaminate.words_of("Größe été_2 한국어 문장 中a1文") == ["größe", "été", "2", "한국어", "문장", "中", "a1", "文"]


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(i, "w " * 50) for i in range(20)], "item_id long, text string")
    assert len(decontaminate.blocks(items, 0.2, most=400)) == 5


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert rows(got, *columns) == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall(), key=str)


def test_chat(spark):
    turns = [("p", "chosen", 0, "user", "hi"), ("p", "rejected", 0, "user", "hi"), ("p", "chosen", 1, "assistant", "good"), ("p", "rejected", 1, "assistant", "bad"), ("p", "rejected", 1, "assistant", "bad"), ("p", "chosen", 2, "user", "more"), ("q", "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), ("p", "other", 0, "user", "x")]
    ids = {"p": 1, "q": 2, None: None}
    sides = spark.createDataFrame([(ids[a], *rest) for a, *rest in turns], "pair_id long, side string, turn long, role string, text string")
    got = {(r.pair_id, r.part, r.turn): r for r in chat.format_preferences(clashing(sides)).collect()}
    assert set(got) == {(1, "prompt", 0), (1, "chosen", 1), (1, "rejected", 1), (1, "chosen", 2), (2, "chosen", 0)}
    r = got[1, "chosen", 1]
    assert r.rendered[r.loss_begin : r.loss_end] == "good<|im_end|>\n" and r.rendered.startswith("<|im_start|>assistant\n")
    assert all(got[k].loss_end == 0 for k in ((1, "prompt", 0), (1, "chosen", 2), (2, "chosen", 0))) and got[2, "chosen", 0].role == "unknown"
    whole = {r.pair_id: r for r in chat.assemble(chat.format_preferences(sides)).collect()}
    assert whole[1].chosen == got[1, "chosen", 1].rendered + got[1, "chosen", 2].rendered and whole[1].prompt == got[1, "prompt", 0].rendered
    assert chat.format_preferences(sides.where("false")).count() == 0
    plan = chat.format_preferences(sides)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [(1, "http://a/ é", "<p>one"), (2, None, "<p>one"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\nü"), (0, "late", "x\r\n\r\nWARC/1.1\r\nü"), (None, "n", "<p>one"), (7, "u", "y" * 300_000), (5, "u", "x\r\n\r\nWARC/1.1\r\nü")]


def pages(spark):
    return clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_warc_round_trip(spark, tmp_path):
    folder = warc.write_pages(pages(spark).repartition(3), f"file://{tmp_path}/w")
    got = warc.read_records(spark, folder).withColumn("page_id", warc.page_of("record_id")).withColumn("first", warc.page_of("refers_to")).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(PAGES)
    for r in got:
        h = next(h for i, _, h in PAGES if i == r.page_id) or ""
        revisit = r.page_id is not None and first[h] != r.page_id
        assert (r.record_type, r.first) == (("revisit", first[h]) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert r.payload is None if revisit else bytes(r.payload) == h.encode()
    no_payload = warc.read_records(spark, folder, payload=False).where("record_type = 'revisit'")
    assert no_payload.count() == sum(r.record_type == "revisit" for r in got) and no_payload.where("payload is not null").count() == 0
    alone = warc.write_pages(pages(spark), f"file://{tmp_path}/v", least_bytes=100)
    assert warc.read_records(spark, alone).where("record_type = 'revisit'").count() == 0
    assert warc.read_records(spark, warc.write_pages(pages(spark).where("false"), f"file://{tmp_path}/e")).count() == 0


def test_warc_predicates_are_pushed_and_blocks_skipped(tmp_path):
    from pyspark.sql.datasource import EqualTo, In

    reader = warc.WarcReader({"path": str(tmp_path)})
    other = EqualTo(("payload_bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("u",)), other])) == [other]
    with open(tmp_path / "x.warc", "wb") as f:
        f.write(warc.record(1, "u", b"payload") + warc.record(2, "u", b"payload", 1) + warc.record(3, "v", b"payload", 1))
    (partition,) = reader.partitions()
    assert [b.column("record_id").to_pylist() for b in reader.read(partition)] == [["<urn:page:2>"]]


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_cut_and_changed_archives_are_errors(tmp_path, suffix):
    import gzip

    body = warc.record(1, "u", b"first " * 50) + warc.record(2, "u", b"payload " * 50) + warc.record(3, "v", b"x", 1)
    path = tmp_path / f"x.warc{suffix}"

    def read(data, **options):
        path.write_bytes(gzip.compress(data) if suffix else data)
        with warc._open(str(path)) as f:
            return list(warc.records(f, **options))

    wanted = lambda h: h[b"warc-record-id"] == b"<urn:page:3>"
    every = [{}, {"payloads": False}, {"payloads": False, "verify": True}, {"wanted": lambda h: False}, {"wanted": wanted}]
    starts = [0, len(warc.record(1, "u", b"first " * 50)), len(warc.record(1, "u", b"first " * 50) + warc.record(2, "u", b"payload " * 50)), len(body)]
    for options in every:
        read(body, **options)
        for cut in range(1, len(body), 7):
            whole = any(0 <= s - cut <= 2 for s in starts)  # all but the last line ends
            if whole:
                read(body[:cut], **options)
            else:
                with pytest.raises(ValueError):
                    read(body[:cut], **options)
    changed = body.replace(b"first first", b"first First", 1)
    assert len(read(changed, payloads=False)) == 3
    with pytest.raises(ValueError):
        read(changed, payloads=False, verify=True)


HTML = [
    ("<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>First <b>bold</b>\n  text<br>next</p><p>Second</article><footer>foot</footer>", "T & U\nFirst bold text next\nSecond"),
    ("<body><div class='sidebar'>side</div><div id=main><p>Hello there, this is the long text of a page.</p><p>Short.</p></div><div class=comments><p>nice post</p></div>", "Hello there, this is the long text of a page.\nShort."),
    ("<article><p>a<script>var x='</p>'</script>b</p><!-- <p>no</p> --><ul><li>one<li>two</ul><form><p>no</p></form><aside>no</aside><div class='ad'>no</div></article>", "ab\none\ntwo"),
    ("just text &lt;here&gt;", "just text <here>"), ("", ""), (None, ""), (" \n ", ""), ("<nav>only menus</nav>", ""), ("<p>a<p>b", "a\nb"),
    ("<article><header><h1>Title</h1></header><p>x</p></article><header>site</header>", "Title\nx"), ("<div>" * 2000 + "deep", "deep"), ("<p title='a>b'>c</p>", "c"),
    ("<article><p>See <a href='/hidden/nav' title='the hidden id'>this <i data-id=nav>one</i></a> now.</p></article>", "See this one now."),
    ("<body class='has-sidebar'><article class='post comments-open'><p>Kept.</p></article><article class='comment'><p>me too</p></article>", "Kept."),
    ("<div class='layout with-sidebar'><div class='entryHeader'><h1>Head</h1></div><p>A long enough text of the page.</p><div class=userComments><p>no</p></div></div><div id=siteHeader>site</div><div class=pageFooter>foot</div><ol class=commentlist><li>said</ol>", "Head\nA long enough text of the page."),
    ("<main><article><h1>T</h1><p>The text of it.</p></article><article class=related><p>Another text, of which more.</p></article></main>", "T\nThe text of it."),
    ("<article><p>a</p><div style='display: none'>b</div><section class=commentary><p>c</p></section></article>", "a\nc"),
]


HTML_KEPT = [
    ("<article><p>a</p><h2 id='related-work'>Related work</h2><section id='social-impact'><p>b</p></section><section id='advertising-revenue'><p>c</p></section><p id='notice-of-termination'>d</p></article>", "a\nRelated work\nb\nc\nd"),
    ("<article><p>a</p><div class='social-impact'>b</div><p class='notice'>c</p><h2 id=comments>d</h2><section class='related-posts'>no</section><div id='comments'>no</div><ul class='share-buttons'><li>no</ul><div id=siteFooter>no</div></article>", "a\nb\nc\nd"),
    ("<body><h1 id='cookie-law'>Law</h1><p>A long enough text of the page, which goes on.</p><section id='cookie-consent-in-law'><p>Another text of it, as long as the first one.</p></section><div id=comments><p>no</p></div></body>", "Law\nA long enough text of the page, which goes on.\nAnother text of it, as long as the first one."),
    ("<body><div class='social-impact'><article><p>a</p></article></div></body>", "a"), ("<div class='social-impact'><p>only this</p></div>", "only this"),
    ("<article><p>As <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E = m</annotation></math> says.</p></article>", "As E=m E = m says."),
    ("<article><p>a</p><select><option>x<option>y<p>b</p><select><option>z</select><p>c</p><math><mi>d</mi><p>e</p></article>", "a\nb\nc\nd\ne"),
    ("<article><p>a<svg/>b</p><template><p>c</p><svg><g><svg><text>no</text></svg></g></svg><noscript>d<p>e</p></article>", "ab\nc\nd\ne"),
]


@pytest.mark.parametrize("page, text", HTML_KEPT)
def test_html_keeps_what_only_looks_like_a_part(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("page, text", HTML)
def test_html(page, text):
    assert html_text.extract(page) == text


def test_html_query(spark):
    table = clashing(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(HTML)] + [(None, None, None)], "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in html_text.main_text(table).collect()}
    assert got == dict(enumerate(t for _, t in HTML)) | {None: ""}
    assert html_text.main_text(table.where("false")).count() == 0


def brute_top(vectors, every, k):
    good = [(i, [int(256 * x // 1) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = set()
    for q, v in good:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return sorted(out, key=str)


@pytest.mark.parametrize("block, data_block", [(7, 10_000), (10_000, 50), (10, 7)])
def test_top_k(spark, block, data_block):
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(400 + i, list(vectors[3][1])) for i in range(30)]  # ties
    vectors += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (None, [1.0] * 6), (540, [1.0, 2.0]), (541, [0.5, 1.0]), (550, [])]
    table = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3))
    assert rows(cover_tree.top_k(table, every=10, query_block=block, data_block=data_block), "query_id", "rank", "vec_id", "score") == brute_top(vectors, 10, 5)
    assert cover_tree.top_k(table.where("false")).count() == 0
    assert cover_tree.top_k(table.where("vec_id = 10"), every=10).count() == 0


def test_trees_prune():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 50
    data = np.repeat(centres, 500, axis=0) + rng.normal(size=(10_000, 8))
    tree, few = cover_tree.CoverTree(data), cover_tree.CoverTree(data[::500], leaf=4)
    found = cover_tree.TopK(20, 5)
    pairs = cover_tree.dual_search(few, np.arange(20) + 10**6, tree, np.arange(10_000), found)
    assert (np.sort(data[::500] @ data.T, axis=1)[:, -5:][:, ::-1] == pytest.approx(found.scores))
    assert pairs < 0.5 * sum(not c for c in tree.children) * sum(not c for c in few.children)


def test_op4_query(spark):
    got = queries.op4_decontaminate(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("distance", "int"), ("first_word", "int"), ("end_word", "int")]
    docs = {r.doc_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    expected = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        own = decontaminate.words_of(r.text)
        bits = {w: sum(1 << i for i, x in enumerate(own) if x == w) for w in own}
        for d, words in docs.items():
            if own and (n := decontaminate.myers(bits, len(own), words)[0]) <= int(0.2 * len(own)):
                expected.add((d, r.item_id, n))
    found = got.collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected and len(found) == len(expected) > 0
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert all(distance(items[r.item_id], docs[r.doc_id][r.first_word : r.end_word]) == r.distance for r in found)


def test_op8_query(spark):
    got = queries.op8_html_text(spark, DATA)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: (r.url, html_text.extract(r.html)) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert {r.page_id: (r.url, r.text) for r in got.collect()} == pages
    assert all(r.n_chars == len(r.text) > 0 for r in got.collect())
