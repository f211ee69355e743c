"""The store and its facade: results, messages, lifecycle, snapshots, races."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tarnbrook import api
from tarnbrook.functions.envelope import STORAGE_ERRORS, Response, StoreError
from tarnbrook.store import DocumentStore, Record
from tarnbrook.streaming.ingest import change_counts, ingest


def model(id_, data='{"test":"data"}'):
    return Record(id_, f"hash_{id_}", data)


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore.init(spark, "main", str(tmp_path))


def test_workflow(store):
    assert store.get_by_id("1") is None and store.get().count() == 0
    for i in range(1, 4):
        assert store.post(model(str(i))) == model(str(i))
    assert store.get_by_id("2") == model("2") and store.get().count() == 3
    assert store.put(model("9")) is None
    assert store.put(model("2", '{"updated":true}')).data_json == '{"updated":true}'
    assert store.get_by_id("2").data_json == '{"updated":true}'
    assert store.post(Record("2", "x", "null")) and store.get_by_id("2").hash == "x"
    assert store.delete_by_id("9") is False and store.delete_by_id("2") is True and store.get_by_id("2") is None
    assert store.clear_all_records() == 2 and store.clear_all_records() == 0
    store.post(model("after"))
    assert [r.id for r in store.get().collect()] == ["after"]


def test_many_updates_and_keys(store):
    for i in range(99):
        store.post(model("k", json.dumps({"update_number": i})))
    assert json.loads(store.get_by_id("k").data_json) == {"update_number": 98}
    for i in range(99):
        store.post(model(f"m{i}"))
    assert sum(store.delete_by_id(f"m{i}") for i in range(0, 98, 2)) == 49
    assert store.get().count() == 51
    assert store.post(model("Key")) and store.get_by_id("key") is None


@pytest.mark.parametrize("id_, fine", [("", False), ("x" * 511, True), ("x" * 512, False), ("é" * 256, False), (" ", True), ("🦀-中文-/\\", True)])
def test_keys(store, id_, fine):
    if fine:
        store.post(model(id_))
        assert store.get_by_id(id_) == model(id_)
    else:
        with pytest.raises(StoreError):
            store.post(model(id_))


def test_persistence_isolation_and_reset(spark, tmp_path):
    a, b = (DocumentStore.init(spark, n, str(tmp_path)) for n in "ab")
    a.post(model("1"))
    b.post(model("2"))
    a.close_database()
    a.close_database()
    for call in (a.get, lambda: a.get_by_id("1"), lambda: a.post(model("x")), lambda: a.put(model("x")), lambda: a.delete_by_id("1"), a.clear_all_records):
        with pytest.raises(StoreError):
            call()
    again = DocumentStore.init(spark, "a", str(tmp_path))
    assert [r.id for r in again.get().collect()] == ["1"]
    assert again.reset_database("b") and [r.id for r in again.get().collect()] == ["2"]
    assert again.reset_database("b") and again.get().count() == 0
    assert DocumentStore.init(spark, "a", str(tmp_path)).get().count() == 0


def test_batches_equal_rows_one_by_one(spark, store):
    rows = [(i, f"k{i % 7}", f"h{i}", str(i)) for i in range(50)]
    batch = spark.createDataFrame(rows, "seq long, id string, hash string, data_json string")
    store.post(model("k3"))
    store.apply(batch, "put")
    assert {r.id: r.hash for r in store.get().collect()} == {"k3": "h45"}
    store.apply(batch, "post")
    assert {r.id: r.hash for r in store.get().collect()} == {f"k{i % 7}": f"h{i}" for i in range(50)}
    pinned = store.manifest().version
    store.apply(batch.where("id = 'k0'"), "delete")
    assert store.get().count() == 6 and store.get(pinned).count() == 7
    store.compact()
    assert store.manifest().snapshot and store.get().count() == 6 and store.get_by_id("k1").hash == "h43"


def test_concurrent_writers_lose_nothing(spark, store, tmp_path):
    def write(n):
        own = DocumentStore.init(spark, "main", str(tmp_path))
        for i in range(10):
            own.post(model(f"{n}-{i}"))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.get().count() == 50


def tag(text):
    return next(iter(json.loads(text)))


def test_facade(spark, tmp_path):
    assert api.create_db(spark, None) is None and api.create_db(spark, b"\xff") is None
    s = api.create_db(spark, "f", str(tmp_path))
    text = '{"id":"test1","hash":"hash1","data":{"key":"value"}}'
    assert api.push_data(s, text) == json.dumps({"Ok": text}, separators=(",", ":"))
    assert json.loads(api.get_by_id(s, "test1")) == {"Ok": text}
    assert json.loads(api.get_by_id(s, "no")) == {"NotFound": "No model found with id: no"}
    assert json.loads(api.update_data(s, text.replace("test1", "no"))) == {"NotFound": "Model not found for update"}
    assert tag(api.put_data(s, text.replace("value", "v2"))) == "Ok" and "v2" in api.get_by_id(s, "test1")
    assert json.loads(json.loads(api.get_all(s))["Ok"])[0]["data"] == {"key": "v2"}
    assert json.loads(api.delete_by_id(s, "no")) == {"NotFound": "No record found with id: no"}
    assert json.loads(api.delete_by_id(s, "test1")) == {"Ok": "Record deleted successfully"}
    assert json.loads(api.get_all(s)) == {"Ok": "[]"}
    assert json.loads(api.clear_all_records(s)) == {"Ok": "All records cleared successfully"}
    assert tag(api.push_data(s, '{"invalid": json structure')) == "SerializationError" == tag(api.update_data(s, "{"))
    for call in (lambda x: api.push_data(x, text), lambda x: api.get_by_id(x, "a"), api.get_all, lambda x: api.update_data(x, text), lambda x: api.delete_by_id(x, "a"), api.clear_all_records, lambda x: api.reset_database(x, "n"), api.close_database):
        assert tag(call(None)) == "BadRequest"
    for call in (api.push_data, api.get_by_id, api.update_data, api.delete_by_id, api.reset_database):
        assert tag(call(s, None)) == "BadRequest"
    assert tag(api.get_by_id(s, b"\xff")) == "BadRequest"
    assert json.loads(api.reset_database(s, "g")) == {"Ok": "Database 'g' was reset successfully"}
    assert json.loads(api.close_database(s)) == {"Ok": "Database connection closed successfully"}
    assert tag(api.push_data(s, text)) == "DatabaseError" and tag(api.push_data(s, "{")) == "SerializationError"


def test_envelope():
    assert str(Response("BadRequest", "x")) == "Bad Request: x" and Response.success(3).to_json() == '{"Ok":"3"}'
    assert Response.of_error(StoreError("KeyExist")) == Response("BadRequest", "Key already exists")
    assert Response.of_error(StoreError("7")) == Response("DatabaseError", "LMDB error code: 7")
    assert len(STORAGE_ERRORS) == 20


def test_corrupt_values(spark, store):
    store.apply(spark.createDataFrame([("good", "h", "{}", 0), ("bad", "h", '{"a"', 0)], "id string, hash string, data_json string, seq long"), "post")
    assert [r.id for r in store.get().collect()] == ["good"]
    with pytest.raises(StoreError):
        store.get_by_id("bad")


def test_streaming(spark, store, tmp_path):
    src = tmp_path / "in"
    spark.range(20).select(F.concat(F.lit("k"), F.col("id") % 5).alias("id"), F.col("id").cast("string").alias("hash"), F.lit("{}").alias("data_json"), F.col("id").alias("seq")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id string, hash string, data_json string, seq long").parquet(str(src))
    ingest(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert {r.id: r.hash for r in store.get().collect()} == {f"k{i}": str(15 + i) for i in range(5)}
    assert "window" in change_counts(spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("post").alias("op"))).columns


BIG = ["\"" + "x" * 25_000_000 + "\"", "[" * 1100 + "]" * 1100, '{"a":1,"a":2}', '{"' + "k" * 60_000 + '":1}', "[]"]


def test_scan_and_lookup_agree_on_large_and_odd_values(spark, store):
    rows = [(f"k{i}", "h", x, i) for i, x in enumerate([*BIG, "{} x", "NaN", "[" * 200_000, None])]
    store.apply(spark.createDataFrame(rows, "id string, hash string, data_json string, seq long"), "post")
    for id_, _, data, _ in rows[:3]:
        store.post(Record(f"p{id_}", "h", data))
    kept = {f"k{i}": len(x) for i, x in enumerate(BIG)} | {f"pk{i}": len(x) for i, x in enumerate(BIG[:3])}
    assert {r.id: r.n for r in store.get().selectExpr("id", "length(data_json) n").collect()} == kept
    for id_ in kept:
        assert len(store.get_by_id(id_).data_json) == kept[id_]
    for id_, *_ in rows[len(BIG) :]:
        with pytest.raises(StoreError):
            store.get_by_id(id_)
    store.compact()
    assert {r.id for r in store.get().select("id").collect()} == set(kept)


def test_apply_tells_of_every_row(spark, store):
    rows = [(0, "a"), (1, ""), (2, None), (3, "x" * 512), (4, "a"), (5, "b")]
    batch = spark.createDataFrame([(s, i, f"h{s}", "1") for s, i in rows], "seq long, id string, hash string, data_json string")
    status = lambda df: [(r.seq, r.status) for r in df.orderBy("seq").collect()]
    bad = [(s, "DatabaseError") for s in (1, 2, 3)]
    assert status(store.apply(batch.where("id <> 'b' or id is null"), "post")) == sorted([(0, "Ok"), *bad, (4, "Ok")])
    assert store.get_by_id("a").hash == "h4" and store.get().count() == 1
    assert status(store.apply(batch, "put")) == sorted([(0, "Ok"), *bad, (4, "Ok"), (5, "NotFound")])
    assert status(store.apply(batch.select("seq", "id"), "delete")) == sorted([(0, "Ok"), *bad, (4, "NotFound"), (5, "NotFound")])
    assert store.get().count() == 0


def test_a_repeated_micro_batch_is_passed_over(spark, store):
    batch = spark.createDataFrame([(0, "a", "h", "1")], "seq long, id string, hash string, data_json string")
    assert store.apply(batch, "post", stream=("s", 0)) is not None
    assert store.delete_by_id("a")
    store.compact()
    assert store.apply(batch, "post", stream=("s", 0)) is None and store.get().count() == 0
    assert store.apply(batch, "post", stream=("s", 1)) is not None and store.get().count() == 1


def test_vacuum_and_expiry(spark, store, monkeypatch):
    batch = spark.createDataFrame([(0, "a", "h", "1")], "seq long, id string, hash string, data_json string")
    for _ in range(3):
        store.apply(batch, "post")
    store.compact()
    assert store.vacuum(older_than=3600) == 0 and store.vacuum(older_than=-1) == 3
    assert store.get().count() == 1 and len(store._versions()) == 1
    monkeypatch.setattr("tarnbrook.store.KEPT_VERSIONS", 5)
    monkeypatch.setattr("tarnbrook.store.EXPIRE_EVERY", 10)
    for i in range(30):
        store.post(model(f"k{i}"))
    assert len(store._versions()) < 20 and store.get().count() == 31
    stale = store.manifest()
    store.post(model("z"))
    assert store._publish(stale) is False


def test_posts_fold_repeated_keys(spark):
    from tarnbrook.operators import ops

    state = spark.createDataFrame([("a", "old", "1")], "id string, hash string, data_json string")
    batch = spark.createDataFrame([(1, "a", "h1", "1"), (2, "a", "h2", "1"), (1, "b", "h1", "1"), (0, "b", "h9", "1")], "seq long, id string, hash string, data_json string")
    assert sorted((r.id, r.hash) for r in ops.post(state, batch).collect()) == [("a", "h2"), ("b", "h1")]
    assert sorted((r.id, r.hash) for r in ops.put(state, batch).collect()) == [("a", "h2")]
