"""The driver's queries over documents made from its tables, and the SQL they must agree with."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api
from ..functions.envelope import DISPLAY, STORAGE_ERRORS, Response, StoreError, display
from ..operators import fold, ops
from ..store import DocumentStore


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _root(spark: SparkSession) -> str:
    """A folder for the stores of a query: in the cluster's shared folder, or in local mode, where none is set, one of
    this machine. Stores need a mounted path."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if not shared and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return tempfile.mkdtemp()
    path = urlparse(shared).path if shared.startswith(("file:", "/")) else ""
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that is mounted on all machines")
    os.makedirs(path, exist_ok=True)
    return tempfile.mkdtemp(dir=path)


def _kv(df: DataFrame, key: str, hashed: str, data: str = "'{}'") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.sha2(F.col(hashed).cast("string"), 256).alias("hash"), F.expr(data).alias("data_json"))


def orders(spark, d) -> DataFrame:
    return _kv(_read(spark, d, "orders"), "o_orderkey", "o_orderpriority", """concat('{"status":"', o_orderstatus, '"}')""")


def customers(spark, d) -> DataFrame:
    return _kv(_read(spark, d, "customer"), "c_custkey", "c_name", """concat('{"segment":"', c_mktsegment, '"}')""")


def suppliers(spark, d) -> DataFrame:
    return _kv(_read(spark, d, "supplier"), "s_suppkey", "s_name", """concat('{"nation":', s_nationkey, '}')""")


_ORDERS = """select cast(o_orderkey as varchar) as id, sha256(o_orderpriority) as hash, '{"status":"' || o_orderstatus || '"}' as data_json from orders"""
_CUSTOMERS = """select cast(c_custkey as varchar) as id, sha256(c_name) as hash, '{"segment":"' || c_mktsegment || '"}' as data_json from customer"""
_SUPPLIERS = """select cast(s_suppkey as varchar) as id, sha256(s_name) as hash, '{"nation":' || s_nationkey || '}' as data_json from supplier"""
#: Rows of a batch on orders: the orders that lineitem knows, and the parts as new keys.
_BATCH = "select id, sha256(id) as hash, '{\"new\":true}' as data_json from (select distinct cast(l_orderkey as varchar) as id from lineitem union all select 'n' || p_partkey from part)"
#: Keys to delete: the customers of orders, whose numbers are also numbers of orders, and the suppliers as unknown ones.
_KEYS = "select distinct cast(o_custkey as varchar) as id from orders union all select 'x' || s_suppkey from supplier"


def _batch(spark, d) -> DataFrame:
    known = _read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    ids = known.unionByName(_read(spark, d, "part").select(F.concat(F.lit("n"), "p_partkey").alias("id")))
    return ids.select("id", F.sha2("id", 256).alias("hash"), F.lit('{"new":true}').alias("data_json"))


def _keys(spark, d) -> DataFrame:
    known = _read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return known.unionByName(_read(spark, d, "supplier").select(F.concat(F.lit("x"), "s_suppkey").alias("id")))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _stored(spark, name: str, docs: DataFrame, root: str | None = None) -> DocumentStore:
    """A new store that holds these documents."""
    store = DocumentStore.init(spark, name, root or _root(spark))
    store.apply(docs.withColumn("seq", F.lit(0)), "post")
    return store


@query(_ORDERS)
def get_all_orders(spark, d):
    return _stored(spark, "orders", orders(spark, d)).get()


@query(f"with kv as ({_CUSTOMERS}) select id, k as place from (select id, (select count(*) from kv b where b.id <= a.id) as k from kv a)")
def get_all_key_order(spark, d):
    """Places in key order: a range sort, the count of each range, and the place within it; no single task sees all. The
    sorted table is written once, so its ranges are the same wherever they are read."""
    path = f"file://{os.path.abspath(_root(spark))}/ordered"
    ops.get_all(customers(spark, d).select("id")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path)
    ranged = spark.read.schema("id string, part int, at long").parquet(path)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    return ranged.join(before, "part").select("id", (F.col("before") + F.col("at") + 1).alias("place"))


@query(f"select * from ({_CUSTOMERS}) where id = '42'")
def get_by_id_hit(spark, d):
    return ops.get_by_id(customers(spark, d), "42")


@query("with keys as (select 'Key' || n_nationkey as id from nation union all select 'key' || n_nationkey from nation where n_nationkey in (select r_regionkey from region)) select p.id, k.id is not null as found from (select 'Key' || n_nationkey as id from nation union all select 'key' || n_nationkey from nation union all select 'KEY' || n_nationkey from nation) p left join keys k using (id)")
def get_by_id_case_sensitive(spark, d):
    nation = _read(spark, d, "nation")
    named = lambda w, df=nation: df.select(F.concat(F.lit(w), "n_nationkey").alias("id"))
    state = named("Key").unionByName(named("key", nation.join(_read(spark, d, "region"), F.col("n_nationkey") == F.col("r_regionkey"), "left_semi"))).select("id", F.lit("").alias("hash"), F.lit("{}").alias("data_json"))
    probes = named("Key").unionByName(named("key")).unionByName(named("KEY"))
    return ops.get_many(state, probes).select("id", (F.col("status") == "Ok").alias("found"))


@query("""select id, case when c.c_custkey is null then 'NotFound' else 'Ok' end as status, case when c.c_custkey is null then 'No model found with id: ' || id else 'found' end as message
from (select cast(o_custkey * 2 as varchar) as id from orders group by 1) p left join customer c on cast(c.c_custkey as varchar) = p.id""")
def get_by_id_response(spark, d):
    probes = _read(spark, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("id")).distinct()
    return ops.get_responses(customers(spark, d), probes)


@query(f"{_ORDERS} union all select id, hash, data_json from ({_BATCH}) where id like 'n%'")
def post_insert_new(spark, d):
    return ops.post(orders(spark, d), _batch(spark, d).where("id like 'n%'"))


@query(f"with b as ({_BATCH}) select * from ({_ORDERS}) where id not in (select id from b) union all select * from b")
def post_overwrite(spark, d):
    return ops.post(orders(spark, d), _batch(spark, d))


@query("""select cast(l_partkey as varchar) as id, sha256(cast(arg_max(l_orderkey, {'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey, 'd': l_shipdate}) as varchar)) as hash
from lineitem group by l_partkey""")
def post_batch_last_wins(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    last = ops.last_of_each(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"])
    return last.select("id", F.sha2(F.col("l_orderkey").cast("string"), 256).alias("hash"))


@query(f"with b as ({_BATCH}), o as ({_ORDERS}) select * from o where id not in (select id from b) union all select * from b where id in (select id from o)")
def put_existing_only(spark, d):
    return ops.put(orders(spark, d), _batch(spark, d))


@query(f"with o as ({_ORDERS}) select b.id, case when o.id is null then 'NotFound' else 'Ok' end as status, case when o.id is null then 'Model not found for update' else 'updated' end as message from ({_BATCH}) b left join o using (id)")
def put_response(spark, d):
    return ops.put_responses(orders(spark, d), _batch(spark, d))


@query(f"select * from ({_ORDERS}) where id not in ({_KEYS})")
def delete_existing(spark, d):
    return ops.delete(orders(spark, d), _keys(spark, d))


@query(f"with o as ({_ORDERS}) select k.id, case when o.id is null then 'NotFound' else 'Ok' end as status, case when o.id is null then 'No record found with id: ' || k.id else 'Record deleted successfully' end as message from ({_KEYS}) k left join o using (id)")
def delete_response(spark, d):
    return ops.delete_responses(orders(spark, d), _keys(spark, d))


@query("select count(*) as cleared from supplier")
def clear_count(spark, d):
    return ops.clear(suppliers(spark, d))


def _supplier_log(spark, d) -> DataFrame:
    """A post of every supplier, a clear, then a post of those whose key is also that of a nation."""
    s = _read(spark, d, "supplier")
    kv = lambda df, seq: _kv(df, "s_suppkey", "s_name").select(F.expr(seq).cast("long").alias("seq"), F.lit("post").alias("op"), "id", "hash", "data_json")
    clear = spark.createDataFrame([(1_000_000_000, "clear", None, None, None)], "seq long, op string, id string, hash string, data_json string")
    return kv(s, "cast(id as long)").unionByName(clear).unionByName(kv(s.join(_read(spark, d, "nation"), F.col("s_suppkey") == F.col("n_nationkey"), "left_semi"), "1000000001 + cast(id as long)"))


@query("select cast(s_suppkey as varchar) as id, sha256(s_name) as hash from supplier where s_suppkey in (select n_nationkey from nation)")
def clear_then_post(spark, d):
    return fold.state_with_clear(_supplier_log(spark, d)).select("id", "hash")


@query("select 'region' as store, cast(r_regionkey as varchar) as id, sha256(r_name) as hash from region")
def reset_keeps_target(spark, d):
    """A store of nations is reset to the name of a store of regions: its own documents go, the target's stay."""
    root = _root(spark)
    target, source = DocumentStore.init(spark, "region", root), DocumentStore.init(spark, "nation", root)
    for store, table, key, name in ((target, "region", "r_regionkey", "r_name"), (source, "nation", "n_nationkey", "n_name")):
        store.apply(_kv(_read(spark, d, table), key, name).withColumn("seq", F.lit(0)), "post")
    source.reset_database("region")
    return source.get().select(F.lit(source.name).alias("store"), "id", "hash")


def _event_log(spark, d) -> DataFrame:
    op = F.expr("case event_type when 'signup' then 'post' when 'error' then 'delete' when 'purchase' then 'get' else 'put' end")
    return _read(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.sha2("props", 256).alias("hash"), F.col("props").alias("data_json"))


_LOG = "select event_id as seq, case event_type when 'signup' then 'post' when 'error' then 'delete' when 'purchase' then 'get' else 'put' end as op, cast(user_id as varchar) as id, sha256(props) as hash, props as data_json from events"


def _state_sql(log: str) -> str:
    return f"""select id, v.h as hash, v.d as data_json from (
  select id, arg_max(op, seq) filter (op in ('post', 'delete')) as e, arg_max({{'h': hash, 'd': data_json}}, seq) filter (op in ('post', 'put')) as v
  from ({log}) group by id) where e = 'post'"""


@query(_state_sql(_LOG))
def oplog_replay(spark, d):
    return fold.state(_event_log(spark, d))


@query(f"""select seq, op, id, case when op = 'post' or last = 'post' then 'Ok' else 'NotFound' end as status from (
  select *, last_value(case when op in ('post', 'delete') then op end ignore nulls) over (partition by id order by seq rows between unbounded preceding and 1 preceding) as last from ({_LOG}))""")
def oplog_responses(spark, d):
    return fold.responses(_event_log(spark, d))


@query(_state_sql(f"{_LOG} where event_id > (select max(event_id) * 9 // 10 from events)"))
def oplog_replay_with_clear(spark, d):
    events = _event_log(spark, d)
    clear = events.agg(F.expr("max(seq) * 9 div 10").alias("seq")).select("seq", F.lit("clear").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("id", "hash", "data_json")])
    return fold.state_with_clear(events.unionByName(clear))


@query(_state_sql(f"{_LOG} where event_id <= (select max(event_id) // 2 from events)"))
def snapshot_as_of(spark, d):
    log = _event_log(spark, d)
    return fold.as_of(log, log.agg(F.expr("max(seq) div 2")).scalar())


@query(_state_sql(_LOG))
def snapshot_and_tail(spark, d):
    log = _event_log(spark, d)
    middle = log.agg(F.expr("max(seq) div 3")).scalar()
    return fold.state(fold.with_snapshot(fold.as_of(log, middle), log.where(F.col("seq") > middle)))


_CORRUPT = "select cast(event_id as varchar) as id, case when event_id % 10 = 0 then substr(props, 1, length(props) - 1) when event_id % 10 = 1 then substr(props, 1, 3) else props end as data_json from events"


def _corrupt(spark, d) -> DataFrame:
    data = F.expr("case when event_id % 10 = 0 then substr(props, 1, length(props) - 1) when event_id % 10 = 1 then substr(props, 1, 3) else props end")
    return _read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), data.alias("data_json"))


@query(f"select * from ({_CORRUPT}) where json_valid(data_json)")
def scan_skips_corrupt(spark, d):
    return ops.valid_rows(_corrupt(spark, d))


@query(f"with s as ({_CORRUPT}) select p.id, case when s.id is null then 'NotFound' when json_valid(s.data_json) then 'Ok' else 'DatabaseError' end as status from (select cast(event_id * 2 as varchar) as id from events) p left join s using (id)")
def lookup_corrupt_is_error(spark, d):
    probes = _read(spark, d, "events").select((F.col("event_id") * 2).cast("string").alias("id"))
    return ops.lookup_strict(_corrupt(spark, d), probes)


@query("""select doc_id, case when text is null or strlen(text) = 0 or strlen(text) > 511 then 'DatabaseError' else 'Ok' end as status,
case when text is null or strlen(text) = 0 or strlen(text) > 511 then 'Value size is invalid' else '' end as message from documents""")
def key_validation(spark, d):
    return ops.check_keys(_read(spark, d, "documents").select("doc_id", F.col("text").alias("id"))).select("doc_id", "status", "message")


_STATUS = "case o_orderkey % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(DISPLAY)) + " end"
_WORDS = "case o_orderkey % 6 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(DISPLAY.values())) + " end"


@query(f"select o_orderkey, {_WORDS} || ': ' || o_orderpriority as shown from orders")
def envelope_display(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", display(F.expr(_STATUS), F.col("o_orderpriority")).alias("shown"))


@query(f"select o_orderkey, '{{\"' || {_STATUS} || '\":\"' || o_orderpriority || '\"}}' as envelope from orders")
def envelope_json_text(spark, d):
    from ..functions.envelope import envelope_json

    return _read(spark, d, "orders").select("o_orderkey", envelope_json(F.expr(_STATUS), F.col("o_orderpriority")).alias("envelope"))


@query(f"select 'customer' as store, * from ({_CUSTOMERS}) union all select 'supplier', * from ({_SUPPLIERS})")
def store_isolation(spark, d):
    root = _root(spark)
    out = None
    stores = {"customer": customers, "supplier": suppliers}
    opened = {name: DocumentStore.init(spark, name, root) for name in stores}
    for name, make in stores.items():
        opened[name].apply(make(spark, d).withColumn("seq", F.lit(0)), "post")
    for name, store in opened.items():
        own = store.get().select(F.lit(name).alias("store"), "id", "hash", "data_json")
        out = own if out is None else out.unionByName(own)
    return out


@query("select cast(p_partkey as varchar) as id, sha256(p_name) as hash, '{\"size\":' || p_size || '}' as data_json from part")
def reopen_persistence(spark, d):
    root = _root(spark)
    store = DocumentStore.init(spark, "part", root)
    store.apply(_kv(_read(spark, d, "part"), "p_partkey", "p_name", "concat('{\"size\":', p_size, '}')").withColumn("seq", F.lit(0)), "post")
    store.close_database()
    return DocumentStore.init(spark, "part", root).get()


@query("select cast(event_id as varchar) as id, cast(json_extract(props, '$.k') as bigint) as k from events")
def variant_view(spark, d):
    state = _read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("").alias("hash"), F.col("props").alias("data_json"))
    return ops.variants(state).select("id", F.variant_get("data", "$.k", "long").alias("k"))


# -- the facade and the life of a store ------------------------------------------------------------------------------

_REGION_TEXT = """'{"id":"' || r_regionkey || '","hash":"' || sha256(r_name) || '","data":{"name":"' || r_name || '"}}'"""
_NATION_TEXT = """'{"id":"' || n_nationkey || '","hash":"' || sha256(n_name) || '","data":{"name":"' || n_name || '"}}'"""


def _texts(spark, d, table: str, key: str, name: str) -> list[tuple[str, str]]:
    """(key, JSON text) of the records of a small table."""
    hashed = F.sha2(F.col(name), 256)
    rows = _read(spark, d, table).select(F.col(key).cast("string").alias("k"), hashed.alias("h"), F.col(name).alias("n")).toLocalIterator()
    return [(r["k"], f'{{"id":"{r["k"]}","hash":"{r["h"]}","data":{{"name":"{r["n"]}"}}}}') for r in rows]


@query(f"""with regions as (select cast(r_regionkey as varchar) as k, {_REGION_TEXT} as t from region),
nations as (select cast(n_nationkey as varchar) as k, {_NATION_TEXT} as t, n_nationkey in (select r_regionkey from region) as there from nation),
answers as (
  select '1 push' as step, k, 'Ok' as tag, t as said from regions
  union all select '2 get', n.k, case when r.k is null then 'NotFound' else 'Ok' end, coalesce(r.t, 'No model found with id: ' || n.k) from nations n left join regions r using (k)
  union all select '3 update', k, case when there then 'Ok' else 'NotFound' end, case when there then t else 'Model not found for update' end from nations
  union all select '4 get all', '', 'Ok', (select '[' || string_agg(t, ',' order by k) || ']' from nations where there)
  union all select '5 delete', k, case when there then 'Ok' else 'NotFound' end, case when there then 'Record deleted successfully' else 'No record found with id: ' || k end from nations
  union all select '6 get all', '', 'Ok', '[]'
  union all select '7 clear', '', 'Ok', 'All records cleared successfully'
  union all select '8 reset', 'other', 'Ok', 'Database ''other'' was reset successfully'
  union all select '9 close', '', 'Ok', 'Database connection closed successfully'
)
select step, k, '{{"' || tag || '":' || cast(to_json(said) as varchar) || '}}' as envelope from answers""")
def facade(spark, d):
    """The nine operations of the facade on the regions, asked for the keys of all nations."""
    regions, nations = _texts(spark, d, "region", "r_regionkey", "r_name"), _texts(spark, d, "nation", "n_nationkey", "n_name")
    state = api.create_db(spark, "facade", _root(spark))
    out = [("1 push", k, api.push_data(state, t)) for k, t in regions]
    out += [("2 get", k, api.get_by_id(state, k)) for k, _ in nations]
    out += [("3 update", k, api.update_data(state, t)) for k, t in nations]
    out.append(("4 get all", "", api.get_all(state)))
    out += [("5 delete", k, api.delete_by_id(state, k)) for k, _ in nations]
    out += [("6 get all", "", api.get_all(state)), ("7 clear", "", api.clear_all_records(state)), ("8 reset", "other", api.reset_database(state, "other")), ("9 close", "", api.close_database(state))]
    return spark.createDataFrame(out, "step string, k string, envelope string")


@query("""with base as (select cast(r_regionkey as varchar) as k from region)
select step, k, tag from base, (values ('alias post', 'Ok'), ('alias put', 'Ok'), ('malformed push', 'SerializationError'), ('malformed update', 'SerializationError'),
  ('null push', 'BadRequest'), ('null id', 'BadRequest'), ('null state', 'BadRequest'), ('bytes id', 'BadRequest'), ('empty id', 'DatabaseError'),
  ('closed push', 'DatabaseError'), ('closed malformed push', 'SerializationError'), ('closed get', 'DatabaseError'), ('closed close', 'Ok'), ('reset reopens', 'Ok'), ('push again', 'Ok')) as t(step, tag)
union all select 'null name', '', 'none'""")
def facade_rejections(spark, d):
    """Aliases, arguments that are missing or malformed, and a closed handle, whose malformed arguments are told of first."""
    root, out = _root(spark), [("null name", "", "none" if api.create_db(spark, None) is None else "some")]
    for k, text in _texts(spark, d, "region", "r_regionkey", "r_name"):
        state = api.create_db(spark, f"r{k}", root)
        calls = [
            ("alias post", lambda: api.post_data(state, text)), ("alias put", lambda: api.put_data(state, text)), ("malformed push", lambda: api.push_data(state, text[:-1])), ("malformed update", lambda: api.update_data(state, text[1:])),
            ("null push", lambda: api.push_data(state, None)), ("null id", lambda: api.get_by_id(state, None)), ("null state", lambda: api.delete_by_id(None, k)), ("bytes id", lambda: api.get_by_id(state, b"\xff")), ("empty id", lambda: api.get_by_id(state, "")),
            ("", lambda: api.close_database(state)), ("closed push", lambda: api.push_data(state, text)), ("closed malformed push", lambda: api.push_data(state, text[:-1])), ("closed get", lambda: api.get_by_id(state, k)), ("closed close", lambda: api.close_database(state)),
            ("reset reopens", lambda: api.reset_database(state, f"s{k}")), ("push again", lambda: api.push_data(state, text)),
        ]
        out += [(step, k, answer.split('"')[1]) for step, call in calls for answer in [call()] if step]
    return spark.createDataFrame(out, "step string, k string, tag string")


@query("""select * from (values
  ('KeyExist', 'BadRequest', 'Key already exists', 'Bad Request: Key already exists'),
  ('NotFound', 'NotFound', 'Record not found', 'Not found: Record not found'),
  ('Corrupted', 'DatabaseError', 'Database is corrupted', 'Database error: Database is corrupted'),
  ('Panic', 'DatabaseError', 'Database panic occurred', 'Database error: Database panic occurred'),
  ('MapFull', 'DatabaseError', 'Database map is full', 'Database error: Database map is full'),
  ('DbsFull', 'DatabaseError', 'Maximum databases reached', 'Database error: Maximum databases reached'),
  ('ReadersFull', 'DatabaseError', 'Maximum readers reached', 'Database error: Maximum readers reached'),
  ('TxnFull', 'DatabaseError', 'Transaction is full', 'Database error: Transaction is full'),
  ('CursorFull', 'DatabaseError', 'Cursor stack is full', 'Database error: Cursor stack is full'),
  ('PageFull', 'DatabaseError', 'Page is full', 'Database error: Page is full'),
  ('MapResized', 'DatabaseError', 'Database map was resized', 'Database error: Database map was resized'),
  ('Incompatible', 'DatabaseError', 'Database is incompatible', 'Database error: Database is incompatible'),
  ('BadRslot', 'DatabaseError', 'Bad reader locktable slot', 'Database error: Bad reader locktable slot'),
  ('BadTxn', 'DatabaseError', 'Invalid transaction', 'Database error: Invalid transaction'),
  ('BadValSize', 'DatabaseError', 'Value size is invalid', 'Database error: Value size is invalid'),
  ('BadDbi', 'DatabaseError', 'Invalid database handle', 'Database error: Invalid database handle'),
  ('PageNotFound', 'DatabaseError', 'Page not found', 'Database error: Page not found'),
  ('VersionMismatch', 'DatabaseError', 'Version mismatch', 'Database error: Version mismatch'),
  ('Invalid', 'DatabaseError', 'Invalid LMDB file', 'Database error: Invalid LMDB file'),
  ('TlsFull', 'DatabaseError', 'TLS keys full', 'Database error: TLS keys full'),
  ('7', 'DatabaseError', 'LMDB error code: 7', 'Database error: LMDB error code: 7'),
  ('parse', 'SerializationError', 'JSON serialization error: x', 'Serialization error: JSON serialization error: x'),
  ('success', 'Ok', '3', 'Ok: 3')) as t(condition, status, message, shown)""")
def error_mapping(spark, d):
    """The response to every storage condition, to one without a name, to a parse error, and a success."""
    found = [(c, Response.of_error(StoreError(c))) for c in [*STORAGE_ERRORS, "7"]] + [("parse", Response.of_parse_error(ValueError("x"))), ("success", Response.success(3))]
    return spark.createDataFrame([(c, r.status, r.message, str(r)) for c, r in found], "condition string, status string, message string, shown string")


@query(_SUPPLIERS)
def reset_same_name(spark, d):
    """Reset to its own name empties a store, also through a closed handle; what is written then is all there is."""
    store = _stored(spark, "same", customers(spark, d))
    store.close_database()
    store.reset_database("same")
    store.apply(suppliers(spark, d).withColumn("seq", F.lit(0)), "post")
    return store.get()


@query(_CUSTOMERS)
def pinned_version(spark, d):
    """A reader that holds a version sees its documents after deletes, posts and a clear."""
    store = _stored(spark, "pinned", customers(spark, d))
    pinned = store.manifest().version
    store.apply(_keys(spark, d).withColumn("seq", F.lit(1)), "delete")
    store.apply(suppliers(spark, d).withColumn("seq", F.lit(2)), "post")
    store.clear_all_records()
    return store.get(pinned)


@query(f"select * from ({_CUSTOMERS}) where id not in ({_KEYS}) and id not in (select id from ({_SUPPLIERS})) union all ({_SUPPLIERS})")
def opened_twice(spark, d):
    """Two handles of one store see each other's writes at once."""
    root = _root(spark)
    first = _stored(spark, "twice", customers(spark, d), root)
    second = DocumentStore.init(spark, "twice", root)
    second.apply(_keys(spark, d).withColumn("seq", F.lit(1)), "delete")
    first.apply(suppliers(spark, d).withColumn("seq", F.lit(2)), "post")
    second.compact()
    return first.get()


@query(f"""with c as ({_CUSTOMERS}), k as ({_KEYS}) select 1 as seq, k.id, case when c.id is null then 'NotFound' else 'Ok' end as status, case when c.id is null then 'No record found with id: ' || k.id else 'Record deleted successfully' end as message from k left join c using (id)
union all select 2, k.id, 'NotFound', 'No record found with id: ' || k.id from k""")
def apply_delete_responses(spark, d):
    """The store's answer to each row of a batch of deletes in which every key comes twice."""
    keys = _keys(spark, d)
    batch = keys.withColumn("seq", F.lit(1)).unionByName(keys.withColumn("seq", F.lit(2)))
    return _stored(spark, "answers", customers(spark, d)).apply(batch, "delete")


@query("""select doc_id as seq, case when text is null or strlen(text) = 0 or strlen(text) > 511 then 'DatabaseError' else 'Ok' end as status,
case when text is null or strlen(text) = 0 or strlen(text) > 511 then 'Value size is invalid' else 'stored' end as message from documents""")
def apply_key_errors(spark, d):
    """The store's answer to each row of a batch whose keys are texts, many of them too long."""
    batch = _read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("id"), F.lit("").alias("hash"), F.lit("{}").alias("data_json"))
    return DocumentStore.init(spark, "keys", _root(spark)).apply(batch, "post").select("seq", "status", "message")


@query("""with last as (select cast(l_partkey as varchar) as id, sha256(cast(arg_max(l_orderkey, {'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey, 'd': l_shipdate}) as varchar)) as hash from lineitem group by l_partkey)
select coalesce(l.id, cast(p_partkey as varchar)) as id, coalesce(l.hash, sha256(p_name)) as hash from part full join last l on l.id = cast(p_partkey as varchar)""")
def post_batch_repeats(spark, d):
    """A batch with repeated keys posted to a state equals its rows one by one."""
    state = _kv(_read(spark, d, "part"), "p_partkey", "p_name")
    batch = _read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("hash"), F.lit("{}").alias("data_json"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").alias("seq"))
    return ops.post(state, batch).select("id", "hash")


@query(f"{_CUSTOMERS} union all {_ORDERS}")
def json_text_round_trip(spark, d):
    """Documents written as JSON lines and read back through the strict reader."""
    from ..sources.json_text import read_records, write_records

    path = f"file://{os.path.abspath(_root(spark))}/lines"
    write_records(customers(spark, d).unionByName(orders(spark, d)), path)
    return read_records(spark, path).where("error is null").select("id", "hash", "data_json")


# -- streams -------------------------------------------------------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    """The events as a stream of files; the pattern lets the table be a file or a folder."""
    return spark.readStream.schema(_read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query("select cast(user_id as varchar) as id, arg_max(sha256(props), event_id) as hash, arg_max(props, event_id) as data_json from events group by user_id")
def streaming_ingest(spark, d):
    """Events posted to a store by a stream, a version for each micro-batch; then the stream runs again and adds nothing."""
    from ..streaming.ingest import ingest

    root = _root(spark)
    store = DocumentStore.init(spark, "stream", root)
    posts = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("id"), F.sha2("props", 256).alias("hash"), F.col("props").alias("data_json"), F.col("event_id").alias("seq"))
    for _ in range(2):
        ingest(posts, store, f"file://{os.path.abspath(root)}/checkpoint").awaitTermination()
    return store.get()


@query("select time_bucket(interval 5 minutes, ts) as begins, event_type as op, count(*) as entries from events group by 1, 2")
def streaming_change_counts(spark, d):
    """Entries of each kind in tumbling windows of a stream of events, with a watermark."""
    from ..streaming.ingest import change_counts

    path = f"file://{os.path.abspath(_root(spark))}"
    counts = change_counts(_event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op")))
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "op", "entries").write.mode("overwrite").parquet(f"{path}/counts-{number}")
        written.append(number)

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("begins timestamp_ntz, op string, entries long").parquet(f"{path}/counts-{max(written)}")
