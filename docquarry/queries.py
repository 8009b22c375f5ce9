"""The engine's registered queries over the driver's tables, with their SQL.

``events`` doubles as a log: its id numbers the entries, the user is the key, an error deletes.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.engine import Collection
from docquarry.functions.patch import merge_patch_json
from docquarry.operators import indexing, paging
from docquarry.operators.projecting import project_json, project_struct
from docquarry.plans.requests import MAX_BUDGET
from docquarry.sources import log as logs
from docquarry.sources.tables import Documents, padded, prepare, typed, variant
from docquarry.streaming import changes as feed

KEYS: dict[str, Callable[[], Column]] = {
    "lineitem": lambda: F.concat_ws("-", padded("l_orderkey"), padded("l_linenumber", "l_partkey", "l_suppkey"), F.col("l_shipdate").cast("string")),
    "orders": lambda: padded("o_orderkey"),
    "customer": lambda: F.col("c_name"),
    "part": lambda: padded("p_partkey"),
    "supplier": lambda: F.col("s_name"),
    "nation": lambda: F.col("n_name"),
    "region": lambda: F.col("r_name"),
    "events": lambda: padded("event_id"),
    "documents": lambda: padded("doc_id"),
    "labels": lambda: padded("doc_id"),
    "pages": lambda: F.col("url"),
    "conversations": lambda: padded("conv_id", "turn"),
    "embeddings": lambda: padded("vec_id"),
    "benchmark": lambda: padded("item_id"),
}


#: Members whose order is that of the key text: numbers from 0 on and times.
ORDER: dict[str, tuple[str, ...]] = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), "orders": ("o_orderkey",), "customer": ("c_name",), "part": ("p_partkey",)}


def table(spark: SparkSession, sf_dir: str, name: str, folder: str | None = None) -> Collection:
    return Collection(name, typed(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name](), order=ORDER.get(name, ())), folder=folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; only a local session may do without the setting for it."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='docquarry-')}/{name}-{uuid.uuid4().hex}"


def find(name: str, columns: str, **request) -> Callable[[SparkSession, str], DataFrame]:
    """A registered request on a table: the listed columns of the rows that it finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, name)
        return c.find(**request).select(*project_struct(c.documents.root, columns.split(",")))

    return run


def totals(name: str, **request) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name).totals(**request)


def props(spark: SparkSession, sf_dir: str) -> Collection:
    """``events.props`` as documents of any shape."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return Collection("props", variant(events, KEYS["events"](), F.col("props")))


def find_props(**request) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: props(spark, sf_dir).find(**request).select(F.col("key").cast("bigint").alias("event_id"))


def event_log(spark: SparkSession, sf_dir: str, drops: tuple[int, ...] = ()) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_id").isin(*drops), "drop").when(F.col("event_type") == "error", "del").otherwise("put") if drops else F.when(F.col("event_type") == "error", "del").otherwise("put")
    return events.select(
        F.col("event_id").alias("lsn"),
        F.lit(1).cast("bigint").alias("term"),
        op.alias("op"),
        F.when(op != "drop", F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit(None).cast("bigint").alias("expire_at"),
        F.lit(False).alias("migration"),
        F.lit(None).cast("bigint").alias("ttl_secs"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem")
    rows = c.find(filter={"l_quantity": {"$gte": 49.0}, "l_returnflag": "A"}, sort="l_extendedprice:desc", limit=100)
    return rows.select(*project_struct(c.documents.root, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]))


_LINE = "l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate"
_LINE_KEY = "lpad(l_orderkey::VARCHAR, 20, '0') || '-' || lpad(l_linenumber::VARCHAR, 20, '0') || '-' || lpad(l_partkey::VARCHAR, 20, '0') || '-' || lpad(l_suppkey::VARCHAR, 20, '0') || '-' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"


def items(spark: SparkSession, page: paging.Page, schema: str) -> DataFrame:
    """The documents of a page as rows."""
    texts = spark.createDataFrame([(json.dumps(x),) for x in page.items], "text string")
    return texts.select(F.from_json("text", schema).alias("d")).select("d.*")


def sort_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten, asked for with the cursor of the first."""
    request = {"sort": "l_quantity:desc,l_shipdate", "fields": _LINE, "limit": 10, "whole": True}
    c = table(spark, sf_dir, "lineitem")
    page = c.query(**request, cursor=c.query(**request).next_cursor)
    return items(spark, page, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz")


def unsorted_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"filter": {"o_orderstatus": "F"}, "fields": "o_orderkey", "limit": 20, "max_docs": MAX_BUDGET}
    c = table(spark, sf_dir, "orders")
    return items(spark, c.query(**request, cursor=c.query(**request).next_cursor), "o_orderkey bigint")


#: Values of all kinds at one path, some missing; their kind, number and text decide their order.
_MIXED = "CASE event_id % 6 WHEN 0 THEN '{{\"g\":' || event_id % 4 || ',\"v\":' || {n} || '}}' WHEN 1 THEN '{{\"v\":\"s' || {n} || '\"}}' WHEN 2 THEN '{{\"g\":1,\"v\":null}}' WHEN 3 THEN '{{\"v\":true}}' WHEN 4 THEN '{{\"g\":' || event_id % 4 || ',\"v\":[' || {n} || ']}}' ELSE '{{\"g\":2}}' END"
_MIXED_SQL = """
WITH mixed AS (SELECT event_id, event_id % 97 AS n, event_id % 6 AS kind FROM events),
kinds AS (
  SELECT event_id, CASE kind WHEN 5 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS rank, CASE WHEN kind IN (0, 4) THEN n ELSE 0 END AS num, CASE WHEN kind = 1 THEN 's' || n ELSE '' END AS str,
    CASE WHEN kind IN (0, 4) THEN (event_id % 4)::VARCHAR WHEN kind = 2 THEN '1' WHEN kind = 5 THEN '2' END AS g,
    CASE kind WHEN 0 THEN n::VARCHAR WHEN 1 THEN '"s' || n || '"' WHEN 2 THEN 'null' WHEN 3 THEN 'true' WHEN 4 THEN '[' || n || ']' END AS text FROM mixed)
"""


def mixed(spark: SparkSession, sf_dir: str) -> Collection:
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return Collection("mixed", variant(events, KEYS["events"](), F.expr(_MIXED.format(n="event_id % 97"))))


def sort_mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).find(sort="v", limit=9000).select(F.col("key").cast("bigint").alias("event_id"))


def sort_mixed_kinds_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).find(sort="v:desc", limit=4000).select(F.col("key").cast("bigint").alias("event_id"))


def event_folder(spark: SparkSession, sf_dir: str, drops: tuple[int, ...] = (), up_to: int | None = None) -> logs.Log:
    """The events as a log in a folder of its own."""
    log = logs.Log(prepare(spark), scratch(spark, "events"))
    entries = event_log(spark, sf_dir, drops)
    (entries if up_to is None else entries.where(F.col("lsn") <= up_to)).write.parquet(log.path)
    return log


def swept_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a sweep: one append of deletions to the log."""
    log = event_folder(spark, sf_dir)
    newest = log.read().agg(F.max("ts")).first()[0] or 0
    log.set_ttl(SWEEP_TTL)
    log.sweep(newest)
    return logs.snapshot(log.read()).select("key", "lsn")


def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that stay when a log with drops is compacted in place."""
    log = event_folder(spark, sf_dir, _DROPS)
    log.compact()
    return log.read().select("lsn", "op", "key")


def restored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that was exported and taken over by another log."""
    log, target = event_folder(spark, sf_dir, _DROPS), scratch(spark, "export")
    log.export(target)
    other = logs.Log(spark, scratch(spark, "restored"))
    other.restore(target)
    return logs.snapshot(other.read()).select("key", "value", "lsn")


def read_before_the_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Collection("new", logs.Log(prepare(spark), scratch(spark, "new")))
    return c.find(filter={"a": 1}).select("key").unionByName(c.changes(after=0).select("key"))


def through_index(name: str, column: str, path: str, filter: dict) -> Callable[[SparkSession, str], DataFrame]:
    """A filter answered through written postings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, name, scratch(spark, "indexes"))
        c.create_index("by_path", path)
        return c.find_by_index(filter).select(F.col("doc")[column].alias(column))

    return run


def index_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made in the middle of a log, brought up to date by the entries that came after."""
    log = event_folder(spark, sf_dir, up_to=6000)
    c = Collection("events", log)
    c.create_index("by_k", "k")
    event_log(spark, sf_dir).where("lsn > 6000").withColumn("lsn", F.col("lsn") + 1).write.mode("append").parquet(log.path)
    return c.find_by_index({"k": {"$gte": 90}}).select("key", F.expr("CASE WHEN lsn > 6000 THEN lsn - 1 ELSE lsn END").alias("lsn"))


def cdc_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that a buffer of the newest 1024 can still resume."""
    changes = feed.classify(event_log(spark, sf_dir))
    floor = feed.retention_floor(changes, 1024)
    head = event_log(spark, sf_dir).agg(F.max("lsn")).first()[0] or 0
    return feed.resume(changes, floor, head, floor).select("lsn", "op", "key", "value")


def customer_nested(spark: SparkSession, sf_dir: str) -> Documents:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nested = c.select("c_name", F.struct("c_custkey", F.struct("c_nationkey", "c_mktsegment").alias("place")).alias("who"), "c_acctbal")
    return typed(nested, F.col("c_name"))


def project_nested_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = customer_nested(spark, sf_dir)
    return docs.df.select(F.col("key").alias("id"), project_json(docs.root, ["who.c_custkey", "who.place.c_mktsegment", "nowhere.x"]).alias("value"))


def orders_with_lines(spark: SparkSession, sf_dir: str) -> Documents:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("items"), F.collect_set("l_returnflag").alias("flags"))
    return typed(grouped, padded("l_orderkey"))


def on_lines(filter: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Collection("lines", orders_with_lines(spark, sf_dir)).find(filter=filter).select("doc.l_orderkey")


def key_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").find(start="0" * 17 + "100", end="0" * 16 + "2000", limit=50).select("doc.o_orderkey", "doc.o_totalprice")


def snapshot_latest(spark: SparkSession, sf_dir: str, drops: tuple[int, ...] = ()) -> DataFrame:
    return logs.snapshot(event_log(spark, sf_dir, drops)).select("key", "value", "lsn")


def merge_patch_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    patches = events.select("user_id", "event_id", F.expr("CASE WHEN event_type = 'purchase' THEN value END").alias("spent"), F.expr("CASE WHEN event_type = 'signup' THEN event_id END").alias("signed"))
    return logs.shallow_patches(patches, "user_id", "event_id", ["spent", "signed"])


#: 2024-01-08 00:00:00 UTC would sweep a week of events; the tables' times decide what is due.
SWEEP_TTL = 86_400


def expire_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    newest = log.agg(F.max("ts")).first()[0] or 0
    setting = spark.range(1).select(F.lit(1 << 60).alias("lsn"), F.lit(1).cast("bigint").alias("term"), F.lit("ttl").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("ts"), F.lit(None).cast("bigint").alias("expire_at"), F.lit(False).alias("migration"), F.lit(SWEEP_TTL).cast("bigint").alias("ttl_secs"))
    return logs.expired(log.unionByName(setting), newest).select("key", "lsn")


def cdc(spark: SparkSession, sf_dir: str, drops: tuple[int, ...] = (), after: int | None = None, **admit) -> DataFrame:
    found = feed.classify(event_log(spark, sf_dir, drops))
    if after is not None:
        found = found.where(F.col("lsn") > after)
    return feed.admitted(found, **admit).select("lsn", "op", "key", "value")


def cdc_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.plans.filters import parse_filter

    return cdc(spark, sf_dir, ops=("update", "delete"), filter=parse_filter({"k": {"$gt": 50}}))


def cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of one pass over the file; what it wrote is read back."""
    folder = scratch(spark, "cdc")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    parent, _, file = f"{sf_dir}/events.parquet".rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(parent)
    log = events.select(
        F.col("event_id").alias("lsn"),
        F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.lit(False).alias("migration"),
    )
    query = feed.classify_stream(log).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("op").agg(F.count("*").alias("n"))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").documents
    return indexing.status(docs.df, docs.root, "o_orderpriority")


def postings_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").documents
    return indexing.postings(docs.df, docs.root, "p_brand").select(F.col("value").alias("p_brand"), "key")


def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    patch = F.when(F.col("event_id") % 3 == 0, '{"k":null,"seen":true}').when(F.col("event_id") % 3 == 1, '{"k":{"n":1,"gone":null}}').otherwise('{"list":[1,null]}')
    return events.select("event_id", merge_patch_json("props", patch).alias("patched"))


def etags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.snapshot(event_log(spark, sf_dir)).select("key", logs.etag().alias("etag"))


def embed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier")
    return c.project(c.find(filter={"s_nationkey": {"$lte": 3}}), "s_suppkey,s_name")


def shard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log dealt to two shards by key, each classified by itself, as one feed after a position in either."""
    log = event_log(spark, sf_dir)
    shard = F.col("key").cast("bigint") % 2
    feeds = {n: feed.classify(log.where(shard == n)) for n in (0, 1)}
    return feed.resume_merged(feeds, feed.merged_position({0: 4000, 1: 6000})).select("shard", "lsn", "op")


def agg_min_max_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir).totals(metrics="min:k,max:k,sum:k")


_SNAPSHOT = """
WITH log AS (SELECT event_id AS lsn, CASE WHEN event_id IN ({drops}) THEN 'drop' WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, user_id::VARCHAR AS key, props AS value, ts FROM events),
live AS (SELECT * FROM log WHERE op <> 'drop' AND lsn > coalesce((SELECT max(lsn) FROM log WHERE op = 'drop'), -1)),
newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM live)
"""
_CHANGES = """
WITH log AS (SELECT event_id AS lsn, CASE WHEN event_id IN ({drops}) THEN 'drop' WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, user_id::VARCHAR AS key, props AS value FROM events),
parts AS (SELECT *, sum(CASE WHEN op = 'drop' THEN 1 ELSE 0 END) OVER (ORDER BY lsn) AS epoch FROM log),
judged AS (SELECT *, lag(op) OVER (PARTITION BY epoch, op = 'drop', key ORDER BY lsn) AS before FROM parts),
changes AS (
  SELECT lsn, CASE WHEN op = 'drop' THEN 'drop' WHEN op = 'put' AND before = 'put' THEN 'update' WHEN op = 'put' THEN 'insert' WHEN before = 'put' THEN 'delete' END AS op,
    CASE WHEN op <> 'drop' THEN key END AS key, CASE WHEN op = 'put' THEN value END AS value FROM judged)
"""
_NO_DROPS = "-1"
_DROPS = (3000, 7000)

#: Name: query, and its SQL.
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship_filter_sort_topk": (flagship, f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'A' ORDER BY l_extendedprice DESC, {_LINE_KEY} LIMIT 100"),
    "eq_literal": (find("lineitem", _LINE, filter={"l_returnflag": "A", "l_linenumber": 1}), f"SELECT {_LINE} FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1"),
    "eq_int_on_fraction_is_empty": (find("lineitem", "l_orderkey", filter={"l_quantity": 17}), "SELECT l_orderkey FROM lineitem WHERE false"),
    "eq_fraction": (find("lineitem", "l_orderkey,l_linenumber", filter={"l_quantity": 17.0}), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17"),
    "ne": (find("orders", "o_orderkey", filter={"o_orderstatus": {"$ne": "F"}}), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "in": (find("orders", "o_orderkey", filter={"o_orderpriority": {"$in": ["1-URGENT", "5-LOW", 3]}}), "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "nin": (find("orders", "o_orderkey", filter={"o_custkey": {"$nin": [1, 2, 3, "x"]}}), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3)"),
    "range_gt_gte_lt_lte": (find("orders", "o_orderkey", filter={"o_totalprice": {"$gte": 1000, "$lt": 150000.5}, "o_custkey": {"$gt": 10.5, "$lte": 900}}), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000.5 AND o_custkey > 10.5 AND o_custkey <= 900"),
    "range_wrong_kind_is_empty": (find("orders", "o_orderkey", filter={"o_totalprice": {"$gt": "1000"}}), "SELECT o_orderkey FROM orders WHERE false"),
    "range_time_text": (find("orders", "o_orderkey", filter={"o_orderdate": {"$gte": "1995-01-01", "$lt": "1996-01-01T00:00:00"}}), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "exists_true": (find_props(filter={"k": {"$exists": True}}), "SELECT event_id FROM events WHERE json_exists(props, '$.k')"),
    "exists_false": (find_props(filter={"missing.x": {"$exists": False}}), "SELECT event_id FROM events WHERE NOT json_exists(props, '$.missing.x')"),
    "type_number": (find_props(filter={"k": {"$type": "number"}}), "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"),
    "type_multi": (find_props(filter={"k": {"$type": ["string", "null", "array"]}}), "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('VARCHAR', 'NULL', 'ARRAY')"),
    "prefix": (find("customer", "c_custkey,c_name", filter={"c_mktsegment": {"$prefix": "BU"}}), "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_mktsegment, 'BU')"),
    "suffix": (find("part", "p_partkey", filter={"p_name": {"$suffix": "bolt"}}), "SELECT p_partkey FROM part WHERE ends_with(p_name, 'bolt')"),
    "contains": (find("part", "p_partkey", filter={"p_name": {"$contains": "d w"}}), "SELECT p_partkey FROM part WHERE contains(p_name, 'd w')"),
    "all": (on_lines({"flags": {"$all": ["A", "R"]}}), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')"),
    "size": (on_lines({"items": {"$size": 4}}), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4"),
    "elem_match_filter": (on_lines({"items": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_returnflag": "R"}}}), "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
    "elem_match_operators": (find("embeddings", "vec_id", filter={"embedding": {"$elemMatch": {"$gt": 0.3}}}), "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > CAST(0.3 AS DOUBLE))) > 0"),
    "not_over_missing": (find_props(filter={"missing": {"$not": {"$gt": 5}}, "k": {"$not": {"$gte": 50}}}), "SELECT event_id FROM events WHERE NOT coalesce(CAST(json_extract(props, '$.k') AS DOUBLE) >= 50, false)"),
    "and_or_nor": (
        find("orders", "o_orderkey", filter={"$or": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 20000}}], "$nor": [{"o_orderpriority": {"$prefix": "4"}}, {"o_custkey": {"$lt": 100}}], "$and": [{"o_orderkey": {"$gt": 7}}]}),
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice < 20000) AND NOT (starts_with(o_orderpriority, '4') OR o_custkey < 100) AND o_orderkey > 7",
    ),
    "variant_path_gt": (find_props(filter={"k": {"$gt": 50}}), "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50"),
    "variant_eq": (find_props(filter={"k": 42}), "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 42"),
    "sort_multi_topk": (find("lineitem", _LINE, sort="l_returnflag:desc,l_quantity", limit=200), f"SELECT {_LINE} FROM lineitem ORDER BY l_returnflag DESC, l_quantity NULLS FIRST, {_LINE_KEY} LIMIT 200"),
    "sort_page_2": (sort_page_2, f"SELECT {_LINE} FROM lineitem ORDER BY l_quantity DESC, l_shipdate NULLS FIRST, {_LINE_KEY} LIMIT 10 OFFSET 10"),
    "variant_sort": (find_props(sort="k:desc", limit=100), "SELECT event_id FROM events ORDER BY CAST(json_extract(props, '$.k') AS DOUBLE) DESC NULLS LAST, event_id LIMIT 100"),
    "sort_mixed_kinds": (sort_mixed_kinds, _MIXED_SQL + "SELECT event_id FROM kinds ORDER BY rank, num, str, event_id LIMIT 9000"),
    "sort_mixed_kinds_desc": (sort_mixed_kinds_desc, _MIXED_SQL + "SELECT event_id FROM kinds ORDER BY rank DESC, num DESC, str DESC, event_id LIMIT 4000"),
    "agg_min_max_kinds": (
        lambda spark, sf_dir: mixed(spark, sf_dir).totals(group="g", metrics="min:v,max:v"),
        _MIXED_SQL + "SELECT g, count(*) AS count, arg_min(text, (rank, num, str)) FILTER (rank > 0) AS min_v, arg_max(text, (rank, num, str)) FILTER (rank > 0) AS max_v FROM kinds GROUP BY g",
    ),
    "agg_doubles": (totals("orders", group="o_orderstatus", metrics="avg:o_custkey,sum:o_custkey"), "SELECT o_orderstatus, count(*) AS count, sum(o_custkey)::DOUBLE AS sum_o_custkey, count(o_custkey) AS count_o_custkey, sum(o_custkey)::DOUBLE / count(o_custkey) AS avg_o_custkey FROM orders GROUP BY o_orderstatus"),
    "key_range_page": (key_range_page, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 2000 ORDER BY o_orderkey LIMIT 50"),
    "unsorted_page_2": (unsorted_page_2, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY lpad(o_orderkey::VARCHAR, 20, '0') LIMIT 20 OFFSET 20"),
    "point_read": (find("orders", "o_orderkey,o_totalprice", start="0" * 18 + "42", end="0" * 18 + "42", limit=1), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42 LIMIT 1"),
    "project_nested_embed": (
        project_nested_embed,
        """SELECT c_name AS id, '{"who":{"c_custkey":' || c_custkey || ',"place":{"c_mktsegment":"' || c_mktsegment || '"}}}' AS value FROM customer""",
    ),
    "agg_global": (
        totals("lineitem", metrics="count,sum:l_extendedprice,min:l_shipdate,max:l_returnflag", scale=2),
        "SELECT count(*) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_extendedprice, count(l_extendedprice) AS count_l_extendedprice, min(l_shipdate) AS min_l_shipdate, max(l_returnflag) AS max_l_returnflag FROM lineitem",
    ),
    "agg_group_1": (totals("orders", group="o_orderstatus", metrics="count,min:o_totalprice,max:o_totalprice"), "SELECT o_orderstatus, count(*) AS count, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY ALL"),
    "agg_group_2": (
        totals("lineitem", group="l_returnflag,l_linestatus", metrics="sum:l_quantity,avg:l_extendedprice,min:l_discount,max:l_tax", scale=2),
        "SELECT l_returnflag, l_linestatus, count(*) AS count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_quantity, count(l_quantity) AS count_l_quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_extendedprice, count(l_extendedprice) AS count_l_extendedprice, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS avg_l_extendedprice, min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_group_4": (totals("lineitem", group="l_returnflag,l_linestatus,l_linenumber,l_suppkey", metrics="count"), "SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) AS count FROM lineitem GROUP BY ALL"),
    "agg_empty_is_no_group": (totals("orders", filter={"o_orderkey": {"$lt": 0}}, metrics="count"), "SELECT count(*) AS count FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0"),
    "agg_min_max_mixed": (
        agg_min_max_mixed,
        "SELECT count(*) AS count, min(CAST(json_extract(props, '$.k') AS BIGINT))::VARCHAR AS min_k, max(CAST(json_extract(props, '$.k') AS BIGINT))::VARCHAR AS max_k, sum(CAST(json_extract(props, '$.k') AS BIGINT))::DOUBLE AS sum_k, count(json_extract(props, '$.k')) AS count_k FROM events",
    ),
    "agg_partial_budget": (
        totals("lineitem", group="l_returnflag", metrics="count", budget=1000),
        f"SELECT l_returnflag, count(*) AS count FROM (SELECT * FROM lineitem ORDER BY {_LINE_KEY} LIMIT 1000) GROUP BY l_returnflag",
    ),
    "snapshot_latest": (snapshot_latest, _SNAPSHOT.format(drops=_NO_DROPS) + "SELECT key, value, lsn FROM newest WHERE n = 1 AND op = 'put'"),
    "snapshot_after_drop": (partial(snapshot_latest, drops=_DROPS), _SNAPSHOT.format(drops="3000, 7000") + "SELECT key, value, lsn FROM newest WHERE n = 1 AND op = 'put'"),
    "merge_patch_shallow": (merge_patch_shallow, "SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN value END, event_id) FILTER (event_type = 'purchase') AS spent, max(CASE WHEN event_type = 'signup' THEN event_id END) AS signed FROM events GROUP BY user_id"),
    "expire_sweep": (expire_sweep, _SNAPSHOT.format(drops=_NO_DROPS) + f"SELECT key, lsn FROM newest WHERE n = 1 AND op = 'put' AND epoch_ms(ts) + {SWEEP_TTL} * 1000 <= (SELECT max(epoch_ms(ts)) FROM events)"),
    "cdc_classify": (cdc, _CHANGES.format(drops=_NO_DROPS) + "SELECT * FROM changes WHERE op IS NOT NULL"),
    "cdc_with_drops": (partial(cdc, drops=_DROPS), _CHANGES.format(drops="3000, 7000") + "SELECT * FROM changes WHERE op IS NOT NULL"),
    "cdc_filtered": (cdc_filtered, _CHANGES.format(drops=_NO_DROPS) + "SELECT * FROM changes WHERE op IN ('update', 'delete') AND (value IS NULL OR CAST(json_extract(value, '$.k') AS DOUBLE) > 50)"),
    "cdc_resume": (partial(cdc, after=5000), _CHANGES.format(drops=_NO_DROPS) + "SELECT * FROM changes WHERE op IS NOT NULL AND lsn > 5000"),
    "cdc_stream": (cdc_stream, _CHANGES.format(drops=_NO_DROPS) + "SELECT op, count(*) AS n FROM changes WHERE op IS NOT NULL GROUP BY op"),
    "cdc_shards": (shard_feed, _CHANGES.format(drops=_NO_DROPS) + "SELECT (key::BIGINT % 2)::INTEGER AS shard, lsn, op FROM changes WHERE op IS NOT NULL AND lsn > CASE WHEN key::BIGINT % 2 = 0 THEN 4000 ELSE 6000 END"),
    "cdc_retention": (cdc_retention, _CHANGES.format(drops=_NO_DROPS) + "SELECT * FROM changes WHERE op IS NOT NULL ORDER BY lsn DESC LIMIT 1024"),
    "swept_log": (swept_log, _SNAPSHOT.format(drops=_NO_DROPS) + f"SELECT key, lsn FROM newest WHERE n = 1 AND op = 'put' AND epoch_ms(ts) + {SWEEP_TTL} * 1000 > (SELECT max(epoch_ms(ts)) FROM events)"),
    "compacted_log": (compacted_log, _SNAPSHOT.format(drops="3000, 7000") + ", kept AS (SELECT lsn, op, key FROM newest WHERE n = 1 AND op = 'put') SELECT * FROM kept UNION ALL SELECT max(lsn), 'barrier', NULL FROM log HAVING max(lsn) NOT IN (SELECT lsn FROM kept)"),
    "restored_log": (restored_log, _SNAPSHOT.format(drops="3000, 7000") + "SELECT key, value, lsn FROM newest WHERE n = 1 AND op = 'put'"),
    "read_before_the_first_write": (read_before_the_first_write, "SELECT user_id::VARCHAR AS key FROM events WHERE false"),
    "log_suffix": (lambda spark, sf_dir: logs.suffix(event_log(spark, sf_dir), 100, 250).select("lsn", "key"), "SELECT event_id AS lsn, user_id::VARCHAR AS key FROM events WHERE event_id > 100 AND event_id <= 250"),
    "etags": (etags, _SNAPSHOT.format(drops=_NO_DROPS) + """SELECT key, '"1.' || lsn || '"' AS etag FROM newest WHERE n = 1 AND op = 'put'"""),
    "merge_patch_json": (
        merge_patch,
        """SELECT event_id, json_merge_patch(props, CASE event_id % 3 WHEN 0 THEN '{"k":null,"seen":true}' WHEN 1 THEN '{"k":{"n":1,"gone":null}}' ELSE '{"list":[1,null]}' END)::VARCHAR AS patched FROM events""",
    ),
    "keys_with_items": (embed_keys, """SELECT s_name AS key, '{"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}' AS item FROM supplier WHERE s_nationkey <= 3"""),
    "find_by_index": (through_index("orders", "o_orderkey", "o_custkey", {"o_custkey": {"$gte": 5, "$lt": 20}, "o_orderstatus": "F"}), "SELECT o_orderkey FROM orders WHERE o_custkey >= 5 AND o_custkey < 20 AND o_orderstatus = 'F'"),
    "index_eq": (through_index("orders", "o_orderkey", "o_custkey", {"o_custkey": 7}), "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "index_in": (through_index("part", "p_partkey", "p_brand", {"p_brand": {"$in": ["Brand#11", "Brand#25", 5]}}), "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#25')"),
    "index_prefix": (through_index("part", "p_partkey", "p_name", {"p_name": {"$prefix": "b"}}), "SELECT p_partkey FROM part WHERE starts_with(p_name, 'b')"),
    "index_type": (through_index("customer", "c_custkey", "c_nationkey", {"c_nationkey": {"$type": "number"}, "c_acctbal": {"$lt": 0}}), "SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "index_after_writes": (index_after_writes, _SNAPSHOT.format(drops=_NO_DROPS) + "SELECT key, lsn FROM newest WHERE n = 1 AND op = 'put' AND CAST(json_extract(value, '$.k') AS DOUBLE) >= 90"),
    "index_postings": (postings_keys, "SELECT p_brand, lpad(p_partkey::VARCHAR, 20, '0') AS key FROM part"),
    "agg_variant_group": (lambda spark, sf_dir: props(spark, sf_dir).totals(group="k", metrics="count"), "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS count FROM events GROUP BY 1"),
    "index_status": (index_status, "SELECT count(*) AS documents, count(DISTINCT o_orderpriority) AS values FROM orders"),
    "doc_corpus_by_lang": (totals("documents", group="lang", metrics="count,min:n_chars,max:n_chars"), "SELECT lang, count(*) AS count, min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars FROM documents GROUP BY lang"),
    "labels_quality": (totals("labels", group="quality,toxic", metrics="count"), "SELECT quality, toxic, count(*) AS count FROM labels GROUP BY ALL"),
    "pages_host_prefix": (find("pages", "page_id,url", filter={"url": {"$prefix": "https://m."}}), "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')"),
    "conversation_turns": (totals("conversations", group="conv_id,role", metrics="max:turn"), "SELECT conv_id, role, count(*) AS count, max(turn) AS max_turn FROM conversations GROUP BY ALL"),
}
