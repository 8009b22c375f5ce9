import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.engine import Collection, Engine
from docquarry.errors import Conflict, NotFound, Refused
from docquarry.functions.encoding import encode
from docquarry.functions.kinds import order_key
from docquarry.functions.paths import lookup, project
from docquarry.operators.indexing import successor
from docquarry.plans.filters import parse_filter
from docquarry.plans.requests import MAX_BUDGET, SortKey, encode_cursor, sort_position
from docquarry.queries import CATALOGUE
from docquarry.sources.tables import typed, variant
from tests.evaluator import matches

#: One value of every sort, in order.
ORDERED = [None, False, True, -3, -0.5, 0, 7, 8.25, "", "a", "b", "é", [], [1], [1, 2], [2], {}, {"a": 1}, {"a": 1, "b": 0}, {"a": 2}, {"b": 0}]


def collection(spark, documents):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "key string, text string")
    return Collection("c", variant(rows, F.col("key"), F.col("text")))


def test_total_order():
    for a, b in itertools.product(range(len(ORDERED)), repeat=2):
        x, y = ORDERED[a], ORDERED[b]
        assert (order_key(x) < order_key(y)) == (a < b)
        assert (encode(x) < encode(y)) == (a < b)


def test_sort_mixed_values(spark):
    shuffled = ORDERED[:]
    random.Random(1).shuffle(shuffled)
    c = collection(spark, {f"k{i:02}": {"v": v} for i, v in enumerate(shuffled)} | {"missing": {}})
    got = [d.get("v") for d in c.query(sort="v", limit=100).items]
    assert [encode(v) for v in got] == [encode(v) for v in [None, *ORDERED]]
    assert [encode(v) for v in (d.get("v") for d in c.query(sort="v:desc", limit=100).items)] == [encode(v) for v in [*reversed(ORDERED), None]]


def test_missing_sorts_before_null(spark):
    docs = {"a": {"v": None}, "b": {}, "c": {"v": 0}, "d": {"v": None}, "e": {"w": 1}, "f": {"v": [None]}, "g": {}, "h": {"v": None}}
    c = collection(spark, docs)
    for sort, want in (("v", "begadhcf"), ("v:desc", "fcadhbeg"), ("w,v", "bgadhcfe"), ("w:desc,v:desc", "efcadhbg")):
        assert "".join(r["key"] for r in c.find(sort=sort).collect()) == want
        assert "".join(pages(c, sort=sort, limit=2)) == want


@pytest.mark.parametrize("missing", ["0", [1], [-1], [0.0], ["0"], [0]])
def test_cursors_whose_missing_values_do_not_fit(missing):
    with pytest.raises(Refused):
        sort_position(encode_cursor({"values": [3], "key": "k", "missing": missing}), [SortKey("a")])


@pytest.mark.parametrize("name", ["sort_mixed_kinds", "sort_mixed_kinds_desc"])
def test_mixed_kinds_are_in_the_order_of_their_sql(spark, tmp_path, name):
    spark.range(600).selectExpr("id * 37 % 600 AS event_id").write.parquet(str(tmp_path / "events.parquet"))
    query, sql = CATALOGUE[name]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == db.execute(sql).fetchall()


def pages(c, **request):
    out, cursor = [], None
    for _ in range(100):
        page = c.query(cursor=cursor, keys=True, **request)
        out += page.keys
        cursor = page.next_cursor
        if cursor is None:
            return out
    raise AssertionError("no end")


@pytest.mark.parametrize("seed", range(4))
def test_any_paging_gives_the_whole_answer(spark, seed):
    """Random documents, orders, filters and page sizes: the pages one after another are what one request finds."""
    rng = random.Random(seed)
    docs = {f"{rng.randrange(10**6):06}-{n}": {"size": rng.choice([rng.randint(0, 4), 2.5, "m", None]), "shade": rng.choice("xyz")} | ({"extra": n} if rng.random() < 0.3 else {}) for n in range(23)}
    c = collection(spark, docs)
    sort = rng.choice([None, "size", "shade:desc,size", "extra:desc,shade"])
    chosen = rng.choice([None, {"shade": {"$in": ["x", "z"]}}, {"extra": {"$exists": False}}])
    request = {"sort": sort, "filter": chosen} | ({"max_docs": 5} if sort is None else {})
    whole = [k for k in sorted(docs) if chosen is None or matches(parse_filter(chosen), docs[k])]
    for part in reversed((sort or "").split(",")):
        if part:
            path, _, way = part.partition(":")
            rank = {k: b"" if path not in docs[k] else b"1" + encode(docs[k][path]) for k in whole}
            whole.sort(key=rank.__getitem__, reverse=way == "desc")
    assert pages(c, limit=rng.choice([2, 3, 9, 100]), **request) == whole


def test_sorted_pages_over_mixed_and_missing(spark):
    docs = {f"k{i:02}": {"v": v} for i, v in enumerate(ORDERED)} | {"m1": {}, "m2": {}}
    c = collection(spark, docs)
    for sort in ("v", "v:desc"):
        assert pages(c, sort=sort, limit=5) == c.query(sort=sort, limit=100, keys=True).keys


def test_budgets(spark):
    c = collection(spark, {f"k{i:02}": {"n": i} for i in range(30)})
    page = c.query(filter={"n": 29}, max_docs=4, keys=True)
    assert page.keys == [] and page.next_cursor
    with pytest.raises(Refused):
        c.query(sort="n", max_docs=10)
    with pytest.raises(Refused):
        c.aggregate(metrics="count", max_docs=10)
    part = c.aggregate(metrics="count,sum:n", max_docs=10, partial=True)
    assert part.partial and part.matched == 10 and part.groups[0]["metrics"]["sum:n"]["sum"] == 45


@pytest.mark.parametrize("request_", [{"sort": "n:desc"}, {"sort": "n", "filter": {"t": 1}}, {"filter": {"t": 2}}, {}])
def test_whole_pages_have_no_budget(spark, monkeypatch, request_):
    c = collection(spark, {f"k{i:02}": {"n": i, "t": i % 3} for i in range(30)})
    want = pages(c, limit=100, **request_)
    monkeypatch.setattr("docquarry.plans.requests.DEFAULT_BUDGET", 4)
    assert len(want) in (10, 30) and pages(c, limit=7, whole=True, **request_) == want
    with pytest.raises(Refused):
        c.query(whole=True, max_docs=10, **request_)


def test_second_page_of_more_rows_than_a_budget(spark, tmp_path):
    columns = ("id AS l_orderkey", "CAST(id % 7 AS int) AS l_linenumber", "id % 11 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id * 7919 % 50 AS double) AS l_quantity", "CAST(DATE '2000-01-01' + CAST(id % 3 AS int) AS timestamp_ntz) AS l_shipdate")
    spark.range(MAX_BUDGET + 1).selectExpr(*columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    query, sql = CATALOGUE["sort_page_2"]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == db.execute(sql).fetchall()


def test_key_modes_and_projection(spark):
    docs = {"a": {"id": 9, "p": {"q": 1, "r": None}}, "b": ["x"], "c": 7, "d": {"p": 5}}
    c = collection(spark, docs)
    assert c.query().items == [docs[k] for k in "abcd"] and c.query().keys is None
    assert c.query(keys="embed").items == [{"id": k, "value": docs[k]} for k in "abcd"]
    assert c.query(keys="true").keys == list("abcd")
    for fields in ("p.q", "p.r,id", "p,p.q", "p.q,p", "none.x", "p.q.z", "id,p.r"):
        assert c.query(fields=fields).items == [project(docs[k], fields.split(",")) for k in "abcd"], fields
    assert c.query(start="b", end="c", keys=True).keys == ["b", "c"]
    assert c.query(sort="id:desc", fields="p", limit=1).items == [{"p": {"q": 1, "r": None}}]


def test_aggregates(spark):
    docs = {f"k{i:02}": {"tier": "gold" if i % 2 == 0 else "silver", "amount": i} for i in range(20)}
    c = collection(spark, docs)
    got = c.aggregate(metrics="count,sum:amount,avg:amount,min:amount,max:amount").groups
    assert got == [{"count": 20, "metrics": {"count": {"count": 20}, "sum:amount": {"count": 20, "sum": 190.0}, "avg:amount": {"count": 20, "sum": 190.0, "avg": 9.5}, "min:amount": {"min": 0}, "max:amount": {"max": 19}}}]
    by = c.aggregate(group="tier", metrics="avg:amount").groups
    assert [(g["key"], g["metrics"]["avg:amount"]["avg"]) for g in by] == [({"tier": "gold"}, 9.0), ({"tier": "silver"}, 10.0)]
    assert c.aggregate(filter={"tier": "lead"}).groups == []
    assert c.totals(filter={"tier": "lead"}).count() == 0


def test_groups_tell_missing_null_and_fractions_apart(spark):
    c = collection(spark, {"a": {"n": 1}, "b": {"n": 1.0}, "c": {"n": None}, "d": {}, "e": {"n": "1"}, "f": {"n": 10}, "g": {"n": 2}})
    groups = c.aggregate(group="n").groups
    assert [json.dumps(g["key"]) for g in groups] == ['{"n": "1"}', '{"n": 1.0}', '{"n": 10}', '{"n": 1}', '{"n": 2}', '{"n": null}', "{}"]
    gaps = collection(spark, {"a": {"n": 2}, "b": {"n": "x"}, "c": {"other": 1}}).aggregate(metrics="sum:n,min:n,max:n,sum:zip").groups[0]["metrics"]
    assert gaps == {"sum:n": {"count": 1, "sum": 2.0}, "min:n": {"min": 2}, "max:n": {"max": "x"}, "sum:zip": {"count": 0}}


def test_typed_and_variant_agree_and_filters_are_pushed(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 7 AS age", "CASE WHEN id % 3 = 0 THEN 'gold' ELSE 'silver' END AS tier", "named_struct('rank', id) AS meta", "CASE WHEN id % 5 = 0 THEN id END AS bonus")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    key = F.lpad(F.col("id").cast("string"), 4, "0")
    a = Collection("a", typed(table, key))
    b = Collection("b", variant(table, key, F.to_json(F.struct("*"))))
    for f in ({"age": {"$gte": 3}, "tier": "gold"}, {"bonus": {"$exists": False}}, {"meta.rank": {"$lt": 50}, "bonus": {"$not": {"$gt": 20}}}, {"$nor": [{"age": 1}, {"tier": {"$prefix": "s"}}]}):
        want = a.query(filter=f, limit=1000, keys=True)
        got = b.query(filter=f, limit=1000, keys=True)
        assert got.keys == want.keys and got.items == want.items
        assert [k for k, d in zip(want.keys, want.items, strict=True) if not matches(parse_filter(f), d)] == []
    plan = a.find(filter={"age": {"$gte": 3}, "tier": {"$prefix": "g"}})._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(age,3)" in pushed and "StringStartsWith(tier,g)" in pushed


FILTERS = ({"n": 1}, {"n": {"$in": [0, 2.0, None]}}, {"n": {"$gte": 1, "$lt": 2}, "s": {"$contains": "xx"}}, {"n": {"$type": "null"}}, {"n": {"$exists": True}}, {"s": "x"}, {"n": {"$gt": 5}}, {"n": [1, {"a": 2}]}, {"n": {"$type": "array"}}, {"n": "w"}, {"n": {"$prefix": "w"}}, {"n": True}, {"n": {"$lt": "x"}})


def same_with_index(c):
    for f in FILTERS:
        assert sorted(r["key"] for r in c.find_by_index(f).collect()) == sorted(r["key"] for r in c.find(filter=f).collect()), f


def test_indexes(spark, tmp_path):
    c = collection(spark, {f"k{i}": {"n": i % 3, "s": "x" * i} if i else {"n": None} for i in range(10)} | {"z": {}, "l": {"n": [1, {"a": 2}]}, "w": {"n": "wx"}, "t": {"n": True}})
    with pytest.raises(NotFound):
        c.create_index("homeless", "n")
    c.indexes.drop("homeless")
    c.folder = str(tmp_path / "indexes")
    assert c.create_index("by_n", "n") and not c.create_index("by_n", "n")
    with pytest.raises(Conflict):
        c.create_index("by_n", "s")
    assert c.index_status() == [{"name": "by_n", "field": "n", "state": "ready", "documents": 13, "values": 7}]
    assert c.explain_index({"n": 1})["index"] == "by_n"
    same_with_index(c)
    assert c.explain_index({"$or": [{"n": 1}]}) is None and c.explain_index({"s": "x"}) is None
    with pytest.raises(NotFound):
        c.drop_index("other")
    c.drop_index("by_n")
    assert c.index_status() == [] and c.explain_index({"n": 1}) is None
    assert successor("a") == "b" and successor("a\U0010ffff") == "b" and successor("\U0010ffff") is None and successor("\ud7ff") == "\ue000"


def test_indexes_follow_the_log(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).create("c")
    c.source.bulk([{"id": f"k{i}", "value": {"n": i % 3, "s": "x" * i}} for i in range(8)])
    c.create_index("by_n", "n")
    first = c.postings.version("by_n")
    same_with_index(c)
    c.source.put("k1", {"n": "wide"})
    c.source.put("new", {"n": [1, {"a": 2}]})
    c.source.delete("k4")
    assert c.index_status()[0]["state"] == "stale"
    same_with_index(c)
    assert c.postings.version("by_n") == c.source.head() > first and c.index_status()[0] == {"name": "by_n", "field": "n", "state": "ready", "documents": 8, "values": 5}
    # Another process finds the definition in the log.
    again = Engine(spark, str(tmp_path)).create("c")
    assert again.explain_index({"n": 2})["index"] == "by_n"
    c.source.drop()
    c.source.put("late", {"n": 1})
    assert c.explain_index({"n": 1}) is None and [r["key"] for r in c.find_by_index({"n": 1}).collect()] == ["late"]


def test_probes_reach_the_scan_of_postings(spark, tmp_path):
    c = collection(spark, {f"k{i:03}": {"n": i} for i in range(300)})
    c.folder = str(tmp_path)
    c.create_index("by_n", "n")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = c.find_by_index({"n": {"$gte": 10, "$lt": 20}})._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(part.split("]")[0] for part in plan.split("PushedFilters:")[1:])
    assert "GreaterThanOrEqual(value.num,10.0)" in pushed and "LessThan(value.num,20.0)" in pushed and "EqualTo(value.rank" in pushed


def test_plans_of_sorted_variants(spark):
    c = collection(spark, {"a": {"v": 1}, "b": {"v": [2]}, "c": {}})
    found = c.find(sort="v:desc", limit=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and [r["key"] for r in found.collect()] == ["b", "a"]
    # Python stands in the branch of nested values only.
    assert plan.count("ArrowEvalPython") <= 1 < plan.count("Union") + 1


def test_key_order_by_parts(spark):
    rows = spark.createDataFrame([(i * 37 % 100, i % 3) for i in range(100)], "a bigint, b int")
    key = F.concat_ws("-", F.lpad(F.col("a").cast("string"), 20, "0"), F.lpad(F.col("b").cast("string"), 20, "0"))
    plain, parts = (Collection("t", typed(rows, key, order=o)) for o in ((), ("a", "b")))
    for request in ({"limit": 30}, {"sort": "b:desc", "limit": 30}):
        assert [r["key"] for r in plain.find(**request).collect()] == [r["key"] for r in parts.find(**request).collect()]
    plan = parts.find(sort="b", limit=5).select("doc.a")._jdf.queryExecution().executedPlan().toString()
    assert "lpad" not in plan


def test_a_collection_before_its_first_write(spark, tmp_path):
    c = Engine(spark, str(tmp_path)).create("new")
    assert c.query().items == [] and c.query(filter={"a": 1}, sort="b").items == []
    assert c.aggregate(metrics="count,sum:a").groups == [] and c.find().count() == 0
    assert c.changes(after=0).count() == 0 and c.changes().count() == 0 and c.index_status() == []
    with pytest.raises(NotFound):
        c.get("k")


def test_engine_names(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    with pytest.raises(NotFound):
        e.collection("none")
    c = e.create("orders")
    c.source.put("o1", {"x": 1})
    assert e.collections() == ["orders"] and c.get("o1")[0] == {"x": 1}
    c.create_index("by_x", "x")
    c.drop()
    assert c.indexes.list() == [] and e.collections() == [] and c.query().items == []
    with pytest.raises(NotFound):
        c.get("o1")
    assert lookup({"a": [1]}, "a.0") == (False, None)
