import json
import random

import pytest
from pyspark.sql import functions as F

from docquarry.errors import Forbidden, Refused
from docquarry.operators.filtering import truth
from docquarry.plans import requests
from docquarry.plans.filters import OPERATORS, parse_filter
from docquarry.sources.tables import typed, variant
from tests.evaluator import matches

DOCUMENTS = [
    {"a": 1, "b": {"c": "x"}, "t": ["u", "v"], "n": None},
    {"a": 1.0, "b": {"c": 5}, "t": [], "items": [{"q": 3}, {"q": 9, "s": "k"}]},
    {"a": "1", "b": None, "t": "u", "n": 0},
    {"a": True, "b": {}, "t": [1, 1.0, None], "items": [3, "k", {"q": "9"}]},
    {"a": [1, {"z": None}], "b": {"c": {"d": [1, 2]}}},
    {"a": {"x": 1, "y": 2.5}, "b": {"c": ""}},
    {"a": -0.5, "b": {"c": "xy"}, "a-b": {"$x": "é"}, "d.e": 1},
    {"a": 12345678901234567890, "t": [["u"], {"q": 1}]},
    {},
    [1, 2],
    "text",
    7,
    None,
]
LITERALS = [None, True, False, 0, 1, 1.0, 2.5, -0.5, 12345678901234567890, "", "1", "x", "xy", "u", [], [1, 2], ["u", "v"], {}, {"x": 1, "y": 2.5}, {"c": "x"}]
PATHS = ["a", "b", "b.c", "b.c.d", "t", "t.0", "n", "items", "a-b", "a-b.$x", "missing", "missing.x", "a.x", ""]


def run(spark, docs, filters):
    """Which documents each filter matches, all in one job."""
    rows = spark.createDataFrame([(f"{i:03}", json.dumps(d)) for i, d in enumerate(docs)], "key string, text string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = variant(rows, F.col("key"), F.col("text"))
    out = found.df.select("key", *(truth(parse_filter(f), found.root).alias(f"f{i}") for i, f in enumerate(filters)))
    rows = out.orderBy("key").collect()
    return [[r[f"f{i}"] for r in rows] for i in range(len(filters))]


def random_condition(rng, depth=0):
    ops = ["$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$exists", "$type", "$prefix", "$suffix", "$contains", "$all", "$size"] + ["$not", "$elemMatch"] * (depth < 2)
    op = rng.choice(ops)
    pick = lambda: rng.choice(LITERALS)
    if op in ("$in", "$nin", "$all"):
        return {op: [pick() for _ in range(rng.randint(0, 3))]}
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return {op: rng.choice([0, 1, 2.5, -0.5, "", "u", "x"])}
    if op == "$exists":
        return {op: rng.random() < 0.5}
    if op == "$type":
        return {op: rng.choice(["null", "bool", "number", "string", "array", "object", ["array", "null"]])}
    if op in ("$prefix", "$suffix", "$contains"):
        return {op: rng.choice(["", "x", "u", "1"])}
    if op == "$size":
        return {op: rng.randint(0, 3)}
    if op == "$not":
        return {op: random_condition(rng, depth + 1)}
    if op == "$elemMatch":
        return {op: random_condition(rng, depth + 1) if rng.random() < 0.5 else {"q": random_condition(rng, depth + 1)}}
    return {op: pick()}


def random_filter(rng, depth=0):
    out = {rng.choice(PATHS): random_condition(rng) for _ in range(rng.randint(0, 2))}
    if depth < 1 and rng.random() < 0.4:
        out[rng.choice(["$and", "$or", "$nor"])] = [random_filter(rng, depth + 1) for _ in range(rng.randint(1, 2))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_variant_filters_agree_with_the_evaluator(spark, seed):
    rng = random.Random(seed)
    filters = [random_filter(rng) for _ in range(40)]
    for f, got in zip(filters, run(spark, DOCUMENTS, filters), strict=True):
        assert got == [matches(parse_filter(f), d) for d in DOCUMENTS], f


def test_each_operator_on_each_literal(spark):
    filters = [{"a": {op: x}} for op in ("$eq", "$ne") for x in LITERALS] + [{"t": {"$all": [x]}} for x in LITERALS]
    for f, got in zip(filters, run(spark, DOCUMENTS, filters), strict=True):
        assert got == [matches(parse_filter(f), d) for d in DOCUMENTS], f


TYPED = [
    (1, 1.5, "abc", True, [1, 2], {"x": "p", "y": 1}),
    (2, 2.0, "abd", False, [], {"x": None, "y": 2}),
    (None, None, None, None, None, None),
    (-5, -0.5, "", True, [5], {"x": "q", "y": None}),
]
SCHEMA = "i int, d double, s string, b boolean, l array<bigint>, o struct<x: string, y: bigint>"


def as_json(row):
    out = {k: v for k, v in zip(("i", "d", "s", "b", "l", "o"), row, strict=True) if v is not None}
    if "o" in out:
        out["o"] = {k: v for k, v in out["o"].items() if v is not None}
    return out


@pytest.mark.parametrize(
    "f",
    [
        {"i": 1}, {"i": 1.0}, {"d": 2}, {"d": 2.0}, {"s": "abc"}, {"b": True}, {"l": [1, 2]}, {"l": []}, {"o": {"x": "p", "y": 1}}, {"o": {"y": 2}}, {"o": {"y": 2, "z": 1}},
        {"i": {"$ne": 1}}, {"d": {"$ne": 2}}, {"s": {"$ne": 3}}, {"i": {"$in": [1, 2.0, "x"]}}, {"d": {"$in": [1.5, 2]}}, {"i": {"$in": []}}, {"i": {"$nin": [1]}}, {"i": {"$nin": []}},
        {"i": {"$gt": 0.5, "$lt": 2}}, {"i": {"$gte": 0.5}}, {"i": {"$lte": -4.5}}, {"i": {"$lt": -4.5}}, {"d": {"$gt": 1}}, {"d": {"$lte": 2}}, {"s": {"$gt": "abc"}}, {"s": {"$lte": "abc"}}, {"s": {"$gt": 1}}, {"b": {"$gt": 1}},
        {"i": {"$gt": 1e300}}, {"i": {"$lt": 1e300}}, {"i": {"$gt": -1e300}},
        {"i": {"$exists": True}}, {"i": {"$exists": False}}, {"z": {"$exists": False}}, {"o.x": {"$exists": True}}, {"o.z.w": {"$exists": False}},
        {"i": {"$type": "number"}}, {"s": {"$type": ["string", "null"]}}, {"l": {"$type": "array"}}, {"o": {"$type": "object"}}, {"b": {"$type": "null"}},
        {"s": {"$prefix": "ab"}}, {"s": {"$suffix": "d"}}, {"s": {"$contains": "b"}}, {"i": {"$prefix": "1"}},
        {"l": {"$all": [1]}}, {"l": {"$all": []}}, {"l": {"$all": [1, "x"]}}, {"l": {"$size": 0}}, {"l": {"$size": 2}}, {"l": {"$elemMatch": {"$gt": 1, "$lt": 5}}}, {"l": {"$elemMatch": {}}}, {"l": {"$elemMatch": {"q": 1}}},
        {"i": {"$not": {"$gt": 0}}}, {"z": {"$not": {"$eq": 1}}}, {"o.y": {"$not": {"$in": [1]}}}, {"l.0": 1},
        {"$or": [{"i": 1}, {"o.x": "q"}]}, {"$nor": [{"i": 1}, {"o.x": "q"}]}, {"$and": [{"i": {"$gt": 0}}, {"b": False}]}, {},
    ],
)
def test_typed_filters_agree_with_the_evaluator(spark, f):
    if "typed_rows" not in globals():
        globals()["typed_rows"] = typed(spark.createDataFrame(TYPED, SCHEMA), F.lit("k"))
    docs = globals()["typed_rows"]
    got = [r[0] for r in docs.df.select(truth(parse_filter(f), docs.root)).collect()]
    assert got == [matches(parse_filter(f), as_json(row)) for row in TYPED]


#: A value of every shape, and which of them each operator takes as its operand.
SHAPES = {"null": None, "flag": True, "whole": 3, "negative": -3, "fraction": 1.5, "text": "word", "kind": "number", "empty": [], "texts": ["word"], "kinds": ["null", "number"], "numbers": [1, 2], "object": {"q": 1}, "nothing": {}, "condition": {"$gt": 1}}
ANYTHING = set(SHAPES)
ARRAYS = {"empty", "texts", "kinds", "numbers"}
TEXT = {"text", "kind"}
OPERANDS = {
    **dict.fromkeys(("$eq", "$ne"), ANYTHING),
    **dict.fromkeys(("$in", "$nin", "$all"), ARRAYS),
    **dict.fromkeys(("$gt", "$gte", "$lt", "$lte"), {"whole", "negative", "fraction", *TEXT}),
    "$exists": {"flag"},
    "$type": {"kind", "kinds"},
    **dict.fromkeys(("$prefix", "$suffix", "$contains"), TEXT),
    "$size": {"whole"},
    "$elemMatch": {"object", "nothing", "condition"},
    "$not": {"condition"},
}


@pytest.mark.parametrize("name", sorted(OPERANDS))
def test_operands(name):
    for shape, value in SHAPES.items():
        request = {"field": {name: value}}
        if shape in OPERANDS[name]:
            assert parse_filter(request) is not None, (name, shape)
        else:
            with pytest.raises(Refused):
                print(name, shape, parse_filter(request))


def test_every_operator_has_its_operands():
    assert set(OPERANDS) == set(OPERATORS)


@pytest.mark.parametrize("branch", ("$and", "$or", "$nor"))
def test_branches_take_lists_of_filters(branch):
    assert parse_filter({branch: [{"field": 1}]}) is not None
    for value in SHAPES.values():
        with pytest.raises(Refused):
            parse_filter({branch: value})
    # A branch stands beside paths, not under one.
    with pytest.raises(Refused):
        parse_filter({"field": {"$elemMatch": {branch: [{"q": 1}]}}})


def test_unknown_names_and_broken_texts():
    for request in ({"$unless": [{"field": 1}]}, {"field": {"$like": "word"}}, {"field": {"$gt": 1, "plain": 2}}, {"field": {"$not": {"$gt": 1, "plain": 2}}}, {"field": {"$gte": 2, "$lt": "word"}}, "", "{", "3", "[{}]", '"text"'):
        with pytest.raises(Refused):
            print(request, parse_filter(request))


def test_depth():
    deep = {"a": 1}
    for _ in range(16):
        deep = {"$and": [deep]}
    parse_filter(deep)
    with pytest.raises(Refused):
        parse_filter({"$and": [deep]})
    inner = {"$gt": 1}
    for _ in range(17):
        inner = {"$not": inner}
    with pytest.raises(Refused):
        parse_filter({"a": inner})


@pytest.mark.parametrize(
    "call",
    [
        lambda: requests.parse_sort(""), lambda: requests.parse_sort("a,,b"), lambda: requests.parse_sort("a:up"), lambda: requests.parse_sort("a:asc:desc"), lambda: requests.parse_sort("a,a:desc"), lambda: requests.parse_sort(",".join("abcdefghi")), lambda: requests.parse_sort(":desc"),
        lambda: requests.parse_group(""), lambda: requests.parse_group("a,a"), lambda: requests.parse_group("a,b,c,d,e"), lambda: requests.parse_metrics("count:a"), lambda: requests.parse_metrics("sum"), lambda: requests.parse_metrics("sum:"), lambda: requests.parse_metrics("p99:a"), lambda: requests.parse_metrics("count,count"),
        lambda: requests.parse_metrics(",".join(f"sum:{i}" for i in range(17))), lambda: requests.parse_keys("yes"), lambda: requests.check_range("b", "a"), lambda: requests.bounded(10_001, "limit", 100, 10_000), lambda: requests.parse_change_ops(""), lambda: requests.check_read("nearest"),
        lambda: requests.check_name("A"), lambda: requests.check_name(".a"), lambda: requests.check_name("a."), lambda: requests.check_name("x.tmp"), lambda: requests.check_name("con"), lambda: requests.check_name("a" * 129), lambda: requests.check_index("a b", "x"), lambda: requests.check_index("a", "x..y"), lambda: requests.check_index("a", "$x"),
        lambda: requests.key_position("%%%"), lambda: requests.key_position(requests.encode_cursor({"values": [1], "key": "a"})), lambda: requests.sort_position(requests.encode_cursor({"key": "a"}), [requests.SortKey("a")]), lambda: requests.sort_position(requests.encode_cursor({"values": [1, 2], "key": "a"}), [requests.SortKey("a")]),
    ],
)
def test_refused_requests(call):
    with pytest.raises(Refused):
        call()


def test_requests():
    assert requests.parse_sort("a, b.c:DESC") == [requests.SortKey("a"), requests.SortKey("b.c", True)]
    assert requests.parse_fields(" a, ,b.c,") == ["a", "b.c"]
    assert [m.label for m in requests.parse_metrics(" ")] == ["count"]
    assert requests.bounded(0, "limit", 100, 10_000) == 1
    assert requests.sort_position(requests.encode_cursor({"value": 3, "key": "k"}), [requests.SortKey("a")]) == ([3], "k")
    assert requests.decode_cursor(requests.encode_cursor({"key": "é??>>"})) == {"key": "é??>>"}
    with pytest.raises(Forbidden):
        requests.check_name("_system")
