import hashlib
import hmac
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from docquarry.errors import Conflict, Gone, NotFound, PreconditionFailed, Refused
from docquarry.functions.patch import merge_patch, merge_patch_json
from docquarry.plans.filters import parse_filter
from docquarry.sources import log as logs
from docquarry.streaming import changes as feed
from docquarry.streaming.webhook import Subscriptions, Webhook, stream_to, waits

PATCHES = [
    ({"a": "b"}, {"a": "c"}, {"a": "c"}),
    ({"a": "b"}, {"b": "c"}, {"a": "b", "b": "c"}),
    ({"a": "b", "b": "c"}, {"a": None}, {"b": "c"}),
    ({"a": ["b"]}, {"a": "c"}, {"a": "c"}),
    ({"a": {"b": "c"}}, {"a": {"b": "d", "c": None}}, {"a": {"b": "d"}}),
    ({"a": [{"b": "c"}]}, {"a": [1]}, {"a": [1]}),
    (["a", "b"], ["c", "d"], ["c", "d"]),
    ({"a": "b"}, ["c"], ["c"]),
    ({"e": None}, {"a": 1}, {"e": None, "a": 1}),
    ([1, 2], {"a": "b", "c": None}, {"a": "b"}),
    ({}, {"a": {"bb": {"ccc": None}}}, {"a": {"bb": {}}}),
]


def test_merge_patch(spark):
    assert all(merge_patch(t, p) == r for t, p, r in PATCHES)
    rows = spark.createDataFrame([(json.dumps(t), json.dumps(p)) for t, p, _ in PATCHES] + [(None, "{}")], "t string, p string")
    got = [r[0] for r in rows.select(merge_patch_json("t", "p")).collect()]
    assert [json.loads(g) for g in got[:-1]] == [r for _, _, r in PATCHES] and got[-1] is None


def test_mutations(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    made = log.put("k", {"v": 1, "w": 2}, expire_at=5000, now_ms=1000)
    assert made.status == 201 and made.etag == '"1.1"'
    assert log.patch("k", {"w": None}, now_ms=1000).etag == '"1.2"'
    assert log.get("k") == ({"v": 1}, '"1.2"')
    assert logs.snapshot(log.read()).first()["expire_at"] == 5000
    with pytest.raises(PreconditionFailed) as e:
        log.put("k", {}, if_match='"1.1"')
    assert e.value.etag == '"1.2"'
    with pytest.raises(PreconditionFailed):
        log.put("k", {}, if_none_match="*")
    with pytest.raises(PreconditionFailed):
        log.put("k", {}, if_match='W/"1.2"')
    assert log.put("k", {"v": 2}, if_match='"0.0", "1.2"', now_ms=1000).status == 200
    assert logs.snapshot(log.read()).first()["expire_at"] is None
    for bad in (lambda: log.put("k", 1, expire_at=0), lambda: log.patch("k", None), lambda: log.set_ttl(0), lambda: log.put("k", 1, if_match="bare")):
        with pytest.raises(Refused):
            bad()
    with pytest.raises(NotFound):
        log.patch("absent", {})
    assert log.delete("absent").existed is False and log.delete("k").existed is True
    assert [o.status for o in log.bulk([{"id": "a", "value": 1}, {"value": 2}, {"id": "a", "value": 3}], now_ms=1000)] == [201, 201, 200]
    assert log.get("a")[0] == 3
    log.drop()
    assert logs.snapshot(log.read()).count() == 0
    n = log.head()
    log.drop()
    assert log.head() == n
    log.append_frame(spark.range(5).selectExpr("concat('n', id) AS key", "'{}' AS value"))
    assert logs.snapshot(log.read()).count() == 5 and log.head() > n


def test_expiry(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    log.put("past", {"v": 1}, expire_at=100, now_ms=50)
    log.put("later", {"v": 2}, expire_at=10_000_000, now_ms=50)
    log.put("plain", {"v": 3}, now_ms=50)
    assert [r["key"] for r in logs.expired(log.read(), 200).collect()] == ["past"]
    log.set_ttl(1)
    assert log.get_ttl() == 1 and log.sweep(2000) == 2 and log.sweep(2000) == 0
    assert [r["key"] for r in logs.snapshot(log.read()).collect()] == ["later"]
    log.set_ttl(None)
    assert log.get_ttl() is None
    log.compact(str(tmp_path / "d"))
    small = logs.Log(spark, str(tmp_path / "d"))
    assert small.get("later")[0] == {"v": 2} and small.read().count() < log.read().count()


def test_sweep_is_one_append(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    assert log.sweep(10**15) == 0
    log.append_frame(spark.range(300).selectExpr("concat('k', id) AS key", "'{}' AS value"))
    log.put("stays", 1, expire_at=10**15, now_ms=1)
    log.set_ttl(1)
    files = {f.name for f in (tmp_path / "c").glob("*.parquet")}
    before = log.head()
    assert log.sweep(10**14) == 300 and [r["key"] for r in logs.snapshot(log.read()).collect()] == ["stays"]
    added = logs.suffix(log.read(), before)
    assert added.select("op").distinct().collect() == [("del",)] and added.select("lsn").distinct().count() == 300
    assert len({f.name for f in (tmp_path / "c").glob("*.parquet")} - files) < 64


def test_compaction_in_place(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    log.compact()
    for i in range(4):
        log.put("a", {"n": i})
    log.put("b", 1)
    log.set_ttl(50)
    log.delete("b")
    state, head = ordered_state(log), log.head()
    assert not log.compact_if(0.9) and log.compact_if(0.5)
    # The last entry was a deletion; a barrier keeps its number in use.
    assert ordered_state(log) == state and log.head() == head and log.get_ttl() == 50
    assert sorted((r["lsn"], r["op"]) for r in log.read().collect()) == [(4, "put"), (6, "ttl"), (7, "barrier")]
    assert log.put("c", 2).etag == '"1.8"' and not (tmp_path / "c.old").exists() and not (tmp_path / "c.new").exists()
    # A writer that stopped between the two renames.
    (tmp_path / "c").rename(tmp_path / "c.old")
    log.recover()
    assert log.get("c")[0] == 2 and not (tmp_path / "c.old").exists()


def ordered_state(log):
    return sorted((r["key"], r["value"], r["lsn"]) for r in logs.snapshot(log.read()).collect())


def test_export_and_restore(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    log.put("a", {"n": 1}, expire_at=77)
    log.put("a", {"n": 2}, expire_at=78)
    log.put("gone", 1)
    log.delete("gone")
    log.define_index("by_n", "n")
    head = log.export(str(tmp_path / "out"))
    log.put("later", 3)
    other = logs.Log(spark, str(tmp_path / "d"))
    other.restore(str(tmp_path / "out"))
    assert head == 5 and ordered_state(other) == [("a", '{"n":2}', 2)] and other.index_definitions() == {"by_n": "n"}
    assert [r["expire_at"] for r in logs.snapshot(other.read()).collect()] == [78]
    with pytest.raises(PreconditionFailed):
        other.restore(str(tmp_path / "out"))


def entries(spark, ops):
    rows = [(n, op, k, json.dumps(v) if v is not None else None, moved) for n, (op, k, v, moved) in enumerate(ops, 1)]
    return spark.createDataFrame(rows, "lsn bigint, op string, key string, value string, migration boolean")


def by_hand(ops):
    live, out = set(), []
    for n, (op, k, _, moved) in enumerate(ops, 1):
        kind = {"put": "update" if k in live else "insert", "del": "delete" if k in live else None, "drop": "drop"}.get(op)
        if op == "drop":
            live.clear()
        elif op in ("put", "del"):
            (live.add if op == "put" else live.discard)(k)
        if kind and not moved:
            out.append((n, kind))
    return out


OPS = [("put", "a", {"s": 1}, False), ("put", "a", {"s": 2}, False), ("del", "a", None, False), ("del", "a", None, False), ("put", "b", {"s": 5}, True), ("put", "b", {"s": 1}, False), ("barrier", None, None, False)]


def test_classification(spark, monkeypatch):
    more = [*OPS, ("drop", None, None, False), ("put", "b", {"s": 9}, False), ("del", "a", None, False), ("drop", None, None, False), ("drop", None, None, False), ("put", "b", {"s": 9}, False)] * 3
    for stretch in (1 << 20, 4):
        monkeypatch.setattr(feed, "STRETCH", stretch)
        for ops in (OPS, more):
            got = [(r["lsn"], r["op"]) for r in feed.classify(entries(spark, ops)).orderBy("lsn").collect()]
            assert got == by_hand(ops)


def test_admission_and_resume(spark):
    changes = feed.classify(entries(spark, OPS))
    assert [r["lsn"] for r in feed.admitted(changes, filter=parse_filter({"s": {"$gt": 1}})).orderBy("lsn").collect()] == [2, 3]
    assert [r["lsn"] for r in feed.admitted(changes, ops=("delete",)).collect()] == [3]
    assert feed.resume(changes, None, 7).count() == 0 and feed.resume(changes, 2, 7).count() == 2
    with pytest.raises(Refused):
        feed.resume(changes, 8, 7)
    floor = feed.retention_floor(changes, 2)
    with pytest.raises(Gone) as e:
        feed.resume(changes, 0, 7, floor)
    assert e.value.resume_floor == floor == 2
    sent = list(feed.frames("c", 0, changes, "overrun"))
    assert [f["event"] for f in sent] == ["open", "change", "change", "change", "change", "error"]
    assert feed.sse(sent[1]) == 'event: change\nid: 1\ndata: {"lsn": 1, "op": "insert", "key": "a", "value": {"s": 1}}\n\n'
    assert json.loads(feed.message(sent[0])) == {"event": "open", "position": 0, "collection": "c"}
    assert feed.deduplicated(changes.unionByName(changes)).count() == 4


def test_merged_feeds(spark):
    a, b = (feed.classify(entries(spark, ops)) for ops in (OPS, OPS[:3]))
    both = feed.merged({0: a, 1: b})
    assert both.count() == 7 and feed.deduplicated(both.unionByName(both), F.col("shard")).count() == 7
    rest = feed.resume_merged({0: a, 1: b}, feed.merged_position({0: 2, 1: 1}, 9), 9)
    assert sorted((r["shard"], r["lsn"]) for r in rest.collect()) == [(0, 3), (0, 6), (1, 2), (1, 3)]
    with pytest.raises(Conflict):
        feed.resume_merged({0: a}, feed.merged_position({0: 2, 1: 1}))
    with pytest.raises(Conflict):
        feed.resume_merged({0: a}, feed.merged_position({0: 2}, 1), 2)
    for bad in (lambda: feed.merged({}), lambda: feed.resume_merged({0: a}, "e30")):
        with pytest.raises(Refused):
            bad()
    assert [r["lsn"] for r in logs.suffix(entries(spark, OPS), 2, 4).collect()] == [3, 4]


def test_stream_agrees_with_batch_and_reaches_a_webhook(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    for v in range(3):
        log.append([{"op": "put", "key": k, "value": json.dumps({"v": v})} for k in "abc"] + [{"op": "del", "key": "b"}])
    got, status = [], iter([500, 200, 200])

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["content-length"]))
            want = hmac.new(b"s", self.headers["x-timestamp"].encode() + b"." + body, hashlib.sha256).hexdigest()
            assert self.headers["x-signature"] == f"sha256={want}"
            code = next(status, 410)
            if code == 200:
                got.extend(json.loads(body)["events"])
            self.send_response(code)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    slept = []
    hook = Webhook("h", f"http://127.0.0.1:{server.server_port}", "s", sleep=slept.append)
    stream = feed.classify_stream(spark.readStream.schema(logs.SCHEMA).parquet(log.path))
    stream_to(hook, "c", stream, str(tmp_path / "state")).awaitTermination()
    want = [(r["lsn"], r["op"]) for r in feed.classify(log.read()).orderBy("lsn").collect()]
    assert [(e["lsn"], e["op"]) for e in got] == want and slept == [0.5] and hook.position == want[-1][0]
    log.append([{"op": "put", "key": "z", "value": "{}"}])
    stream_to(hook, "c", stream, str(tmp_path / "state")).awaitTermination()
    assert got[-1]["key"] == "z"
    log.append([{"op": "put", "key": "z", "value": "{}"}])
    stream_to(hook, "c", stream, str(tmp_path / "state")).awaitTermination()
    assert hook.disabled
    server.shutdown()
    steps = waits()
    assert [next(steps) for _ in range(8)] == [0.5, 1, 2, 4, 8, 16, 30, 30]
    assert logs.documents(log.read()).df.where(F.col("key") == "z").count() == 1


def test_stored_subscriptions(spark, tmp_path, monkeypatch):
    """Progress is kept by post; another process goes on; an overrun is a gap; a subscription has its kinds and its filter."""
    posts, answers = [], []

    def post(self, body):
        posts.append(json.loads(body))
        if answers:
            self.disabled = answers.pop(0) == 410
        return not self.disabled

    monkeypatch.setattr(Webhook, "_post", post)
    log = logs.Log(spark, str(tmp_path / "c"))
    log.bulk([{"id": f"k{i}", "value": {"n": i}} for i in range(70)])
    hooks = Subscriptions(logs.Log(spark, str(tmp_path / "hooks")))
    hooks.create(Webhook("all", "http://x"))
    hooks.create(Webhook("some", "http://y", ops="insert", filter={"n": {"$gte": 68}}))
    with pytest.raises(PreconditionFailed):
        hooks.create(Webhook("all", "http://z"))
    with pytest.raises(Refused):
        hooks.create(Webhook("bad", "http://z", ops="moved"))
    assert [h.id for h in hooks.list()] == ["all", "some"]
    assert hooks.pump("all", "c", log).position == 70 and [len(p["events"]) for p in posts] == [64, 6]
    again = Subscriptions(logs.Log(spark, str(tmp_path / "hooks")))
    assert again.get("all").position == 70 and again.pump("all", "c", log).gaps == 0 and len(posts) == 2
    assert again.pump("some", "c", log).position == 70 and [e["key"] for e in posts[-1]["events"]] == ["k68", "k69"]
    log.bulk([{"id": f"m{i}", "value": i} for i in range(10)])
    hook = again.pump("all", "c", log, buffer=3)
    assert hook.gaps == 1 and [e["lsn"] for e in posts[-1]["events"]] == [78, 79, 80] and again.get("all").gaps == 1
    log.put("end", 1)
    answers.append(410)
    assert again.pump("all", "c", log).disabled and again.get("all").disabled and again.get("all").position == 80
    assert again.delete("all") and not again.delete("all") and [h.id for h in again.list()] == ["some"]


def test_frames_of_a_stream(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "c"))
    log.put("a", 1)
    log.put("a", 2)
    log.delete("a")
    source = spark.readStream.schema(logs.SCHEMA).parquet(log.path)
    for form in (feed.sse, feed.message):
        sent = []
        feed.stream_frames("c", 1, feed.classify_stream(source), sent.append, form, str(tmp_path / form.__name__)).awaitTermination()
        assert sent == [form(f) for f in feed.frames("c", 1, feed.classify(log.read()).where("lsn > 1"))]
