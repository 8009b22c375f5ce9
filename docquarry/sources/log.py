"""The log: an append-only table of puts, deletes, drops and settings, and the collection state that it amounts to.

State is an aggregate of the log. The newest entry of each key wins, which combines within tasks before
the shuffle; a drop cuts off all before it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.errors import NotFound, PreconditionFailed, Refused
from docquarry.functions.kinds import canonical
from docquarry.functions.patch import merge_patch
from docquarry.sources.tables import Documents

SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("lsn", T.LongType()),
            ("term", T.LongType()),
            ("op", T.StringType()),
            ("key", T.StringType()),
            ("value", T.StringType()),
            ("ts", T.LongType()),
            ("expire_at", T.LongType()),
            ("migration", T.BooleanType()),
            ("ttl_secs", T.LongType()),
        )
    ]
)
_DOCUMENT = ("put", "del")


def suffix(log: DataFrame, after: int, up_to: int | None = None) -> DataFrame:
    """Entries above ``after`` and, if given, up to ``up_to``; both bounds reach the Parquet scan."""
    found = log.where(F.col("lsn") > after)
    return found if up_to is None else found.where(F.col("lsn") <= up_to)


def last_drop(log: DataFrame) -> int | None:
    """The number of the last drop, by a scan for drops alone."""
    return log.where("op = 'drop'").agg(F.max("lsn")).first()[0]


def since_drop(log: DataFrame) -> DataFrame:
    """The entries after the last drop. Its number is looked up now and is a bound that reaches the scan."""
    dropped = last_drop(log)
    return log if dropped is None else log.where(F.col("lsn") > dropped)


def snapshot(log: DataFrame) -> DataFrame:
    """The live documents: ``key, value`` (JSON text), ``ts, expire_at, term, lsn`` of their last put."""
    entry = F.struct("op", "value", "ts", "expire_at", "term", "lsn")
    newest = since_drop(log).where(F.col("op").isin(*_DOCUMENT)).groupBy("key").agg(F.max_by(entry, "lsn").alias("e"))
    return newest.where("e.op = 'put'").select("key", "e.value", "e.ts", "e.expire_at", "e.term", "e.lsn")


def documents(log: DataFrame) -> Documents:
    return Documents(snapshot(log).select("key", F.parse_json("value").alias("doc"), "ts", "expire_at", "term", "lsn"))


def etag(term: Column | str = "term", lsn: Column | str = "lsn") -> Column:
    return F.concat(F.lit('"'), F.col(term) if isinstance(term, str) else term, F.lit("."), F.col(lsn) if isinstance(lsn, str) else lsn, F.lit('"'))


def ttl(log: DataFrame) -> DataFrame:
    """One row: the collection's ``ttl_secs``, NULL if none is set."""
    return since_drop(log).where("op = 'ttl'").agg(F.max_by("ttl_secs", "lsn").alias("ttl_secs"))


def deadline(ttl_secs: Column) -> Column:
    """A document's own ``expire_at``, else its write time and the collection's lifetime; NULL: it stays."""
    return F.coalesce(F.col("expire_at"), F.when(F.col("ts") > 0, F.col("ts") + ttl_secs * 1000))


def expired(log: DataFrame, now_ms: int) -> DataFrame:
    """Live documents that are due. Reads don't look at deadlines; a sweep deletes what is due."""
    live = snapshot(log).join(F.broadcast(ttl(log)))
    return live.where(deadline(F.col("ttl_secs")) <= now_ms).select("key", "term", "lsn")


def shallow_patches(patches: DataFrame, key: str, order: str, fields: Iterable[str]) -> DataFrame:
    """Typed patches folded by key: of each field the newest value that is not NULL."""
    return patches.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


@dataclass(frozen=True)
class Outcome:
    status: int
    key: str
    etag: str | None = None
    existed: bool | None = None


def _etags(header: str) -> list[tuple[bool, str]]:
    """Weak or not, and tag, of a list of entity tags."""
    found = re.findall(r'\s*(W/)?("[^"]*")\s*(?:,|$)', header)
    if not found or re.sub(r'\s*(W/)?"[^"]*"\s*(,|$)', "", header).strip():
        raise Refused(f"{header!r} is not a list of entity tags")
    return [(bool(weak), tag) for weak, tag in found]


def check_preconditions(current: str | None, if_match: str | None, if_none_match: str | None) -> None:
    """If-Match compares strongly, If-None-Match weakly; ``*`` stands for any document. Both must hold."""
    holds = True
    if if_match is not None:
        holds &= current is not None if if_match.strip() == "*" else any(not weak and tag == current for weak, tag in _etags(if_match))
    if if_none_match is not None:
        holds &= current is None if if_none_match.strip() == "*" else all(tag != current for _, tag in _etags(if_none_match))
    if not holds:
        raise PreconditionFailed("the document is of another version", current)


class Log:
    """A log in a folder of Parquet files. One writer at a time: the driver numbers the entries."""

    def __init__(self, spark: SparkSession, path: str, term: int = 1):
        self.spark, self.path, self.term = spark, path, term

    def read(self) -> DataFrame:
        """All entries; none before the first write."""
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists() else self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA))

    def _at(self, path: str) -> tuple[Any, Any]:
        """The path and its file system, whichever it is."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str | None = None) -> bool:
        where, system = self._at(path or self.path)
        return system.exists(where)

    def _rename(self, source: str, target: str) -> None:
        where, system = self._at(source)
        if not system.rename(where, self._at(target)[0]):
            raise OSError(f"{source} could not be renamed")

    def _delete(self, path: str) -> None:
        where, system = self._at(path)
        system.delete(where, True)

    def head(self) -> int:
        """The highest number in use; 0 for an empty log."""
        return (self.read().agg(F.max("lsn")).first()[0] or 0) if self._exists() else 0

    def append(self, entries: list[dict[str, Any]]) -> int:
        """Numbers and writes entries in their order; the last number. One write is one commit."""
        lsn = self.head()
        rows = []
        for e in entries:
            lsn += 1
            rows.append({"lsn": lsn, "term": self.term, "op": None, "key": None, "value": None, "ts": 0, "expire_at": None, "migration": False, "ttl_secs": None} | e)
        if rows:
            self.spark.createDataFrame([[r[n] for n in SCHEMA.names] for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return lsn

    def append_frame(self, documents: DataFrame, key: str = "key", value: str = "value") -> None:
        """Bulk load: numbers follow the order of the keys, in parallel; nothing passes through the driver."""
        rows = documents.select(F.col(key).alias("key"), F.col(value).alias("value"))
        sorted_rows = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
        first = self.head() + 1
        numbered = sorted_rows.withColumn("lsn", F.col("i") + first)
        now = int(time.time() * 1000)
        fixed = {"term": self.term, "op": "put", "ts": now, "expire_at": None, "migration": False, "ttl_secs": None}
        out = numbered.select(*(F.col(f.name) if f.name in ("lsn", "key", "value") else F.lit(fixed[f.name]).cast(f.dataType).alias(f.name) for f in SCHEMA))
        out.write.mode("append").parquet(self.path)

    def _current(self, key: str) -> Any:
        return snapshot(self.read().where((F.col("key") == key) | (F.col("op") == "drop"))).first() if self._exists() else None

    def _tag(self, row: Any) -> str | None:
        return None if row is None else f'"{row["term"]}.{row["lsn"]}"'

    def get(self, key: str) -> tuple[Any, str]:
        row = self._current(key)
        if row is None:
            raise NotFound(f"there is no document {key!r}")
        return json.loads(row["value"]), self._tag(row)

    def put(self, key: str, value: Any, *, expire_at: int | None = None, if_match: str | None = None, if_none_match: str | None = None, now_ms: int | None = None) -> Outcome:
        """Replaces the whole document; its deadline is the one sent, or none."""
        row = self._current(key)
        check_preconditions(self._tag(row), if_match, if_none_match)
        lsn = self.append([self._put(key, value, expire_at, now_ms)])
        return Outcome(201 if row is None else 200, key, f'"{self.term}.{lsn}"')

    def insert(self, value: Any, *, expire_at: int | None = None, now_ms: int | None = None) -> Outcome:
        return self.put(str(uuid.uuid4()), value, expire_at=expire_at, now_ms=now_ms)

    def _put(self, key: str, value: Any, expire_at: int | None, now_ms: int | None) -> dict:
        if expire_at is not None and expire_at <= 0:
            raise Refused("expire_at is a time in milliseconds above 0")
        return {"op": "put", "key": key, "value": canonical(value), "ts": int(time.time() * 1000) if now_ms is None else now_ms, "expire_at": expire_at}

    def patch(self, key: str, patch: Any, *, expire_at: int | None = None, if_match: str | None = None, if_none_match: str | None = None, now_ms: int | None = None) -> Outcome:
        """Merges into the document and keeps its deadline unless one is sent."""
        if patch is None:
            raise Refused("a patch is not null")
        row = self._current(key)
        if row is None:
            check_preconditions(None, if_match, if_none_match)
            raise NotFound(f"there is no document {key!r}")
        check_preconditions(self._tag(row), if_match, if_none_match)
        merged = merge_patch(json.loads(row["value"]), patch)
        lsn = self.append([self._put(key, merged, row["expire_at"] if expire_at is None else expire_at, now_ms)])
        return Outcome(200, key, f'"{self.term}.{lsn}"')

    def delete(self, key: str, *, if_match: str | None = None, if_none_match: str | None = None) -> Outcome:
        """An absent document's deletion is logged too."""
        row = self._current(key)
        check_preconditions(self._tag(row), if_match, if_none_match)
        self.append([{"op": "del", "key": key}])
        return Outcome(200, key, existed=row is not None)

    def bulk(self, documents: list[dict[str, Any]], now_ms: int | None = None) -> list[Outcome]:
        """Documents with ``value`` and optionally ``id`` and ``expire_at``; the outcomes are in their order."""
        keyed = [d | {"id": d.get("id") or str(uuid.uuid4())} for d in documents]
        known = self.read().where(F.col("key").isin([d["id"] for d in keyed]) | (F.col("op") == "drop")) if self._exists() else None
        seen = {r["key"] for r in snapshot(known).select("key").collect()} if known is not None else set()
        last = self.append([self._put(d["id"], d["value"], d.get("expire_at"), now_ms) for d in keyed])
        out = []
        for n, d in enumerate(keyed, last - len(keyed) + 1):
            out.append(Outcome(200 if d["id"] in seen else 201, d["id"], f'"{self.term}.{n}"'))
            seen.add(d["id"])
        return out

    def define_index(self, name: str, path: str | None) -> None:
        """Logs a definition; None takes it back."""
        self.append([{"op": "index", "key": name, "value": path}])

    def index_definitions(self) -> dict[str, str]:
        """The path of each index by its name; there are few."""
        newest = since_drop(self.read()).where("op = 'index'").groupBy("key").agg(F.max_by(F.struct("value"), "lsn").alias("e"))
        return {r["key"]: r["e"]["value"] for r in newest.collect() if r["e"]["value"] is not None}

    def drop(self) -> None:
        """Clears documents, index definitions and lifetime; a later put revives the collection."""
        if self._exists() and since_drop(self.read()).head(1):
            self.append([{"op": "drop"}])

    def set_ttl(self, ttl_secs: int | None) -> None:
        """None clears it."""
        if ttl_secs is not None and ttl_secs <= 0:
            raise Refused("ttl_secs is above 0")
        self.append([{"op": "ttl", "ttl_secs": ttl_secs}])

    def get_ttl(self) -> int | None:
        return ttl(self.read()).first()[0] if self._exists() else None

    def sweep(self, now_ms: int) -> int:
        """Logs a deletion of each document that is due, all in one append; how many."""
        if not self._exists():
            return 0
        first = self.head() + 1
        due = expired(self.read(), now_ms).select("key").repartitionByRange("key").sortWithinPartitions("key")
        fixed = {"term": self.term, "op": "del", "value": None, "ts": 0, "expire_at": None, "migration": False, "ttl_secs": None}
        rows = due.withColumn("lsn", F.monotonically_increasing_id() + first)
        rows.select(*(F.col(f.name) if f.name in ("lsn", "key") else F.lit(fixed[f.name]).cast(f.dataType).alias(f.name) for f in SCHEMA)).write.mode("append").parquet(self.path)
        return self.read().where((F.col("lsn") >= first) & (F.col("op") == "del")).count()

    def compacted(self, keep_after: int | None = None) -> DataFrame:
        """The live documents' puts, the settings and the entries after ``keep_after``: another log of the same state."""
        log = self.read()
        since = since_drop(log)
        # Of the newest entry of each key only its number is gathered; numbers are unique in a log.
        newest = since.where(F.col("op").isin(*_DOCUMENT)).groupBy("key").agg(F.max("lsn").alias("lsn")).select("lsn")
        kept = since.where("op = 'put'").join(newest, "lsn", "left_semi").unionByName(since.where("op IN ('ttl', 'index')"))
        if keep_after is not None:
            kept = kept.where(F.col("lsn") <= keep_after).unionByName(log.where(F.col("lsn") > keep_after))
        return kept.select(*SCHEMA.names).repartitionByRange("lsn").sortWithinPartitions("lsn")

    def compact(self, target: str | None = None, keep_after: int | None = None) -> None:
        """Writes the compacted log to another folder or, without one, in place of this one.

        In place, the new folder is written whole before the old one makes way; ``recover`` ends a swap that was cut short.
        The number of the last entry is kept by a barrier, so numbers are never given out twice.
        """
        if target is not None:
            return self.compacted(keep_after).write.parquet(target)
        if not self._exists():
            return None
        head = self.head()
        new, old = f"{self.path}.new", f"{self.path}.old"
        barrier = {"lsn": head, "term": self.term, "op": "barrier", "ts": 0, "migration": False}
        last = self.spark.range(1).select(*(F.lit(barrier.get(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMA))
        kept = self.compacted(keep_after)
        # The last entry may be among those that stay; then there is no need of a barrier.
        kept.unionByName(last.join(kept.select("lsn"), "lsn", "left_anti").select(*SCHEMA.names)).write.mode("overwrite").parquet(new)
        self._delete(old)
        self._rename(self.path, old)
        self._rename(new, self.path)
        self._delete(old)
        return None

    def recover(self) -> None:
        """After a writer that stopped in the middle of a swap: the old folder comes back if the new one isn't in its place."""
        old = f"{self.path}.old"
        if not self._exists() and self._exists(old):
            self._rename(old, self.path)
        self._delete(old)
        self._delete(f"{self.path}.new")

    def compact_if(self, share: float = 0.5, keep_after: int | None = None) -> bool:
        """Compacts in place if at least this share of the entries would go; whether it did."""
        total = self.read().count()
        if not total or total - self.compacted(keep_after).count() < share * total:
            return False
        self.compact(keep_after=keep_after)
        return True

    def export(self, target: str) -> int:
        """Writes the state at this moment to a folder: live documents with their versions and deadlines, and the
        settings. The number up to which it holds, at which a change feed takes over."""
        head = self.head()
        log = suffix(self.read(), 0, head)
        live = snapshot(log).withColumns({"op": F.lit("put"), "migration": F.lit(False), "ttl_secs": F.lit(None).cast("bigint")})
        live.select(*SCHEMA.names).unionByName(since_drop(log).where("op IN ('ttl', 'index')").select(*SCHEMA.names)).write.parquet(target)
        return head

    def restore(self, source: str) -> None:
        """Takes over an exported state, as it was; only into an empty log."""
        if self.head():
            raise PreconditionFailed("the log is not empty", None)
        self.spark.read.schema(SCHEMA).parquet(source).write.mode("append").parquet(self.path)
