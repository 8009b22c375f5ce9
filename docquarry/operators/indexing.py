"""Secondary indexes: definitions, what they would answer, and their tables.

A definition says what is filed. Its postings are written as a table in the order of the values, so that the bounds of a
probe reach the Parquet scan and most of it is passed over. A table stands in a folder that is named by the
log number that it holds for; a refresh takes over the postings of the keys that have not changed since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import Conflict, NotFound
from docquarry.functions.kinds import KINDS
from docquarry.operators.paging import keyed
from docquarry.operators.values import Value
from docquarry.plans.filters import Branch, Condition, conjuncts
from docquarry.plans.requests import MAX_INDEXES, check_index
from docquarry.sources.log import documents, suffix

#: An index is used for this many candidates, beyond that only for at most half of the documents.
ALWAYS, SHARE = 64, 2


@dataclass
class Indexes:
    """Definitions by name."""

    paths: dict[str, str] = field(default_factory=dict)

    def create(self, name: str, path: str) -> bool:
        """Whether it is new; the same definition again changes nothing."""
        check_index(name, path)
        if name in self.paths:
            if self.paths[name] != path:
                raise Conflict(f"index {name!r} is on {self.paths[name]!r}")
            return False
        if len(self.paths) >= MAX_INDEXES:
            raise Conflict(f"a collection has at most {MAX_INDEXES} indexes")
        self.paths[name] = path
        return True

    def drop(self, name: str) -> None:
        if name not in self.paths:
            raise NotFound(f"there is no index {name!r}")
        del self.paths[name]

    def list(self) -> list[dict[str, str]]:
        return [{"name": n, "field": p} for n, p in sorted(self.paths.items())]


def postings(df: DataFrame, root: Value, path: str) -> DataFrame:
    """``value`` (sort key), ``key`` for each document that has the path; an explicit null is filed."""
    rows, (name,) = keyed(df.where(root.at(path).exists()), root, [path])
    return rows.select(F.col(name).alias("value"), "key")


def status(df: DataFrame, root: Value, path: str) -> DataFrame:
    """``documents`` that are filed and ``values`` that are distinct."""
    return counted(postings(df, root, path))


def counted(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("documents"), F.countDistinct("value").alias("values"))


@dataclass(frozen=True)
class Probe:
    """The stretch of the value order to read: points, or bounds within one kind."""

    points: tuple[Any, ...] = ()
    kind: str | None = None
    low: Any = None
    low_open: bool = False
    high: Any = None
    high_open: bool = False


def successor(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``; None if there is none."""
    for n in range(len(prefix), 0, -1):
        code = ord(prefix[n - 1]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code <= 0x10FFFF:
            return prefix[: n - 1] + chr(code)
    return None


def probe(condition: Condition) -> Probe | None:
    """The narrowest stretch that holds every match, None if the condition names none."""
    ops = {op.name: op.operand for op in condition.ops}
    if "$eq" in ops:
        return Probe(points=(ops["$eq"],))
    if "$in" in ops:
        return Probe(points=tuple(ops["$in"]))
    low = next((n for n in ops if n in ("$gt", "$gte")), None)
    high = next((n for n in ops if n in ("$lt", "$lte")), None)
    if low or high:
        bound = ops[low or high]
        return Probe(kind="string" if isinstance(bound, str) else "number", low=ops.get(low), low_open=low == "$gt", high=ops.get(high), high_open=high == "$lt")
    if "$prefix" in ops:
        return Probe(kind="string", low=ops["$prefix"], high=successor(ops["$prefix"]), high_open=True)
    if len(ops.get("$type", ())) == 1:
        return Probe(kind=ops["$type"][0])
    return Probe(kind="any") if ops.get("$exists") else None


def candidates(table: DataFrame, p: Probe, path_value: Value) -> DataFrame:
    """Keys in a postings table that the probe leads to; a superset of the matches, which the filter is applied to again.

    ``path_value`` is the value as it stands in the table, to build bounds that compare with its sort keys.
    """
    tests = [path_value.compare_key(x, "==") for x in p.points]
    if p.points:
        wanted = tests[0]
        for t in tests[1:]:
            wanted = wanted | t
        return table.where(wanted).select("key")
    if p.kind not in (None, "any"):
        table = table.where(path_value.key_kind(p.kind))
    if p.low is not None:
        table = table.where(path_value.compare_key(p.low, ">" if p.low_open else ">="))
    if p.high is not None:
        table = table.where(path_value.compare_key(p.high, "<" if p.high_open else "<="))
    return table.select("key")


class Postings:
    """The written postings of a collection's indexes, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, *parts: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> int | None:
        """The log number that the newest whole table of an index holds for."""
        where, system = self._at(name)
        found = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        whole = [int(v) for v in found if system.exists(self._at(name, v, "_SUCCESS")[0])]
        return max(whole, default=None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.version(name)}")

    def write(self, name: str, table: DataFrame, version: int) -> None:
        before = self.version(name)
        table.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}")
        if before is not None and before != version:
            where, system = self._at(name, str(before))
            system.delete(where, True)

    def drop(self, name: str) -> None:
        where, system = self._at(name)
        system.delete(where, True)

    def refresh(self, name: str, log: DataFrame, head: int, root: Value, path: str) -> None:
        """Brings a table to the state of a log: written anew at first and after a drop, else only changed keys are filed again."""
        held = self.version(name)
        if held == head:
            return
        newer = None if held is None else suffix(log, held)
        if newer is None or newer.where("op = 'drop'").head(1):
            self.write(name, postings(documents(log).df, root, path), head)
            return
        changed = newer.where(F.col("op").isin("put", "del")).select("key").distinct()
        current = documents(log.join(changed, "key", "left_semi").unionByName(log.where("op = 'drop'"))).df
        kept = self.read(name).join(changed, "key", "left_anti").select("value", "key")
        self.write(name, kept.unionByName(postings(current, root, path)), head)


def choose(indexes: Indexes, filter: Branch | None, count: Callable[[str, Probe], int], total: Callable[[], int]) -> tuple[str, Probe] | None:
    """The index with the fewest candidates: ``count(path, probe)`` tells them. Ties go to the first path, then name.

    None if no index applies, or the best still reads more than half of all documents, whose number ``total`` tells.
    """
    best = None
    for at in sorted(conjuncts(filter), key=lambda a: a.path) if filter is not None else ():
        p = probe(at.condition)
        for name, path in sorted(indexes.paths.items()):
            if p is not None and path == at.path:
                n = count(path, p)
                if best is None or n < best[0]:
                    best = n, name, p
    if best is None or best[0] > ALWAYS and best[0] * SHARE > total():
        return None
    return best[1], best[2]
