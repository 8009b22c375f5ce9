"""The engine: collections by name, and the requests that they answer.

Every request is parsed whole, in a fixed order, before any data is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import NotFound, Refused
from docquarry.operators import aggregating, indexing, paging
from docquarry.operators.filtering import compile_filter
from docquarry.operators.indexing import Indexes
from docquarry.operators.projecting import project_json
from docquarry.plans import requests
from docquarry.plans.filters import parse_filter
from docquarry.sources import log as logs
from docquarry.sources.tables import Documents, prepare
from docquarry.streaming import changes as feed


@dataclass
class Collection:
    name: str
    source: Documents | logs.Log
    indexes: Indexes = field(default_factory=Indexes)
    #: Where the postings of a registered table's indexes are written.
    folder: str | None = None

    @property
    def documents(self) -> Documents:
        return self.source if isinstance(self.source, Documents) else logs.documents(self.source.read())

    def query(
        self,
        *,
        filter: str | dict | None = None,
        sort: str | None = None,
        fields: str | None = None,
        start: str | None = None,
        end: str | None = None,
        limit: int | None = None,
        cursor: str | None = None,
        max_docs: int | None = None,
        keys: str | bool | None = None,
        read: str | None = None,
        whole: bool = False,
    ) -> paging.Page:
        """``whole``: a page of all documents, however many there are, as ``find`` gives; nothing is refused or cut for their number."""
        if whole and max_docs is not None:
            raise Refused("whole takes no max_docs")
        budget = None if whole else requests.bounded(max_docs, "max_docs", requests.DEFAULT_BUDGET, requests.MAX_BUDGET)
        limit = requests.bounded(limit, "limit", requests.DEFAULT_LIMIT, requests.MAX_LIMIT)
        order, listed, parsed = requests.parse_sort(sort), requests.parse_fields(fields), parse_filter(filter)
        requests.check_read(read)
        requests.check_range(start, end)
        mode = requests.parse_keys(keys)
        docs = self.documents
        if order is not None:
            position = requests.sort_position(cursor, order)
            df = paging.key_range(docs.df, start, end)
            return paging.sorted_page(df, docs.root, parsed, order, position, limit, budget, listed, mode)
        df = paging.key_range(docs.df, start, end, requests.key_position(cursor))
        return paging.unsorted_page(df, docs.root, parsed, limit, budget, listed, mode)

    def find(self, *, filter: str | dict | None = None, sort: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        """The matching rows as a DataFrame, lazily and without a budget: the whole result unless limited."""
        order, parsed = requests.parse_sort(sort), parse_filter(filter)
        requests.check_range(start, end)
        docs = self.documents
        df = paging.key_range(docs.df, start, end)
        df = df.where(compile_filter(parsed, docs.root)) if parsed is not None else df
        if order is not None:
            return paging.ordered(df, docs.root, order, limit, docs.key_order())
        return df if limit is None else df.orderBy(*docs.key_order()).limit(limit)

    @property
    def postings(self) -> indexing.Postings:
        """Where the written postings are: beside the log, or in the folder that was given."""
        folder = self.folder if isinstance(self.source, Documents) else f"{self.source.path}.indexes"
        if folder is None:
            raise NotFound(f"collection {self.name!r} has no folder for indexes")
        return indexing.Postings(self._spark, folder)

    @property
    def _spark(self) -> SparkSession:
        return self.source.df.sparkSession if isinstance(self.source, Documents) else self.source.spark

    def create_index(self, name: str, path: str) -> bool:
        """Defines an index and writes its postings; whether it is new. A log keeps the definition."""
        self._load()
        new = self.indexes.create(name, path)
        if new and isinstance(self.source, logs.Log):
            self.source.define_index(name, path)
        self.refresh_index(name)
        return new

    def drop_index(self, name: str) -> None:
        self._load()
        self.indexes.drop(name)
        self.postings.drop(name)
        if isinstance(self.source, logs.Log):
            self.source.define_index(name, None)

    def refresh_index(self, name: str) -> None:
        """Brings the postings to the state of the collection; registered tables are taken as they were at first."""
        path, docs = self.indexes.paths[name], self.documents
        if isinstance(self.source, logs.Log):
            self.postings.refresh(name, self.source.read(), self.source.head(), docs.root, path)
        elif self.postings.version(name) is None:
            self.postings.write(name, indexing.postings(docs.df, docs.root, path), 0)

    def _load(self) -> None:
        if isinstance(self.source, logs.Log):
            self.indexes.paths = self.source.index_definitions()

    def find_by_index(self, filter: str | dict) -> DataFrame:
        """``find`` through the postings of the index that ``explain_index`` names, by a join on the key; a plain scan
        where none applies. The filter is applied again, so both give the same rows."""
        chosen = self.explain_index(filter)
        if chosen is None:
            return self.find(filter=filter)
        docs = self.documents
        keys = indexing.candidates(self.postings.read(chosen["index"]), chosen["probe"], docs.root.at(self.indexes.paths[chosen["index"]]))
        rows = docs.df.join(keys, "key", "left_semi")
        if isinstance(self.source, logs.Log):
            # Only the entries of the candidates are folded.
            log = self.source.read()
            rows = logs.documents(log.join(keys, "key", "left_semi").unionByName(log.where("op = 'drop'"))).df
        return rows.where(compile_filter(parse_filter(filter), docs.root))

    def drop(self) -> None:
        """Clears documents, lifetime and indexes; a later put revives the collection."""
        if not isinstance(self.source, logs.Log):
            raise NotFound(f"collection {self.name!r} has no log")
        self._load()
        for name in self.indexes.paths:
            self.postings.drop(name)
        self.source.drop()
        self.indexes.paths.clear()

    def project(self, rows: DataFrame, fields: str | None) -> DataFrame:
        """``key`` and ``item``, the projected document as JSON text."""
        return rows.select("key", project_json(self.documents.root, requests.parse_fields(fields)).alias("item"))

    def aggregate(self, *, group: str | None = None, metrics: str | None = None, filter: str | dict | None = None, start: str | None = None, end: str | None = None, max_docs: int | None = None, partial: bool = False, read: str | None = None) -> aggregating.Aggregate:
        budget = requests.bounded(max_docs, "max_docs", requests.DEFAULT_BUDGET, requests.MAX_BUDGET)
        parsed, by, wanted = parse_filter(filter), requests.parse_group(group), requests.parse_metrics(metrics)
        requests.check_read(read)
        requests.check_range(start, end)
        docs = self.documents
        return aggregating.aggregate_page(paging.key_range(docs.df, start, end), docs.root, parsed, by, wanted, budget, partial)

    def totals(self, *, group: str | None = None, metrics: str | None = None, filter: str | dict | None = None, budget: int | None = None, scale: int | None = None, names: dict[str, str] | None = None) -> DataFrame:
        """``aggregate`` as a DataFrame, lazily and over all documents."""
        parsed, by, wanted = parse_filter(filter), requests.parse_group(group), requests.parse_metrics(metrics)
        docs = self.documents
        return aggregating.aggregate(docs.df, docs.root, parsed, by, wanted, budget=budget, scale=scale, names=names)

    def get(self, key: str) -> tuple[Any, str | None]:
        """The document and, from a log, its version."""
        if isinstance(self.source, logs.Log):
            return self.source.get(key)
        page = self.query(start=key, end=key, limit=1)
        if not page.items:
            raise NotFound(f"there is no document {key!r}")
        return page.items[0], None

    def changes(self, *, after: int | None = None, ops: str | None = None, filter: str | dict | None = None, floor: int = 0) -> DataFrame:
        kinds, parsed = requests.parse_change_ops(ops), parse_filter(filter)
        if not isinstance(self.source, logs.Log):
            raise NotFound(f"collection {self.name!r} has no log")
        found = feed.resume(feed.classify(self.source.read()), after, self.source.head(), floor)
        return feed.admitted(found, kinds, parsed)

    def index_status(self) -> list[dict[str, Any]]:
        """Of each index, from its postings; ``stale`` ones wait for entries of the log to be filed."""
        self._load()
        head = self.source.head() if isinstance(self.source, logs.Log) else 0
        out = []
        for d in self.indexes.list():
            version = self.postings.version(d["name"])
            if version is None:
                out.append(d | {"state": "building", "documents": 0, "values": 0})
                continue
            n = indexing.counted(self.postings.read(d["name"])).first()
            out.append(d | {"state": "ready" if version == head else "stale", "documents": n["documents"], "values": n["values"]})
        return out

    def explain_index(self, filter: str | dict) -> dict[str, Any] | None:
        """Which index would answer, and from where to where it is read; None for a scan. Postings are brought up to date before."""
        self._load()
        parsed = parse_filter(filter)
        root = self.documents.root
        by_path = {path: name for name, path in sorted(self.indexes.paths.items(), reverse=True)}

        def count(path: str, p: indexing.Probe) -> int:
            self.refresh_index(by_path[path])
            return indexing.candidates(self.postings.read(by_path[path]), p, root.at(path)).count()

        # The total matters for large candidate sets only.
        chosen = indexing.choose(self.indexes, parsed, count, lambda: self.documents.df.count())
        return None if chosen is None else {"index": chosen[0], "probe": chosen[1]}


class Engine:
    """Collections under names. A read never creates one: an unknown name raises."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = prepare(spark), root
        self._collections: dict[str, Collection] = {}

    def register(self, name: str, source: Documents | logs.Log) -> Collection:
        self._collections[requests.check_name(name)] = Collection(name, source, folder=self.root and f"{self.root}/{name}.indexes")
        return self._collections[name]

    def create(self, name: str) -> Collection:
        """A collection with a log of its own under the engine's folder; its first write makes it exist."""
        requests.check_name(name)
        return self._collections.get(name) or self.register(name, logs.Log(self.spark, f"{self.root}/{name}"))

    def collection(self, name: str) -> Collection:
        if requests.check_name(name) not in self._collections:
            raise NotFound(f"there is no collection {name!r}")
        return self._collections[name]

    def collections(self) -> list[str]:
        """In order; dropped ones are not listed."""

        def live(c: Collection) -> bool:
            if isinstance(c.source, Documents):
                return True
            last = c.source.read().where(F.col("op").isin("put", "del", "drop")).agg(F.max_by("op", "lsn")).first()[0] if c.source._exists() else None
            return last not in (None, "drop")

        return sorted(n for n, c in self._collections.items() if live(c))
