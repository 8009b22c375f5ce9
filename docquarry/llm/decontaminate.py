"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words instead of bytes, numbered as the benchmark has them; a document's other words are -1. Test
strings of one length share a matcher of flat arrays: a shift table over hashed blocks of two words tells how
far the window may move on, a zero shift leads to the bucket of the window's last words, by a hash, and the
strings in that bucket are compared word by word.

A benchmark beyond ``BLOCK_BYTES`` of text is searched in blocks. Each is a pass of its own over the documents, which is
over and whose matcher is released before the next begins: it leaves the hits, by a digest of the text, so the
memory of a task is that of one block.

Defined cases: a null or wordless document has no words and is never contaminated; a benchmark item
without words gives no test string; an item whose id is null still marks words but is not listed; the
same item given twice counts once; repeated document rows each give a row; very long texts are searched
whole, their words are in memory at once; an empty benchmark finds
nothing; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint, small_batches

WINDOW = 13
#: Text bytes of benchmark items that one broadcast may hold; a larger benchmark is searched in blocks.
BLOCK_BYTES = 4 << 20
#: Entries of a shift table.
SHIFTS = 1 << 20

#: Upper case to lower case, and every byte outside words to a space; bytes from 0x80 on belong to words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A hash of each row of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class WuManber:
    """Search for the windows of ``length`` words that begin at ``starts`` in ``text`` (numbers of words)."""

    def __init__(self, length: int, text: np.ndarray, starts: np.ndarray):
        self.length, self.text = length, text
        self.block, self.tail = min(2, length), min(4, length)
        self.shift = np.full(SHIFTS, length - self.block + 1, np.uint8 if length < 256 else np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self._blocks(starts + end - self.block), self.shift.dtype.type(length - end))
        tails = _mixed([text[starts + length - k] for k in range(self.tail, 0, -1)])
        order = np.argsort(tails, kind="stable")
        self.tails, self.starts = tails[order], starts[order]

    def _blocks(self, at: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        text = self.text if text is None else text
        return (_mixed([text[at + k] for k in range(self.block)]) & np.uint64(SHIFTS - 1)).astype(np.int64)

    def find(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Start of each occurrence in a text, in order, with the starts of the benchmark's windows that it equals."""
        length, n = self.length, len(text)
        if n < length:
            return
        shifts = self.shift[self._blocks(np.arange(n - self.block + 1), text)].tolist()
        ends, end = [], length
        while end <= n:
            step = shifts[end - self.block]
            if not step:
                ends.append(end)
            end += step or 1
        if not ends:
            return
        at = np.array(ends)
        tails = _mixed([text[at - k] for k in range(self.tail, 0, -1)])
        low, high = np.searchsorted(self.tails, tails), np.searchsorted(self.tails, tails, "right")
        words = np.arange(length)
        for k in np.flatnonzero(low < high).tolist():
            bucket, start = self.starts[low[k] : high[k]], ends[k] - length
            same = bucket[(self.text[bucket[:, None] + words] == text[start : start + length]).all(axis=1)]
            if len(same):
                yield start, same


class Block:
    """The items of a block: their words as numbers, whose they are, and a matcher for each length of test strings."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items, numbers, sizes = [i for i, _ in items], [], []
        for _, data in items:
            found = words(data)
            sizes.append(len(found))
            numbers.append(np.fromiter((self.number.setdefault(w, len(self.number)) for w in found), np.int32, len(found)))
        text = np.concatenate([np.zeros(0, np.int32), *numbers])
        size = np.array(sizes, np.int64)
        self.begin = np.cumsum(size) - size
        self.matchers = []
        for length in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(np.minimum(size, window) == length)
            count = size[own] - length + 1
            # Every start of every item of this kind.
            starts = np.repeat(self.begin[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            self.matchers.append(WuManber(length, text, starts))

    def find(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the maximal runs of hit words, and the ids of the items that occur."""
        found = words(data)
        get = self.number.get
        text = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
        spans: list[tuple[int, int]] = []
        of: set[int] = set()
        for m in self.matchers:
            for start, same in m.find(text):
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], start + m.length))
                else:
                    spans.append((start, start + m.length))
                of.update((np.searchsorted(self.begin, same, "right") - 1).tolist())
        # Items without words begin where the next one does; the last of those that begin there has the words.
        return len(found), _merged(spans), {i for k in of if (i := self.items[k]) is not None}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words bigint, spans array<struct<start int, end int>>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Block]:
    """One block at a time; the last may be empty."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append((row["item"], bytes(row["data"])))
        size += len(held[-1][1])
        if size >= block_bytes:
            yield Block(held, window)
            held, size = [], 0
    yield Block(held, window)


def _pass(rows: DataFrame, sent, key: str) -> DataFrame:
    """``key``, ``n_words``, ``spans``, ``items`` of each row (columns ``key`` and ``data``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            counts, spans, items = [], [], []
            for data in batch.column("data"):
                n, found, ids = block.find(data.as_py())
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(ids))
            arrays = [batch.column(key), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n_words", "spans", "items"])

    return rows.mapInArrow(scan, f"{key} {rows.schema[key].dataType.simpleString()}, {_FOUND}")


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: its id, ``n_words``, ``spans`` (maximal runs of hit words, end exclusive) and
    ``items`` (ids as strings, in string order).

    A benchmark of one block takes no shuffle: documents stream past the broadcast matchers.
    """
    sc = docs.sparkSession.sparkContext
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    rows = small_batches(docs).select(F.col(id_col).alias("id"), data)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _pass(rows, sc.broadcast(block), "id").withColumnRenamed("id", id_col)
    keyed = small_batches(docs).select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), data)
    # Copies have the same hits; only texts with hits leave a row.
    hits = None
    while block is not None:
        sent = sc.broadcast(block)
        found = checkpoint(_pass(keyed.select("key", "data"), sent, "key").where("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
        block, following = following, next(blocks, None)
    empty = sc.broadcast(Block([], window))
    counted = rows.select("id", "data").withColumn("key", F.unhex(F.md5(F.col("data"))))
    # Here and below a row's key goes along as its first column.
    kind = rows.schema["id"].dataType.simpleString()
    sized = _pass(counted.select(F.struct("id", F.col("key").alias("of")).alias("key"), "data"), empty, "key").select("key.id", "key.of", "n_words")
    listed = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = sized.join(listed, F.col("of") == F.col("key"), "left").select("id", "n_words", "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in listed or ()])] for listed in batch.column("spans").to_pylist()]
            items = [x or [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return joined.mapInArrow(merge, f"id {kind}, {_FOUND}").withColumnRenamed("id", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **columns) -> DataFrame:
    """``find_benchmark`` with counts, the digest of the items, and the rule: contaminated if some word is
    hit and hit words are at least one in ``share``."""
    found = find_benchmark(docs, benchmark, **columns)
    id_col = columns.get("id_col", "doc_id")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
        .select(
            id_col,
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
            "contaminated",
            "spans",
            "items",
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("searched"))
    found = contamination(rows, benchmark, share=share, id_col="row", text_col="searched", **columns)
    return found.where("NOT contaminated").select("row.*")
