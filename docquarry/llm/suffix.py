"""Substrings of 200 bytes that occur more than once, by suffix sorting with a difference cover.

Sorting every suffix of a corpus would move many times its size, so positions are first dealt out by
content. Each window of ``LENGTH`` bytes has an anchor: the piece of ``PIECE`` bytes inside it with the
least hash, the leftmost of equals. Equal windows have equal anchors at equal places, so a window whose
anchor piece occurs once in the corpus is unique. Consecutive windows with one anchor form a context.
Contexts that occur whole more than once are repeated in all their windows. What is left, the distinct
contexts of an anchor piece that has several, is brought together by that piece and suffix-sorted there:

- positions that are not a multiple of three are the sample; they are sorted by triples of symbols,
- the triples' names make a string of two thirds the length, which is sorted the same way (DC3),
- the remaining suffixes are sorted by a symbol and the rank that follows, and merged with the sample,
- neighbours in that order are compared over ``LENGTH`` bytes.

Windows equal to a neighbour are repeated. Hashes of pieces only deal out; whole contexts are equated by a
128-bit digest, and only those of one anchor piece with the same extents. Equal contexts of a batch are one row
before the shuffle, so a passage that is everywhere is a row from each batch.

An anchor piece with more than ``CROWD`` distinct contexts is dealt out further, by the bytes that all
windows in a narrow range of places share, so no task gets all of a common passage. The contexts of pieces with more than
``LARGE`` are more than a task should hold: they are sorted over all tasks, by the same algorithm (``difference_cover``).

Defined cases: null and empty texts, and texts shorter than ``LENGTH``, have nothing removed; a document
may repeat itself, also with overlap; rows that agree in id and text are copies of each other; an empty
table gives no rows. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import difference_cover
from docquarry.llm.common import checkpoint, small_batches
from docquarry.llm.difference_cover import suffix_array

LENGTH = 200
PIECE = 32
#: Distinct contexts of an anchor piece from which they are dealt out further, and the width of the ranges then.
CROWD, RANGE = 2048, 85
#: Distinct contexts of an anchor piece from which they are sorted over all tasks.
LARGE = 1 << 16
#: Bytes of a text whose anchors are looked for at a time, and bytes that are suffix-sorted at a time.
SLICE, BATCH = 1 << 20, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchor of every window of a text."""

    def __init__(self, length: int = LENGTH, piece: int = PIECE):
        self.length, self.piece, self.width = length, piece, length - piece + 1
        self.up, self.down = _powers(_BASE, SLICE + length), _powers(_INVERSE, SLICE + length)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of the piece at each place, from differences of a running sum."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        h = (sums[self.piece :] - sums[: n + 1 - self.piece]) * self.up[: n + 1 - self.piece]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def contexts(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each context: hash and place of its anchor, first and last start of its windows."""
        parts = []
        for at in range(0, max(0, len(data) - self.length + 1), SLICE):
            some = np.frombuffer(data, np.uint8, min(SLICE + self.length - 1, len(data) - at), at)
            h = self.hashes(some)
            least = _sliding_least((h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64), self.width)
            anchor = (least & np.uint64(0x1FFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            last = np.append(first[1:], len(anchor)) - 1
            parts.append((h[anchor[first]].view(np.int64), anchor[first] + at, first + at, last + at))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values: of the end of one block and the start of the next."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def repeated_windows(data: np.ndarray, valid: np.ndarray, more: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the ``valid`` starts have a window that another valid start has too, or that counts as several (``more``).

    ``data``: the contexts, each followed by a separator (0); windows hold no separator.
    """
    order = suffix_array(data.astype(np.int32) + 1)
    order = order[valid[order]]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view("<u8").ravel()  # the eight bytes from each place
    same = np.ones(max(0, len(order) - 1), bool)
    left = np.arange(len(same))
    for k in [*range(0, length - 7, 8), length - 8]:
        equal = words[order[left] + k] == words[order[left + 1] + k]
        same[left[~equal]] = False
        left = left[equal]
    out = np.zeros(len(data), bool)
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    n = np.bincount(group, 1 + more[order])
    out[order] = n[group] > 1
    return out


#: ``place`` has the first start, and 16 bits each for how far from it the anchor and the last start are. ``n``: how many
#: rows stand for, at most 2, or 0 if a row is decided: its context occurs whole elsewhere too. ``deal``: where it is dealt.
_CONTEXT = "id {id}, h bigint, deal bigint, piece bigint, place bigint, digest bigint, more_digest bigint, n int"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("data"))


def contexts(rows: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """A row per context. Of those that are equal in a batch one stands for all; the others are decided and dealt anywhere."""
    if length > 1 << 16:
        raise ValueError("windows are of 65536 bytes at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, piece)
        for batch in batches:
            of, found, digests = [np.zeros(0, np.int64)], [], []
            for i, data in enumerate(batch.column("data")):
                text = data.as_py()
                got = anchors.contexts(text)
                of.append(np.full(len(got[0]), i))
                found.append(got)
                digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(got[2].tolist(), (got[3] + length).tolist(), strict=True)]
            if not digests:
                continue
            row = np.concatenate(of)
            key, anchor, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            extents = (anchor - first) << 16 | (last - first)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            n, deal = np.ones(len(row), np.int32), key.copy()
            order = np.lexsort((extents, key, halves[:, 1], halves[:, 0]))
            same = (np.diff(halves[order, 0]) == 0) & (np.diff(halves[order, 1]) == 0) & (np.diff(key[order]) == 0) & (np.diff(extents[order]) == 0)
            # The sort is stable: the first of equals comes first.
            later, earlier = order[1:][same], order[:-1][same]
            n[earlier] = 2
            n[later] = 0
            deal[later] = (row[later] * 0x9E3779B97F4A7C1 + first[later] * 0x5851F42D4C957F2D) ^ key[later]
            at = pa.array(row)
            columns = (deal, key, first << 32 | extents, halves[:, 0].copy(), halves[:, 1].copy(), n)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("h").take(at), *map(pa.array, columns)], ["id", "h", "deal", "piece", "place", "digest", "more_digest", "n"])

    return rows.mapInArrow(run, _CONTEXT.format(id=rows.schema["id"].dataType.simpleString()))


def _dealt(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The asked contexts with their bytes: ``bucket, id, h, first, more, data``; in a crowd, narrow parts of them."""
    grouped = asked.groupBy(F.col("id").alias("i"), F.col("h").alias("k")).agg(F.collect_list(F.struct("piece", "anchor", "first", "last", "more", "crowd")).alias("asked"))
    joined = rows.join(grouped, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("id", "h", "data", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                of, out = [], []
                for i, (data, listed) in enumerate(zip(some.column("data"), some.column("asked"), strict=True)):
                    text = data.as_py()
                    for c in listed.as_py():
                        parts = [(c["first"], c["last"], c["piece"])]
                        if c["crowd"]:
                            parts = []
                            # Places in relation to the anchor, so that copies are cut alike.
                            for offset in range(0, c["anchor"] - c["first"] + 1, RANGE):
                                last, first = c["anchor"] - offset, max(c["first"], c["anchor"] - offset - RANGE + 1)
                                last = min(last, c["last"])
                                if first <= last:
                                    low, high = c["anchor"] - offset, c["anchor"] - offset - RANGE + 1 + length
                                    parts.append((first, last, xxhash.xxh64_intdigest(text[low:max(low, high)], seed=c["piece"] & 0xFFFFFFFF)))
                        for first, last, bucket in parts:
                            of.append(i)
                            out.append((np.uint64(bucket & ((1 << 64) - 1)).astype(np.int64), first, c["more"], text[first : last + length]))
                at = pa.array(of, pa.int64())
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), some.column("id").take(at), some.column("h").take(at), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.binary())],
                    ["bucket", "id", "h", "first", "more", "data"],
                )

    return joined.mapInArrow(run, f"bucket bigint, id {rows.schema['id'].dataType.simpleString()}, h bigint, first int, more boolean, data binary")


def _sorted_spans(dealt: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows: ``id, h, first, last``. A bucket's rows are in one task; several buckets are sorted at once."""
    schema = f"id {dealt.schema['id'].dataType.simpleString()}, h bigint, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, bucket = 0, None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [d.as_py() for d in table.column("data")]
            lengths = np.array([len(t) for t in texts])
            data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
            begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            of = np.repeat(np.arange(len(texts)), lengths + 1)
            valid = np.arange(len(data)) - begin[of] <= (lengths - length)[of]
            more = table.column("more").to_numpy()[of].astype(np.int64)
            # A window that stands under one bucket only is compared with windows of others too; that can't make it equal.
            found = repeated_windows(data, valid, more, length)
            edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            at, offset = pa.array(of[first]), table.column("first").to_numpy()[of[first]] - begin[of[first]]
            ids, hs = (table.column(c).combine_chunks().take(at) for c in ("id", "h"))
            arrays = [ids, hs, pa.array((first + offset).astype(np.int32)), pa.array((last + offset).astype(np.int32))]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], ["id", "h", "first", "last"])

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            sizes = pa.compute.binary_length(batch.column("data")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if buckets[i] != bucket and size >= BATCH:
                    yield close()
                    held, size = [], 0
                bucket = buckets[i]
                held.append(batch.slice(i, j - i))
                size += int(sizes[i:j].sum())
        if held:
            yield close()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _spread_spans(dealt: DataFrame, length: int) -> DataFrame:
    """``_sorted_spans`` for contexts that no task could hold: single windows, from the order of all suffixes."""
    numbered = checkpoint(dealt.select("id", "h", "first", "data", F.monotonically_increasing_id().alias("string")))
    repeated = difference_cover.repeated_windows(numbered, length)
    starts = repeated.join(numbered.drop("data"), "string").select("id", "h", (F.col("first") + F.col("start")).cast("int").alias("first"))
    return starts.withColumn("last", F.col("first"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, piece: int = PIECE, crowd: int = CROWD, large: int = LARGE) -> DataFrame:
    """``id, h, first, last``: runs of starts whose windows of ``length`` bytes occur elsewhere too."""
    rows = _rows(docs, id_col, text_col)
    found = contexts(rows, length, piece).repartition("deal")
    extents = F.col("place").bitwiseAND(0xFFFFFFFF)
    equal = ("deal", "piece", "digest", "more_digest", extents)
    same, group = Window.partitionBy(*equal), Window.partitionBy("deal", "piece")
    order = F.row_number().over(same.orderBy(F.col("n") == 0, "id", "h", "place"))
    counted = found.withColumn("times", F.sum("n").over(same)).withColumn("order", order)
    counted = counted.withColumn("distinct", F.sum(F.when((F.col("order") == 1) & (F.col("n") > 0), 1).otherwise(0)).over(group))
    first = F.shiftrightunsigned("place", 32).cast("int")
    anchor = (first + F.shiftrightunsigned("place", 16).bitwiseAND(0xFFFF)).cast("int")
    judged = checkpoint(
        counted.where("n = 0 OR times > 1 OR distinct > 1").select(
            "id", "h", "piece", first.alias("first"), anchor.alias("anchor"), (first + F.col("place").bitwiseAND(0xFFFF)).cast("int").alias("last"),
            ((F.col("n") == 0) | (F.col("times") > 1)).alias("more"), ((F.col("n") > 0) & (F.col("order") == 1) & (F.col("distinct") > 1)).alias("asked"), (F.col("distinct") > crowd).alias("crowd"), (F.col("distinct") > large).alias("large"),
        )
    )
    whole = judged.where("more").select("id", "h", "first", "last")
    asked = judged.where("asked")
    found = whole.unionByName(_sorted_spans(_dealt(rows, asked.where("NOT large"), length), length))
    spread = asked.where("large")
    return found.unionByName(_spread_spans(_dealt(rows, spread.withColumn("crowd", F.lit(False)), length), length)) if spread.head(1) else found


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, piece: int = PIECE, crowd: int = CROWD, large: int = LARGE) -> DataFrame:
    """A row per row: its id, ``n_bytes``, ``removed`` (maximal runs of bytes, ``start``, ``stop``) and ``kept``, the bytes that stay."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, piece=piece, crowd=crowd, large=large)
    listed = spans.groupBy(F.col("id").alias("i"), F.col("h").alias("k")).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    rows = _rows(docs, id_col, text_col)
    joined = rows.join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left").select("id", "data", "spans")
    removed = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for data, found in zip(batch.column("data"), batch.column("spans"), strict=True):
                text, runs, out, at = data.as_py(), [], [], 0
                for s in found.as_py() or ():
                    if runs and s["first"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], s["last"] + length)
                    else:
                        runs.append({"start": s["first"], "stop": s["last"] + length})
                for r in runs:
                    out.append(text[at : r["start"]])
                    at = r["stop"]
                sizes.append(len(text))
                gone.append(runs)
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, removed), pa.array(kept, pa.binary())], [id_col, "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` {joined.schema['id'].dataType.simpleString()}, n_bytes bigint, removed array<struct<start:int,stop:int>>, kept binary")
