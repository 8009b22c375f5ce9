"""Suffix sorting over many tasks, with the difference cover modulo three.

The strings are short arrays of symbols above 0, one of a row. One level of the recursion:

- the suffixes at places that are not a multiple of three are the sample; their triples of symbols are sorted over all
  tasks and named by their order,
- if no name occurs twice they are the sample's order; else the names of a string, those of places 1, 4, 7 and so on
  before those of 2, 5, 8, make a string of the next level, whose suffixes are sorted the same way,
- the other suffixes are merged with either half of the sample: a sort by a symbol and the rank of what follows tells how
  many of the first half lie below each, one by two symbols and a rank how many of the second.

Sorted frames are range-partitioned; places in them are counted from the sizes of the partitions, and only these numbers
reach the driver. Up to ``LOCAL`` symbols are sorted in one task, which ends the recursion. Each result is cut off by a
checkpoint, so lost executors cost one step.

Defined cases: suffixes of different strings that are equal up to the end get ranks one after the other, in the order of the strings; empty
strings have no suffixes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint

#: Symbols that one task sorts.
LOCAL = 1 << 20
_ROW = (1 << 33) - 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, in one task (DC3). Symbols are integers above 0; the end sorts first."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols, np.zeros(3, symbols.dtype)]).astype(np.int32)
    # A sample at the end stands for the empty suffix, so that the first half of the names ends with the least.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
    a = sample[order]
    new = np.ones(len(a), bool)
    new[1:] = (s[a[1:]] != s[a[:-1]]) | (s[a[1:] + 1] != s[a[:-1] + 1]) | (s[a[1:] + 2] != s[a[:-1] + 2])
    names = np.empty(len(a), np.int32)
    names[order] = np.cumsum(new)
    if names.max() < len(names):
        order = suffix_array(names)
        a = sample[order]
    rank = np.zeros(n + 3, np.int32)
    rank[a] = np.arange(1, len(a) + 1)
    a = a[a < n]
    # The remaining suffixes by their first symbol and the rank of what follows.
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], s[rest]))]
    # Each is merged before the first larger sample suffix: of places 1 mod 3 by one symbol and a rank, of 2 mod 3 by two.
    width = np.int64(len(rank) + 1)
    top = np.int64(s.max() + 1)
    if int(top) * int(top) * int(width) < 1 << 62:
        one, two = a[a % 3 == 1], a[a % 3 == 2]
        key = lambda i: s[i].astype(np.int64) * width + rank[i + 1]
        below = np.searchsorted(key(one), key(rest))
        key = lambda i: (s[i].astype(np.int64) * top + s[i + 1]) * width + rank[i + 2]
        below = below + np.searchsorted(key(two), key(rest))
    else:
        below = _merged_below(s, rank, rest, a)
    out = np.empty(n, np.int64)
    at = below + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = a
    return out


def _merged_below(s: np.ndarray, rank: np.ndarray, rest: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many sample suffixes lie below each of the remaining, where keys don't fit a word."""
    below = np.zeros(len(rest), np.int64)
    for residue in (1, 2):
        own = sample[sample % 3 == residue]
        both = np.concatenate([rest, own])
        last = rank[both + residue]
        keys = (last, s[both]) if residue == 1 else (last, s[both + 1], s[both])
        order = np.lexsort(keys)
        is_own = order >= len(rest)
        smaller = np.cumsum(is_own)
        place = np.empty(len(both), np.int64)
        place[order] = smaller
        below += place[: len(rest)]
    return below


def _batch(columns: list[np.ndarray], names: list[str], kinds: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, (kinds or {}).get(n)) for c, n in zip(columns, names, strict=True)], names)


def _arrays(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    for x in batch.column(name):
        yield x.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _sample(n: int) -> np.ndarray:
    """Places 1, 4, 7 and so on, then 2, 5, 8; with the empty suffix if the first half would not end with the least name."""
    return np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])


def _joined(rows: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in range(width)]


def _triples(strings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for string, s in zip(batch.column("string").to_pylist(), _arrays(batch, "symbols"), strict=True):
                padded, at = np.concatenate([s, np.zeros(3, np.int64)]), _sample(len(s))
                rows.append([np.full(len(at), string), np.arange(len(at)), padded[at], padded[at + 1], padded[at + 2]])
            yield _batch(_joined(rows, 5), ["string", "place", "a", "b", "c"])

    return strings.mapInArrow(run, "string bigint, place bigint, a bigint, b bigint, c bigint")


def in_order(df: DataFrame, *by: str) -> tuple[DataFrame, np.ndarray]:
    """The rows sorted over all tasks, with ``at`` (their partition and place in it), and the rows before each partition."""
    rows = checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftrightunsigned("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()
    before = np.zeros(max((r["p"] for r in sizes), default=0) + 2, np.int64)
    for r in sizes:
        before[r["p"] + 1] = r["n"]
    return rows, np.cumsum(before)


def _gathered(rows: DataFrame) -> DataFrame:
    """``string``, ``values``: the sum of the values at each place, in the order of the places."""
    listed = rows.groupBy("string").agg(F.collect_list(F.struct("place", "value")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("x"):
                place, value = (x.values.field(k).to_numpy() for k in (0, 1))
                values = np.zeros(place.max() + 1, np.int64)
                np.add.at(values, place, value)
                out.append(values)
            yield pa.RecordBatch.from_arrays([batch.column("string"), pa.array(out, pa.list_(pa.int64()))], ["string", "values"])

    return listed.mapInArrow(run, "string bigint, values array<bigint>")


def _merge_keys(both: DataFrame, half: int, empty: int) -> DataFrame:
    """The suffixes of places 0 mod 3 and of one half of the sample with what they are compared by; ``own`` is a sample's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for string, s, ranks in zip(batch.column("string").to_pylist(), _arrays(batch, "symbols"), _arrays(batch, "values"), strict=True):
                n = len(s)
                padded, rank = np.concatenate([s, np.zeros(3, np.int64)]), np.zeros(n + 4, np.int64)
                # Above all empty suffixes, which stand before the others in the sample; what is beyond the end has 0.
                rank[_sample(n)] = ranks - empty + 1
                at = np.concatenate([np.arange(0, n, 3), np.arange(half, n, 3)])
                second = padded[at + 1] if half == 2 else np.zeros(len(at), np.int64)
                rows.append([np.full(len(at), string), at, padded[at], second, np.maximum(rank[at + half], 0), (at % 3 != 0).astype(np.int64), rank[at] - 1])
            yield _batch(_joined(rows, 7), ["string", "place", "first", "second", "following", "sampled", "own"])

    return both.mapInArrow(run, "string bigint, place bigint, first bigint, second bigint, following bigint, sampled bigint, own bigint")


def _shares(rows: DataFrame, before: np.ndarray, before_rest: np.ndarray, half: int) -> DataFrame:
    """What a merge adds to the rank of a suffix: of those of the sample below a rest suffix, or of the rest below a sampled one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_before = None
        for batch in batches:
            at, sampled, own = (batch.column(c).to_numpy() for c in ("at", "sampled", "own"))
            if not len(at):
                continue
            p = int(at[0]) >> 33
            rest_before = int(before_rest[p]) if rest_before is None else rest_before
            rests = rest_before + np.cumsum(sampled == 0) - (sampled == 0)
            rest_before += int((sampled == 0).sum())
            index = before[p] + (at & _ROW)
            value = np.where(sampled == 1, own + rests, index if half == 1 else index - rests)
            yield pa.RecordBatch.from_arrays([batch.column("string"), batch.column("place"), pa.array(value)], ["string", "place", "value"])

    return rows.mapInArrow(run, "string bigint, place bigint, value bigint")


def _rest_before(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    out = np.zeros(len(before), np.int64)
    for r in rows.where("sampled = 0").groupBy(F.shiftrightunsigned("at", 33).alias("p")).agg(F.count("*").alias("n")).collect():
        out[r["p"] + 1] = r["n"]
    return np.cumsum(out)


def _in_one_task(strings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            ids += batch.column("string").to_pylist()
            held += list(_arrays(batch, "symbols"))
        if not ids:
            return
        sizes = np.array([len(s) for s in held])
        joined = np.concatenate([np.append(s, 0) for s in held])
        # Small numbers in the same order; 1 is a separator.
        dense = np.unique(joined, return_inverse=True)[1].reshape(-1) + 1
        order = suffix_array(dense)
        rank = np.empty(len(joined), np.int64)
        order = order[joined[order] != 0]
        rank[order] = np.arange(len(order))
        ends = np.cumsum(sizes + 1)
        yield _ranked(ids, [rank[e - n - 1 : e - 1] for e, n in zip(ends, sizes, strict=True)])

    return strings.coalesce(1).mapInArrow(run, "string bigint, values array<bigint>")


def _ranked(ids: list[int], ranks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.list_(pa.int64()))], ["string", "values"])


def suffix_ranks(strings: DataFrame, local: int = LOCAL) -> DataFrame:
    """``string``, ``values``: of each string (``string bigint`` from 0 on, ``symbols array<bigint>``) the ranks of its suffixes among all, from 0."""
    strings = checkpoint(strings.where("size(symbols) > 0"))
    number, last = strings.agg(F.count("*"), F.coalesce(F.max("string"), F.lit(0))).first()  # type: ignore[misc]
    # A mark of its own ends each string, below all symbols: no two suffixes are equal, so all comparisons go one way.
    marked = strings.select("string", F.array_append(F.transform("symbols", lambda x: x + last + 1), F.col("string") + 1).alias("symbols"))
    ranked = _ranks(marked, local)
    return ranked.select("string", F.transform(F.slice("values", F.lit(1), F.size("values") - 1), lambda x: x - number).alias("values"))


def _ranks(strings: DataFrame, local: int) -> DataFrame:
    """The ranks of suffixes that are all different."""
    strings = checkpoint(strings)
    total, empty = strings.agg(F.coalesce(F.sum(F.size("symbols")), F.lit(0)), F.count_if(F.size("symbols") % 3 == 1)).first()  # type: ignore[misc]
    if total <= local:
        return checkpoint(_in_one_task(strings))
    triples = checkpoint(_triples(strings))
    names, before = in_order(triples.select("a", "b", "c").distinct(), "a", "b", "c")
    offsets = F.element_at(F.lit(before.tolist()), F.shiftrightunsigned("at", 33).cast("int") + 1)
    names = names.select("a", "b", "c", (offsets + F.col("at").bitwiseAND(_ROW)).alias("value"))
    named = checkpoint(_gathered(triples.join(names, ["a", "b", "c"]).select("string", "place", "value")))
    if int(before[-1]) < triples.count():
        # Names are symbols of the next level, above 0.
        named = _ranks(named.select("string", F.transform("values", lambda x: x + 1).alias("symbols")), local)
    both = checkpoint(strings.join(named, "string", "left").select("string", "symbols", F.coalesce("values", F.array().cast("array<bigint>")).alias("values")))
    parts = []
    for half in (1, 2):
        rows, before = in_order(_merge_keys(both, half, empty), "first", "second", "following", "sampled")
        parts.append(_shares(rows, before, _rest_before(rows, before), half))
    return checkpoint(_gathered(parts[0].unionByName(parts[1])))


def repeated_windows(strings: DataFrame, length: int, local: int = LOCAL) -> DataFrame:
    """``string, start`` of each window of ``length`` bytes (``string bigint, data binary``) that a neighbour in the order of all suffixes equals.

    Neighbours are compared by a 128-bit digest of the window.
    """

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("string"), pa.array([np.frombuffer(d.as_py(), np.uint8).astype(np.int64) + 1 for d in batch.column("data")], pa.list_(pa.int64()))], ["string", "symbols"])

    ranks = suffix_ranks(strings.select("string", "data").mapInArrow(symbols, "string bigint, symbols array<bigint>"), local)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], [b""]
            for string, data, rank in zip(batch.column("string").to_pylist(), batch.column("data").to_pylist(), _arrays(batch, "values"), strict=True):
                starts = np.arange(max(0, len(data) - length + 1))
                rows.append([np.full(len(starts), string), starts, rank[starts]])
                digests += [xxhash.xxh3_128_digest(data[i : i + length]) for i in starts.tolist()]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield _batch([*_joined(rows, 3), halves[:, 0].copy(), halves[:, 1].copy()], ["string", "start", "rank", "hi", "lo"])

    found = strings.select("string", "data").join(ranks, "string").mapInArrow(windows, "string bigint, start bigint, rank bigint, hi bigint, lo bigint")
    rows, _ = in_order(found, "rank")
    # The ends of each partition, for the neighbours across its border.
    edge = F.struct("at", "hi", "lo")
    ends = rows.groupBy(F.shiftrightunsigned("at", 33).alias("p")).agg(F.min(edge).alias("low"), F.max(edge).alias("high")).orderBy("p").collect()
    lows, highs = {r["p"]: (r["low"]["hi"], r["low"]["lo"]) for r in ends}, {r["p"]: (r["high"]["hi"], r["high"]["lo"]) for r in ends}
    parts = [r["p"] for r in ends]
    above, below = dict(zip(parts, parts[1:])), dict(zip(parts[1:], parts))

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last = None

        def judged(batch: pa.RecordBatch, following) -> pa.RecordBatch:
            hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
            same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            out = np.zeros(len(hi), bool)
            out[1:] |= same
            out[:-1] |= same
            out[0] |= last == (hi[0], lo[0])
            out[-1] |= following == (hi[-1], lo[-1])
            return batch.filter(pa.array(out)).select(["string", "start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [(batch.column("hi")[k].as_py(), batch.column("lo")[k].as_py()) for k in (0, batch.num_rows - 1)]
            if held is None:
                last = highs.get(below.get(batch.column("at")[0].as_py() >> 33))
            else:
                yield judged(held, ends[0])
                last = (held.column("hi")[-1].as_py(), held.column("lo")[-1].as_py())
            held = batch
        if held is not None:
            yield judged(held, lows.get(above.get(held.column("at")[0].as_py() >> 33)))

    return rows.mapInArrow(adjacent, "string bigint, start bigint")
