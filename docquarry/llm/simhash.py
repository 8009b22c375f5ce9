"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in few bits are found through two 32-bit segments. Of two fingerprints within
four bits, one segment differs in at most two bits or the other in at most one (3 + 2 > 4). Small Hamming
balls around each segment value are enumerated as table keys: of radius one on both sides for the first
segment, since two values within two bits share a value within one bit of either, and of radius one
against the value itself for the second. Rows that meet under a key are verified on all 64 bits.

Equal fingerprints are one row from the start, so copies cost nothing. A key's rows reach one task in
sorted order and are verified in batches of at most ``BUCKET``, which leave a forest of links, not all
pairs. Fingerprints of a fuller key go another exact way: each lists every value within two bits, and
whoever shares one is within four, so that the work is in proportion to their number.

Defined cases: null and wordless texts have the fingerprint zero and are linked like any other; repeated
rows and ids each give a row; very long texts are hashed in slices; an id that is null gets the component of its fingerprint but names none
unless all ids there are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint, id_and_bytes
from docquarry.llm.components import connected_components

SHINGLE = 4
SEED = 42
#: Bits in which linked fingerprints may differ.
RADIUS = 4
#: Most fingerprints under one key that are compared with each other.
BUCKET = 4096
#: Shingles hashed at a time, which bounds the memory that one text takes.
SLICE = 1 << 15


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned: a bit is one if it is one in over half of the shingles' hashes."""
    text = data.lower().split()
    if not text:
        return 0
    n = max(1, len(text) - shingle + 1)
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for first in range(0, n, SLICE):
        some = text[first : first + SLICE + shingle - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[min(shingle, len(some)) - 1 :] - 1).tolist()
        hashes = np.array([hashed(joined[i:j], SEED) for i, j in zip(starts, stops)], "<u8")  # noqa: B905  the starts end with the last shingles
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a long) of each row."""
    rows = id_and_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(data.as_py()) for data in batch.column("data")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``RADIUS`` joins among these fingerprints, without cycles."""
    # Unsigned: of signed numbers the bits of the absolute value would be counted.
    left, links = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found = left[near]
                links += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                front += list(found)
                left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: the links under each key; rows of the fuller keys with a null instead."""
    key, held, full = None, [], False

    def close() -> list[tuple[int, int | None]]:
        if full or sum(map(len, held)) < 2:
            return []
        fps = np.unique(np.concatenate(held))
        return [(a, b) for a, b in _forest(fps)] if len(fps) > 1 else []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        out: list[tuple[int, int | None]] = []
        bounds = [0, *cuts.tolist(), len(keys)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            if keys[i] != key:
                out += close()
                key, held, full = keys[i], [], False
            if full:
                out += [(int(x), None) for x in fps[i:j]]
                continue
            held.append(fps[i:j])
            if sum(map(len, held)) > BUCKET:
                out += [(int(x), None) for x in np.concatenate(held)]
                held, full = [], True
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    out = close()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs within ``RADIUS``; ``distinct``: one row for each ``fp``."""
    bits = F.sequence(F.lit(0), F.lit(31))
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    ball = lambda x: F.concat(F.array(x), F.transform(bits, lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    tagged = lambda xs, tag: F.transform(xs, lambda x: x.bitwiseOR(F.lit(tag << 32)))
    # The first segment's balls, and of the second the ball as well; its plain value lies in its own ball.
    keys = distinct.select("fp", F.explode(F.concat(tagged(ball(high), 0), tagged(ball(low), 1))).alias("key"))
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    found = checkpoint(dealt.mapInArrow(_links, "a bigint, b bigint").distinct())
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    masks = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    near = crowded.select("fp", F.explode(F.transform(F.lit(signed), lambda m: m.bitwiseXOR(F.col("fp")))).alias("at"))
    stars = near.join(near.groupBy("at").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1"), "at").select(F.col("hub").alias("a"), F.col("fp").alias("b")).where("a != b").distinct()
    plain = found.where("b IS NOT NULL")
    return plain.unionByName(stars) if crowded.head(1) else plain


def _assigned(fps: DataFrame) -> DataFrame:
    """``id``, ``fp`` and ``component_id``, the least id of what links reach, for each row of ``fps``."""
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    component = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    grouped = checkpoint(distinct.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    # Kept by itself, so that the join deals both sides and can split a component that is large.
    least = checkpoint(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    return fps.join(grouped.join(least, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: its id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``."""
    found = _assigned(checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col)))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each component: that of the smallest id, null ids last.

    Rows that share the id are told apart by a hash of their columns; of rows equal in all of them one stays.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    hashed = [name for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("hash")))
    found = _assigned(checkpoint(fingerprints(keyed, id_col=key, text_col=text_col)))
    keep = checkpoint(found.where("id = component_id").groupBy(F.col("id").alias(key)).agg(F.count("*").alias("n_rows")))
    kept = keyed.join(keep, key, "left_semi")
    if keep.where("n_rows > 1").head(1):
        kept = kept.dropDuplicates([key])
    return kept.drop(key)
