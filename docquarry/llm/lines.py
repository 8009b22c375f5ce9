"""Repeated lines and sentences: of each unit of text the earliest occurrence stays, all later ones go.

A unit is a whole line of any length with a word in it and, of a line that has several, each sentence of
at least ``MIN_WORDS`` words or, for scripts without spaces, ``MIN_BYTES`` bytes of words: shorter sentences
are common phrases, of which prose would be robbed. A sentence ends at marks before a space or the line's
end, or at a full-width mark. Units are compared by a 128-bit digest of their words, without case and
punctuation. Occurrences are ranked by document id (null first), then by a hash of the text, then by place.

The least place of each digest is found by an aggregate that combines within tasks before the shuffle, so
a line in every document is a row from each task; the join that finds the other occurrences can be split.
Texts are cut for either, which costs less than keeping the units.

Defined cases: null and empty texts have no units; rows that agree in id and text are one document and
keep the same units; spans are byte offsets into the UTF-8 text, ends exclusive; what lies between units
(line ends, spaces, lines without a word) stays; a sentence in a removed line goes with it; very long texts
and lines are cut in one pass; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import small_batches
from docquarry.llm.decontaminate import words

#: What a sentence inside a line must have, words or bytes of them.
MIN_WORDS, MIN_BYTES = 5, 40
#: The full-width marks, and bytes that UTF-8 never has in their place while a line is cut.
_FULL = re.compile(rb"\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
#: A sentence with its closing marks, or what is left of a line.
_SENTENCE = re.compile(rb"(?:[^.!?\xfe\xff]+|[.!?]+[^\s.!?\xfe\xff])+[.!?]*(?:\xfe\xfe\xff)?|[.!?]+(?:\xfe\xfe\xff)?|\xfe\xfe\xff")


def _trimmed(unit: bytes, start: int) -> int:
    return start + len(unit) - len(unit.lstrip())


def units(data: bytes, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of each unit; spaces before a unit are not part of it."""
    at = 0
    for line in data.split(b"\n"):
        whole = b" ".join(words(line))
        if whole:
            yield _trimmed(line, at), at + len(line), xxhash.xxh3_128_digest(whole)
            for match in _SENTENCE.finditer(_FULL.sub(b"\xfe\xfe\xff", line)):
                start, end = match.span()
                text = words(line[start:end])
                joined = b" ".join(text)
                if (len(text) >= min_words or len(joined) >= min_bytes) and len(joined) < len(whole):
                    yield _trimmed(line[start:end], at + start), at + end, xxhash.xxh3_128_digest(joined)
        at += len(line) + 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("data"))


def occurrences(rows: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, h, start, stop`` and the digest's halves ``hi, lo`` of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, stops, digests = [], [], [], []
            for i, data in enumerate(batch.column("data")):
                for start, stop, digest in units(data.as_py(), min_words, min_bytes):
                    of.append(i)
                    starts.append(start)
                    stops.append(stop)
                    digests.append(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(of, pa.int64())
            columns = [batch.column("id").take(at), batch.column("h").take(at), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "start", "stop", "hi", "lo"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h bigint, start int, stop int, hi bigint, lo bigint")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, h, start, stop`` of each unit that is not its digest's earliest occurrence."""
    found = occurrences(_rows(docs, id_col, text_col), min_words, min_bytes)
    first = found.groupBy("hi", "lo").agg(F.min(F.struct("id", "h", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("start") == F.col("first.start")))
    return found.join(first, ["hi", "lo"]).where(later).select("id", "h", "start", "stop")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row per row: its id, ``kept`` (the bytes that stay), ``removed``, an array of ``start``, ``stop`` in the original, and ``n_bytes``."""
    found = repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words, min_bytes=min_bytes)
    removed = found.groupBy(F.col("id").alias("i"), F.col("h").alias("k")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    rows = _rows(docs, id_col, text_col)
    joined = rows.join(removed, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left").select("id", "data", "removed")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, sizes = [], [], []
            for data, spans in zip(batch.column("data"), batch.column("removed"), strict=True):
                text, out, at, runs = data.as_py(), [], 0, []
                # A line sorts before its last sentences, and after a first one that it shares its start with.
                for x in spans.as_py() or ():
                    if runs and runs[-1]["start"] == x["start"]:
                        runs.pop()
                    elif runs and x["stop"] <= runs[-1]["stop"]:
                        continue
                    runs.append(x)
                for x in runs:
                    out.append(text[at : x["start"]])
                    at = x["stop"]
                kept.append(b"".join([*out, text[at:]]))
                gone.append(runs)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), pa.array(gone, kind), pa.array(sizes, pa.int64())], [id_col, "kept", "removed", "n_bytes"])

    return joined.mapInArrow(run, f"`{id_col}` {joined.schema['id'].dataType.simpleString()}, kept binary, removed array<struct<start:int,stop:int>>, n_bytes bigint")
