"""Hashed text features and bounded samples of labelled documents, for the linear models."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import id_and_bytes

#: Labelled documents that a model is fitted on: those whose ids hash lowest. Scoring covers all documents.
SAMPLE = 10_000
#: Entries of a worker's memo from words to features; a full memo is emptied.
MEMO = 1 << 17


def place(feature: bytes) -> int:
    """32 bits: hardly two features of a corpus that matter share one."""
    return zlib.crc32(feature)


class Extractor(dict):
    """Maps a text to the sorted distinct places of its features; after ``keep`` to columns of kept places.

    ``of_word`` lists a token's features; the memo holds their places. ``of_text`` adds features of the
    whole text.
    """

    def __init__(self, tokens: Callable[[bytes], list[bytes]], of_word: Callable[[bytes], list[bytes]], of_text: Callable[[list[bytes]], list[bytes]] | None = None):
        self.tokens, self.of_word, self.of_text = tokens, of_word, of_text
        self.column: dict[int, int] | None = None

    def keep(self, kept: np.ndarray) -> Extractor:
        self.clear()
        self.column = {int(p): c for c, p in enumerate(kept)}
        return self

    def places(self, features: list[bytes]) -> list[int]:
        found = [place(f) for f in features]
        return found if self.column is None else [self.column[p] for p in found if p in self.column]

    def __missing__(self, word: bytes) -> list[int]:
        places = self.places(self.of_word(word))
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = places
        return places

    def __call__(self, data: bytes) -> np.ndarray:
        tokens = self.tokens(data)
        found: set[int] = set()
        for places in map(self.__getitem__, set(tokens)):
            found.update(places)
        if self.of_text:
            found.update(self.places(self.of_text(tokens)))
        out = np.fromiter(found, np.uint32, len(found))
        out.sort()
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, extractor: Callable[[], Extractor], *, id_col: str, text_col: str, label_id: str, sample: int, join: Callable[[str], Column] = F.max) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of up to ``sample`` labelled documents, in a fixed order.

    A document with several labels takes what ``join`` makes of them; of several documents with one id one is taken; null ids and grades are left out; of labelled rows
    with equal features and grade one stays, so that copies don't outweigh the rest.
    """
    chosen = (
        labels.select(F.col(label_id).alias("label_id"), grade.cast("int").alias("grade"))
        .where("label_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("label_id")
        .agg(join("grade").alias("grade"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    # Bounded by ``sample`` rows of two numbers.
    rows = id_and_bytes(docs, id_col, text_col).join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("label_id", "grade", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor()
        for batch in batches:
            features = [extract(data.as_py()).tobytes() for data in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("grade"), pa.array(features, pa.binary())], ["label_id", "grade", "features"])

    id_type = rows.schema["label_id"].dataType.simpleString()
    # One row for each label, however many documents share its id.
    found = rows.mapInArrow(run, f"label_id {id_type}, grade int, features binary").groupBy("label_id").agg(F.min(F.struct("grade", "features")).alias("x")).select("label_id", "x.*").collect()
    distinct = sorted({(bytes(r["features"]), r["grade"]): r["label_id"] for r in sorted(found, key=lambda r: r["label_id"], reverse=True)}.items(), key=lambda kv: kv[1])
    return [np.frombuffer(f, np.uint32) for (f, _), _ in distinct], np.array([g for (_, g), _ in distinct], np.int64)


def telling(features: Sequence[np.ndarray], y: np.ndarray, *, least: int, z: float, both: bool) -> np.ndarray:
    """Places of features that at least ``least`` samples have and that go with ``y`` (0 or 1), by ``z`` standard
    deviations more often than chance would have it; with ``both``, also those that go against it."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.uint32)
    places, at = np.unique(np.concatenate(features), return_inverse=True)
    have = np.bincount(at, minlength=len(places))
    hits = np.bincount(at, np.repeat(y, [len(f) for f in features]), minlength=len(places))
    score = (hits - have * share) / np.sqrt(np.maximum(have, 1) * share * (1 - share))
    return places[(have >= least) & ((np.abs(score) if both else score) >= z)]


class Design:
    """The samples' kept features as one sparse matrix, with dense columns beside it."""

    def __init__(self, features: Sequence[np.ndarray], kept: np.ndarray):
        self.n, self.kept = len(features), kept
        found = [np.searchsorted(kept, places[np.isin(places, kept)]) for places in features]
        self.rows = np.repeat(np.arange(self.n), [len(c) for c in found])
        self.columns = np.concatenate([np.zeros(0, np.int64), *found])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.rows], len(self.kept))


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
