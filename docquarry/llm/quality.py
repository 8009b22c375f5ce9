"""Document quality by ordinal regression: one score from shared hashed-text weights, ordered thresholds between grades.

The probability that a document reaches grade k or above is the logistic of its score less the k-th
threshold (cumulative link). From these follow the expected grade and the probability of the highest
grades, by which documents are selected.

Grades: 0 for labelled low quality, 1 for good quality but toxic, 2 for good quality and not toxic.

Defined cases: null and empty texts have only the features of an empty text; without labels, or with one
grade only, every document gets the base rates of the grades (with no labels: the highest); a document
with several labels takes the best; repeated rows each give a row; very long texts are read whole, their
features are a set; an empty table gives no rows. The model is fitted on at most ``hashed.SAMPLE`` labelled documents and
applied to all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import hashed
from docquarry.llm.common import id_and_bytes

GRADES = 3
#: A document is selected if it reaches grade 1 at least this probably.
SELECT = 0.5
FEATURE_LEAST, FEATURE_Z = 10, 5.0
STEPS, RATE, DECAY = 300, 0.1, 1e-4

_LETTERS, _DIGITS, _RUN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"(.)\1+")


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def shape(token: bytes) -> bytes:
    """Letters by their case, digits, and each run of one mark as that mark."""
    return _RUN.sub(rb"\1", _DIGITS.sub(b"0", re.sub(rb"[A-Z]+", b"A", _LETTERS.sub(b"a", token))))


def _bucket(x: float) -> bytes:
    return str(int(np.ceil(np.log2(x * 16 + 1)))).encode()


def _of_text(tokens: list[bytes]) -> list[bytes]:
    """Length, share of distinct tokens, share of tokens that repeat the one before, share that aren't words."""
    n = max(1, len(tokens))
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    plain = sum(t[:1].isalpha() or t[:1] >= b"\x80" for t in tokens)
    return [
        b"n" + str(len(tokens).bit_length()).encode(),
        b"d" + _bucket(len(set(tokens)) / n),
        b"r" + _bucket(again / n),
        b"m" + _bucket(1 - plain / n),
    ]


def extractor() -> hashed.Extractor:
    return hashed.Extractor(bytes.split, lambda t: [b"w" + t.lower(), b"s" + shape(t)], _of_text)


@dataclass
class Ordinal:
    kept: np.ndarray
    weights: np.ndarray
    #: Ascending; ``cuts[k]`` lies between grades k and k + 1.
    cuts: np.ndarray

    def tails(self, columns: np.ndarray) -> np.ndarray:
        """Probability of at least grade 1, 2, ..."""
        x = self.weights[columns].sum() / np.sqrt(max(1, len(columns)))
        return hashed.sigmoid(x - self.cuts)


def fit(features: list[np.ndarray], grades: np.ndarray) -> Ordinal:
    """Maximum likelihood with an L2 penalty; the thresholds stay in order by being a first one and positive steps."""
    counts = np.bincount(grades, minlength=GRADES)
    above = counts[::-1].cumsum()[::-1][1:] / max(1, len(grades)) if len(grades) else np.ones(GRADES - 1)
    base = np.maximum.accumulate(-np.log(np.clip(above, 1e-6, 1 - 1e-6) / (1 - np.clip(above, 1e-6, 1 - 1e-6))))
    if np.count_nonzero(counts) < 2:
        return Ordinal(np.zeros(0, np.uint32), np.zeros(0), base)
    kept = np.unique(np.concatenate([hashed.telling(features, (grades >= k).astype(float), least=FEATURE_LEAST, z=FEATURE_Z, both=True) for k in range(1, GRADES)]))
    design = hashed.Design(features, kept)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(design.rows, minlength=design.n)))
    d, k = len(kept), GRADES - 1

    def cuts(x: np.ndarray) -> np.ndarray:
        return x[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(x[d + 1 :], -20, 20)))])

    lower, upper = grades - 1, grades

    def gradient(x: np.ndarray) -> np.ndarray:
        score, c = design.times(x[:d]) * scale, cuts(x)
        edge = np.concatenate([[-40.0], c, [40.0]])
        # P(grade) = s(b) - s(a) with s the logistic, a and b the distances to the cuts around it.
        a, b = edge[lower + 1] - score, edge[upper + 1] - score
        sa, sb = hashed.sigmoid(a), hashed.sigmoid(b)
        p = np.maximum(sb - sa, 1e-12)
        da, db = sa * (1 - sa) / p, sb * (1 - sb) / p
        to_score = db - da
        to_cut = np.zeros(k)
        np.add.at(to_cut, lower[lower >= 0], da[lower >= 0])
        np.subtract.at(to_cut, upper[upper < k], db[upper < k])
        steps = np.exp(np.clip(x[d + 1 :], -20, 20))
        to_x = [to_cut.sum(), *(to_cut[i + 1 :].sum() * steps[i] for i in range(k - 1))]
        return np.concatenate([design.back(to_score * scale), to_x]) / design.n + DECAY * np.concatenate([x[:d], np.zeros(k)])

    start = np.concatenate([np.zeros(d), [base[0]], np.log(np.maximum(np.diff(base), 1e-3))])
    x = hashed.adam(gradient, start, STEPS, RATE)
    return Ordinal(kept, x[:d], cuts(x))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", rating: Column | None = None, sample: int = hashed.SAMPLE, select: float = SELECT) -> DataFrame:
    """A row per row: its id, ``expected_grade``, ``tail_1`` and ``tail_2`` (chances of at least that grade), ``selected``."""
    features, grades = hashed.labelled_sample(docs, labels, grade() if rating is None else rating, extractor, id_col=id_col, text_col=text_col, label_id=label_id, sample=sample)
    sent = docs.sparkSession.sparkContext.broadcast(fit(features, grades))
    rows = id_and_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        extract = extractor().keep(model.kept)
        for batch in batches:
            tails = np.array([model.tails(extract(data.as_py())) for data in batch.column("data")]).reshape(-1, GRADES - 1)
            columns = [batch.column("id"), pa.array(tails.sum(axis=1)), *(pa.array(t) for t in tails.T), pa.array(tails[:, 0] >= select)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "expected_grade", "tail_1", "tail_2", "selected"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, expected_grade double, tail_1 double, tail_2 double, selected boolean")
