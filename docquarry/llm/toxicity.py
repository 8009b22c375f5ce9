"""Toxicity by a chain of classifiers.

The categories are predicted one after another: each link is a logistic regression on hashed text
features and on the probabilities of the categories before it, which while fitting come from models that
did not see the document (out of fold). The last link is the label itself.

The categories are columns of the labels, named by the caller in the order of the chain. Only where the labels
just say toxic or not, as a last resort, is a labelled document taken to be of a category if it is toxic and
holds one of the category's seed words. Every category is fitted, however rare it is.

A document is toxic from the probability on that parts the labelled documents best (by F1) when each is
predicted out of fold; it is never that of a document without features, nor above one half.

Defined cases: null and empty texts have no features and get the base-line probability; without labels,
or with labels of one class only, every probability is the base rate (zero without labels); a document
with several labels is toxic, or of a category, if one says so; a row with a null label is left out, a null category says no; repeated rows each give a
row; very long texts are read whole, their features are a set; an empty table gives no rows. The model is fitted
on at most ``hashed.SAMPLE`` labelled documents and applied to all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import hashed
from docquarry.llm.common import id_and_bytes, small_batches
from docquarry.llm.decontaminate import words

#: Seed words by category, in the order of the chain.
SEEDS = {
    "insult": ("clown", "coward", "dumb", "fool", "freak", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pig", "stupid"),
    "contempt": ("disgusting", "dirt", "filth", "garbage", "hate", "pathetic", "rubbish", "scum", "trash", "ugly", "vermin", "worthless"),
    "threat": ("beat", "burn", "destroy", "die", "hang", "hurt", "kill", "murder", "shoot", "stab"),
}
FOLDS = 5
#: A feature counts if so many samples have it and it is so many standard deviations more common in toxic ones.
FEATURE_LEAST, FEATURE_Z = 10, 5.0
STEPS, RATE, DECAY = 300, 0.1, 5e-5


def extractor() -> hashed.Extractor:
    """Whole words, and the first four and five bytes of longer ones, which inflected forms share."""

    def of_word(word: bytes) -> list[bytes]:
        return [b"w" + word] + [b"p" + word[:n] for n in (4, 5) if len(word) > n]

    return hashed.Extractor(words, of_word)


@dataclass
class Link:
    """``weights`` by kept feature; ``before`` for the earlier categories' probabilities."""

    weights: np.ndarray
    before: np.ndarray
    bias: float

    def predict(self, columns: np.ndarray, before: list[float]) -> float:
        x = self.bias + float(self.weights[columns].sum()) + float(np.dot(self.before, before))
        return float(hashed.sigmoid(np.array(x)))


def _fit(design: hashed.Design, before: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    d, k, n = len(design.kept), before.shape[1], max(1, int(use.sum()))
    share = float(y[use].mean()) if use.any() else 0.0
    if not 0 < share < 1:
        return np.zeros(d), np.zeros(k), 40.0 if share else -40.0

    def gradient(x: np.ndarray) -> np.ndarray:
        p = hashed.sigmoid(design.times(x[:d]) + before @ x[d : d + k] + x[-1])
        r = np.where(use, p - y, 0.0)
        return np.concatenate([design.back(r), before.T @ r, [r.sum()]]) / n + DECAY * np.append(x[:-1], 0.0)

    start = np.zeros(d + k + 1)
    start[-1] = np.log(share / (1 - share))
    x = hashed.adam(gradient, start, STEPS, RATE)
    return x[:d], x[d : d + k], float(x[-1])


@dataclass
class Chain:
    """``kept``: places of the features that the links weigh. ``threshold``: from where the last link's probability means toxic."""

    kept: np.ndarray
    links: list[Link]
    threshold: float

    def predict(self, columns: np.ndarray) -> list[float]:
        out: list[float] = []
        for link in self.links:
            out.append(link.predict(columns, out))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, least: float) -> float:
    """Halfway, in log-odds, between the last probability on the best side of the cut and the next; above ``least``, at most one half."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = np.clip(p[order], 1e-9, 1 - 1e-9), np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    f1[p <= least] = 0
    k = int(np.argmax(f1))
    low = max(p[k + 1] if k + 1 < len(p) else least, least, 1e-9)
    odds = lambda x: np.log(x / (1 - x))
    return float(min(0.5, hashed.sigmoid(np.array((odds(p[k]) + odds(min(low, p[k]))) / 2)))) if f1[k] > 0 else 0.5


def seeded(features: list[np.ndarray], toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Membership by seed words: toxic documents that hold one."""
    out = {}
    for category, listed in SEEDS.items():
        seeds = np.array([hashed.place(b"w" + s.encode()) for s in listed], np.uint32)
        out[category] = toxic * np.array([np.isin(seeds, f).any() for f in features], bool)
    return out


def fit_chain(features: list[np.ndarray], toxic: np.ndarray, categories: dict[str, np.ndarray]) -> Chain:
    """``categories``: membership by name, in the order of the chain, before the last link."""
    kept = hashed.telling(features, toxic, least=FEATURE_LEAST, z=FEATURE_Z, both=False)
    design = hashed.Design(features, kept)
    before = np.zeros((len(features), 0))
    links = []
    for y in (*categories.values(), toxic):
        y = y.astype(float)
        # Folds that share out the members, so that a rare category is in all of them.
        fold = np.empty(len(y), int)
        fold[np.argsort(-y, kind="stable")] = np.arange(len(y)) % FOLDS
        out_of_fold = np.zeros(len(features))
        for k in range(FOLDS):
            w, b, bias = _fit(design, before, y, fold != k)
            out_of_fold = np.where(fold == k, hashed.sigmoid(design.times(w) + before @ b + bias), out_of_fold)
        w, b, bias = _fit(design, before, y, np.ones(len(features), bool))
        links.append(Link(w, b, bias))
        before = np.column_stack([before, out_of_fold])
    chain = Chain(kept, links, 0.5)
    chain.threshold = best_threshold(before[:, -1], toxic, chain.predict(np.zeros(0, np.int64))[-1])
    return chain


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label: str = "toxic",
    categories: Sequence[str] = (),
    sample: int = hashed.SAMPLE,
    threshold: float | None = None,
    keep: bool = False,
) -> DataFrame:
    """A row per row: its id, a probability for each category and at last for the label itself, and ``is_toxic``.

    ``categories``: columns of the labels, 0 or 1, in the order of the chain; without any, those of the seed words.
    With ``keep``: instead, the rows of ``docs`` that are not toxic, with all their columns.
    """
    held = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (label, *categories)]
    # One number tells all labels of a row; a document with several rows has the labels of any.
    number = sum((F.when(h, 1 << k).otherwise(0) for k, h in enumerate(held)), F.lit(0))
    number = F.when(F.col(label).isNotNull(), number)
    features, numbers = hashed.labelled_sample(docs, labels, number, extractor, id_col=id_col, text_col=text_col, label_id=label_id, sample=sample, join=F.bit_or)
    toxic, *others = ((numbers.astype(np.int64) >> k & 1).astype(bool) for k in range(len(held)))
    chain = fit_chain(features, toxic, dict(zip(categories, others, strict=True)) if categories else seeded(features, toxic))
    names = (*(categories or SEEDS), label)
    if threshold is not None:
        chain.threshold = threshold
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    if keep:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = sent.value
            extract = extractor().keep(chain.kept)
            for batch in batches:
                texts = batch.column(place).cast(pa.binary())
                yield batch.filter(pa.array([chain.predict(extract(t.as_py() or b""))[-1] < chain.threshold for t in texts], pa.bool_()))

        place = docs.columns.index(text_col)
        return small_batches(docs).mapInArrow(clean, docs.schema)

    rows = id_and_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        extract = extractor().keep(chain.kept)
        for batch in batches:
            all_chances = np.array([chain.predict(extract(data.as_py())) for data in batch.column("data")]).reshape(-1, len(names))
            columns = [batch.column("id"), *(pa.array(c) for c in all_chances.T), pa.array(all_chances[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f"p_{c}" for c in names), "is_toxic"])

    kinds = ", ".join(f"p_{c} double" for c in names)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, {kinds}, is_toxic boolean")
