"""Language-model scores: the pseudo-likelihood of a document, each word predicted from the words on both sides.

The network looks at ``REACH`` words to the left and to the right of a masked word, whose embeddings are
weighted by position, summed and squashed, and gives a distribution over ``CLASSES`` classes of words. The
softmax has two steps: the class from both sides, then the word by its exact share of the class's
occurrences in the corpus. Classes follow the counts: the frequent words, in order of count, are cut into
``HEAD`` classes of equal mass, so that the most common words are classes of their own; the others are dealt
out to ``TAIL`` classes by digest. A document's score is the sum of the logarithms over its words.

The vocabulary, each word's exact count, is a table that grows with the corpus and is never gathered:
words of at least the ``FREQUENT``-th part of the corpus, hence at most so many, are sent to the tasks, the
others are joined by key. The context table grows with the square root of the number of words; half of it is for the
most frequent words, one entry each, the rest is shared by the others.

Fitting covers every document, with every word masked once. Documents are dealt out by a hash of id and text to shards
of about as many words each, whatever tasks there are, and stand there in the order of that hash. Each shard
starts from the same weights, passes once over its words and hands in what it has moved. This is added
up as integers, so that the order of addition doesn't matter, and averaged by the number of words: the
model doesn't depend on how the table was dealt over tasks. What goes to the driver has the size of the model;
shards grow with it, so that what they hand in stays a small part of the words.

Defined cases: null, empty and wordless texts have no words, the score 0 and no mean; repeated rows are
counted and scored each; long texts are taken in slices that overlap by ``REACH``; an empty table leaves
the starting weights and gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint, id_and_bytes
from docquarry.llm.decontaminate import words

#: Classes of frequent words and of others, least context entries (one more stands for the border), embedding size.
HEAD, TAIL, CONTEXTS, SIZE = 64, 32, 4096, 16
CLASSES = HEAD + TAIL
REACH = 2
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]
BATCH, RATE = 1024, 0.2
#: Words of at least this part of the corpus are sent to the tasks.
FREQUENT = 1 << 18
#: Words of a shard for each number of the embeddings.
SHARD = 32
#: Words handled at a time.
SLICE = 4096
#: Weights are added up as multiples of this fraction.
UNIT = 1 << 20
MEMO = 1 << 18


def _shapes(entries: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (entries + 1, SIZE), "place": (2 * REACH, SIZE), "out": (SIZE, CLASSES), "bias": (CLASSES,)}


def _key(word: bytes) -> int:
    """A signed 64-bit digest, by which a word stands in the vocabulary; never 0."""
    key = xxhash.xxh3_64_intdigest(word) or 1
    return key - (1 << 64) if key >> 63 else key


def entries_for(distinct: int) -> int:
    """Context entries for so many distinct words: a power of two, from eight times their square root on."""
    entries = CONTEXTS
    while entries * entries < 64 * distinct:
        entries *= 2
    return entries


@dataclass
class Lexicon:
    """What the tasks know of words. ``keys`` and ``counts``: the frequent words, the most frequent first.
    ``tail``: the occurrences of the other words, by class. A word's code is its rank, or from the number of
    frequent words on a remainder of its digest; ``entry``, ``klass`` and ``share`` (the logarithm of a
    word's part in its class, without its own count for words that aren't sent) are by code."""

    keys: np.ndarray
    counts: np.ndarray
    tail: np.ndarray
    entries: int
    total: int

    def __post_init__(self) -> None:
        n, half = len(self.keys), self.entries // 2
        mass = self.counts.astype(np.float64)
        before = (np.cumsum(mass) - mass) / max(1.0, mass.sum())
        rest = np.arange(TAIL * half)
        self.klass = np.concatenate([(before * HEAD).astype(np.int64), HEAD + rest % TAIL])
        own = np.arange(n)
        self.entry = np.concatenate([np.where(own < half, own, half + (self.keys & 0x7FFFFFFF) % half), half + rest // TAIL])
        of_class = np.concatenate([np.bincount(self.klass[:n], mass, HEAD), self.tail])
        self.used = of_class > 0
        self.share = np.concatenate([np.log(mass.clip(0.5)), np.zeros(len(rest))]) - np.log(of_class.clip(0.5))[self.klass]
        self.rank = {k: r for r, k in enumerate(self.keys.tolist())}

    def code(self, word: bytes) -> int:
        key = _key(word)
        rank = self.rank.get(key)
        return len(self.keys) + (key & 0x7FFFFFFF) % (TAIL * (self.entries // 2)) if rank is None else rank


class _Codes(dict[bytes, int]):
    """The code of a word."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.of = lexicon.code

    def __missing__(self, word: bytes) -> int:
        code = self.of(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


class _Rare(dict[bytes, int]):
    """The key of a word, 0 for the frequent ones, which were sent."""

    def __init__(self, frequent: dict[int, int]) -> None:
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        key = _key(word)
        held = 0 if key in self.frequent else key
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = held
        return held


def start_weights(entries: int = CONTEXTS, used: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``used``: which classes have words; the others get no probability."""
    rng = np.random.default_rng(0)
    shapes = _shapes(entries)
    w = {"embed": rng.normal(0, 0.3, shapes["embed"]), "place": np.ones(shapes["place"]), "out": rng.normal(0, 0.1, shapes["out"]), "bias": np.zeros(shapes["bias"])}
    if used is not None:
        w["bias"][~used] = -40.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def _contexts(entries_of: np.ndarray, entries: int = CONTEXTS) -> np.ndarray:
    """A row per word: the context entries of its neighbours."""
    edge = np.full(REACH, entries)
    padded = np.concatenate([edge, entries_of, edge])
    return np.stack([padded[REACH + o : REACH + o + len(entries_of)] for o in OFFSETS], axis=1)


def _hidden(w: dict[str, np.ndarray], contexts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hidden layer with a one beside it, for the bias, and the embeddings of the neighbours at each offset."""
    near = [w["embed"].take(contexts[:, j], axis=0) for j in range(contexts.shape[1])]
    x = near[0] * w["place"][0]
    for j in range(1, len(near)):
        x += near[j] * w["place"][j]
    h = np.ones((len(x), SIZE + 1), x.dtype)
    np.tanh(x, out=h[:, :SIZE])
    return h, near


def _logits(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Of all classes, so that their exponentials neither leave the range of the numbers nor all vanish."""
    z = h @ np.concatenate([w["out"], w["bias"][None]])
    # The hidden layer lies between -1 and 1, so weights within bounds need no look at each row.
    reach = np.abs(w["out"]).sum(axis=0)
    if (w["bias"] + reach).max() > 60 or (w["bias"] - reach).max() < -60:
        z -= z.max(axis=1, keepdims=True)
    return z


def class_log_probs(w: dict[str, np.ndarray], contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The logarithm of each word's class probability, given its neighbours."""
    z = _logits(w, _hidden(w, contexts)[0])
    own = z[np.arange(len(z)), classes]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


class Trainer:
    """One pass of AdaGrad in batches."""

    def __init__(self, start: dict[str, np.ndarray]) -> None:
        self.w = {k: v.copy() for k, v in start.items()}
        self.seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.w.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, contexts: np.ndarray, classes: np.ndarray) -> None:
        self.held.append((contexts, classes))
        self.n += len(classes)
        if self.n >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.n:
            contexts, classes = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.n = [], 0
            for i in range(0, len(classes), BATCH):
                self._step(contexts[i : i + BATCH], classes[i : i + BATCH])

    def _update(self, name: str, g: np.ndarray, at=...) -> None:
        seen = self.seen[name][at] + g * g
        self.seen[name][at] = seen
        self.w[name][at] -= RATE * g / np.sqrt(seen)

    def _step(self, contexts: np.ndarray, classes: np.ndarray) -> None:
        w, n = self.w, len(classes)
        h, near = _hidden(w, contexts)
        p = _logits(w, h)
        np.exp(p, out=p)
        sums = p.sum(axis=1)
        # The rows are left as they are and what they are multiplied with is divided by their sums.
        p[np.arange(n), classes] -= sums
        part = (1 / (sums * n))[:, None]
        dx = (p @ w["out"].T) * part
        dx *= 1 - h[:, :SIZE] ** 2
        d_out = (h * part).T @ p
        # The gradients of an entry stand together after the sort and are summed by stretches.
        flat = contexts.T.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else flat, kind="stable")
        held = flat[order]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        d_near = np.concatenate([dx * w["place"][j] for j in range(len(near))])
        d_embed = np.add.reduceat(d_near.take(order, axis=0), starts, axis=0)
        d_place = np.stack([(dx * x).sum(axis=0) for x in near])
        self._update("embed", d_embed, held[starts])
        self._update("place", d_place)
        self._update("out", d_out[:SIZE])
        self._update("bias", d_out[SIZE])


def _slices(lexicon: Lexicon, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and classes, a bounded number of words at a time."""
    for i in range(0, len(codes), SLICE):
        low, high = max(0, i - REACH), min(len(codes), i + SLICE + REACH)
        some = codes[low:high]
        inside = slice(i - low, i - low + min(SLICE, len(codes) - i))
        # The words beyond the slice are there as neighbours; the border is that of the text.
        yield _contexts(lexicon.entry[some], lexicon.entries)[inside], lexicon.klass[some[inside]]


def vocabulary(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``key, n`` of each distinct word: its digest and its exact count."""

    def out(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_key(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for data in batch.column("data"):
                counts.update(words(data.as_py()))
                if len(counts) >= MEMO:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    rows = id_and_bytes(docs, text_col, text_col).select("data")
    return rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def lexicon(known: DataFrame, frequent: int = FREQUENT) -> Lexicon:
    """The lexicon of a vocabulary, which is read several times."""
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()  # type: ignore[misc]
    often = F.col("n") * F.lit(frequent) >= F.lit(total)
    held = known.where(often).select("key", "n").toArrow()
    keys, counts = held.column("key").to_numpy(), held.column("n").to_numpy()
    order = np.lexsort((keys, -counts))
    entries = entries_for(distinct)
    tail = np.zeros(TAIL)
    # The class of the others is a remainder of their code, as in Lexicon.
    for klass, n in known.where(~often).groupBy((F.col("key").bitwiseAND(0x7FFFFFFF) % (TAIL * (entries // 2)) % TAIL).alias("class")).agg(F.sum("n")).collect():
        tail[klass] = n
    return Lexicon(keys[order], counts[order], tail, entries, total)


@dataclass
class Model:
    lexicon: Lexicon
    weights: dict[str, np.ndarray]


def fit(docs: DataFrame, *, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> Model:
    """The lexicon and the weights of the network, from all documents."""
    lex = lexicon(checkpoint(vocabulary(docs, text_col=text_col)) if known is None else known, frequent)
    entries = lex.entries
    start, shapes = start_weights(entries, lex.used), _shapes(entries)
    lengths = [int(np.prod(x)) for x in shapes.values()]
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def flat(w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[k].ravel() for k in shapes]).astype(np.float64)

    def handed_in(trainer: Trainer, total: int) -> Iterator[pa.RecordBatch]:
        trainer.flush()
        # What a shard has moved: entries that none of its words touched are not handed in.
        values = np.rint((flat(trainer.w) - flat(start)) * UNIT).astype(np.int64) * total
        held = np.flatnonzero(values)
        for i in range(0, len(held), 1 << 15):
            some = held[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(values[some])], ["place", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        memo, shard, trainer, total = _Codes(lex), None, Trainer(start), 0
        for batch in batches:
            for here, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                if here != shard:
                    yield from handed_in(trainer, total)
                    shard, trainer, total = here, Trainer(start), 0
                text = words(data.as_py())
                codes = np.fromiter(map(memo.__getitem__, text), np.int64, len(text))
                total += len(codes)
                for contexts, own in _slices(lex, codes):
                    trainer.add(contexts, own)
        yield from handed_in(trainer, total)

    shards = max(1, round(lex.total / (SHARD * entries * SIZE)))
    rows = id_and_bytes(docs, id_col, text_col)
    dealt = rows.select("data", F.xxhash64("id", F.col("data").cast("string")).alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    ordered = dealt.repartitionById(min(shards, 1 << 16), F.pmod("shard", F.lit(1 << 16)).cast("int")).sortWithinPartitions("shard", "h").select("shard", "data")
    # Weights times words can leave 64 bits in a large corpus; the sums have more.
    summed = ordered.mapInArrow(run, "place int, value bigint").groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).toArrow()
    values = np.zeros(sum(lengths))
    values[summed.column("place").to_numpy()] = summed.column("value").cast(pa.float64()).to_numpy()
    parts = np.split(flat(start) + values / max(1, lex.total) / UNIT, np.cumsum(lengths)[:-1])
    return Model(lex, {k: x.reshape(shapes[k]).astype(np.float32) for k, x in zip(shapes, parts, strict=True)})


def score(docs: DataFrame, model: Model | None = None, *, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """A row per row: its id, ``n_words``, ``log_likelihood`` (natural logarithm) and ``mean_log_likelihood``.

    ``known`` is the vocabulary that the model was fitted with, of ``docs`` if none is given; a word that it lacks counts as half an occurrence.
    """
    known = checkpoint(vocabulary(docs, text_col=text_col) if known is None else known)
    if model is None:
        model = fit(docs, known=known, id_col=id_col, text_col=text_col, frequent=frequent)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_bytes(docs, id_col, text_col)
    rows = rows.select("id", "data", F.xxhash64(F.col("data").cast("string")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each of its words that weren't sent, with how often it has it."""
        lex, w = sent.value.lexicon, sent.value.weights
        codes_of, rare_of = _Codes(lex), _Rare(lex.rank)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                sizes, lengths, sums, keys, times = [], [], [], [], []
                for h, data in zip(some.column("h").to_pylist(), some.column("data"), strict=True):
                    text = words(data.as_py())
                    codes = np.fromiter(map(codes_of.__getitem__, text), np.int64, len(text))
                    total = float(lex.share[codes].sum())
                    for contexts, own in _slices(lex, codes):
                        total += float(class_log_probs(w, contexts, own).sum(dtype=np.float64))
                    rare, n = np.unique(np.array([rare_of[text[i]] for i in np.flatnonzero(codes >= len(lex.keys)).tolist()], np.int64), return_counts=True)
                    sizes.append(1 + len(rare))
                    lengths.append(len(text))
                    sums.append(total)
                    # The document's own row stands where its hash leads and finds nothing that counts.
                    keys += [[h], rare]
                    times += [[0], n]
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = pa.array(of)
                own_row = np.diff(of, prepend=-1).astype(np.int32)
                columns = [some.column("id").take(at), some.column("h").take(at), pa.array(np.array(lengths, np.int64)[of]), pa.array(np.array(sums)[of])]
                columns += [pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(np.concatenate([np.zeros(0, np.int32), *times]).astype(np.int32)), pa.array(own_row)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "n_words", "total", "key", "times", "own"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, h bigint, n_words bigint, total double, key bigint, times int, own int").join(known, "key", "left")
    # Whole numbers, which add up alike in any order. Equal rows meet in one and are told apart by how many there are.
    one = F.col("times") * F.coalesce(F.round(F.log(F.col("n")) * UNIT), F.lit(round(np.log(0.5) * UNIT))).cast("bigint")
    summed = found.groupBy("id", "h", "n_words", "total").agg(F.sum(one).alias("units"), F.sum("own").alias("rows"))
    total = F.col("total") + F.col("units") / F.col("rows") / UNIT
    scored = summed.select(F.col("id").alias(id_col), "n_words", total.alias("log_likelihood"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return scored.select(id_col, "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
