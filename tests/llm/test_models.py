"""Toxicity, quality and language-model scores: held-out accuracy, the mathematics, and the odd cases."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import hashed, lm, quality, toxicity
from tests.llm.common import ODD, SF, empty, odd, ordered, table

WORDS = ["".join(p) for p in zip("abcdefghij" * 10, "klmnopqrst" * 10, "uvwxyzabcd" * 10, strict=True)]


def labelled(n=1500, seed=0):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "hu", "ka") for b in ("lan", "mer", "nid", "pos", "rut", "sil", "tev")]
    rows = []
    for i in range(n):
        text = rng.choices(plain, k=rng.randint(5, 60))
        toxic = rng.random() < 0.15
        junk = not toxic and rng.random() < 0.2
        if toxic:
            for w in rng.choices(["idiot", "moron", "scum", "trash", "loser", "vequmo", "vequra"], k=rng.randint(2, 4)):
                text.insert(rng.randrange(len(text)), w)
        if junk:
            text = [w + rng.choice(["###", "***"]) for w in text]
        rows.append((i, " ".join(text), int(not junk), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 2 == 0], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_toxicity(spark):
    rows = labelled()
    got = {r["doc_id"]: r for r in toxicity.score(*frames(spark, rows)).collect()}
    held = [(got[i]["is_toxic"], bool(t)) for i, _, _, t in rows if i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    insults = [got[i]["p_insult"] for i, text, _, _ in rows if "idiot" in text and i % 2]
    assert np.mean(insults) > 0.8 > 0.2 > np.mean([got[i]["p_insult"] for i, _, _, t in rows if not t and i % 2])
    kept = toxicity.score(*frames(spark, rows), keep=True)
    assert kept.columns == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["is_toxic"]}


def test_later_links_use_earlier_probabilities():
    rows = labelled(2000, 3)
    features = [toxicity.extractor()(t.encode()) for _, t, _, _ in rows]
    toxic = np.array([r[3] for r in rows], bool)
    links = toxicity.fit_chain(features, toxic, toxicity.seeded(features, toxic)).links
    assert [len(link.before) for link in links] == [0, 1, 2, 3]
    assert links[-1].before[0] > 0 and links[-1].before[1] > 0


def test_threshold():
    y = np.array([1, 1, 0, 0, 0])
    assert 0.1 < toxicity.best_threshold(np.array([0.9, 0.4, 0.1, 0.05, 0.01]), y, 0.02) < 0.4
    assert toxicity.best_threshold(np.array([0.3, 0.3, 0.3, 0.3, 0.3]), y, 0.3) == 0.5
    assert toxicity.best_threshold(np.array([0.9, 0.95, 0.1, 0.05, 0.01]), y, 0.02) <= 0.5
    assert toxicity.best_threshold(np.zeros(3), np.zeros(3), 0.0) == 0.5
    # A document without features is not toxic, however many of those labelled are.
    assert toxicity.best_threshold(np.array([0.9, 0.2, 0.2]), np.array([1, 1, 1 - 1]), 0.2) > 0.2


def test_held_out_quality(spark):
    rows = labelled(1500, 1)
    got = {r["doc_id"]: r for r in quality.score(*frames(spark, rows)).collect()}
    held = [(got[i]["selected"], bool(q)) for i, _, q, _ in rows if i % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    mean = lambda want: np.mean([got[i]["expected_grade"] for i, _, q, t in rows if i % 2 and (0 if not q else 1 if t else 2) == want])
    assert mean(0) < mean(1) < mean(2)
    assert all(1 >= r["tail_1"] >= r["tail_2"] >= 0 and abs(r["expected_grade"] - r["tail_1"] - r["tail_2"]) < 1e-9 for r in got.values())


def test_ordinal_fit_finds_the_likelihoods_maximum():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    # A feature for each grade: without penalty the tails approach the grades.
    features = [np.sort(np.array([10 + g, 100 + rng.integers(0, 5)], np.uint32)) for g in grades]
    model = quality.fit(features, grades)
    kept = {int(p): i for i, p in enumerate(model.kept)}
    for g in range(3):
        tails = model.tails(np.array([kept[10 + g]]))
        assert all((t > 0.8) == (g > k) for k, t in enumerate(tails))
    assert (np.diff(model.cuts) > 0).all()


def test_models_without_labels(spark):
    docs, labels = frames(spark, labelled(40))
    none = labels.limit(0)
    assert not toxicity.score(docs, none).where("is_toxic").head(1)
    assert toxicity.score(docs, none, keep=True).count() == 40
    assert quality.score(docs, none).where("selected").count() == 40
    one = labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))
    assert not toxicity.score(docs, one).where("is_toxic").head(1) and quality.score(docs, one).where("selected").count() == 40
    null = labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int"))
    assert quality.score(docs, null).count() == 40 and toxicity.score(docs, null).count() == 40


def test_models_on_odd_rows(spark):
    docs, labels = frames(spark, labelled(200))
    mixed = docs.unionByName(odd(spark).select("doc_id", "text"))
    for df in (toxicity.score(mixed, labels), quality.score(mixed, labels), lm.score(mixed)):
        assert df.count() == 200 + len(ODD)
    assert toxicity.score(odd(spark), labels, keep=True).columns == odd(spark).columns
    assert toxicity.score(odd(spark), labels, keep=True).count() == len(ODD)
    for df in (toxicity.score(empty(spark), labels), quality.score(empty(spark), labels), lm.score(empty(spark)), toxicity.score(empty(spark), labels, keep=True)):
        assert df.count() == 0


def test_sample_is_bounded_and_fixed(spark):
    docs, labels = frames(spark, labelled(300))
    twice = labels.unionByName(labels)
    a = hashed.labelled_sample(docs, twice, F.col("toxic"), toxicity.extractor, id_col="doc_id", text_col="text", label_id="doc_id", sample=50)
    b = hashed.labelled_sample(docs.repartition(7), labels, F.col("toxic"), toxicity.extractor, id_col="doc_id", text_col="text", label_id="doc_id", sample=50)
    assert len(a[0]) == 50 and all((x == y).all() for x, y in zip(a[0], b[0], strict=True)) and (a[1] == b[1]).all()


def test_extractor_memo(monkeypatch):
    whole = toxicity.extractor()(b"some words and Some WORDS more")
    monkeypatch.setattr(hashed, "MEMO", 2)
    assert (toxicity.extractor()(b"some words and Some WORDS more") == whole).all()


def test_network_gradient():
    trainer = lm.Trainer(lm.start_weights())
    rng = np.random.default_rng(1)
    trainer.w = {k: v.astype(np.float64) for k, v in trainer.w.items()}
    contexts, classes = rng.integers(0, lm.CONTEXTS + 1, (6, 4)), rng.integers(0, lm.CLASSES, 6)
    got = {}
    trainer._update = lambda name, g, at=...: got.update({name: (g, at)})
    trainer._step(contexts, classes)
    loss = lambda: -lm.class_log_probs(trainer.w, contexts, classes).mean()
    for name, index in (("out", (3, int(classes[0]))), ("bias", (int(classes[1]),)), ("place", (2, 5)), ("embed", (int(contexts[2, 1]), 7))):
        w, (g, at) = trainer.w[name], got[name]
        before = w[index]
        w[index] = before + 1e-5
        high = loss()
        w[index] = before - 1e-5
        low = loss()
        w[index] = before
        own = g[np.flatnonzero(at == index[0])[0], index[1]] if name == "embed" else g[index]
        assert abs((high - low) / 2e-5 - own) < 1e-5


def test_lm_learns_context_and_slices_agree(spark, monkeypatch):
    rng = random.Random(0)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("one", "two"), ("up", "down")]
    docs = [(i, " ".join(w for _ in range(40) for w in rng.choice(pairs))) for i in range(400)]
    model = lm.fit(table(spark, docs))
    assert model.lexicon.total == 400 * 80
    known = lm.vocabulary(table(spark, docs))
    mixed = rng.sample([w for p in pairs for w in p] * 10, 80)
    good, bad = (lm.score(table(spark, [(1, t)]), model, known=known).first() for t in (docs[0][1], " ".join(mixed)))
    assert good["mean_log_likelihood"] > bad["mean_log_likelihood"] + 1
    codes = np.arange(50) % 8
    whole = lm._contexts(model.lexicon.entry[codes], model.lexicon.entries)
    monkeypatch.setattr(lm, "SLICE", 7)
    parts = list(lm._slices(model.lexicon, codes))
    assert (np.concatenate([c for c, _ in parts]) == whole).all() and (np.concatenate([b for _, b in parts]) == model.lexicon.klass[codes]).all()


def plain_score(model, counts, frequent, text):
    """The score by the definition, a word and a class at a time, in plain Python."""
    total = sum(counts.values())
    sent = sorted((w for w in counts if counts[w] * frequent >= total), key=lambda w: (-counts[w], lm._key(w)))
    half, klass, entry, before = lm.entries_for(len(counts)) // 2, {}, {}, 0
    mass = sum(counts[w] for w in sent)
    for rank, w in enumerate(sent):
        klass[w], entry[w], before = int(before / mass * lm.HEAD), rank, before + counts[w]
        assert rank < half
    for w in counts:
        if w not in klass:
            rest = lm._key(w) % 2**31 % (lm.TAIL * half)
            klass[w], entry[w] = lm.HEAD + rest % lm.TAIL, half + rest // lm.TAIL
    score, w = 0.0, {k: v.astype(float) for k, v in model.weights.items()}
    for i, word in enumerate(text):
        hidden = np.zeros(lm.SIZE)
        for j, o in enumerate((-2, -1, 1, 2)):
            near = entry[text[i + o]] if 0 <= i + o < len(text) else 2 * half
            hidden += w["embed"][near] * w["place"][j]
        z = [float(np.tanh(hidden) @ w["out"][:, c] + w["bias"][c]) for c in range(lm.CLASSES)]
        within = counts[word] / sum(counts[x] for x in counts if klass[x] == klass[word])
        score += z[klass[word]] - math.log(sum(map(math.exp, z))) + math.log(within)
    return score


@pytest.mark.parametrize("frequent", (lm.FREQUENT, 40, 1))
def test_lm_against_plain_sums(spark, frequent):
    """All words sent, some, or none: the same as by the definition, and probabilities that add up to one over all words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").select("doc_id", "text")
    counts = collections.Counter(w for r in docs.collect() for w in lm.words((r["text"] or "").encode()))
    known = lm.vocabulary(docs)
    assert sorted(map(tuple, known.collect())) == sorted((lm._key(w), n) for w, n in counts.items())
    model = lm.fit(docs, frequent=frequent)
    got = {r["doc_id"]: r for r in lm.score(docs, model, known=known).collect()}
    texts = {r["doc_id"]: lm.words((r["text"] or "").encode()) for r in docs.limit(8).collect()}
    for i, text in texts.items():
        assert got[i]["n_words"] == len(text) and abs(got[i]["log_likelihood"] - plain_score(model, counts, frequent, text)) < 1e-3 * (1 + len(text))
    if frequent == lm.FREQUENT:
        by = {r["doc_id"]: r["log_likelihood"] for r in lm.score(table(spark, [(0, "the"), *((k, w.decode()) for k, w in enumerate(counts, 1))]), model, known=known).collect()}
        assert abs(sum(math.exp(by[k]) for k in range(1, len(counts) + 1)) - 1) < 1e-3


def test_lm_counts_and_odd_cases(spark):
    rows = [(1, "a b c a"), (2, None), (3, ""), (4, "A, b")]
    model = lm.fit(table(spark, rows))
    assert model.lexicon.total == 6 and model.lexicon.counts.tolist() == [3, 2, 1]
    got = {r["doc_id"]: r for r in lm.score(table(spark, rows), model).collect()}
    assert got[2]["n_words"] == 0 and got[2]["log_likelihood"] == 0 and got[2]["mean_log_likelihood"] is None
    assert ordered((r["doc_id"], r["n_words"]) for r in got.values()) == ordered([(1, 4), (2, 0), (3, 0), (4, 2)])
    empty_model = lm.fit(empty(spark))
    assert (empty_model.weights["embed"] == lm.start_weights()["embed"]).all()


def test_lm_trains_every_word(spark):
    """One-word documents are targets too."""
    model = lm.fit(table(spark, [(0, ""), *((i, "a") for i in range(1, 8)), (8, "b")]))
    assert model.weights["bias"][0] > 0 > model.weights["bias"][int(7 / 8 * lm.HEAD)] > -1


def test_lm_does_not_depend_on_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CONTEXTS", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = lm.vocabulary(docs).cache()
    monkeypatch.setattr(lm, "entries_for", lambda distinct: 64)
    # Several shards, met in any order.
    one, other = (lm.fit(d, known=known) for d in (docs.coalesce(1), docs.repartition(7, F.rand(3))))
    assert one.lexicon.total > 2 * lm.SHARD * 64 * lm.SIZE
    assert all((one.weights[k] == other.weights[k]).all() for k in one.weights)
    known.unpersist()


def test_lm_words_have_their_own_counts(spark):
    rows = [(i, "often") for i in range(50)] + [(50, "seldom")]
    model = lm.fit(table(spark, rows), frequent=1)
    monkey = {r["doc_id"]: r["log_likelihood"] for r in lm.score(table(spark, rows), model).collect()}
    classes = [lm._key(w) % 2**31 % (lm.TAIL * (model.lexicon.entries // 2)) % lm.TAIL for w in (b"often", b"seldom")]
    assert model.lexicon.tail[classes[0]] >= 50 and model.lexicon.tail[classes[1]] >= 1 and monkey[0] != monkey[50]


def test_lm_gathers_more_from_more_words(spark):
    docs = table(spark, [(i, " ".join(f"v{i}x{j}" for j in range(1000))) for i in range(300)] + [(300, "v0x0 V0X0"), (301, None)])
    known = lm.vocabulary(docs)
    assert known.count() == 300_000 and known.agg(F.max("n"), F.sum("n")).first() == (3, 300_002)
    assert lm.entries_for(100) == lm.CONTEXTS < lm.entries_for(300_000) < lm.entries_for(30_000_000)


def test_rare_and_named_categories(spark):
    """Categories are columns of the labels; one of five members is fitted like any other."""
    rows = labelled()
    docs, _ = frames(spark, rows)
    toxic = [r for r in rows if r[3]]
    rare = {r[0] for r in toxic[:10]}
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(list(rare)), F.concat("text", F.lit(" zzrare zzrare"))).otherwise(F.col("text")))
    labels = spark.createDataFrame([(r[0], r[3], int(r[0] in rare) if r[0] not in {x[0] for x in toxic[5:10]} else None) for r in rows], "doc_id bigint, toxic int, slur int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, categories=["slur"]).collect()}
    assert list(got[rows[0][0]].asDict()) == ["doc_id", "p_slur", "p_toxic", "is_toxic"]
    known, held, others = ([got[i]["p_slur"] for i in ids] for ids in ([r[0] for r in toxic[:5]], [r[0] for r in toxic[5:10]], [r[0] for r in rows if r[0] not in rare]))
    assert min(known) > np.quantile(others, 0.95) and len(set(others)) > 1 and np.isfinite(held).all()


def test_held_out_labels_of_the_tables(spark):
    """Fitted on half of the labelled documents, judged on texts of the others that the first half doesn't have."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    seen = {r["text"] for r in docs.join(half, "doc_id").select("text").collect()}
    held = {r["doc_id"]: r for r in docs.join(labels.where("doc_id % 2 = 1"), "doc_id").collect() if r["text"] not in seen}
    judged = docs.where(F.col("doc_id").isin(list(held)))
    toxic = {r["doc_id"]: r for r in toxicity.score(docs, half).where(F.col("doc_id").isin(list(held))).collect()}
    found = [(toxic[i]["is_toxic"], bool(r["toxic"])) for i, r in held.items()]
    assert sum(a == b for a, b in found) >= 0.97 * len(found) and sum(a and b for a, b in found) >= 0.8 * sum(b for _, b in found)
    # An expected grade puts a better document above a worse one: the share of pairs in the right order.
    grade = {r["doc_id"]: r["expected_grade"] for r in quality.score(docs, half).where(F.col("doc_id").isin(list(held))).collect()}
    good, bad = (np.array([grade[i] for i, r in held.items() if r["quality"] == q]) for q in (1, 0))
    assert judged.count() == len(held) and (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean() > 0.9


def test_links_against_plain_sums(spark):
    """The chain's probabilities for the odd rows, from its weights, a feature at a time."""
    rows = labelled(300, 5)
    features = [toxicity.extractor()(t.encode()) for _, t, _, _ in rows]
    toxic = np.array([r[3] for r in rows], bool)
    chain = toxicity.fit_chain(features, toxic, toxicity.seeded(features, toxic))
    extract = toxicity.extractor().keep(chain.kept)
    for _, text, _, _ in rows[:40]:
        held = set()
        for w in text.encode().lower().split():
            plain = w.strip(b"#*")
            held |= {b"w" + plain} | {b"p" + plain[:n] for n in (4, 5) if len(plain) > n}
        places = {hashed.place(f) for f in held}
        before = []
        for link in chain.links:
            x = link.bias + sum(link.weights[c] for c, p in enumerate(chain.kept) if int(p) in places) + sum(b * p for b, p in zip(link.before, before, strict=True))
            before.append(1 / (1 + math.exp(-x)))
        assert np.allclose(chain.predict(extract(text.encode())), before, atol=1e-9)
