import random

import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import simhash
from docquarry.llm.components import connected_components
from tests.llm.common import ODD, SF, empty, odd, ordered, table, texts


def plain_fingerprint(text):
    w = text.lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute(docs):
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    distinct = sorted({f for _, f in fps})
    group = plain_components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in fps:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    return ordered((d, f"{f:016x}", least.get(group[f])) for d, f in fps)


def test_fingerprints(monkeypatch):
    rng = random.Random(0)
    made = [" ".join(rng.choices(["Aa", "b", "É", "d e", "f,"], k=n)).encode() for n in range(40)] + [(t or "").encode() for _, t in ODD]
    want = [plain_fingerprint(t) for t in made]
    assert [simhash.fingerprint(t) for t in made] == want
    monkeypatch.setattr(simhash, "SLICE", 3)
    assert [simhash.fingerprint(t) for t in made[:40]] == want[:40]


def test_small_tables(spark):
    assert ordered(simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == brute(texts(spark))
    assert ordered(simhash.near_duplicates(odd(spark)).collect()) == brute([(d, (t or "").encode()) for d, t in ODD])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def fingerprints(n, seed):
    """Clusters of close fingerprints with chains between, negative ones as well."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_join_what_brute_force_joins(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    for seed in range(2):
        fps = fingerprints(300, seed)
        close = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
        links = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint")).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
        assert plain_components(fps, links) == plain_components(fps, close)


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(400, i) for i in range(401, 450)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert {n: got.get(n, n) for n in nodes} == plain_components(nodes, [(a, b) for a, b in links if a in nodes and a != b])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each(spark):
    found = brute([(d, (t or "").encode()) for d, t in ODD])
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    groups = {plain_fingerprint((t or "").encode()): None for _, t in ODD}
    assert len(got) == len(groups) and all(r in ODD for r in got)
    assert {d for d, _ in got if d is not None} == {c for _, _, c in found if c is not None}
    # The same id on two texts: each text's component keeps its row.
    twice = table(spark, [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, "one two three four five"), (2, "one two three four five")])
    assert ordered(simhash.one_of_each(twice).collect()) == ordered([(1, "one two three four five"), (1, "six seven eight nine ten")])
    assert simhash.one_of_each(empty(spark)).count() == 0
    with_map = twice.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert simhash.one_of_each(with_map).count() == 2
