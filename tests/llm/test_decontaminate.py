import random
import subprocess
import sys

from docquarry.llm import decontaminate
from tests.llm.common import ODD, empty, odd, ordered, table


def brute(docs, items, window=13):
    strings = {}
    for item, text in items:
        w = decontaminate.words((text or "").encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w = decontaminate.words((text or "").encode())
        hit, found = set(), set()
        for s, ids in strings.items():
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i : i + len(s)]) == s:
                    hit.update(range(i, i + len(s)))
                    found |= ids
        out.append((doc, len(w), len(hit), str(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return ordered(out)


def figures(df):
    return ordered((r["doc_id"], r["n_words"], r["n_hit"], str(r["items"]), r["contaminated"]) for r in df.collect())


def made(n, words, least, most, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(least, most)))) for i in range(n)]


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_agrees_with_plain_search(spark):
    # Few words, so that test strings overlap, repeat and begin alike.
    for window, vocabulary in ((3, ["a", "B", "é", "c1"]), (5, ["x", "y"]), (13, ["q", "r"])):
        items = [*made(12, vocabulary, 0, window + 2, 1), (None, "a B é x y"), (3, None), (11, "x x"), (11, "x x")]
        docs = made(60, [*vocabulary, "other", "words"], 0, 40, 2)
        found = decontaminate.contamination(table(spark, docs), benchmark(spark, items), window=window)
        assert figures(found) == brute(docs, items, window)


def test_blocks_make_no_difference(spark):
    items, docs = made(30, ["a", "b", "c"], 1, 9, 4), made(40, ["a", "b", "c", "d"], 0, 60, 5)
    whole = decontaminate.contamination(table(spark, docs), benchmark(spark, items), window=4)
    blocks = decontaminate.contamination(table(spark, docs), benchmark(spark, items), window=4, block_bytes=40)
    assert figures(blocks) == figures(whole) == brute(docs, items, 4)


def test_odd_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog it then goes home to sleep for"), (2, "漢 naïve"), (3, "lorem")]
    found = decontaminate.contamination(odd(spark), benchmark(spark, items))
    assert figures(found) == brute(ODD, items)
    kept = decontaminate.keep_clean(odd(spark), benchmark(spark, items))
    assert kept.columns == odd(spark).columns
    dirty = [r[4] for r in brute(ODD, items)].count(True)
    assert dirty > 2 and kept.count() == len(ODD) - dirty
    assert figures(decontaminate.contamination(odd(spark), benchmark(spark, items).limit(0))) == brute(ODD, [])
    assert decontaminate.contamination(empty(spark), benchmark(spark, items)).count() == 0


def test_memory_of_a_block():
    """A full block of words that are nearly all different, built in a process of its own: what it takes beside the process."""
    code = """
import random, resource
from docquarry.llm import decontaminate as d
rng = random.Random(0)
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
items = [(str(i), b" ".join(b"%x" % rng.getrandbits(26) for _ in range(300))) for i in range(d.BLOCK_BYTES // 2250)]
before = used()
block = d.Block(items)
assert block.find(items[7][1]) == (300, [(0, 300)], {"7"})
print(used() - before)
"""
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 200


def test_a_block_is_released_before_the_next(spark, monkeypatch):
    items, docs = made(40, ["a", "b", "c"], 3, 9, 4), made(30, ["a", "b", "c", "d"], 0, 60, 5)
    alive, most = [], []

    def counted(real):
        def broadcast(value):
            sent = real(value)
            if isinstance(value, decontaminate.Block) and value.items:
                alive.append(sent)
                most.append(len(alive))
                destroy = sent.destroy
                sent.destroy = lambda *a, **b: (alive.remove(sent), destroy(*a, **b))
            return sent

        return broadcast

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted(spark.sparkContext.broadcast))
    found = decontaminate.contamination(table(spark, docs), benchmark(spark, items), window=4, block_bytes=120)
    assert figures(found) == brute(docs, items, 4) and len(most) >= 4 and max(most) == 1
