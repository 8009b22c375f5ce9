"""Repeated substrings and repeated lines."""

import hashlib
import random
import re

import numpy as np
import pytest

from docquarry.llm import difference_cover, lines, suffix
from tests.llm.common import ODD, SF, empty, odd, ordered, table, texts


def plain_substrings(docs, length):
    count = {}
    for _, t in docs:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for d, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def figures(df):
    return ordered((r["doc_id"], r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(1500):
        a = [rng.randint(1, rng.choice([1, 2, 3, 250])) for _ in range(rng.randint(0, 40))]
        assert difference_cover.suffix_array(np.array(a, np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    big = [rng.choice([1, 2**30 + 5, 2**30 + 6]) for _ in range(400)]
    assert difference_cover.suffix_array(np.array(big, np.int64)).tolist() == sorted(range(400), key=lambda i: big[i:])


def test_anchors_depend_on_the_window_only(monkeypatch):
    rng = random.Random(1)
    for size in (1 << 20, 60):
        monkeypatch.setattr(suffix, "SLICE", size)
        anchors = suffix.Anchors(20, 6)
        place = {}
        for _ in range(30):
            text = bytes(rng.choices(b"ab", k=rng.randint(0, 150)))
            key, anchor, first, last = anchors.contexts(text)
            covered = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
            assert covered == list(range(len(text) - 19))
            for k, p, a, b in zip(key, anchor, first, last, strict=True):
                for i in range(a, b + 1):
                    assert place.setdefault(text[i : i + 20], (k, p - i)) == (k, p - i)


@pytest.mark.parametrize(("local", "seed"), [(1 << 20, 0), (300, 1), (40, 2)])
def test_ranks_over_all_tasks(spark, local, seed):
    """The order of all suffixes, through several levels of the recursion and in one task."""
    rng = random.Random(seed)
    strings = [[rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 40]))] for _ in range(30)] + [[2] * 31, [1, 2, 3] * 12, [1, 2, 3] * 12]
    df = spark.createDataFrame(list(enumerate(strings)), "string bigint, symbols array<bigint>")
    got = {r["string"]: r["values"] for r in difference_cover.suffix_ranks(df, local).collect()}
    ranked = sorted((rank, strings[k][i:]) for k, ranks in got.items() for i, rank in enumerate(ranks))
    assert [r for r, _ in ranked] == list(range(sum(map(len, strings)))) and {k: len(v) for k, v in got.items()} == {k: len(s) for k, s in enumerate(strings) if s}
    assert all(a <= b for (_, a), (_, b) in zip(ranked, ranked[1:], strict=False))


def test_windows_over_all_tasks(spark):
    rng = random.Random(4)
    data = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(40)]
    count = {}
    for d in data:
        for i in range(len(d) - 7):
            count[d[i : i + 8]] = count.get(d[i : i + 8], 0) + 1
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "string bigint, data binary")
    got = {tuple(r) for r in difference_cover.repeated_windows(df, 8, local=200).collect()}
    assert got == {(k, i) for k, d in enumerate(data) for i in range(len(d) - 7) if count[d[i : i + 8]] > 1}
    assert difference_cover.repeated_windows(df.limit(0), 8).count() == 0


@pytest.mark.parametrize(("crowd", "large"), [(2048, 1 << 16), (1, 1 << 16), (1, 3)])
def test_substrings_of_random_texts(spark, crowd, large, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 500)
    monkeypatch.setattr(difference_cover.suffix_ranks, "__defaults__", (800,))
    monkeypatch.setattr(difference_cover.repeated_windows, "__defaults__", (800,))
    rng = random.Random(2)
    pieces = ["".join(rng.choices("abcé", k=rng.randint(5, 90))) for _ in range(25)]
    docs = [(i, "".join(rng.choice(pieces)[rng.randint(0, 6) :] for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(100, "a" * 300), (101, "ab" * 90), (102, None), (103, "same text twice " * 4), (103, "same text twice " * 4), (None, pieces[0] * 3)]
    data = [(d, (t or "").encode()) for d, t in docs]
    got = suffix.without_repeats(table(spark, docs), length=24, piece=7, crowd=crowd, large=large)
    assert figures(got) == plain_substrings(data, 24)


def test_substrings_of_the_tables(spark):
    assert figures(suffix.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"))) == plain_substrings(texts(spark), 200)
    assert figures(suffix.without_repeats(odd(spark))) == plain_substrings([(d, (t or "").encode()) for d, t in ODD], 200)
    assert suffix.without_repeats(empty(spark)).count() == 0


def plain_units(data):
    """Start, stop and words of the units, by characters."""
    text, ascii_words = data.decode(), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    place = lambda i: len(text[:i].encode())
    out, at = [], 0

    def unit(i, j):
        while i < j and text[i] in " \t\r\x0b\f":
            i += 1
        return place(i), place(j), ascii_words.findall(text[i:j].translate(lower))

    for line in text.split("\n"):
        whole = unit(at, at + len(line))
        if whole[2]:
            out.append(whole)
            cuts = [0]
            for k, c in enumerate(line, 1):
                following = line[k : k + 1]
                if c in "。！？" or (c in ".!?" and (not following or following in " \t\r\x0b\f")) or (c in ".!?" and following in "。！？"):
                    if not (c in ".!?" and following and following in "。！？"):
                        cuts.append(k)
            cuts.append(len(line))
            for i, j in zip(cuts, cuts[1:]):
                u = unit(at + i, at + j)
                if u[2] != whole[2] and (len(u[2]) >= 5 or len(" ".join(u[2]).encode()) >= 40):
                    out.append(u)
        at += len(line) + 1
    return out


def plain_lines(docs):
    seen, out = set(), []
    # Null ids rank first; rows that agree in id and text are one document.
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        spans = []
        for start, stop, unit in plain_units(t):
            if tuple(unit) in seen:
                spans.append((start, stop))
            seen.add(tuple(unit))
        spans = sorted(x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans))
        out += [(d, t, spans)] * docs.count((d, t))
    return out


def test_lines(spark):
    sentence = "One line of more than five words."
    docs = [
        (1, f"{sentence}\nAnother line that is only here, once and no more.\n  {sentence.upper()} tail"),
        (2, f"short line.\n{sentence}"),
        (3, f"short line. {sentence[:-1]}"),
        (4, None),
        (5, ""),
        (6, f"{sentence}\n" * 300),
        (6, f"{sentence}\n" * 300),
        (7, "É à la carte dix mots. é à la carte dix mots.\nAll rights reserved\n这是三份文件里都有的同一句话。"),
        (8, "All rights reserved"),
        (9, "这是三份文件里都有的同一句话。新的\nall rights reserved!"),
        (10, "一个用来测试没有空格的文字的很长的句子。再来一句话"),
        (11, "Kept 3.14 only here. 一个用来测试没有空格的文字的很长的句子。"),
    ]
    data = [(d, (t or "").encode()) for d, t in docs]
    for df, rows in ((table(spark, docs), data), (odd(spark).where("doc_id IS NOT NULL"), [(d, (t or "").encode()) for d, t in ODD if d is not None]), (spark.read.parquet(f"{SF}/documents.parquet"), texts(spark))):
        want = []
        for d, t, spans in plain_lines(rows):
            kept, at = b"", 0
            for a, b in spans:
                kept, at = kept + t[at:a], b
            want.append((d, str(spans), kept + t[at:]))
        got = lines.without_repeats(df).collect()
        assert ordered((r["doc_id"], str([tuple(x) for x in r["removed"]]), bytes(r["kept"])) for r in got) == ordered(want)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in lines.without_repeats(table(spark, docs)).collect()}
    assert got[3] == "short line. " and got[2] == "short line.\n" and got[1].startswith(sentence)
    assert got[8] == "" and got[9] == "新的\n" and got[11] == "Kept 3.14 only here. "
    assert lines.without_repeats(odd(spark)).count() == len(ODD) and lines.without_repeats(empty(spark)).count() == 0


def test_units():
    data = b"a b c. One two three four five! six\n  seven eight 9.10 eleven\n...\n"
    assert [(a, b) for a, b, _ in lines.units(data)] == [(0, 35), (7, 31), (38, 61)]
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["word ", "a", "é", ".", "!", "。", "？", " ", "\n", "\t", "句子句子句子句子", "one two three four five"], k=rng.randint(0, 40)))
        assert [(a, b) for a, b, _ in lines.units(text.encode())] == [(a, b) for a, b, _ in plain_units(text.encode())], text
