import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docquarry.llm import bpe, queries
from tests.llm.common import ODD, SF, empty, odd, ordered, texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_that_of_the_merges(ranks, reference):
    own, rng = bpe.ByteBPE(ranks, public_tokenizers.PATTERN), random.Random(3)
    parts = ["ab", "the", " ", "  ", "\n", "é", "ñ", "9", "a", "A", "=", "漢", "😀", "aaaa", "ing", "'s", " ", "\x1c"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choices("abcdeghinorst", k=rng.randint(0, 200))) for _ in range(1500)]
    for text in [*made, "x" * 20_000, "ab" * 20_000, " " * 5_000, *(t for _, t in ODD if t)]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_literal_merges_on_small_vocabularies():
    rng = random.Random(5)
    for _ in range(60):
        # Tokens that merges may or may not reach.
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 20:
            t = b"".join(rng.choices(tokens, k=2))
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        odd_one = bytes(rng.choices(b"abc", k=5))
        small = {t: i for i, t in enumerate(dict.fromkeys([*tokens, odd_one]))}
        own = bpe.ByteBPE(small, r"[\s\S]+")
        for _ in range(60):
            data = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
            want = [data] if data in small else bpe.merged(data, small)
            assert [own.token[i] for i in own.encode_piece(data)] == want


def test_long_texts_and_full_memos(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "MEMO", 50)
    own = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} näive" for i in range(500))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_query(spark, reference):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc, text in texts(spark):
        ids = reference.encode_ordinary(text.decode())
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text)))
    assert ordered(queries.op3_byte_bpe(spark, SF).collect()) == ordered(want)


def test_odd_rows(spark):
    pattern = public_tokenizers.PATTERN
    got = bpe.encode_and_decode(odd(spark), PATH, pattern).collect()
    assert ordered((r["doc_id"], bytes(r["decoded"])) for r in got) == ordered((d, (t or "").encode()) for d, t in ODD)
    apart = bpe.decode(bpe.encode(odd(spark), PATH, pattern), PATH).collect()
    assert ordered((r["doc_id"], bytes(r["ids"])) for r in apart) == ordered((r["doc_id"], bytes(r["ids"])) for r in got)
    assert bpe.encode(empty(spark), PATH, pattern).count() == 0
    assert bytes(bpe.decode(spark.sql("SELECT 1L AS doc_id, CAST(NULL AS binary) AS ids"), PATH).first()["decoded"]) == b""
