import os
import shutil
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from docquarry.llm import bpe, decontaminate, simhash, toxicity
from tests.llm.common import ODD, empty, odd, ordered
from tests.llm.test_secrets import brute as plain_secrets
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it made, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "byte_bpe"]
    assert all(columns == COLUMNS for _, _, columns in stages[:-1])


def test_toxicity_stage(spark, stages):
    given, made, _ = stages[0]
    judged = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ordered(made) == ordered(r for r in given if r["doc_id"] not in {j["doc_id"] for j in judged if j["is_toxic"]})


def test_simhash_stage(stages):
    given, made, _ = stages[1]
    fps = {r["doc_id"]: plain_fingerprint(r["text"].encode()) for r in given}
    distinct = sorted(set(fps.values()))
    group = plain_components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= simhash.RADIUS])
    least = {}
    for d, f in fps.items():
        least[group[f]] = min(d, least.get(group[f], d))
    assert ordered(made) == ordered(r for r in given if r["doc_id"] in least.values())


def test_decontamination_stage(spark, stages):
    given, made, _ = stages[2]
    strings = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words(r["text"].encode())
        n = min(13, len(w))
        strings.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))
    clean = []
    for r in given:
        w = decontaminate.words(r["text"].encode())
        hit = {i + k for n, known in strings.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    assert len(clean) < len(given) and ordered(made) == ordered(clean)


def test_secrets_stage(stages):
    given, made, _ = stages[3]
    texts = {r["doc_id"]: r for r in made}
    assert len(made) == len(given)
    for r in given:
        out, at = "", 0
        for a, _, kind, b in plain_secrets(r["text"]):
            if a >= at:
                out += r["text"][at:a] + f"[{kind}]"
            at = max(at, b)
        out += r["text"][at:]
        assert texts[r["doc_id"]]["text"] == out and texts[r["doc_id"]]["n_chars"] == len(out)


def test_encoding_stage(stages):
    given, made, _ = stages[4]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.ByteBPE(bpe.load_ranks(f.read()), public_tokenizers.PATTERN)
    ids = {r["doc_id"]: bytes(r["ids"]) for r in made}
    assert {d: own.decode(x).decode() for d, x in ids.items()} == {r["doc_id"]: r["text"] for r in given}
    assert all(r["n_tokens"] == len(np.frombuffer(ids[r["doc_id"]], "<u4")) for r in made)


def test_whole_pipeline(spark, stages):
    assert ordered(corpus_pipeline.run(spark, SF).collect()) == ordered(stages[-1][1])
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in __spark_entry__.queries()


def test_odd_rows_through_every_stage(spark):
    docs = odd(spark).selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, empty(spark).selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars")):
            out = stage(spark, df, SF)
            assert out.count() <= len(ODD)
            assert name == "byte_bpe" or out.columns == docs.columns


def test_entry_without_the_folders(tmp_path):
    """A copy of the repository as it is without this subpackage: the entry imports and has the other queries."""
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    n, corpus, known = done.stdout.split()
    assert int(n) > 50 and (corpus, known) == ("False", "True")


def test_entry_without_what_the_operators_need(monkeypatch):
    for module in [m for m in sys.modules if m.startswith("docquarry.llm")]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.delattr("docquarry.llm")
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    with pytest.warns(UserWarning, match="ahocorasick"):
        found = __spark_entry__.queries()
    assert not [q for q in found if q.startswith("op")] and "eq_literal" in found
