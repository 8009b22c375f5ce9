"""A corpus pipeline: every stage works on all that the one before it kept, and hands on the columns of ``documents``.

The last stage returns the tokens instead. Null and empty texts are documents like any other: not toxic, near-copies
of each other, clean, without secrets or tokens; of repeated rows one stays; columns beyond those of ``documents`` go along up to the
last stage; very long texts are handled whole; an empty table stays empty through all stages. SQL can express neither the fitted model nor the tokeniser;
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontaminate, secrets, simhash, toxicity
from docquarry.llm.common import documents, remove, shared_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    return toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark text in a twentieth of their words."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and ``n_chars`` as it is then."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    n = F.expr("CAST(octet_length(ids) DIV 4 AS bigint) AS n_tokens")
    return tokens.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each result but the last is written to the shared folder and read again, so that no stage is computed
    twice and none depends on executors that are gone; what a stage has read is deleted once it is written."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
