"""The registered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontaminate, lines, lm, media, quality, secrets, simhash, suffix, toxicity
from docquarry.llm.common import documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each vector is drawn as one. The queries are edited copies of every
    hundredth: cropped, turned, toned or made smaller. For each the least image that it is a copy of, and how many there are."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return media.count_copies(media.drawn(vectors), media.drawn(vectors.where("vec_id % 100 = 0"), edit=True), id_col="vec_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(documents(spark, sf_dir))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.encode_and_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS bigint) AS n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans", "items")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeats(documents(spark, sf_dir))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    listed = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",")
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), listed.alias("spans"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5_SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
strings AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
hits AS (
  SELECT r, i, d.n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM docs, (SELECT DISTINCT n FROM strings), unnest(range(1, len(w) - n + 2)) AS u(i)) AS d
  JOIN strings USING (n, s)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def _either_case(s: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)


_ASSIGN_SQL = f"""({"|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind_sql(rank: int, kind: str, pattern: str, accept: str) -> str:
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, m[k] AS m, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM docs), unnest(range(1, len(m) + 1)) AS u(k)
  WHERE {accept}"""


OP4_SQL = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),\nspans AS ("
    + "\n  UNION ALL".join(
        _kind_sql(rank, *kind)
        for rank, kind in enumerate(
            (
                ("assign", _ASSIGN_SQL, f"length(regexp_extract(m[k], '{_ASSIGN_SQL}', 2)) >= 6"),
                ("access", "AKIA[A-Z0-9]+", "length(m[k]) >= 20"),
                ("hex", "[0-9a-f]+", "length(m[k]) >= 24"),
                ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
                ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
            )
        )
    )
    + """),
found AS (SELECT r, kind, rank, s, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS span FROM spans),
summed AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)"""
)

# Occurrences in the order of their rank; texts that agree in id and text are one document.
_SPACE = r" \t\r\x0b\f"
_SENTENCE_SQL = rf"(?:[^.!?。！？]+|[.!?]+[^\n{_SPACE}.!?。！？])+[.!?]*[。！？]?|[.!?]+[。！？]?|[。！？]"
_WORDS_SQL = rf"array_to_string(regexp_extract_all(translate(%s, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ')"
OP10_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT doc_id, r, i, p[i] AS p, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: strlen(x) + 1)), 0) AS ofs
  FROM (SELECT doc_id, r, string_split(t, chr(10)) AS p FROM docs), unnest(range(1, len(p) + 1)) AS u(i)),
whole AS (SELECT *, {_WORDS_SQL % "p"} AS w FROM lines),
sentences AS (
  SELECT doc_id, r, i, s[k] AS p, ofs + coalesce(list_sum(list_transform(s[1:k - 1], lambda x: strlen(x))), 0) AS ofs, w AS of
  FROM (SELECT *, regexp_extract_all(p, '{_SENTENCE_SQL}') AS s FROM whole WHERE w <> ''), unnest(range(1, len(s) + 1)) AS u(k)),
units AS (
  SELECT doc_id, r, i, true AS is_line, ofs + strlen(p) - strlen(ltrim(p, E'{_SPACE}')) AS start, ofs + strlen(p) AS stop, w FROM whole WHERE w <> ''
  UNION ALL
  SELECT doc_id, r, i, false, ofs + strlen(p) - strlen(ltrim(p, E'{_SPACE}')), ofs + strlen(p), w
  FROM (SELECT *, {_WORDS_SQL % "p"} AS w FROM sentences) WHERE strlen(w) < strlen(of) AND (strlen(w) >= 40 OR len(string_split(w, ' ')) >= 5)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS n FROM units),
gone AS (
  SELECT r, start, stop FROM (SELECT *, max(is_line) OVER (PARTITION BY r, i) AS line_gone FROM ranked WHERE n > 1) WHERE is_line OR NOT line_gone),
removed AS (SELECT r, list([start, stop] ORDER BY start) AS g FROM gone GROUP BY r),
spans AS (
  SELECT r, list_sum(list_transform(g, lambda x: x[2] - x[1])) AS n_removed, len(g) AS n_spans, array_to_string(list_transform(g, lambda x: x[1]::BIGINT || ':' || x[2]::BIGINT), ',') AS spans,
    list_concat([0], list_transform(g, lambda x: x[2])) AS a, list_transform(g, lambda x: x[1]) AS b FROM removed)
SELECT doc_id, strlen(t) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(t) ELSE sha256(array_to_string(list_transform(range(1, len(a) + 1), lambda k: decode(encode(t)[a[k] + 1:coalesce(b[k], strlen(t))])), '')) END AS kept_sha256,
  coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_copies": op1_media_copies,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scans": op4_secret_scans,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scores": op6_lm_scores,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES: dict[str, str] = {"op4_secret_scans": OP4_SQL, "op5_decontamination": OP5_SQL, "op10_line_dedup": OP10_SQL}
