"""Secret scans with a trigram inverted index.

Each rule is a regular expression. From it a Boolean trigram query is derived (``trigrams``), an OR of
branches of trigrams that any text with a match holds. The index has a posting for each trigram and each text that
holds it; a branch's candidates are the texts in the postings of all its trigrams, and the
expression is run on the candidates only. A rule without mandatory trigrams is run on all documents.

Everything is built-in functions: postings by substring tests on the text in lower case, their intersection
by an aggregate over branch and text that is combined before the shuffle, positions from the lengths of the pieces
between matches. A text stands in the index by its 64-bit hash, so copies are one posting and two texts with one
hash share candidate verdicts, which verification corrects. Up to ``SENT`` candidate texts are sent to the tasks that
scan, so that no text is moved; more are joined by the hash.

Defined cases: null and empty texts have no secrets; positions count code points, ends are exclusive;
repeated rows each give a row; very long texts with many matches take time in proportion to the power of 1.5 of the
matches; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint
from docquarry.llm.trigrams import Query, trigram_query

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match that ``accept`` rejects is dropped."""

    kind: str
    pattern: str
    accept: Callable[[Column], Column] | None = None

    def query(self) -> Query:
        return trigram_query(self.pattern)


#: In fixed order, which decides between spans that begin together. The first three are the base.
RULES = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    # Maximal runs of 24 or more: those of '[0-9a-f]+' without the shorter ones, which are dropped.
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
#: Most candidate texts that are sent to the tasks, 16 bytes each and what a hash table takes.
SENT = 1 << 18


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, trigrams: Sequence[str], *, text_col: str = "text") -> DataFrame:
    """The index: ``trigram`` and ``h``, the hash of a text that holds it in either case."""
    folded = docs.select(_hash(F.col(text_col)).alias("h"), F.lower(text_col).alias("folded"))
    held = F.filter(F.lit(list(trigrams)), lambda t: F.contains("folded", t))
    return folded.select(F.explode(held).alias("trigram"), "h")


def candidates(index: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """``h`` and ``rules``, a bit for each rule one of whose branches has the text in all its postings."""
    branches = [(rule, sorted(branch)) for rule, query in enumerate(queries) for branch in sorted(query, key=sorted)]
    terms: dict[str, list[Column]] = {}
    for n, (_, branch) in enumerate(branches):
        for k, trigram in enumerate(branch):
            terms.setdefault(trigram, []).append(F.struct(F.lit(n).alias("branch"), F.lit(1 << k).cast("bigint").alias("term")))
    asked = F.create_map(*(x for trigram, listed in terms.items() for x in (F.lit(trigram), F.array(*listed))))
    # The postings of a branch, each with its bit; a text that has all of them is in the intersection.
    listed = index.select("h", F.inline(F.element_at(asked, F.col("trigram"))))
    met = listed.groupBy("branch", "h").agg(F.bit_or("term").alias("terms"))
    whole, of_rule = F.lit([(1 << len(b)) - 1 for _, b in branches]), F.lit([1 << rule for rule, _ in branches])
    inside = met.where(F.col("terms") == F.element_at(whole, F.col("branch") + 1))
    return inside.groupBy("h").agg(F.bit_or(F.element_at(of_rule, F.col("branch") + 1).cast("bigint")).alias("rules"))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of longs, the join (of 0 at first) of all values up to it.

    An array that grows by one element is copied each time, so it is done in pieces of the square root of the length.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / size)).cast("int")), lambda k: F.slice(values, k * size + 1, size))
    none = F.array().cast("array<bigint>")

    def scan(array: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        grown = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.array_append(s["out"], join(s["at"], x)).alias("out"))
        return F.aggregate(array, start, grown, lambda s: s["out"])

    zero = F.lit(0).cast("bigint")
    until = scan(F.transform(pieces, lambda p: F.aggregate(p, zero, join)), zero)
    return F.flatten(F.transform(pieces, lambda p, k: scan(p, F.when(k == 0, zero).otherwise(F.get(until, k - 1)))))


def _spans(found: str, text: str, rule: Rule, rank: int) -> Column:
    """Accepted matches with their places, which follow from the lengths of the pieces between matches."""
    gaps = F.slice(F.split(text, F.lit(rule.pattern), F.lit(-1)), F.lit(1), F.size(found))
    ends = _running(F.zip_with(found, gaps, lambda m, gap: (F.length(m) + F.length(gap)).cast("bigint")), lambda a, b: a + b)
    span = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), (rule.accept(m) if rule.accept else F.lit(True)).alias("ok"))
    spans = F.transform(F.filter(F.zip_with(found, ends, span), lambda x: x["ok"]), lambda x: x.dropFields("ok"))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"


def _searched(docs: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` and ``found``, the spans in its text."""
    queries = [rule.query() for rule in rules]
    trigrams = sorted({t for query in queries for branch in query for t in branch})
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if trigrams:
        chosen = checkpoint(candidates(postings(docs, trigrams, text_col=text_col), queries))
        chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
        rows = rows.join(chosen, _hash(F.col("text")) == F.col("h"), "left")
    nothing = F.array().cast("array<string>")

    def matches(n: int, rule: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        return F.when(F.col("rules").bitwiseAND(1 << n) != 0, found).otherwise(nothing) if queries[n] else found

    matched = rows.select("row", "text", *(matches(n, rule).alias(f"m{n}") for n, rule in enumerate(rules)))
    spans = F.concat(*(_spans(f"m{n}", "text", rule, n) for n, rule in enumerate(rules)))
    return matched.select("row", "text", F.array_sort(spans).alias("found"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: its id and ``found``, an array of ``start``, ``rank`` (place of the rule), ``kind``, ``end`` by start and rank."""
    found = _searched(docs.select(id_col, text_col), rules, text_col)
    return found.select(F.col("row")[id_col].alias(id_col), "found")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_secrets`` in figures: counts of the base kinds, the digest of the base spans, all spans as text."""
    found = find_secrets(docs, id_col=id_col, text_col=text_col)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return found.select(id_col, *map(of, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows with each run of overlapping spans in the text replaced by ``[kind]`` of its first; a null text stays null."""
    found = _searched(docs, rules, text_col)
    # Four bytes a code point, so that a piece is found without counting; the mark before it keeps one of its own.
    wide, mark = F.encode("text", "UTF-32"), F.lit(bytes([0, 0, 0xFE, 0xFF]))
    piece = lambda a, b: F.decode(F.concat(mark, F.substring(wide, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int"))), "UTF-32")
    ends = _running(F.transform("found", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    # A span that begins inside those before it only lengthens them.
    first = F.filter(
        F.zip_with("found", F.array_prepend(F.slice(ends, F.lit(1), F.size("found") - 1), F.lit(0).cast("bigint")), lambda x, before: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), before.alias("before"))),
        lambda x: x["start"] >= x["before"],
    )
    parts = F.transform(first, lambda x: F.concat(piece(x["before"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
    clean = F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), F.length("text")))
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("row")[text_col])
    return found.select(*(text.alias(x) if x == text_col else F.col("row")[x].alias(x) for x in docs.columns))
