"""Byte-level BPE: exact encoding in linear time, and decoding.

A sequence of tokens is what the merges give for its bytes exactly if that holds for each adjacent pair.
So the encoder takes, from left to right, the longest token which agrees with the token before it, and
steps back where none does; positions found to lead nowhere are not tried again. Longest matches come
from an Aho-Corasick automaton over the bytes mapped to Latin-1 characters, and the verdicts on pairs are
memoised.

Defined cases: null text is empty text and gives no tokens; text is split by the tokeniser's pattern and
each piece is encoded whole, however long; repeated rows each give a row; an empty table gives no
rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docquarry.llm.common import id_and_bytes, small_batches

#: Entries of a worker's memos (pieces, pairs); a full memo is emptied, results don't depend on it.
MEMO = 1 << 18
#: Pieces longer than this are not kept in the memo.
MEMO_PIECE = 64
#: Characters from which a text's pieces are taken one after another instead of all at once.
LONG_TEXT = 1 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merged(data: bytes, ranks: dict[bytes, int], down_to: int = 1) -> list[bytes]:
    """The merges done literally, again and again the adjacent pair of lowest rank, the leftmost first, until ``down_to`` parts are left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    never = 1 << 40
    pairs = [ranks.get(data[i : i + 2], never) for i in range(len(data) - 1)]
    while len(parts) > down_to and (low := min(pairs)) < never:
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], never)
    return parts


class _Pieces(dict[str, bytes]):
    """Encoded pieces, each made when it is first asked for."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        found = self.bpe.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        #: The two tokens whose merge forms a token; none for single bytes.
        self._split: dict[int, tuple[int, int]] = {}
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.token[rank] = token
            halves = merged(token, ranks, 2)
            # A token that merges don't form is only ever a whole piece.
            if len(halves) <= 2:
                self._automaton.add_word(token.decode("latin-1"), rank)
                if len(halves) == 2:
                    self._split[rank] = ranks[halves[0]], ranks[halves[1]]
        self._automaton.make_automaton()
        self._size = [len(token) for token in self.token]
        #: Of a token the longest other one that it begins with and that merges form, -1 if there is none.
        self._shorter = [self._begins(token) for token in self.token]
        #: Verdicts by both ranks in one number.
        self._pairs: dict[int, bool] = {}
        self._pieces = _Pieces(self)

    def _begins(self, token: bytes) -> int:
        for size in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:size], -1)
            if rank >= 0 and (size == 1 or rank in self._split):
                return rank
        return -1

    def _agree(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes give these two tokens; the verdict is kept.

        They do unless something merges across the border before the tokens next to it are complete. So
        both are taken apart from the border outwards, last merge first, and at each step the border's
        neighbours must not form a token earlier than the merge just undone.
        """
        if len(self._pairs) >= MEMO:
            self._pairs.clear()
        verdict = self._pairs[left << 32 | right] = self._apart(left, right)
        return verdict

    def _apart(self, left: int, right: int) -> bool:
        before = 1 << 40
        while self.ranks.get(self.token[left] + self.token[right], before) >= before:
            # Of two merges of one rank the left one comes first.
            from_left, from_right = self._split.get(left), self._split.get(right)
            if from_left and (left > right or not from_right):
                before, left = left, from_left[1]
            elif from_right:
                before, right = right + 1, from_right[0]
            else:
                return True
        return False

    def encode_piece(self, data: bytes) -> list[int]:
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, shorter, known, agree = self._size, self._shorter, self._pairs.get, self._agree
        longest = [-1] * (len(data) + 1)
        for end, rank in self._automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank
        usable = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, last, candidate, n = 0, -1, longest[0], len(data)
        while at < n:
            while candidate >= 0:
                end = at + size[candidate]
                if usable[end]:
                    if last < 0:
                        break
                    verdict = known(last << 32 | candidate)
                    if verdict or verdict is None and agree(last, candidate):
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at, last, candidate = end, candidate, longest[end]
            elif last >= 0 and longest[at] >= 0:
                # No token here agrees with the one before, so that one must be another.
                usable[at] = 0
                candidate = out.pop()
                at -= size[candidate]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(text) < LONG_TEXT:
            pieces = self.pattern.findall(text)
        else:
            pieces = (match.group() for match in self.pattern.finditer(text))
        return b"".join(map(self._pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return detokenized(ids, self.token)


def detokenized(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[int, str], ByteBPE] = {}


def _tokenizer(data: bytes, pattern: str) -> ByteBPE:
    """One for each worker process: building the automaton takes longer than a small batch."""
    key = hash(data), pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(load_ranks(data), pattern)
    return _loaded[key]


def _vocabulary(df: DataFrame, path: str):
    """The driver reads the vocabulary once and sends it; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


Batches = Iterator[pa.RecordBatch]


def _encoder(sent, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        bpe = _tokenizer(sent.value, pattern)
        for batch in batches:
            ids = [bpe.encode(data.as_py().decode()) for data in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return run


def _decoder(sent) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        ranks = load_ranks(sent.value)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        del ranks
        for batch in batches:
            out = [detokenized(ids.as_py() or b"", table) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    return run


def _named(rows: DataFrame, run: Callable[[Batches], Batches], id_col: str, columns: str) -> DataFrame:
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    return _named(id_and_bytes(docs, id_col, text_col), _encoder(_vocabulary(docs, path), pattern), id_col, "ids binary")


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row per row: its id, ``ids`` as given, and ``decoded``, the bytes that they stand for. Null ids decode to nothing."""
    rows = small_batches(tokens).select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    return _named(rows, _decoder(_vocabulary(tokens, path)), id_col, "ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one worker process for each task, instead of one for either step."""
    sent = _vocabulary(docs, path)
    encoder, decoder = _encoder(sent, pattern), _decoder(sent)
    return _named(id_and_bytes(docs, id_col, text_col), lambda batches: decoder(encoder(batches)), id_col, "ids binary, decoded binary")
