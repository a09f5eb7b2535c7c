"""Byte-level BPE: token ids of whole texts and back to bytes, by the tiktoken library.

The rank file is read once on the driver from a path given as a parameter and sent to the
executors (a vocabulary, so its size is fixed). Long texts are cut at places where the
pre-tokenizer's regex always ends a match: before a space that follows an ASCII letter or
digit, since no alternative of the pattern holds white space after such a character.
What has no such place is matched piece by piece, and a very long piece is merged with a
heap, so neither the regex engine nor the merge loop meets a text it cannot finish.

Null and empty texts have no ids. Texts of any length are encoded whole. Repeated rows and null
ids are carried along, and so are further columns, whatever their names. An empty table gives
an empty one. Bytes that are no UTF-8 count as replacement characters.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after which a text is cut at the next safe place.
SPAN = 1 << 16
#: Bytes from which a single match is merged with a heap.
LONG_PIECE = 2048

_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?= )")


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """Cuts of ``text`` at safe places, each at least ``span`` characters but for the last."""
    at = 0
    while len(text) - at > span:
        m = _SAFE.search(text, at + span)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one match in O(n log n): always the lowest rank, leftmost first."""
    part = [piece[i : i + 1] for i in range(len(piece))]
    after = [*range(1, len(part)), -1]
    before = [*range(-1, len(part) - 1)]
    heap = [(r, i, part[i] + part[i + 1]) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[b]))
    return [ranks[x] for x in part if x is not None]


class Codec:
    """A vocabulary with its pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = pattern
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        size = max(self.ranks.values()) + 1
        self.names = [str(k) for k in range(size)]
        self.bytes_of = [b""] * size
        for k, v in self.ranks.items():
            self.bytes_of[v] = k

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= SPAN:
            return self._span(text)
        return [x for part in spans(text) for x in self._span(part)]

    def _span(self, text: str) -> list[int]:
        if len(text) <= 2 * SPAN and not _unbroken(text):
            return self.encoding.encode_ordinary(text)
        import regex

        out: list[int] = []
        for m in regex.finditer(self.pattern, text):
            piece = m[0].encode()
            if len(piece) >= LONG_PIECE:
                out += merge_long(piece, self.ranks)
            elif (one := self.ranks.get(piece)) is not None:
                out.append(one)
            else:
                out += self.encoding._encode_single_piece(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _unbroken(text: str) -> bool:
    """Whether some aligned window is of one kind of characters throughout: a match may be very long."""
    half = LONG_PIECE // 2
    windows = (text[k : k + half] for k in range(0, len(text) - half + 1, half))
    return any((" " not in w or w.isspace()) and _one_kind().fullmatch(w) for w in windows)


@lru_cache(maxsize=1)
def _one_kind():
    import regex

    return regex.compile(r"[\p{L}\p{M}\p{N}_'’]+|[^\s\p{L}\p{N}]+|\s+")


def texts_of(column: pa.Array) -> list[str | None]:
    """Strings of a column; bytes that are no UTF-8 become replacement characters."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


@lru_cache(maxsize=4)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _shared(df: DataFrame, rank_path: str, pattern: str):
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _codec(ranks.value, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of ``df`` (``ids`` replaced where it exists) and the ids of the whole text."""
    codec = _shared(df, rank_path, pattern)
    kept = [c for c in df.columns if c != ids]
    part = df.select(*(F.col(c).alias(f"__c{k}") for k, c in enumerate(kept)), F.col(text).alias("__text"))
    schema = part.drop("__text").schema.add("__made", T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            made = pa.array([c.encode(t) for t in texts_of(b.column(b.num_columns - 1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=schema.names)

    return part.mapInArrow(run, schema).toDF(*kept, ids)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes of its ids; null ids give no bytes."""
    codec = _shared(df, rank_path, pattern)
    kept = [c for c in df.columns if c != out]
    part = df.select(*(F.col(c).alias(f"__c{k}") for k, c in enumerate(kept)), F.col(ids).alias("__ids"))
    schema = part.drop("__ids").schema.add("__made", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            made = pa.array([c.decode(x or []) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=schema.names)

    return part.mapInArrow(run, schema).toDF(*kept, out)


def digests(df: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass."""
    codec = _shared(df, rank_path, pattern)
    part = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    schema = part.select("doc_id").schema.add("n_tokens", "long", False).add("ids_sha256", "string", False).add("decoded_sha256", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            n, ids_hex, bytes_hex = [], [], []
            for t in texts_of(b.column(1)):
                ids = c.encode(t)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join([c.names[i] for i in ids]).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], names=schema.names)

    return part.mapInArrow(run, schema)
