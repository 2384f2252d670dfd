"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 4).

A piece (one match of the split pattern) is halved until a half has ``LEAF`` bytes, halves are encoded, and
neighbours are joined on the way up. A join re-encodes a window of bytes around the boundary that grows, side by
side, until it provably stabilises: a row of tokens is the encoding of its bytes exactly when every two
neighbours are, that is when encoding the bytes of two tokens gives back those two. Both parts are encodings, so
only the neighbours at the edges of the re-encoded window have to be tested; all tokens outside it stay. Decoding
concatenates the bytes of halves up the same tree.

Nulls and edge cases: a null text counts as empty (no ids; the digests are those of no bytes); any Unicode text is
encoded whole; special-token strings are ordinary text; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch
from .tokens import parts, rank_file

LEAF = 8
#: Entries of each worker's memory of pieces, halves and pairs; when full it starts anew.
MEMORY = 300_000
#: Tokens whose bytes a leaf of the decoding tree joins at once.
JOINED = 1 << 12
#: Longer pieces are not remembered.
REMEMBERED_BYTES = 48


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The encoding of some bytes: the pair of least rank, the leftmost first, is merged until none is left."""
    if len(data) > 64:
        return _merge_many(ranks, data)
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_many(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The same with a heap of pairs, for windows that have grown: n log n."""
    n = len(data)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(data[i : end[j]])
            if r is not None:
                heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue  # a part of this pair has changed since
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


def concatenated(pieces: list[bytes], first: int = 0, last: int | None = None) -> bytes:
    """The bytes of pieces, halves joined up the tree from leaves of ``JOINED`` pieces."""
    last = len(pieces) if last is None else last
    if last - first <= JOINED:
        return b"".join(pieces[first:last])
    half = (first + last) // 2
    return concatenated(pieces, first, half) + concatenated(pieces, half, last)


class Bpe:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes = {i: b for b, i in ranks.items()}
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, side by side, are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = merge(self.ranks, self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = merge(self.ranks, b"".join(self.bytes[x] for x in left[-i:] + right[:j]))
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i = min(len(left), i * 2) if grow_left else i
            j = min(len(right), j * 2) if grow_right else j

    def encode(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= self.leaf:
            found = self.leaves.get(data)
            if found is None:
                if len(self.leaves) >= MEMORY:
                    self.leaves.clear()
                found = self.leaves[data] = merge(self.ranks, data) if n else []
            return found
        half = n // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        return concatenated(list(map(self.bytes.__getitem__, ids)))


class Written(dict):
    """Piece of text to its ids as decimal text with a leading space, worked out on first sight."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> str:
        data = piece.encode()
        out = "".join(f" {i}" for i in self.bpe.encode(data))
        if len(data) <= REMEMBERED_BYTES:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = out
        return out


_state: dict = {}


def _worker(path: str, pattern: str):
    if (path, pattern) not in _state:
        import regex

        bpe = Bpe(rank_file(path))
        _state[path, pattern] = regex.compile(pattern), Written(bpe), bpe, {str(i): b for i, b in bpe.bytes.items()}
    return _state[path, pattern]


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """The ids of a whole text."""
    pat, written, _, _ = _worker(path, pattern)
    return [int(x) for part in parts(text) for x in "".join(map(written.__getitem__, pat.findall(part))).split()]


def digests(text: str, path: str, pattern: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes decoded from that text."""
    pat, written, bpe, back = _worker(path, pattern)
    n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), 1
    for part in parts(text):
        line = "".join(map(written.__getitem__, pat.findall(part)))
        tokens = line.split()
        n += len(tokens)
        ids.update(line[gap:].encode())
        gap = 0 if n else 1
        decoded.update(concatenated(list(map(back.__getitem__, tokens))))
    return n, ids.hexdigest(), decoded.hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digests(x.as_py() or "", path, pattern) for x in b.column(1)]
            yield batch(_OUT, doc_id=b.column(0), n_tokens=[x[0] for x in got], ids_sha256=[x[1] for x in got], decoded_sha256=[x[2] for x in got])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, doc_id=b.column(0), ids=[encode_text(x.as_py() or "", path, pattern) for x in b.column(1)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are not UTF-8 become U+FFFD."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(rank_file(path))
        for b in batches:
            yield batch(schema, doc_id=b.column(0), text=[bpe.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id bigint, text string")
