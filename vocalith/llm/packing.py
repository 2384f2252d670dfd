"""Best-fit packing (operator 1).

Best-fit decreasing over all pieces of the corpus: pieces in order of falling length, each put into the open
sequence with the least room that still holds it. Pieces of one length are interchangeable, so the plan is made on
the exact histogram of lengths, which has at most ``capacity`` entries whatever the corpus: open sequences with the
same room form one class, a segment tree over the rooms 0..capacity finds the tightest class that holds a length in
logarithmic time, and whole runs of equal pieces move at once. The plan is the one that best-fit decreasing makes
piece by piece. Each piece then looks up its place from its length and its rank among the pieces of that length;
ranks come from counts per (partition, length), so no length is gathered in one task.

Nulls and edge cases: a null or empty text is the single id ``eos``; repeated rows and repeated doc_ids are packed
as separate documents (``piece`` restarts per row); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored
from .tokens import encode

CAPACITY = 2048

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class RoomTree:
    """A segment tree over rooms 0..capacity that holds how many open sequences have each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some open sequence has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on counts per length.

    Rows of the result: length, first rank, number of pieces, first sequence, pieces per sequence, first offset.
    The piece of rank r goes to sequence ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    tree, runs = RoomTree(capacity), {}
    out, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            tree.add(room, n)
            runs.setdefault(room, deque()).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -n)
            # the tightest sequence stays the tightest while it holds one more piece, so it fills before the next
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            if full < n and left:
                out.append((length, rank, left, first + full, per, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                tree.add(room, n - full)
                runs.setdefault(room, deque()).appendleft((first + full, n - full))
    return np.array(out, np.int64).reshape(-1, 6)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``capacity`` but the first, which takes what is over."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, eos: int = 0) -> DataFrame:
    """Encodes whole texts and cuts those of more than ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or "", tokenizer, pattern), eos).astype("<u4")
                for i, (s, n) in enumerate(cut(len(ids), capacity)):
                    doc.append(doc_id)
                    piece.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield batch(_PIECES, doc_id=doc, piece=piece, start=start, length=length, ids_crc32=crc)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, eos: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = stored(pieces(docs, tokenizer, pattern, capacity, eos).withColumn("part", F.spark_partition_id()))
    counts = stored(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    # at most one row per length up to the capacity
    places = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = made.join(before, ["part", "length"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    )
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    order = np.lexsort((places[:, 1], places[:, 0]))
    places = places[order]
    top = int(places[:, 2].sum()) + 1
    keys = places[:, 0] * top + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = places[np.searchsorted(keys, length * top + rank, "right") - 1]
            r = rank - at[:, 1]
            got = {c: b.column(b.schema.get_field_index(c)) for c in _PIECES.names}
            yield batch(schema, **got, sequence_id=at[:, 3] + r // at[:, 4], offset=at[:, 5] + r % at[:, 4] * length)

    return ranked.select(*_PIECES.names, "rank").mapInArrow(run, _PIECES_SQL + ", sequence_id bigint, offset bigint")
