"""N-gram Jaccard join by vertical partitioning (operator 5).

Sets are the distinct five-word shingles of whole texts. Equal sets are one class from the start. The global order of
n-grams is cut into fragments; each fragment counts the overlap of a candidate pair on its own, and the counts are
summed per pair, which gives the exact intersection.

Candidates come from the head of each set in the global order: two sets with Jaccard >= t share one of the first
n - ceil(t n) + 1 n-grams. Any total order is right; this one puts n-grams that tasks see again and again (at most
2**18 of them, those counted most) last and goes by hash otherwise, so passages that many documents share
make no candidates. The same order is cut into the fragments: ranges of hashes, and the common n-grams as the last.

Links inside a group need not be listed to know the group, so the work per group is in proportion to its documents:

1. each document is held against one leader, that with which it shares most head n-grams (every head n-gram names
   three of its documents leaders); components are formed;
2. documents of different components that share a head n-gram are compared inside the tasks by a bound that is never
   wrong (the parity of each set over some bins differs in at most as many bins as the sets have elements apart), and
   of each two components the closest pair is counted; under n-grams of at most ``FEW`` documents the pairs are listed
   as they are, before the bound; components are formed again;
3. all pairs of documents in different components that the bound leaves are counted.

Under a head n-gram the documents of its largest component are never held against each other: they are dealt to blocks
that only the documents of other components visit. ``jaccard_links`` lists every link between classes instead.

Nulls and edge cases: a null, empty or blank text has no shingles and is its own component; equal texts share theirs;
a doc_id that repeats with another text takes the component of that doc_id, whose text with the least key is
compared; repeated rows count once; a null doc_id joins only through equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, batch, bloom, hash_longs, sliced, stored
from .components import components
from .shingles import SHINGLE_WORDS, shingle_sets

#: Similarity as a percentage.
THRESHOLD = 80
FRAGMENTS = 16
#: N-grams put last in the global order: at most so many, those counted more than COMMON times.
COMMON, MOST_COMMON = 16, 1 << 18
#: Shingles counted together inside a task; bounds its memory.
WINDOW = 1_000_000
#: An n-gram of at most so many documents lists its pairs at once; most pairs share many such n-grams.
FEW = 8
#: Documents of one head n-gram compared in one task; more are cut into blocks, compared block by block.
BLOCK = 2048
#: Pairs tested at a time.
PAIRS = 1 << 18
#: Bytes of sketches gathered at a time on either side of the pairs tested.
GATHERED = 1 << 22
#: Of n pairs, a document in more than n / HOT (and than HOT_ROWS) is salted; there are fewer than HOT such documents.
HOT, HOT_ROWS = 1 << 12, 1 << 12


def _key(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128(s.tobytes()).intdigest()
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def head_size(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the global order."""
    if not len(common):
        return s
    at = np.searchsorted(common, s)
    late = common[np.minimum(at, len(common) - 1)] == s
    return np.concatenate([s[~late], s[late]])


def parity(s: np.ndarray) -> np.ndarray:
    """Parity of a set's elements over 2**k bins, 2**k >= 4 len(s) (len(s) for very large sets), as bytes."""
    bits = max(64, 1 << int(len(s) - 1).bit_length()) * (4 if len(s) <= 2048 else 1)
    seen = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(seen.astype(np.uint8), bitorder="little")


def fragments(s: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """A set cut at the fixed places of the global order: ranges of hashes, then the common n-grams."""
    late = np.zeros(len(s), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    early = s[~late]
    edges = np.array([(i << 64) // (FRAGMENTS - 1) for i in range(1, FRAGMENTS - 1)], np.uint64)
    return [*np.split(early, np.searchsorted(early, edges)), s[late]]


def class_sizes(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Per document doc_id, n, k1, k2 (a 128-bit key of the set); and rows h, c: n-grams seen c > 1 times in a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])

    def counted(window: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(window), return_counts=True)
        h, c = h[c > 1], c[c > 1]
        none = pa.nulls(len(h))
        return batch(schema, doc_id=none, n=none, k1=none, k2=none, h=_signed(h), c=c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held, seen = [], 0, set()
        for b in sliced(batches):
            n, k1, k2 = [], [], []
            for s in shingle_sets(b.column(1), k):
                key = _key(s)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                if key not in seen and len(s):
                    seen.add(key)
                    window.append(s)
                    held += len(s)
                    if held > WINDOW:
                        yield counted(window)
                        window, held, seen = [], 0, set()
            none = pa.nulls(len(n))
            yield batch(schema, doc_id=b.column(0), n=n, k1=k1, k2=k2, h=none, c=none)
        if window:
            yield counted(window)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n int, k1 bigint, k2 bigint, h bigint, c bigint")


def _over_sets(docs: DataFrame, k: int, only: Bloom | None, fields: list, sql: str, make) -> DataFrame:
    """Maps (doc_id, key, set) of the documents that ``only`` lets through to rows, by ``make``."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if only is not None and b.num_rows:
                b = b.filter(pa.array(only.has(hash_longs(b.column(0)))))
            rows = [[] for _ in fields]
            for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), k)):
                if len(s) and doc_id is not None:
                    for row in make(doc_id, s):
                        for out, x in zip(rows, row):
                            out.append(x)
            yield batch(schema, **dict(zip(schema.names, rows)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, sql)


def _once(rows: DataFrame, reps: DataFrame, repeated: bool, *key: str) -> DataFrame:
    """The rows of the representatives' sets, each once."""
    if not repeated:
        return rows.join(reps.select("doc_id"), "doc_id", "left_semi")
    return rows.join(reps.select("doc_id", "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", *key])


def _salted(pairs: DataFrame, side: str, rows: DataFrame, *key: str) -> DataFrame:
    """``pairs`` (a stored table) joined with ``rows`` on ``side``; documents in very many pairs are split."""
    limit = max(HOT_ROWS, pairs.count() // HOT)
    hot = pairs.groupBy(side).agg(F.count("*").alias("c")).where(F.col("c") > limit)
    hot = {r[side]: -(-r["c"] // limit) for r in hot.collect()}  # fewer than HOT, as limit >= pairs / HOT
    if not hot:
        return pairs.join(rows, [side, *key])
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(hot.items()), f"{side} bigint, copies bigint"))
    a = pairs.join(table, side, "left").withColumn("salt", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("a", "b"), "copies"))).drop("copies")
    b = rows.join(table, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return a.join(b, [side, "salt", *key]).drop("salt")


def close_pairs(pairs: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """a, b, na, nb: the pairs (a, b) that the parity bound leaves."""
    a, b = (heads.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
            ok = _may_link(na, nb, x.column(4).to_pylist(), x.column(5).to_pylist(), threshold)
            yield x.select(["a", "b", "na", "nb"]).filter(pa.array(ok)).cast(schema)

    both = _salted(pairs, "a", a).join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a bigint, b bigint, na int, nb int")


def _allowed(na: np.ndarray, nb: np.ndarray, threshold: int) -> np.ndarray:
    """The most elements by which two linked sets of these sizes can differ."""
    total = na.astype(np.int64) + nb
    need = -(-threshold * total // (100 + threshold))  # least intersection
    return total - 2 * need


def _may_link(na: np.ndarray, nb: np.ndarray, sa: list[bytes], sb: list[bytes], threshold: int) -> np.ndarray:
    out = np.zeros(len(na), bool)
    allowed = _allowed(na, nb, threshold)
    for i, (x, y) in enumerate(zip(sa, sb)):
        if len(x) != len(y):
            x, y = _folded(x, len(y)), _folded(y, len(x))
        apart = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
        out[i] = apart <= allowed[i]
    return out


def _folded(x: bytes, size: int) -> bytes:
    """Parities over fewer bins; bins are the low bits of a hash, so halves add up."""
    a = np.frombuffer(x, np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def overlap_links(docs: DataFrame, reps: DataFrame, repeated: bool, pairs: DataFrame, common: np.ndarray, k: int, threshold: int) -> DataFrame:
    """Vertical partitioning proper: partial overlaps per fragment of the n-gram order, summed per pair (a stored table)."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    fields = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("fragment", pa.int32()), ("part", pa.list_(pa.int64()))]

    def make(doc_id, s):
        key = _key(s)
        for i, part in enumerate(fragments(s, common)):
            if len(part):
                yield doc_id, *key, i, _signed(part)

    rows = _over_sets(docs, k, bloom(ids, "a"), fields, "doc_id bigint, k1 bigint, k2 bigint, fragment int, part array<bigint>", make)
    if repeated:
        rows = _once(rows, reps, repeated, "fragment")
    a = rows.select(F.col("doc_id").alias("a"), "fragment", F.col("part").alias("pa"))
    b = rows.select(F.col("doc_id").alias("b"), "fragment", F.col("part").alias("pb"))
    counts = _salted(pairs, "a", a).join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("overlap"))
    total = counts.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("both"))
    return stored(total.where(F.col("both") * 100 >= threshold * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (h, i, j), in tables that never cut a run."""
    names, held = ["h", "i", "j"], []
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(n).to_numpy() for n in names]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
        if held:
            last = [held[-1].column(n)[-1].as_py() for n in names]
            if last != [int(x[0]) for x in key]:
                yield pa.Table.from_batches(held)
                held = []
        if len(change):
            yield pa.Table.from_batches([*held, b.slice(0, change[-1])])
            held = []
            b = b.slice(change[-1])
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(later: np.ndarray, start: np.ndarray):
    """Index pairs (row, start[row] ...) with ``later`` partners each, at most about PAIRS at a time (or one row's)."""
    total = np.cumsum(later)
    row = 0
    while row < len(later):
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = later[row:stop]
        x = np.repeat(np.arange(row, stop), n)
        y = np.repeat(start[row:stop], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        yield x, y
        row = stop


def _ends(*keys: np.ndarray) -> np.ndarray:
    """For every row of sorted keys, where its run ends."""
    edges = np.concatenate([np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1, [len(keys[0])]])
    return np.repeat(edges, np.diff(np.concatenate([[0], edges])))


def _cross_pairs(table: pa.Table, threshold: int, closest: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of different components that the bounds leave, each under the first n-gram that their heads share.

    a, b, na, nb, the two labels and how much of the difference allowed the bound uses; of each two labels in a chunk
    only the closest pair, if ``closest``.
    """
    table = table.combine_chunks()
    get = lambda c: table.column(c).to_numpy()
    h, i, j, doc, n, label, block = (get(c) for c in ("h", "i", "j", "doc_id", "n", "label", "block"))
    first = np.frombuffer(b"".join(table.column("first").to_pylist()), np.uint64).reshape(-1, 4)
    sketches = table.column("sketch").to_pylist()
    # the sketches of each width, a row each: whole rows are gathered, no index of their bytes is made
    widths, kind = np.unique([len(s) // 8 for s in sketches], return_inverse=True)
    at, rows_of = np.zeros(len(kind), np.int64), []
    for k in range(len(widths)):
        own = np.flatnonzero(kind == k)
        at[own] = np.arange(len(own))
        rows_of.append(np.frombuffer(b"".join([sketches[o] for o in own]), np.uint64).reshape(len(own), -1))
    del sketches
    same_label = _ends(h, i, j, label)
    grams = h.view(np.uint64)
    for x, y in _pairs_of(_ends(h, i, j) - same_label, same_label):
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        keep = (100 * small.astype(np.int64) >= threshold * large) & ((i[x] == j[x]) | (block[x] != block[y]))
        x, y = x[keep], y[keep]
        # the first of a's first four that is among b's first four, if any, must be this n-gram
        same = (first[x][:, :, None] == first[y][:, None, :]).any(axis=2)
        found = same.any(axis=1)
        earliest = first[x, same.argmax(axis=1)]
        keep = ~found | (earliest == grams[x])
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        allowed, apart = _allowed(n[x], n[y], threshold), np.zeros(len(x), np.int64)
        both = kind[x] * len(widths) + kind[y]
        for c in np.flatnonzero(np.bincount(both)):
            which = np.flatnonzero(both == c)
            kx, ky = divmod(int(c), len(widths))
            least = min(widths[kx], widths[ky])
            step = max(1, GATHERED // (8 * int(max(widths[kx], widths[ky]))))
            for s in range(0, len(which), step):
                part = which[s : s + step]
                parts = []
                for side, k in ((x[part], kx), (y[part], ky)):
                    rows = rows_of[k][at[side]]
                    while rows.shape[1] > least:
                        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
                    parts.append(rows)
                apart[part] = np.bitwise_count(parts[0] ^ parts[1]).sum(axis=1, dtype=np.int64)
        ok = apart <= allowed
        x, y, used = x[ok], y[ok], apart[ok] / np.maximum(1, allowed[ok])
        swap = doc[x] > doc[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if closest and len(x):
            order = np.lexsort((doc[y], doc[x], used, hi, lo))
            order = order[np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])])]
            x, y, lo, hi, used = x[order], y[order], lo[order], hi[order], used[order]
        yield doc[x], doc[y], n[x], n[y], lo, hi, used


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("doc_id"))
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def _cells(rows: DataFrame) -> DataFrame:
    """h, i, j, block and the columns of ``rows`` (h, doc_id, n, label): every row in each cell where it meets others.

    The rows of an n-gram's largest label, and the others, are cut into blocks of about BLOCK; a cell is two blocks,
    not both of the largest label.
    """
    sizes = rows.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1").select("h", F.col("top.label").alias("major"), F.col("top.c").alias("most"), (F.col("m") - F.col("top.c")).alias("rest"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    rows = rows.join(sizes, "h").withColumn("few", blocks("rest")).withColumn("many", blocks("most")).withColumn("x", F.xxhash64("doc_id"))
    is_major = F.col("label") == F.col("major")
    rows = rows.withColumn("block", F.when(is_major, F.col("few") + F.pmod("x", "many")).otherwise(F.pmod("x", "few")).cast("int"))
    others = F.sequence(F.lit(0), F.when(is_major, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "n", "label")


_CROSS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("used", pa.float64())])


def _across(shared: DataFrame, labels: DataFrame | None, info: DataFrame, threshold: int, closest: bool) -> DataFrame:
    """a, b, na, nb of the pairs with different labels that the bounds leave, or of the closest of each two labels."""
    cells = _cells(_labelled(shared.where(F.col("m") > FEW).select("h", "doc_id", "n"), labels)).join(info, "doc_id")
    dealt = cells.repartition(F.col("h"), F.col("i"), F.col("j")).sortWithinPartitions("h", "i", "j", "label")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            for got in _cross_pairs(table, threshold, closest):
                yield batch(_CROSS, **dict(zip(_CROSS.names, got)))

    found = dealt.select("h", "i", "j", "block", "doc_id", "n", "label", "sketch", "first").mapInArrow(cross, "a bigint, b bigint, na int, nb int, lo bigint, hi bigint, used double")
    if closest:
        return found.groupBy("lo", "hi").agg(F.min(F.struct("used", "a", "b", "na", "nb")).alias("p")).select("p.a", "p.b", "p.na", "p.nb")
    return found.select("a", "b", "na", "nb").distinct()


def _few(shared: DataFrame, labels: DataFrame | None, threshold: int) -> DataFrame:
    """a, b: the pairs with different labels, of sizes that allow a link, under n-grams of at most FEW documents."""
    rows = _labelled(shared.where(F.col("m") <= FEW).select("h", "doc_id", "n"), labels)
    lists = rows.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n", "label"))).alias("ls")).where(F.size("ls") > 1)

    def meets(x, y):
        return (x["label"] != y["label"]) & (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * threshold)

    def of(x, i):
        return F.transform(F.filter("ls", lambda y, j: (j > i) & meets(x, y)), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))

    return lists.select(F.explode(F.flatten(F.transform("ls", of))).alias("p")).select("p.a", "p.b").distinct()


class _Sets:
    """What every step needs: keys of the documents, classes, representatives, heads and shared head n-grams."""

    def __init__(self, docs: DataFrame, k: int, threshold: int):
        self.docs, self.k, self.threshold = docs, k, threshold
        first = stored(class_sizes(docs, k))
        self.keys = first.where("n is not null").select("doc_id", "n", "k1", "k2")
        self.classes = stored(self.keys.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        mine = Window.partitionBy("rep").orderBy("k1", "k2")
        reps = self.classes.where("rep is not null").withColumn("r", F.row_number().over(mine)).where("r = 1").select(F.col("rep").alias("doc_id"), "k1", "k2", "n")
        self.reps = stored(reps)
        self.repeated = not self.keys.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
        # the order of n-grams: right whatever is in this bounded list
        often = first.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(f"c > {COMMON}").orderBy(F.desc("c"), "h").limit(MOST_COMMON)
        self.common = common = np.sort(np.array([r["h"] for r in often.select("h").collect()], np.int64).view(np.uint64))
        fields = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("head", pa.list_(pa.int64())), ("sketch", pa.binary()), ("first", pa.binary())]

        def make(doc_id, s):
            s, key = ordered(s, common), _key(s)
            yield doc_id, *key, len(s), _signed(s[: head_size(len(s), threshold)]), parity(s).tobytes(), np.resize(s[:4], 4).tobytes()

        rows = _over_sets(docs, k, None, fields, "doc_id bigint, k1 bigint, k2 bigint, n int, head array<bigint>, sketch binary, first binary", make)
        rows = stored(rows)
        self.heads = _once(rows.drop("head"), self.reps, True) if self.repeated else rows.select("doc_id", "n", "sketch", "first")
        self.info = self.heads.select("doc_id", "sketch", "first")
        heads = _once(rows.drop("sketch", "first"), self.reps, self.repeated)
        entries = heads.select("doc_id", "n", F.explode("head").alias("h"))
        shared = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
        self.shared = stored(entries.join(shared, "h"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        return overlap_links(self.docs, self.reps, self.repeated, pairs, self.common, self.k, self.threshold)

    def with_leaders(self) -> DataFrame:
        """a, b: every document and the leader with which it shares most head n-grams, if their sizes allow a link."""
        leaders = self.shared.groupBy("h").agg(
            F.min(F.struct("doc_id", "n")).alias("l0"),
            F.min(F.struct(F.xxhash64("doc_id").alias("x"), "doc_id", "n")).alias("l1"),
            F.max(F.struct(F.xxhash64("doc_id").alias("x"), "doc_id", "n")).alias("l2"),
        )
        leaders = leaders.select("h", F.array(*[F.struct(F.col(f"l{i}.doc_id").alias("doc_id"), F.col(f"l{i}.n").alias("n")) for i in range(3)]).alias("ls"))
        stars = self.shared.join(leaders, "h").select("doc_id", "n", F.explode(F.array_distinct("ls")).alias("l"))
        near_size = F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * self.threshold
        stars = stars.where((F.col("doc_id") != F.col("l.doc_id")) & near_size).groupBy("doc_id", F.col("l.doc_id").alias("leader")).agg(F.count("*").alias("c"))
        best = stars.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("best"))
        return best.select((-F.col("best.l")).alias("a"), F.col("doc_id").alias("b"))


def jaccard_links(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: every link between different sets, a and b (a < b) the least doc_ids of theirs.

    Lists what there is, so a group of many linked texts gives many rows; ``jaccard_components`` does not.
    """
    sets = _Sets(docs, k, threshold)
    few = close_pairs(stored(_few(sets.shared, None, threshold)), sets.heads, threshold)
    return sets.linked(stored(few.union(_across(sets.shared, None, sets.info, threshold, False)).distinct()))


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), one row per document."""
    sets = _Sets(docs, k, threshold)
    keys, classes, reps = sets.keys, sets.classes, sets.reps
    links = sets.linked(stored(close_pairs(stored(sets.with_leaders()), sets.heads, threshold)))
    labels = stored(components(links))
    few = close_pairs(stored(_few(sets.shared, labels, threshold)), sets.heads, threshold)
    tried = stored(few.union(_across(sets.shared, labels, sets.info, threshold, True)).distinct())
    links = links.union(sets.linked(tried))
    labels = stored(components(links))
    rest = _across(sets.shared, labels, sets.info, threshold, False).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = sets.linked(stored(rest))
    joined = more.select("a", "b").union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
    # rows that repeat a doc_id hold their classes together
    if sets.repeated:
        again = keys.where("n > 0 and doc_id is not null").join(classes, ["k1", "k2", "n"]).where("doc_id <> rep").join(reps.select("doc_id"), "doc_id", "left_semi")
        joined = joined.union(again.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = stored(components(joined))

    multiple = classes.where("copies > 1 or rep is null").select("k1", "k2", F.col("rep"))
    out = keys.join(multiple, ["k1", "k2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(labels.withColumnRenamed("component", "c"), "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("c", "node")).otherwise(F.col("doc_id")).alias("component_id"))
