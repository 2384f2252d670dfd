"""Document fingerprints (operator 2): SimHash in DataFrame functions only.

The terms of a text are its five-word shingles (a shorter text is one shingle); each occurrence votes +1 or -1 on
each of 64 bits with its xxhash64, so a term weighs as often as it occurs. Votes are counted eight bits to a long,
127 terms at a time, then added up in 64 counters. Fingerprints within a Hamming radius r are found by permuted
block tables: the bits are cut into r + extra blocks, each table is keyed by ``extra`` of them, and two
fingerprints within the radius must agree on all key blocks of some table. Equal fingerprints are one entry there.
``searched`` asks the tables for all fingerprints near those of a set of query rows.

Nulls and edge cases: a null text counts as empty; a text without words has the fingerprint 0; the next document of
the last is the first (of a single document: itself); a null doc_id sorts first; rows that repeat a doc_id sort by
their text; a row with a null doc_id is no query; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

WORDS = 5
CHUNK = 127
#: Rows per group of neighbours, and the most groups; a group is sorted with spilling, so more rows only take longer.
GROUP_ROWS, MOST_GROUPS = 512, 1 << 16
#: Queries of one bucket that are looked up together.
BLOCK = 64
_LOW = 0x0101010101010101  # bit 0 of every byte


def _lanes(terms: Column) -> Column:
    """Eight longs of eight byte-wide counters each, over at most CHUNK terms."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"a{k}") for k in range(8)])
    return F.aggregate(
        terms,
        zero,
        lambda s, x: F.struct(*[(s[f"a{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LOW))).alias(f"a{k}") for k in range(8)]),
        lambda s: F.array(*[s[f"a{k}"] for k in range(8)]),
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _majority(terms: Column) -> Column:
    """The bits that more than half of the terms set, as a long."""

    def add(total: Column, chunk: Column) -> Column:
        lanes = _lanes(F.slice(terms, chunk * CHUNK + 1, F.lit(CHUNK)))
        return _bound(lanes, lambda ls: F.transform(total, lambda v, i: v + F.call_function("shiftrightunsigned", F.get(ls, i % 8), F.lit(8) * F.floor(i / 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))))

    chunks = F.sequence(F.lit(0), F.floor((F.size(terms) - 1) / CHUNK).cast("int"))
    votes = F.aggregate(chunks, F.array_repeat(F.lit(0).cast("long"), 64), add)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("f"))
    return F.aggregate(
        votes,
        zero,
        lambda s, v: F.struct((s["i"] + 1).alias("i"), s["f"].bitwiseOR(F.when(v * 2 > F.size(terms), F.call_function("shiftleft", F.lit(1).cast("long"), s["i"])).otherwise(F.lit(0).cast("long"))).alias("f")),
        lambda s: s["f"],
    )


def _shingles(hashes: Column) -> Column:
    return F.when(F.size(hashes) < WORDS, F.array(F.xxhash64(hashes))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WORDS)]))
    )


def fingerprint(text: Column) -> Column:
    """The 64-bit SimHash of a text as a long."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, F.lit(0).cast("long")).otherwise(_bound(_shingles(h), _majority)))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(docs: DataFrame, payload: list[str], key: str = "doc_id") -> DataFrame:
    """Adds ``next``, a struct of ``payload`` of the next row in ascending ``key``; after the last comes the first.

    Rows are dealt to groups of neighbours, cut at values of ``key`` that occur; the first row of a group also
    visits the group before it (that of the first group the last), so each group is a window of its own.
    """
    place = F.coalesce(F.col(key), F.lit(-(2**63)))
    stats = docs.select(place.alias("k")).agg(F.count("*").alias("n"), F.min("k").alias("least")).first()
    n = max(1, min(MOST_GROUPS, stats["n"] // GROUP_ROWS))
    cuts = [stats["least"] if stats["n"] else 0]
    if n > 1:
        at = [i / n for i in range(1, n)]
        cuts = sorted({cuts[0], *docs.select(place.alias("k")).agg(F.percentile_approx("k", at, max(10_000, 4 * n)).alias("c")).first()["c"]})
    groups = [cuts[i : i + 256] for i in range(0, len(cuts), 256)]
    table = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    first = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    outer = F.size(F.filter(first, lambda x: x <= F.col("_k")))
    inner = F.size(F.filter(F.element_at(table, F.col("_outer")), lambda x: x <= F.col("_k")))
    dealt = docs.withColumn("_k", place).withColumn("_outer", outer).withColumn("_group", (F.col("_outer") - 1) * 256 + inner - 1)
    starts = F.element_at(F.element_at(table, F.col("_outer")), F.col("_group") % 256 + 1) == F.col("_k")
    before = F.pmod(F.col("_group") - 1, F.lit(len(cuts)))
    visits = F.when(starts, F.array(F.struct(F.col("_group").alias("g"), F.lit(0).alias("guest")), F.struct(before.alias("g"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_group").alias("g"), F.lit(0).alias("guest")))
    )
    w = Window.partitionBy("_g").orderBy("_guest", "_k", *payload)
    return (
        dealt.withColumn("_v", F.explode(visits))
        .withColumn("_g", F.col("_v.g"))
        .withColumn("_guest", F.col("_v.guest"))
        .withColumn("next", F.lead(F.struct(*payload)).over(w))
        .where("_guest = 0")
        .drop("_k", "_outer", "_group", "_v", "_g", "_guest")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and fp, the fingerprint
    as a long, of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("fp", fingerprint(F.col("text")))
    both = with_next(own, ["text", "fp"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next.text"), F.lit(1), F.floor(n / 2).cast("int")))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "fp",
    )


def searched(docs: DataFrame, every: int = 50, radius: int = 3) -> DataFrame:
    """``edited_pairs`` and, for the rows whose doc_id is divisible by ``every``, what the block tables find for them
    among all documents (``with_neighbours``)."""
    prints = stored(edited_pairs(docs))
    return with_neighbours(prints, F.pmod(F.col("doc_id"), F.lit(every)) == 0, radius).drop("fp")


def _table_keys(extra: int, blocks: int) -> tuple[list[int], list[Column]]:
    """Per permuted table the bits of its key blocks as a mask, and its key: the table's number and the masked bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), extra)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return signed, [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]


def within_radius(fingerprints: DataFrame, radius: int = 3, extra: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct values of ``fp`` (bigint) at a Hamming distance of at most ``radius``.

    With ``queries`` (a table with ``fp``) a is every value of the queries and b every other value of
    ``fingerprints``; without, all pairs a < b of ``fingerprints``, which in a close family are many.

    Permuted block tables: C(radius + extra, extra) copies keyed by ``extra`` blocks, about
    64 * extra / (radius + extra) bits, so a table's buckets stay small until fingerprints outnumber the keys.
    A bucket's queries are dealt to blocks of ``BLOCK``; every entry of the bucket meets the blocks, not the queries
    one by one, and a pair is told by the first table that finds it. Null fingerprints are left out.
    """
    masks, keys = _table_keys(extra, radius + extra)
    entries = fingerprints.select("fp").where("fp is not null").distinct().select("fp", F.explode(F.array(*keys)).alias("e")).select("fp", "e.table", "e.key")
    asked = entries if queries is None else queries.select("fp").where("fp is not null").distinct().select("fp", F.explode(F.array(*keys)).alias("e")).select("fp", "e.table", "e.key")
    bucket = Window.partitionBy("table", "key").orderBy("fp")
    blocks = asked.withColumn("block", F.floor((F.row_number().over(bucket) - 1) / BLOCK)).groupBy("table", "key", "block").agg(F.collect_list("fp").alias("asked"))
    # written, so that both sides of the join come from a plain exchange and a hot bucket can be split at run time
    met = stored(blocks).hint("merge").join(entries, ["table", "key"])
    earlier = F.slice(F.array(*[F.lit(m).cast("long") for m in masks]), F.lit(1), F.col("table"))

    def found(q: Column) -> Column:
        differ = q.bitwiseXOR(F.col("fp"))
        fits = (q != F.col("fp")) & (F.bit_count(differ) <= radius)
        if queries is None:
            fits = fits & (q < F.col("fp"))
        return fits & F.forall(earlier, lambda m: differ.bitwiseAND(m) != 0)

    pairs = met.select(F.explode(F.filter("asked", found)).alias("a"), F.col("fp").alias("b"))
    return pairs.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def with_neighbours(prints: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """Adds to the rows that ``asked`` picks (the others: null) what lies within ``radius`` of their ``fp``:
    ``near_fingerprints``, how many other fingerprints, and ``near_documents``, how many other rows of any of these
    or of the same fingerprint. ``prints`` is read three times and should be stored."""
    rows = prints.where("fp is not null").groupBy("fp").agg(F.count("*").alias("rows"))
    chosen = prints.where(asked).select("fp").distinct()
    pairs = within_radius(prints, radius, queries=chosen).select(F.col("a").alias("q"), F.col("b").alias("fp"))
    # a query's own fingerprint brings its copies
    own = chosen.select(F.col("fp").alias("q"), "fp")
    told = pairs.unionByName(own).join(rows, "fp").groupBy("q").agg((F.count("*") - 1).alias("near_fingerprints"), (F.sum("rows") - 1).alias("near_documents"))
    answered = prints.where(asked).join(told.withColumnRenamed("q", "fp"), "fp", "left")
    rest = prints.where(~F.coalesce(asked, F.lit(False))).withColumns({c: F.lit(None).cast("long") for c in ("near_fingerprints", "near_documents")})
    return answered.unionByName(rest)
