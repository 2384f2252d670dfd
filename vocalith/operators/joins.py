"""Joins: last-wins builds, attachment with coverage, tiered self-joins, theta anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that of the greatest ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def attach(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Left outer join with the last right row of each key; adds ``matched``."""
    build = last_wins(right, keys, order).select(*keys, *columns, F.lit(True).alias("_hit"))
    return left.join(build, keys, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seen_unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``candidates`` with ``is_seen``: whether the key is in ``seen``."""
    known = seen.select(key).distinct().withColumn("_s", F.lit(True))
    return candidates.join(known, key, "left").withColumn("is_seen", F.coalesce("_s", F.lit(False))).drop("_s")


def pair_prompts(df: DataFrame, key: str, speaker: str, recording: str, duration: str, least: float, bucket: Column) -> DataFrame:
    """For every clip another clip of its speaker as prompt.

    Tier 1: another recording and long enough; tier 2: long enough; tier 3: any. Of the n clips in the best tier that is
    not empty, the one at floor(bucket * n) in key order. Clips of speakers with one clip drop out.

    No pairs are formed: in key order each class of clips (speaker; speaker and long; speaker, recording and long) is
    numbered, a clip's pool size and the number in it of its prompt follow by counting, and one equi-join fetches it.
    """
    long = F.col(duration) >= least
    w = lambda *by: Window.partitionBy(*by)
    n = lambda cond, *by: F.count(F.when(cond, 1)).over(w(*by))
    before = lambda cond, *by: F.count(F.when(cond, 1)).over(w(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    base = df.select(F.col(key), F.col(speaker).alias("_sp"), F.col(recording).alias("_rec"), long.alias("_long"), bucket.alias("_b"))
    base = base.select(
        "*",
        n(F.lit(True), "_sp").alias("_n_all"),
        n(F.col("_long"), "_sp").alias("_n_long"),
        n(F.col("_long"), "_sp", "_rec").alias("_n_own"),
        before(F.lit(True), "_sp").alias("_i_all"),
        before(F.col("_long"), "_sp").alias("_i_long"),
        before(F.col("_long"), "_sp", "_rec").alias("_i_own"),
    )
    self_long = F.col("_long").cast("int")
    n1, n2, n3 = F.col("_n_long") - F.col("_n_own"), F.col("_n_long") - self_long, F.col("_n_all") - 1
    tier = F.when(n1 > 0, 1).when(n2 > 0, 2).when(n3 > 0, 3)
    size = F.when(n1 > 0, n1).when(n2 > 0, n2).otherwise(n3)
    rows = base.withColumn("tier", tier).where("tier is not null").withColumn("_k", F.floor(F.col("_b") * size).cast("long"))
    # tiers 2 and 3: the k-th of all but the clip itself
    at2 = F.col("_k") + F.when(F.col("_long") & (F.col("_k") >= F.col("_i_long")), 1).otherwise(0)
    at3 = F.col("_k") + F.when(F.col("_k") >= F.col("_i_all"), 1).otherwise(0)
    # tier 1: the k-th long clip outside the recording comes after those own long clips that have at most k others
    # before them; counted by one window over own clips and questions in the order of that number
    wanted = rows.select(F.col(key), "_sp", "_rec", "tier", "_k", at2.alias("_at2"), at3.alias("_at3"))
    own = base.where("_long").select("_sp", "_rec", (F.col("_i_long") - F.col("_i_own")).alias("_v"), F.lit(0).alias("_ask"))
    asked = wanted.where("tier = 1").select("_sp", "_rec", F.col("_k").alias("_v"), F.lit(1).alias("_ask"), F.col(key), "tier")
    counted = F.count(F.when(F.col("_ask") == 0, 1)).over(w("_sp", "_rec").orderBy("_v", "_ask").rowsBetween(Window.unboundedPreceding, -1))
    first = own.unionByName(asked, allowMissingColumns=True).withColumn("_at", F.col("_v") + counted).where("_ask = 1").select(F.col(key), "_sp", "tier", "_at")
    second = wanted.where("tier = 2").select(F.col(key), "_sp", "tier", F.col("_at2").alias("_at"))
    third = wanted.where("tier = 3").select(F.col(key), "_sp", "tier", F.col("_at3").alias("_at"))
    longs = base.where("_long").select("_sp", F.col("_i_long").alias("_at"), F.col(key).alias("prompt_" + key), F.col("_rec").alias("_prompt_rec"))
    everyone = base.select("_sp", F.col("_i_all").alias("_at"), F.col(key).alias("prompt_" + key), F.col("_rec").alias("_prompt_rec"))
    found = first.unionByName(second).join(longs, ["_sp", "_at"]).unionByName(third.join(everyone, ["_sp", "_at"]))
    return found.select(key, "tier", "prompt_" + key)


#: Characters of short candidate texts that one scan of the corpus looks for.
SHORT_CHARS = 1 << 16


def _inner_pairs(text: Column) -> Column:
    """Neighbouring pieces of a text split at spaces, without the first and last piece, which may be parts of words."""
    return F.element_at(F.transform(F.array(F.split(text, " ")), lambda p: F.when(F.size(p) >= 4, F.transform(F.sequence(F.lit(1), F.size(p) - 3), lambda i: F.concat_ws(" ", F.get(p, i), F.get(p, i + 1))))), 1)


def not_contained(candidates: DataFrame, corpus: DataFrame, text: str, key: str, corpus_key: str) -> DataFrame:
    """Candidates whose text is no substring of any corpus text.

    Where a candidate occurs, its inner pieces are whole pieces of the corpus text. So its longest pair of inner pieces
    meets the pairs of the corpus texts in an equi-join, and only those pairs of texts are tested. Candidates of
    fewer than four pieces have no such pair: they go, ``SHORT_CHARS`` of them at a time, to every task as literals of a
    scan of the corpus, which stays where it is. Null texts are contained in nothing.
    """
    c = candidates.select(F.col(key).alias("_id"), F.col(text).alias("_c")).where("_c is not null")
    t = corpus.select(F.col(corpus_key).alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    longest = F.array_max(F.transform(_inner_pairs(F.col("_c")), lambda p: F.struct(F.length(p).alias("n"), F.xxhash64(p).alias("g"))))["g"]
    long = c.withColumn("_g", longest).where("_g is not null")
    pieces = F.split("_t", " ")
    pairs = F.when(F.size(pieces) >= 2, F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b))))
    places = t.select("_k", F.explode(F.array_distinct(pairs)).alias("_g"))
    meet = long.select("_id", "_g").join(places, "_g").select("_id", "_k")
    found = meet.join(long.select("_id", "_c"), "_id").join(t, "_k").where(F.contains(F.col("_t"), F.col("_c"))).select("_id")
    found, lot, size = found.distinct(), [], 0
    for text_ in [*(r["_c"] for r in c.where(longest.isNull()).select("_c").distinct().toLocalIterator()), None]:
        if lot and (text_ is None or size + len(text_) > SHORT_CHARS):
            hits = t.select(F.explode(F.filter(F.array(*map(F.lit, lot)), lambda x: F.contains(F.col("_t"), x))).alias("_c")).distinct()
            found, lot, size = found.union(c.join(hits, "_c").select("_id")), [], 0
        if text_ is not None:
            lot, size = [*lot, text_], size + len(text_) + 64
    return candidates.join(found.distinct().withColumnRenamed("_id", key), key, "left_anti")


def match_on(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Inner join on several keys, say a path and a rounded start, with the last right row of each key.

    Rows of either side without a partner drop out; ``columns`` of the right side come under the name other_*.
    """
    build = last_wins(right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in columns], F.col(order).alias("_o")), keys, "_o")
    return left.join(build.drop("_o"), keys)


def attach_if(left: DataFrame, right: DataFrame, keys: list[str], column: str, fits: Column) -> DataFrame:
    """All rows of ``left`` with ``column`` of ``right`` by composite key, null where the pair does not fit."""
    joined = left.join(right.select(*keys, column), keys, "left")
    return joined.withColumn(column, F.when(fits, F.col(column)))


def positional(df: DataFrame, index: str, lists: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the element of the list ``column`` (one row) at their 0-based index; those out of range are dropped."""
    numbered = lists.select(F.posexplode(column).alias("_at", name))
    return df.join(numbered, F.col(index) == F.col("_at")).drop("_at")


def first_present(df: DataFrame, choices: list[tuple[str, DataFrame]], key: str, column: str, otherwise: Column) -> DataFrame:
    """Adds ``column`` of the first choice that has the key, and ``tier``, its name; else the fallback and 'original'.

    A choice (name, table of key and column) holds each key once.
    """
    for i, (_, choice) in enumerate(choices):
        df = df.join(choice.select(key, F.col(column).alias(f"_c{i}")), key, "left")
    found = [F.col(f"_c{i}") for i in range(len(choices))]
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, (n, _) in zip(found, choices)], F.lit("original"))
    return df.withColumn("tier", tier).withColumn(column, F.coalesce(*found, otherwise)).drop(*[f"_c{i}" for i in range(len(choices))])
