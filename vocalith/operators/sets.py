"""Set operations on keys, and the assertion that two sets are disjoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_shard_order(frames: list[DataFrame], index: str) -> DataFrame:
    """Shard outputs with the shard number, to sort by (shard, index)."""
    return union_all(*[f.withColumn("shard", F.lit(i)) for i, f in enumerate(frames)]).orderBy("shard", index)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).exceptAll(b.select(key)).distinct()


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    found = common(a, b, key).take(1)
    if found:
        raise ValueError(f"{key} {found[0][0]!r} is on both sides")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: keys without a result (results may have gaps, so keys count, not rows)."""
    return work.join(done.select(key), key, "left_anti")


def newest(df: DataFrame, order: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Retention: (the ``keep`` newest rows, the rest)."""
    top = df.orderBy(F.desc(order)).limit(keep)
    return top, df.join(F.broadcast(top.select(order)), order, "left_anti")  # keep rows
