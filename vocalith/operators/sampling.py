"""Sampling and selection: hash splits, budgets, quotas, round-robin, evenly spaced rows, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.hashing import bucket
from vocalith.operators.prefix import running, unit_bin


def hash_split(df: DataFrame, key: Column, share: float, train: str = "train", rest: str = "validation") -> DataFrame:
    b = bucket(key)
    return df.withColumn("bucket", b).withColumn("split", F.when(F.col("bucket") < share, rest).otherwise(train))


def within_budget(df: DataFrame, key: str, value: Column, budget: float) -> DataFrame:
    """Rows in hash order while the total before them is under the budget: the row that crosses it is in."""
    placed = df.withColumn("_p", bucket(F.col(key)))
    totals = running(placed, unit_bin(F.col("_p")), ["_p", key], value, "before")
    return totals.where(F.col("before") < budget).drop("_p", "_total")


def static_skip(groups: DataFrame, key: str, value: str, budget: float, slack: float = 1.5) -> DataFrame:
    """Groups in hash order until the budget is met, without those over slack * budget; if none, the smallest group."""
    small = groups.where(F.col(value) <= slack * budget)
    chosen = within_budget(small, key, F.col(value), budget).select(key)
    least = groups.groupBy().agg(F.min_by(F.col(key), F.struct(value, key)).alias(key))
    fallback = least.join(chosen.groupBy().agg(F.count("*").alias("_n"))).where("_n = 0").select(key)
    return chosen.unionByName(fallback)


def relaxed_fold(groups: DataFrame, key: str, value: str, target: Column, total: Column, shares: list[float], enough: float = 0.9, slack: float = 1.5) -> DataFrame:
    """One row: the share accepted, the chosen keys, their sum.

    For each share in turn: groups in hash order, skipping those over share * total or that would take the sum over
    slack * target, until the sum reaches the target; the first share with at least enough * target wins, else the last.
    The skip depends on the sum so far, so it is a fold over one array of groups (one entry per speaker).
    """
    item = F.struct(bucket(F.col(key)).alias("b"), F.col(key).alias("k"), F.col(value).alias("v"))
    one = groups.agg(F.array_sort(F.collect_list(item)).alias("xs"), total.alias("total"), target.alias("target"))

    def attempt(share: float) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("acc"), F.array().cast("array<string>").alias("keys"))

        def step(a: Column, x: Column) -> Column:
            skip = (a["acc"] >= F.col("target")) | (x["v"] > share * F.col("total")) | (a["acc"] + x["v"] > slack * F.col("target"))
            return F.when(skip, a).otherwise(F.struct((a["acc"] + x["v"]).alias("acc"), F.concat(a["keys"], F.array(x["k"])).alias("keys")))

        return F.struct(F.lit(share).alias("share"), F.aggregate("xs", zero, step).alias("got"))

    tries = one.select("target", F.array(*[attempt(s) for s in shares]).alias("tries"))
    good = F.filter("tries", lambda t: t["got"]["acc"] >= enough * F.col("target"))
    pick = F.when(F.size(good) > 0, good[0]).otherwise(F.element_at("tries", -1))
    return tries.select(pick["share"].alias("share"), pick["got"]["keys"].alias("keys"), pick["got"]["acc"].alias("acc"))


def top_up(candidates: DataFrame, taken: DataFrame, key: str, bin_: Column, order: list, value: Column, quota: float) -> DataFrame:
    """Rows not taken yet, in order, until the quota is met."""
    free = candidates.join(taken.select(key), key, "left_anti").where(value > 0)
    return running(free, bin_, order, value, "before").where(F.col("before") < quota).drop("_total")


def round_robin(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Offset 0 of every group (in group order), then offset 1, ... until k rows; a group's own order is by hash."""
    offset = F.row_number().over(Window.partitionBy(group).orderBy(bucket(F.col(key)), key)) - 1
    return df.withColumn("offset", offset).orderBy("offset", group).limit(k)


def evenly_spaced(numbered: DataFrame, index: str, n: int, k: int) -> DataFrame:
    """k rows at floor(i (n-1) / (k-1)); all rows when k <= 0 or k >= n."""
    if k <= 0 or k >= n:
        return numbered
    i = numbered.sparkSession.range(k).select(F.floor(F.col("id") * (n - 1) / F.lit(max(1, k - 1))).alias(index))
    return numbered.join(F.broadcast(i), index, "left_semi")  # k rows


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same ones every time."""
    return df.orderBy(bucket(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def shard(index: Column, world: int, how: str = "modulo", n: int | None = None) -> Column:
    """The shard of a 0-based row: modulo (strided) or contiguous blocks of ceil(n / world)."""
    if how == "modulo":
        return F.pmod(index, F.lit(world))
    if how == "contiguous" and n is not None:
        return F.floor(index / F.lit(-(-n // world)))
    raise ValueError(how)
