"""Aggregations: shares, histograms, top groups, bootstrap intervals, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.hashing import bucket


def hours(seconds: Column, digits: int = 3) -> Column:
    return F.round(F.sum(seconds) / 3600, digits)


def top_groups(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The k most frequent keys; of equally frequent ones those seen first."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def median_group_size(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.median("n").alias("median_n"))


def largest_share(df: DataFrame, key: str, value: Column) -> DataFrame:
    """The greatest group's share of the total (at least 1e-9)."""
    sums = df.groupBy(key).agg(F.sum(value).alias("s"))
    return sums.agg((F.max("s") / F.greatest(F.sum("s"), F.lit(1e-9))).alias("largest_share"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n for every bin 0..bins-1; values outside fall into the end bins; no rows when hi <= lo."""
    spark = df.sparkSession
    if hi <= lo:
        return spark.createDataFrame([], "bin int, n bigint")
    width = (hi - lo) / bins
    at = F.least(F.greatest(F.floor((value - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def with_baseline(df: DataFrame, is_baseline: Column, key: str, value: str) -> DataFrame:
    """Adds ``ratio`` to the one baseline row's value; null on that row."""
    base = df.where(is_baseline).agg(F.max(value).alias("_b"))
    return df.join(F.broadcast(base)).withColumn("ratio", F.when(~is_baseline, F.col(value) / F.col("_b"))).drop("_b")


def bootstrap(df: DataFrame, index: str, n: int, value: Column, draws: int, seed: int = 0) -> DataFrame:
    """The 2.5 and 97.5 percent bounds of the mean over ``draws`` resamples of the n rows numbered 0..n-1.

    Draw i of resample s takes row floor(bucket("seed-s-i") n), so a run repeats anywhere.
    """
    if n <= 0 or draws <= 0:
        raise ValueError("needs rows and draws")
    spark = df.sparkSession
    drawn = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("s"), (F.col("id") % n).alias("i"))
    at = F.floor(bucket(F.concat_ws("-", F.lit(str(seed)), F.col("s").cast("string"), F.col("i").cast("string"))) * n).cast("long")
    sums = drawn.withColumn(index, at).join(df.select(index, value.alias("_v")), index).groupBy("s").agg((F.sum("_v") / n).alias("m"))
    ranked = sums.withColumn("r", F.row_number().over(Window.orderBy("m", "s")) - 1)
    lo, hi = int(0.025 * (draws - 1)), int(0.975 * (draws - 1))
    return ranked.agg(F.max(F.when(F.col("r") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("m"))).alias("hi"))


def moving_average(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """The last exponential moving average per key: decay * average + (1 - decay) * value, starting at the first value."""
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("xs"))
    first = F.col("xs")[0]["v"]
    ema = F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), first, lambda a, x: a * decay + x["v"] * (1 - decay))
    return listed.select(key, ema.alias("ema"))


def mean_of_means(df: DataFrame, worker: str, value: str) -> DataFrame:
    """The plain mean over workers of each worker's mean."""
    return df.groupBy(worker).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def failure_classes(df: DataFrame, reason: str, seconds: Column, order: str) -> DataFrame:
    """Per reason the rows and seconds lost and where it was first seen; most frequent first, then first seen."""
    lost = df.groupBy(reason).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds_lost"), F.min(order).alias("first_seen"))
    return lost.orderBy(F.desc("n"), "first_seen")


def rate(condition: Column) -> list[Column]:
    """n, n_hit and percent (two decimals) of rows that meet a condition; percent is null without rows."""
    hit, n = F.count_if(condition), F.count("*")
    return [n.alias("n"), hit.alias("n_hit"), F.when(n > 0, F.round(hit * 100.0 / n, 2)).alias("percent")]


def longest_per_group(df: DataFrame, group: str, key: str, value: str, k: int) -> DataFrame:
    """Each group's row with the greatest value (of equal ones the least key); the k greatest of these."""
    best = df.groupBy(group).agg(F.max(F.struct(F.col(value), (-F.col(key)).alias("_k"))).alias("_b"))
    return best.select(group, (-F.col("_b._k")).alias(key), F.col(f"_b.{value}").alias(value)).orderBy(F.desc(value), group).limit(k)
