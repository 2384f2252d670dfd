"""Global running sums and row numbers without a single-task window.

Rows go to bins by a column that rises with the order, and bins to blocks of ``BINS``. Blocks and bins are summed first,
so a row's total is that of the blocks before its own (a window over blocks), of the bins before its own in the block
(a window per block), and a window inside its bin: with n rows in bins of w, no window sees more than n / (w BINS), BINS
or w rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per block.
BINS = 1024


def running(df: DataFrame, bin_: Column, order: list, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one. ``bin_`` must not fall along ``order``."""
    dealt = df.withColumn("_bin", bin_).withColumn("_value", value)
    bins = dealt.groupBy("_bin").agg(F.sum("_value").alias("_total")).withColumn("_block", F.floor(F.col("_bin") / BINS))
    blocks = bins.groupBy("_block").agg(F.sum("_total").alias("_sum"))
    above = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    before = Window.partitionBy("_block").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = bins.join(blocks, "_block").select("_bin", (F.col("_above") + F.coalesce(F.sum("_total").over(before), F.lit(0))).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals, "_bin").withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return out.drop("_bin", "_value", "_before")


def unit_bin(position: Column, bins: int = 1 << 20) -> Column:
    """The bin of a position in [0, 1)."""
    return F.floor(position * bins)


def numbered(df: DataFrame, bin_: Column, order: list, name: str) -> DataFrame:
    """Adds the 0-based row number in ``order``."""
    return running(df, bin_, order, F.lit(1).cast("long"), name)
