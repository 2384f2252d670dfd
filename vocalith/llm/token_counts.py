"""Token counts (operator 10): an exact length histogram with suffix sums.

Documents are aggregated by encoded length. Suffix sums over the histogram then give, for every context limit L, the
documents that reach it, their tokens and the tokens kept if every document is cut to L; totals and quantiles follow
from the same rows. The sums run in two levels (blocks of lengths, then inside a block), so no task sees the whole
histogram even when lengths are many.

Nulls and edge cases: a null or empty text has length 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored
from .tokens import encode

#: Lengths per block of the two-level suffix sum.
BLOCK = 256


def length_counts(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """n_tokens, n: partial counts per task and length."""
    schema = pa.schema([("n_tokens", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, n = np.unique(np.array([len(encode(x.as_py() or "", tokenizer, pattern)) for x in b.column(0)], np.int64), return_counts=True)
            yield batch(schema, n_tokens=lengths, n=n)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens bigint, n bigint")


def histogram(counts: DataFrame) -> DataFrame:
    """One row per length L = n_tokens.

    n_docs: documents of that length; docs_from, tokens_from: documents of at least L and their tokens; docs_upto:
    documents of at most L; truncated_tokens: tokens left when each document keeps its first L; total_docs, total_tokens.
    """
    h = stored(counts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))).withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(blocks, "block").withColumn("docs_from", F.col("d_later") + F.sum("n_docs").over(inside)).withColumn("tokens_from", F.col("t_later") + F.sum("tokens").over(inside))
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
    )


def token_counts(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    return histogram(length_counts(docs, tokenizer, pattern))


def at_limit(h: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, whether or not a document has exactly that length: one row.

    The suffix sums of the least length beyond the limit hold all documents that are cut and their tokens.
    """
    beyond = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > limit, F.col("n_tokens")))
    one = h.agg(beyond.alias("s"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    cut = F.coalesce(F.col("s.docs_from"), F.lit(0))
    kept = F.col("total") - F.coalesce(F.col("s.tokens_from"), F.lit(0)) + cut * F.lit(limit)
    return one.select(F.lit(limit).cast("long").alias("context_limit"), kept.alias("truncated_tokens"), cut.alias("docs_cut"))


def quantile(h: DataFrame, p: float) -> DataFrame:
    """The least length that at least the share p of the documents do not exceed: one row."""
    return h.where(F.col("docs_upto") >= F.greatest(F.lit(1), F.ceil(F.col("total_docs") * F.lit(p)))).agg(F.min("n_tokens").alias("n_tokens"))
