"""Filter cascades: every row is charged to the first check that it fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check whose condition holds (null conditions do not), else null."""
    arms = [(name, F.coalesce(failed, F.lit(False))) for name, failed in checks]
    head, *rest = arms
    return reduce(lambda c, x: c.when(x[1], x[0]), rest, F.when(head[1], head[0]))


def cascade(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rows of reason and n for those dropped)."""
    marked = df.withColumn("_reason", first_reason(checks))
    kept = marked.where("_reason is null").drop("_reason")
    return kept, reason_counts(marked.where("_reason is not null"), "_reason")


def reason_counts(df: DataFrame, column: str = "reason") -> DataFrame:
    return df.groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))


def segment_reason(words: str, start: str, end: str, text_ok: Column, least: float) -> Column:
    """The quality gate of a segment with words (word, start, end, probability)."""
    w, known = F.col(words), F.filter(F.transform(F.col(words), lambda x: x["probability"]), lambda p: p.isNotNull())
    from vocalith.functions.numbers import quantile

    untimed = F.exists(w, lambda x: x["start"].isNull() | x["end"].isNull() | (x["end"] <= x["start"]))
    return first_reason(
        [("no_words", F.coalesce(F.size(w), F.lit(0)) <= 0), ("low_confidence", quantile(known, "median") < least), ("untimed", F.col(end) <= F.col(start)), ("untimed", untimed), ("no_script", ~text_ok)]
    )


def usable(df: DataFrame, key: Column, score: Column, least: float, present: list[Column]) -> DataFrame:
    """Rows with a key that is not empty, a score of at least ``least`` and no null among ``present``."""
    ok = F.coalesce(F.length(key.cast("string")) > 0, F.lit(False)) & F.coalesce(score >= least, F.lit(False))
    for c in present:
        ok = ok & c.isNotNull()
    return df.where(ok)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows of ``df``; reading one that breaks the condition fails with the message."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def without_nulls(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda k, v: v.isNotNull())


def upcast(column: Column, legacy: Column) -> Column:
    """An array column of a newer layout; rows of the older one, where it is null, get one element made of their own columns."""
    return F.coalesce(column, F.array(legacy))


def allowed_groups(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """The rows of groups in which some row meets the condition; other groups are not scored at all."""
    return df.join(df.where(condition).select(key).distinct(), key, "left_semi")
