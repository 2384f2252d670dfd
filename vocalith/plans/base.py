"""The registry of queries, and the stand-in relations that the test tables are mapped onto."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a manifest: speaker (source and language), recording, duration in seconds."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars", F.concat_ws("-", "source", "lang").alias("speaker"), (F.col("doc_id") % 3).alias("recording"), (F.col("n_chars") / F.lit(15.0)).alias("duration")
    )


MANIFEST_SQL = "m AS (SELECT doc_id, text, lang, source, n_chars, source || '-' || lang AS speaker, doc_id % 3 AS recording, n_chars / 15.0::DOUBLE AS duration FROM documents)"


def bucket_sql(x: str) -> str:
    return f"(CAST(CAST(('0x' || substr(sha256(CAST({x} AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616::DOUBLE)"


def ref_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')"


def id_bin(column: Column, width: int = 4096) -> Column:
    """Bins of consecutive ids, for global prefix sums."""
    return F.floor(column / width)
