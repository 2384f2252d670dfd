"""Shared pieces: tables in the cluster's shared folder, bounded Bloom filters, Arrow mapping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode with none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vocalith-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        return


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cuts lineage: writes ``df`` once to the shared folder and reads it back.

    Unlike checkpoint() this runs the last stage once. The files are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vocalith-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: log2 of the bits of a Bloom filter: 2 MB, whatever goes in. Beyond some two million keys it lets more through.
BLOOM_BITS = 24
_BLOOM_HASHES = 4


class Bloom:
    """A filter of fixed size over 64-bit hashes. What it lets through is a superset; a join decides."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for i in range(_BLOOM_HASHES):
            at = (hashes >> np.uint64(16 * i // 2)) & np.uint64((1 << BLOOM_BITS) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(keys: DataFrame, column: str) -> Bloom:
    """A Bloom filter of xxhash64(column), OR-ed in Spark; at most 2**18 words come to the driver."""
    h = F.xxhash64(F.col(column))
    at = F.array(*[F.shiftrightunsigned(h, 16 * i // 2).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)) for i in range(_BLOOM_HASHES)])
    bits = keys.select(F.explode(at).alias("at")).select(
        F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    )
    words = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return Bloom(words)


def hash_longs(values: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of a bigint column."""
    raw = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(raw[i : i + 8], 42) for i in range(0, len(raw), 8)), np.uint64, len(values))


def hash_strings(values: list[str]) -> np.ndarray:
    """Spark's xxhash64 of a string column."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in values), np.uint64, len(values))


def sliced(batches, rows: int = 1024):
    """The same record batches in slices, so that what a task builds beside a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir.rstrip('/')}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
