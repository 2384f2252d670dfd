"""Streaming operators. Offsets live in the checkpoint, partial last lines stay unread until they end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def tail(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder as a stream; malformed JSON lines are dropped."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).load(path)


def latest_per_key(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, kept up to date (update or complete mode)."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions by inactivity: key, session_start, session_end, n. In append mode a session comes out once closed."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stop_rule(stream: DataFrame, key: str, step: str, ended: str, after: int, most: int) -> DataFrame:
    """key, eos_step, stop_step: emitted once per key, when the frames after its first end are over or ``most`` is reached.

    State per key: the first step that ended, and whether the stop has been told. Rows come in step order within a key.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        eos, told = state.get if state.exists else (-1, False)
        for part in parts:
            for s, e in part.sort_values(step)[[step, ended]].itertuples(index=False):
                if eos < 0 and e:
                    eos = int(s)
                if not told and (s >= most or (eos >= 0 and s >= eos + after)):
                    told = True
                    yield pd.DataFrame({key: [k[0]], "eos_step": [eos if eos >= 0 else None], "stop_step": [int(min(s, most))]}).astype({"eos_step": "Int64"})
        state.update((eos, told))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, eos_step bigint, stop_step bigint", "eos bigint, told boolean", "append", GroupStateTimeout.NoTimeout)


def overlap_add(stream: DataFrame, key: str, order: str, samples: str, tail_size: int) -> DataFrame:
    """Chunks of samples whose last ``tail_size`` values overlap the next chunk: the tail is kept as state and added."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry = list(state.get[0]) if state.exists else [0.0] * tail_size
        for part in parts:
            for o, xs in part.sort_values(order)[[order, samples]].itertuples(index=False):
                xs = [float(x) for x in xs]
                for i in range(min(tail_size, len(xs))):
                    xs[i] += carry[i]
                cut = max(0, len(xs) - tail_size)
                carry = (xs[cut:] + [0.0] * tail_size)[:tail_size]
                yield pd.DataFrame({key: [k[0]], order: [o], samples: [xs[:cut]]})
        state.update((carry,))

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {order} {stream.schema[order].dataType.simpleString()}, {samples} array<double>"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "carry array<double>", "append", GroupStateTimeout.NoTimeout)


def sliding_context(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Each row with the ``size`` latest values up to it, oldest first: a count-bounded window."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, Window.currentRow)
    return df.withColumn("context", F.collect_list(value).over(w))


def poll_and_score(stream: DataFrame, key: str, done: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """For each batch: what has no result yet is scored and appended; runs over what is there, then ends."""

    def batch(df: DataFrame, _: int) -> None:
        append(score(df.join(done().select(key), key, "left_anti").orderBy(key)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drives a stream over what is there into a Parquet table beside its checkpoint and returns it.

    Nothing passes through the driver. In append mode the file sink commits each batch once; in the others the last
    batch, which holds the whole result, replaces the one before.
    """
    spark, path = stream.sparkSession, f"{checkpoint}-{name}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", path).start()
    else:
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)
        q = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
