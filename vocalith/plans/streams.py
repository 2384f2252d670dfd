"""Streaming queries, run over what is there, beside their batch equivalents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.plans.base import query, table
from vocalith.streaming import streams


def _checkpoint(spark: SparkSession) -> str:
    """Below the cluster's shared folder; a temporary folder only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='vocalith-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{sf_dir.rstrip('/')}/"
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS step, event_id, value FROM events) SELECT user_id, step, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM e GROUP BY 1, 2""")
def stream_tail_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("step"), "event_id", "value")
    name = f"latest_{uuid.uuid4().hex}"
    latest = streams.latest_per_key(e.select("user_id", "step", F.col("event_id").alias("order"), "event_id", "value"), ["user_id", "step"], "order")
    return streams.run_to_table(latest.select("user_id", "step", "value", "event_id"), name, "complete", _checkpoint(spark))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, n FROM s WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions only: an append stream holds back those that the watermark has not passed."""
    e = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.sessions(e, "user_id", "ts", "12 hours", "1 hour")
    got = streams.run_to_table(out, f"sessions_{uuid.uuid4().hex}", "append", _checkpoint(spark))
    return got.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")
