"""Sources. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

WORDS = "array<struct<word: string, start: double, end: double>>"
MANIFEST = "path string, start double, duration double, transcript string, speaker string, words " + WORDS


def jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a malformed line fails the read, blank lines are skipped. Lenient: malformed lines drop."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_with_drops(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with the number of malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return parsed.where("_bad is null").drop("_bad"), parsed.agg(F.count("_bad").alias("malformed"))


def raw_lines(spark: SparkSession, path: str, rank: int = 0, world: int = 1) -> DataFrame:
    """value: unparsed lines of this shard, one of ``world``; a shard without lines is refused.

    Lines are dealt by their place: the number of the split and of the line in it, which do not change while the files
    do not. Files are split as ever, so a large one is read by many tasks.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.monotonically_increasing_id().alias("line_no"))
    split, line = F.shiftright("line_no", 33), F.col("line_no").bitwiseAND(F.lit((1 << 33) - 1))
    shard = lines.where(F.pmod(split + line, F.lit(world)) == rank)
    if shard.isEmpty():
        raise ValueError(f"shard {rank} of {world} has no lines")
    return shard.select("value")


def texts(spark: SparkSession, path: str, field: str = "transcript") -> DataFrame:
    """Plain or JSON lines, told apart line by line; blank ones are skipped."""
    line = F.trim("value")
    text = F.when(line.startswith("{"), F.get_json_object(line, f"$.{field}")).otherwise(line)
    return spark.read.text(path).select(text.alias("text")).where("text <> ''")


def catalogue(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """CSV with a header; the named columns become doubles, null where they are no numbers."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers})


def pairs_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Headerless tab-separated lines of exactly six columns; another number of columns fails the read."""
    parts = F.split("value", "\t", -1)
    names = ("id0", "dur0", "txt0", "id1", "dur1", "txt1")
    lines = spark.read.text(path).where("trim(value) <> ''")
    ok = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("expected 6 columns: "), F.col("value"))).cast("array<string>"))
    df = lines.select(ok.alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    df = df.withColumns({c: F.col(c).cast("double") for c in ("dur0", "dur1")})
    return df.limit(limit) if limit is not None else df


def documents(spark: SparkSession, path: str, schema: str, nested: str | None = None) -> DataFrame:
    """Whole-file JSON documents with their path; a missing ``nested`` array is empty. Unreadable files give nulls."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return df if nested is None else df.withColumn(nested, F.coalesce(nested, F.expr(f"from_json('[]', '{df.schema[nested].dataType.simpleString()}')")))


def recordings(spark: SparkSession, path: str, preference: list[str]) -> DataFrame:
    """recording (folder), file: per folder the file of the first suffix in ``preference`` that occurs, then by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), "length")
    rank = F.coalesce(*[F.when(F.col("path").endswith(s), i) for i, s in enumerate(preference)])
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("recording"), "path", "length", rank.alias("r")).where("r is not null").groupBy("recording").agg(F.min_by("path", F.struct("r", "path")).alias("file"))


def named_files(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Numbers in file names: one bigint column per group of ``pattern``; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(pattern)).select("path", "length", *[F.regexp_extract(name, pattern, i + 1).cast("bigint").alias(n) for i, n in enumerate(names)])


def existing(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose file exists under ``path`` and is not empty."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    return rows.join(files.select(F.element_at(F.split("path", "/"), -1).alias(column)), column, "left_semi")


def media_windows(rows: DataFrame, files: DataFrame, decode: Callable[[bytes, float, float, int], list[float]], rate: int) -> DataFrame:
    """path, start, samples: windows (path, start, duration) of media files through an injected decoder."""
    joined = rows.join(files.select("path", "content"), "path").select("path", "start", "duration", "content")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            b["samples"] = [decode(c, s, d, rate) for c, s, d in zip(b["content"], b["start"], b["duration"])]
            yield b[["path", "start", "samples"]]

    return joined.mapInPandas(run, "path string, start double, samples array<float>")


def load_settings(text: str, allowed: dict[str, type], overrides: dict[str, object] | None = None) -> dict[str, object]:
    """Settings under dotted names from nested JSON text and overrides; unknown names are refused, "1e-5" becomes a float.

    Types are strict: a number is no string, a fraction no integer, and only true and false are booleans.
    """

    def flat(x: dict, before: str = "") -> Iterator[tuple[str, object]]:
        for k, v in x.items():
            if isinstance(v, dict):
                yield from flat(v, f"{before}{k}.")
            else:
                yield before + k, v

    found = dict(flat(json.loads(text))) | (overrides or {})
    if unknown := set(found) - set(allowed):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for k, v in found.items():
        kind = allowed[k]
        if kind is float and isinstance(v, (int, str)) and not isinstance(v, bool):
            v = float(v)
        if type(v) is not kind:
            raise ValueError(f"{k}: {v!r} is no {kind.__name__}")
        out[k] = v
    return out


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, next_offset, lines: what a log holds up to its last line end; a partial last line stays unread."""
    content = F.col("content").cast("string")
    done = F.regexp_extract(content, r"(?s)^(.*\n)", 1)
    files = spark.read.format("binaryFile").load(path)
    lines = F.filter(F.split(done, "\n"), lambda x: F.trim(x) != "")
    return files.select(F.col("path").alias("file"), F.octet_length(done).cast("long").alias("next_offset"), lines.alias("lines"))


def new_lines(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """file, value, next_offset: complete lines beyond each file's byte offset (file, next_offset of the last call).

    A file shorter than its offset was begun anew and is read from its start. Logs are small files; one is one row.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    if offsets is not None:
        files = files.join(offsets.groupBy("file").agg(F.max("next_offset").alias("_at")), "file", "left")
    else:
        files = files.withColumn("_at", F.lit(0).cast("long"))
    at = F.when(F.coalesce("_at", F.lit(0)) > F.octet_length("content"), F.lit(0)).otherwise(F.coalesce("_at", F.lit(0)))
    fresh = F.expr("substring(content, cast(_from as int) + 1)").cast("string")
    rows = files.withColumn("_from", at).withColumn("_done", F.regexp_extract(fresh, r"(?s)^(.*\n)", 1))
    rows = rows.select("file", (F.col("_from") + F.octet_length("_done")).alias("next_offset"), F.explode(F.split("_done", "\n")).alias("value"))
    return rows.where("trim(value) <> ''").select("file", "value", "next_offset")


class ArrowIpc(DataSource):
    """Arrow IPC files or streams as a Spark source: format("arrow_ipc").option("paths", "a;b"), one task per file.

    Files are opened through pyarrow's file systems, so a path may name any store that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _paths(self) -> list[str]:
        return self.options["paths"].split(";")

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with _ipc(self._paths()[0]) as r:
            return from_arrow_schema(r.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IpcReader(self._paths())


class _IpcReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _ipc(partition.value) as r:
            if hasattr(r, "num_record_batches"):
                yield from (r.get_batch(i) for i in range(r.num_record_batches))
            else:
                yield from r


def _ipc(path: str):
    """The file format, else the stream format."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    try:
        return pa.ipc.open_file(where.open_input_file(inner))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(where.open_input_stream(inner))


def explode_chapters(chapters: DataFrame, utterances: str = "utterances") -> DataFrame:
    """One row per utterance with its place; chapters without any give none."""
    return chapters.select("*", F.posexplode(utterances).alias("place", "_u")).select(*[c for c in chapters.columns if c != utterances], "place", "_u.*")


