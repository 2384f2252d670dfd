"""Gates, keyed joins, tails, shards, settings and reports on small fixtures."""

import pytest
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.operators import filters, joins, prefix
from vocalith.sources import readers, writers


def test_catalogue_gate(spark):
    df = spark.createDataFrame([("a", 0.9, 1.0), ("", 0.9, 1.0), (None, 0.9, 1.0), ("b", None, 1.0), ("c", 0.1, 1.0), ("d", 0.9, None)], "id string, q double, d double")
    assert [r["id"] for r in filters.usable(df, F.col("id"), F.col("q"), 0.5, [F.col("d")]).collect()] == ["a"]


def test_match_on_two_keys(spark):
    a = spark.createDataFrame([("x", 1.0004), ("x", 2.0), ("y", 1.0)], "path string, at double").withColumn("start", F.round("at", 3))
    b = spark.createDataFrame([("x", 1.0001, "old", 1), ("x", 1.0, "new", 2), ("z", 1.0, "n", 3)], "path string, at double, w string, o int").withColumn("start", F.round("at", 3))
    assert [(r["path"], r["start"], r["other_w"]) for r in joins.match_on(a, b, ["path", "start"], "o", ["w"]).collect()] == [("x", 1.0, "new")]


def test_short_candidates_go_in_lots(spark, monkeypatch):
    monkeypatch.setattr(joins, "SHORT_CHARS", 100)
    corpus = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dogs"), (3, None)], "k int, t string")
    c = spark.createDataFrame([(i, w) for i, w in enumerate(["quick", "cat", "dogs", "dogs", "y d", "", None])], "id int, t string")
    assert sorted(r[0] for r in joins.not_contained(c, corpus, "t", "id", "k").select("id").collect()) == [1, 6]


def test_word_edits_of_very_many_words(spark):
    a = [f"w{i}" for i in range(36_000)]
    b = a[:100] + ["other"] + a[101:]
    df = spark.createDataFrame([(a[:500], b[:500]), (a[35_000:35_400], a[35_001:35_400])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(N.word_edits(F.col("a"), F.col("b"))).collect()] == [1, 1]
    wide = spark.createDataFrame([(a, a[35_990:])], "a array<string>, b array<string>")
    assert wide.select(N.word_edits(F.col("a"), F.col("b"))).first()[0] == 35_990


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BINS", 4)
    df = spark.range(500).select("id", (F.col("id") % 5).alias("v"))
    got = {r["id"]: r["s"] for r in prefix.running(df, F.floor(F.col("id") / 9), ["id"], F.col("v"), "s").collect()}
    assert all(got[i] == sum(j % 5 for j in range(i)) for i in range(500))


def test_shards_of_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("a\n\nb\nc\nd\n")
    shards = [sorted(r[0] for r in readers.raw_lines(spark, str(tmp_path), i, 2).collect()) for i in range(2)]
    assert sorted(sum(shards, [])) == ["a", "b", "c", "d"] and [len(s) for s in shards] == [2, 2]
    with pytest.raises(ValueError, match="no lines"):
        readers.raw_lines(spark, str(tmp_path), 7, 8)


def test_tail_keeps_a_partial_line_unread(spark, tmp_path):
    log = tmp_path / "p.jsonl"
    log.write_bytes('{"step": 1}\n{"st'.encode())
    first = readers.new_lines(spark, str(tmp_path))
    rows = first.collect()
    assert [(r["value"], r["next_offset"]) for r in rows] == [('{"step": 1}', 12)]
    assert [r["lines"] for r in readers.complete_lines(spark, str(tmp_path)).collect()] == [['{"step": 1}']]
    offsets = spark.createDataFrame([(r["file"], r["next_offset"]) for r in rows], "file string, next_offset bigint")
    log.write_bytes('{"step": 1}\n{"step": "é"}\n\n{"step": 3}\n{'.encode())
    assert [r["value"] for r in readers.new_lines(spark, str(tmp_path), offsets).collect()] == ['{"step": "é"}', '{"step": 3}']
    log.write_bytes(b"{}\n")  # begun anew
    assert [(r["value"], r["next_offset"]) for r in readers.new_lines(spark, str(tmp_path), offsets).collect()] == [("{}", 3)]


def test_settings_are_strict():
    kinds = {"lr": float, "model.width": int, "model.deep": bool, "name": str}
    got = readers.load_settings('{"lr": "1e-5", "model": {"width": 8, "deep": true}}', kinds, {"name": "x", "model.width": 9})
    assert got == {"lr": 1e-5, "model.width": 9, "model.deep": True, "name": "x"}
    for bad in ('{"model": {"width": 1.5}}', '{"model": {"deep": 1}}', '{"name": 3}', '{"other": 1}', '{"lr": true}'):
        with pytest.raises(ValueError):
            readers.load_settings(bad, kinds)


def test_reports_are_whole_or_refused(spark):
    df = spark.range(5).select(F.col("id").alias("step"), (F.col("id") / 10).alias("wer"), F.col("id").alias("row_idx"))
    assert writers.markdown_table(df).count("\n") == 6
    assert writers.dashboard(df).count("<tr>") == 5
    for f in (writers.markdown_table, writers.dashboard):
        with pytest.raises(ValueError, match="more than 4"):
            f(df, most=4)
