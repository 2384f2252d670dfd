"""Operators on fixtures that the test tables lack: ties, nulls, one-clip speakers, malformed lines, Hebrew."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.functions import text as T
from vocalith.functions.hashing import bucket, nested_position
from vocalith.operators import aggregates, filters, joins, prefix, sampling, sequence, sets
from vocalith.sources import readers, writers
from vocalith.streaming import streams


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, **columns):
    row = {k: v for k, v in columns.items()}
    return spark.createDataFrame([row]).select(expr).first()[0]


def test_bucket_and_nested_position(spark):
    import hashlib

    keys = ["a", "שלום", "x" * 100, "17"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(bucket(F.col("k"))).collect()]
    assert got == [int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") / 2**64 for k in keys]
    ids = [0, 1, 12345, 2**31, 2**32 - 1, 2**40 + 7]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select(nested_position(F.col("i"))).collect()]
    assert got == [((i * 2654435761) & 0xFFFFFFFF) / 2**32 for i in ids]


def test_text_normalisation(spark):
    raw = "  ש\u05b8ל\u05d5\u05b9ם\u200f,\u2003e\u0301 \n x!  "
    assert one(spark, T.normalize_text(F.col("t")), t=raw) == " ".join(unicodedata.normalize("NFC", raw).replace("\u200f", "").split())
    assert one(spark, T.normalize_for_asr(F.col("t")), t="ש\u05b8לום, עולם!") == "שלום עולם"
    assert one(spark, T.norm(F.col("t")), t=" e\u0301 ") == "é"
    assert one(spark, T.escape_html(F.col("t")), t='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, T.fold_case(F.col("t"), "ABC a"), t="xY") == "XY"
    assert one(spark, T.keep_vocabulary(F.col("t"), "ab"), t="abcab") == "abab"


def test_prompts_and_chunks(spark):
    assert tuple(one(spark, T.prepare_prompt(F.col("t")), t=" hello; you\n")) == (" " * 8 + "Hello, you.", 3)
    assert one(spark, T.prepare_prompt(F.col("t")), t="  ") is None
    assert one(spark, T.chunks(F.col("t"), 4), t="It costs 3.5 euros. Really? Yes it does indeed.") == ["It costs 3.5 euros.", "Really?", "Yes it does indeed."]
    assert one(spark, T.chunks(F.col("t"), 3), t="a b c, d e f, g.") == ["a b c,", "d e f,", "g."]


def test_source_ids(spark):
    df = spark.createDataFrame([("x/rec1/a.wav", "q/y_seg3.wav"), (None, "q/rec2_seg1_seg2.wav")], "o string, a string")
    assert [r[0] for r in df.select(T.source_id(F.col("o"), F.col("a"))).collect()] == ["rec1", "rec2"]


def word_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(e[-1] + 1, d[j + 1] + 1, d[j] + (x != y)))
        d = e
    return d[-1]


def test_word_edits(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(N.word_edits(F.col("a"), F.col("b"))).collect()] == [word_distance(a, b) for a, b in rows]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 40])
def test_quantile_rules(spark, n):
    xs = [float(i) for i in range(n)]
    df = spark.createDataFrame([(xs[::-1],)], "x array<double>")
    q = lambda rule, p=50: df.select(N.quantile(F.col("x"), rule, p)).first()[0]
    assert q("floor_n1", 90) == xs[int(0.9 * (n - 1))]
    assert q("clamped", 90) == xs[min(n - 1, int(0.9 * n))]
    assert q("integer", 10) == xs[n // 10]
    assert q("median") == (xs[(n - 1) // 2] + xs[n // 2]) / 2


def test_cascade_charges_one_reason(spark):
    df = spark.createDataFrame([("", 5.0), ("x", 0.0), ("x", None), ("x", 5.0)], "t string, d double")
    kept, dropped = filters.cascade(df, [("empty", F.col("t") == ""), ("short", F.col("d") < 1)])
    assert kept.count() == 2 and sorted(values(dropped)) == [("empty", 1), ("short", 1)]


def test_segment_gate(spark):
    w = "array<struct<word: string, start: double, end: double, probability: double>>"
    rows = [(1, 0.0, 1.0, []), (2, 0.0, 1.0, [("a", 0.0, 0.5, 0.1)]), (3, 1.0, 1.0, [("a", 0.0, 0.5, 0.9)]), (4, 0.0, 1.0, [("a", None, 0.5, 0.9)]), (5, 0.0, 1.0, [("a", 0.0, 0.5, None)])]
    df = spark.createDataFrame(rows, f"i int, s double, e double, w {w}")
    got = dict(values(df.select("i", filters.segment_reason("w", "s", "e", F.lit(True), 0.5))))
    assert got == {1: "no_words", 2: "low_confidence", 3: "untimed", 4: "untimed", 5: None}


def test_pairing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdef"), rng.randrange(3), rng.choice([100.0, 500.0])) for i in range(90)] + [(500, "solo", 0, 900.0)]
    df = spark.createDataFrame(rows, "id bigint, sp string, rec int, d double")
    got = {r[0]: (r[1], r[2]) for r in joins.pair_prompts(df, "id", "sp", "rec", "d", 400.0, bucket(F.col("id"))).collect()}
    import hashlib

    want = {}
    for i, sp, rec, _ in rows:
        others = [r for r in rows if r[1] == sp and r[0] != i]
        for tier, pool in ((1, [r for r in others if r[3] >= 400 and r[2] != rec]), (2, [r for r in others if r[3] >= 400]), (3, others)):
            if pool:
                b = int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") / 2**64
                want[i] = (tier, pool[int(b * len(pool)) % len(pool)][0])
                break
    assert got == want and 500 not in got


def test_not_contained(spark):
    corpus = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "lazy dogs sleep"), (3, None)], "k int, t string")
    c = spark.createDataFrame([(1, "ick brown fox ju"), (2, "dogs"), (3, "brown cat sat down"), (4, "fox jumps over the"), (5, None)], "id int, t string")
    assert sorted(values(joins.not_contained(c, corpus, "t", "id", "k").select("id"))) == [(3,), (4,), (5,)]


def test_prefix_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["s"] for r in prefix.running(df, F.floor(F.col("id") / 64), ["id"], F.col("v"), "s").collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_budgets(spark):
    groups = spark.createDataFrame([("a", 1000), ("b", 900)], "k string, v bigint")
    assert values(sampling.static_skip(groups, "k", "v", 10)) == [("b",)]
    got = sampling.relaxed_fold(groups, "k", "v", F.lit(100.0), F.sum("v").cast("double"), [0.1, 0.2]).first()
    assert got["keys"] == [] and got["share"] == 0.2


def test_round_robin_and_even_spacing(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 8 else "c") for i in range(9)], "id bigint, g string")
    got = sampling.round_robin(df, "g", "id", 5).collect()
    assert sorted((r["offset"], r["g"]) for r in got) == [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "b")]
    numbered = spark.range(10).withColumnRenamed("id", "i")
    assert sorted(r[0] for r in sampling.evenly_spaced(numbered, "i", 10, 4).collect()) == [0, 3, 6, 9]
    assert sampling.evenly_spaced(numbered, "i", 10, 0).count() == 10


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (-5.0,), (3.0,), (None,)], "v double")
    assert sorted(values(aggregates.histogram(df, F.col("v"), 0, 10, 5))) == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert aggregates.histogram(df, F.col("v"), 1, 1, 5).count() == 0


def test_sequences(spark):
    segs = spark.createDataFrame([("r", float(s), i, float(e)) for i, (s, e) in enumerate([(0, 2), (2, 4), (5, 6), (20, 21)])], "k string, s double, u int, e double")
    got = values(sequence.bounded_groups(segs, "k", "s", "u", "e", 1.5, 5.0, 30.0))
    assert sorted(got) == [("r", 0, 0.0, 6.0, 3), ("r", 1, 20.0, 21.0, 1)]
    assert sequence.bounded_groups(segs, "k", "s", "u", "e", 0, 5.0, 30.0).count() == 4
    iv = spark.createDataFrame([("r", 1.0, 3.0, "a", 0), ("r", 2.0, 5.0, "b", 1), ("r", 2.5, 2.7, "c", 2)], "k string, s double, e double, l string, u int")
    got = sequence.tiles(iv, "k", "s", "e", "l", "u", F.lit(6.0)).orderBy("tile_no").select("tile_start", "tile_end", "label")
    assert values(got) == [(0.0, 1.0, ""), (1.0, 3.0, "a"), (3.0, 5.0, "b"), (5.0, 6.0, "")]


def test_early_stop_never_fires_on_improvement(spark):
    df = spark.createDataFrame([("up", i, 1.0 + i) for i in range(6)] + [("down", i, 9.0 - i) for i in range(6)], "k string, o int, v double")
    got = {r["k"]: r["stop_at"] for r in sequence.early_stop(df, "k", "o", "v", 3, 1.2).collect()}
    assert got == {"up": 3, "down": None}


def test_disjointness(spark):
    a, b = spark.range(3), spark.range(3, 5)
    sets.assert_disjoint(a, b, "id")
    with pytest.raises(ValueError):
        sets.assert_disjoint(a, a, "id")


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"path": "a", "duration": 1.5}\n{broken\n{"path": "ב", "duration": 2}\n', encoding="utf-8")
    schema = "path string, duration double"
    assert sorted(values(readers.jsonl(spark, str(p), schema, strict=False))) == [("a", 1.5), ("ב", 2.0)]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), schema).collect()
    good, bad = readers.jsonl_with_drops(spark, str(p), schema)
    assert good.count() == 2 and bad.first()[0] == 1
    (tmp_path / "t.txt").write_text('plain\n\n{"transcript": "json"}\n')
    assert sorted(values(readers.texts(spark, str(tmp_path / "t.txt")))) == [("json",), ("plain",)]
    (tmp_path / "c.csv").write_text("id,q\n1,0.5\nx,\ny,bad\n")
    assert sorted(values(readers.catalogue(spark, str(tmp_path / "c.csv"), ["q"])), key=str) == [("1", 0.5), ("x", None), ("y", None)]
    (tmp_path / "l.tsv").write_text("a\t1\tt\tb\t2\tu\n")
    assert values(readers.pairs_list(spark, str(tmp_path / "l.tsv"))) == [("a", 1.0, "t", "b", 2.0, "u")]
    writers.splits(spark.createDataFrame([("a", "train"), ("b", "validation")], "x string, split string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "split=train").exists()
    with pytest.raises(Exception):
        writers.jsonl(good, str(tmp_path / "out"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "step7_2.wav").write_bytes(b"x")
    assert [tuple(r)[2:] for r in readers.named_files(spark, str(tmp_path / "w"), r"step(\d+)_(\d+)\.wav", ["step", "i"]).collect()] == [(7, 2)]


def test_arrow_ipc_source(spark, tmp_path):
    t = pa.table({"a": [1, 2], "b": ["x", "y"]})
    for name, new in (("f.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with new(str(tmp_path / name), t.schema) as out:
            out.write_table(t)
    spark.dataSource.register(readers.ArrowIpc)
    df = spark.read.format("arrow_ipc").option("paths", f"{tmp_path}/f.arrow;{tmp_path}/s.arrow").load()
    assert sorted(values(df)) == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]


def test_reports(spark):
    evals = spark.createDataFrame([(1, 0.5, 0), (1, 0.4, 1), (2, 0.3, 2)], "step int, wer double, row_idx int")
    page = writers.dashboard(evals)
    assert "0.4000" in page and "0.5000" not in page and "<circle" in page
    assert writers.markdown_table(evals.limit(1)).count("\n") == 2
    assert 'text = "say ""hi"""' in writers.textgrid({"words": [(0.0, 1.0, 'say "hi"')]}, 1.0)
    merged = writers.upsert(spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, t int"), spark.createDataFrame([("a", 9, 1)], "k string, v int, t int"), ["k"], "t")
    assert sorted(values(merged)) == [("a", 9, 1), ("b", 2, 0)]


def test_stop_rule_stream(spark, tmp_path):
    rows = [("a", i, i == 2) for i in range(9)] + [("b", i, False) for i in range(9)]
    spark.createDataFrame(rows, "k string, step bigint, e boolean").coalesce(1).write.json(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), "k string, step bigint, e boolean")
    out = streams.run_to_table(streams.stop_rule(stream, "k", "step", "e", 3, 7), "stops", "append", str(tmp_path / "cp"))
    assert sorted(values(out), key=str) == [("a", 2, 5), ("b", None, 7)]


def test_poll_and_score(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "step bigint").coalesce(1).write.json(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    spark.createDataFrame([(2, 0.1)], "step bigint, wer double").write.json(log)
    q = streams.poll_and_score(
        streams.tail(spark, str(tmp_path / "in"), "step bigint"), "step", lambda: spark.read.schema("step bigint, wer double").json(log), lambda df: df.withColumn("wer", F.col("step") / 10.0), lambda df: writers.append_log(df, log), str(tmp_path / "cp")
    )
    q.awaitTermination()
    assert sorted(values(spark.read.schema("step bigint, wer double").json(log))) == [(1, 0.1), (2, 0.1), (3, 0.3)]
