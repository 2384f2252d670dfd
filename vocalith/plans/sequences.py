"""Timed segments and words, alignments, text shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.functions import text as T
from vocalith.functions.binding import bound
from vocalith.functions.hashing import bucket
from vocalith.operators import sequence
from vocalith.plans.base import WORDS_SQL, bucket_sql, query, ref_words, table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments in whole seconds: a recording per user, as long as the value in minutes."""
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", start.alias("start"), (start + F.round(F.col("value") * 60)).alias("end"), "event_type")


SEGMENTS_SQL = "sg AS (SELECT event_id, user_id, floor(epoch(ts)) AS start, floor(epoch(ts)) + round(value * 60) AS \"end\", event_type FROM events)"


@query(f"""WITH {SEGMENTS_SQL}, l AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start, event_id) AS p FROM sg)
SELECT event_id, user_id, sum(CASE WHEN start - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, event_id)::BIGINT AS group_no FROM l""")
def segment_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gap_groups(segments(spark, sf_dir), "user_id", ["start", "event_id"], "start", "end", 43_200).select("event_id", "user_id", "group_no")


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, o AS (SELECT user_id, start AS s, "end" AS e, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS i FROM sg),
r AS (SELECT user_id, i, s AS gs, e AS ge, 1 AS n, false AS closed, 0 AS g FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, CASE WHEN j THEN r.gs ELSE o.s END, o.e, CASE WHEN j THEN r.n + 1 ELSE 1 END, j AND o.e - r.gs >= 43200, CASE WHEN j THEN r.g ELSE r.g + 1 END
FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT NOT r.closed AND o.s - r.ge <= 86400 AND o.e - r.gs <= 108000 AS j))
SELECT user_id, g AS group_no, arg_max(gs, i) AS first_start, arg_max(ge, i) AS last_end, max(n) AS n FROM r GROUP BY 1, 2""")
def segment_merge_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bounded_groups(segments(spark, sf_dir), "user_id", "start", "event_id", "end", 86_400, 43_200, 108_000)


@query(f"""WITH {SEGMENTS_SQL}, z AS (SELECT user_id, event_id, event_type, start - 1704067200 AS s, "end" - 1704067200 AS e FROM sg),
c AS (SELECT *, greatest(coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS cur FROM z),
k AS (SELECT *, greatest(s, cur) AS a FROM c WHERE e > greatest(s, cur)), x AS (SELECT user_id, max(e) AS last, max(e) + 600 AS until FROM z GROUP BY 1),
t AS (SELECT user_id, a AS tile_start, e AS tile_end, event_type AS label FROM k UNION ALL SELECT user_id, cur, a, '' FROM k WHERE a > cur UNION ALL SELECT user_id, last, until, '' FROM x)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY tile_start) - 1 AS tile_no, tile_start, tile_end, label FROM t""")
def interval_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    s = s.select("user_id", "event_id", "event_type", (F.col("start") - 1704067200).alias("start"), (F.col("end") - 1704067200).alias("end"))
    out = sequence.tiles(s, "user_id", "start", "end", "event_type", "event_id", F.col("end") + 600)
    return out.select("user_id", F.col("tile_no").cast("long").alias("tile_no"), "tile_start", "tile_end", "label")


def timed(ws: Column, slow: int = 0) -> Column:
    """Words with times in milliseconds: word i lasts from 400 i to 400 i + 300, shifted where ``slow`` says."""
    shift = lambda i: F.when(i % 7 == slow, 25).otherwise(i % 3) if slow else F.lit(0)
    return F.transform(ws, lambda w, i: F.struct(w.alias("word"), (i * 400 + shift(i)).cast("double").alias("start"), (i * 400 + 300 + shift(i)).cast("double").alias("end")))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word, generate_subscripts({WORDS_SQL}, 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, regexp_split_to_array(replace(word, 'e', 'e '), ' ') AS ps FROM w),
x AS (SELECT doc_id, i, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS j, len(ps) AS k FROM p)
SELECT doc_id, count(*) AS n_parts, count(*) FILTER (k > 1) AS n_split, sum(CAST(round(1000 * (400 * i + 300.0::DOUBLE / k * j)) AS BIGINT))::BIGINT AS starts FROM x GROUP BY 1""")
def word_even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(timed(ref_words(F.col("text"))), lambda w: F.struct(F.replace(w["word"], F.lit("e"), F.lit("e ")).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    parts = table(spark, sf_dir, "documents").select("doc_id", sequence.even_split(words).alias("ps"), F.size(ref_words(F.col("text"))).alias("k"))
    long = lambda ps: F.filter(ps, lambda p: p["end"] - p["start"] < 299.9)
    starts = F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + F.round(1000 * p["start"]).cast("long"))
    return parts.where(F.size("ps") > 0).select("doc_id", F.size("ps").cast("long").alias("n_parts"), F.size(long(F.col("ps"))).cast("long").alias("n_split"), starts.alias("starts"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws, {bucket_sql('doc_id')} AS pick FROM documents), n AS (SELECT *, len(ws) AS n, len(ws) * 0.4::DOUBLE + 2 AS duration FROM d),
c AS (SELECT doc_id, n, duration, pick, unnest(range(1, n)) AS i FROM n), e AS (SELECT *, ((i - 1) * 0.4::DOUBLE + 0.3 + i * 0.4::DOUBLE) * 0.5 AS cut, (i - 1) * 0.4::DOUBLE + 0.3 AS before FROM c),
v AS (SELECT * FROM e WHERE cut >= 1 AND duration - cut >= 1 AND before < 10), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM v)
SELECT doc_id, round(cut, 6) AS cut, i::INTEGER AS word_index, array_to_string(ws[i + 1:], ' ') AS text, round(least(k.duration, (k.n - 1) * 0.4::DOUBLE + 0.3 + 0.2), 6) AS "end" FROM k JOIN n USING (doc_id) WHERE r = CAST(floor(k.pick * m) AS BIGINT)""")
def word_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ref_words(F.col("text"))
    at = F.transform(ws, lambda w, i: F.struct(w.alias("word"), (i * F.lit(0.4)).alias("start"), (i * F.lit(0.4) + F.lit(0.3)).alias("end")))
    df = table(spark, sf_dir, "documents").select("doc_id", at.alias("w"), (F.size(ws) * F.lit(0.4) + 2).alias("duration"), bucket(F.col("doc_id")).alias("pick"))
    got = df.select("doc_id", sequence.cut_point(F.col("w"), F.col("duration"), F.col("pick")).alias("c")).where("c is not null").select("doc_id", "c.*")
    return got.select("doc_id", F.round("cut", 6).alias("cut"), "word_index", "text", F.round("end", 6).alias("end"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word, generate_subscripts({WORDS_SQL}, 1) - 1 AS i FROM documents)
SELECT doc_id, count(*) AS n, round(min(400.0::DOUBLE * i + 100), 4) AS first_start, round(max(400.0::DOUBLE * i + 400), 4) AS last_end FROM w GROUP BY 1""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", sequence.relative_times(timed(ref_words(F.col("text"))), F.lit(-100.0)).alias("w")).where(F.size("w") > 0)
    ends = lambda c, f: F.transform(c, lambda x: x[f])
    return df.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min(ends("w", "start")).alias("first_start"), F.array_max(ends("w", "end")).alias("last_end"))


_DISAGREE = f"""WITH b AS MATERIALIZED (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents),
d AS (SELECT doc_id, i, n, CASE WHEN i % 7 = 5 THEN 25 ELSE i % 3 END AS x FROM (SELECT doc_id, n, unnest(range(n)) AS i FROM b WHERE n >= 3)),
a AS (SELECT doc_id, max(n) AS n_words, list_sort(list(x)) AS xs, max(x) AS end_max, arg_max(x, i) AS last_word, max(CASE WHEN x = 25 THEN 1 ELSE 0 END) AS big, min(i) FILTER (x = 25) AS worst25, min(i) FILTER (x = 2) AS worst2 FROM d GROUP BY 1),
s AS (SELECT doc_id, n_words, (xs[(n_words - 1) // 2 + 1] + xs[n_words // 2 + 1]) / 2.0::DOUBLE AS median, xs[least(n_words - 1, CAST(floor(0.9 * n_words) AS BIGINT)) + 1]::DOUBLE AS p90, end_max::DOUBLE AS end_max, last_word::DOUBLE AS last_word, coalesce(worst25, worst2) AS worst FROM a)"""


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:

    def of(ws: Column) -> Column:
        return bound(F.transform(sequence.boundary_differences(timed(ws), timed(ws, 5)), lambda x: x["end"]), summary)

    def summary(e: Column) -> Column:
        return bound(F.sort_array(e), lambda s: measures(e, s))

    def measures(e: Column, s: Column) -> Column:
        n = F.size(s)
        middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        worst = F.array_position(e, F.element_at(s, -1)) - 1
        return F.struct(n.cast("long").alias("n_words"), middle.alias("median"), F.get(s, N.quantile_index(n, "clamped", 90)).alias("p90"), F.element_at(s, -1).alias("end_max"), F.element_at(e, -1).alias("last_word"), worst.alias("worst"))

    ws = ref_words(F.col("text"))
    scored = table(spark, sf_dir, "documents").select("doc_id", bound(ws, lambda w: F.when(F.size(w) >= 3, of(w))).alias("d"))
    # written out once, so that no later filter or projection works it out again
    return scored.select("doc_id", F.explode(F.array("d")).alias("d")).where("d is not null").select("doc_id", "d.*")


@query(_DISAGREE + " SELECT doc_id, n_words, median, p90, end_max, last_word, worst FROM s")
def alignment_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disagreement(spark, sf_dir)


@query(_DISAGREE + " SELECT doc_id, p90, median FROM s ORDER BY p90 DESC, median DESC, doc_id LIMIT 20")
def disagreement_rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disagreement(spark, sf_dir).select("doc_id", "p90", "median").orderBy(F.desc("p90"), F.desc("median"), "doc_id").limit(20)


_SPACES = "[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(f"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '{_SPACES}', ' ', 'g'))) AS cleaned, length(trim(regexp_replace(nfc_normalize(text), '{_SPACES}', ' ', 'g')))::BIGINT AS n FROM documents")
def normalize_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return df.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("cleaned"), F.length("t").cast("long").alias("n"))


_ASR = f"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s\\x{{0590}}-\\x{{05FF}}]', ' ', 'g'), '{_SPACES}', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_ASR}) AS normalized FROM documents")
def normalize_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_asr(F.col("text")).alias("t"))
    return df.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("normalized"))


@query("""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z'' ]', '', 'g')) AS matched, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 12) AS slug,
right(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 12) AS slug_end, replace(text, '"', '""') AS quoted FROM documents""")
def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.match_text(c).alias("matched"), T.slug(c).alias("slug"), T.slug(c, last=True).alias("slug_end"), T.escape_quotes(c).alias("quoted"))


_LINE = "replace(replace(regexp_replace(trim(text, ' \t\n\r'), '[\\n\\r]', ' ', 'g'), '  ', ' '), ';', ',')"


@query(f"""WITH l AS (SELECT conv_id, turn, {_LINE} AS t FROM conversations WHERE trim(text, ' \t\n\r') <> ''), w AS (SELECT *, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n, upper(substr(t, 1, 1)) || substr(t, 2) AS u FROM l),
p AS (SELECT *, CASE WHEN regexp_matches(right(u, 1), '[\\p{{L}}\\p{{N}}]') THEN u || '.' ELSE u END AS v FROM w)
SELECT conv_id, turn, CASE WHEN n < 5 THEN '        ' || v ELSE v END AS prompt, CASE WHEN n <= 4 THEN 3 ELSE 1 END AS frames_after FROM p""")
def prompt_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.prepare_prompt(F.col("text")).alias("p"))
    return df.where("p is not null").select("conv_id", "turn", "p.prompt", "p.frames_after")


@query("""WITH RECURSIVE f AS (SELECT conv_id, turn, text FROM conversations), s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM f),
q AS (SELECT conv_id, turn, flatten(list_transform(ss, lambda x: CASE WHEN len(regexp_split_to_array(x, '\\s+')) <= 12 THEN [x] ELSE string_split(regexp_replace(x, '([,;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) END)) AS ps FROM s),
r AS (SELECT conv_id, turn, ps, 0 AS i, []::VARCHAR[] AS done, '' AS open, 0::BIGINT AS n FROM q
UNION ALL SELECT conv_id, turn, ps, i + 1, CASE WHEN n = 0 OR n + k <= 12 THEN done ELSE list_append(done, open) END, CASE WHEN n = 0 THEN p WHEN n + k <= 12 THEN open || ' ' || p ELSE p END, CASE WHEN n = 0 THEN k WHEN n + k <= 12 THEN n + k ELSE k END
FROM (SELECT *, ps[i + 1] AS p, len(regexp_split_to_array(ps[i + 1], '\\s+')) AS k FROM r WHERE i < len(ps)))
SELECT conv_id, turn, array_to_string(CASE WHEN n > 0 THEN list_append(done, open) ELSE done END, '|') AS chunks, len(CASE WHEN n > 0 THEN list_append(done, open) ELSE done END)::BIGINT AS n_chunks FROM r WHERE i = len(ps)""")
def sentence_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chunks(F.col("text"), 12).alias("c"))
    return df.select("conv_id", "turn", F.array_join("c", "|").alias("chunks"), F.size("c").cast("long").alias("n_chunks"))


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events), f AS (SELECT user_id, min(step) FILTER (value > 90) AS eos_step FROM e GROUP BY 1)
SELECT user_id, eos_step, least(coalesce(eos_step + 3, 40), 40) AS stop_step, eos_step IS NULL OR eos_step + 3 > 40 AS capped FROM f""")
def eos_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", "value", step.cast("long").alias("step"))
    return sequence.end_rule(e, "user_id", "step", F.col("value") > 90, 3, 40)


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT user_id, i, CASE WHEN i >= 5 THEN v ELSE 'inf'::DOUBLE END AS best, 0 AS n, NULL::BIGINT AS stop FROM o WHERE i = 0
UNION ALL SELECT r.user_id, o.i, CASE WHEN r.stop IS NULL AND o.i >= 5 AND o.v < r.best THEN o.v ELSE r.best END, CASE WHEN r.stop IS NOT NULL OR o.i < 5 THEN r.n WHEN o.v < r.best THEN 0 WHEN o.v > r.best * 1.5 THEN r.n + 1 ELSE 0 END,
CASE WHEN r.stop IS NOT NULL OR o.i < 5 OR o.v < r.best THEN r.stop WHEN o.v > r.best * 1.5 AND r.n + 1 >= 6 THEN o.i END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS z FROM r) SELECT user_id, best, n AS regressions, stop AS stop_at FROM l WHERE z = 1""")
def early_stop_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", "value", step.alias("step"))
    return sequence.early_stop(e, "user_id", "step", "value", 6, 1.5, 5)
