"""Error rates, statistics, vectors, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.operators import aggregates, joins
from vocalith.plans.base import bucket_sql, query, ref_words, table

# Word edits by dynamic programming in SQL: one row of the table per reference word.
_EDIT_SQL = """WITH RECURSIVE t AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS ws FROM conversations),
p AS (SELECT conv_id, turn, role, ws AS a, list_transform(list_filter(list_transform(ws, lambda w, i: CASE WHEN i % 7 = 0 THEN NULL WHEN i % 11 = 0 THEN 'xx' ELSE w END), lambda w: w IS NOT NULL), lambda w: w) AS b FROM t),
r AS (SELECT conv_id, turn, role, a, b, 0::BIGINT AS i, range(0, len(b) + 1) AS d FROM p
UNION ALL SELECT conv_id, turn, role, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, d[j + 1] + 1, d[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)), [i + 1]) FROM r WHERE i < len(a)),
e AS (SELECT conv_id, turn, role, len(a) AS n_ref, d[len(b) + 1] AS edits, len(b) AS n_hyp FROM r WHERE i = len(a))"""


def hypothesis(ws: Column) -> Column:
    """A corruption: every 7th word dropped, every 11th replaced."""
    marked = F.transform(ws, lambda w, i: F.when((i + 1) % 7 == 0, F.lit(None)).when((i + 1) % 11 == 0, F.lit("xx")).otherwise(w))
    return F.filter(marked, lambda w: w.isNotNull())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ref_words(F.col("text"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ws.alias("a"), hypothesis(ws).alias("b"))
    return df.select("conv_id", "turn", "role", F.size("a").cast("long").alias("n_ref"), N.word_edits(F.col("a"), F.col("b")).cast("long").alias("edits"), F.size("b").cast("long").alias("n_hyp"))


@query(_EDIT_SQL + " SELECT conv_id, turn, n_ref, edits, CASE WHEN n_ref > 0 THEN edits / n_ref::DOUBLE END AS wer FROM e")
def edit_distance_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("conv_id", "turn", "n_ref", "edits", N.ratio(F.col("edits"), F.col("n_ref")).alias("wer"))


@query(_EDIT_SQL + " SELECT role, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, sum(edits) / sum(n_ref)::DOUBLE AS wer, count(*) FILTER (n_hyp = 0) AS empty FROM e GROUP BY 1")
def wer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus-level: edits and lengths are summed, not rates averaged."""
    s = scored(spark, sf_dir).groupBy("role").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"), F.count_if(F.col("n_hyp") == 0).alias("empty"))
    return s.select("role", "edits", "n_ref", N.ratio(F.col("edits"), F.col("n_ref")).alias("wer"), "empty")


@query("""WITH p AS (SELECT page_id, url AS a, replace(replace(url, 'th', 't'), 'example', 'exampel') AS b FROM pages) SELECT page_id, levenshtein(a, b)::BIGINT AS edits, length(a)::BIGINT AS n_ref, levenshtein(a, b) / length(a)::DOUBLE AS cer FROM p""")
def edit_distance_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    other = F.replace(F.replace(u, F.lit("th"), F.lit("t")), F.lit("example"), F.lit("exampel"))
    df = table(spark, sf_dir, "pages").select("page_id", N.char_edits(u, other).cast("long").alias("edits"), F.length(u).cast("long").alias("n_ref"))
    return df.select("page_id", "edits", "n_ref", N.ratio(F.col("edits"), F.col("n_ref")).alias("cer"))


@query(f"""WITH v AS (SELECT s_suppkey AS i, CAST(round(s_acctbal) AS BIGINT) AS v FROM supplier), c AS (SELECT count(*) AS n FROM v), dr AS (SELECT s, i, CAST(floor({bucket_sql("'7-' || s || '-' || i")} * c.n) AS BIGINT) AS k FROM c, range(200) a(s), range((SELECT n FROM c)) b(i)),
m AS (SELECT s, sum(v)::DOUBLE / (SELECT n FROM c) AS m FROM dr JOIN v ON v.i = dr.k GROUP BY s), r AS (SELECT m, row_number() OVER (ORDER BY m, s) - 1 AS r FROM m) SELECT max(m) FILTER (r = 4) AS lo, max(m) FILTER (r = 194) AS hi FROM r""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples of a bounded evaluation set (here the suppliers, whose keys number the rows)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.round("s_acctbal").cast("long").alias("v"))
    return aggregates.bootstrap(s, "i", s.count(), F.col("v"), 200, 7)


@query("""WITH a AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS xs, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n, xs[CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT) + 1] AS q1, xs[least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) + 1] AS q2, xs[CAST(floor(0.9::DOUBLE * n) AS BIGINT) + 1] AS q3, xs[n // 10 + 1] AS q4_low, xs[9 * n // 10 + 1] AS q4_high, (xs[(n - 1) // 2 + 1] + xs[n // 2 + 1]) / 2 AS q5 FROM a""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("xs"), F.count("*").alias("n"))
    xs = F.col("xs")
    return a.select(
        "o_custkey", "n", N.quantile(xs, "floor_n1", 90).alias("q1"), N.quantile(xs, "clamped", 90).alias("q2"), N.quantile(xs, "plain", 90).alias("q3"), N.quantile(xs, "integer", 10).alias("q4_low"), N.quantile(xs, "integer", 90).alias("q4_high"), N.quantile(xs, "median").alias("q5")
    )


@query("""WITH v AS (SELECT least(greatest(CAST(floor((l_extendedprice - 1000) / ((100000 - 1000) / 30.0::DOUBLE)) AS BIGINT), 0), 29) AS bin FROM lineitem WHERE l_extendedprice IS NOT NULL), c AS (SELECT bin, count(*) AS n FROM v GROUP BY 1)
SELECT b.bin::INTEGER AS bin, coalesce(n, 0) AS n FROM range(30) b(bin) LEFT JOIN c USING (bin)""")
def histogram_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 1000, 100_000, 30)


@query("""WITH p AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events) SELECT event_id, event_type || '/k' AS name, k AS v FROM p WHERE k IS NOT NULL UNION ALL SELECT event_id, event_type || '/value', value FROM p WHERE value IS NOT NULL""")
def json_flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested measurements and top-level numbers under type/key; nulls drop out."""
    metrics = F.from_json("props", "map<string, double>")
    flat = F.map_concat(metrics, F.create_map(F.lit("value"), F.col("value")))
    named = F.transform_keys(F.map_filter(flat, lambda k, v: v.isNotNull()), lambda k, v: F.concat_ws("/", F.col("event_type"), k))
    return table(spark, sf_dir, "events").select("event_id", F.explode(named).alias("name", "v"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS step, value FROM events), l AS (SELECT user_id, step, arg_max(value, event_id) AS wer, max(event_id) AS event_id FROM e GROUP BY 1, 2)
SELECT user_id, arg_min(step, (wer, step)) AS best_step, min(wer) AS best_wer, arg_max(wer, step) AS latest_wer, count(*) AS n_steps FROM l GROUP BY 1""")
def latest_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("step"), F.col("value").alias("wer"))
    last = joins.last_wins(e, ["user_id", "step"], "event_id")
    return last.groupBy("user_id").agg(F.min_by("step", F.struct("wer", "step")).alias("best_step"), F.min("wer").alias("best_wer"), F.max_by("wer", "step").alias("latest_wer"), F.count("*").alias("n_steps"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS similarity FROM p""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(N.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(10 * log10(list_dot_product(x, x) / list_dot_product(e, e)), 6) AS snr FROM p""")
def snr_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(N.snr_db(F.col("x"), F.col("y")), 6).alias("snr"))


@query("""WITH t AS (SELECT DISTINCT lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z]+'), lambda w: w <> '')) AS piece FROM documents), s AS (SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS shared FROM t a JOIN t b ON a.piece = b.piece AND a.lang < b.lang GROUP BY 1, 2)
SELECT lang_a, lang_b, shared FROM s""")
def piece_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that the vocabularies of two languages share; a piece's languages are few and form its pairs."""
    pieces = F.filter(F.split(F.lower("text"), "[^a-zA-Z]+"), lambda w: w != "")
    t = table(spark, sf_dir, "documents").select("lang", F.explode(pieces).alias("piece")).distinct()
    langs = t.groupBy("piece").agg(F.array_sort(F.collect_set("lang")).alias("ls")).where(F.size("ls") > 1)
    pairs = F.flatten(F.transform("ls", lambda x, i: F.transform(F.slice("ls", i + 2, F.size("ls")), lambda y: F.struct(x.alias("lang_a"), y.alias("lang_b")))))
    return langs.select(F.explode(pairs).alias("p")).groupBy("p.lang_a", "p.lang_b").agg(F.count("*").alias("shared"))


@query("""SELECT lang, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars,
sum(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''))) / sum(length(text))::DOUBLE AS tokens_per_char FROM documents GROUP BY 1""")
def tokens_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size(ref_words(F.col("text")))).alias("tokens"), F.sum(F.length("text")).alias("chars"))
    return df.withColumn("tokens_per_char", N.ratio(F.col("tokens"), F.col("chars")))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT user_id, step, round(CASE WHEN step < 10 THEN 0.001::DOUBLE * step / 10 ELSE 0.0005::DOUBLE * (1 + cos(least(1.0::DOUBLE, (step - 10) / 90.0::DOUBLE) * pi())) END, 12) AS rate FROM e""")
def learning_rate_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", step.cast("long").alias("step"))
    return e.select("user_id", "step", F.round(N.warmup_cosine(F.col("step"), 0.001, 10, 100), 12).alias("rate"))


@query("""SELECT greatest(1, CAST(floor(n_chars * 12.5::DOUBLE / 240) AS BIGINT)) AS frames, CAST(ceil((n_chars / 3.0::DOUBLE + 2) * 12.5::DOUBLE) AS BIGINT) AS longest, CAST(floor(n_chars / 15.0::DOUBLE * 48000) AS BIGINT) AS bytes, doc_id FROM documents""")
def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", N.frames(n, 12.5, 240).cast("long").alias("frames"), N.longest_generation(n, 12.5).cast("long").alias("longest"), N.audio_bytes(n / F.lit(15.0)).alias("bytes"))


@query("""WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) SELECT round(avg(m), 9) AS mean FROM m""")
def mean_of_worker_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mean_of_means(table(spark, sf_dir, "events"), "event_type", "value").select(F.round("mean", 9).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT user_id, i, v AS ema FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, r.ema * 0.9 + o.v * 0.1 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, round(arg_max(ema, i), 6) AS ema FROM r GROUP BY 1""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.moving_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9).select("user_id", F.round("ema", 6).alias("ema"))
