"""Filters, splits, joins, samples and summaries of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.functions.hashing import bucket, content_name, nested_position
from vocalith.operators import aggregates, filters, joins, prefix, sampling, sequence, sets
from vocalith.plans.base import MANIFEST_SQL, bucket_sql, id_bin, manifest, query, table

LONG = 400.0
BUDGET = 200_000


@query(f"""WITH {MANIFEST_SQL} SELECT count(*) AS n, round(sum(n_chars) / 15.0::DOUBLE / 3600, 3) AS hours, count(DISTINCT speaker) AS speakers,
count(DISTINCT speaker || '/' || recording) AS recordings, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic
FROM m LEFT JOIN labels l USING (doc_id)""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = manifest(spark, sf_dir).drop("text").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(1)), "doc_id", "left")
    return df.agg(
        F.count("*").alias("n"),
        F.round(F.sum("n_chars") / F.lit(15.0) / 3600, 3).alias("hours"),
        F.countDistinct("speaker").alias("speakers"),
        F.countDistinct(F.concat_ws("/", "speaker", F.col("recording").cast("string"))).alias("recordings"),
        F.count("labelled").alias("n_labelled"),
        F.count_if(F.col("quality") == 1).alias("n_good"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
    )


@query(f"""WITH {MANIFEST_SQL} SELECT CASE WHEN trim(text) = '' THEN 'empty_text' WHEN duration < 20 OR duration > 400 THEN 'duration' WHEN quality IS NULL THEN 'missing_label'
WHEN NOT regexp_matches(text, '[éèüñß]') THEN 'no_script' ELSE 'kept' END AS reason, count(*) AS n FROM m LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def filter_cascade_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = manifest(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = [("empty_text", F.trim("text") == ""), ("duration", ~F.col("duration").between(20, 400)), ("missing_label", F.col("quality").isNull()), ("no_script", ~F.col("text").rlike("[éèüñß]"))]
    return filters.reason_counts(df.withColumn("reason", F.coalesce(filters.first_reason(checks), F.lit("kept"))))


@query(f"""WITH {MANIFEST_SQL} SELECT CASE WHEN trim(text) = '' THEN 'empty_text' WHEN NOT regexp_matches(text, '[éèüñß]') THEN 'no_script' WHEN duration < 20 OR duration > 400 THEN 'duration'
WHEN speaker IS NULL THEN 'missing_speaker_id' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1""")
def filter_cascade_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("empty_text", F.trim("text") == ""), ("no_script", ~F.col("text").rlike("[éèüñß]")), ("duration", ~F.col("duration").between(20, 400)), ("missing_speaker_id", F.col("speaker").isNull())]
    return filters.reason_counts(manifest(spark, sf_dir).withColumn("reason", F.coalesce(filters.first_reason(checks), F.lit("kept"))))


@query(f"SELECT doc_id, {bucket_sql('doc_id')} AS bucket, CASE WHEN {bucket_sql('doc_id')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def stable_bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.1)


@query("""WITH p AS (SELECT o_orderkey, ((o_orderkey * 2654435761) & 4294967295) / 4294967296::DOUBLE AS position FROM orders)
SELECT o_orderkey, position, position < 0.05 AS in_small, position < 0.2 AS in_large FROM p WHERE position < 0.2""")
def knuth_nested_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", nested_position(F.col("o_orderkey")).alias("position")).where("position < 0.2")
    return df.select("o_orderkey", "position", (F.col("position") < 0.05).alias("in_small"), F.lit(True).alias("in_large"))


@query(f"""WITH o AS (SELECT doc_id, n_chars, {bucket_sql('doc_id')} AS b FROM documents),
s AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY b, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o)
SELECT * FROM s WHERE before < {BUDGET}""")
def budget_prefix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), BUDGET)


@query(f"""WITH {MANIFEST_SQL}, g AS (SELECT speaker, sum(n_chars)::BIGINT AS chars FROM m GROUP BY 1), f AS (SELECT *, {bucket_sql('speaker')} AS b FROM g WHERE chars <= 1.5 * 60000),
s AS (SELECT speaker, coalesce(sum(chars) OVER (ORDER BY b, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
c AS (SELECT speaker FROM s WHERE before < 60000), v AS (SELECT speaker FROM c UNION ALL SELECT speaker FROM (SELECT speaker FROM g ORDER BY chars, speaker LIMIT 1) WHERE (SELECT count(*) FROM c) = 0)
SELECT doc_id, speaker, CASE WHEN speaker IN (SELECT speaker FROM v) THEN 'validation' ELSE 'train' END AS split FROM m""")
def budget_static_skip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("doc_id", "speaker", "n_chars")
    chosen = sampling.static_skip(m.groupBy("speaker").agg(F.sum("n_chars").alias("chars")), "speaker", "chars", 60_000)
    marked = joins.seen_unseen(m, chosen, "speaker")
    return marked.select("doc_id", "speaker", F.when(F.col("is_seen"), "validation").otherwise("train").alias("split"))


_FOLD_SQL = f"""WITH RECURSIVE {MANIFEST_SQL}, g AS (SELECT speaker, sum(n_chars)::BIGINT AS v, {bucket_sql('speaker')} AS b FROM m GROUP BY speaker),
o AS (SELECT speaker, v, row_number() OVER (ORDER BY b, speaker) AS i FROM g), t AS (SELECT sum(v)::DOUBLE AS total, 0.2 * sum(v)::DOUBLE AS target, count(*) AS n FROM g),
sh AS (SELECT * FROM (VALUES (1, 0.02::DOUBLE), (2, 0.05::DOUBLE), (3, 0.25::DOUBLE), (4, 1.5::DOUBLE)) AS x(k, share)),
r AS (SELECT k, share, 0::BIGINT AS i, 0::BIGINT AS acc, []::VARCHAR[] AS keys FROM sh
UNION ALL SELECT r.k, r.share, o.i, CASE WHEN r.acc >= t.target OR o.v > r.share * t.total OR r.acc + o.v > 1.5 * t.target THEN r.acc ELSE r.acc + o.v END,
CASE WHEN r.acc >= t.target OR o.v > r.share * t.total OR r.acc + o.v > 1.5 * t.target THEN r.keys ELSE list_append(r.keys, o.speaker) END FROM r JOIN o ON o.i = r.i + 1 CROSS JOIN t),
f AS (SELECT r.* FROM r, t WHERE r.i = t.n), ok AS (SELECT min(k) AS k FROM f, t WHERE acc >= 0.9 * t.target)
SELECT share, acc, array_to_string(keys, ',') AS keys FROM f WHERE k = coalesce((SELECT k FROM ok), 4)"""


@query(_FOLD_SQL)
def budget_fold_relaxed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = manifest(spark, sf_dir).groupBy("speaker").agg(F.sum("n_chars").alias("v"))
    total = F.sum("v").cast("double")
    got = sampling.relaxed_fold(groups, "speaker", "v", 0.2 * total, total, [0.02, 0.05, 0.25, 1.5])
    return got.select("share", "acc", F.array_join("keys", ",").alias("keys"))


@query(f"""WITH q AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, qty, ((o_orderkey * 2654435761) & 4294967295) / 4294967296::DOUBLE AS p FROM orders JOIN q USING (o_orderkey)),
s AS (SELECT o_orderkey, qty, coalesce(sum(qty) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o WHERE NOT p < 0.2 AND qty > 0) SELECT * FROM s WHERE before < 50000""")
def quota_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    taken = orders.where(nested_position(F.col("o_orderkey")) < 0.2)
    return sampling.top_up(orders.join(qty, "o_orderkey"), taken, "o_orderkey", id_bin(F.col("o_orderkey")), ["o_orderkey"], F.col("qty"), 50_000)


@query("""WITH meta AS (SELECT p_partkey, arg_max(p_brand, v) AS brand, arg_max(p_size, v) AS size FROM (SELECT p_partkey, p_brand, p_size, 0 AS v FROM part UNION ALL SELECT p_partkey, 'new' || p_brand, p_size + 100, 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, brand, size FROM lineitem JOIN meta ON l_partkey = p_partkey""")
def explode_join_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    chapters = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("utterances"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit(0).alias("v"))
    newer = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("new"), "brand").alias("brand"), (F.col("size") + 100).alias("size"), F.lit(1).alias("v"))
    meta = joins.last_wins(part.unionByName(newer), ["p_partkey"], "v").drop("v")
    lines = chapters.select("l_orderkey", F.explode("utterances").alias("u")).select("l_orderkey", "u.*")
    return lines.join(meta, lines["l_partkey"] == meta["p_partkey"]).drop("p_partkey")


@query("""WITH r AS (SELECT doc_id, quality, 0 AS i FROM labels UNION ALL SELECT doc_id, quality + 2, 1 FROM labels WHERE doc_id % 3 = 0), b AS (SELECT doc_id, arg_max(quality, i) AS quality FROM r GROUP BY 1)
SELECT d.doc_id, d.n_chars, b.quality, b.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN b USING (doc_id)""")
def left_attach_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(0).alias("i"))
    right = old.unionByName(old.where("doc_id % 3 = 0").select("doc_id", (F.col("quality") + 2).alias("quality"), F.lit(1).alias("i")))
    return joins.attach(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), right, ["doc_id"], "i", ["quality"])


@query(f"""WITH {MANIFEST_SQL}, c AS (SELECT a.doc_id, b.doc_id AS prompt_doc_id, CASE WHEN b.recording <> a.recording AND b.duration >= {LONG} THEN 1 WHEN b.duration >= {LONG} THEN 2 ELSE 3 END AS tier
FROM m a JOIN m b ON a.speaker = b.speaker AND a.doc_id <> b.doc_id), t AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best FROM c),
k AS (SELECT doc_id, prompt_doc_id, tier, row_number() OVER (PARTITION BY doc_id ORDER BY prompt_doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE tier = best)
SELECT doc_id, tier, prompt_doc_id FROM k WHERE i = CAST(floor({bucket_sql('doc_id')} * n) AS BIGINT)""")
def prompt_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("doc_id", "speaker", "recording", "duration")
    return joins.pair_prompts(m, "doc_id", "speaker", "recording", "duration", LONG, bucket(F.col("doc_id")))


@query(f"""WITH {MANIFEST_SQL}, s AS (SELECT DISTINCT speaker FROM m WHERE {bucket_sql('doc_id')} < 0.02) SELECT m.doc_id, m.speaker, s.speaker IS NOT NULL AS is_seen FROM m LEFT JOIN s USING (speaker)""")
def seen_unseen_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).select("doc_id", "speaker")
    return joins.seen_unseen(m, m.where(bucket(F.col("doc_id")) < 0.02), "speaker").select("doc_id", "speaker", "is_seen")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def theta_anti_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "item_id", "doc_id").select("item_id")


@query(f"""WITH {MANIFEST_SQL}, r AS (SELECT speaker, doc_id, abs(duration - 60) AS away, row_number() OVER (PARTITION BY speaker ORDER BY abs(duration - 60), doc_id) AS rn FROM m WHERE duration >= 20)
SELECT speaker, doc_id, round(away, 6) AS away FROM r WHERE rn = 1 ORDER BY away, speaker LIMIT 10""")
def best_per_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).where("duration >= 20").select("speaker", "doc_id", F.abs(F.col("duration") - 60).alias("away"))
    best = m.groupBy("speaker").agg(F.min(F.struct("away", "doc_id")).alias("r"))
    return best.select("speaker", "r.doc_id", F.col("r.away").alias("a")).orderBy("a", "speaker").limit(10).select("speaker", "doc_id", F.round("a", 6).alias("away"))


@query(f"""WITH {MANIFEST_SQL}, r AS (SELECT doc_id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY {bucket_sql('doc_id')}, doc_id) - 1 AS "offset" FROM m) SELECT * FROM r ORDER BY "offset", speaker LIMIT 150""")
def roundrobin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(manifest(spark, sf_dir).select("doc_id", "speaker"), "speaker", "doc_id", 150).select("doc_id", "speaker", F.col("offset").cast("long").alias("offset"))


@query(f"""WITH {MANIFEST_SQL}, sp AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS s FROM (SELECT DISTINCT speaker FROM m ORDER BY speaker LIMIT 8)),
tx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS t FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 6)), g AS (SELECT * FROM (VALUES (0), (1), (2), (3)) x(grp))
SELECT grp, speaker, item_id, 42 + grp * 1000000 + s * 10000 + t AS seed FROM g, sp, tx""")
def factorial_eval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight speakers, six sentences and four groups: the eval set is that small by definition."""
    number = lambda df, c, n, name: df.select(c).distinct().orderBy(c).limit(n).withColumn(name, F.row_number().over(Window.orderBy(c)) - 1)
    speakers = number(manifest(spark, sf_dir), "speaker", 8, "s")
    texts = number(table(spark, sf_dir, "benchmark"), "item_id", 6, "t")
    groups = spark.range(4).select(F.col("id").alias("grp"))
    out = groups.crossJoin(F.broadcast(speakers)).crossJoin(F.broadcast(texts))
    return out.select(F.col("grp").cast("int").alias("grp"), "speaker", "item_id", (F.lit(42).cast("long") + F.col("grp") * 1000000 + F.col("s") * 10000 + F.col("t")).alias("seed"))


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, i FROM o WHERE i IN (SELECT CAST(floor(k * (n - 1) / 99::DOUBLE) AS BIGINT) FROM range(100) r(k), (SELECT count(*) AS n FROM orders))""")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    numbered = prefix.numbered(orders, id_bin(F.col("o_orderkey")), ["o_orderkey"], "i").drop("_total")
    return sampling.evenly_spaced(numbered, "i", orders.count(), 100).select("o_orderkey", "i")


@query("SELECT event_id % 8 AS shard, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def modulo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", sampling.shard(F.col("event_id"), 8).alias("shard"))
    return df.groupBy("shard").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT CAST(floor(event_id / ceil((SELECT max(event_id) + 1 FROM events) / 8::DOUBLE)) AS BIGINT) AS shard, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    n = events.agg(F.coalesce(F.max("event_id") + 1, F.lit(1))).first()[0]
    df = events.select("event_id", sampling.shard(F.col("event_id"), 8, "contiguous", n).alias("shard"))
    return df.groupBy("shard").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {MANIFEST_SQL} SELECT speaker, count(*) AS n, min(doc_id) AS first_seen FROM m GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 15""")
def top_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_groups(manifest(spark, sf_dir).select("speaker", "doc_id"), "speaker", "doc_id", 15)


@query(f"WITH {MANIFEST_SQL} SELECT median(n) AS median_n FROM (SELECT count(*) AS n FROM m GROUP BY speaker)")
def median_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.median_group_size(manifest(spark, sf_dir).select("speaker"), "speaker")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digit, count(*) FILTER (regexp_matches(text, '[A-Za-z]')) AS with_latin,
count(*) FILTER (regexp_matches(text, '[\\x{0590}-\\x{05FF}]')) AS with_hebrew, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (contains(text, '@')) AS with_at FROM documents GROUP BY 1""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(T.has_digit(c)).alias("with_digit"), F.count_if(T.has_latin(c)).alias("with_latin"), F.count_if(T.has_hebrew(c)).alias("with_hebrew"), F.count_if(T.is_blank(c)).alias("blank"), F.count_if(c.contains("@")).alias("with_at")
    )


@query("SELECT max(s) / greatest(sum(s), 1e-9::DOUBLE) AS largest_share FROM (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS s FROM orders GROUP BY 1)")
def largest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.largest_share(table(spark, sf_dir, "orders"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long"))


@query("""WITH a AS (SELECT l_returnflag AS config, avg(l_quantity) FILTER (l_discount > 0) AS mean_rts, coalesce(min(l_quantity) FILTER (l_tax > 0), 0) AS least, avg(CASE WHEN l_tax > 0.02 THEN l_quantity END) AS mean_quality FROM lineitem GROUP BY 1),
b AS (SELECT mean_rts AS base FROM a WHERE config = 'N') SELECT config, round(coalesce(mean_rts, 0), 9) AS mean_rts, least, round(mean_quality, 9) AS mean_quality, CASE WHEN config <> 'N' THEN round(mean_rts / base, 9) END AS ratio FROM a, b""")
def baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("config")).agg(
        F.coalesce(F.avg(F.when(F.col("l_discount") > 0, q)), F.lit(0.0)).alias("mean_rts"), F.coalesce(F.min(F.when(F.col("l_tax") > 0, q)), F.lit(0.0)).alias("least"), F.avg(F.when(F.col("l_tax") > 0.02, q)).alias("mean_quality")
    )
    out = aggregates.with_baseline(runs, F.col("config") == "N", "config", "mean_rts")
    return out.select("config", F.round("mean_rts", 9).alias("mean_rts"), "least", F.round("mean_quality", 9).alias("mean_quality"), F.round("ratio", 9).alias("ratio"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS base, substr(sha256(url), 1, 12) AS name12, substr(sha256(url), 1, 16) AS name16, sha256(url) AS name64 FROM pages""")
def path_and_id_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(F.regexp_replace(u, "[?#].*$", ""), "([^/]+)/*$", 1).alias("base"), content_name(u, 12).alias("name12"), content_name(u, 16).alias("name16"), content_name(u, 64).alias("name64")
    )


@query("SELECT event_id, ts, user_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "ts", "user_id")
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id")).distinct()
    return sets.pending(work, done, "user_id").select("event_id", "ts", "user_id")


@query("""WITH b AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), w AS (SELECT *, i // 256 AS buffer_no FROM b)
SELECT doc_id, i, buffer_no, (row_number() OVER (PARTITION BY buffer_no ORDER BY n_chars, i) - 1) // 32 AS batch_no FROM w""")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prefix.numbered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), id_bin(F.col("doc_id")), ["doc_id"], "i")
    return sequence.micro_batches(docs, "i", "n_chars", 256, 32).select("doc_id", "i", "buffer_no", "batch_no")


@query("""WITH b AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch_no FROM events), f AS (SELECT batch_no FROM b GROUP BY 1 HAVING count(*) = 64) SELECT batch_no, count(*) AS n, sum(event_id)::BIGINT AS ids FROM b JOIN f USING (batch_no) GROUP BY 1""")
def whole_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = prefix.numbered(table(spark, sf_dir, "events").select("event_id"), id_bin(F.col("event_id")), ["event_id"], "i")
    return sequence.whole_batches(events, "i", 64).groupBy("batch_no").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def extras_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spark-native extra."""
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@query("""SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (y, o_orderpriority)""")
def extras_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spark-native extra."""
    return table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("long")).rollup("y", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def extras_window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spark-native extra."""
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderstatus"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(k).cast("long").alias("q"), F.lag("o_orderkey").over(k).alias("previous"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def key_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return sets.missing(sets.common(c, o, "k"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT kind, id, size FROM (SELECT 'doc' AS kind, doc_id AS id, n_chars AS size FROM documents UNION ALL SELECT 'item', item_id, NULL FROM benchmark)")
def union_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return sets.union_all(docs, table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_wins(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
