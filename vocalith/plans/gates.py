"""Gates over catalogues and merged segments, joins of aligned manifests, sums per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions.hashing import bucket
from vocalith.operators import filters, joins, sequence
from vocalith.plans.base import MANIFEST_SQL, bucket_sql, manifest, query, table
from vocalith.plans.sequences import SEGMENTS_SQL, segments


@query(f"""WITH c AS (SELECT p_partkey, p_size AS quality_score, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS duration, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand || '-' || p_partkey END AS source_entry_id FROM part)
SELECT source_entry_id, duration, {bucket_sql('source_entry_id')} AS bucket FROM c WHERE quality_score IS NOT NULL AND duration IS NOT NULL AND coalesce(source_entry_id, '') <> '' AND quality_score >= 20""")
def catalogue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with a score, a length and an id, good enough, with their place in hash order (parts stand in)."""
    c = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("quality_score"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("duration"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("")).otherwise(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("source_entry_id"),
    )
    ok = filters.usable(c, F.col("source_entry_id"), F.col("quality_score"), 20, [F.col("duration")])
    return ok.select("source_entry_id", "duration", bucket(F.col("source_entry_id")).alias("bucket"))


@query(f"""WITH {SEGMENTS_SQL}, l AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start, event_id) AS p FROM sg),
n AS (SELECT *, sum(CASE WHEN start - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, event_id) AS g FROM l),
m AS (SELECT user_id, g, max("end") - min(start) AS d, string_agg(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS text FROM n GROUP BY 1, 2)
SELECT CASE WHEN d < 60 OR d > 100000 THEN 'bad_duration' WHEN text = '' THEN 'no_text' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1""")
def merged_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of merged segments: too short or too long, then without text, else kept."""
    s = sequence.gap_groups(segments(spark, sf_dir), "user_id", ["start", "event_id"], "start", "end", 43_200)
    said = F.when(F.col("event_type") != "view", 1)
    groups = s.groupBy("user_id", "group_no").agg((F.max("end") - F.min("start")).alias("duration"), F.count(said).alias("words"))
    checks = [("bad_duration", ~F.col("duration").between(60, 100_000)), ("no_text", F.col("words") == 0)]
    return filters.reason_counts(groups.withColumn("reason", F.coalesce(filters.first_reason(checks), F.lit("kept"))))


@query("""WITH a AS (SELECT l_orderkey, round((l_extendedprice + 0.001) / 1000, 3) AS start, max(l_quantity) AS qa FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
b AS (SELECT l_orderkey, round((l_extendedprice + 0.0012) / 1000, 3) AS start, arg_max(l_tax, (l_linenumber, l_partkey, l_suppkey, l_tax)) AS tax FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2)
SELECT l_orderkey, start, qa, tax FROM a JOIN b USING (l_orderkey, start)""")
def aligned_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests of partly the same clips, met by path and start to three decimals; the later of equal keys counts."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_linenumber <= 4").select("l_orderkey", ((F.col("l_extendedprice") + 0.001) / 1000).alias("at"), "l_quantity")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    b = lines.where("l_linenumber >= 2").select("l_orderkey", ((F.col("l_extendedprice") + 0.0012) / 1000).alias("at"), F.col("l_tax").alias("tax"), order.alias("o"))
    a = a.withColumn("start", F.round("at", 3)).groupBy("l_orderkey", "start").agg(F.max("l_quantity").alias("qa"))
    met = joins.match_on(a, b.withColumn("start", F.round("at", 3)), ["l_orderkey", "start"], "o", ["tax"])
    return met.select("l_orderkey", "start", "qa", F.col("other_tax").alias("tax"))


@query("""WITH r AS (SELECT doc_id::VARCHAR AS k, quality FROM labels UNION ALL SELECT 'doc/' || doc_id, quality + 10 FROM labels WHERE doc_id % 2 = 0),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR END AS audio, 'root/doc/' || doc_id AS path FROM documents), j AS (SELECT d.*, r.quality FROM d LEFT JOIN r ON r.k = coalesce(d.audio, substr(path, 6)))
SELECT audio IS NULL AS by_path, count(*) AS n, count(quality) AS n_matched, count(*) - count(quality) AS n_missed, sum(quality)::BIGINT AS total FROM j GROUP BY 1""")
def attach_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments by the clip's own id, for clips without one by the path below the root; how many matched."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "doc_id")
    paths = labels.where("doc_id % 2 = 0").select(F.concat(F.lit("doc/"), "key").alias("key"), (F.col("quality") + 10).alias("quality"), "doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).alias("audio"), F.concat(F.lit("root/doc/"), F.col("doc_id").cast("string")).alias("path"))
    keyed = docs.withColumn("key", F.coalesce("audio", F.expr("substring(path, length('root/') + 1)")))
    got = joins.attach(keyed, labels.unionByName(paths), ["key"], "doc_id", ["quality"])
    hit = F.count_if(F.col("matched"))
    return got.groupBy(F.col("audio").isNull().alias("by_path")).agg(F.count("*").alias("n"), hit.alias("n_matched"), (F.count("*") - hit).alias("n_missed"), F.sum("quality").alias("total"))


@query(f"""WITH {MANIFEST_SQL} SELECT {bucket_sql('doc_id')} >= 0.1 AS is_train, count(*) AS n, round(sum(n_chars) / 15.0::DOUBLE / 3600, 6) AS hours FROM m GROUP BY 1""")
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and hours of either split."""
    m = manifest(spark, sf_dir).select((bucket(F.col("doc_id")) >= 0.1).alias("is_train"), "n_chars")
    return m.groupBy("is_train").agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / F.lit(15.0) / 3600, 6).alias("hours"))


@query("SELECT page_id, url FROM pages WHERE contains(replace(url, chr(92), '/'), '/en/')")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose path, with slashes of one kind, holds a given part."""
    return table(spark, sf_dir, "pages").where(F.contains(F.replace("url", F.lit("\\"), F.lit("/")), F.lit("/en/"))).select("page_id", "url")


@query(f"""WITH g AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS group_no FROM orders),
b AS (SELECT *, {bucket_sql("'5-' || o_custkey || '-' || group_no")} AS u FROM g) SELECT o_custkey, group_no, round(greatest(4, 12 * 0.75::DOUBLE) + u * (least(20, 12 * 1.25::DOUBLE) - greatest(4, 12 * 0.75::DOUBLE)), 9) AS target FROM b""")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merged group's own target length, drawn by hash between 12 s less and more a quarter, inside [4 s, 20 s]."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    groups = table(spark, sf_dir, "orders").select("o_custkey", number.cast("long").alias("group_no"))
    return groups.withColumn("target", F.round(sequence.drawn_target(F.col("o_custkey"), F.col("group_no"), 12, 0.25, 4, 20, 5), 9))
