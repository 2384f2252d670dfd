"""Checks, guards, fallbacks, retention and layout changes of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.functions import text as T
from vocalith.operators import aggregates, filters, joins, sampling, sequence, sets
from vocalith.plans.base import MANIFEST_SQL, WORDS_SQL, bucket_sql, manifest, query, ref_words, table
from vocalith.plans.measures import hypothesis
from vocalith.sources import writers

_PAIR_SQL = f"""WITH w AS (SELECT conv_id, turn, {WORDS_SQL} AS a FROM conversations),
p AS (SELECT conv_id, turn, a, list_filter(list_transform(a, lambda w, i: CASE WHEN i % 7 = 0 THEN NULL WHEN i % 11 = 0 THEN 'xx' ELSE w END), lambda w: w IS NOT NULL) AS b FROM w)"""


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's words and a corrupted copy of them."""
    ws = ref_words(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("a"), hypothesis(ws).alias("b"))


@query(_PAIR_SQL + " SELECT conv_id, turn, len(b) AS n_words, array_to_string(b, ' ') = array_to_string(a, ' ') AS reproduces FROM p WHERE len(b) >= 2")
def transcript_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the aligned words, joined, are the transcript; fewer than two words are left out uncounted."""
    same = F.array_join("b", " ") == F.array_join("a", " ")
    return word_pairs(spark, sf_dir).where(F.size("b") >= 2).select("conv_id", "turn", F.size("b").cast("long").alias("n_words"), same.alias("reproduces"))


@query(_PAIR_SQL + " SELECT conv_id, turn, len(a) AS n_words, CASE WHEN len(a) = len(b) THEN array_to_string(b, ' ') END AS attached FROM p")
def attach_same_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = word_pairs(spark, sf_dir)
    got = joins.attach_if(pairs.select("conv_id", "turn", "a"), pairs.select("conv_id", "turn", "b"), ["conv_id", "turn"], "b", F.size("a") == F.size("b"))
    return got.select("conv_id", "turn", F.size("a").cast("long").alias("n_words"), F.array_join("b", " ").alias("attached"))


@query("""WITH l AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT event_id, k, n_name AS sentence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) JOIN l ON k = i""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's index picks its sentence from a list (here the nations, one short row)."""
    clips = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    sentences = table(spark, sf_dir, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return joins.positional(clips, "k", sentences, "names", "sentence")


@query("""WITH a AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1)
SELECT c_custkey, coalesce(a.k, b.k, -c_custkey) AS prompt, CASE WHEN a.k IS NOT NULL THEN 'first' WHEN b.k IS NOT NULL THEN 'second' ELSE 'original' END AS tier FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def fallback_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    best = lambda p: orders.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("prompt"))
    choices = [("first", best("1-URGENT")), ("second", best("2-HIGH"))]
    return joins.first_present(table(spark, sf_dir, "customer").select("c_custkey"), choices, "c_custkey", "prompt", -F.col("c_custkey"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, min(role) AS first_role FROM conversations GROUP BY 1), r AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT r.conv_id, r.role AS name, r.n FROM r JOIN c USING (conv_id) WHERE c.n > 4 UNION ALL SELECT conv_id, 'all', n FROM c WHERE n <= 4""")
def legacy_groups_upcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of an older layout (short conversations stand in for them) have totals only: they get one group."""
    per_role = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    reports = per_role.groupBy("conv_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("role").alias("name"), "n")).alias("groups"))
    reports = reports.withColumn("groups", F.when(F.col("total") > 4, F.col("groups")))
    one = F.struct(F.lit("all").alias("name"), F.col("total").alias("n"))
    return reports.select("conv_id", F.explode(filters.upcast(F.col("groups"), one)).alias("g")).select("conv_id", "g.name", "g.n")


@query("""WITH ok AS (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, '[éèüñß]'))
SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS n_prompts FROM conversations WHERE conv_id IN (SELECT conv_id FROM ok) GROUP BY 1""")
def refuse_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without one sentence in the script are not scored; of the others, how many rows have a prompt."""
    rows = filters.allowed_groups(table(spark, sf_dir, "conversations"), "conv_id", F.col("text").rlike("[éèüñß]"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "system").alias("n_prompts"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def constraint_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows must carry a language (a null one means English) and a length; one that does not fails the query."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("en")).alias("lang"), "n_chars")
    return filters.require(docs, F.col("n_chars") >= 0, "a row has no length").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN n_chars < 300 THEN 'too_short' WHEN n_chars > 6000 THEN 'too_long' END AS reason FROM documents)
SELECT reason, count(*) AS n, sum(n_chars)::BIGINT AS seconds_lost, min(doc_id) AS first_seen FROM d WHERE reason IS NOT NULL GROUP BY 1""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("empty_text", F.trim("text") == ""), ("too_short", F.col("n_chars") < 300), ("too_long", F.col("n_chars") > 6000)]
    failed = table(spark, sf_dir, "documents").withColumn("reason", filters.first_reason(checks)).where("reason is not null")
    return aggregates.failure_classes(failed, "reason", F.col("n_chars"), "doc_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value < 20) AS n_hit, round(count(*) FILTER (value < 20) * 100.0::DOUBLE / count(*), 2) AS percent FROM events GROUP BY 1")
def uncuttable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*aggregates.rate(F.col("value") < 20))


@query(f"""WITH {MANIFEST_SQL}, r AS (SELECT speaker, doc_id, n_chars, row_number() OVER (PARTITION BY speaker ORDER BY n_chars DESC, doc_id) AS r FROM m)
SELECT speaker, doc_id, n_chars FROM r WHERE r = 1 ORDER BY n_chars DESC, speaker LIMIT 10""")
def longest_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.longest_per_group(manifest(spark, sf_dir), "speaker", "doc_id", "n_chars", 10)


@query("SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE value >= 150 GROUP BY 1")
def first_qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first clip that is long enough."""
    return table(spark, sf_dir, "events").where("value >= 150").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query(f"SELECT item_id FROM benchmark ORDER BY {bucket_sql("'3-' || item_id")}, item_id LIMIT 20")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: twenty items without replacement, then in order."""
    return sampling.hash_sample(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 20, 3).orderBy("item_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) <= 100 AS keep FROM events")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest stay; the rest is the list to delete."""
    newest, rest = sets.newest(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)
    return newest.withColumn("keep", F.lit(True)).unionByName(rest.withColumn("keep", F.lit(False)))


@query("""WITH a AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, 'purchase', event_id, -value FROM events WHERE event_type = 'error')
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM a GROUP BY 1, 2""")
def upsert_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks per annotator and clip: a later mark replaces the earlier one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old, new = e.where("event_type <> 'error'"), e.where("event_type = 'error'").withColumn("event_type", F.lit("purchase")).withColumn("value", -F.col("value"))
    return writers.upsert(old, new, ["user_id", "event_type"], "event_id")


@query("""SELECT page_id, upper(url) AS folded, regexp_replace(url, '[^a-z]', '', 'g') AS known, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', '') AS renamed FROM pages""")
def case_and_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    renamed = F.regexp_replace(F.regexp_replace(u, "^https?://", ""), "/+$", "")
    folded, known = T.fold_case(u, "ABCDe"), T.keep_vocabulary(u, "abcdefghijklmnopqrstuvwxyz")
    return table(spark, sf_dir, "pages").select("page_id", folded.alias("folded"), known.alias("known"), T.escape_html(u).alias("escaped"), renamed.alias("renamed"))


@query("""SELECT l_orderkey, l_linenumber, round(l_linenumber * 0.08::DOUBLE, 3) AS span_start, round((l_linenumber + l_quantity + 1) * 0.08::DOUBLE, 3) AS span_end, 40 + (l_quantity - 0) * (560 / 50.0::DOUBLE) AS x, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped FROM lineitem""")
def spans_and_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame spans in seconds, chart positions, formatted times."""
    span = N.frame_span(F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity"), 0.08)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", span.alias("s"), N.scaled(F.col("l_quantity"), 0, 50, 40, 600).alias("x"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))
    return df.select("l_orderkey", "l_linenumber", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "x", "shipped")


@query("""WITH f AS (SELECT user_id, event_id, value, first_value(value) OVER w AS f, lag(value) OVER w AS p, lag(value, 2) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(0.5::DOUBLE * value + 0.25::DOUBLE * coalesce(p, f) + 0.25::DOUBLE * coalesce(q, f), 6) AS filtered FROM f""")
def causal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.causal_filter(table(spark, sf_dir, "events"), "user_id", "event_id", "value", [0.5, 0.25, 0.25])
    return out.select("user_id", "event_id", F.round("filtered", 6).alias("filtered"))


@query("""SELECT user_id, event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)::VARCHAR AS context FROM events""")
def sliding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four latest values up to each row."""
    from vocalith.streaming.streams import sliding_context as context

    out = context(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id", 4)
    return out.select("user_id", "event_id", F.concat(F.lit("["), F.array_join(F.col("context").cast("array<string>"), ", "), F.lit("]")).alias("context"))
