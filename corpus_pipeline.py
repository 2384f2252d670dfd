"""A corpus pipeline over ``documents``: toxicity, near duplicates, PII, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
``documents`` but for the last, which returns the packed pieces. ``run`` writes each stage's result as Parquet in the
cluster's shared folder and rereads it as the next one's ``docs``.

``n_chars`` follows ``text`` where a stage changes it. SQL cannot express the stages (boosted trees, byte-pair ids),
so ``ORACLE_SQL`` is None; ``tests/llm`` hold the operators of stages two to four against brute-force versions, and the
stages against the operators. In every stage an empty table gives no rows and other columns, whatever their names, pass
through (the last stage drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import jaccard, packing, pii, toxicity
from vocalith.llm.common import read, stored
from vocalith.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; null and empty texts stay."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each linked group; of rows that repeat it, the least text.

    Texts without words link with nothing and stay; a null doc_id stays unless its text has copies.
    """
    groups = jaccard.jaccard_components(docs)
    own = groups.where("component_id = doc_id or component_id is null").select("doc_id", "n_shingles")
    ids = own.select("doc_id").where("doc_id is not null").distinct()
    kept = docs.join(ids, docs["doc_id"] == ids["doc_id"], "left_semi")
    if not own.where("doc_id is null").isEmpty():
        kept = kept.unionByName(docs.where("doc_id is null"))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    others = [c for c in docs.columns if c != "doc_id"]
    # columns of any type, maps too, are told apart by their text
    place = F.struct(F.col("text"), F.xxhash64(F.to_json(F.struct(*others))))
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), place).alias("r"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("doc_id", "r.*").select(*docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces base spans by their kinds, generalises or removes disclosing terms; keeps every row."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every kept document into sequences of at most 2048 ids."""
    return packing.pack(docs, *tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
