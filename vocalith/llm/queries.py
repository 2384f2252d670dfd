"""The opN queries: thin uses of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, jaccard, media, packing, pii, simhash, token_counts, toxicity, urlfilter
from .common import read


def tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.searched(read(spark, sf_dir, "documents"))


#: (verdict, host, path) of the rules that every url is held against.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.tiktoken"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(read(spark, sf_dir, "documents"))


def op8_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(read(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_document_fingerprints, op3_url_filters, op4_bpe_round_trip, op5_ngram_jaccard_join, op6_toxicity, op7_pii_spans, op8_audio_media, op9_html_extraction, op10_token_counts)
}

_PLACES = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)
"""


def _rule_sql() -> str:
    """CASE arms, longest rule first."""
    return " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in sorted(enumerate(URL_RULES), key=lambda x: (-len(x[1][1] + x[1][2]), x[0]))
    )


def _op3_sql() -> str:
    arms = _rule_sql()
    rule = arms.format(*[f"'{h}{p}'" for _, h, p in URL_RULES])
    verdict = arms.format(*[f"'{v}'" for v, _, _ in URL_RULES])
    return f"{_PLACES} SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM h"


ORACLE_SQL: dict[str, str] = {"op3_url_filters": _op3_sql()}
