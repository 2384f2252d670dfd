"""PII (operator 7): base patterns, and information-theoretic sanitisation.

Base spans are those of four kinds: email, ip, card, phone. The method then measures on the whole corpus how strongly a
term reveals a protected entity: PMI(term; c) = log2(P(c near | term) / P(c near)), from counts of the term within
``NEAR`` words of a base span and counts of it anywhere, held against the information content of c, -log2 P(c near). The
protected c are the four kinds and every single entity.

A term discloses a kind if its PMI reaches the information content over ``ALPHA`` (half of what there is to know) in
``SUPPORT`` texts at least, summed over the entities of the kind, and an entity if it leaves at most ``LEFT_BITS`` of it unknown in ``ENTITY_SUPPORT`` texts.
Texts are families of near copies (documents linked by min-hash bands), so copies of a document count once, edited or
not. A kind's count must also exceed what chance gives by ``SIGMAS`` standard deviations, which matters where entities
are so frequent that half of the information content is little. A disclosing term is generalised where it stands near
an entity; one whose share near them reaches ``GIVES_AWAY`` (it occurs nearly nowhere else) is removed everywhere.
Disclosing terms are looked up in lots of at most ``MOST_TERMS``, each lot in a pass of its own over the texts.

Nulls and edge cases: a null text counts as empty and has no spans; base matches run left to right without
overlap per kind, and a match that fails its test is dropped; repeated rows give repeated rows; other columns pass
through ``sanitise``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bloom, hash_strings, sliced, stored
from .components import components
from .shingles import mix, shingle_sets

KINDS = ("email", "ip", "card", "phone")
NEAR = 3
SUPPORT, ENTITY_SUPPORT = 20, 2
ALPHA, LEFT_BITS, GIVES_AWAY, SIGMAS = 2.0, 1.0, 0.9, 5.0
#: Two documents of Jaccard J over runs of ALIKE_WORDS words share a band of two min-hashes with probability
#: 1 - (1 - J^2)^BANDS: 0.98 at 0.4, 0.01 at 0.02. Runs are short so that much edited copies stay alike.
BANDS, ALIKE_WORDS = 24, 3
MOST_TERMS = 1 << 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+, found from each @ so that long runs cost once."""
    done, at = 0, text.find("@")
    while at >= 0:
        nxt = at + 1
        if at > done and text[at - 1] in _LOCAL and (m := _DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            yield start, m.end()
            done = nxt = m.end()
        at = text.find("@", nxt)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then by start."""
    out = [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _near(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of the words within NEAR words of a base span and outside all of them, each once."""
    words, out = [m.span() for m in _WORD.finditer(text)], set()
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for _, s, e in spans:
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        out |= {*words[max(0, before - NEAR) : before], *words[after : after + NEAR]}
    inside = sorted((s, e) for _, s, e in spans)
    first = [s for s, _ in inside]
    furthest = list(accumulate((e for _, e in inside), max))
    # a word is inside if some span that starts before its end ends after its start
    return sorted(w for w in out if not (i := bisect_left(first, w[1])) or furthest[i - 1] <= w[0])


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def _bands(shingles: np.ndarray) -> list[int]:
    """BANDS hashes of two least hashes each; texts that share one are taken for near copies."""
    least = np.array([mix(shingles ^ seed).min() for seed in _SEEDS])
    with np.errstate(over="ignore"):
        return mix(least[::2] * _SEEDS[1::2] + least[1::2] + _SEEDS[::2]).view(np.int64).tolist()


def near_counts(docs: DataFrame) -> DataFrame:
    """term, kind, entity, near, family: how often each lower-cased word stands near each entity, by family of near copies."""
    schema = pa.schema([("term", pa.string()), ("kind", pa.string()), ("entity", pa.int64()), ("doc", pa.int64()), ("near", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            seen, texts = Counter(), {}
            for x in b.column(0):
                if (t := x.as_py()) and (spans := base_spans(t)):
                    doc = xxhash.xxh64_intdigest(t) - 2**63
                    texts[doc] = t
                    by_start = sorted(spans, key=lambda z: z[1])
                    starts = [z[1] for z in by_start]
                    reach = list(accumulate(by_start, lambda p, z: z if z[2] > p[2] else p))  # ends last, so far
                    for s, e in _near(t, spans):
                        at = bisect_left(starts, e)
                        kind, *closest = min(reach[max(0, at - 1) : at] + by_start[at : at + 1], key=lambda z: max(z[1] - e, s - z[2]))
                        seen[t[s:e].lower(), kind, xxhash.xxh64_intdigest(t[closest[0] : closest[1]]) - 2**63, doc] += 1
            bands = [_bands(x) for x in shingle_sets(pa.array(list(texts.values()), pa.string()), ALIKE_WORDS)]
            # a row per term, entity and document, then one per document with its bands
            term, kind, entity, doc = ([k[i] for k in seen] for i in range(4))
            none = [None] * len(texts)
            yield batch(schema, term=term + none, kind=kind + none, entity=entity + none, doc=doc + list(texts), near=list(seen.values()) + none, bands=[None] * len(seen) + bands)

    rows = stored(_text(docs).mapInArrow(run, "term string, kind string, entity bigint, doc bigint, near bigint, bands array<bigint>"))
    # copies are one text; a band of one text links nothing, any other links its texts to the least of them
    banded = stored(rows.where("bands is not null").select("doc", F.explode("bands").alias("band")).distinct())
    least = banded.groupBy("band").agg(F.min("doc").alias("least"), F.count("*").alias("texts")).where("texts > 1")
    families = components(banded.join(least, "band").select(F.col("doc").alias("a"), F.col("least").alias("b")))
    each = rows.where("bands is null").groupBy("term", "kind", "entity", "doc").agg(F.sum("near").alias("near"))
    each = each.join(families.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("family", F.coalesce("component", "doc"))
    return each.groupBy("term", "kind", "entity", "family").agg(F.sum("near").alias("near"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, near, anywhere, share, kind, bits, content, one, left: the terms that disclose a kind or an entity.

    ``share`` is how often an entity is near; ``kind`` the one of the greatest PMI, ``bits``, of information ``content``;
    ``one`` how often the term stands near the entity that it reveals most, of those with support, and ``left`` what is
    then unknown of that one: its information content less the PMI.
    """
    counts = stored(near_counts(docs))
    by_kind = counts.groupBy("term", "kind").agg(F.sum("near").alias("near"), F.count("*").alias("texts"))
    by_entity = counts.groupBy("term", "entity").agg(F.sum("near").alias("near"), F.count_distinct("family").alias("texts"))
    entities = by_entity.groupBy("term").agg(F.max(F.when(F.col("texts") >= ENTITY_SUPPORT, F.col("near"))).alias("one"))
    kinds = by_kind.groupBy("term").agg(F.sum("near").alias("near"), F.max("texts").alias("texts"), F.collect_list(F.struct("kind", "near", "texts")).alias("kinds"))
    often = stored(kinds.join(entities, "term").where((F.col("texts") >= SUPPORT) | F.col("one").isNotNull()).drop("texts"))
    wanted = bloom(often, "term")
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            seen = Counter()
            for x in b.column(0):
                seen.update(_WORD.findall((x.as_py() or "").lower()))
            terms = list(seen)
            keep = wanted.has(hash_strings(terms))
            kept = [t for t, ok in zip(terms, keep) if ok]
            yield batch(schema, term=[*kept, None], n=[*(seen[t] for t in kept), None], words=[*([None] * len(kept)), seen.total()])

    anywhere = stored(_text(docs).mapInArrow(run, "term string, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("anywhere"), F.sum("words").alias("words")))
    # five numbers: all words, and all words near base spans of each kind
    words = max(1, anywhere.where("term is null").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    rate = {r["kind"]: r["n"] / words for r in counts.groupBy("kind").agg(F.sum("near").alias("n")).collect()}
    rates = F.create_map(*[F.lit(x) for k in KINDS for x in (k, float(min(1.0, rate.get(k) or 1.0)))])
    both = often.join(anywhere.where("term is not null").drop("words"), "term").withColumn("anywhere", F.greatest("anywhere", "near"))

    def judged(k):
        p = F.element_at(rates, k["kind"])
        bits, content, chance = F.log2(k["near"] / F.col("anywhere") / p), -F.log2(p), F.col("anywhere") * p
        sure = (k["texts"] >= SUPPORT) & (k["near"] - chance >= SIGMAS * F.sqrt(chance))
        return F.struct((sure & (bits >= content / ALPHA)).alias("discloses"), bits.alias("bits"), content.alias("content"), k["kind"].alias("kind"))

    share = F.least(F.col("near") / F.col("anywhere"), F.lit(1.0))
    # IC(e) - PMI(term; e) = -log2 P(e near) - log2(P(e near | term) / P(e near)) = -log2 P(e near | term)
    left = -F.log2(F.col("one") / F.col("anywhere"))
    out = both.withColumn("best", F.array_max(F.transform("kinds", judged))).withColumn("left", left).withColumn("share", share)
    out = out.where(F.col("best.discloses") | F.coalesce(F.col("left") <= LEFT_BITS, F.lit(False)))
    return out.select("term", "near", "anywhere", "share", "best.kind", "best.bits", "best.content", "one", "left")


def find_spans(text: str, terms: dict[str, bool], gone: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans of disclosing terms: 'term' to generalise, 'removed' to remove, if in ``gone``)."""
    base = base_spans(text)
    extra = []
    if terms:
        near = set(_near(text, base)) if base else set()
        places = [m.span() for m in _WORD.finditer(text)] if gone else sorted(near)
        for s, e in places:
            term = text[s:e].lower()
            if term in gone:
                if not any(a < e and s < b for _, a, b in base):
                    extra.append(("removed", s, e))
            elif (s, e) in near and term in terms:
                extra.append(("term", s, e))
        extra.sort(key=lambda x: (x[0] != "term", x[1]))
    return base, extra


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by <KIND>; overlapping spans become one."""
    out, done = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], "" if k == "removed" else f"<{k.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _passes(docs: DataFrame, text: str, last, sql: str) -> DataFrame:
    """Finds all spans, a lot of terms at a time, and maps (batch, per row (base spans, other spans)) by ``last``.

    No task or driver holds more than one lot. With one lot, as nearly always, this is one pass; between passes the
    spans found stand in a column of a stored table.
    """
    terms = stored(disclosing_terms(docs.select(F.col(text).alias("text"))).select("term", (F.col("share") >= GIVES_AWAY).alias("always")))
    lots = max(1, -(-terms.count() // (MOST_TERMS // 2)))
    lot = F.pmod(F.xxhash64("term"), F.lit(lots))
    found = "_spans_found"
    while found in docs.columns:
        found += "_"
    at, rows = docs.columns.index(text), docs.withColumn(found, F.lit(None).cast("string"))
    for i in range(lots):
        known = {r["term"]: r["always"] for r in terms.where(lot == i).collect()}
        gone = frozenset(t for t, always in known.items() if always)

        def spans(b: pa.RecordBatch, known=known, gone=gone):
            for x, old in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                base, extra = find_spans(x.as_py() or "", known, gone)
                yield base, sorted({*extra, *_read(old)}, key=lambda z: (z[0] != "term", z[1]))

        def add(batches: Iterator[pa.RecordBatch], spans=spans) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                column = pa.array([written(extra) for _, extra in spans(b)], b.schema.field(b.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], column], schema=b.schema)

        def finish(batches: Iterator[pa.RecordBatch], spans=spans) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                yield last(b, list(spans(b)))

        rows = stored(rows.mapInArrow(add, rows.schema)) if i < lots - 1 else rows.mapInArrow(finish, sql)
    return rows


def _read(spans: str | None) -> list[tuple[str, int, int]]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""

    def last(b: pa.RecordBatch, got: list) -> pa.RecordBatch:
        n = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in KINDS}
        return batch(_OUT, doc_id=b.column(0), **n, base_sha256=[hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], spans=[written(base + extra) for base, extra in got])

    sql = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return _passes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), "text", last, sql)


def sanitise(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with the spans of ``column`` generalised or removed; null stays null."""
    at, width = docs.columns.index(column), len(docs.columns)

    def last(b: pa.RecordBatch, got: list) -> pa.RecordBatch:
        texts = [None if (t := x.as_py()) is None else sanitised(t, base + extra) for x, (base, extra) in zip(b.column(at), got)]
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:width])]
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names[:width])

    return _passes(docs, column, last, docs.schema)
