"""Toxicity (operator 6): gradient-boosted trees over dense features, with isotonic calibration.

The model is fitted on a bounded, documented sample of labelled rows (``SAMPLE_ROWS``, in hash order) and then
scores every document whole. The lexicon is learnt from the sample: words and word beginnings that occur in far more
toxic than other documents (near copies in the sample count once). Features: lexicon densities and weights, hits near
second-person words, capitals, punctuation, obfuscation and repetition rates. A row's training features use
a lexicon counted without that row's fold. Trees are fitted on all folds but the last, on which scores are calibrated.

Nulls and edge cases: a null or empty text has all-zero features and is scored like any other; rows without a label,
or with one other than 0 and 1, are not learnt from; a doc_id labelled both 0 and 1 counts as 1; with no labelled rows, or one class only, every score is that
class's share (0 without labels); repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, hash_longs, sliced, stored
from .shingles import shingle_sets

SAMPLE_ROWS = 20_000
FOLDS = 5
#: Entries of the lexicon at most: the strongest.
MOST_TERMS = 4096
#: A lexicon entry: seen in so many toxic documents at least, with so large a log odds ratio.
SUPPORT, LOG_ODDS = 3, 2.0
BEGINNINGS = (4, 5, 6, 7)
NEAR = 4
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LEAST = 80, 3, 0.15, 32, 5

# Second-person words of English, German, French, Spanish.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro".split())
# Look-alike characters and the letters that they stand for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1{2,}")
MEMORY = 200_000

_CLASS = np.zeros(256, np.uint8)  # of bytes: 1 capital, 2 letter, 4 digit, 8 exclamation or question, 16 other sign
_CLASS[65:91] = 3
_CLASS[97:123] = 2
_CLASS[48:58] = 4
_CLASS[[33, 63]] = 8
for _i in (*range(34, 48), *range(58, 63), 64, *range(91, 97), *range(123, 127)):
    _CLASS[_i] = 16


def plain(token: str) -> tuple[str, bool]:
    """A token's word: lower case, trimmed, look-alikes and inner signs undone; and whether that undid anything."""
    word = _EDGE.sub("", token).lower()
    if word.isalpha():
        short = _REPEAT.sub(r"\1\1", word)
        return short, short != word
    core = token.lower().strip(".,;:?\"'()[]{}#*&%-—…")
    if any(c.isalpha() for c in core):
        undone = _INNER.sub("", core.translate(LOOKALIKES))
        if undone and undone != word:
            return undone, True
    return word, False


def terms_of(word: str) -> list[str]:
    return [f"={word}", *[word[:k] for k in BEGINNINGS if len(word) > k]] if word else []


class Words(dict):
    """Token to 0 (nothing special) or (weight, word, second person, obfuscated, capitals)."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str):
        word, undone = plain(token)
        weight = max((self.weights.get(t, 0.0) for t in terms_of(word)), default=0.0)
        letters = [c for c in token if c.isalpha()]
        you, caps = word in SECOND_PERSON, len(letters) > 2 and token.upper() == token
        out = (weight, word, you, undone, caps) if weight or you or undone or caps else 0
        if len(self) >= MEMORY:
            self.clear()
        self[token] = out
        return out


N_FEATURES = 16


def features(text: str, words: Words) -> list[float]:
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * N_FEATURES
    special = [(i, x) for i, x in enumerate(map(words.__getitem__, tokens)) if x]
    hits = [(i, x) for i, x in special if x[0]]
    you = [i for i, x in special if x[2]]
    close = sum(any(abs(i - j) <= NEAR for j in you) for i, _ in hits) if you and hits else 0
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=17)
    letters = max(1, int(kinds[2] + kinds[3]))
    weights = [x[0] for _, x in hits]
    return [
        math.log1p(n),
        len(hits) / n,
        math.log1p(len(hits)),
        sum(w >= 4 for w in weights) / n,
        math.log1p(sum(w >= 4 for w in weights)),
        math.log1p(len({x[1] for _, x in hits})),
        sum(weights) / n,
        max(weights, default=0.0),
        math.log1p(close),
        len(you) / n,
        int(kinds[3]) / letters,
        sum(x[4] for _, x in special) / n,
        int(kinds[8]) / n,
        int(kinds[16]) / n,
        sum(x[3] for _, x in special) / n,
        math.log1p(sum(1 for _, x in hits if x[3])),
    ]


class Lexicon:
    """Counts per term and fold of toxic and other documents."""

    def __init__(self, terms: list[str], toxic: np.ndarray, other: np.ndarray, n_toxic: np.ndarray, n_other: np.ndarray):
        self.terms, self.toxic, self.other, self.n_toxic, self.n_other = terms, toxic, other, n_toxic, n_other

    def weights(self, without: int | None = None) -> dict[str, float]:
        keep = np.array([f != without for f in range(FOLDS)])
        a, b = self.toxic[:, keep].sum(1), self.other[:, keep].sum(1)
        na, nb = self.n_toxic[keep].sum(), self.n_other[keep].sum()
        w = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
        ok = (a >= SUPPORT) & (w >= LOG_ODDS)
        return {t: float(x) for t, x, y in zip(self.terms, w, ok) if y}


class Trees:
    """Boosted regression trees for the logistic loss over binned features; complete trees of fixed depth."""

    def __init__(self, base: float, edges: list[np.ndarray]):
        self.base, self.edges = base, edges
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self = cls(float(np.log(p / (1 - p))), [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, BINS))) for c in x.T])
        q, score = self.binned(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255, np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, BINS + 1
                best = np.full(2**level, 1e-9)
                for j in range(q.shape[1]):
                    at = node * width + q[:, j]
                    gs, hs, ns = (np.bincount(at, v, 2**level * width).reshape(-1, width).cumsum(1) for v in (g, h, np.ones_like(g)))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(len(k)), k] > best
                    best[better] = gain[np.arange(len(k)), k][better]
                    feature[first : first + len(k)][better] = j
                    cut[first : first + len(k)][better] = k[better]
                node = 2 * node + (q[np.arange(len(q)), feature[first + node]] > cut[first + node])
            leaf = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            score += leaf[node]
            self.splits.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        q, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.splits:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + (q[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, rising shares) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Lexicon weights, trees and calibration; small, and sent to every task."""

    def __init__(self, share: float, weights: dict[str, float] | None = None, trees: Trees | None = None, steps=None):
        self.share, self.weights, self.trees, self.steps = share, weights or {}, trees, steps
        self.words: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"words": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if self.words is None:
            self.words = Words(self.weights)
        raw = self.trees.score(np.array([features(t, self.words) for t in texts]).reshape(-1, N_FEATURES))
        # the raw score decides inside a calibrated step, so that ties of the steps stay in order
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id) -> F.Column:
    """Rows never learnt from: crc32 of the decimal doc_id, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    sample = stored(sample.select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).cast("int").alias("fold"), "doc_id"))
    # near copies: one of those that share the least or the greatest shingle
    ends = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            own = hash_longs(b.column(0)).view(np.int64)
            sets = [s.view(np.int64) for s in shingle_sets(b.column(1))]
            yield batch(ends, doc_id=b.column(0), lo=[s[0] if len(s) else o for s, o in zip(sets, own)], hi=[s[-1] if len(s) else o for s, o in zip(sets, own)])

    marks = sample.select("doc_id", "text").mapInArrow(marked, "doc_id bigint, lo bigint, hi bigint")
    once = stored(marks.groupBy("lo").agg(F.min_by("hi", "doc_id").alias("hi"), F.min("doc_id").alias("doc_id")).groupBy("hi").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    single = stored(sample.join(F.broadcast(once), "doc_id", "left_semi"))
    counted = pa.schema([("term", pa.string()), ("fold", pa.int32()), ("n", pa.int64())])

    def counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        """Documents per term and fold, of the wanted terms if such are given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                seen = Counter()
                for text, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = {t for w in {plain(x)[0] for x in set((text or "").split())} for t in terms_of(w)}
                    seen.update((t, fold) for t in (found if wanted is None else found & wanted))
                yield batch(counted, term=[t for t, _ in seen], fold=[f for _, f in seen], n=list(seen.values()))

        per_fold = rows.select("text", "fold").mapInArrow(run, "term string, fold int, n bigint").groupBy("term")
        return per_fold.agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)], F.sum("n").alias("n"))

    sizes = {(r["fold"], r["toxic"]): r["n"] for r in single.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = (np.array([sizes.get((f, v), 0) for f in range(FOLDS)], np.int64) for v in (1, 0))
    if not n_toxic.sum() or not n_other.sum():
        return Model(1.0 if n_toxic.sum() else 0.0)
    # terms of toxic documents first: the sample bounds them, and only they need counting in the others
    toxic = {r["term"]: r for r in counts(single.where("toxic = 1"), None).where(F.col("n") >= SUPPORT).collect()}
    other = {r["term"]: r for r in counts(single.where("toxic = 0"), frozenset(toxic)).collect()}
    odds = {t: math.log((r["n"] + 0.5) / (n_toxic.sum() + 1)) - math.log(((other[t]["n"] if t in other else 0) + 0.5) / (n_other.sum() + 1)) for t, r in toxic.items()}
    top = sorted((t for t, x in odds.items() if x >= LOG_ODDS), key=lambda t: (-odds[t] * math.sqrt(toxic[t]["n"]), t))[:MOST_TERMS]
    table = lambda found: np.array([[found[t][f"n{f}"] if t in found else 0 for f in range(FOLDS)] for t in top], np.int64).reshape(-1, FOLDS)
    lexicon = Lexicon(top, table(toxic), table(other), n_toxic, n_other)
    rows = pa.schema([("toxic", pa.int32()), ("fold", pa.int32()), ("x", pa.list_(pa.float64()))])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(lexicon.weights(f)) for f in range(FOLDS)]
        for b in sliced(batches):
            yield batch(rows, toxic=b.column(1), fold=b.column(2), x=[features(t or "", words[f]) for t, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist())])

    # at most sample_rows rows of sixteen numbers
    got = single.select("text", "toxic", "fold").mapInArrow(featured, "toxic int, fold int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist()).reshape(-1, N_FEATURES)
    y, fold = got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    fitted = fold != FOLDS - 1
    if len({*y[fitted]}) < 2 or len({*y[~fitted]}) < 2:
        fitted = np.ones(len(y), bool)
    trees = Trees.fit(x[fitted], y[fitted])
    rest = ~fitted if (~fitted).any() else fitted
    return Model(float(y.mean()), lexicon.weights(), trees, isotonic(trees.score(x[rest]), y[rest]))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield batch(schema, doc_id=b.column(0), score=model.score([x or "" for x in b.column(1).to_pylist()]))

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(model.score([x or "" for x in b.column(at).to_pylist()]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
