"""Numbers: error rates, vector and signal measures, schedules, index rules of quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.binding import bound


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance: each distinct word of the pair becomes one code point, then levenshtein.

    Code points run from U+4E00 past the surrogates to the last one, for over a million distinct words. Looking a word up
    and the distance itself take time in proportion to the product of the lengths.
    """

    def letter(i: Column) -> Column:
        point = i + F.when(i < 0xD800 - 0x4E00, F.lit(0x4E00)).otherwise(F.lit(0x4E00 + 0x800))
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    def coded(ws: Column, letters: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.element_at(letters, w)), "")

    known = F.array_union(reference, hypothesis)
    letters = F.map_from_arrays(known, F.transform(known, lambda w, i: letter(i)))
    return F.element_at(F.transform(F.array(letters), lambda k: F.levenshtein(coded(reference, k), coded(hypothesis, k))), 1)


def char_edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def snr_db(signal: Column, other: Column) -> Column:
    """10 log10 of signal power over error power, over the common length; infinite without error."""
    n = F.least(F.size(signal), F.size(other))
    s, q = F.slice(signal, F.lit(1), n), F.slice(other, F.lit(1), n)
    error = F.zip_with(s, q, lambda x, y: x.cast("double") - y.cast("double"))
    power = dot(error, error)
    return F.when(power == 0, F.lit(math.inf)).otherwise(10 * F.log10(dot(s, s) / power))


def z_scores(values: Column, mean: Column, std: Column) -> Column:
    """Elementwise (value - mean) / max(std, 1e-6)."""
    centred = F.zip_with(values, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / F.greatest(s, F.lit(1e-6)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: real-time speed, error rates."""
    return F.when(b != 0, a / b)


def frames(samples: Column, frame_rate: float, sample_rate: int) -> Column:
    return F.greatest(F.lit(1), F.floor(samples * F.lit(frame_rate) / F.lit(sample_rate)))


def longest_generation(tokens: Column, frame_rate: float) -> Column:
    return F.ceil((tokens / F.lit(3.0) + 2) * F.lit(frame_rate))


def frame_span(first: Column, last: Column, seconds_per_frame: float) -> Column:
    """Start and end seconds of frames first..last, to three decimals."""
    return F.struct(F.round(first * seconds_per_frame, 3).alias("start"), F.round((last + 1) * seconds_per_frame, 3).alias("end"))


def audio_bytes(seconds: Column, rate: int = 24_000, width: int = 2) -> Column:
    return (seconds * F.lit(rate * width)).cast("long")


def warmup_cosine(step: Column, peak: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    """A learning-rate schedule: linear warm-up, then half a cosine down to the floor."""
    along = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, F.lit(peak) * step / F.lit(float(max(1, warmup)))).otherwise(F.lit(floor) + (F.lit(peak - floor) * 0.5) * (1 + F.cos(along * math.pi)))


def scaled(value: Column, lo: float, hi: float, start: float, end: float) -> Column:
    """Linear chart scale."""
    return F.lit(start) + (value - F.lit(lo)) * F.lit((end - start) / ((hi - lo) or 1.0))


def quantile_index(n: Column, rule: str, percent: int) -> Column:
    """0-based index into n ascending values. The rules differ on purpose.

    floor_n1: int(p (n-1)); clamped: min(n-1, int(p n)); plain: int(p n); integer: percent * n // 100.
    """
    if rule == "floor_n1":
        return F.floor(F.lit(percent / 100) * (n - 1)).cast("int")
    if rule == "clamped":
        return F.least(n - 1, F.floor(F.lit(percent / 100) * n)).cast("int")
    if rule == "plain":
        return F.floor(F.lit(percent / 100) * n).cast("int")
    if rule == "integer":
        return F.floor(F.lit(percent) * n / 100).cast("int")
    raise ValueError(rule)


def quantile(values: Column, rule: str, percent: int = 50) -> Column:
    """A quantile of an array by one of the index rules, or its interpolating median."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        if rule == "median":
            return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
        return F.get(ordered, quantile_index(n, rule, percent))

    return bound(F.sort_array(F.filter(values, lambda v: v.isNotNull())), of)
