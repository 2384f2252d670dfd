"""Sequence operators: merging, splitting and tiling of timed segments and words."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.binding import bound
from vocalith.functions.hashing import bucket


def gap_groups(df: DataFrame, key: str, order: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Adds ``group_no`` per key: a new group begins where the pause before a segment exceeds the gap."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(start) - F.lag(end).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w)).drop("_new")


def bounded_groups(df: DataFrame, key: str, start: str, unique: str, end: str, gap: float, target: float, most: float) -> DataFrame:
    """Segments merged per key into groups: key, group_no, first_start, last_end, n.

    A segment joins the open group if the pause is at most ``gap`` and the group would span at most ``most``; a
    group that spans ``target`` closes; gap <= 0 leaves every segment alone. The rule depends on where the group
    began, so it is a fold over the key's segments in order.
    """
    item = F.struct(F.col(start).cast("double").alias("s"), F.col(unique).alias("u"), F.col(end).cast("double").alias("e"))
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    span = "struct<s: double, e: double, n: int>"
    none = F.lit(None).cast(span)
    zero = F.struct(F.array().cast(f"array<{span}>").alias("done"), none.alias("open"))
    group = lambda s, e, n: F.struct(s.alias("s"), e.alias("e"), n.alias("n"))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def step(a: Column, x: Column) -> Column:
        own = group(x["s"], x["e"], F.lit(1))
        grown = group(a["open"]["s"], x["e"], a["open"]["n"] + 1)
        joins = F.lit(gap > 0) & (x["s"] - a["open"]["e"] <= gap) & (x["e"] - a["open"]["s"] <= most)
        full = x["e"] - a["open"]["s"] >= target
        return (
            F.when(a["open"].isNull(), state(a["done"], own))
            .when(joins & full, state(F.concat(a["done"], F.array(grown)), none))
            .when(joins, state(a["done"], grown))
            .otherwise(state(F.concat(a["done"], F.array(a["open"])), own))
        )

    groups = F.aggregate("xs", zero, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    out = listed.select(key, F.posexplode(groups).alias("group_no", "g"))
    return out.select(key, "group_no", F.col("g.s").alias("first_start"), F.col("g.e").alias("last_end"), F.col("g.n").alias("n"))


def drawn_target(key: Column, group: Column, target: float, jitter: float, least: float, most: float, seed: int = 0) -> Column:
    """A group's target length: uniform in [target (1 - jitter), target (1 + jitter)] within [least, most], by hash of seed, key and group."""
    lo, hi = max(least, target * (1 - jitter)), min(most, target * (1 + jitter))
    u = bucket(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), group.cast("string")))
    return F.lit(float(lo)) + u * F.lit(float(hi - lo))


def tiles(df: DataFrame, key: str, start: str, end: str, label: str, unique: str, until: Column) -> DataFrame:
    """Intervals made to tile [0, until] per key: clipped to the end of those before, gaps filled with empty labels.

    Rows: key, tile_no, tile_start, tile_end, label. Intervals of no length after clipping are left out. The cursor is
    the running maximum of ends, so windows do it.
    """
    w = Window.partitionBy(key).orderBy(start, unique)
    earlier = F.greatest(F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    cut = df.select(key, F.col(unique).alias("_u"), F.col(start).alias("_start"), earlier.alias("_cursor"), F.greatest(F.col(start), earlier).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_l"))
    cut = cut.where("_e > _s")
    gaps = cut.where("_s > _cursor").select(key, F.col("_cursor").alias("tile_start"), F.col("_s").alias("tile_end"), F.lit("").alias("label"))
    own = cut.select(key, F.col("_s").alias("tile_start"), F.col("_e").alias("tile_end"), F.col("_l").alias("label"))
    ends = df.groupBy(key).agg(F.greatest(F.max(end), F.lit(0.0)).alias("tile_start"), F.max(until).alias("tile_end")).where("tile_end > tile_start")
    every = own.unionByName(gaps).unionByName(ends.select(key, "tile_start", "tile_end", F.lit("").alias("label")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("tile_start")) - 1
    return every.withColumn("tile_no", number)


def even_split(words: Column) -> Column:
    """Words (word, start, end) whose text has several parts: the span is divided evenly among them."""

    def parts(w: Column) -> Column:
        ps = F.split(w["word"], " ")
        step = (w["end"] - w["start"]) / F.size(ps)
        return F.transform(ps, lambda p, i: F.struct(p.alias("word"), (w["start"] + step * i).alias("start"), (w["start"] + step * (i + 1)).alias("end")))

    return F.flatten(F.transform(words, parts))


def relative_times(words: Column, origin: Column, digits: int = 4) -> Column:
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), F.round(w["start"] - origin, digits).alias("start"), F.round(w["end"] - origin, digits).alias("end")))


def cut_point(words: Column, duration: Column, pick: Column, least: float = 1.0, window: float | None = 10.0, tail: float = 0.2) -> Column:
    """A struct (cut, word_index, text, end) at a boundary between timed words; null without one.

    A cut is the midpoint between two words with ``least`` seconds on both sides. Of the cuts whose word before ends
    inside the window (else the first cut alone) the one at floor(pick * n) is taken; the text is that of the
    words after it; the end is a short tail after the last timed word.
    """

    def choose(given: Column) -> Column:
        ws, duration, pick = given["w"], given["d"], given["p"]
        at = F.when(F.size(ws) > 1, F.sequence(F.lit(1), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        found = F.transform(at, lambda i: F.struct(((F.get(ws, i - 1)["end"] + F.get(ws, i)["start"]) * 0.5).alias("cut"), i.alias("i"), F.get(ws, i - 1)["end"].alias("before")))
        cuts = F.filter(found, lambda c: c["cut"].isNotNull() & (c["cut"] >= least) & (duration - c["cut"] >= least))
        return bound(cuts, lambda cs: bound(F.filter(cs, lambda c: c["before"] < window) if window else cs, lambda inside: pick_of(ws, duration, pick, F.when(F.size(inside) > 0, inside).otherwise(F.slice(cs, 1, 1)))))

    def pick_of(ws: Column, duration: Column, pick: Column, usable: Column) -> Column:
        return bound(usable, lambda us: F.when(F.size(us) > 0, bound(F.get(us, F.floor(pick * F.size(us)).cast("int")), lambda c: made(ws, duration, c))))

    def made(ws: Column, duration: Column, chosen: Column) -> Column:
        last = F.array_max(F.transform(ws, lambda w: w["end"]))
        after = F.array_join(F.transform(F.slice(ws, chosen["i"] + 1, F.size(ws)), lambda w: w["word"]), " ")
        end = F.when(last > chosen["cut"], F.least(duration, last + tail)).otherwise(duration)
        return F.struct(chosen["cut"].alias("cut"), chosen["i"].alias("word_index"), after.alias("text"), end.alias("end"))

    return bound(F.struct(words.alias("w"), duration.alias("d"), pick.alias("p")), choose)


def boundary_differences(a: Column, b: Column) -> Column:
    """Absolute start and end differences word by word of two alignments with the same words; null otherwise."""

    def measured(x: Column) -> Column:
        a, b = x["a"], x["b"]
        same = F.transform(a, lambda w: w["word"]) == F.transform(b, lambda w: w["word"])  # else reported, not measured
        return F.when(same, F.zip_with(a, b, lambda x, y: F.struct(F.abs(x["start"] - y["start"]).alias("start"), F.abs(x["end"] - y["end"]).alias("end"), x["word"].alias("word"))))

    return bound(F.struct(a.alias("a"), b.alias("b")), measured)


def early_stop(df: DataFrame, key: str, order: str, value: str, patience: int, factor: float, armed_from: int = 0) -> DataFrame:
    """Per key: best, regressions, stop_at (the order value at which the rule fires, else null).

    Armed from a minimum order value. A value under the best resets the count; one over factor * best adds to it;
    one between resets it; ``patience`` in a row stops.
    """
    item = F.struct(F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    state = lambda best, n, stop: F.struct(best.alias("best"), n.alias("n"), stop.alias("stop"))
    zero = state(F.lit(float("inf")), F.lit(0), F.lit(None).cast("long"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        return (
            F.when(a["stop"].isNotNull() | (x["o"] < armed_from), a)
            .when(x["v"] < a["best"], state(x["v"], F.lit(0), a["stop"]))
            .when(x["v"] > a["best"] * factor, state(a["best"], n, F.when(n >= patience, x["o"])))
            .otherwise(state(a["best"], F.lit(0), a["stop"]))
        )

    return listed.select(key, F.aggregate("xs", zero, step).alias("r")).select(key, "r.best", F.col("r.n").alias("regressions"), F.col("r.stop").alias("stop_at"))


def end_rule(df: DataFrame, key: str, step: str, ended: Column, after: int, most: int) -> DataFrame:
    """Per key: eos_step (the first step that ended, null if none), stop_step (that plus ``after``, at most ``most``), capped."""
    first = df.groupBy(key).agg(F.min(F.when(ended, F.col(step))).alias("eos_step"))
    stop = F.least(F.coalesce(F.col("eos_step") + after, F.lit(most)), F.lit(most))
    return first.select(key, "eos_step", stop.alias("stop_step"), (F.col("eos_step").isNull() | (F.col("eos_step") + after > most)).alias("capped"))


def micro_batches(df: DataFrame, index: str, length: str, buffer: int, size: int) -> DataFrame:
    """Adds buffer_no, batch_no: rows are sorted by length inside buffers of consecutive rows, then cut into batches."""
    w = Window.partitionBy("buffer_no").orderBy(length, index)
    return df.withColumn("buffer_no", F.floor(F.col(index) / buffer)).withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size))


def whole_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    """Adds batch_no over consecutive rows and drops the last, partial batch."""
    dealt = df.withColumn("batch_no", F.floor(F.col(index) / size))
    full = dealt.groupBy("batch_no").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("batch_no")
    return dealt.join(full, "batch_no", "left_semi")


def causal_filter(df: DataFrame, key: str, order: str, value: str, kernel: list[float], replicate: bool = True) -> DataFrame:
    """Adds ``filtered``: the kernel over each row's value and those before it in its key (kernel[0] weighs the row itself).

    Before the first row the first value is repeated, or zeros stand there.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.first(value).over(w) if replicate else F.lit(0.0)
    terms = [F.lit(k) * (F.coalesce(F.lag(value, i).over(w), before) if i else F.col(value)) for i, k in enumerate(kernel)]
    return df.withColumn("filtered", reduce(add, terms))
