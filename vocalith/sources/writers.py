"""Sinks. Tables go through Spark's commit protocol; reports are formatted from small aggregates on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.operators.joins import last_wins


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def splits(df: DataFrame, path: str, column: str = "split", mode: str = "errorifexists") -> None:
    """All splits in one pass, a folder each."""
    df.write.mode(mode).partitionBy(column).json(path)


def text_corpus(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    df.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode(mode).text(path)


def csv_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def stats_document(df: DataFrame) -> str:
    """A one-row summary as JSON, non-ASCII kept."""
    return json.dumps(json.loads(df.toJSON().first()), ensure_ascii=False, indent=2)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All keys of both, each with the row of the greatest ``order``; keys that are no longer served stay."""
    return last_wins(stored.unionByName(changes, allowMissingColumns=True), keys, order)


def _report_rows(df: DataFrame, most: int) -> list:
    """All rows of a report; one with more than ``most`` is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; aggregate it first")
    return rows


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """All rows, at most ``most`` (a report), as a table."""
    rows = _report_rows(df, most)
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def line_chart(points: list[tuple[float, float]], width: int = 640, height: int = 240, pad: int = 30) -> str:
    """An SVG line with the least point circled; nothing to draw gives an empty picture."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'
    if not points:
        return head + "</svg>"
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    fit = lambda v, lo, hi, a, b: a + (v - lo) * (b - a) / ((hi - lo) or 1)
    at = [(fit(x, min(xs), max(xs), pad, width - pad), fit(y, min(ys), max(ys), height - pad, pad)) for x, y in points]
    best = min(range(len(ys)), key=ys.__getitem__)
    drawn = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    return f'{head}<polyline fill="none" stroke="black" points="{drawn}"/><circle cx="{at[best][0]:.1f}" cy="{at[best][1]:.1f}" r="5" fill="none" stroke="red"/></svg>'


def dashboard(evals: DataFrame, step: str = "step", value: str = "wer", most: int = 2000) -> str:
    """An HTML page: the chart of the latest value per step, and its table, over all steps, at most ``most``."""
    import html

    rows = last_wins(evals.where(f"{value} is not null"), [step], "row_idx").orderBy(step)
    rows = _report_rows(rows, most)
    cells = "".join(f"<tr><td>{html.escape(str(r[step]))}</td><td>{r[value]:.4f}</td></tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(value)}</title>{line_chart([(r[step], r[value]) for r in rows])}<table>{cells}</table>"


def textgrid(tiers: dict[str, list[tuple[float, float, str]]], end: float) -> str:
    """Annotation tiers of tiling intervals in the long text format."""
    q = lambda s: '"' + s.replace('"', '""') + '"'
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {end}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for i, (name, spans) in enumerate(tiers.items(), 1):
        out += [f"    item [{i}]:", '        class = "IntervalTier"', f"        name = {q(name)}", "        xmin = 0", f"        xmax = {end}", f"        intervals: size = {len(spans)}"]
        for k, (a, b, text) in enumerate(spans, 1):
            out += [f"        intervals [{k}]:", f"            xmin = {a}", f"            xmax = {b}", f"            text = {q(text)}"]
    return "\n".join(out) + "\n"


def to_tracker(send: Callable[[int, dict[str, float]], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that sends (step, metrics map) rows in order; nulls in the map are left out."""

    def run(df: DataFrame, _: int) -> None:
        for r in df.orderBy("step").toLocalIterator():
            send(r["step"], {k: v for k, v in (r["metrics"] or {}).items() if v is not None})

    return run
