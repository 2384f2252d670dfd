"""URL filters (operator 3): a bit-parallel wildcard automaton.

A rule (host, path) fits a host, all its subdomains, and every path that starts with the rule's. It becomes two globs
over the canonical url (host + path): ``host path *`` and ``@.host path *``, where ``*`` stands for any bytes and
``@`` for any bytes but ``/`` (a host holds none). All globs lie one after the other in the bits of a row of 64-bit
words; one Shift-And step per byte moves every glob at once:

    D = (((D << 1) | starts) & accepts[byte]) | (D & stays[byte])

The step runs over a whole batch of urls together, position by position. Of the rules that fit, the longest wins.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; case is folded
in the host only, A-Z; bytes beyond ASCII are matched as UTF-8; repeated rows give repeated rows; no table rows, no
result rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

ANY, LABEL = "*", "@"
_LOWER = {i: i + 32 for i in range(65, 91)}


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    if url is None:
        return "", ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


class Globs:
    """A set of globs compiled to multiword Shift-And masks. Each glob is a list of bytes, ANY or LABEL."""

    def __init__(self, globs: list[list[int | str]]):
        states = []  # one state per literal byte, a start state before each glob; (byte accepted, bytes stayed on)
        self.start, self.final = [], []
        for g in globs:
            self.start.append(len(states))
            states.append([None, set()])
            for x in g:
                if x == ANY:
                    states[-1][1] |= {*range(256)}
                elif x == LABEL:
                    states[-1][1] |= {*range(256)} - {ord("/")}
                else:
                    states.append([x, set()])
            self.final.append(len(states) - 1)
        self.n = len(states)
        self.words = max(1, -(-self.n // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.initial = np.zeros(self.words, np.uint64)
        for i, (byte, stay) in enumerate(states):
            bit = np.uint64(1 << (i % 64))
            if byte is None:
                self.initial[i // 64] |= bit
            else:
                self.accepts[byte, i // 64] |= bit
            for b in stay:
                self.stays[b, i // 64] |= bit

    def run(self, texts: list[bytes]) -> np.ndarray:
        """texts x globs: which globs match which whole texts."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.cumsum(lengths) - lengths
        d = np.repeat(self.initial[None, :], len(texts), axis=0)
        live = len(texts)
        for p in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths[:live], -p, "left"))  # those longer than p
            byte = flat[at[:live] + p]
            now = d[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.accepts[byte]) | (now & self.stays[byte])
        out = np.zeros((len(texts), len(self.final)), bool)
        for k, f in enumerate(self.final):
            out[order, k] = (d[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) == 1
        return out


def compile_rules(rules: list[tuple[str, str, str]]) -> Globs:
    """Two globs for each rule (verdict, host, path)."""
    globs = []
    for _, host, path in rules:
        tail = [*host.encode(), *path.encode(), ANY]
        globs += [tail, [LABEL, ord("."), *tail]]
    return Globs(globs)


_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, else null), verdict."""
    globs = compile_rules(rules)
    names = [h + p for _, h, p in rules]
    by_length = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [canonical(u) for u in b.column(1).to_pylist()]
            fits = globs.run([(h + p).encode() for h, p in places])
            fits = fits[:, 0::2] | fits[:, 1::2]
            best = [next((i for i in by_length if row[i]), None) for row in fits]
            yield batch(
                _OUT,
                page_id=b.column(0),
                host=[h for h, _ in places],
                path=[p for _, p in places],
                rule=[None if i is None else names[i] for i in best],
                verdict=[otherwise if i is None else rules[i][0] for i in best],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
