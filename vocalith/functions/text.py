"""Text functions: cleaning, normalisation, prompts, chunks, escapes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Zero-width and bidirectional marks that normalisation deletes.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    return squeeze(nfc(text))


def normalize_text(text: Column) -> Column:
    """NFC, without invisible marks, white space squeezed."""
    return squeeze(F.translate(nfc(text), INVISIBLE, ""))


def normalize_for_asr(text: Column) -> Column:
    """For error rates: without vowel marks; all but letters, digits, Hebrew and _ becomes space."""
    bare = F.regexp_replace(nfc(text), "[֑-ׇ]", "")
    return squeeze(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s" + "֐-׿]", " "))


def norm(text: Column) -> Column:
    """NFC and trimmed."""
    return F.regexp_replace(nfc(text), r"(?U)^\s+|\s+$", "")


def match_text(text: Column) -> Column:
    """Lower case; only a-z, apostrophe and space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z' ]", ""))


def slug(text: Column, length: int = 12, last: bool = False) -> Column:
    bare = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.right(bare, F.lit(length)) if last else F.left(bare, F.lit(length))


def has_hebrew(text: Column) -> Column:
    return text.rlike("[֐-׿]")


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(squeeze(text)), F.lit(0)) == 0


def n_words(text: Column) -> Column:
    return F.size(words(text))


def words(text: Column) -> Column:
    """White-space words; none in a blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def prepare_prompt(text: Column, pad: bool = True, commas: bool = True) -> Column:
    """A struct of the prompt text and the frames to go on after the end; null for a blank text."""
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[\n\r]", " ")
    line = F.replace(line, F.lit("  "), F.lit(" "))
    if commas:
        line = F.replace(line, F.lit(";"), F.lit(","))
    count = n_words(line)
    line = F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)))
    line = F.when(F.right(line, F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.concat(line, F.lit("."))).otherwise(line)
    if pad:
        line = F.when(count < 5, F.concat(F.lit(" " * 8), line)).otherwise(line)
    made = F.struct(line.alias("prompt"), F.when(count <= 4, 3).otherwise(1).alias("frames_after"))
    return F.when(~is_blank(text), made)


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space, so decimals stay whole; ends trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunks(text: Column, most: int) -> Column:
    """Sentences packed in order into chunks of at most ``most`` white-space tokens.

    A sentence that is too long is cut after commas, semicolons and colons first; a piece that is still too long is a
    chunk of its own.
    """
    size = lambda s: F.size(F.split(s, r"\s+"))
    pieces = F.flatten(F.transform(sentences(text), lambda s: F.when(size(s) <= most, F.array(s)).otherwise(F.split(s, r"(?<=[,;:])\s+"))))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        k = size(piece)
        fits = acc["n"] + k <= most
        return (
            F.when(acc["n"] == 0, F.struct(acc["done"].alias("done"), piece.alias("open"), k.alias("n")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], piece).alias("open"), (acc["n"] + k).alias("n")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open"), k.alias("n")))
        )

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def fold_case(text: Column, vocabulary: str) -> Column:
    """Upper or lower case, as most cased letters of the vocabulary are; as it is if there are none or as many."""
    up, low = sum(c.isupper() for c in vocabulary), sum(c.islower() for c in vocabulary)
    return F.upper(text) if up > low else F.lower(text) if low > up else text


def keep_vocabulary(word: Column, vocabulary: str) -> Column:
    """A word without characters outside the vocabulary; may become empty."""
    known = F.array(*[F.lit(c) for c in vocabulary])
    return F.array_join(F.filter(F.split(word, ""), lambda c: F.array_contains(known, c)), "")


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit("—"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_id(original: Column, audio: Column) -> Column:
    """The folder of the original path, else the audio stem before its first _seg."""
    folder = F.regexp_extract(original, r"([^/\\]+)[/\\][^/\\]+$", 1)
    stem = F.regexp_replace(F.element_at(F.split(audio, r"[/\\]"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(folder, F.lit("")), F.element_at(F.split(stem, "_seg"), 1))


def rebase(path: Column, root: str) -> Column:
    """The base name, after either kind of slash, under a new root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.element_at(F.split(path, r"[/\\]"), -1))
