"""The public byte-level BPE vocabularies, loaded once per Python worker from a path given as a parameter.

Nothing is copied into the repository and nothing is trained. ``encoder`` builds the byte-pair engine from the
vocabulary of a tokenizers JSON file: for byte-level BPE the rank of a merge is the id of its result, so both
libraries give the same ids (the tests hold them against each other). Like that library by default, a JSON vocabulary's
added tokens that stand in a text are one id each; a rank file has none.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np


@functools.lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level BPE files write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def json_ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", [])}
    letters = byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@functools.lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


@functools.lru_cache(4)
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def encoder(path: str, pattern: str):
    import tiktoken

    if path.endswith(".tiktoken"):
        return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=rank_file(path), special_tokens={})
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=json_ranks(path), special_tokens=added_tokens(path))


#: Texts longer than this are encoded part by part, cut where the pattern always cuts.
PART_CHARS = 1 << 16


def parts(text: str):
    """Cuts a long text before single spaces between two letters or digits, where a match always begins.

    No added token of the vocabularies holds a space, so none is cut.
    """
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut > 0 and cut + 1 < len(text) and not (text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    e = encoder(path, pattern)
    if len(text) <= PART_CHARS:
        return e.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    return np.concatenate([e.encode_to_numpy(x, allowed_special="all", disallowed_special=()) for x in parts(text)])
