"""Byte-level vocabularies: files, pre-tokens and merge tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex

#: The published pre-token pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next one from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Token bytes by id, the id of each byte, and the merges as sorted pair keys with rank and result."""

    pieces: list[bytes]
    of_byte: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    special: dict[str, int]
    pattern: object = field(default_factory=lambda: regex.compile(PATTERN))

    @property
    def base(self) -> int:
        return len(self.pieces)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab: dict[str, int] = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = {c: b for b, c in enumerate(byte_symbols())}
    pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left, right, result = (np.array([vocab[x] for x in xs], dtype=np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    keys = left * len(pieces) + right
    order = np.argsort(keys)
    return Vocabulary(pieces, of_byte, keys[order], order.astype(np.int64), result[order], special)


def regular(text: str) -> bool:
    """Whether single spaces and single line feeds between visible characters are all its white space."""
    return " ".join(text.split()) == text.replace("\n", " ")


def chunks(text: str) -> tuple[list[str], list[str]]:
    """Of a regular text: the pieces that begin a line, and those that follow a space.

    A pre-token never crosses a single blank between visible characters: a space begins the next pre-token, and a line feed
    is one by itself. So pieces can be encoded apart, each once, whatever stands around them.
    """
    first: list[str] = []
    rest: list[str] = []
    for line in text.split("\n"):
        head, *tail = line.split(" ")
        first.append(head)
        rest += tail
    return first, rest


def segments(text: str, special: dict[str, int]) -> list[tuple[str, int | None]]:
    """The text between special strings, each with the id of the special string that follows it (None at the end)."""
    out: list[tuple[str, int | None]] = []
    start = 0
    for m in regex.finditer("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)), text) if special else ():
        out.append((text[start : m.start()], special[m.group()]))
        start = m.end()
    return [*out, (text[start:], None)]
