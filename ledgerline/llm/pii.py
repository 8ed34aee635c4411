"""Personal data: offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then a cascade of transducers rewrites the text: lookalike letters and
digits of other scripts become ASCII and invisible signs go; disguises of at, dot and plus become their signs; spelled digits
become digits. Each transducer reads its tokens and copies the rest, and says of every piece it
writes where in its input the piece stood. The cascade's pieces are composed, so a span of the rewritten text maps to a span
of the source. Identifiers found in the rewritten text, and nowhere in the text as it stands, are added.

A text in which no transducer's trigger occurs is never rewritten. All patterns run in time linear in the text: an e-mail is
sought around its sign, other patterns cannot begin twice in one run of their characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_texts, spread

KINDS = ("email", "ip", "card", "phone")
MOST_OCTET, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones, side by side.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁһԛԝвмнт" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρα" "ıɑɡ",
    "ABESIJKMHOPCTYXaesijkopcyxdhqwbmht" "ABEZHIKMNOPTYXovipa" "iag",
    strict=True,
))
#: Signs that stand for at, dot, plus, dash and blank in other widths or scripts.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "•": ".", "·": ".", "﹒": ".", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "\xa0": " ", " ": " ", " ": " "}
#: Signs without a width; they are left out.
INVISIBLE = "​‌‍⁠﻿­"
# Digits as words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
_WORDS = "|".join(DIGITS)


def _shown(start: int, end: int) -> dict[str, str]:
    """Characters of a range that are other forms of an ASCII letter, digit or sign (full width, mathematical, circled, other digits)."""
    out = {}
    for c in map(chr, range(start, end)):
        digit = unicodedata.digit(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and plain.isprintable() and not plain.isspace():
            out[c] = plain
    return out


def letters() -> dict[str, str]:
    """Each character that the first transducer rewrites, and what it becomes."""
    rows = [(0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2070, 0x208A), (0x2460, 0x24EB), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
    found: dict[str, str] = {}
    for row in rows:
        found |= _shown(*row)
    return found | LOOKALIKES | SIGNS | dict.fromkeys(INVISIBLE, "")


@dataclass
class Rewritten:
    """A text and the pieces that were changed: where each stands in it and in the source, and which signs are disguised."""

    text: str
    starts: list[int]  # of pieces, in this text
    ends: list[int]
    source: list[tuple[int, int]]
    kinds: list[str]

    def begin(self, at: int) -> int:
        """The source position at which the character at ``at`` begins."""
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at
        return self.source[k][0] if at < self.ends[k] else self.source[k][1] + at - self.ends[k]

    def end(self, at: int) -> int:
        """The source position at which the character before ``at`` ends."""
        k = bisect_right(self.starts, at - 1) - 1
        if k < 0:
            return at
        return self.source[k][1] if at <= self.ends[k] else self.source[k][1] + at - self.ends[k]

    def within(self, start: int, end: int) -> set[str]:
        """The kinds of the pieces that overlap a span."""
        k = max(bisect_right(self.starts, start) - 1, 0)
        out = set()
        while k < len(self.starts) and self.starts[k] < end:
            if self.ends[k] > start:
                out.add(self.kinds[k])
            k += 1
        return out


@dataclass
class Transducer:
    """Tokens that it reads, and what it writes for each: (output, kind), or None to copy the token. The trigger tells cheaply
    whether a text can have a token that matters, and gives the pattern of tokens then."""

    trigger: Callable[[str], re.Pattern[str] | None]
    write: Callable[[re.Match[str]], tuple[str, str] | None]

    def run(self, before: Rewritten) -> Rewritten:
        """Rewrites a text; pieces of ``before`` that no token takes are carried over, others join the token's piece."""
        if (tokens := self.trigger(before.text)) is None:
            return before
        found = [(m.start(), m.end(), *w) for m in tokens.finditer(before.text) if (w := self.write(m)) is not None]
        if not found:
            return before
        text, starts, ends, source, kinds = [], [], [], [], []
        at = size = k = 0

        def carry(upto: int) -> None:
            nonlocal k
            while k < len(before.starts) and before.ends[k] <= upto:
                if before.starts[k] >= at:
                    starts.append(size + before.starts[k] - at)
                    ends.append(size + before.ends[k] - at)
                    source.append(before.source[k])
                    kinds.append(before.kinds[k])
                k += 1

        for begin, end, out, kind in found:
            carry(begin)
            text.append(before.text[at:begin])
            size += begin - at
            starts.append(size)
            size += len(out)
            ends.append(size)
            source.append((before.begin(begin), before.end(end)))
            kinds.append(kind)
            text.append(out)
            at = end
            while k < len(before.starts) and before.starts[k] < end:
                k += 1
        carry(len(before.text))
        text.append(before.text[at:])
        return Rewritten("".join(text), starts, ends, source, kinds)


def _lookalikes() -> Transducer:
    table = letters()

    def trigger(text: str) -> re.Pattern[str] | None:
        held = None if text.isascii() else table.keys() & set(text)
        return re.compile(f"[{re.escape(''.join(sorted(held)))}]") if held else None

    return Transducer(trigger, lambda m: (table[m[0]], "letter"))


_OPEN, _SHUT = r"[\x20\t]*[(\[{<][\x20\t]*", r"[\x20\t]*[)\]}>][\x20\t]*"


def _signs() -> Transducer:
    """at, dot, plus and their like: in brackets always, as bare words between blanks as weak signs."""
    named = {"at": "@", "dot": ".", "point": ".", "plus": "+", "dash": "-", "hyphen": "-", "underscore": "_", "@": "@", ".": "."}
    bracketed = f"{_OPEN}(?P<b>at|dot|point|@|\\.|plus|dash|hyphen|underscore){_SHUT}"
    bare = r"(?<=[A-Za-z0-9])[\x20\t]{1,3}(?P<w>at|dot|point|dash|hyphen|underscore)[\x20\t]{1,3}(?=[A-Za-z0-9])"
    plus = rf"(?<![A-Za-z])(?P<p>plus)[\x20\t]{{1,3}}(?=[0-9]|(?:{_WORDS})\b)"
    html = r"&(?:#64|#x40|commat);|%40|&(?:#46|#x2e|period);"
    code = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@"}

    def write(m: re.Match[str]) -> tuple[str, str] | None:
        if m["b"]:
            return named[m["b"].lower()], "sign"
        if m["p"]:
            return "+", "plus"
        if m["w"]:
            return named[m["w"].lower()], "weak " + m["w"].lower()
        return code.get(m[0].lower(), "."), "sign"

    tokens = re.compile(f"{bracketed}|{bare}|{plus}|{html}", re.I)
    opened, coded = re.compile(bracketed, re.I), re.compile(html, re.I)

    def trigger(text: str) -> re.Pattern[str] | None:
        # a bare "at" alone makes no e-mail: a dot must be disguised too (see _told)
        low = text.lower()
        words = any(w in low for w in ("dot", "point", "plus", "dash", "hyphen", "underscore"))
        return tokens if words or opened.search(text) or coded.search(text) else None

    return Transducer(trigger, write)


def _digits() -> Transducer:
    """Words for digits, where three or more stand in a row, or next to a digit or plus."""
    one = rf"(?:(?:double|triple)[\x20-])?(?:{_WORDS})"
    run = re.compile(rf"(?<![A-Za-z]){one}(?:[\x20-]{{1,2}}{one})*(?![A-Za-z])", re.I)
    word = re.compile(rf"(?:(double|triple)[\x20-])?({_WORDS})", re.I)

    def write(m: re.Match[str]) -> tuple[str, str] | None:
        said = word.findall(m[0])
        before, after = m.string[max(m.start() - 2, 0) : m.start()], m.string[m.end() : m.end() + 2]
        if len(said) < 3 and not re.search(r"[0-9+][\x20.-]?$", before) and not re.match(r"[\x20.-]?[0-9]", after):
            return None
        return "".join(DIGITS[w.lower()] * TIMES.get(t.lower(), 1) for t, w in said), "digit"

    whole = {w: re.compile(rf"{w}(?<![a-z]{w})(?![a-z])") for w in DIGITS}

    def trigger(text: str) -> re.Pattern[str] | None:
        low = text.lower()
        return run if any(w in low and p.search(low) for w, p in whole.items()) else None

    return Transducer(trigger, write)


CASCADE = (_lookalikes(), _signs(), _digits())


def normalised(text: str) -> Rewritten:
    out = Rewritten(text, [], [], [], [])
    for transducer in CASCADE:
        out = transducer.run(out)
    return out


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1  # no e-mail reaches over a sign
        at = text.find("@", floor)


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= MOST_OCTET


def _ips(chain: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Of a run of numbers parted by dots every four, as a leftmost search takes them."""
    parts = chain.split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(map(_octet, four)):
            yield "ip", at, end
        at = end + 1


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)] if i % 2 else d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _count(text: str, least: int, most: int) -> str | None:
    """The digits of a match, if their number fits."""
    found = re.sub("[^0-9]", "", text)
    return found if least <= len(found) <= most else None


def identifiers(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base identifiers, leftmost and without overlap for each kind; matches that fail are dropped."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            yield from _ips(m[0], m.start())
    for m in _CARD.finditer(text):
        if (d := _count(m[0], *CARD_DIGITS)) and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if _count(m[0], *PHONE_DIGITS):
            yield "phone", *m.span()


def _told(kind: str, value: str, disguises: set[str]) -> bool:
    """Whether an identifier of the rewritten text is one: words of prose alone do not make it."""
    if not disguises:
        return False
    if kind == "email":
        host = value.rpartition("@")[2]
        if not re.fullmatch(r"[A-Za-z]{2,24}", host.rpartition(".")[2]):
            return False
        # a bare "at" may be a word of the sentence, so a dot must be disguised too
        return "weak at" not in disguises or bool(disguises & {"weak dot", "weak point", "sign"})
    return True


def added(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of the source that are identifiers when rewritten, and do not lie within a base span of their kind."""
    new = normalised(text)
    if not new.starts:
        return []
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    out = []
    for kind, start, end in identifiers(new.text):
        if not _told(kind, new.text[start:end], new.within(start, end)):
            continue
        begin, stop = new.begin(start), new.end(end)
        k = bisect_right(taken[kind], (begin, len(text))) - 1
        if k < 0 or taken[kind][k][1] < stop:
            out.append((kind, begin, stop))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, added) spans of a text, in code points, ends exclusive."""
    base = list(identifiers(text or ""))
    return base, added(text or "", base)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and the digest are of base spans, spans lists these and the added ones. A null text counts as empty, a null id
    is kept, repeated rows have a row each, an empty table has none. Other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in arrow}
        out["doc_id"] = rows.column("doc_id").to_pylist()
        for text in rows.column("text").to_pylist():
            base, more = spans_of(text)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["n_added"].append(len(more))
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(spread(rows), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", arrow)
