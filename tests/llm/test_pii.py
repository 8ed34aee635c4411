"""Personal data against plain patterns, disguises, and offsets that map back."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import pii

SCHEMA = "doc_id long, text string"


def plain(text):
    """The base spans by the patterns as the contract writes them."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def by_start(spans):
    return sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("aB1290.@-+ ()é%_\n２а"), max_size=60))
def test_base_spans(text):
    assert by_start(pii.identifiers(text)) == by_start(plain(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["jo", " at ", "mail", " dot ", "com", "(at)", "[dot]", "@", ".", "４", "а", "​", "one two three", " ", "+", "double five", "plus ", "7", "&#64;", "é"]), max_size=14))
def test_offsets_cover_what_was_written(parts):
    text = "".join(parts)
    new = pii.normalised(text)
    at = 0
    for s, e, (a, b) in zip(new.starts, new.ends, new.source, strict=True):
        assert s >= at and s <= e and a < b
        at = e
    # what lies between two pieces is copied
    edges = [(0, 0), *((e, b) for e, (_, b) in zip(new.ends, new.source, strict=True))]
    for (e, b), (s, a) in zip(edges, [*((s, a) for s, (a, _) in zip(new.starts, new.source, strict=True)), (len(new.text), len(text))], strict=True):
        assert new.text[e:s] == text[b:a]


def test_luhn_and_planted():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "Card 4111-1111 1111 1111, ip 192.168.0.256 or 10.0.0.1, call +1 (743) 555-3824. Mail x.y+z@mail5.example.com!"
    assert [text[s:e] for _, s, e in by_start(pii.identifiers(text))] == ["4111-1111 1111 1111", "10.0.0.1", "+1 (743) 555-3824", "x.y+z@mail5.example.com"]


def found(text):
    base, more = pii.spans_of(text)
    return [(k, text[s:e]) for k, s, e in by_start(more)]


def test_disguises():
    for said, kind in {
        "john.doe at example dot com": "email", "john (at) example (dot) com": "email", "john[at]example.com": "email", "jоhn@exаmple.com": "email", "john＠example．com": "email",
        "jo​hn@example.com": "email", "john&#64;example.com": "email", "john {at} mail [dot] example [dot] org": "email", "john underscore doe at example dot com": "email",
        "１９２.１６８.０.１": "ip", "ten": "", "10 dot 0 dot 0 dot 1": "ip", "192[.]168[.]1[.]77": "ip",
        "four one one one 1111 1111 1111 1111": "", "４１１１ １１１１ １１１１ １１１１": "card", "four one double one 1111 1111 one one one one": "card",
        "plus one 743 five five five 3824": "phone", "+１ (７４３) ５５５-３８２４": "phone", "+one seven four three five five five three eight two four": "phone",
    }.items():
        got = found(f"é Write: {said}, soon.")
        if kind:
            assert [k for k, _ in got] == [kind], (said, got)
            assert got[0][1].strip() == said, (said, got)
        else:
            assert not got or said.startswith("four"), (said, got)


def test_prose_is_left_alone():
    for text in [
        "We meet at noon. Bye", "look at example.com today", "one or two of three at four dot", "It was at point blank. Nine of ten", "meet me at example.com (at) least", "one two three four five", "a (b) c [1] {x}",
        "Les élèves de l’été, à dix heures.", "call at 5. Point taken", "version 1 dot 2 at 3",
    ]:
        assert found(text) == [], text


def test_base_stays_and_long_texts():
    text = "x@y.com " + "a" * 2_000_000 + " " + "1" * 500_000 + " 1.2.3.4 " + "9.9.9" * 50_000 + " +1" + "-" * 300_000 + " jane at example dot org " + "@" * 100_000 + "é" * 1000
    base, more = pii.spans_of(text)
    assert ("email", 0, 7) in base and [text[s:e].strip() for k, s, e in more if k == "email"] == ["jane at example dot org"]


def test_scan(spark, sf_dir):
    rng = random.Random(3)
    rows = [(None, None), (1, ""), (2, None), (3, "a@b.co"), (3, "a@b.co"), (4, "x at y dot com, 10.0.0.1")] + [(10 + i, "".join(rng.choice("ab1 .@+-") for _ in range(80))) for i in range(200)]
    docs = spark.createDataFrame([(*r, "spans", 1) for r in rows], SCHEMA + ", spans string, n_email int")
    got = sorted((tuple(r) for r in pii.scan(docs).collect()), key=str)
    want = []
    for i, t in rows:
        base = by_start(plain(t or ""))
        counts = [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        every = by_start(base + pii.spans_of(t)[1])
        want.append((i, *counts, digest, ",".join(f"{k}:{s}:{e}" for k, s, e in every), len(every) - len(base)))
    assert got == sorted(want, key=str)
    assert pii.scan(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    """On the table the base spans are those of the plain patterns, and clean prose gets no added spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    for r in docs.collect():
        base = by_start(plain(r["text"] or ""))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert sum(r["n_added"] for r in got.values()) <= len(got) // 50
