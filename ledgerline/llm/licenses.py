"""License scans as an exact set-similarity join, in DataFrame functions only.

A text block is one of overlapping windows of the words of a text, short ones for short statements and long ones for the
others; a template is the set of words of a license statement. A block matches a template if it has at least the threshold's
share of the template's words, and a phrase that tells it from its kin. The join is exact: tokens are ordered by
their frequency in all blocks of the corpus, rarest first. A template has ``size - need + 1`` prefix tokens, a block as many of
its own, and a pair that reaches ``need`` common tokens shares one of them; the length filter drops blocks with fewer than
``need`` tokens, and the positional filter drops pairs whose remaining tokens cannot reach it. Words that no template has
cannot take part in an overlap and are left out of the blocks from the start.

All that is broadcast or put into plans is bounded by the templates, never by the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import spread, staged

# The phrases that are looked for word by word, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Statements of public licenses in lower-case words: label, words, and a phrase that tells the license from its
# kin and must stand in the block.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
]

#: A block matches a template if it has at least this share of its words.
THRESHOLD = (4, 5)
#: Words of a chunk; blocks are runs of 2 chunks for statements of at most CHUNK words, else of twice LONG chunks, at every
#: chunk or every LONG ones, so that a whole statement lies in one of them wherever its lines end.
CHUNK, LONG = 12, 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template:
    """A statement as a set of words; ``need`` of them make a match, if the phrase stands there too."""

    def __init__(self, number: int, label: str, words: str, phrase: str) -> None:
        self.number, self.label, self.phrase = number, label, phrase
        self.tokens = list(dict.fromkeys(words.split()))
        self.size = len(self.tokens)
        self.need = -(-THRESHOLD[0] * self.size // THRESHOLD[1])
        self.long = len(words.split()) > CHUNK


def templates() -> list[Template]:
    every = [Template(n, *row) for n, row in enumerate(TEMPLATES)]
    assert all(len(words.split()) <= CHUNK * LONG for _, words, _ in TEMPLATES)
    return every


def _lowered(text: Column) -> Column:
    """A-Z in lower case. The Kelvin sign, the one other letter that lower() turns into an ASCII letter, is set aside."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))


def _words(docs: DataFrame) -> DataFrame:
    """Of each row all its words, between single spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.regexp_replace(_lowered(F.col("text")), _BETWEEN, " ").alias("t"))
    return rows.withColumn("padded", F.concat(F.lit(" "), F.trim("t"), F.lit(" "))).drop("t")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _phrases(rows: DataFrame) -> DataFrame:
    """Adds n_words and, from the places where phrase words stand in a row, n_base, first_word, last_word, base."""
    padded = F.col("padded")
    either = "|".join(PHRASES)
    there = {p: padded.contains(f" {p} ") for p in PHRASES}
    some = next(iter(there.values()))
    for x in there.values():
        some = some | x
    before_first = F.substr(padded, F.lit(1), F.regexp_instr(padded, F.lit(f"(?<= )(?:{either})(?= )")) - 1)
    before_last = F.regexp_extract(padded, f"(?s)^(.*) (?:{either})(?= )", 1)
    base = F.array_compact(F.array(*(F.when(there[p], F.lit(label)) for p, label in PHRASES.items())))
    return rows.select(
        "doc_id",
        "text_key",
        "padded",
        F.when(padded == "  ", F.lit(0)).otherwise(_spaces(padded) - 1).cast("long").alias("n_words"),
        F.when(some, F.regexp_count(padded, F.lit(f"(?<= )(?:{either})(?= )"))).otherwise(0).cast("long").alias("n_base"),
        F.when(some, _spaces(before_first) - 1).cast("long").alias("first_word"),
        F.when(some, _spaces(before_last)).cast("long").alias("last_word"),
        F.array_sort(base).alias("base"),
    )


def _chunks(padded: Column, vocabulary: list[str]) -> Column:
    """Of each run of CHUNK words in turn the words that some template has."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK))
        return F.transform(starts, lambda s: F.filter(F.slice(words, s + 1, CHUNK), lambda w: w.isin(vocabulary)))

    # an array around the words, so that they are split once and not at each chunk
    return F.get(F.transform(F.array(F.split(F.trim(padded), " ")), cut), F.lit(0))


def _blocks(chunks: Column, rare: tuple[list[str], list[str]]) -> Column:
    """(long, tokens, line) of the blocks of a text that have a prefix token of a short or of a long template.

    line has the block's template words in their order, between spaces.
    """

    def of(long: bool) -> Column:
        step, wide, prefix = (LONG, 2 * LONG, rare[1]) if long else (1, 2, rare[0])
        starts = F.sequence(F.lit(0), F.greatest(F.size(chunks) - step - 1, F.lit(0)), F.lit(step))
        every = F.transform(starts, lambda s: F.flatten(F.slice(chunks, s + 1, wide)))
        near = F.filter(every, lambda b: F.arrays_overlap(b, F.array(*map(F.lit, prefix))))
        line = lambda b: F.concat(F.lit(" "), F.array_join(b, " "), F.lit(" "))
        return F.transform(near, lambda b: F.struct(F.lit(long).alias("long"), F.array_distinct(b).alias("tokens"), line(b).alias("line")))

    return F.concat(of(False), of(True))


def _prefix(template: Template, rank: dict[str, int]) -> list[str]:
    return sorted(template.tokens, key=rank.__getitem__)[: template.size - template.need + 1]


def _prefixes(spark, rank: dict[str, int]) -> DataFrame:
    """(token, long, template, size, need, pos): the prefix of every template in the corpus order."""
    rows = [(token, t.long, t.number, t.size, t.need, pos) for t in templates() for pos, token in enumerate(_prefix(t, rank))]
    return spark.createDataFrame(rows, "token string, long boolean, template int, size int, need int, pos int")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    n_base counts the places of PHRASES, with the word numbers of the first and last of them (null without any); labels has
    the phrases' labels and those of matching templates; score is the largest share of a matching template's words in a
    block, 1.0 where a phrase stands, 0.0 without a match; both may cross lines. Null texts count as empty: no words,
    empty labels, score 0. Repeated rows and null ids give a row each; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    all_templates = templates()
    vocabulary = sorted({w for t in all_templates for w in t.tokens})
    rows = _phrases(_words(spread(docs)))
    rows = staged(rows.withColumn("chunks", _chunks(F.col("padded"), vocabulary)).drop("padded"), "license-chunks")
    seen = {r["token"]: r["n"] for r in rows.select(F.explode(F.flatten("chunks")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rare = tuple(sorted({w for t in all_templates if t.long == long for w in _prefix(t, rank)}) for long in (False, True))
    some = F.exists("chunks", lambda c: F.arrays_overlap(c, F.array(*map(F.lit, sorted({*rare[0], *rare[1]})))))
    blocks = rows.where(some).select("doc_id", "text_key", F.explode(_blocks(F.col("chunks"), rare)).alias("b")).select("doc_id", "text_key", "b.long", "b.tokens", "b.line")
    # in corpus order
    ordered = F.filter(F.array(*map(F.lit, rank)), lambda w: F.array_contains("tokens", w))
    near = blocks.select("doc_id", "text_key", "long", "line", ordered.alias("tokens"))
    near = near.select("doc_id", "text_key", "long", "line", "tokens", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "token"))
    joined = near.join(F.broadcast(_prefixes(spark, rank)), ["token", "long"])
    joined = joined.where("length >= need AND at <= length - need AND 1 + least(size - pos - 1, length - at - 1) >= need")

    def told(values: list) -> Column:
        return F.element_at(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values)), F.col("template") + 1)

    matched = joined.withColumn("common", F.size(F.array_intersect("tokens", told([t.tokens for t in all_templates])))).where("common >= need")
    matched = matched.where(F.contains("line", told([f" {t.phrase} " for t in all_templates])))
    label = told([t.label for t in all_templates])
    found = matched.groupBy("doc_id", "text_key").agg(F.max(F.col("common") / F.col("size")).alias("best"), F.collect_set(label).alias("more"))
    found = found.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    both = rows.drop("chunks").join(found, (rows["text_key"] == found["_text_key"]) & rows["doc_id"].eqNullSafe(found["_doc_id"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def scan_sql() -> str:
    """The same rows by comparing every block with every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    vocabulary = sorted({w for t in templates() for w in t.tokens})
    values = ", ".join(f"('{t.label}', {str(t.long).upper()}, {t.size}, {t.need}, {t.tokens!r}, ' {t.phrase} ')" for t in templates())
    hits = ", ".join(
        f"CASE WHEN {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))} THEN '{label}' END" for p, label in PHRASES.items()
    )
    blocks = lambda long, step: (
        f"SELECT rid, {long} AS long, list_filter(w[s * {CHUNK} + 1 : (s + {2 * step}) * {CHUNK}], lambda x: list_contains({vocabulary!r}, x)) AS block"
        f" FROM (SELECT rid, w, unnest(generate_series(0, greatest(CAST(ceil(len(w) / {CHUNK}) AS BIGINT) - {step} - 1, 0), {step})) AS s FROM w WHERE len(w) > 0)"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{up}', '{low}') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT rid, i, coalesce({hits}) AS label FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM w)),
b AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS base
      FROM p WHERE label IS NOT NULL GROUP BY rid),
k AS ({blocks("FALSE", 1)} UNION ALL {blocks("TRUE", LONG)}),
m AS (SELECT rid, label, len(list_intersect(block, tokens)) / size AS share
      FROM k JOIN (VALUES {values}) AS v(label, long, size, need, tokens, phrase) USING (long)
      WHERE len(list_intersect(block, tokens)) >= need AND contains(' ' || array_to_string(block, ' ') || ' ', phrase)),
g AS (SELECT rid, max(share) AS best, list(DISTINCT label) AS more FROM m GROUP BY rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN g USING (rid)
"""
