"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become tokens in which numbers, units after numbers and names are typed placeholders; the values that stood there are
slots. Windows of WINDOW tokens are hashed and hash-joined with those of the benchmark, so a question with other numbers or
names still meets its template. Windows that meet on one diagonal (same shift between text and question) belong to one
occurrence. An occurrence counts if enough of its question's windows meet and its slots are consistent: the same value of
the question always stands for the same value of the text; two values may become one.

A name is a capitalised word inside a sentence. Since copies may be in other letter case, windows with names are looked up in
both forms, with the words as they stand and with placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import spread

WINDOW = 8
#: Literal words that a window must have; the others may be placeholders.
LITERAL = 4
#: Windows of a question that must meet: so many, or all where it has fewer.
NEEDED = 3
#: Questions with fewer tokens than EDITED can be hidden from the long windows by one edited word, so they have windows of
#: SHORT tokens too, or of SHORTEST if they have fewer tokens than TIGHT.
EDITED, SHORT = 2 * WINDOW - 1 + NEEDED, 4
TIGHT, SHORTEST = 10, 3
#: Benchmark windows up to this many (about 100 bytes each) are broadcast; beyond it the join shuffles both sides.
BROADCAST_WINDOWS = 500_000
#: Up to so many questions with short windows, only texts with one of their telling words get short windows (see ``_short_gate``).
GATED = 5_000

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "g mg kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()

_MARK = "\ue000"  # a private character before a name; removed from texts first
_NAME = r"(?<=[\p{L}\p{M}\p{N},;] )(?=\p{Lu}\p{Ll})"
#: Whether there is any name: the same, begun at the blank, which is found faster.
_ANY_NAME = r" (?=\p{Lu}\p{Ll})(?<=[\p{L}\p{M}\p{N},;] )"
_TOKEN = _MARK + r"?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
_NUMBER = "[0-9]"


def _tokens(rows: DataFrame) -> DataFrame:
    """Adds marked (names carry a mark), named and counted (whether any name or number is there)."""
    clean = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_MARK), F.lit(" "))
    rows = rows.withColumn("text", clean).withColumn("named", F.col("text").rlike(_ANY_NAME))
    text = F.when(F.col("named"), F.regexp_replace("text", _NAME, _MARK)).otherwise(F.col("text"))
    rows = rows.withColumn("marked", F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)))
    return rows.withColumn("counted", F.col("text").rlike(_NUMBER)).drop("text")


def _is_number(token: Column) -> Column:
    return token.rlike("^[0-9]")


def _forms(rows: DataFrame) -> DataFrame:
    """Adds plain (names as words) and typed (names as placeholders) token arrays, and words (no placeholder)."""
    bare = lambda x: F.when(x.startswith(_MARK), F.substr(x, F.lit(2))).otherwise(x)
    rows = rows.withColumn("words", F.when(F.col("named"), F.transform("marked", bare)).otherwise(F.col("marked")))

    def numbers(x: Column, i: Column) -> Column:
        after = F.when(i > 0, _is_number(F.get(F.col("words"), i - 1))).otherwise(False)
        return F.when(_is_number(x), F.lit("<num>")).when(x.isin(UNITS) & after, F.lit("<unit>")).otherwise(x)

    rows = rows.withColumn("plain", F.when(F.col("counted"), F.transform("words", numbers)).otherwise(F.col("words")))
    names = F.zip_with("marked", "plain", lambda m, x: F.when(m.startswith(_MARK), F.lit("<name>")).otherwise(x))
    return rows.withColumn("typed", F.when(F.col("named"), names)).drop("marked")


def _spans(tokens: Column, width: Column) -> Column:
    """Where the windows of a token array begin, from 1."""
    return F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + F.lit(1))).otherwise(F.array().cast("array<int>"))


def _plain_windows(width: Column) -> Column:
    """(at, hash, slots) of each window where no placeholder can be."""
    tokens, none = F.col("plain"), F.lit(None).cast("array<string>")
    return F.transform(_spans(tokens, width), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(tokens, i, width)).alias("hash"), none.alias("slots")))


def _slotted_windows(form: str, only: str | None, width: Column, least: Column) -> Column:
    """(at, hash, slots) of each window with enough literal words, and with the placeholder ``only`` if there is one."""
    tokens, words = F.col(form), F.col("words")
    held = F.transform(_spans(tokens, width), lambda i: F.struct(i.alias("at"), F.slice(tokens, i, width).alias("w")))

    def fits(x: Column) -> Column:
        literal = F.size(F.filter(x["w"], lambda w: ~w.startswith("<"))) >= least
        return literal & F.array_contains(x["w"], only) if only else literal

    def slots(x: Column) -> Column:
        return F.filter(F.zip_with(x["w"], F.slice(words, x["at"], width), lambda c, w: F.when(c.startswith("<"), w)), lambda w: w.isNotNull())

    return F.transform(F.filter(held, fits), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["w"]).alias("hash"), slots(x).alias("slots")))


def _formed_windows(formed: DataFrame, keys: list[str], widths: list[tuple[Column, Column, Column | None]]) -> DataFrame:
    """The windows of each width with so many literal words at least, of rows where a condition holds (if there is one)."""
    every = []
    for width, least, where in widths:
        only = lambda windows, where=where: windows if where is None else F.when(where, windows).otherwise(F.array())
        every.append(only(F.when(F.col("counted"), _slotted_windows("plain", None, width, least)).otherwise(_plain_windows(width))))
        every.append(F.when(F.col("named"), only(_slotted_windows("typed", "<name>", width, least))))
    names = [f"x{k}" for k in range(len(every))]
    both = formed.select(*keys, F.col("named"), *(x.alias(n) for x, n in zip(every, names, strict=True)))
    plain = F.concat(*names[::2]) if len(widths) > 1 else F.col(names[0])
    all_of = F.when(F.col("named"), F.concat(*names)).otherwise(plain)
    return both.select(*keys, F.explode(all_of).alias("x")).select(*keys, "x.at", "x.hash", "x.slots")


def windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, hash, slots): a row for each window of each form of ``rows.text``."""
    return _formed_windows(_forms(_tokens(rows.select(*keys, "text"))), keys, [(F.lit(WINDOW), F.lit(LITERAL), None)])


def _question_forms(benchmark: DataFrame) -> DataFrame:
    """The questions' tokens, a row for each kind of windows that a question has (see ``_question_windows``): kind, width, least."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").dropDuplicates()
    formed = _forms(_tokens(rows)).withColumn("n", F.size("plain"))
    kind = lambda name, width, least: F.struct(F.lit(name).alias("kind"), width.alias("width"), least.alias("least"))
    n, long = F.col("n"), F.col("n") >= WINDOW
    kinds = F.array(
        F.when(long, kind("long", F.lit(WINDOW), F.lit(LITERAL))), F.when((n > 0) & ~long, kind("whole", n, F.lit(0))),
        F.when(long & (n < TIGHT), kind("short", F.lit(SHORTEST), F.lit(SHORTEST // 2 + 1))).when(long & (n < EDITED), kind("short", F.lit(SHORT), F.lit(SHORT // 2))),
    )
    return formed.withColumn("k", F.explode(F.array_compact(kinds))).select("*", "k.kind", "k.width", "k.least").drop("k")


def _question_windows(formed: DataFrame) -> DataFrame:
    """(item_id, kind, width, item_at, hash, item_slots, loose) of the questions' forms.

    Kind long: windows of WINDOW tokens. Kind short: those of SHORT tokens (SHORTEST below TIGHT), of questions that one
    edited word can hide from the long ones. Kind whole: a question with fewer tokens than WINDOW, as it stands; loose tells
    whether it has enough literal words to be known with other values.
    """
    found = _formed_windows(formed, ["item_id", "kind", "width"], [(F.col("width"), F.col("least"), None)])
    found = found.select("item_id", "kind", "width", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    loose = (F.col("kind") != "whole") | (2 * F.coalesce(F.size("item_slots"), F.lit(0)) <= F.col("width"))
    return found.withColumn("loose", loose)


def _needed() -> Column:
    """How many places of a question must meet: one edited word takes at most as many windows as a window has tokens."""
    few = F.greatest(F.lit(NEEDED), F.col("places") - F.col("width"))
    return F.least(F.col("places"), F.when(F.col("kind") == "short", few).otherwise(F.lit(NEEDED)))


def _short_gate(formed: DataFrame) -> Column | None:
    """Whether a text (with its words) can hold a question by its short or whole windows; None if that cannot be told cheaply.

    A place of a question is covered by a set of words if each of its windows, in every form, has one of them as a literal
    word. Words of a question are taken, the rarest of the benchmark first, until the places that are not covered are fewer
    than those that must meet: then a text that holds the question has one of the words. No result changes by this.
    """
    rows = formed.where("kind <> 'long'")
    words = formed.select("item_id", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def held(form: str) -> Column:
        each = F.transform(_spans(F.col(form), F.col("width")), lambda i: F.struct(i.alias("at"), F.filter(F.slice(form, i, F.col("width")), lambda w: ~w.startswith("<")).alias("w"), F.array_contains(F.slice(form, i, F.col("width")), "<name>").alias("name")))
        return F.filter(each, lambda x: (F.size(x["w"]) >= F.col("least")) & (x["name"] if form == "typed" else F.lit(True)))

    every = F.concat(held("plain"), F.when(F.col("named"), held("typed")).otherwise(F.array()))
    cut = rows.select("item_id", "kind", "width", F.explode(every).alias("x")).select("item_id", "kind", "width", F.col("x.at").alias("at"), F.col("x.w").alias("w"))
    keys = ["item_id", "kind", "width"]
    order = F.struct("often", (-F.length("word")).alias("short"), "word")
    ranked = cut.select(*keys, "at", "w", F.explode_outer("w").alias("word")).join(words, "word", "left").withColumn("rank", F.when(F.col("word").isNotNull(), order))
    rarest = ranked.groupBy(*keys, "at", "w").agg(F.min("rank").alias("rank"), F.collect_set("rank").alias("all"))
    # a place is covered when its last window is; windows without a literal word never are
    place = rarest.groupBy(*keys, "at").agg(F.max("rank").alias("rank"), F.bool_or(F.col("rank").isNull()).alias("never"), F.flatten(F.collect_set("all")).alias("all"))
    of = place.groupBy(*keys).agg(F.count("*").alias("places"), F.array_sort(F.collect_list(F.when(~F.col("never"), F.col("rank")))).alias("ranks"), F.array_distinct(F.flatten(F.collect_list("all"))).alias("all"))
    upto = F.get("ranks", F.col("places") - _needed())
    gates = of.select(upto.isNotNull().alias("told"), F.transform(F.filter("all", lambda r: r <= upto), lambda r: r["word"]).alias("words")).limit(GATED + 1).collect()
    if len(gates) > GATED or not all(r["told"] for r in gates):
        return None
    chosen = sorted({w for r in gates for w in r["words"]})
    return F.exists("words", lambda w: w.isin(chosen)) if chosen else F.lit(False)


def _consistent(held: Column) -> Column:
    """The windows of a diagonal whose slots stand as in the question, or for the value that its windows have most often."""
    pairs = F.flatten(F.transform(held, lambda x: x["pairs"]))

    def usual(q: Column) -> Column:
        mine = F.transform(F.filter(pairs, lambda p: p["q"] == q), lambda p: p["d"])
        ranked = F.transform(F.array_distinct(mine), lambda d: F.struct(F.size(F.filter(mine, lambda x: x == d)).alias("n"), (d == q).alias("same"), d.alias("d")))
        return F.array_max(ranked)["d"]

    known = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["q"])), lambda q: F.struct(q.alias("q"), usual(q).alias("d")))
    return F.filter(held, lambda x: F.forall(x["pairs"], lambda p: p["q"] == p["d"]) | F.forall(x["pairs"], lambda p: F.array_contains(known, p)))


def occurrences(docs: DataFrame, benchmark: DataFrame, veto: bool = True) -> DataFrame:
    """(doc_id, text_key, item_id, shift, windows, share, changed): each consistent occurrence of a question in a text.

    windows counts the question's places that meet, share is that count over the question's places, changed tells whether a
    slot has another value than in the question. With ``veto`` a question's value that stands for two values makes its whole
    diagonal inconsistent; without, only its windows with the rarer values are left out.
    """
    forms = _question_forms(benchmark)
    questions = _question_windows(forms)
    places = questions.groupBy("item_id", "kind", "width").agg(F.count_distinct("item_at").alias("places"))
    questions = questions.join(places, ["item_id", "kind", "width"])
    many, widths = questions.agg(F.count("*"), F.collect_set("width")).first()
    if many <= BROADCAST_WINDOWS:
        questions = F.broadcast(questions)
    rows = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn("text_key", F.xxhash64("text"))
    keys = ["doc_id", "text_key"]
    formed = _forms(_tokens(rows.select(*keys, "text")))
    short = sorted({*widths} - {WINDOW})
    if short and (gate := _short_gate(forms)) is not None:
        formed = formed.withColumn("gate", gate)
    asked = [(F.lit(WINDOW), F.lit(LITERAL), None), *((F.lit(w), F.lit(0), F.col("gate") if "gate" in formed.columns else None) for w in short)]
    met = _formed_windows(formed, keys, asked).join(questions, "hash")
    pairs = F.coalesce(F.arrays_zip(F.col("item_slots").alias("q"), F.col("slots").alias("d")), F.array().cast("array<struct<q:string,d:string>>"))
    met = met.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("pairs", pairs)
    met = met.where(F.col("loose") | F.forall("pairs", lambda p: p["q"] == p["d"]))
    # a diagonal has the windows of one shift, a double one those of two neighbouring shifts: one word more or less parts them
    ways = F.array(
        F.when(F.col("kind") != "short", F.struct(F.lit(True).alias("single"), F.col("shift").alias("shift"))),
        *(F.when(F.col("kind") != "whole", F.struct(F.lit(False).alias("single"), (F.col("shift") - k).alias("shift"))) for k in (0, 1)),
    )
    met = met.withColumn("way", F.explode(F.array_compact(ways))).select(*keys, "item_id", "kind", "width", "places", "way.single", "way.shift", "item_at", "pairs")
    # a diagonal has at most the places of one question, whatever the corpus
    found = met.groupBy(*keys, "item_id", "kind", "width", "places", "single", "shift").agg(F.collect_set(F.struct("item_at", "pairs")).alias("held"))
    count = lambda held: F.size(F.array_distinct(F.transform(held, lambda x: x["item_at"])))
    needed = _needed()
    found = found.where(count(F.col("held")) >= needed)
    if not veto:
        found = found.withColumn("held", _consistent(F.col("held"))).where(count(F.col("held")) >= needed)
    found = found.withColumn("windows", count(F.col("held"))).withColumn("pairs", F.array_distinct(F.flatten(F.transform("held", lambda x: x["pairs"]))))
    if veto:
        found = found.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["q"]))) == F.size("pairs"))
    found = found.withColumn("share", F.col("windows") / F.col("places")).withColumn("changed", F.exists("pairs", lambda p: p["q"] != p["d"]))
    # diagonals that lie side by side are one occurrence, unless they are whole ones: those count each
    of = Window.partitionBy(*keys, "item_id")
    begins = F.col("shift") - F.lag("shift").over(of.orderBy("shift")) > 1
    found = found.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(of.orderBy("shift")))
    of = Window.partitionBy(*keys, "item_id", "run")
    found = found.withColumn("any_single", F.max("single").over(of))
    found = found.withColumn("nth", F.row_number().over(of.orderBy(F.desc("share"), F.desc("windows"), "shift", "kind")))
    found = found.where(F.when(F.col("any_single"), F.col("single")).otherwise(F.col("nth") == 1))
    return found.select(*keys, "item_id", "shift", "windows", "share", "changed")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, occurrences, windows, share, changed): the questions that each text holds; clean texts have no row.

    windows and share are those of the fullest occurrence; changed tells whether all occurrences have other slot values than
    the question. Null texts and questions, and longer ones with too few literal words, hold and are nothing; a question with
    fewer than WINDOW tokens is held where it stands whole. Rows that repeat an id and text count as one; null ids are kept. Other columns are ignored.
    """
    found = occurrences(docs, benchmark).drop("text_key").distinct()
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("occurrences"), F.max("windows").alias("windows"), F.max("share").alias("share"), F.bool_and("changed").alias("changed")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no question, also none whose values were edited here and there."""
    held = occurrences(docs, benchmark, veto=False).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(held["_doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == held["_text_key"])
    return docs.join(held.hint("shuffle_hash"), same, "left_anti")
