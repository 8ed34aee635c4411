"""Text functions on columns: folding, keys, tokens and n-grams. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.payee import DEFAULT, Payee

# Words of transfer narratives that say nothing about a customer.
STOP_WORDS = (
    "rem tfr ac o l tt tien nuoc thoi gian gd thanh toan chuyen khoan the tai va cua cho tu den vnd cty cong ty co phan "
    "hue bidv ngan hang dau phat trien viet nam bank charge vat dtls ref tkthe bftvvnvx icbvvnvx "
    "ma id kh hd ky thang nam nuoc water supply jsc hinh thuc gui nhan tk ac stk hoa don invoice "
    "tthd atbp ewx bpment ft vcbcsh kbnnttsp kba chiho ibft cap sacombank vietcombank vietinbank agribank mbvcb"
).split()

# Canonical channel of a bank or wallet by its first word.
CHANNELS = {
    "bidv": "bidv", "vcb": "vcb", "vietcombank": "vcb", "mb": "mb", "mbbank": "mb", "vtb": "vietinbank", "vietinbank": "vietinbank",
    "icb": "vietinbank", "agr": "agribank", "agribank": "agribank", "exb": "eximbank", "eximbank": "eximbank", "vpb": "vpbank",
    "vpbank": "vpbank", "abb": "abbank", "ab": "abbank", "abbank": "abbank", "scb": "sacombank", "shb": "shb", "sacombank": "sacombank",
    "momo": "momo", "viettelpay": "viettelpay", "payoo": "payoo", "vnpay": "vnpay", "zalopay": "zalopay",
}

# Leading words that name a bank in another way.
CHANNEL_PHRASES = {"an binh": "abbank", "cong thuong": "vietinbank", "quan doi": "mb", "vp bank": "vpbank", "nn": "agribank"}

# Kind of provider by collection channel label.
COLLECTION_CHANNELS = {
    "momo": "wallet", "zalopay": "wallet", "viettelpay": "wallet", "shopee": "wallet", "shopeepay": "wallet", "vnpay": "wallet",
    "payoo": "wallet", "vnpt": "other", "buu dien": "other", "napas": "other",
}


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with one-letter decompositions and their base letters; combining marks follow and are dropped."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point).lower()) if not unicodedata.combining(c)).replace("đ", "d")
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


def fold(c: Column) -> Column:
    """Lower case without diacritics; đ is d."""
    source, target = _folding()
    return F.translate(F.lower(c), source, target)


def letter_words(c: Column) -> Column:
    """Folded runs of letters, in order."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0))


def name_key(c: Column) -> Column:
    return F.array_join(letter_words(c), " ")


def squeezed(c: Column) -> Column:
    """Single spaces between words, none around."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def reconciliation_key(c: Column) -> Column:
    return F.sha2(squeezed(fold(c)), 256)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def text_tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The distinct folded words of two or more letters, stop words left out, sorted."""
    words = F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z]{2,}"), F.lit(0)))
    return F.array_sort(F.filter(words, lambda w: ~w.isin(sorted(set(stop)))))


def word_ngrams(words: Column, low: int = 2, high: int = 6) -> Column:
    """All runs of ``low`` to ``high`` words, space-joined, distinct."""

    def of(n: int) -> Column:
        spans = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(*(of(n) for n in range(low, high + 1))))


def longest_words(words: Column, k: int = 8) -> Column:
    """The ``k`` longest distinct words, ties in alphabetical order."""
    keyed = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, k), lambda x: x["w"])


def id_key(c: Column) -> Column:
    """One to six digits are padded to six; anything else is trimmed and stands."""
    value = F.trim(c)
    return F.when(value.rlike("^[0-9]{1,6}$"), F.lpad(value, 6, "0")).otherwise(value)


def confirmed_ids(c: Column) -> Column:
    """The six-digit ids of a confirmed label cell (lists by blanks and ,;/+&; ``123.0`` counts), null if any part is none."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"[\s,;/+&]+"), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "^'", ""), r"^([0-9]{1,6})\.0+$", "$1"))
    valid = (F.size(plain) > 0) & F.forall(plain, lambda x: x.rlike("^[0-9]{1,6}$"))
    return F.when(valid, F.array_distinct(F.transform(plain, lambda x: F.lpad(x, 6, "0"))))


def channel_key(c: Column) -> Column:
    """Canonical channel of a bank or wallet label; the folded words themselves where it is not known."""
    words = letter_words(F.coalesce(c, F.lit("")))
    key = F.array_join(words, " ")
    out = F.when(F.size(words) == 0, F.lit("unknown"))
    for phrase, channel in CHANNEL_PHRASES.items():
        out = out.when((key == phrase) | key.startswith(phrase + " "), F.lit(channel))
    table = F.create_map(*(F.lit(x) for pair in CHANNELS.items() for x in pair))
    return out.otherwise(F.coalesce(F.try_element_at(table, F.get(words, F.lit(0))), key))


def collection_channel(c: Column) -> Column:
    """Provider kind of a collection channel label, null for banks and unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in COLLECTION_CHANNELS.items() for x in pair))
    return F.try_element_at(table, name_key(F.coalesce(c, F.lit(""))))


def alias_key(c: Column) -> Column:
    """Folded, squeezed alias of 2 to 100 ordinary characters, else null."""
    key = squeezed(fold(c))
    return F.when(F.length(key).between(2, 100) & key.rlike(r"^[a-z0-9][a-z0-9 ._()/&-]*$"), key)


def allocation_names(ids: Column, names: Column) -> Column:
    """A name for each id: the list's parts where they are as many, else none; a single id takes the whole."""
    whole = F.trim(F.coalesce(names, F.lit("")))
    parts = F.transform(F.split(whole, r"[;|\n]"), lambda x: F.trim(x))
    return F.when(F.size(ids) == 1, F.array(whole)).when(F.size(parts) == F.size(ids), parts).otherwise(F.transform(ids, lambda _: F.lit("")))


def compare_names(query: Column, history: Column) -> Column:
    """match or mismatch of two sets of whole names, missing where one is empty."""
    keys = lambda names: F.array_sort(F.array_distinct(F.filter(F.transform(names, name_key), lambda k: k != "")))
    q, h = keys(query), keys(history)
    return F.when((F.size(q) == 0) | (F.size(h) == 0), "missing").when(q == h, "match").otherwise("mismatch")


def water_receiver(c: Column, payee: Payee = DEFAULT) -> Column:
    """Whether a name is the payee's; a water company of another city is not."""
    return name_key(c).rlike(payee.receiver)


def valid_name(c: Column) -> Column:
    """Two to twelve words of letters, hyphens and apostrophes, at most 200 characters, and no receiver of water bills."""
    name = squeezed(c)
    return F.size(F.split(name, " ")).between(2, 12) & (F.length(c) <= 200) & c.rlike(r"^[\p{L}\p{M}\s'’-]+$") & ~water_receiver(c)


def branch_markers(c: Column) -> Column:
    """Sorted markers cs:N, kv:N and school:N of numbered branches, areas and schools."""
    pattern = r"\b(cs|co\s*so|kv|khu\s*vuc|truong\s*(?:th|tieu\s*hoc)\s*so)\s*(\d+)\b"
    text = fold(c)
    kinds, numbers = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))

    def marker(kind: Column, n: Column) -> Column:
        prefix = F.when(kind.rlike("^(cs|co so)$"), "cs").when(kind.rlike("^(kv|khu vuc)$"), "kv").otherwise("school")
        return F.concat(prefix, F.lit(":"), n)

    return F.array_sort(F.array_distinct(F.zip_with(kinds, numbers, marker)))


# Device names that cannot begin a file name.
DEVICES = r"^(?i:CON|PRN|AUX|NUL|(?:COM|LPT)[1-9¹²³])$"


def portable_filename(c: Column, most: int = 180) -> Column:
    """A file name that is valid on common systems and at most ``most`` bytes long, with its suffix; ``upload`` where nothing stays."""
    clean = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")
    device = F.regexp_replace(F.substring_index(clean, ".", 1), " +$", "").rlike(DEVICES)
    name = F.when(device, F.concat(F.lit("_"), clean)).otherwise(clean)
    suffix = F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    room = F.lit(most) - F.octet_length(suffix)
    # the last of the room's bytes and the three before it: a prefix ends where no continuation byte follows
    data = F.encode(stem, "UTF-8")
    ends = lambda at: ~F.hex(F.substr(data, at + 1, F.lit(1))).between("80", "BF")
    end = F.when(F.octet_length(stem) <= room, F.octet_length(stem)).when(room < 0, None)
    for back in range(3):
        end = end.when(ends(room - back), room - back)
    head = F.substr(data, F.lit(1), end.otherwise(room - 3)).cast("string")
    cut = F.regexp_replace(head, r"[ .]+$", "")
    return F.concat(F.when(cut == "", "upload").otherwise(cut), suffix)


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
