"""Functions on dates, periods, money and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats that are tried in turn.
DATE_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd.MM.yyyy", "dd-MM-yy", "dd/MM/yy", "yyyy-MM-dd")
#: Confidence of a first sighting, and the share of the rest that each newer period adds or an absence takes.
FIRST, GAIN, DECAY = 0.2, 0.3, 0.7
#: Weights of the linear score.
WEIGHTS = {"customer": 0.30, "payer": 0.10, "text": 0.20, "structure": 0.15, "number": 0.15, "history": 0.10}


def date_text(c: Column) -> Column:
    """ISO text of a date in one of the known formats; other text stands as it is."""
    value = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^'", ""))
    parsed = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), value)


def serial_date(days: Column) -> Column:
    """Date of a spreadsheet serial number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int"))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def period_of(c: Column) -> Column:
    """YYYY-MM of ISO text, else ``unknown``."""
    return F.when(c.rlike(r"^\d{4}-\d{2}"), F.substring(c, 1, 7)).otherwise("unknown")


def newer_period(period: Column, previous: Column) -> Column:
    """Whether a known period is after another one, or that one is unknown."""
    return (period != "unknown") & (previous.isin("", "unknown") | (period > previous))


def month_range(first: Column, last: Column, most: int = 24) -> Column:
    """MM/yyyy of each month between two dates; none if they are reversed or more than ``most`` months."""
    a, b = F.trunc(first, "month"), F.trunc(last, "month")
    n = F.months_between(b, a)
    months = F.when((n >= 0) & (n < most), F.sequence(a, b, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(months, lambda m: F.date_format(m, "MM/yyyy"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_money(c: Column) -> Column:
    """Amount of locale-formatted text: grouped by dots or commas, in parentheses if negative; null on doubt, 0 if empty."""

    def number(token: Column) -> Column:
        return (
            F.when(token.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$"), F.translate(token, ",.", "."))
            .when(token.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$"), F.replace(token, F.lit(","), F.lit("")))
            .when(token.rlike(r"^[+-]?\d{1,3}([.,]\d{3})+$"), F.translate(token, ".,", ""))
            .when(token.contains(",") & token.contains("."), F.lit(None))
            .otherwise(F.translate(token, ",", "."))
        )

    def signed(value: Column) -> Column:
        negative = value.rlike(r"^\(.*\)$")
        token = F.regexp_replace(F.regexp_replace(value, r"^\((.*)\)$", "$1"), r"\s+|(?i)(VND|VNĐ|đ|₫)\s*$", "")
        plain = let(let(token, number), lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x)).try_cast("double")
        return let(plain, lambda x: F.when(negative, -x).otherwise(x))

    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(let(F.trim(F.regexp_replace(F.trim(c), "^'", "")), signed))


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; 0 and 1 without observations."""
    n = total.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    some = total > 0
    return F.when(some, (centre - margin) / scale).otherwise(0.0), F.when(some, (centre + margin) / scale).otherwise(1.0)


def slot_kind(hits: Column, total: Column) -> Column:
    """id, not_id or unknown, by the bounds of the share of hits."""
    low, high = wilson(hits, total)
    return F.when(low >= 0.95, "id").when(high <= 0.05, "not_id").otherwise("unknown")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clipped to 0 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot))


def vector_buckets(v: Column, k: int = 8) -> Column:
    """Tokens v:index:sign of the ``k`` greatest components by size; zeros have none."""
    keyed = F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("n"), i.alias("i"), (x >= 0).cast("int").alias("s")))
    # zeros go first: most components of a text's vector are, and sorting is what costs
    kept = F.slice(F.array_sort(F.filter(keyed, lambda x: ~x["n"].eqNullSafe(0))), 1, k)
    kept = F.filter(kept, lambda x: x["n"].isNotNull())
    return F.transform(kept, lambda x: F.concat(F.lit("v:"), x["i"], F.lit(":"), x["s"]))


def history_score(confidence: Column, seen: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * confidence + 0.5 * F.least(F.lit(1.0), F.log1p(seen) / F.log(F.lit(10.0))))


def weighted_score(**parts: Column) -> Column:
    """The weighted sum of the parts of a match, clipped to 0 and 1."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def reciprocal_rank(weight: Column, rank: Column, constant: int = 60) -> Column:
    return weight / (constant + rank)


def confidence_after(advances: Column) -> Column:
    """Confidence after so many advances to a newer period."""
    return 1 - (1 - FIRST) * F.pow(F.lit(1 - GAIN), advances)


def decayed(present: Column) -> Column:
    """Confidence after a run of periods, of which each either shows the value (gain) or does not (decay)."""
    return F.aggregate(present, F.lit(FIRST), lambda c, here: F.when(here, c + GAIN * (1 - c)).otherwise(c * DECAY))


def percentile_rank(values: Column, p: int) -> Column:
    """Nearest-rank percentile of an array: element floor((n - 1) p / 100) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) * p / 100).cast("int"))


def ratio_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and F0.5, null where their denominators are zero."""
    p, r = F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    f = lambda b: F.try_divide((1 + b * b) * p * r, b * b * p + r)
    return {"precision": p, "recall": r, "f1": f(1.0), "f05": f(0.5)}
