"""Sequence similarity in Arrow batches, for fused candidates only. Equal pairs of a worker are compared once."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1 << 15)
def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 4)


@lru_cache(maxsize=1 << 15)
def _word_ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def _word_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_word_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts, rounded to four places; not symmetric."""
    return F.pandas_udf(_ratios, "double")(a, b)


def word_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts as word sequences."""
    return F.pandas_udf(_word_ratios, "double")(a, b)
