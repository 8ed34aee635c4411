"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, a blended spectrum) that both have, whatever their
counts, over the geometric mean of the numbers that each has. Nyström landmarks are texts of a bounded training sample;
kernel values against them, whitened by the landmarks' own kernel matrix, feed one ridge regression per language against all
others. A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fold_of, map_texts, spread, stratified_ids, texts_of

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bounds of the training sample: texts per language, texts in all, characters of a text.
PER_LANGUAGE, SAMPLE, SAMPLE_CHARS = 192, 4096, 20_000
LANDMARKS = 96
RIDGE = 1e-2
#: How steeply margins turn into a score.
SHARPNESS = 6.0
LONGEST, BITS = 3, 15
_SIZE = LONGEST << BITS
_ROWS = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a whole text, with repeats; None without a letter. Runs of other characters are one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        letter[high] = [chr(x).isalpha() for x in points[high].tolist()]
    if not letter.any():
        return None
    points = np.where(letter, points, 32)
    points = points[letter | np.r_[True, letter[:-1]]]
    points = np.r_[32, points, 32].astype(np.uint64)
    out = []
    code = np.zeros(len(points), dtype=np.uint64)
    for n in range(LONGEST):
        code = code[: len(points) - n] + points[n:] * _MIX[n]
        out.append(((code * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64) + (n << BITS))
    return np.concatenate(out)


class Presence:
    """Rows of zeros and ones over the columns that landmarks have, and each text's number of n-grams."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns, self.board = columns, np.zeros(_SIZE, dtype=bool)

    def of(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.empty((len(found), len(self.columns)), dtype=np.float32)
        sizes = np.empty(len(found))
        for k, g in enumerate(found):
            self.board[g] = True
            rows[k] = self.board[self.columns]
            sizes[k] = np.count_nonzero(self.board)
            self.board[g] = False
        return rows, sizes


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray  # columns x landmarks, over the root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages: whitening and ridge weights in one
    bias: np.ndarray

    def margins(self, found: list[np.ndarray]) -> np.ndarray:
        rows, sizes = Presence(self.columns).of(found)
        return (rows @ self.landmarks) / np.sqrt(sizes)[:, None] @ self.weights + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for k in range(0, len(texts), _ROWS):
            found = {i: g for i, t in enumerate(texts[k : k + _ROWS], k) if (g := grams(t)) is not None}
            if not found:
                continue
            some = list(found)
            m = self.margins(list(found.values())) * SHARPNESS
            p = np.exp(m - m.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, b, row in zip(some, best.tolist(), p, strict=True):
                out[i] = (self.languages[b], float(row[b]))
        return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language); rows without letters teach nothing, and no rows at all give a model that knows none."""
    found = [(g, lang) for text, lang in rows if (g := grams(text)) is not None]
    languages = sorted({lang for _, lang in found})
    if not found:
        return Model([], np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    by = {lang: [g for g, x in found if x == lang] for lang in languages}
    share = max(1, LANDMARKS // len(languages))
    chosen = [g for lang in languages for g in sorted(by[lang], key=len)[-share:]]
    columns = np.unique(np.concatenate(chosen))
    see = Presence(columns)
    points, sizes = see.of(chosen)
    landmarks = (points / np.sqrt(sizes)[:, None]).T.astype(np.float32)
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(float))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = []
    for k in range(0, len(found), _ROWS):
        seen, n = see.of([g for g, _ in found[k : k + _ROWS]])
        features.append((seen @ landmarks) / np.sqrt(n)[:, None] @ whiten)
    x = np.concatenate(features)
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in found])
    # each language counts alike
    w = np.array([1.0 / len(by[lang]) for _, lang in found])
    w /= w.mean()
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    target = (w[:, None] * y).sum(axis=0) / w.sum()
    centred = x - mean
    ridge = np.linalg.solve((centred * w[:, None]).T @ centred + RIDGE * len(found) * np.eye(x.shape[1]), (centred * w[:, None]).T @ (y - target))
    return Model(languages, columns, landmarks, (whiten @ ridge).astype(np.float32), (target - mean @ ridge).astype(np.float32))


def fit_documents(docs: DataFrame) -> Model:
    """A model from a bounded sample of the documents that are not held out and have a language."""
    learn = docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    ids = dict(stratified_ids(learn.select("doc_id", "lang"), "lang", PER_LANGUAGE, SAMPLE))
    texts = texts_of(docs.select("doc_id", "text"), list(ids), SAMPLE_CHARS)
    return fit([(texts[i], str(ids[i])) for i in sorted(texts)])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, from its text alone.

    Texts that are null or have no letter are ``und`` with score 0; so are all texts where nothing could be learned. Repeated
    rows and null ids (never held out) give a row each; an empty table gives none; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        got = model.predict(rows.column("text").to_pylist())
        return {"doc_id": rows.column("doc_id").to_pylist(), "held_out": rows.column("held_out").to_pylist(), "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(spread(rows), run, "doc_id long, held_out boolean, lang_pred string, score double", arrow)
