"""A quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words and word pairs, and runs of one to four word shapes (letter case,
digits, marks, and whether a word repeats the one before). Indicators are scaled by the log-count ratios of the two classes,
texts to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve over margins from
the other half of the sample turns margins into scores, with the class shares of all labelled training rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fold_of, map_texts, spread, stratified_ids, texts_of

FOLDS, HELD_OUT = 4, 2
#: Bounds of the training sample: texts per class, characters of a text.
PER_CLASS, SAMPLE_CHARS = 1500, 50_000
CUT = 0.7
BITS = 18
SMOOTH = 1.0
COST, EPOCHS = 1.0, 25
#: Words remembered by a worker; a full memo starts anew.
MEMO = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word with its letters and digits as classes and runs as one character."""
    marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", marks)


class Words(dict):
    """Hash of a word and of its shape, by word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = (zlib.crc32(word.lower().encode("utf-8", "replace")), zlib.crc32(shape(word).encode("utf-8", "replace")))
        return got


def features(text: str | None, words: Words) -> np.ndarray:
    """The distinct feature numbers of a whole text; none without words."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    ids = np.array([words[t] for t in tokens], dtype=np.uint64)
    word, form = ids[:, 0], ids[:, 1] * _B
    same = np.r_[False, word[1:] == word[:-1]]
    form = form + same.astype(np.uint64)
    out = [word * _A + np.uint64(1), (word[:-1] * _B + word[1:]) * _A + np.uint64(2)]
    code = np.zeros(len(form), dtype=np.uint64)
    for n in range(min(4, len(form))):
        code = (code[: len(form) - n] * _B) + form[n:]
        out.append(code * _A + np.uint64(3 + n))
    at = ((np.concatenate(out) * _A) >> np.uint64(64 - BITS)).astype(np.int64)
    if len(at) < 1 << BITS - 8:  # sorting a few numbers costs less than clearing a board
        return np.unique(at)
    board = np.zeros(1 << BITS, dtype=bool)
    board[at] = True
    return np.flatnonzero(board)


@dataclass
class Model:
    """Score 1 / (1 + exp(-(slope * margin + offset))); a model without weights scores every text with ``offset``."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratios[at]
        norm = float(np.sqrt(r @ r))
        return float(self.weights[at] @ r) / norm + self.bias if norm else self.bias

    def score(self, texts: list[str | None], words: Words) -> list[float]:
        margins = np.array([self.margin(features(t, words)) for t in texts])
        return (1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))).tolist()


def _descend(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss model (L1 loss, L2 penalty, bias as a feature) by dual coordinate descent."""
    values = [(r / n if (n := np.sqrt(r @ r)) else r) for r in (ratios[at] for at in rows)]
    w, bias = np.zeros(len(ratios)), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(7)
    upper = np.where(labels > 0, COST * len(labels) / max(1, 2 * (labels > 0).sum()), COST * len(labels) / max(1, 2 * (labels < 0).sum()))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y, at, v = labels[i], rows[i], values[i]
            step = (1.0 - y * (w[at] @ v + bias)) / square[i]
            new = min(max(alpha[i] + step, 0.0), upper[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y
                w[at] += change * v
                bias += change
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved < 1e-3 * len(rows):
            break
    return w, bias


def _ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the ratio of each indicator's smoothed shares in the two classes."""
    counts = []
    for c in (1, -1):
        n = np.full(1 << BITS, SMOOTH)
        for at, y in zip(rows, labels, strict=True):
            if y == c:
                n[at] += 1
        counts.append(n / n.sum())
    return np.log(counts[0] / counts[1])


def _logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve by Newton's method, each class counting alike."""
    w = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))
    t = np.where(labels > 0, 0.98, 0.02)
    beta, x = np.array([1.0, 0.0]), np.c_[margins, np.ones(len(margins))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (w * (t - p)) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """A model from (text, 0 or 1); ``share`` is that of label 1 among all rows that may teach. One class alone (or none)
    gives a model that scores every text alike, with that share (0.5 without rows)."""
    words = Words()
    found = [features(t, words) for t, _ in rows]
    labels = np.array([1 if y else -1 for _, y in rows])
    share = share if share is not None else float((labels > 0).mean()) if rows else 0.5
    prior = float(np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3))))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, prior)
    margins = np.zeros(len(rows))
    half = np.arange(len(rows)) % 2
    if all(len(set(labels[half == h].tolist())) == 2 for h in (0, 1)):
        for h in (0, 1):
            teach = [i for i in range(len(rows)) if half[i] != h]
            ratios = _ratios([found[i] for i in teach], labels[teach])
            part = Model(ratios, *_descend([found[i] for i in teach], ratios, labels[teach]), 1.0, 0.0)
            for i in np.flatnonzero(half == h):
                margins[i] = part.margin(found[i])
    ratios = _ratios(found, labels)
    w, bias = _descend(found, ratios, labels)
    if not margins.any():
        margins = np.array([Model(ratios, w, bias, 1.0, 0.0).margin(at) for at in found])
    slope, offset = _logistic(margins, labels)
    return Model(ratios.astype(np.float32), w.astype(np.float32), float(bias), slope, offset + prior)


def labelled(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) that may teach: one row per document, the greater label where rows differ."""
    learn = labels.where((fold_of(F.col("doc_id"), folds) != held_out) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias(label))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, most_chars: int) -> tuple[list[tuple[str, int]], float | None]:
    """A bounded sample of (text, label) in order of id, and the share of label 1 in all rows that may teach."""
    learn = labelled(labels, label, folds, held_out)
    share = learn.agg(F.avg(label)).first()[0]
    ids = dict(stratified_ids(learn, label, per_class, 2 * per_class))
    texts = texts_of(docs.select("doc_id", "text"), list(ids), most_chars) if ids else {}
    return [(texts[i], int(ids[i])) for i in sorted(texts)], share


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    rows, share = sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS, SAMPLE_CHARS)
    return fit(rows, share)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, from its text alone.

    Null and empty texts have no features and get the score of the bias. Repeated rows and null ids (never held out) give a
    row each; an empty table gives none; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    memo: list[Words] = []

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        if not memo:
            memo.append(Words())
        scores = model.score(rows.column("text").to_pylist(), memo[0])
        return {"doc_id": rows.column("doc_id").to_pylist(), "held_out": rows.column("held_out").to_pylist(), "score": scores, "predicted": [int(s >= CUT) for s in scores]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(spread(rows), run, "doc_id long, held_out boolean, score double, predicted int", arrow)
