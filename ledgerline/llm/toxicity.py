"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each step of a window reads a word's own vector (words of the training sample) and the mean of its character trigrams'
vectors (any word). All overlapping windows of a text are scored; a text has the score of its highest window. Training is by
multiple instances: a text's label is learned from its highest window, in the first epochs from the window that has its most
telling word by naive Bayes.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fold_of, map_texts, spread
from ledgerline.llm.quality import sample

FOLDS, HELD_OUT = 5, 0
#: Bounds of the training sample: texts per class, characters of a text.
PER_CLASS, SAMPLE_CHARS = 1000, 20_000
CUT = 0.5
#: Words in a window, and between the starts of two windows: half a window, so that each run of half a window lies whole in one.
WINDOW, STEP = 24, 12
VOCABULARY, TRIGRAM_BITS = 4096, 12
WORD, CHARS, HIDDEN, ATTEND = 8, 8, 8, 8
EPOCHS, WARM, BATCH, RATE = 9, 2, 64, 0.02
#: Words remembered by a worker, and windows scored at once.
MEMO, AT_ONCE = 150_000, 1024
_MARKS = string.punctuation + "“”„‘’«»‹›¡¿…–—·•"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def normal(token: str) -> str:
    """A token in lower case without marks at its ends."""
    return token.strip(_MARKS).lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of words between angle brackets, end to end, and how many each word has."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    code = points[:-2] * _MIX[0] + points[1:-1] * _MIX[1] + points[2:] * _MIX[2]
    ends = np.cumsum(size + 2)
    inside = np.ones(len(code), dtype=bool)
    for k in (1, 2):
        inside[ends[:-1] - k] = False
    # the empty word's two brackets have none: it takes the first of what follows, or number 0 at the end
    hashed = ((code * _MIX[0]) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
    if (size == 0).any():
        empty = ends[:-1][size[:-1] == 0] - 2 if len(size) > 1 else np.zeros(0, dtype=np.int64)
        inside[empty], hashed[empty] = True, 0
        if size[-1] == 0:
            return np.r_[hashed[inside], 0], np.maximum(size, 1)
    return hashed[inside], np.maximum(size, 1)


def starts(n: int) -> list[int]:
    """Where the windows of ``n`` words begin; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states (steps, rows, hidden) of one direction from its input gates (steps, rows, 3 hidden)."""
    steps, rows, _ = x.shape
    h = np.zeros((rows, HIDDEN), dtype=x.dtype)
    out = np.empty((steps, rows, HIDDEN), dtype=x.dtype)
    memory = []
    gates, inner = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    for t in range(steps):
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ inner)
        m = mask[t][:, None]
        new = h + m * z * (c - h)
        if keep:
            memory.append((h, z, r, c, m))
        out[t] = h = new
    return out, memory


def _backward(d: np.ndarray, memory: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of ``u``."""
    gates, inner = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    dx = np.zeros((len(memory), d.shape[1], 3 * HIDDEN))
    du = np.zeros_like(u)
    dh = np.zeros(d.shape[1:])
    for t in range(len(memory) - 1, -1, -1):
        h, z, r, c, m = memory[t]
        dh = dh + d[t]
        dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
        drh = dc @ inner.T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        dx[t] = np.concatenate([dzr, dc], axis=1)
        du[:, : 2 * HIDDEN] += h.T @ dzr
        du[:, 2 * HIDDEN :] += (r * h).T @ dc
        dh = dh * (1 - m * z) + drh * r + dzr @ gates.T
    return dx, du


@dataclass
class Model:
    """Parameters by name, the word numbers, and the curve from a text's logit to its score."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _gates: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "p": self.p, "slope": self.slope, "offset": self.offset, "_rows": {}, "_gates": None}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Word numbers, input vectors and trigrams of some words."""
        flat, size = trigrams(words)
        number = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        chars = np.add.reduceat(self.p["chars"][flat], np.cumsum(size) - size, axis=0) / size[:, None]
        return number, np.concatenate([self.p["words"][number], chars], axis=1), (flat, size)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """Rows of the gate table for some tokens; row 0 pads."""
        rows = self._rows
        new = [t for t in set(tokens) if t not in rows]
        if new or self._gates is None:
            if self._gates is None or len(rows) + len(new) > MEMO:
                rows.clear()
                self._gates = (np.zeros((1, 3 * HIDDEN), dtype=np.float32),) * 2
                new = list(set(tokens))
            if new:
                _, x, _ = self.inputs([normal(t) for t in new])
                g = (x @ self.p["in"] + self.p["in_bias"]).astype(np.float32)
                at = len(self._gates[0])
                both = g[:, : 3 * HIDDEN], g[:, 3 * HIDDEN :]
                for d in both:
                    d[:, : 2 * HIDDEN] *= np.float32(0.5)
                self._gates = tuple(np.concatenate(x) for x in zip(self._gates, both, strict=True))
                rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def logits(self, windows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logit of each window (rows, steps) of gate table rows. Both directions go through the same array operations."""
        p = {k: v.astype(np.float32) for k, v in self.p.items() if k not in ("words", "chars")}
        half = np.float32(0.5)  # a sigmoid is half a hyperbolic tangent of half its argument
        gates = np.stack([p["ahead"][:, : 2 * HIDDEN], p["back"][:, : 2 * HIDDEN]]) * half
        inner = np.stack([p["ahead"][:, 2 * HIDDEN :], p["back"][:, 2 * HIDDEN :]])
        out = np.empty(len(windows), dtype=np.float32)
        for k in range(0, len(windows), AT_ONCE):
            at = windows[k : k + AT_ONCE].T
            m = mask[k : k + AT_ONCE].T
            whole = bool(m.all())
            h = np.zeros((2, at.shape[1], HIDDEN), dtype=np.float32)
            states = np.empty((2, WINDOW, at.shape[1], HIDDEN), dtype=np.float32)
            for t in range(WINDOW):
                x = np.stack([self._gates[0][at[t]], self._gates[1][at[WINDOW - 1 - t]]])
                zr = h @ gates
                zr += x[:, :, : 2 * HIDDEN]
                np.tanh(zr, out=zr)
                zr *= half
                zr += half
                c = (zr[:, :, HIDDEN:] * h) @ inner
                c += x[:, :, 2 * HIDDEN :]
                np.tanh(c, out=c)
                c -= h
                c *= zr[:, :, :HIDDEN]
                if not whole:
                    c *= np.stack([m[t], m[WINDOW - 1 - t]])[:, :, None]
                h = h + c
                states[0, t], states[1, WINDOW - 1 - t] = h[0], h[1]
            a = states[0] @ p["attend"][:HIDDEN]
            a += states[1] @ p["attend"][HIDDEN:]
            a += p["attend_bias"]
            weight = np.exp(np.tanh(a, out=a) @ p["attend_to"]) * m
            weight /= np.maximum(weight.sum(axis=0), 1e-9)
            told = states[0] @ p["out"][:HIDDEN] + states[1] @ p["out"][HIDDEN:]
            out[k : k + AT_ONCE] = (weight * told).sum(axis=0) + p["out_bias"]
        return out

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gate table rows and mask of every window of some texts, and the number of the text that each is of."""
        flat = self._numbers([w for ws in texts for w in ws])
        size = np.array([len(ws) for ws in texts], dtype=np.int64)
        base = np.cumsum(size) - size
        begins = [starts(n) for n in size.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        begin = np.concatenate([np.array(b, dtype=np.int64) for b in begins]) + base[owner]
        at = begin[:, None] + np.arange(WINDOW)
        mask = at < (base + size)[owner][:, None]
        rows = np.where(mask, np.r_[flat, 0][np.minimum(at, len(flat))], 0)
        return rows, mask, owner

    def highest(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The greatest window logit of each text, and which of its windows has it."""
        rows, mask, owner = self.windows(texts)
        # short windows apart: the others need no mask
        order = np.argsort(~mask.all(axis=1), kind="stable")
        logit = np.empty(len(rows))
        logit[order] = self.logits(rows[order], mask[order])
        best = np.lexsort((np.arange(len(rows)), -logit, owner))
        first = best[np.r_[True, np.diff(owner[best]) > 0]]
        return logit[first], first - np.searchsorted(owner, np.arange(len(texts)))

    def score(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        return _sigmoid(self.slope * self.highest([(t or "").split() for t in texts])[0] + self.offset).tolist()


def _parameters(words: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    normal_ = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {
        "words": rng.normal(0, 0.1, (words, WORD)), "chars": rng.normal(0, 0.1, (1 << TRIGRAM_BITS, CHARS)),
        "in": normal_(WORD + CHARS, 6 * HIDDEN), "in_bias": np.zeros(6 * HIDDEN),
        "ahead": normal_(HIDDEN, 3 * HIDDEN), "back": normal_(HIDDEN, 3 * HIDDEN),
        "attend": normal_(2 * HIDDEN, ATTEND), "attend_bias": np.zeros(ATTEND), "attend_to": normal_(ATTEND),
        "out": normal_(2 * HIDDEN), "out_bias": np.zeros(1),
    }
    p["words"][0] = 0
    return p


def _gradients(model: Model, windows: list[list[str]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of some windows of normal words, and its gradients."""
    p, g = model.p, {}
    steps = max(map(len, windows))
    words = sorted({w for ws in windows for w in ws})
    place = {w: i for i, w in enumerate(words)}
    at = np.zeros((steps, len(windows)), dtype=np.int64)
    mask = np.zeros((steps, len(windows)))
    for j, ws in enumerate(windows):
        at[: len(ws), j] = [place[w] for w in ws]
        mask[: len(ws), j] = 1
    number, x, grams = model.inputs(words)
    gates = x @ p["in"] + p["in_bias"]
    all_gates = gates[at]
    ahead, kept_ahead = _forward(all_gates[:, :, : 3 * HIDDEN], mask, p["ahead"], True)
    back, kept_back = _forward(all_gates[::-1, :, 3 * HIDDEN :], mask[::-1], p["back"], True)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    a = np.tanh(both @ p["attend"] + p["attend_bias"])
    e = np.exp(a @ p["attend_to"]) * mask
    total = e.sum(axis=0)
    weight = e / total
    pooled = (weight[:, :, None] * both).sum(axis=0)
    logit = pooled @ p["out"] + p["out_bias"]
    prob = _sigmoid(logit)
    loss = -float(np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9)))
    d = (prob - labels) / len(labels)
    g["out"], g["out_bias"] = pooled.T @ d, np.array([d.sum()])
    dpooled = d[:, None] * p["out"]
    dboth = weight[:, :, None] * dpooled
    dweight = (both * dpooled).sum(axis=2)
    dscore = weight * (dweight - (weight * dweight).sum(axis=0))
    g["attend_to"] = np.einsum("sra,sr->a", a, dscore)
    da = dscore[:, :, None] * p["attend_to"] * (1 - a * a)
    g["attend"], g["attend_bias"] = np.einsum("srh,sra->ha", both, da), da.sum(axis=(0, 1))
    dboth = dboth + da @ p["attend"].T
    dx_ahead, g["ahead"] = _backward(dboth[:, :, :HIDDEN], kept_ahead, p["ahead"])
    dx_back, g["back"] = _backward(dboth[::-1, :, HIDDEN:], kept_back, p["back"])
    dgates = np.zeros_like(gates)
    np.add.at(dgates, at, np.concatenate([dx_ahead, dx_back[::-1]], axis=2) * mask[:, :, None])
    g["in"], g["in_bias"] = x.T @ dgates, dgates.sum(axis=0)
    dinput = dgates @ p["in"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], number, dinput[:, :WORD])
    g["words"][0] = 0
    flat, size = grams
    np.add.at(g["chars"], flat, np.repeat(dinput[:, WORD:] / size[:, None], size, axis=0))
    return loss, g


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """A model from (text, 0 or 1); ``share`` is that of label 1 among all rows that may teach. One class alone (or none)
    gives a model that scores every text alike."""
    rows = [(t, y) for t, y in rows if t.split()]
    labels = np.array([float(y) for _, y in rows])
    share = share if share is not None else float(labels.mean()) if rows else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    texts = [[normal(w) for w in t.split()] for t, _ in rows]
    seen: dict[str, list[int]] = {}
    for ws, y in zip(texts, labels, strict=True):
        for w in set(ws):
            seen.setdefault(w, [0, 0])[int(y)] += 1
    common = sorted((w for w, n in seen.items() if sum(n) >= 3), key=lambda w: (-sum(seen[w]), w))[: VOCABULARY - 1]
    model = Model({w: i + 1 for i, w in enumerate(common)}, _parameters(len(common) + 1))
    if len(set(labels.tolist())) < 2:
        return Model(model.vocabulary, model.p, 0.0, float(np.log(share / (1 - share))))
    n = [max(1, (labels == y).sum()) for y in (0, 1)]
    telling = {w: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for w, c in seen.items()}
    rng = np.random.default_rng(5)
    first, second = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        chosen = []
        if epoch < WARM:
            for ws in texts:
                at = max(range(len(ws)), key=lambda i: telling[ws[i]])
                a = max(0, min(at - int(rng.integers(WINDOW)), len(ws) - WINDOW))
                chosen.append(ws[a : a + WINDOW])
        else:
            model._rows, model._gates = {}, None
            for k in range(0, len(texts), 256):
                _, best = model.highest(texts[k : k + 256])
                chosen += [ws[(a := starts(len(ws))[b]) : a + WINDOW] for ws, b in zip(texts[k : k + 256], best.tolist(), strict=True)]
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            _, g = _gradients(model, [chosen[i] for i in some], labels[some])
            step += 1
            rate = RATE * 0.5 ** (epoch / 4)
            for name, d in g.items():
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.99 * second[name] + 0.01 * d * d
                model.p[name] = model.p[name] - rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    model._rows, model._gates = {}, None
    # the sample has as many texts of either class; the offset restores the share of all rows
    model.offset = float(np.log(share / (1 - share)) - np.log(n[1] / n[0]))
    return model


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    rows, share = sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS, SAMPLE_CHARS)
    return fit(rows, share)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, from its text alone.

    Null, empty and blank texts are one empty window, which has a score like any other. Repeated rows give a row each; null
    ids count as held out (fold 0); an empty table gives no rows; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        scores = model.score(rows.column("text").to_pylist())
        return {"doc_id": rows.column("doc_id").to_pylist(), "held_out": rows.column("held_out").to_pylist(), "score": scores, "predicted": [int(s >= CUT) for s in scores]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(spread(rows), run, "doc_id long, held_out boolean, score double, predicted int", arrow)
