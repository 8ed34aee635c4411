"""Classifiers: held-out accuracy on the tables, and defined results for odd rows."""

import zlib

import numpy as np
import pytest

from ledgerline.llm import langid, quality, toxicity
from ledgerline.llm.common import fold_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [(1, None), (2, ""), (3, " \n "), (4, "123 ..."), (5, "word"), (5, "word"), (None, "thing of the " * 9), (6, "é " * 30000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", True, 0.5) for i, t in ODD], "doc_id long, text string, lang_pred string, held_out boolean, score double")


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456789, None)], "doc_id long").select(fold_of(__import__("pyspark").sql.functions.col("doc_id"), 4).alias("f")).collect()
    assert [r.f for r in rows] == [*(zlib.crc32(str(i).encode()) % 4 for i in (0, 7, 123456789)), 0]


def plain_kernel(a, b):
    x, y = set(langid.grams(a).tolist()), set(langid.grams(b).tolist())
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_kernel_values_are_exact():
    texts = ["ab ba", "abba abba", "x y z"]
    rows = [(t, "a") for t in texts]
    found = [langid.grams(t) for t, _ in rows]
    columns = np.unique(np.concatenate(found))
    seen, n = langid.Presence(columns).of(found)
    got = seen @ seen.T / np.sqrt(np.outer(n, n))
    assert np.allclose(got, [[plain_kernel(a, b) for b in texts] for a in texts])


def test_languages(docs, odd):
    model = langid.fit_documents(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    by = sorted(((str(r.doc_id), r.lang_pred == "und") for r in langid.predict(odd, model).collect()))
    assert by == [("1", True), ("2", True), ("3", True), ("4", True), ("5", False), ("5", False), ("6", False), ("None", False)]
    assert langid.predict(odd.limit(0), model).count() == 0
    empty = langid.fit_documents(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.fit([("abc", "xx")]).predict(["abc", "zzz"])[1][0] == "xx"


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_labels(docs, labels, odd, module, label, cut):
    model = module.fit_documents(docs, labels)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = module.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.CUT) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([truth[r.doc_id] == r.predicted for r in held]) > cut
    rows = module.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert module.predict(odd.limit(0), model).count() == 0
    one = module.fit_documents(docs, labels.where(f"{label} = 1"))
    assert len({r.score for r in module.predict(odd, one).collect()}) == 1
    none = module.fit_documents(docs, labels.limit(0))
    assert {r.score for r in module.predict(odd, none).collect()} == {0.5}


def test_gradients_are_right():
    texts = [["you", "idiot", ""], ["a", "b", "c", "dd"], ["x"]]
    model = toxicity.Model({"idiot": 1, "a": 2}, toxicity._parameters(3))
    labels = np.array([1.0, 0.0, 1.0])
    _, g = toxicity._gradients(model, texts, labels)
    for name, value in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        keep = value[at]
        value[at] = keep + 1e-5
        up = toxicity._gradients(model, texts, labels)[0]
        value[at] = keep - 1e-5
        down = toxicity._gradients(model, texts, labels)[0]
        value[at] = keep
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_windows_cover_whole_texts():
    for n in (0, 1, 24, 25, 40, 41, 500):
        at = toxicity.starts(n)
        assert set(range(n)) <= {i for a in at for i in range(a, a + toxicity.WINDOW)}
        assert all(a + toxicity.WINDOW <= max(n, toxicity.WINDOW) for a in at)
    model = toxicity.fit([("you idiot", 1), ("you dear", 0)] * 20)
    apart = [model.score([t])[0] for t in ("you idiot", "", "word " * 900, "x y")]
    assert np.allclose(model.score(["you idiot", "", "word " * 900, "x y"]), apart, atol=1e-5)


def test_descent_parts_separable_texts():
    rows = [(f"good fine word{i}", 1) for i in range(40)] + [(f"bad poor word{i}", 0) for i in range(40)]
    model = quality.fit(rows)
    scores = model.score([t for t, _ in rows], quality.Words())
    assert min(scores[:40]) > 0.7 > max(scores[40:])


def plain_logit(model, words):
    """Logit of one window by the formulas, a step at a time and in double precision."""
    p, n = model.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        marked = f"<{word}>"
        grams = [marked[i : i + 3] for i in range(len(marked) - 2)]
        rows = [toxicity.trigrams([word])[0][i] for i in range(len(grams))]
        return np.r_[p["words"][model.vocabulary.get(word, 0)], np.mean([p["chars"][r] for r in rows], axis=0)] @ p["in"] + p["in_bias"]

    def walk(gates, u):
        h, out = np.zeros(n), []
        for x in gates:
            z, r = sigmoid(x[:n] + h @ u[:, :n]), sigmoid(x[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(x[2 * n :] + (r * h) @ u[:, 2 * n :])
            h = h + z * (c - h)
            out.append(h)
        return out

    x = [vector(toxicity.normal(w)) for w in words]
    states = [np.r_[a, b] for a, b in zip(walk([v[: 3 * n] for v in x], p["ahead"]), walk([v[3 * n :] for v in x[::-1]], p["back"])[::-1], strict=True)]
    weight = np.exp([np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["attend_to"] for s in states])
    return float(sum(w * (s @ p["out"]) for w, s in zip(weight / weight.sum(), states, strict=True)) + p["out_bias"][0])


def test_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(5)
    known = ["idiot", "dear", "fine", "day", "Mörder", "x"]
    model = toxicity.Model({"idiot": 1, "dear": 2, "fine": 3}, toxicity._parameters(4), slope=1.5, offset=-0.2)
    for n in (1, 5, 24, 25, 60):
        words = [known[i] for i in rng.integers(0, len(known), n)]
        every = [plain_logit(model, words[a : a + toxicity.WINDOW]) for a in toxicity.starts(n)]
        want = 1 / (1 + np.exp(-(1.5 * max(every) - 0.2)))
        assert abs(model.score([" ".join(words)])[0] - want) < 1e-5
        assert all(any(a <= k and k + toxicity.WINDOW // 2 <= a + toxicity.WINDOW for a in toxicity.starts(n)) for k in range(max(1, n - toxicity.WINDOW // 2)))


def test_features_are_those_of_plain_sets():
    words = quality.Words()
    for text in ("one two one", "word", "a " * 3000, " ".join(f"w{i % 500} W{i}" for i in range(3000))):
        got = quality.features(text, words)
        assert got.tolist() == sorted(set(got.tolist())) and 0 <= got[0] and got[-1] < 1 << quality.BITS
    both = set(quality.features("one two three", words).tolist())
    assert 8 <= len(both) <= 3 + 2 + 3 + 2 + 1  # words, pairs, shapes of one to three; equal hashes count once
    assert set(quality.features("one two", words).tolist()) <= both


MASK = (1 << 64) - 1


def plain_features(text):
    """Feature numbers by plain loops over words: words, pairs, and runs of one to four shapes that know of repeats."""
    words = (text or "").split()
    a, b = int(quality._A), int(quality._B)
    ids = [zlib.crc32(w.lower().encode()) for w in words]
    forms = [(zlib.crc32(quality.shape(w).encode()) * b + (k > 0 and ids[k] == ids[k - 1])) & MASK for k, w in enumerate(words)]
    found = [x * a + 1 for x in ids] + [(x * b + y) * a + 2 for x, y in zip(ids, ids[1:], strict=False)]
    for n in range(4):
        for k in range(len(words) - n):
            code = 0
            for f in forms[k : k + n + 1]:
                code = (code * b + f) & MASK
            found.append(code * a + 3 + n)
    return sorted({(((x & MASK) * a) & MASK) >> (64 - quality.BITS) for x in found})


def quality_rows(n=60):
    rng = np.random.default_rng(11)
    good, bad = ["The river runs slowly.", "Birds sing at dawn,", "we read old books"], ["CLICK here!!!", "$$$ 999", "buy buy buy"]
    return [(" ".join(rng.choice(good if (i % 2) ^ (rng.random() < 0.15) else bad, 4)), i % 2) for i in range(n)]


def test_quality_by_plain_formulas():
    """Features, ratios, weights and scores equal those of plain loops, and the weights are near the least possible loss."""
    rows = quality_rows()
    words = quality.Words()
    found = [plain_features(t) for t, _ in rows]
    assert [quality.features(t, words).tolist() for t, _ in rows] == found and quality.features(None, words).size == 0
    labels = np.array([1 if y else -1 for _, y in rows])
    size = 1 << quality.BITS

    def ratios_of(which):
        count = {1: {}, -1: {}}
        for i in which:
            for f in found[i]:
                count[labels[i]][f] = count[labels[i]].get(f, 0) + 1
        total = {c: quality.SMOOTH * size + sum(count[c].values()) for c in count}
        return lambda f: np.log((quality.SMOOTH + count[1].get(f, 0)) / total[1] / ((quality.SMOOTH + count[-1].get(f, 0)) / total[-1]))

    ratio = ratios_of(range(len(rows)))
    got = quality._ratios([np.array(f) for f in found], labels)
    assert all(abs(got[f] - ratio(f)) < 1e-9 for at in found for f in at)

    def vector(f):
        v = {k: ratio(k) for k in f}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {k: x / norm for k, x in v.items()}

    vectors = [vector(f) for f in found]
    cost = {c: quality.COST * len(rows) / (2 * (labels == c).sum()) for c in (1, -1)}

    def margin(w, bias, v):
        return sum(w.get(k, 0.0) * x for k, x in v.items()) + bias

    def loss(w, bias):
        return 0.5 * (sum(x * x for x in w.values()) + bias**2) + sum(cost[y] * max(0.0, 1 - y * margin(w, bias, v)) for v, y in zip(vectors, labels, strict=True))

    def descend(epochs):
        w, bias, alpha, rng = {}, 0.0, [0.0] * len(rows), np.random.default_rng(7)
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(len(rows)):
                y, v = labels[i], vectors[i]
                new = min(max(alpha[i] + (1 - y * margin(w, bias, v)) / (sum(x * x for x in v.values()) + 1), 0.0), cost[y])
                for k, x in v.items():
                    w[k] = w.get(k, 0.0) + (new - alpha[i]) * y * x
                bias += (new - alpha[i]) * y
                moved += abs(new - alpha[i])
                alpha[i] = new
            if moved < 1e-3 * len(rows):
                break
        return w, bias, sum(alpha) - 0.5 * (sum(x * x for x in w.values()) + bias**2)

    w, bias, _ = descend(quality.EPOCHS)
    dense, b = quality._descend([np.array(f) for f in found], got, labels)
    assert abs(b - bias) < 1e-9 and all(abs(dense[k] - x) < 1e-9 for k, x in w.items())
    _, _, dual = descend(400)  # the dual's value bounds the least loss from below
    assert loss({k: dense[k] for k in w}, b) < dual * 1.05 + 1e-6
    model = quality.fit(rows)
    for text, f in [(t, f) for (t, _), f in zip(rows, found, strict=True)] + [("", []), ("unseen words here", plain_features("unseen words here"))]:
        norm = sum(ratio(k) ** 2 for k in f) ** 0.5
        m = sum(dense[k] * ratio(k) for k in f) / norm + b if norm else b
        assert abs(model.score([text], words)[0] - 1 / (1 + np.exp(-(model.slope * m + model.offset)))) < 1e-4


def test_languages_by_plain_formulas(monkeypatch):
    """Kernel, landmarks' whitening, ridge regression and scores equal those of plain loops with an intercept of its own."""
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    rng = np.random.default_rng(5)
    bits = {"aa": ["the", "and", "of", "then", "her"], "bb": ["der", "und", "nicht", "ich", "zu"], "cc": ["que", "les", "des", "pas", "une"]}
    rows = [(" ".join(rng.choice(bits[lang], rng.integers(2, 7))), lang) for lang in bits for _ in range({"aa": 9, "bb": 5, "cc": 7}[lang])] + [("...", "aa"), (None, "bb")]
    model = langid.fit(rows)
    known = [(t, lang) for t, lang in rows if langid.grams(t) is not None]
    sets = [set(langid.grams(t).tolist()) for t, _ in known]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    languages, chosen = sorted(bits), []
    for lang in languages:
        mine = [i for i, (_, x) in enumerate(known) if x == lang]
        chosen += [sets[i] for i in sorted(mine, key=lambda i: len(langid.grams(known[i][0])))[-(8 // 3) :]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in chosen] for a in chosen]))
    keep = [i for i, v in enumerate(values) if v > 1e-6 * max(values)]

    def mapped(s):
        k = [kernel(s, c) for c in chosen]
        return [sum(k[j] * vectors[j, i] for j in range(len(k))) / values[i] ** 0.5 for i in keep]

    x = [[*mapped(s), 1.0] for s in sets]
    weight = [1 / sum(y == lang for _, y in known) for _, lang in known]
    weight = [w / (sum(weight) / len(weight)) for w in weight]
    n = len(x[0])
    a = np.array([[sum(w * r[i] * r[j] for w, r in zip(weight, x, strict=True)) + (langid.RIDGE * len(known) if i == j < n - 1 else 0) for j in range(n)] for i in range(n)])
    y = np.array([[sum(w * r[i] * (1 if lang == c else -1) for w, r, (_, lang) in zip(weight, x, known, strict=True)) for c in languages] for i in range(n)])
    beta = np.linalg.solve(a, y)
    for text in [t for t, _ in known] + ["the und que", "zzz", "e"]:
        s = set(langid.grams(text).tolist())
        m = np.array([*mapped(s), 1.0]) @ beta
        assert np.allclose(model.margins([langid.grams(text)])[0], m, atol=1e-4)
        p = np.exp(m * langid.SHARPNESS) / np.exp(m * langid.SHARPNESS).sum()
        lang, score = model.predict([text])[0]
        assert abs(score - p.max()) < 1e-3 and (lang == languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)
