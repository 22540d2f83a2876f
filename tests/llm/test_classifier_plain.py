"""Features and scores of the classifier against a plain version, one text and one word at a time."""

import math
import random
import re

import numpy as np

from rolegraph.llm import _text, classifier

MOD = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % MOD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % MOD
    return x ^ (x >> 31)


def code(word):
    total, power = 0, 1
    for b in word:
        total = (total + int(_text.BYTE_CODE[b]) * power) % MOD
        power = power * _text.BASE % MOD
    return mixed((total + len(word) * int(_text.PLACE[63])) % MOD)


def binned(share):
    return 0 if share <= 0 else int(min(max(classifier.BINS - 1 + math.ceil(math.log2(max(share, 1e-9))), 1), classifier.BINS - 1))


def plain_features(text):
    data = (text or "").encode()
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)]
    out = {code(w) % classifier.BUCKETS for w in words} | {code(w[:5]) % classifier.BUCKETS for w in words if len(w) > 5}
    n, size = max(len(words), 1), max(len(data), 1)
    shares = [sum(c in b"#*$%&|<>!@^~{}[]=\\" for c in data) / size, sum(65 <= c <= 90 for c in data) / size, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(words)) / n, data.count(b"\n") / size]
    return out | {classifier.BUCKETS + k * classifier.BINS + binned(s) for k, s in enumerate(shares)}


def texts():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeÀéXY09") for _ in range(r.randint(1, 9)))
    out = [None, "", " \n ", "!!!", "same same same", "ABCDEF abcdef abcdeg", "line\nline\n\n", "x" * 5000]
    return out + [" ".join(r.choice([word(), "and", "#", "{}", "Some\n"]) for _ in range(r.randint(1, 120))) for _ in range(60)]


def test_features():
    parts = [(t or "").encode() for t in texts()]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    row, feature = classifier.features(np.frombuffer(b"".join(parts), np.uint8), offs)
    got = [set(feature[row == i].tolist()) for i in range(len(parts))]
    assert got == [plain_features(t) for t in texts()] and len(row) == sum(map(len, got))


def test_scores(spark):
    """Probabilities from sums of weights, a text at a time."""
    rng = np.random.default_rng(4)
    model = classifier.Ordinal(rng.normal(0, 0.4, classifier.N_FEATURES), np.array([-0.7, 0.9]))
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts())], "doc_id long, text string, note string").repartition(3)
    got = {r["doc_id"]: r for r in classifier.score(docs, model).collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        s = sum(float(np.float32(model.weights[f])) for f in plain_features(t))
        tails = [1 / (1 + math.exp(k - s)) for k in (-0.7, 0.9)]
        assert abs(got[i]["expected_grade"] - sum(tails)) < 1e-5 and abs(got[i]["tail_probability"] - tails[1]) < 1e-5
        assert got[i]["kept"] == (tails[1] >= 0.5) or abs(tails[1] - 0.5) < 1e-5
    stay = classifier.select_good(docs, model)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == {i for i, r in got.items() if r["kept"]}
