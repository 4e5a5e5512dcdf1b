"""Attention over passages: gradients, a plain score, what attention is for, held-out accuracy."""

import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import quality, textscan

from .conftest import LONG

SF = "/root/testdata/sf0.1"


def tokens(texts):
    return quality.tokens(*textscan.text_buffer(pa.array(texts, pa.string())))


def test_gradients(monkeypatch):
    monkeypatch.setattr(quality, "PASSAGE", 5)
    rng = np.random.default_rng(3)
    p = {k: rng.normal(0, 0.7, v.shape) for k, v in quality.init().items()}
    token, first = tokens(["one two three four five six seven eight", "", "a b c d e f a a b b !! ??", "x " * 11])
    y = np.array([1.0, 0, 0, 1])
    _, grads = quality.loss_and_grads(p, token, first, y)
    for name, value in p.items():
        spots = [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]
        if name == "e":
            spots = [(int(token[i, k]), 3) for i, k in ((0, 0), (3, 1), (12, 2), (20, 0))]
        for at in spots:
            old, ends = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                ends.append(quality.loss_and_grads(p, token, first, y)[0])
            value[at] = old
            assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)


def plain_score(p, text):
    """The same score, one passage and one gate at a time."""
    token = tokens([text])[0]
    hs = []
    for a in range(0, len(token), quality.PASSAGE):
        part = token[a:a + quality.PASSAGE]
        mean = sum(p["e"][int(b)].astype(float) for row in part for b in row) / (3 * len(part))
        hs.append(np.tanh(mean))
    es = [sum(float(w) * math.tanh(v @ h) / (1 + math.exp(-(u @ h))) for w, v, u in zip(p["w"], p["v"], p["u"])) for h in hs]
    total = sum(math.exp(e) for e in es)
    z = sum((math.exp(e) / total * h for e, h in zip(es, hs)), np.zeros(quality.CELLS))
    return 1 / (1 + math.exp(-(z @ p["c"] + p["b"][0])))


def test_scores_match_a_plain_computation(make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["A1!", "THE", "é", "--"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 7, 48, 49, 130, 400]))) for _ in range(40)]
    texts += [None, "", " \n ", "x", LONG, texts[0], texts[0]]
    p = quality.init(8)
    p["e"] *= 12
    rows = list(enumerate(texts)) + [(None, "no id")]
    got = quality.score(make_docs(rows), p).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        if text != LONG:
            assert r.score == pytest.approx(plain_score(p, text or ""), abs=1e-5)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_tokens():
    token, first = tokens(["Abc dEF abc abc 12-3", "", None, "ABC xyz", "Xyz Q"])
    assert first.tolist() == [0, 5, 5, 5, 7, 9]
    same = [[int(a == b) for b in token[:, 1]] for a in token[:, 1]]
    shape = [re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "B", re.sub("[a-z]", "a", w))))
             for w in "Abc dEF abc abc 12-3 ABC xyz Xyz Q".split()]
    assert same == [[int(a == b) for b in shape] for a in shape]
    assert (token[:, 2] - (1 << quality.HASH_BITS)).tolist() == [0, 0, 1, 1, 0, 0, 0, 0, 0]


def test_one_passage_decides():
    """Labels tell whether any passage holds the word; attention finds it among twenty passages."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(200)]

    def text(bad):
        ws = [rng.choice(words) for _ in range(quality.PASSAGE * 20)]
        if bad:
            at = rng.randrange(20) * quality.PASSAGE
            ws[at:at + 24] = ["spam"] * 24
        return " ".join(ws)
    y = np.array([i % 2 for i in range(600)], np.float32)
    token, first = tokens([text(not v) for v in y])
    each = [token[a:b] for a, b in zip(first[:-1], first[1:])]
    p = quality.fit(each[:400], y[:400], steps=250)
    rest = quality.sigmoid(quality.logits(p, np.concatenate(each[400:]), first[400:] - first[400]))
    assert ((rest >= 0.5) == (y[400:] == 1)).mean() > 0.97
    start, size, of = quality.passages(first[400:] - first[400])
    a = quality.attend(p, quality.encode(p, np.concatenate(each[400:]), start, size), of)[2]
    spam = tokens(["spam"])[0][0, 0]
    holds = np.array([(np.concatenate(each[400:])[s:s + n, 0] == spam).any() for s, n in zip(start, size)])
    assert a[holds].mean() > 3 * a[~holds].mean()


def test_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    p = quality.train(docs, none)
    assert [r.score for r in quality.score(docs, p).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), p).count() == 0


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op13_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[i].held_out == (crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    good, bad = [p for p, q in held if q == 1], [p for p, q in held if q == 0]
    assert len(bad) > 80 and np.mean(good) > 0.99 and np.mean(bad) < 0.06
