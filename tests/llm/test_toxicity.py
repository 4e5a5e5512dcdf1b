import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import textscan, toxicity

from .conftest import LONG


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=600):
    rng = random.Random(2)
    rows, y = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilest", "Rotten!", "grubby" + rng.choice("abcdef")])
        rows.append((i, " ".join(w)))
        y.append(int(bad))
    return rows, y


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    rows, y = corpus()
    labels = spark.createDataFrame([(i, t) for (i, _), t in zip(rows, y)] + [(None, 1), (3, None), (10**6, 1)],
                                   "doc_id long, toxic int")
    docs = make_docs(rows)
    return rows, y, docs, labels, toxicity.train(docs, labels)


def test_held_out_rows_are_told_apart(trained):
    rows, y, docs, _, model = trained
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [(got[i].predicted, t) for (i, _), t in zip(rows, y) if is_held_out(i)]
    assert len(test) > 100 and sum(p == t for p, t in test) / len(test) > 0.97


def test_held_out_labels_are_never_read(spark, trained):
    rows, y, docs, labels, model = trained
    from pyspark.sql import functions as F
    from panelcast.llm.storage import held_out
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, turned)
    assert other.bias == model.bias and (other.w == model.w).all() and (other.v == model.v).all()


def test_odd_texts_and_stage(make_docs, trained):
    model = trained[4]
    rows = [(1, None), (2, ""), (3, "vilest"), (3, "vilest"), (None, "so VILEST"), (4, LONG), (5, LONG + " vilest"), (6, "漢字 ééé")]
    docs = make_docs(rows)
    got = toxicity.score(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].score == by[2].score == by[6].score < 0.3 and by[4].predicted == 0
    assert by[3].predicted == by[None].predicted == by[5].predicted == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]


def test_pair_weights_and_brute_force_logit():
    rng = np.random.default_rng(0)
    m = toxicity.Model(np.zeros(0, np.int32), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    present = [[0, 2, 4], [1], [], [0, 1, 2, 3, 4]]
    doc = np.repeat(np.arange(4), [len(x) for x in present])
    z = m.logits(doc, np.concatenate([np.array(x, int) for x in present]), 4)
    for got, x in zip(z, present):
        want = 0.3 + sum(m.w[i] for i in x) + sum(m.v[i] @ m.v[j] for k, i in enumerate(x) for j in x[:k])
        assert abs(got - want) < 1e-9


def test_an_interaction_is_learned():
    # each word alone is clean, both together are toxic: no sum of word weights can say so
    texts = ["aaaa bbbb", "aaaa", "bbbb", "cccc"] * 200
    y = np.array([1, 0, 0, 0] * 200)
    data, bounds = textscan.text_buffer(pa.array(texts))
    doc, bucket = toxicity.terms(data, bounds)
    rows = [np.unique(bucket[doc == d]) for d in range(len(texts))]
    model = toxicity.fit(rows, y, epochs=600)
    s = model.score(data, bounds)[:4]
    assert s[0] > 0.5 > max(s[1:])


def test_a_pair_of_ordinary_words_is_caught_beside_strong_ones():
    """Constants as shipped: each word of the pair is in a third of the clean texts, both only in toxic ones."""
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(600)]
    texts, y, kind = [], [], []
    for i in range(6000):
        words, what = [rng.choice(filler) for _ in range(rng.randint(10, 120))], "clean"
        if i % 20 == 0:
            what, words = "pair", words + ["alpha", "bravo"]
        elif i % 20 == 1:
            what, words = "strong", words + ["vilest"]
        elif rng.random() < 0.7:
            words.append(rng.choice(["alpha", "bravo"]))
        rng.shuffle(words)
        texts.append(" ".join(words))
        kind.append(what)
        y.append(int(what != "clean") if rng.random() > 0.01 else 1)
    y, kind = np.array(y), np.array(kind)
    data, bounds = textscan.text_buffer(pa.array(texts))
    doc, bucket = toxicity.terms(data, bounds)
    at = np.searchsorted(doc[np.argsort(doc, kind="stable")], np.arange(len(texts) + 1))
    bucket = bucket[np.argsort(doc, kind="stable")]
    rows = [np.unique(bucket[a:b]) for a, b in zip(at[:-1], at[1:])]
    model = toxicity.fit(rows[:4000], y[:4000])
    assert len(model.w) < 40
    score = model.score(data, bounds)[4000:]
    caught = {k: (score[kind[4000:] == k] >= toxicity.THRESHOLD).mean() for k in ("pair", "strong", "clean")}
    assert caught["pair"] >= 0.95 and caught["strong"] >= 0.95 and caught["clean"] <= 0.01, caught


def test_no_pair_is_found_by_chance():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 400, rng.integers(5, 150))) for _ in range(3000)]
    y = (rng.random(3000) < 0.1).astype(int)
    assert len(toxicity.pair_terms(rows, y, np.zeros(0, int))) == 0
    assert len(toxicity.pair_terms(rows[:1], y[:1], np.zeros(0, int))) == 0


def test_no_labels_and_empty_table(spark, make_docs, trained):
    docs = make_docs(["a", "vilest"])
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), trained[4]).count() == 0
