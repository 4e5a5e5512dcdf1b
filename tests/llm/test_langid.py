import random

import numpy as np
import pytest

from panelcast.llm import langid

from .conftest import LONG

SYLLABLES = {"aa": ["ka", "ko", "mi"], "bb": ["shr", "eth", "öl"], "cc": ["漢", "字", "テ"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(make_docs):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    rows = [text(x, rng.randint(10, 80), rng) for x in langs]
    langs[5] = None
    return rows, langs, langid.train(make_docs(rows, langs), sample=250, steps=120)


def test_gradient_is_that_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 4).items()}
    rng = np.random.default_rng(0)
    seen, y = rng.integers(0, 5, (6, 7)), rng.integers(0, 3, 7)
    _, g = langid.loss_and_grads(p, seen, y)
    for k in p:
        for _ in range(4):
            at = tuple(int(rng.integers(0, min(n, 5))) for n in p[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (langid.loss_and_grads(up, seen, y)[0] - langid.loss_and_grads(down, seen, y)[0]) / 2e-5
            assert abs(slope - g[k][at]) < 1e-6


def test_languages_are_told_apart(make_docs, trained):
    _, _, (langs, p) = trained
    assert langs == sorted(SYLLABLES)
    rng = random.Random(8)
    want = [rng.choice(langs) for _ in range(60)]
    got = langid.predict(make_docs([text(x, 30, rng) for x in want]), langs, p).orderBy("doc_id").collect()
    assert np.mean([r.lang_pred == x for r, x in zip(got, want)]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_pooling_reads_every_byte(trained):
    _, _, (langs, p) = trained
    rng = random.Random(3)
    texts = [text("aa", 200, rng).encode(), b"", b"x", text("bb", 300, rng).encode()]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.pooled(p, data, bounds)
    for t, row in zip(texts, got):
        total = np.zeros(len(langs))
        for s in range(0, len(t), langid.WINDOW):
            seen = np.frombuffer(t[s:s + langid.WINDOW], np.uint8)[:, None]
            total += langid.positions(p, langid.states(p, "f", seen), langid.states(p, "b", seen)).sum(1)
        assert np.allclose(row, total / max(len(t), 1), atol=1e-5)


def test_odd_texts(make_docs, trained):
    _, _, (langs, p) = trained
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, LONG), (None, "kakomi mi ko"), (5, "é"), (5, "é")]
    got = langid.predict(make_docs(rows), langs, p).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert by[None].lang_pred == "aa" and by[4].lang_pred in langs and by[5].lang_pred in langs
    assert langid.predict(make_docs(["a"]).limit(0), langs, p).count() == 0


def test_without_known_languages(make_docs):
    docs = make_docs(["ka ko", "mi"], [None, None])
    langs, p = langid.train(docs)
    assert langs == [] and {r.lang_pred for r in langid.predict(docs, langs, p).collect()} == {"und"}


def test_every_registered_twin_is_sql():
    from panelcast.llm.queries import ORACLE, QUERIES
    assert "op9_language_id" in QUERIES and "op9_language_id" not in ORACLE
    assert all(isinstance(twin, str) for twin in ORACLE.values())
