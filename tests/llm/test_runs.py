"""Periodic runs against brute force."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import pytest

from panelcast.llm import runs

from .conftest import LONG


def brute(words, min_words, least):
    """Every maximal stretch of a period, without those that lie in one of a smaller period."""
    out = []
    for q in range(1, len(words) // least + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, least * q):
                if not any(s <= i and j + q <= s + n for s, n, _ in out):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, t):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(1, 60)
    if t % 3:
        s = [rng.randrange(k) for _ in range(n)]
    else:
        p = [rng.randrange(k) for _ in range(rng.randrange(1, 8))]
        s = [rng.randrange(k) for _ in range(rng.randrange(5))] + (p * 20)[:n] + [rng.randrange(k) for _ in range(4)]
    return [b"w%d" % x for x in s]


@pytest.mark.parametrize("min_words, least", [(6, 4), (2, 2), (4, 3)])
def test_runs_match_brute_force(min_words, least):
    rng = random.Random(least)
    for t in range(1500):
        words = some_words(rng, t)
        assert runs.find_runs(words, min_words, least) == brute(words, min_words, least)


def test_lyndon_lengths_and_groups():
    def longest(s, i):
        return max(n for n in range(1, len(s) - i + 1) if all(s[i:i + n] < s[i + k:i + n] for k in range(1, n)))
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        length, group = runs.lyndon_groups(s, 3)
        assert length == [longest(s, i) for i in range(len(s))]
        roots = [tuple(s[i:i + n]) for i, n in enumerate(length)]
        assert len(set(zip(roots, group))) == len(set(roots)) == len(set(group))


def test_cutting_at_rare_words_loses_no_run():
    rng = random.Random(9)
    for _ in range(200):
        words = []
        for _ in range(6):
            p = [rng.randrange(4) + 10 * rng.randrange(3) for _ in range(rng.randrange(1, 4))]
            words += p * rng.randrange(1, 7) + [rng.randrange(50) for _ in range(rng.randrange(6))]
        words = [b"%d" % x for x in words]
        assert runs.find_runs(words) == brute(words, 6, 4)


def test_long_texts_and_deep_repetitions():
    for words in ([b"a"] * 100_000, [b"a", b"b", b"a"] * 30_000, [b"%d" % (i // 2) for i in range(100_000)]):
        found = runs.find_runs(words)
        period = len(set(words)) + (len(words) == 90_000)
        assert found == ([(0, len(words), period)] if period < 9 else [])


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 6, 4)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def key(row):
    return tuple(str(x) for x in row)


def test_query_matches_brute_force(spark, make_docs, tmp_dir):
    rng = random.Random(5)
    texts = [" ".join(w.decode() for w in some_words(rng, t)) for t in range(300)]
    texts += [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x\ty\nx y\x0bx\x0cy x\ry", "é é é é é é ü",
              "Aa aA " * 4, LONG[:3000] + " end", texts[0], texts[0]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "b c " * 9), (None, None), (-7, "b c " * 9)]
    make_docs(rows).write.parquet(f"{tmp_dir}/documents.parquet")
    got = [tuple(r) for r in runs.op11_runs(spark, tmp_dir).collect()]
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sum(r[1] for r in got) > 100 and any(crc32(str(r[0]).encode()) % 10 == 0 for r in got if r[1])


def test_operator_returns_runs_and_text(make_docs):
    docs = make_docs([(1, "so so so so so so it  goes"), (2, None), (3, "one two three")])
    got = {r.id: r for r in runs.word_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 6, 1)] and tuple(got[1].strongest) == (0, 6, 1)
    assert got[1].collapsed == "so it goes" and got[1].n_words == 8
    assert got[2].runs == [] and got[2].strongest is None and got[2].collapsed == "" and got[2].n_words == 0
    assert got[3].collapsed == "one two three"
    assert runs.word_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.word_runs(docs, min_exponent=1)
