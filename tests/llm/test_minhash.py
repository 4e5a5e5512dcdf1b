import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import graph, minhash, textscan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    """Component of each id: the smallest id that links reach."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    name = {i: i for i, _ in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    return {i: find(i) for i in name}


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(30, 200))] for _ in range(40)]
    for w in base:
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append(" ".join(v))
    chain = [rng.choice(vocabulary) for _ in range(120)]  # a drifting group: ends aren't alike, neighbours are
    for k in range(60):
        chain[(7 * k) % 120] = rng.choice(vocabulary)
        rows.append(" ".join(chain))
    rows += [None, "", "  \n", "three words here", "Three  WORDS\there", "one", rows[0].upper(), rows[0], "long word " * 3000]
    rng.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)] + [(None, rows[3])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ漢 \n\t\x0b.", max_size=40), min_size=1, max_size=6))
def test_words_and_shingles(texts):
    data, bounds = textscan.text_buffer(pa.array(texts))
    _, _, hashes, first = textscan.words(data, bounds, textscan.SPACE)
    sh, sb = textscan.shingles(hashes, first)
    sets = [shingle_set(t) for t in texts]
    assert [len(np.unique(sh[sb[i]:sb[i + 1]])) for i in range(len(texts))] == [len(s) for s in sets]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert len(np.intersect1d(sh[sb[i]:sb[i + 1]], sh[sb[j]:sb[j + 1]])) == len(s & t)


def test_components_match_brute_force(make_docs):
    rows = corpus()
    want = brute(rows, 85)
    got = minhash.near_components(make_docs(rows), percent=85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component == (None if r.id is None else want[r.id])
    sizes = {i: len(shingle_set(t)) for i, t in rows}
    assert {r.id: r.n_shingles for r in got} == sizes


def test_crowded_buckets_match_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "FIRST_BANDS", 1)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):  # about half of the pairs of copies lie on either side of the threshold
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    want = brute(rows, 85)
    assert 1 < len(set(want.values())) < 100
    assert {r.id: r.component for r in minhash.near_components(make_docs(rows), percent=85).collect()} == want


def test_repeated_rows_change_nothing(make_docs, monkeypatch):
    """Each row five times, in buckets that are crowded and in those that aren't."""
    rows = corpus()[:90] * 5
    want = brute(rows, 85)
    assert {r.id: r.component for r in minhash.near_components(make_docs(rows), percent=85).collect()
            if r.id is not None} == want
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "FIRST_BANDS", 1)
    rng = random.Random(9)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(150)], []
    for i in range(60):
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    want = brute(rows, 85)
    got = minhash.near_components(make_docs(rows * 6), percent=85).collect()
    assert len(got) == 360 and {r.id: r.component for r in got} == want


def test_one_id_with_two_texts(make_docs, monkeypatch):
    """Its links are those of either text."""
    monkeypatch.setattr(minhash, "SMALL", 0)
    monkeypatch.setattr(minhash, "FIRST_BANDS", 0)
    rng = random.Random(2)
    a, b = ([f"{c}{rng.randrange(300)}" for _ in range(120)] for c in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join(a[:118])), (7, " ".join(b[2:])), (8, "on its own in here now")]
    got = {(r.id, r.component) for r in minhash.near_components(make_docs(rows), percent=85).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 8)}


def test_one_of_each_group_stays(make_docs):
    rows = corpus() + [(7, "alone and repeated by rows of one id"), (7, "alone and repeated by rows of one id")]
    docs = make_docs(rows)
    got = minhash.drop_near_copies(docs, percent=80)
    assert got.columns == docs.columns
    want = brute(rows, 80)
    kept = sorted(str(i) for i in want if want[i] == i) + ["None"]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(kept)


def test_estimate_is_collision_corrected(spark):
    rng = np.random.default_rng(1)
    a = minhash.factors(160)
    x = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    y = np.concatenate((x[:900], rng.integers(0, 1 << 62, 100, dtype=np.uint64)))  # similarity 900 / 1100
    low = minhash.minima(np.concatenate((x, y)), np.array([0, 1000, 2000]), a)
    kept = textscan.mix(low.astype(np.uint64)) & np.uint64(15)
    sig = minhash.pack(kept, 4).tolist()
    df = spark.createDataFrame([(sig[0], sig[1])], "x array<long>, y array<long>")
    from pyspark.sql import functions as F
    unequal = df.select(minhash.unequal_bits(F.col("x"), F.col("y"), 10, 4)).first()[0]
    assert unequal == int((kept[:, 0] != kept[:, 1]).sum())
    match = 1 - unequal / 160
    assert abs((match - 1 / 16) / (1 - 1 / 16) - 9 / 11) < 0.12


def test_empty_table(make_docs):
    empty = make_docs(["a"]).limit(0)
    assert minhash.near_components(empty).count() == 0
    assert minhash.drop_near_copies(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (3, 2)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_parity_never_exceeds_the_difference(s, t):
    x, y = (minhash.parity(np.array(sorted(v), np.uint64)) for v in (s, t))
    assert sum(bin(int(v)).count("1") for v in (x ^ y).view(np.uint64)) <= len(s ^ t)


def test_prefix_join_keeps_every_link_of_a_group_about_the_threshold(spark):
    """One base text with up to four edits a copy: pairs lie on both sides of 0.8; all links come out, few others."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        v = list(base)
        for k in rng.sample(range(150), rng.randint(1, 4)):
            v[k] = f"own{i}x{k}"
        rows.append((i, " ".join(v)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = {(a, b) for a in sets for b in range(a + 1, 120)
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in minhash.rare_pairs(docs.selectExpr("id", "id AS component"), docs, 80).collect()}
    assert links and links <= got and len(got) < 1.2 * len(links) < 120 * 119 / 2
