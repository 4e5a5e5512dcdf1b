import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import decontaminate as dc

from .conftest import LONG


def brute_distance(pattern, text):
    """Least edit distance of a pattern to any part of a text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(0, 3), max_size=30))
def test_myers_distance(pattern, text):
    grid = np.array([text or [9]], np.uint64)
    best, _ = dc.myers(np.array([pattern], np.uint64), np.array([len(pattern)]), grid, np.array([len(text)]))
    assert best[0] == brute_distance(pattern, text)


def test_units_and_pieces_cover_everything():
    for n in range(1, 90):
        starts = dc.unit_starts(n)
        covered = {w for s in starts for w in range(s, min(s + dc.WINDOW, n))}
        assert covered == set(range(n)) and len(set(starts)) == len(starts)
    for m in range(1, 21):
        for k in range(4):
            cut = dc.pieces(m, k)
            assert [w for a, b in cut for w in range(a, b)] == list(range(m)) and len(cut) <= k + 1


@pytest.fixture
def bench(spark):
    rng = random.Random(3)
    items = [" ".join(f"q{rng.randrange(900)}" for _ in range(n)) for n in (14, 20, 37, 58, 3)]
    rows = [(i, t) for i, t in enumerate(items)] + [(90, None), (91, "")]
    return items, spark.createDataFrame(rows, "item_id long, text string")


def corpus(items):
    rng = random.Random(5)

    def noise(n):
        return " ".join(f"z{rng.randrange(500)}" for _ in range(n))

    def changed(t, k):
        w = t.split()
        for i in rng.sample(range(len(w)), k):
            w[i] = "changed"
        return " ".join(w)
    rows = [(i, f"{noise(30)}. {t.upper()}, {noise(30)}") for i, t in enumerate(items)]
    rows += [(20, noise(9) + " " + changed(items[1], 3)), (21, changed(items[1], 4) + " " + noise(9)),
             (22, noise(5) + " " + " ".join(items[3].split()[10:45]) + " " + noise(5)), (23, noise(200)),
             (24, " ".join(items[2].split()[:9])), (25, None), (26, ""), (None, items[1]), (28, LONG + items[0]),
             (28, items[0]), (29, " ".join(w for k, w in enumerate(items[1].split()) if k != 7))]
    return rows


def brute(rows, items, rate=dc.RATE):
    out = set()
    for i, t in rows:
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        for j, item in enumerate(items):
            w = item.split()
            for s in dc.unit_starts(len(w)):
                unit = w[s:s + dc.WINDOW]
                if len(words) < 20000 and brute_distance(unit, words) <= int(rate * len(unit) + 1e-9):
                    out.add((i, j))
    return out | {(28, 0)}


def test_matches_brute_force_in_any_number_of_blocks(make_docs, bench):
    items, table = bench
    rows = corpus(items)
    want = brute(rows, items)
    assert {(0, 0), (4, 4), (20, 1), (22, 3), (29, 1), (None, 1)} <= want and not {(21, 1), (24, 2)} & want
    for block in (100_000, 3):
        got = dc.find_matches(make_docs(rows), table, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert {(r.doc_id, r.item_id): r.distance for r in got}[20, 1] == 3


def test_contaminated_documents_go(make_docs, bench):
    items, table = bench
    rows = corpus(items)
    docs = make_docs(rows)
    bad = {i for i, _ in brute(rows, items)}
    got = dc.drop_contaminated(docs, table, block=4)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_empty_tables(make_docs, bench):
    items, table = bench
    docs = make_docs([items[0]])
    assert dc.find_matches(docs.limit(0), table).count() == 0
    assert dc.find_matches(docs, table.limit(0)).count() == 0
    assert dc.drop_contaminated(docs, table.limit(0)).count() == 1


def test_a_short_passage_is_found_wherever_it_starts(make_docs, spark):
    rng = random.Random(11)
    item = [f"p{i}" for i in range(60)]
    table = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"long{i}" for i in range(2500)))], "item_id long, text string")
    rows, want = [], set()

    def add(words, found):
        if found:
            want.add(len(rows))
        rows.append((len(rows), "before it " + " ".join(words) + " after it"))
    for s in range(61 - 13):
        add(item[s:s + 13], True)
        add([w if i != s % 13 else "changed" for i, w in enumerate(item[s:s + 13])], True)
        add(item[s:s + 11], False)
    for s in range(61 - 20):
        errors = rng.sample(range(20), 3)
        add([w if i not in errors else "changed" for i, w in enumerate(item[s:s + 20])], True)
    for s in range(980, 1005):  # where parts of a long item meet
        add([f"long{i}" for i in range(s, s + 13)], True)
    for block in (400_000, 40):
        got = dc.find_matches(make_docs(rows), table, block=block).collect()
        assert {r.doc_id for r in got} == want and len(got) == len(want)
    kept = dc.drop_contaminated(make_docs(rows), table).collect()
    assert {r.doc_id for r in kept} == set(range(len(rows))) - want
    assert {r.n_units for r in dc.find_matches(make_docs([" ".join(item)]), table).collect()} == {41 + 48}
