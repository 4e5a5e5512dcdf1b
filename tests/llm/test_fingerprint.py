import hashlib
import random

import numpy as np

from panelcast.llm import fingerprint as fp

from .conftest import LONG


def slow_print(text):
    """The definition, one step at a time."""
    bits, digits = fp.steps()
    sym, k, written = fp.symbols(text), fp.sampling(len(text)), []
    for s in range(0, len(text), fp.SEGMENT):
        part = [*sym[s:s + fp.SEGMENT].tolist(), 0]
        i = 0
        for j in range(3 * (len(part) - 1)):
            written.append(part[i])
            i += int(bits[j, part[i]])
    first, base = fp.OFFSET % (1 << k), 0
    out = []
    for p in range(first, len(written), 1 << k):
        salt = ((p * 0x9E37) >> 4) & 255
        out.append(0 if written[p] == 0 else int(digits[written[p] ^ salt]))
    return f"{k}:{len(text)}:" + "".join("%x" % x for x in out)


def texts():
    rng = random.Random(1)
    out = ["", "a", "ab", "é漢🎉", "x" * 5000, "abc " * 3000]
    for n in (20, 170, 171, 400, 4096, 4097, 9000, 20000):
        out.append("".join(rng.choice("abcdefghij élm\n漢") for _ in range(n)))
    return out


def test_side_by_side_walks_are_the_definition():
    assert [str(p) for p in fp.prints(texts())] == [slow_print(t) for t in texts()]
    for t, p in zip(texts(), fp.prints(texts())):
        assert len(p.digits) == fp.sample_count(len(t), p.k) <= fp.SAMPLES
        assert fp.likeness(p, fp.Print.read(str(p))) == 1.0
        coarse = [p.digits[i] for i in range(len(p.digits)) if (fp.OFFSET % (1 << p.k) + (i << p.k) - fp.OFFSET % (2 << p.k)) % (2 << p.k) == 0]
        assert p.at(p.k + 1).tolist() == coarse


def test_few_edits_leave_texts_alike():
    rng = random.Random(5)
    alike, apart = [], []
    for _ in range(60):
        t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(800, 9000)))
        u = list(t)
        for _ in range(3):
            u[rng.randrange(len(u))] = "z"
        del u[rng.randrange(len(u))]
        a, b, c = fp.prints([t, "".join(u), "".join(rng.sample(t, len(t)))])
        alike.append(fp.likeness(a, b))
        apart.append(fp.likeness(a, c))
    assert np.median(alike) > 0.9 and max(apart) < 0.3


ROWS = [(5, "five " * 100), (1, "one " * 30), (None, "null id"), (3, None), (4, ""), (2, "two " * 3000), (2, "second two"),
        (2, "second two"), (7, LONG[:150000]), (6, "é漢" * 900)]


def test_neighbours_match_brute_force(spark, make_docs):
    got = fp.compare_neighbours(make_docs(ROWS)).collect()
    from pyspark.sql import functions as F
    order = [(r.doc_id, r.text or "") for r in make_docs(ROWS).orderBy("doc_id", F.xxhash64("text"), "text").collect()]
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = fp.edited(t, nxt)
        a, b, c = fp.prints([t, e, nxt])
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), str(a), str(b),
                     round(fp.likeness(a, b), 9), round(fp.likeness(a, c), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                   round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_single_document_and_empty_table(make_docs):
    r = fp.compare_neighbours(make_docs(["only one text here"])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"only one text only").hexdigest()
    assert fp.compare_neighbours(make_docs(["a"]).limit(0)).count() == 0


def test_near_pairs(make_docs):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:1500] + "zz" + t[1501:]) for i, t in enumerate(base)] + [(30, None), (31, "")]
    found = fp.near_pairs(make_docs(rows), threshold=0.7).collect()
    assert {(r.a, r.b) for r in found} <= {(i, 10 + i) for i in range(6)} and len(found) >= 4
    assert fp.near_pairs(make_docs(rows).limit(0)).count() == 0
