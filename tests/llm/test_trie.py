"""Prefix trie of rebuilt conversations against a trie of plain texts."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, d long, conv string, pos int, x double"


def reference(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, reference(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            q = todo.pop()
            out.append(q)
            todo += kids[q]
        return out
    result = []
    for p, ms in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in ms if paths[c] == p)
        result.append((ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), len(kids[p]),
                       sum(not kids[q] for q in sub), sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q),
                       hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=str)


def make(spark, rows):
    return spark.createDataFrame([(*r, 5, "c", 3, 0.5) for r in rows], COLUMNS)


def conversations(seed, n=260):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(600), n) + [0, 100, -1, -205, -200]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            text = rng.choice(["hi", "ok", "", None, "Ümläut", f"own {rng.randrange(40)}"])
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), text))
    return rows + rows[::7]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_matches_brute_force(spark, tmp_dir, seed):
    rows = conversations(seed) + [(None, 0, "user", "nobody"), (None, None, None, None)]
    make(spark, rows).write.parquet(f"{tmp_dir}/conversations.parquet")
    got = sorted((tuple(r) for r in trie.op12_trie(spark, tmp_dir).collect()), key=str)
    assert got == brute(rows)


def test_one_conversation_with_a_third_of_the_turns(spark):
    """It lies over several pieces, which the monoid joins; the same for copies of one turn."""
    rng = random.Random(4)
    long = [(str(rng.randrange(3)), f"t{rng.randrange(9)}") for _ in range(300)]
    rows = [(100, i, *t) for i, t in enumerate(long)] + [(101, i, *t) for i, t in enumerate(long[:200])]
    rows += [(102, 0, "user", "again")] * 150 + [(7000 + c, t, "u", f"{c % 9}") for c in range(60) for t in range(2)]
    turns = make(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that pieces stay small
    try:
        check_long(trie, turns, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_long(trie, turns, rows):
    pieces = trie.prefixes(turns)
    place = {(r.conv, r.pos) for r in pieces.select("conv", "pos").collect()}
    assert {(100, i) for i in range(300)} <= place and {(102, i) for i in range(150)} <= place
    got = trie.prefix_trie(turns).drop("f", "g")
    got = got.select("conv_id", "d", *got.columns[2:])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, rebuild=False)


def test_fingerprints_compose():
    """The product of two sequences is that of their concatenation; a cut takes the front off again."""
    rng = np.random.default_rng(2)
    p, c = trie.FIELDS[0]
    word = [int(v) for v in rng.integers(0, p, 50)]

    def value(w):
        return sum(v * pow(c, j, p) for j, v in enumerate(w)) % p
    for i in (0, 7, 50):
        assert (value(word[:i]) + pow(c, i, p) * value(word[i:])) % p == value(word)
    assert (value(word) - value(word[:9])) * pow(pow(c, -1, p), 9, p) % p == value(word[9:])
    table = trie.powers(3000)
    assert [int(x) for x in table[:, 2999]] == [pow(b, 2999, q) for q, b in trie.FIELDS]


def test_shared_fingerprint_of_different_turns_raises(spark, monkeypatch):
    """With one tiny field everything collides; the turn references show it."""
    monkeypatch.setattr(trie, "paths", lambda *a: broken(real(*a)))
    rows = [(c, 0, "user", f"text {c}") for c in range(4)]
    with pytest.raises(Exception, match="share a fingerprint"):
        trie.prefix_trie(make(spark, rows)).collect()


real = trie.paths


def broken(path):
    return path.withColumn("f", F.lit(0).cast("long")).withColumn("g", F.lit(0).cast("long"))


def test_empty_table(spark):
    assert trie.prefix_trie(make(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0
