import hashlib
from collections import Counter

from panelcast.llm import line_dedup

from .conftest import LONG

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_chars=1):
    def key(line):
        return line.strip(SPACE).translate(LOWER)
    texts = [t or "" for _, t in rows]
    seen = Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    hot = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    return [[x for x in t.split("\n") if key(x) not in hot] for t in texts]


ROWS = [
    (1, "Same line\nown 1\n  SAME LINE\t"), (2, "same line \nown 2\n\n"), (3, "\x0bsame line\f"), (None, "own\nsame LINE"),
    (5, None), (6, ""), (7, "Élan\nélan"), (8, "élan"), (9, "same line\nown 1"), (9, "same line\nown 1"),
    (10, "a \n a"), (11, LONG + "\nsame line"), (12, "x\n" * 500 + "same line"),
]


def test_matches_brute_force(spark, make_docs):
    docs = make_docs(ROWS)
    for min_docs in (2, 3):
        got = line_dedup.dedup_lines(docs, min_docs=min_docs, batches=3)
        assert got.columns == docs.columns
        want = sorted(("\n".join(k) for k in brute(ROWS, min_docs)))
        assert sorted(r.text or "" for r in got.collect()) == want


def test_null_text_stays_null_and_count_follows(make_docs):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs(ROWS), min_docs=2).collect()}
    assert got[5].text is None and got[6].text == ""
    assert got[1].text == "" and got[1].n_chars == 0  # own 1 stands in documents 1 and 9 too
    assert got[2].text == "own 2\n\n" and got[2].n_chars == 7


def test_empty_table(spark, make_docs):
    assert line_dedup.dedup_lines(make_docs(ROWS).limit(0)).count() == 0


def test_runs_compact_and_leave_settled_keys_out(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)

    def batch(*keys):
        return spark.createDataFrame([(bytes(k, "ascii"), n) for k, n in keys], "key binary, docs long")

    runs.add(batch(("a", 2), ("b", 1)))
    runs.add(batch(("a", 1), ("c", 1)))          # two runs of level 0 become one of level 1
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(batch(("a", 5), ("c", 1)))          # a is settled: it isn't added again
    assert {bytes(r.key): r.docs for r in runs.counts().collect()} == {b"a": 3, b"b": 1, b"c": 2}
    runs.add(batch(("c", 1),))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {bytes(r.key) for r in runs.settled().collect()} == {b"a", b"c"}


def test_query_digest(spark, tmp_path):
    rows = [(i, f"Footer\nbody {i}") for i in range(12)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == 13
    assert (got[3].n_lines, got[3].n_dropped) == (2, 1)
    assert got[3].kept_sha256 == hashlib.sha256(b"body 3").hexdigest()
    assert (got[99].n_lines, got[99].n_dropped, got[99].kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())
