import random
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from panelcast.llm import decontaminate, textscan, toxicity

from .test_decontaminate import brute_distance
from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        w = words(rng.randint(20, 90))
        bad = rng.random() < 0.25
        if bad:
            w[5] = rng.choice(["vilest", "rotten"])
        lines = [" ".join(w[:10]), " ".join(w[10:])] + (["All rights kept"] if rng.random() < 0.3 else [])
        docs.append((i, "\n".join(lines), "en", rng.choice(["a", "b"])))
        labels.append((i, int(bad)))
    for i in range(20):
        docs.append((300 + i, docs[2 * i][1].replace(" w1", " v1", 1), "en", "a"))
        docs.append((400 + i, " ".join(words(12)) + " " + items[i % 5][1].upper() + ". " + " ".join(words(9)), "en", "b"))
    docs += [(500, None, None, None), (501, "", "en", "a"), (502, None, None, "a")]
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs], labels, items


def test_stages_match_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs]

    model = toxicity.train(table, spark.read.parquet(f"{d}/labels.parquet"))
    score = model.score(*textscan.text_buffer(pa.array([t for _, t in rows])))
    rows = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    toxic = {i for i, t in labels if t and zlib.crc32(str(i).encode()) % 4 != 2}
    assert 150 < len(rows) and len({i for i, _ in rows} & toxic) <= 2

    def same(df, want):
        assert df.columns == COLUMNS
        assert sorted((r.doc_id, r.text or "") for r in df.collect()) == sorted((i, t or "") for i, t in want)

    steps = dict(corpus_pipeline.STAGES)
    assert 4 <= len(steps) <= 5
    got = corpus_pipeline.cut_lineage(steps["toxicity"](spark, table, d), "t")
    same(got, rows)
    rows = [(i, "\n".join(k)) for (i, _), k in zip(rows, brute_lines(rows, 10))]
    got = corpus_pipeline.cut_lineage(steps["line_dedup"](spark, got, d), "t")
    same(got, rows)
    name = brute_components(rows, 80)
    rows = [r for r in rows if name[r[0]] == r[0]]
    got = corpus_pipeline.cut_lineage(steps["near_dedup"](spark, got, d), "t")
    same(got, rows)

    def leaks(t):
        w = t.lower().replace(".", " ").split()
        return any(brute_distance(u, w) <= int(decontaminate.RATE * len(u)) for _, q in items
                   for s in decontaminate.unit_starts(len(q.split())) for u in [q.split()[s:s + decontaminate.WINDOW]])
    rows = [r for r in rows if not leaks(r[1])]
    assert not any(400 <= i < 420 for i, _ in rows)
    got = corpus_pipeline.cut_lineage(steps["decontamination"](spark, got, d), "t")
    same(got, rows)
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}
    for i, _ in rows:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] == own[-1][2]
    assert np.sum([p.length for p in pieces]) > 0


def test_empty_documents(spark, tmp_path):
    docs, labels, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs[:5], "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
