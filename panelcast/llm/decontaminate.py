"""Benchmark decontamination by pigeonhole edit matching.

A test item's *units* are the ``window`` words (20) from each of its words and the ``short`` words (13, a
usual n-gram length) from each of its words; an item of ``window`` words or fewer is a unit as a whole.
A unit of m words may occur with ``k = floor(rate * m)`` word errors (one inserted, lost or changed word
each): 3 of 20, 1 of 13.  So every passage of an item that holds 13 words in a row verbatim or with one
error, or 20 with three, is found wherever it starts, and nothing shorter is, except whole
items.  A unit is split into k + 1 pieces; by the pigeonhole principle at least one of them occurs
exactly, so the first words of the pieces are looked up at every position of every text, and each
hit is verified by Myers' bit-parallel edit distance of the whole unit against the text around
it, in one 64-bit word a candidate.

Words are runs of letters and digits, with A-Z lower-cased.  Texts are read once for each block
of ``block`` units, whose anchors go to the tasks as a broadcast: its size has that bound,
however many test items there are.

Defined results: items without words match nothing; a null or empty text matches nothing;
repeated rows are matched each; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .storage import arrow_type, cut_lineage, read_table, small_batches

WINDOW, SHORT, RATE, ANCHOR = 20, 13, 0.15, 5
#: Units in a broadcast block, some 30 MB; first words of units in a part of a long item.
BLOCK, SPAN = 400_000, 1000
_FILTER = 1 << 20


def unit_starts(n: int, window: int = WINDOW, low: int = 0, span: int | None = None) -> range:
    """First words of the units of an item of ``n`` words, from ``low`` on."""
    stop = max(n - window, 0) + 1 if n else 0
    return range(low, stop if span is None else min(stop, low + span))


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of m words, as (start, end), of lengths that differ by one at most."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _parts(window: int, short: int):
    """(item_id, text) to (item_id, first word, the item's words, word hashes) of parts of ``SPAN`` units' first words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(1))
            for i, j in textscan.blocks(bounds):
                _, _, h, first = textscan.words(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i],
                                                textscan.NOT_ALNUM)
                size = np.diff(first)
                found = [(d, s) for d in range(j - i) for s in unit_starts(int(size[d]), min(window, short))[::SPAN]]
                at = [d for d, _ in found]
                lists = [h[first[d] + s:min(first[d] + s + SPAN + max(window, short) - 1, first[d + 1])].view(np.int64)
                         for d, s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i + d for d in at], pa.int64())),
                     pa.array([s for _, s in found], pa.int64()), pa.array(size[at], pa.int64()),
                     pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "start", "n", "words"])
    return run


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position (positions near the end have none)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    factor = textscan.POWERS.upto(n + 1)[0]
    out = h[:len(h) - n + 1] * factor[1]
    for k in range(1, n):
        out += h[k:len(h) - n + 1 + k] * factor[k + 1]
    return textscan.mix(out)


@dataclass
class Index:
    """Word hashes of the items; of each unit its place there, length, budget, item and number in the item; and,
    by anchor length, the sorted anchors' postings."""

    words: np.ndarray
    place: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    item: np.ndarray
    number: np.ndarray
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build_index(parts: list[tuple[int, int, np.ndarray]], window: int, short: int, rate: float, anchor: int) -> Index:
    """``parts``: first word, the item's words, word hashes."""
    words = np.concatenate([h for _, _, h in parts])
    made, at = [], 0
    for i, (low, n, h) in enumerate(parts):
        for kind, w in enumerate((window, short)):
            if kind == 0 or w < min(n, window):
                s = np.array(unit_starts(n, w, low, SPAN), np.int64)
                made.append(np.stack([at + s - low, np.full(len(s), min(w, n)), np.full(len(s), i), 2 * s + kind]))
        at += len(h)
    place, size, item, number = np.concatenate(made, axis=1)
    budget = np.floor(rate * size + 1e-9).astype(np.int64)
    posted: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for m in np.unique(size):
        unit = np.flatnonzero(size == m)
        for a, b in pieces(int(m), int(np.floor(rate * m + 1e-9))):
            n = min(anchor, b - a)
            posted.setdefault(n, []).append((rolling(words, n)[place[unit] + a], unit, np.full(len(unit), a)))
    anchors = {}
    for n, rows in posted.items():
        keys, unit, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((offset, unit, keys))
        keys = keys[order]
        quick = np.zeros(_FILTER, bool)
        quick[(keys & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        anchors[n] = (keys, unit[order].astype(np.int32), offset[order].astype(np.int16), quick)
    return Index(words, place, size.astype(np.int16), budget.astype(np.int16), item.astype(np.int32), number, anchors)


def myers(pattern: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to a part of its text, and where that part ends.

    Rows are candidates; ``m`` (64 at most) and ``n`` are the rows' true lengths.
    """
    one = np.uint64(1)
    bit = one << np.arange(pattern.shape[1], dtype=np.uint64)
    bit = np.where(np.arange(pattern.shape[1]) < m[:, None], bit, np.uint64(0))
    top = one << (m - 1).astype(np.uint64)
    pv, mv = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64)
    score = m.copy()
    best, at = m.copy(), np.zeros(len(m), np.int64)
    for j in range(text.shape[1]):
        eq = np.bitwise_or.reduce(np.where(pattern == text[:, j:j + 1], bit, np.uint64(0)), axis=1)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + ((ph & top) != 0) - ((mh & top) != 0)
        ph, mh = ph << one, mh << one  # a match may start anywhere in the text
        pv, mv = mh | ~(xv | ph), ph & xv
        better = (score < best) & (j < n)
        best, at = np.where(better, score, best), np.where(better, j + 1, at)
    return best, at


def match_block(index: Index, data: np.ndarray, bounds: np.ndarray, batch: int = 20_000):
    """Matches in a block of texts: document, unit, distance, word after the match (in the document)."""
    _, _, h, first = textscan.words(data, bounds, textscan.NOT_ALNUM)
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    found = []
    for n, (keys, unit, offset, quick) in index.anchors.items():
        r = rolling(h, n)
        if not len(r):
            continue
        pos = np.flatnonzero(quick[(r & np.uint64(_FILTER - 1)).astype(np.int64)])
        pos = pos[doc_of[pos] == doc_of[pos + n - 1]]
        lo, hi = np.searchsorted(keys, r[pos], "left"), np.searchsorted(keys, r[pos], "right")
        count = hi - lo
        p = np.repeat(pos, count)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(p)) if len(p) else p
        found.append(np.stack([doc_of[p], unit[at], p - offset[at] - first[doc_of[p]]], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    cand = np.unique(np.concatenate(found), axis=0)
    out = []
    for s in range(0, len(cand), batch):  # bounded memory whatever the number of hits
        d, u, a = cand[s:s + batch].T
        k, m = index.budget[u].astype(np.int64), index.size[u].astype(np.int64)
        left = np.maximum(a - k, 0)
        right = np.minimum(a + m + k, np.diff(first)[d])
        width = int((right - left).max())
        grid = np.minimum((first[d] + left)[:, None] + np.arange(width), len(h) - 1)
        unit = np.minimum(index.place[u][:, None] + np.arange(int(m.max())), len(index.words) - 1)
        best, end = myers(index.words[unit], m, h[grid], right - left)
        ok = best <= k
        out.append(np.stack([d[ok], u[ok], best[ok], (left + end)[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def index_blocks(benchmark: DataFrame, window: int = WINDOW, short: int = SHORT, rate: float = RATE,
                 anchor: int = ANCHOR, block: int = BLOCK) -> list[tuple[list, Index]]:
    """The test items' units as (item ids, index), some ``block`` units in each; a part of an item is in one."""
    small_batches(benchmark.sparkSession)
    kind = dict(benchmark.dtypes)["item_id"]
    items = cut_lineage(benchmark.select("item_id", "text").mapInArrow(
        _parts(window, short), f"item_id {kind}, start long, n long, words array<long>"), "units")
    n = 2 * (items.agg(F.sum(F.least(F.lit(SPAN), F.size("words")))).first()[0] or 0)
    parts = -(-n // block)
    out = []
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "start", "words"), F.lit(parts)) == p).orderBy("item_id", "start").collect()
        if rows:
            out.append(([r.item_id for r in rows],
                        build_index([(r.start, r.n, np.array(r.words, np.int64).view(np.uint64)) for r in rows],
                                    window, short, rate, anchor)))
    return out


def _matches(shared, kinds: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = shared.value
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(1))
            for i, j in textscan.blocks(bounds):
                rows = match_block(index, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[:, 0] + i)), pa.array([items[u] for u in index.item[rows[:, 1]]], kinds),
                         pa.array(index.number[rows[:, 1]]), pa.array(index.size[rows[:, 1]].astype(np.int64)),
                         pa.array(rows[:, 2]), pa.array(rows[:, 3])],
                        names=["doc_id", "item_id", "unit", "size", "distance", "end_word"])
    return run


def _without(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = shared.value
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(at))
            keep = np.ones(len(batch), bool)
            for i, j in textscan.blocks(bounds):
                keep[match_block(index, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])[:, 0] + i] = False
            yield batch.filter(pa.array(keep))
    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and test item that it holds a unit of: units found (n_units), the least
    distance of the longest of them, and the words after the first and the last match (first_end, last_end)."""
    spark = docs.sparkSession
    d, i = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    kind = arrow_type(benchmark, "item_id")
    schema = f"doc_id {d}, item_id {i}, unit long, size long, distance long, end_word long"
    parts = [docs.select("doc_id", "text").mapInArrow(_matches(spark.sparkContext.broadcast(b), kind), schema)
             for b in index_blocks(benchmark, **options)]
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        F.count_distinct("unit").alias("n_units"), F.min(F.struct(-F.col("size"), "distance"))["distance"].alias("distance"),
        F.min("end_word").alias("first_end"), F.max("end_word").alias("last_end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the rows that hold a unit of a test item."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for block in index_blocks(benchmark, **options):
        docs = docs.mapInArrow(_without(spark.sparkContext.broadcast(block), at), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a test item, with the item and how exactly."""
    return find_matches(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                        read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
