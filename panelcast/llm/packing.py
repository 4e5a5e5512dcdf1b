"""Mixture-controlled packing: deficit round-robin over source queues.

1. Every text is tokenized once; its ids (with the end id) are written, two bytes an id.
2. Documents are dealt into *packs* of about ``pack_tokens`` tokens by a hash, so a source that
   holds most rows spreads over all packs.  A pack's plan needs lengths only.
3. Within a pack each source is a queue.  With every window of ``size`` tokens a source is
   owed its target share more (its *deficit*); in turn, sources that are owed ``grain`` tokens or more put that
   many into the window, cutting documents freely.  What is left of a window goes to the
   sources that are owed most.  Deficits carry over from window to window; what a source is
   owed when a pack starts is known from the token counts of the packs before, so packs carry
   deficits on without waiting for each other.
4. A pack's last tokens, fewer than a window, fill sequences of powers of two, which need no padding.
5. Plans join the ids, and pieces are cut out of them.

The default target is each source's own share of all tokens, so that all queues last to the end.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own;
rows with equal ids are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut_lineage, read_table, scratch_path, small_batches

TOKENIZER, END, SIZE, GRAIN, PACK_TOKENS = "word_bpe_49k.json", 1, 2048, 256, 1 << 22


def _tokenize(name: str, end: int):
    """(row, doc_id, source, text) to (row, doc_id, source, n, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(name)
        last, width = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            ids = [enc.encode(t) + last if t else last for t in batch.column(3).to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n), pa.array(ids, pa.binary())],
                names=["row", "doc_id", "source", "n", "ids"])
    return run


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """row, doc_id, source, n (tokens with the end id) and ids of each document, written."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(docs.dtypes)
    table = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
             .mapInArrow(_tokenize(tokenizer, end),
                         f"row long, doc_id {kinds['doc_id']}, source {kinds['source']}, n long, ids binary"))
    path = scratch_path(spark, "tokens")
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fill(queue: np.ndarray, length: np.ndarray, share: np.ndarray, owed: np.ndarray, size: int, grain: int):
    """Deficit round-robin over one pack.

    ``queue``: the queue of each document, in the order in which it waits; ``share`` and
    ``owed``: of each queue.  Yields (document, start, length, window, offset); windows are full
    but for the last one.
    """
    order = [np.flatnonzero(queue == q).tolist() for q in range(len(share))]
    head, start = [0] * len(order), [0] * len(order)
    left = np.bincount(queue, length, len(share)).astype(np.int64)
    owed = owed.astype(float).copy()
    window, turn = 0, 0
    while left.any():
        owed += share * size
        space = size
        while space and left.any():
            ready = np.flatnonzero((left > 0) & (owed >= np.minimum(grain, left)))
            if len(ready):
                ready = np.roll(ready, -int(np.searchsorted(ready, turn)))
            else:  # nobody is owed enough: the window is filled by who is owed most
                ready = np.array([int(np.argmax(np.where(left > 0, owed, -np.inf)))])
            for q in ready.tolist():
                give = int(min(space, left[q], max(owed[q], grain)))
                turn = q + 1
                owed[q] -= give
                left[q] -= give
                while give:
                    d = order[q][head[q]]
                    n = min(give, int(length[d]) - start[q])
                    yield d, start[q], n, window, size - space
                    start[q] += n
                    if start[q] == length[d]:
                        head[q] += 1
                        start[q] = 0
                    give -= n
                    space -= n
                if not space:
                    break
        window += 1


def halve(pieces: list[tuple[int, int, int, int, int]], total: int, size: int):
    """The last window's pieces, cut so that its ``total`` tokens fill sequences of powers of two."""
    ends, at = [], 0
    while total:
        part = 1 << (total.bit_length() - 1)
        at, total = at + part, total - part
        ends.append(at)
    for d, s, n, w, o in pieces:
        for i, e in enumerate(ends):
            low = ends[i - 1] if i else 0
            a, b = max(o, low), min(o + n, e)
            if a < b:
                yield d, s + a - o, b - a, w + i, a - low


def _plan(size: int, grain: int):
    """A pack's documents (row, source, n, share, owed) to the pieces of each."""
    def run(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["order", "row"], kind="stable").reset_index(drop=True)
        queue, names = pd.factorize(pack["source"], use_na_sentinel=False, sort=True)
        per = pack.groupby(queue)[["share", "owed"]].first()
        length = pack["n"].to_numpy()
        total = int(length.sum())
        full, rest = total // size, total % size
        made: list[list[tuple]] = [[] for _ in range(len(pack))]
        tail = []
        for piece in fill(queue, length, per["share"].to_numpy(float), per["owed"].to_numpy(float), size, grain):
            if piece[3] < full:
                made[piece[0]].append(piece[1:])
            else:
                tail.append(piece)
        for d, *piece in halve(tail, rest, size):
            made[d].append(tuple(piece))
        base = int(pack["pack"].iloc[0]) << 32
        return pd.DataFrame({
            "row": pack["row"],
            "starts": [[p[0] for p in m] for m in made], "lengths": [[p[1] for p in m] for m in made],
            "sequences": [[base + p[2] for p in m] for m in made], "offsets": [[p[3] for p in m] for m in made]})
    return run


def plan(tokens: DataFrame, *, size: int = SIZE, grain: int = GRAIN, pack_tokens: int = PACK_TOKENS,
         weights: dict[str, float] | None = None) -> DataFrame:
    """row, starts, lengths, sequences and offsets of each document's pieces."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-total // pack_tokens))
    order = F.xxhash64("row")
    docs = tokens.select("row", "source", "n", order.alias("order"), F.pmod(order, F.lit(packs)).alias("pack"))
    per = cut_lineage(docs.groupBy("pack", "source").agg(F.sum("n").alias("t")), "pack-sources")
    if weights is None:
        shares = per.groupBy("source").agg((F.sum("t") / F.lit(total)).alias("share"))
    else:
        whole = sum(weights.values())
        known = [F.when(F.col("source").eqNullSafe(F.lit(k)), v / whole) for k, v in weights.items()]
        shares = per.select("source").distinct().select("source", F.coalesce(*known, F.lit(0.0)).alias("share"))
    # before a pack: what a source should have had of all earlier tokens, less what it had
    every = (per.groupBy("pack").agg(F.sum("t").alias("all"))
             .withColumn("before", F.sum("all").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))))
    had = F.sum("t").over(Window.partitionBy("source").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))
    s, p = shares.withColumnRenamed("source", "s_source"), every.select(F.col("pack").alias("e_pack"), "before")
    state = (per.withColumn("had", F.coalesce(had, F.lit(0)))
             .join(s, F.col("source").eqNullSafe(F.col("s_source"))).join(p, F.col("pack") == F.col("e_pack"))
             .select("pack", "source", "share",
                     (F.col("share") * F.coalesce("before", F.lit(0)) - F.col("had")).alias("owed")))
    state = cut_lineage(state, "pack-state").withColumnsRenamed({"pack": "p_pack", "source": "p_source"})
    ready = (docs.join(state, (F.col("pack") == F.col("p_pack")) & F.col("source").eqNullSafe(F.col("p_source")))
             .select("pack", "row", "order", "source", "n", "share", "owed"))
    return ready.groupBy("pack").applyInPandas(
        _plan(size, grain),
        "row long, starts array<long>, lengths array<long>, sequences array<long>, offsets array<long>")


def _cut(width: int):
    """(doc_id, n, ids, starts, lengths, sequences, offsets) to pieces with their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(f"<u{width}")
        for batch in batches:
            of, crc, cols = [], [], [[], [], [], []]
            lists = [batch.column(k).to_pylist() for k in range(3, 7)]
            for i, ids in enumerate(batch.column(2)):
                wide = np.frombuffer(ids.as_buffer(), dtype).astype("<u4").data
                for s, n, q, o in zip(*(x[i] for x in lists), strict=True):
                    of.append(i)
                    crc.append(zlib.crc32(wide[s:s + n]))
                    for c, v in zip(cols, (s, n, q, o)):
                        c.append(v)
            of = pa.array(of, pa.int64())
            starts, lengths, sequences, offsets = (pa.array(c, pa.int64()) for c in cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), starts, lengths, pa.array(crc, pa.int64()), batch.column(1).take(of),
                 sequences, offsets],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, end: int = END, **options) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer, end)
    pieces = cut_lineage(plan(tokens, **options), "pieces")
    joined = tokens.join(pieces, "row").select("doc_id", "n", "ids", "starts", "lengths", "sequences", "offsets")
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(_cut(2), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                             "sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, at the sources' own proportions."""
    return pack(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
