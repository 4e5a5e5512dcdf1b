"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (A-Z lower-cased) and their first four and first five bytes,
hashed into ``2**HASH_BITS`` buckets; a bucket is present or not, so a text's length and
repetitions don't matter.  Two kinds of buckets enter the model: those whose presence alone speaks for a toxic
text in the training sample (log-odds of ``MIN_ODDS`` and a ``z`` of ``MIN_Z`` or more), and those of pairs that do
so together, however ordinary each is (:func:`pair_terms`).  The others mostly tell a text's length and language,
which should not excuse an insult:

    logit = w0 + sum_i w_i + sum_{i<j} <v_i, v_j>     over the present buckets i, j,

so a pair, such as an insult with a group mention, has a weight of its own.  It is trained on
the driver with Adam on a bounded sample of labelled rows: ``sample`` rows at most, those with
the smallest hashed ids.  Every text is scored whole, in Arrow batches.

Defined results: a null or empty text, and one without known terms, gets the score of the bias;
without any labelled row all scores are 0; an id labelled twice counts as toxic if either label
says so; a null label or id is never learned from; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .storage import held_out, read_table, small_batches

HASH_BITS, FACTORS, MIN_Z, MIN_ODDS = 22, 8, 3.5, 2.0
#: Evidence (nats, beyond the logarithm of the number of pairs looked at) that a pair must give.
PAIR_EVIDENCE = 10.0
THRESHOLD = 0.3


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of a block of texts; repetitions included."""
    start, end, hashes, first = textscan.words(data, bounds, textscan.NOT_ALNUM)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    shift = np.uint64(64 - HASH_BITS)
    docs, buckets = [doc], [(hashes >> shift).astype(np.int32)]
    for n in (4, 5):
        long = np.flatnonzero(end - start > n)
        values = np.zeros(len(long), np.uint64)
        for k in range(n):
            values = textscan.mix(values + textscan.BYTE_VALUE[data[start[long] + k]])
        docs.append(doc[long])
        buckets.append((textscan.mix(values + np.uint64(n)) >> shift).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets)


@dataclass
class Model:
    """bucket -> column (or -1), bias, weights and factors."""

    columns: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """For distinct (document, column) pairs."""
        out = self.bias + np.bincount(doc, self.w[column], n)
        for f in range(self.v.shape[1]):
            x = self.v[column, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        doc, bucket = terms(data, bounds)
        column = self.columns[bucket]
        known = column >= 0
        pair = np.unique(doc[known].astype(np.int64) * len(self.w) + column[known]) if len(self.w) else np.zeros(0, int)
        if not len(pair):
            z = np.full(n, self.bias)
        else:
            z = self.logits(pair // len(self.w), pair % len(self.w), n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def select_terms(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose presence speaks for label 1, alone (strongest first) or in pairs."""
    size = 1 << HASH_BITS
    a, b = (np.bincount(np.concatenate([x for x, t in zip(buckets, y) if t == k] or [np.zeros(0, np.int32)]),
                        minlength=size).astype(float) for k in (1, 0))
    seen = np.flatnonzero(a + b >= 3)
    a, b = a[seen] + 0.5, b[seen] + 0.5
    c, d = (y == 1).sum() + 1 - a, (y == 0).sum() + 1 - b
    odds = np.log(a / c) - np.log(b / d)
    z = odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    strong = np.flatnonzero((z >= MIN_Z) & (odds >= MIN_ODDS))
    alone = seen[strong[np.argsort(-z[strong], kind="stable")]]
    return np.concatenate((alone, pair_terms(buckets, y, alone)))


def _presence(rows: list[np.ndarray], columns: np.ndarray, n: int) -> np.ndarray:
    """Rows by the ``n`` buckets that ``columns`` numbers (-1: none), 1 where present."""
    out = np.zeros((len(rows), n), np.float32)
    for i, x in enumerate(rows):
        at = columns[x]
        out[i, at[at >= 0]] = 1
    return out


def pair_terms(buckets: list[np.ndarray], y: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Buckets of pairs whose co-occurrence speaks for label 1 in the rows that hold none of ``alone``.

    A pair in n such rows, a of them toxic, is compared with the more toxic of its two members, whose rate is q:
    n * KL(a / n, q) must reach ``PAIR_EVIDENCE`` plus the logarithm of the number of pairs.  Every pair that could reach
    it is looked at: the toxic rows are counted first, and then the clean rows for the members of those left.
    """
    strong = np.zeros(1 << HASH_BITS, bool)
    strong[alone] = True
    rest = [i for i, x in enumerate(buckets) if not strong[x].any()]
    toxic, clean = ([buckets[i] for i in rest if y[i] == t] for t in (1, 0))
    none = np.zeros(0, np.int64)
    if not toxic or not clean:
        return none
    size = 1 << HASH_BITS
    in_toxic, in_clean = (np.bincount(np.concatenate(rows), minlength=size) for rows in (toxic, clean))
    base = max(len(toxic) / len(rest), 1e-6)
    terms = np.flatnonzero(in_toxic * -np.log(base) >= PAIR_EVIDENCE)
    need = PAIR_EVIDENCE + np.log(max(1, len(terms) * (len(terms) - 1) / 2))
    terms = terms[in_toxic[terms] * -np.log(base) >= need]  # n = a at best
    if len(terms) < 2:
        return none
    rate = in_toxic[terms] / (in_toxic[terms] + in_clean[terms])
    columns = np.full(size, -1, np.int32)
    columns[terms] = np.arange(len(terms))
    x = _presence(toxic, columns, len(terms))
    found = np.zeros(len(terms), bool)
    step = 512  # terms at a time, so that memory grows with the number of terms and not with its square
    for lo in range(0, len(terms), step):
        both = x[:, lo:lo + step].T @ x
        q = np.maximum(rate[lo:lo + step, None], rate[None, :])
        hope = both * -np.log(np.maximum(q, 1e-9)) >= need
        hope &= np.arange(len(terms))[None, :] > np.arange(lo, lo + len(both))[:, None]
        rows, cols = np.flatnonzero(hope.any(axis=1)), np.flatnonzero(hope.any(axis=0))
        if not len(rows):
            continue
        count = np.zeros((len(rows), len(cols)))
        for at in range(0, len(clean), 2048):
            part = _presence(clean[at:at + 2048], columns, len(terms))
            count += part[:, lo + rows].T @ part[:, cols]
        a = both[np.ix_(rows, cols)]
        n, q = a + count, q[np.ix_(rows, cols)]
        share = np.clip(a / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        evidence = n * (share * np.log(share / q) + (1 - share) * np.log((1 - share) / np.maximum(1 - q, 1e-12)))
        good = (evidence >= need) & (share > q) & hope[np.ix_(rows, cols)]
        found[lo + rows[good.any(axis=1)]] = True
        found[cols[good.any(axis=0)]] = True
    return terms[found]


def fit(buckets: list[np.ndarray], y: np.ndarray, epochs: int = 300, rate: float = 0.05, l2: float = 1e-6,
        seed: int = 7) -> Model:
    """Train on rows of distinct buckets with labels 0 and 1."""
    columns = np.full(1 << HASH_BITS, -1, np.int32)
    if not len(y):
        return Model(columns, -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = select_terms(buckets, y)
    columns[chosen] = np.arange(len(chosen))
    rows = [columns[x][columns[x] >= 0] for x in buckets]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(len(chosen)),
              rng.normal(0, 0.05, (len(chosen), FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n, m = len(y), len(chosen)
    for t in range(1, epochs + 1):
        bias, w, v = params
        z = Model(columns, bias[0], w, v).logits(doc, col, n) if m else np.full(n, bias[0])
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grads = [np.array([g.sum()]), np.bincount(col, g[doc], m) + l2 * w, np.empty_like(v)]
        for f in range(FACTORS):
            x = v[col, f]
            rest = np.bincount(doc, x, n)[doc] - x
            grads[2][:, f] = np.bincount(col, g[doc] * rest, m) + l2 * v[:, f]
        for p, d, s, q in zip(params, grads, first, second):
            s += 0.1 * (d - s)
            q += 0.001 * (d * d - q)
            p -= rate * (s / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-9)
    return Model(columns, float(params[0][0]), params[1], params[2])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to (y, distinct buckets)."""
    for batch in batches:
        data, bounds = textscan.text_buffer(batch.column(1))
        for i, j in textscan.blocks(bounds):
            doc, bucket = terms(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
            pair = np.unique(doc.astype(np.int64) << 32 | bucket)
            at = np.searchsorted(pair, np.arange(j - i + 1, dtype=np.int64) << 32)
            low = (pair & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(low))],
                names=["y", "buckets"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 12000) -> Model:
    """Fit on ``sample`` labelled rows at most; rows held out are never read."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = some.join(docs.select("doc_id", "text"), "doc_id").select("y", "text")
    small_batches(docs.sparkSession)
    rows = texts.mapInArrow(_term_rows, "y int, buckets array<int>").toArrow()
    y = rows.column("y").to_numpy().astype(np.int64)
    lists = rows.column("buckets").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray | pa.LargeListArray) else pa.concat_arrays(lists.chunks)
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.lexsort((np.diff(offsets), y))  # the sum's order doesn't depend on how tasks were dealt
    buckets = [values[offsets[i]:offsets[i + 1]] for i in range(len(y))]
    order = sorted(order, key=lambda i: (y[i], buckets[i].tobytes()))
    return fit([buckets[i] for i in order], y[order])


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column("text"))
            for i, j in textscan.blocks(bounds):
                score = model.score(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])
    return run


def _clean(model: Model, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(at))
            keep = [model.score(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]) < threshold
                    for i, j in textscan.blocks(bounds)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _scores(model, threshold), f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_clean(model, threshold, docs.columns.index("text")), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document, learned from the labelled rows that aren't held out."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
