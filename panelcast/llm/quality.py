"""Quality: multiple-instance learning with gated attention over passages.

A text is a bag of passages of ``PASSAGE`` words (words end at ASCII white space); only the text has a label.

* *Encoder.*  A word has three tokens: its own hash, the hash of its shape (runs of lower case, upper case, digits,
  other letters, and each punctuation mark), and whether it repeats the word before or the one before that.  A
  passage is h = tanh(mean of its tokens' learned vectors).
* *Attention.*  e = w . (tanh(V h) * sigmoid(U h)), softmax over the text's passages; the text is z = sum a h, its
  score sigmoid(c . z + b).  So one bad passage of a good page can decide, or be passed over, as the labels teach.
* *Training* on the driver by backpropagation with Adam, from ``sample`` labelled rows at most, those with the smallest
  hashed ids that aren't held out, each with its whole text.

Scoring reads every passage of every text in Arrow batches.

Defined results: a null, empty or blank text has no passages and scores as z = 0, which is the sigmoid of the bias; without
any labelled row all scores are 0.5; an id labelled twice counts as good only if both labels say so; a null label or id is
never learned from; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .storage import read_table, small_batches

PASSAGE, HASH_BITS, CELLS, GATES = 48, 13, 16, 16
SAMPLE, THRESHOLD = 6000, 0.3
#: The last two buckets: the word repeats one of the two before it, or doesn't.
BUCKETS = (1 << HASH_BITS) + 2
TOKENS = 3

Params = dict[str, np.ndarray]


def _shape_bytes() -> np.ndarray:
    """The byte that stands for each byte in a word's shape."""
    v = np.arange(256, dtype=np.uint8)
    v[0x61:0x7B], v[0x41:0x5B], v[0x30:0x3A], v[0x80:] = 0x61, 0x62, 0x30, 0x63
    return v


SHAPE = _shape_bytes()


def shapes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: its bytes by kind, a run of one kind once."""
    kind = SHAPE[data]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return textscan.words(kind[new], kept[bounds], textscan.SPACE)[2]


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of a block (words, ``TOKENS``), and the first word of each text (n + 1)."""
    if not len(data):
        return np.zeros((0, TOKENS), np.uint16), np.zeros(len(bounds), np.int64)
    _, _, words, first = textscan.words(data, bounds, textscan.SPACE)
    shift = np.uint64(65 - HASH_BITS)
    out = np.empty((len(words), TOKENS), np.uint16)
    out[:, 0] = words >> shift
    out[:, 1] = (shapes(data, bounds) >> shift) + np.uint64(1 << (HASH_BITS - 1))
    again = np.zeros(len(words), bool)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    for back in (1, 2):
        again[back:] |= (words[back:] == words[:-back]) & (place[back:] >= back)
    out[:, 2] = (1 << HASH_BITS) + again
    return out, first


def passages(first: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each passage, and the first passage of each text (n + 1)."""
    n_words = np.diff(first)
    count = -(-n_words // size)
    of = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n_words)), count)
    start = first[text] + size * (np.arange(of[-1]) - of[text])
    return start, np.minimum(size, first[text + 1] - start), of


def init(seed: int = 11) -> Params:
    rng = np.random.default_rng(seed)
    scale = CELLS ** -0.5
    return {"e": rng.normal(0, 0.1, (BUCKETS, CELLS)).astype(np.float32),
            "v": rng.normal(0, scale, (GATES, CELLS)).astype(np.float32),
            "u": rng.normal(0, scale, (GATES, CELLS)).astype(np.float32),
            "w": rng.normal(0, scale, GATES).astype(np.float32),
            "c": rng.normal(0, scale, CELLS).astype(np.float32), "b": np.zeros(1, np.float32)}


def encode(p: Params, token: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """h of each passage."""
    if not len(start):
        return np.zeros((0, CELLS), p["e"].dtype)
    words = p["e"][token[:, 0]]
    for k in range(1, TOKENS):
        words += p["e"][token[:, k]]
    return np.tanh(np.add.reduceat(words, start, axis=0) / (TOKENS * size[:, None]).astype(p["e"].dtype))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def attend(p: Params, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both gates of each passage, its weight in its text, and z of each text."""
    t, g = np.tanh(h @ p["v"].T), sigmoid(h @ p["u"].T)
    e = (t * g) @ p["w"]
    n, filled = len(of) - 1, np.flatnonzero(np.diff(of))
    z, a = np.zeros((n, CELLS), h.dtype), np.zeros(len(h), h.dtype)
    if len(filled):
        text = np.repeat(np.arange(n), np.diff(of))
        top, total = np.zeros(n, h.dtype), np.ones(n, h.dtype)
        top[filled] = np.maximum.reduceat(e, of[filled])
        a = np.exp(e - top[text])
        total[filled] = np.add.reduceat(a, of[filled])
        a = a / total[text]
        z[filled] = np.add.reduceat(a[:, None] * h, of[filled], axis=0)
    return t, g, a, z


def logits(p: Params, token: np.ndarray, first: np.ndarray) -> np.ndarray:
    start, size, of = passages(first)
    return attend(p, encode(p, token, start, size), of)[3] @ p["c"] + p["b"][0]


def loss_and_grads(p: Params, token: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of the texts' labels and its gradient."""
    start, size, of = passages(first)
    h = encode(p, token, start, size)
    t, g, a, z = attend(p, h, of)
    logit = z @ p["c"] + p["b"][0]
    loss = float((np.logaddexp(0, logit) - y * logit).mean())
    d = ((sigmoid(logit) - y) / len(y)).astype(h.dtype)
    grads = {"c": z.T @ d, "b": np.array([d.sum()])}
    text = np.repeat(np.arange(len(y)), np.diff(of))
    dz = (d[:, None] * p["c"])[text]
    da = (dz * h).sum(axis=1)
    mean = np.bincount(text, a * da, len(y)).astype(h.dtype)
    de = a * (da - mean[text])
    dtg = de[:, None] * p["w"]
    grads["w"] = (t * g).T @ de
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    grads["v"], grads["u"] = dt.T @ h, dg.T @ h
    dh = a[:, None] * dz + dt @ p["v"] + dg @ p["u"]
    dm = (dh * (1 - h * h) / (TOKENS * size[:, None])).astype(h.dtype)
    passage = np.repeat(np.arange(len(start)), size)
    bucket = token.T.ravel()
    grads["e"] = np.empty_like(p["e"])
    for k in range(CELLS):
        grads["e"][:, k] = np.bincount(bucket, np.tile(dm[passage, k], TOKENS), BUCKETS)
    return loss, grads


def fit(texts: list[np.ndarray], y: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.02,
        l2: float = 1e-5, seed: int = 5) -> Params:
    """Train on texts' token arrays with labels 0 and 1."""
    rng, p = np.random.default_rng(seed), init()
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    if not len(y):
        p["c"][:] = 0
        return p
    prior = (y.sum() + 0.5) / (len(y) + 1)
    p["b"][0] = np.log(prior / (1 - prior))
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(y)):
            order = np.concatenate((order, rng.permutation(len(y))))
        some, order = order[:batch], order[batch:]
        token = np.concatenate([texts[i] for i in some])
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in some])))
        _, grads = loss_and_grads(p, token, bounds, y[some])
        lr = rate * (1 - 0.9 * t / steps)
        for k, d in grads.items():
            d = d + (l2 * p[k] if k != "b" else 0)
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.001 * (d * d - second[k])
            p[k] = (p[k] - lr * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
                    ).astype(np.float32)
    return p


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to (y, tokens of the whole text)."""
    for batch in batches:
        data, bounds = textscan.text_buffer(batch.column(1))
        for i, j in textscan.blocks(bounds):
            token, first = tokens(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
            rows = [token[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())],
                                             names=["y", "tokens"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Params:
    """Fit on ``sample`` labelled rows at most; rows held out are never read."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    small_batches(docs.sparkSession)
    rows = (some.join(docs.select("doc_id", "text"), "doc_id").select("y", "text")
            .mapInArrow(_token_rows, "y int, tokens binary").toArrow())
    y, found = rows.column("y").to_numpy(), rows.column("tokens").to_pylist()
    # the order of the rows doesn't depend on how tasks were dealt
    order = sorted(range(len(y)), key=lambda i: (y[i], found[i]))
    return fit([np.frombuffer(found[i], np.uint16).reshape(-1, TOKENS) for i in order], y[order].astype(np.float32), steps)


def _scores(p: Params, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(1))
            for i, j in textscan.blocks(bounds):
                score = sigmoid(logits(p, *tokens(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, p: Params, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scores(p, threshold), f"doc_id {kind}, score double, predicted int")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document, learned from the labelled rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
