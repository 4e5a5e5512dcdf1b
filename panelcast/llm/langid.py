"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW``; in each window a forward and a backward
GRU of ``HIDDEN`` cells read every byte from a zero state, every position gets probabilities
of the languages from both states, and the text's are their mean over all its positions.

The network is trained on the driver by backpropagation through time with Adam, on windows
of a bounded sample: ``sample`` documents with a known language at most, those with the smallest
hashed ids, ``WINDOWS_EACH`` windows of each, spread over its whole text.  Batches draw the
languages evenly.

Matrices are (cells, windows), so that a gate's values are contiguous and one product serves
thousands of windows.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any
labelled document all texts are ``und``; rows are predicted each, repeated ids included; a null
id is never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .storage import held_out, read_table, small_batches

HIDDEN, WINDOW, TOGETHER = 8, 128, 512
SAMPLE, WINDOWS_EACH, TRAIN_WINDOW = 4000, 6, 48
UNKNOWN = "und"

Params = dict[str, np.ndarray]


def init(n_langs: int, hidden: int = HIDDEN, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for d in ("f", "b"):
        p[d + "x"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        p[d + "u"] = rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(np.float32)
        p[d + "c"] = np.zeros((hidden, 1), np.float32)
    p["v"] = rng.normal(0, 0.3, (n_langs, 2 * hidden)).astype(np.float32)
    p["o"] = np.zeros((n_langs, 1), np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states(p: Params, d: str, seen: np.ndarray, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States (positions, cells, windows) of direction ``d`` over bytes (positions, windows).

    ``mask`` is 0 where a window has ended already; ``keep`` gathers what backpropagation needs.
    """
    n, width = seen.shape
    x, u, bias = p[d + "x"], p[d + "u"], p[d + "c"]
    k = u.shape[1]
    out = np.empty((n, k, width), x.dtype)
    h = np.zeros((k, width), x.dtype)
    for t in range(n) if d == "f" else range(n - 1, -1, -1):
        g = x.take(seen[t], axis=1)
        a = u @ h
        g[:2 * k] += a[:2 * k]
        zr = sigmoid(g[:2 * k])
        z, r = zr[:k], zr[k:]
        cand = a[2 * k:]
        cand += bias
        c = g[2 * k:] + r * cand
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, z, r, c, cand, h))
        step = c - h
        step *= z
        h = h + step if mask is None else (h + step) * mask[t]
        out[t] = h
    return out


def backward(p: Params, d: str, seen: np.ndarray, keep: list, dout: np.ndarray, grads: Params) -> None:
    """Backpropagation through time: add the gradients of direction ``d`` for output gradients ``dout``."""
    u = p[d + "u"]
    k = u.shape[1]
    dh = np.zeros(dout.shape[1:], dout.dtype)
    dx = np.empty((3 * k, *seen.shape), dout.dtype)
    for t, z, r, c, cand, h in reversed(keep):
        dh = dh + dout[t]
        dc = dh * z * (1 - c * c)
        da = np.concatenate((dh * (c - h) * z * (1 - z), dc * cand * r * (1 - r), dc * r))
        dx[:2 * k, t], dx[2 * k:, t] = da[:2 * k], dc
        grads[d + "u"] += da @ h.T
        grads[d + "c"] += da[2 * k:].sum(1, keepdims=True)
        dh = dh * (1 - z) + u.T @ da
    flat = seen.ravel()
    for i in range(3 * k):
        grads[d + "x"][i] += np.bincount(flat, dx[i].ravel(), 256)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=0, keepdims=True))
    return x / x.sum(axis=0, keepdims=True)


def positions(p: Params, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Language probabilities (languages, positions * windows)."""
    both = np.concatenate((f, b), axis=1)
    n, k, width = both.shape
    logits = p["v"] @ both.transpose(1, 0, 2).reshape(k, n * width)
    logits += p["o"]
    return softmax(logits)


def loss_and_grads(p: Params, seen: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all positions of windows (positions, windows) with labels y, and its gradient."""
    n, width = seen.shape
    keeps: dict[str, list] = {"f": [], "b": []}
    f, b = (states(p, d, seen, keep=keeps[d]) for d in "fb")
    prob = positions(p, f, b)
    at = np.tile(y, n), np.arange(n * width)
    loss = float(-np.log(prob[at] + 1e-30).mean())
    prob[at] -= 1
    prob /= n * width
    both = np.concatenate((f, b), axis=1)
    k = f.shape[1]
    grads = {name: np.zeros_like(v) for name, v in p.items()}
    grads["v"] += prob @ both.transpose(1, 0, 2).reshape(2 * k, -1).T
    grads["o"] += prob.sum(1, keepdims=True)
    dboth = (p["v"].T @ prob).reshape(2 * k, n, width).transpose(1, 0, 2)
    backward(p, "f", seen, keeps["f"], dboth[:, :k], grads)
    backward(p, "b", seen, keeps["b"], dboth[:, k:], grads)
    return loss, grads


def fit(windows: np.ndarray, y: np.ndarray, n_langs: int, steps: int = 300, batch: int = 128, rate: float = 0.02,
        seed: int = 5) -> Params:
    """Train on windows (windows, positions) of bytes."""
    rng = np.random.default_rng(seed)
    p = init(n_langs)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    of = [np.flatnonzero(y == c) for c in range(n_langs)]
    for t in range(1, steps + 1):
        label = rng.integers(0, n_langs, batch)
        some = np.array([of[c][rng.integers(0, len(of[c]))] for c in label])
        _, grads = loss_and_grads(p, np.ascontiguousarray(windows[some].T), y[some])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * (1 - 0.9 * t / steps)
        for k, g in grads.items():
            g = g / max(1.0, size)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            p[k] = (p[k] - lr * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: Params, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean language probabilities of each text of a block (texts, languages); 0 for empty texts."""
    n_langs = len(p["o"])
    size = np.diff(bounds)
    total = np.zeros((len(size), n_langs))
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    start = bounds[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(WINDOW, bounds[1:][doc] - start)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), TOGETHER):
        w = order[at:at + TOGETHER]
        longest = int(length[w[0]])
        grid = start[w] + np.arange(longest)[:, None]
        live = np.arange(longest)[:, None] < length[w]
        whole = bool(live.all())
        seen = data[grid if whole else np.minimum(grid, len(data) - 1)]
        mask = None if whole else live.astype(np.float32)
        prob = positions(p, states(p, "f", seen), states(p, "b", seen, mask)).reshape(n_langs, longest, len(w))
        if not whole:
            prob *= mask
        sums = prob.sum(axis=1)
        for c in range(n_langs):
            total[:, c] += np.bincount(doc[w], sums[c], len(size))
    return total / np.maximum(size, 1)[:, None]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to (doc_id, lang, windows)."""
    for batch in batches:
        data, bounds = textscan.text_buffer(batch.column(2))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = int(b - a)
            starts = np.unique(np.linspace(0, n - TRAIN_WINDOW, WINDOWS_EACH).astype(int)) if n >= TRAIN_WINDOW else []
            out.append(b"".join(data[a + s:a + s + TRAIN_WINDOW].tobytes() for s in starts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                         names=["doc_id", "lang", "windows"])


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 300) -> tuple[list[str], Params | None]:
    """Languages and network, from ``sample`` documents at most; those held out are never read."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~held_out(F.col("doc_id")))
    some = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (docs.select("doc_id", "lang", "text").join(some, ["doc_id", "lang"], "left_semi")
            .where(F.col("text").isNotNull())
            .mapInArrow(_windows, f"doc_id {kind}, lang string, windows binary").orderBy("doc_id", "lang", "windows").collect())
    langs = sorted({r.lang for r in rows if r.windows})
    if not langs:
        return [], None
    grids = [np.frombuffer(r.windows, np.uint8).reshape(-1, TRAIN_WINDOW) for r in rows if r.windows]
    y = np.repeat([langs.index(r.lang) for r in rows if r.windows], [len(g) for g in grids])
    return langs, fit(np.concatenate(grids), y, len(langs), steps)


def _predict(langs: list[str], p: Params | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(1))
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for i, j in textscan.blocks(bounds, 1 << 19):
                best, score = np.full(j - i, len(langs)), np.zeros(j - i)
                if p is not None:
                    prob = pooled(p, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                    best = np.where(letters[i:j], prob.argmax(axis=1), len(langs))
                    score = np.where(letters[i:j], np.clip(prob.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, langs: list[str], p: Params | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_predict(langs, p), f"doc_id {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"])
    found = predict(docs, *train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
