"""Document fingerprints: a randomised edit embedding, sampled.

*Embedding.*  All texts walk with the same random bits: at step j the walk writes the character
under it and moves on if the bit of (j, character) is set.  Two texts that differ by an edit
write different characters for a while and then fall into step again, so their edit distance becomes a Hamming
distance of the written strings, whose length is three times the text's.  Texts longer than
``SEGMENT`` code points are walked in segments, each from its own start, so that many walks
run side by side in numpy; a segment that starts a few characters off falls into step like
any other walk.

*Fingerprint.*  Every ``2**k``-th position of the written string, from a fixed offset, a digit of 1 to 15
for a character and 0 after the text's end; k is the least that leaves ``SAMPLES`` positions or fewer.  Samples are nested: a text's
samples at k + 1 are among those at k, so texts of different length are compared at the
coarser one.  Form: ``k:characters:hex digits``.

*Likeness.*  The share of equal samples where either text still goes on, corrected for chance: 0 to 1.

*Pairs* (:func:`near_pairs`).  Bands of sampled positions are buckets; each bucket's members are
verified against its smallest member by the likeness of whole fingerprints.

Defined results: a null text counts as empty; an empty text's fingerprint is ``0:0:``, which is
like itself (1) and like nothing else (0); the only document of a table is its own next one;
repeated ids follow each other by text; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan
from .storage import arrow_type, cut_lineage, read_table, scratch_path, small_batches

SEGMENT, SAMPLES, SEED = 4096, 512, 20240711
WALK = 3 * SEGMENT
#: Where sampling starts, modulo any step.
OFFSET = 0x2D1B3A7F59
#: Segments that walk side by side: some 20 MB of written characters.
TOGETHER = 1500


@cache
def steps() -> tuple[np.ndarray, np.ndarray]:
    """The walk's bits, by step and symbol (symbol 0, the end, never moves on); a digit of 1 to 15 for each byte."""
    rng = np.random.default_rng(SEED)
    bits = rng.integers(0, 2, (WALK, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits, rng.permutation(np.arange(256) % 15 + 1).astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    """A byte for each code point, 1 to 255; itself plus one below 250."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    other = (cp * np.uint32(2654435761)) >> np.uint32(8)
    return np.where(cp < 250, cp + 1, 1 + other % 255).astype(np.uint8)


def sampling(n: int) -> int:
    """Exponent of the step for a text of n code points."""
    return max(0, (-(-3 * n // SAMPLES) - 1).bit_length())


def sample_count(n: int, k: int) -> int:
    first = OFFSET % (1 << k)
    return max(0, -(-(3 * n - first) // (1 << k)))


def samples(segments: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Sampled hex digits (0 to 15) of segments: (symbols, number of the segment in its text, k)."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(segments)
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i][0]))
    for at in range(0, len(order), TOGETHER):
        part = [i for i in order[at:at + TOGETHER] if len(segments[i][0])]
        if not part:
            continue
        size = np.array([len(segments[i][0]) for i in part])
        flat = np.zeros(int(size.sum()) + len(part), np.uint8)
        place = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        for i, p in zip(part, place):
            flat[p:p + len(segments[i][0])] = segments[i][0]
        bits, digits = steps()
        place = place.astype(np.intp)
        written = np.zeros((3 * int(size[0]), len(part)), np.uint8)
        moves = np.empty(len(part), np.uint8)
        walking = np.searchsorted(-size, -np.arange(3 * int(size[0])) / 3, "left")  # rows with 3 * size > j
        for j in range(3 * int(size[0])):
            n = int(walking[j])
            c, m, p = written[j, :n], moves[:n], place[:n]
            flat.take(p, out=c, mode="clip")
            bits[j].take(c, out=m, mode="clip")
            p += m
        for row, i in enumerate(part):
            _, number, k = segments[i]
            step, base = 1 << k, number * WALK
            first = (OFFSET - base) % step
            j = np.arange(first, 3 * int(size[row]), step)
            salt = (((base + j) * 0x9E37) >> 4 & 255).astype(np.uint8)
            seen = written[j, row]
            out[i] = np.where(seen == 0, 0, digits[seen ^ salt]).astype(np.uint8)
    return out


class Print:
    """A text's fingerprint: k, length and digits."""

    __slots__ = ("k", "n", "digits")

    def __init__(self, k: int, n: int, digits: np.ndarray) -> None:
        self.k, self.n, self.digits = k, n, digits

    def __str__(self) -> str:
        return f"{self.k}:{self.n}:" + self.digits.tobytes().translate(_HEX).decode()

    @classmethod
    def read(cls, s: str) -> Print:
        k, n, digits = s.split(":")
        return cls(int(k), int(n), np.frombuffer(digits.encode().translate(_FROM_HEX), np.uint8))

    def at(self, k: int) -> np.ndarray:
        """The digits at a coarser step."""
        first = (OFFSET % (1 << k) - OFFSET % (1 << self.k)) >> self.k
        return self.digits[first::1 << (k - self.k)]


_HEX = bytes(b"0123456789abcdef"[i & 15] for i in range(256))
_FROM_HEX = bytes(int(chr(i), 16) if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def likeness(a: Print, b: Print) -> float:
    if not a.n or not b.n:
        return float(a.n == b.n)
    k = max(a.k, b.k)
    x, y = a.at(k), b.at(k)
    both = np.zeros((2, max(len(x), len(y))), np.uint8)
    both[0, :len(x)], both[1, :len(y)] = x, y
    there = both.any(axis=0)  # one of the texts still goes on
    if not there.any():
        return float(a.n == b.n)
    same = float((both[0] == both[1])[there].mean())
    return max(0.0, (same - 1 / 15) / (1 - 1 / 15))


def _segments(sym: np.ndarray, k: int, first: int = 0) -> list[tuple[np.ndarray, int, int]]:
    return [(sym[i * SEGMENT:(i + 1) * SEGMENT], i, k) for i in range(first, -(-len(sym) // SEGMENT))]


def prints(texts: list[str]) -> list[Print]:
    """Fingerprints of texts."""
    return [p for p, _ in _prints_and_parts(texts)]


def _prints_and_parts(texts: list[str]) -> list[tuple[Print, list[np.ndarray]]]:
    todo, spans = [], []
    for t in texts:
        s = _segments(symbols(t), sampling(len(t)))
        spans.append((len(todo), len(todo) + len(s)))
        todo += s
    done = samples(todo)
    out = []
    for t, (a, b) in zip(texts, spans):
        parts = done[a:b]
        out.append((Print(sampling(len(t)), len(t), np.concatenate(parts) if parts else np.zeros(0, np.uint8)), parts))
    return out


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many of the next text's first code points."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def edited_prints(texts: list[str], others: list[str], parts: list[list[np.ndarray]]) -> list[Print]:
    """Fingerprints of edited texts; segments before the edit are taken from the text's own."""
    todo, plans = [], []
    for t, o, own in zip(texts, others, parts):
        k, first = sampling(len(o)), 0
        if k == sampling(len(t)):
            first = min((len(t) - len(t) // 4) // SEGMENT, len(own))
        s = _segments(symbols(o), k, first)
        plans.append((own[:first], len(todo), len(todo) + len(s), k, len(o)))
        todo += s
    done = samples(todo)
    return [Print(k, n, np.concatenate([*own, *done[a:b]]) if n else np.zeros(0, np.uint8))
            for own, a, b, k, n in plans]


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(rows: list[tuple[str, Print, list]], following: list[tuple[str, Print]]) -> list[list]:
    """Columns of the result for texts and the texts after them."""
    others = [edited(t, f) for (t, _, _), (f, _) in zip(rows, following)]
    made = edited_prints([t for t, _, _ in rows], others, [p for _, _, p in rows])
    return [[len(t) for t, _, _ in rows],
            [hashlib.sha256(o.encode("utf-8", "surrogatepass")).hexdigest() for o in others],
            [str(p) for _, p, _ in rows], [str(p) for p in made],
            [likeness(p, m) for (_, p, _), m in zip(rows, made)],
            [likeness(p, f) for (_, p, _), (_, f) in zip(rows, following)]]


def _neighbours(kind: pa.DataType):
    """Sorted rows (doc_id, text, part) to results; a part's first text and its last, which has no next yet, as such."""
    names = ["role", "part", "doc_id", "text", *_COLUMNS]
    types = [pa.string(), pa.int64(), kind, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.float64(), pa.float64()]

    def whole(rows: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows.get(c, [None] * n), t) for c, t in zip(names, types)],
                                          names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part = None, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not ids:
                continue
            docs = [(i, t, p, parts) for i, t, (p, parts) in zip(ids, texts, _prints_and_parts(texts))]
            if waiting is None:
                part = batch.column(2)[0].as_py()
                yield whole({"role": ["first"], "part": [part], "doc_id": [ids[0]], "text": [texts[0]],
                             "fingerprint": [str(docs[0][2])]}, 1)
            else:
                docs.insert(0, waiting)
            waiting = docs[-1]
            if len(docs) > 1:
                cols = _compare([d[1:] for d in docs[:-1]], [d[1:3] for d in docs[1:]])
                n = len(docs) - 1
                yield whole({"role": ["done"] * n, "doc_id": [d[0] for d in docs[:-1]]} | dict(zip(_COLUMNS, cols)), n)
        if waiting is not None:
            yield whole({"role": ["last"], "part": [part], "doc_id": [waiting[0]], "text": [waiting[1]]}, 1)
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, next text, next fingerprint) to results."""
    for batch in batches:
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = [(t, p, parts) for t, (p, parts) in zip(texts, _prints_and_parts(texts))]
        nexts = [(f, Print.read(s)) for f, s in zip(following, batch.column(3).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _compare(rows, nexts))],
                                             names=["doc_id", *_COLUMNS])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, with their likeness and the next text's.

    The table is dealt by ranges of doc_id (ties by text hash, so one id may fill many parts) and
    sorted, so nearly every document meets the next one in its own task; of each part only the
    first and the last text travel on.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=1000, mb=8)
    kind = dict(docs.dtypes)["doc_id"]
    arrow = arrow_type(docs, "doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text").alias("_tie")
    dealt = (docs.select("doc_id", "text", tie).repartitionByRange(parts, "doc_id", "_tie")
             .sortWithinPartitions("doc_id", "_tie", "text")
             .select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")))
    schema = (f"n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    path = scratch_path(spark, "neighbours")
    (dealt.mapInArrow(_neighbours(arrow), f"role string, part long, doc_id {kind}, text string, " + schema)
     .write.option("compression", "zstd").parquet(path))  # hex digits: half the size
    made = spark.read.parquet(path)
    firsts = made.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                                 F.col("fingerprint").alias("next_print"))
    # the part after each part, by number; after the last one comes the first
    numbers = made.where("role = 'first'").select("part")
    follows = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                                F.min("part").over(Window.partitionBy())).alias("next_part"))
    rest = (made.where("role = 'last'").select("part", "doc_id", "text").join(follows, "part")
            .join(firsts, "next_part").select("doc_id", "text", "next_text", "next_print")
            .mapInArrow(_finish, f"doc_id {kind}, " + schema))
    return made.where("role = 'done'").select("doc_id", *_COLUMNS).unionByName(rest)


def _bands(n_bands: int, width: int):
    """(id, text) to (id, fingerprint, bucket keys): each band is ``width`` samples at the text's step and the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED + 1)
        picks = rng.integers(0, SAMPLES, (n_bands, width))
        for batch in batches:
            found = prints([t or "" for t in batch.column(1).to_pylist()])
            keys = []
            for p in found:
                own = []
                for k in (p.k, p.k + 1) if p.n else ():
                    digits = np.append(p.at(k), np.full(SAMPLES, 16, np.uint8))[:SAMPLES]
                    for b in range(n_bands):
                        # positions count from the start, so texts of one step pick the same ones
                        some = digits[picks[b] % (SAMPLES // 2 if k == p.k else SAMPLES // 4)]
                        h = hashlib.blake2b(bytes([k, b & 255]) + some.tobytes(), digest_size=8).digest()
                        own.append(int.from_bytes(h, "little", signed=True))
                keys.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(p) for p in found]), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "fingerprint", "buckets"])
    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([Print.read(s) for s in batch.column(k).to_pylist()] for k in (2, 3))
            like = np.array([likeness(a, b) for a, b in zip(x, y)], float)
            keep = pa.array(np.flatnonzero(like >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep),
                                              pa.array(like).take(keep)], names=["a", "b", "likeness"])
    return run


def near_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
               bands: int = 24, width: int = 8) -> DataFrame:
    """(a, b, likeness): documents and the smallest member of a bucket that they share, if they are alike."""
    small_batches(docs.sparkSession, rows=1000, mb=8)
    kind = dict(docs.dtypes)[id_col]
    table = cut_lineage(docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(
        _bands(bands, width), f"id {kind}, fingerprint string, buckets array<long>"), "prints")
    entries = table.select("id", F.explode("buckets").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("a"))
    pairs = entries.join(hubs, "bucket").where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")).distinct()
    x, y = (table.select(F.col("id").alias(c), F.col("fingerprint").alias(f"p_{c}")) for c in ("a", "b"))
    return (pairs.join(x, "a").join(y, "b").select("a", "b", "p_a", "p_b")
            .mapInArrow(_verify(threshold), f"a {kind}, b {kind}, likeness double"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    return compare_neighbours(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
