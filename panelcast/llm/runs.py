"""Periodic runs of words: Baier grouping, Lyndon roots, longest common extensions.

A *run* is a stretch of consecutive words with smallest period q that no neighbouring word
extends keeping that period.  Every run holds a Lyndon root: a word sequence of length q that is, under
one of two opposite orders of the words, the longest Lyndon sequence starting at its place.

1. *Grouping* (:func:`lyndon_groups`): the first phase of Baier's suffix sorter, run once under each order.
   Suffixes start in groups by first word.  From the highest group down, each member points to the
   nearest place before it whose group is lower; the places pointed at move, by the number of their
   pointers, to new groups right above their old ones, and their contexts grow by the group's.  A place's
   last context is its longest Lyndon sequence, so the Lyndon array comes out directly, and two places share a
   group only if those sequences are equal.
2. *Roots*: places i, i + q, i + 2 q, ... of one group whose context has length q are copies of a root.
3. *Extension* (:func:`extension`): from the first and the last copy the run grows left and right by the longest
   common extension of the text with itself q words on, found by doubling comparisons, exactly.

A run of exponent e holds each of its words floor(e) times.  So, before the grouping, a text is cut at words that
occur less often in it, and the parts again, until nothing changes; no run is lost, and text without
repetition costs a count of its words.

Defined results: a null, empty or blank text has no words and no runs; repeated rows are scanned each; an id may
be null; a text is read whole, whatever its length, by one task; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import read_table, small_batches

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Rounds of cutting at rare words; the cuts only save work, so ending them changes no result.
ROUNDS = 24

Run = tuple[int, int, int]
Batches = Iterator[pa.RecordBatch]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_groups(s: list[int], letters: int) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon sequence at each place of ``s`` (letters 0 .. ``letters`` - 1), and its group."""
    n = len(s)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, c in enumerate(s):
        members[c].append(i)
    group, context = list(s), [1] * letters
    lower, upper = list(range(-1, letters - 1)), list(range(1, letters + 1))
    done, before = bytearray(n), [-1] * n
    g = letters - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            done[i] = 1
        pointers: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointers.items():
                parts.setdefault((-times, group[j]), []).append(j)
            for times, old in sorted(parts):
                new, moved = len(members), parts[times, old]
                members.append(moved)
                context.append(context[old] - times * context[g])
                above = upper[old]
                lower.append(old)
                upper.append(above)
                lower[above] = upper[old] = new
                for j in moved:
                    group[j] = new
        g = lower[g]
    return [context[x] for x in group], group


def extension(a: np.ndarray, i: int, j: int) -> int:
    """How many words agree from places i < j on."""
    total, step, n = 0, 32, len(a)
    while j + total < n:
        x, y = a[i + total:i + total + step], a[j + total:j + total + step]
        same = x[:len(y)] == y
        if not same.all():
            return total + int(same.argmin())
        total += len(y)
        step *= 2
    return total


def runs_of(ids: np.ndarray, least: int) -> set[Run]:
    """(start, length, period) of all runs of exponent ``least`` (2 or more) or more, of letters 0, 1, ..."""
    letters, back, found = int(ids.max()) + 1, ids[::-1], set()
    for order in (ids, letters - 1 - ids):
        length, group = lyndon_groups(order.tolist(), letters)
        reach: dict[int, int] = {}  # per period: the end of the last run found
        for i, q in enumerate(length):
            if i + (least - 1) * q > len(ids) or i + q <= reach.get(q, 0):
                continue
            copies, at, g = 1, i + q, group[i]
            while at < len(ids) and group[at] == g:
                copies, at = copies + 1, at + q
            if copies < least - 1:
                continue
            end = at + extension(ids, at - q, at)
            start = i - extension(back, len(ids) - i - q, len(ids) - i)
            reach[q] = end
            if end - start >= least * q:
                found.add((start, end - start, q))
    return found


def repetitive(ids: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Parts (from, to) of ``ids`` outside of which no run of exponent ``least`` and ``shortest`` words can lie."""
    alive = np.bincount(ids)[ids] >= least
    for _ in range(ROUNDS):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], alive.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return []
        size = end - begin
        part = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(part)) + np.repeat(begin - np.cumsum(size) + size, size)
        _, inverse, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = count[inverse] >= least
        if often.all():
            break
        alive = np.zeros(len(ids), bool)
        alive[at[often]] = True
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """Runs of ``min_words`` words and exponent ``min_exponent`` or more, by start, then period."""
    if len(words) < min_words or max(Counter(words).values()) < min_exponent:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for a, b in repetitive(ids, min_exponent, max(min_words, min_exponent)):
        part = np.unique(ids[a:b], return_inverse=True)[1].reshape(-1)
        found += [(a + start, length, q) for start, length, q in runs_of(part, min_exponent) if length >= min_words]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that stand in a run after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def _scan(prepare: Callable[[Batches], Batches] | None, min_words: int, min_exponent: int):
    def run(batches: Batches) -> Batches:
        for batch in prepare(batches) if prepare else batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                runs = find_runs(words, min_words, min_exponent)
                rows.append((len(words), runs, strongest(runs), collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), x)) for x in r[1]] for r in rows], pa.list_(_RUN)),
                 pa.array([r[2] and dict(zip(("start", "length", "period"), r[2])) for r in rows], _RUN),
                 pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "strongest", "collapsed"])
    return run


def word_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
              min_exponent: int = MIN_EXPONENT, prepare: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """(id, n_words, runs, strongest, collapsed) of every row: its runs by start and period, the one of the
    greatest exponent, and the text without the repetitions.  Words end at ASCII white space.
    ``prepare`` maps batches (id, text) before they are scanned."""
    if min_exponent < 2:
        raise ValueError("a run has an exponent of 2 or more")
    small_batches(docs.sparkSession)
    kind, one = dict(docs.dtypes)[id_col], "struct<start: long, length: long, period: long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scan(prepare, min_words, min_exponent),
        f"id {kind}, n_words long, runs array<{one}>, strongest {one}, collapsed string")


def made_periodic(batches: Batches) -> Batches:
    """One text in ten, by the checksum of its id, repeats a stretch of its words from some word on to its end."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).to_pylist()
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            h = crc32(str(doc_id).encode())
            words = texts[i].encode().split() if texts[i] and doc_id is not None and h % 10 == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                again = words[a:a + p] * -(-(n - a) // p)
                texts[i] = b" ".join(words[:a] + again[:n - a]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.large_string())], names=["id", "text"])


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them made periodic first: number, strongest run, digests of all
    runs and of the text without the repetitions."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = word_runs(docs, prepare=made_periodic)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in (
        "start", "length", "period"))), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length",
        "strongest.period", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
