"""MinHash near-dedup with b-bit signatures.

1. *Sketch* (Arrow batches, numpy): the set of a text's five-word shingles as 64-bit hashes,
   its size, a 128-bit digest of the set, ``bands`` band keys (each over ``rows`` full minima),
   and the low ``BITS`` bits of every minimum, packed into longs.
2. Texts with the same set are one *class*, whose representative is the smallest id; only
   representatives go on, so copies are never expanded into pairs.
3. *Band candidates*: in the buckets of the first bands every member is paired with the smallest
   and the largest one.  A pair goes on if the b-bit estimate, corrected for chance collisions and
   taken with a margin of more than five standard deviations, can reach the threshold; it is a link when the
   full sets say so.  Connected components follow.
4. *The rest*: a bucket of any band may still have several components.  In one of ``SMALL``
   members at most, members outside the component of its smallest member meet those of other
   components, by a join whose condition is the estimate.  The members of larger ones take an exact
   prefix filter on their rarest shingles (:func:`rare_pairs`).  Both give every pair that
   may be a link, and no others are emitted; full sets decide again.  Links inside a component
   could change nothing, so the result is that of all pairs in all buckets.

With 32 bands of 5 rows a pair of similarity 0.85 shares no bucket with probability 7e-9, one of
0.8 with probability 3e-6.

Defined results: a null or empty text, or one without words, has an empty set and stays alone;
fewer words than five are one shingle; each row comes back, and rows that share an id and a
text are one document; a row with a null id is linked with nothing (component null, kept); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan
from .graph import cut_components
from .storage import cut_lineage, read_table, small_batches

BANDS, ROWS, BITS = 32, 5, 4
SEED = 20240613
#: Standard deviations that an estimate may lie below the threshold before a candidate is dropped.
SIGMAS = 5.5
#: Bands whose buckets are joined by stars first.
FIRST_BANDS = 8
#: Members of a bucket whose pairs are all compared by their estimates; larger buckets take the prefix filter.
SMALL = 16
#: Hash slots of the shingle counts: a table of 2 MB.
SLOT_BITS = 18
#: Bits of a set's parity bitmap in the prefix filter.
PARITY_BITS = 1024
#: Ids that may go to the scan of the texts as a broadcast: some 50 MB.
FEW_IDS = 1_000_000


def factors(n: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray, bounds: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Minimum of each of ``len(a)`` permutations (rows) over each document's hashes (columns); none empty."""
    out = np.empty((len(a), len(bounds) - 1), np.uint32)
    halves = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    buffer = np.empty(len(hashes), np.uint32)
    for k, factor in enumerate(a):
        np.multiply(halves[k & 1], factor, out=buffer)
        np.minimum.reduceat(buffer, bounds[:-1], out=out[k])
    return out


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Low bits (rows: permutations, columns: documents) packed into int64 words, one row a document."""
    per = 64 // bits
    out = np.zeros((low.shape[1], -(-low.shape[0] // per)), np.uint64)
    for k in range(low.shape[0]):
        out[:, k // per] |= low[k].astype(np.uint64) << np.uint64(bits * (k % per))
    return out.view(np.int64)


def sketch_block(data: np.ndarray, bounds: np.ndarray, a: np.ndarray, rows: int, bits: int, shingle: int = 5):
    """Set sizes, set digests, band keys and packed signatures of a block's documents."""
    _, _, hashes, first = textscan.words(data, bounds, textscan.SPACE)
    sh, sb = textscan.shingles(hashes, first, shingle)
    n = len(bounds) - 1
    sizes, digests = np.zeros(n, np.int64), [b""] * n
    for d in range(n):
        if sb[d + 1] > sb[d]:
            full = np.unique(sh[sb[d]:sb[d + 1]])
            sizes[d], digests[d] = len(full), hashlib.blake2b(full.tobytes(), digest_size=16).digest()
    some = np.flatnonzero(np.diff(sb))
    bands, packed = [None] * n, [None] * n
    if len(some):
        low = minima(sh, np.append(sb[some], sb[-1]), a)
        keys = np.zeros((len(a) // rows, len(some)), np.uint64)
        for r in range(rows):
            keys = textscan.mix(keys + low[r::rows].astype(np.uint64) + np.uint64(r + 1))
        keys += np.arange(len(keys), dtype=np.uint64)[:, None]  # a band meets itself alone
        keys = textscan.mix(keys).view(np.int64).T
        kept = textscan.mix(low.astype(np.uint64)) & np.uint64((1 << bits) - 1)
        words = pack(kept, bits)
        for i, d in enumerate(some):
            bands[d], packed[d] = keys[i], words[i]
    return sizes, digests, bands, packed


def _sketches(n_hashes: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = factors(n_hashes)
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(1))
            for i, j in textscan.blocks(bounds):
                sizes, digests, bands, packed = sketch_block(
                    data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], a, rows, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes),
                     pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(packed, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n_shingles", "digest", "bands", "sig"])
    return run


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
           bits: int = BITS) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col, F.xxhash64(text_col)).mapInArrow(
        _sketches(bands * rows, rows, bits),
        f"id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>, sig array<long>")


def unequal_bits(x: Column, y: Column, n_words: int, bits: int) -> Column:
    """How many of the packed values differ."""
    ones = sum(1 << (bits * i) for i in range(64 // bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def word(i: int) -> Column:
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        step = 1
        while step < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
            step *= 2
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    return reduce(lambda p, q: p + q, [word(i) for i in range(n_words)])


def may_link(x: Column, y: Column, n_hashes: int, bits: int, threshold: float) -> Column:
    """The collision-corrected estimate of the packed signatures is not far below the threshold.

    A permutation's low bits agree with probability J + (1 - J) / 2**bits.
    """
    p = threshold + (1 - threshold) / (1 << bits)
    least = n_hashes * p - SIGMAS * (n_hashes * p * (1 - p)) ** 0.5
    n_words = -(-n_hashes // (64 // bits))
    return F.lit(n_hashes) - unequal_bits(x, y, n_words, bits) >= F.lit(least)


def _sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    _, _, hashes, first = textscan.words(data, bounds, textscan.SPACE)
    sh, sb = textscan.shingles(hashes, first)
    return [np.unique(sh[sb[i]:sb[i + 1]]) for i in range(len(bounds) - 1)]


def _confirm(percent: int):
    """Batches (a, b, text of a, text of b) to the pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, (x, xb), (y, yb) = [], *(textscan.text_buffer(batch.column(k)) for k in (2, 3))
            for i, j in textscan.blocks(xb + yb):
                left, right = (_sets(d[b[i]:b[j]], b[i:j + 1] - b[i]) for d, b in ((x, xb), (y, yb)))
                for k, (s, t) in enumerate(zip(left, right, strict=True)):
                    at = np.searchsorted(t, s)
                    at[at == len(t)] = 0
                    both = int((t[at] == s).sum()) if len(s) and len(t) else 0
                    if both and 100 * both >= percent * (len(s) + len(t) - both):
                        keep.append(i + k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())),
                                              batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])
    return run


def _texts_of(ids: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """(id, th, text): the texts of ``n`` ids at most, each once an id; th is the text's hash.

    The ids go to the scan as a broadcast while there are ``FEW_IDS`` at most and they are numbers, and by a
    shuffled semi-join beyond that, so all texts are never shuffled for a few."""
    few = n <= FEW_IDS and dict(ids.dtypes)["id"] in ("int", "bigint")
    some = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").withColumn("th", F.xxhash64("text"))
    return cut_lineage(some.dropDuplicates(["id", "th"]), "some-texts")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets; ``texts``: (id, text)."""
    kind = dict(texts.dtypes)["id"]
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    some = _texts_of(ids, 2 * pairs.count(), texts)
    full = (pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
            .join(some.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(_confirm(percent), f"a {kind}, b {kind}").distinct()


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, component, text) to (slot, n): how many texts hold shingles of each slot, added up over a task."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        data, bounds = textscan.text_buffer(batch.column(3))
        for i, j in textscan.blocks(bounds, 1 << 18):
            for tokens in _sets(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]):
                np.add.at(total, _slots(tokens), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])


def parity(tokens: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits as int64 words: each tells whether an odd number of the set's shingles fall on it.

    A shingle that only one of two sets holds turns one bit, so the sets differ in as many shingles as bits at least.
    """
    odd = np.bincount((tokens % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(percent: int, count: np.ndarray):
    """(id, th, component, text) to one row a shingle of the text's prefix: (id, th, component, n, odd, token, place).

    Shingles alone in their slot are in no other text and give no row; they keep their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textscan.text_buffer(batch.column(3))
            for i, j in textscan.blocks(bounds, 1 << 18):
                sets = _sets(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                tokens, places = [], []
                for full in sets:
                    held = count[_slots(full)]
                    first = np.lexsort((full, held))[:(100 - percent) * len(full) // 100 + 1]
                    at = np.flatnonzero(held[first] > 1)
                    tokens.append(full[first[at]])
                    places.append(at + 1)
                size = np.array([len(t) for t in tokens])
                of = np.repeat(np.arange(j - i), size)
                odd = pa.array([parity(full) for full in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(of + i)) for c in range(3)),
                     pa.array(np.array([len(full) for full in sets])[of], pa.int64()), odd.take(pa.array(of)),
                     pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places), pa.int64())],
                    names=["id", "th", "component", "n", "odd", "token", "place"])
    return run


def _prefix_join(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that may be links; ``members``: (id, component), each id once.

    An exact prefix filter.  Two sets of x and y shingles that are links share ``least`` of them; with all
    shingles in one order, the first one that they share has so many after it on either side
    that they still can.  The order is rarest first, by how many texts hold a shingle of the same hash slot (a table of
    2**SLOT_BITS counts; any order is exact).  A group's members mostly differ by shingles of their own, which come first
    and pair with nothing, so a crowded bucket doesn't give the square of its size.  Links differ in
    x + y - 2 * ``least`` shingles at most; pairs whose parity bitmaps differ in more bits are no links and are not emitted.
    """
    kind = dict(members.dtypes)["id"]
    some = _texts_of(members.select("id"), members.count(), texts)
    crowd = cut_lineage(members.join(some, "id").select("id", "th", "component", "text"), "crowd-texts")
    found = (crowd.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
             .toArrow())  # 2**SLOT_BITS rows at most
    count = np.zeros(1 << SLOT_BITS, np.int64)
    count[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    first = cut_lineage(crowd.mapInArrow(
        _prefixes(percent, count), f"id {kind}, th long, component {kind}, n long, odd array<long>, token long, place long"),
        "prefixes")
    x, y = (first.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "odd", "place")))
            for s in ("a", "b"))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    both = F.col("n_a") + F.col("n_b")
    differ = unequal_bits(F.col("odd_a"), F.col("odd_b"), PARITY_BITS // 64, 1)
    may = ((100 + percent) * left >= percent * both) & ((100 + percent) * differ <= (100 - percent) * both)
    return (x.join(y, (x["token"] == y["token"]) & (F.col("id_a") < F.col("id_b"))
                   & (F.col("component_a") != F.col("component_b")) & may)
            .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def rare_pairs(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that may be links, each once (see :func:`_prefix_join`)."""
    return _prefix_join(members, texts, percent).distinct()


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(id, text_hash, n_shingles, component) of every row; links: 100 * intersection >= percent * union."""
    n_hashes, threshold = bands * rows, percent / 100
    table = cut_lineage(sketch(docs, id_col, text_col, bands, rows, bits), "sketch")
    # one class for each set of shingles; copies end here
    classes = (table.where("n_shingles > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")))
    classes = cut_lineage(classes, "classes")
    reps = (table.where("n_shingles > 0")
            .join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
            .dropDuplicates(["digest", "id"]))
    entries = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = (entries.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            .where(F.col("lo") < F.col("hi")))
    crowded = cut_lineage(entries.join(hubs, "bucket"), "buckets")
    sigs = reps.select("id", "sig")
    left, right = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate allows a link."""
        return (pairs.join(left, "a").join(right, "b")
                .where(may_link(F.col("sig_a"), F.col("sig_b"), n_hashes, bits, threshold)).select("a", "b").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(confirm(cut_lineage(pairs, "pairs"), texts, percent), "links")

    def members(found: DataFrame) -> DataFrame:
        """The buckets' members with their components, and the component of the smallest (main)."""
        main = found.select(F.col("id").alias("lo"), F.col("component").alias("main"))
        return (crowded.join(found, "id", "left").join(main, "lo", "left")
                .withColumn("component", F.coalesce("component", "id")).withColumn("main", F.coalesce("main", "lo")))

    # stars in the buckets of a few bands: they join most of a large group
    first = crowded.where(F.col("band") < FIRST_BANDS)
    star = (first.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")),
                                           F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p"))
            .select("p.*").where("a < b").distinct())
    links = linked(tested(star))
    found = cut_components(links)
    # the rest: buckets that still have several components
    inner = (crowded.where(f"band >= {FIRST_BANDS} OR (id > lo AND id < hi)").groupBy("bucket")
             .agg(F.count(F.lit(1)).alias("size")))

    member = cut_lineage(members(found).join(inner, "bucket").select("id", "bucket", "component", "main", "size"),
                         "members")
    split = member.where("component <> main").select("bucket").distinct()
    pool = member.join(split, "bucket", "left_semi")
    small = pool.where(F.col("size") <= SMALL).join(sigs, "id")
    x = small.where("component <> main").select("bucket", F.col("id").alias("a"), F.col("component").alias("ca"),
                                                F.col("sig").alias("sig_a"))
    y = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("main").alias("mb"),
                     F.col("sig").alias("sig_b"))
    once = (F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b"))  # both outside: one order of the two
    more = (x.join(y, (x["bucket"] == y["bucket"]) & (F.col("ca") != F.col("cb")) & once
                   & may_link(F.col("sig_a"), F.col("sig_b"), n_hashes, bits, threshold))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    large = cut_lineage(pool.where(F.col("size") > SMALL).select("id", "component").distinct(), "crowd")
    if not large.isEmpty():
        more = more.unionAll(tested(rare_pairs(large, texts, percent))).distinct()
    more = linked(more)
    if not more.isEmpty():
        found = cut_components(links.unionAll(more))
    rep = (classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
           .select("digest", F.coalesce("component", "rep").alias("component")))
    return (table.select("id", "text_hash", "n_shingles", "digest").join(rep, "digest", "left")
            .select("id", "text_hash", "n_shingles",
                    F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component"))
                    .otherwise(F.col("id")).alias("component")))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with the smallest id.

    Of rows that repeat an id and a text one stays, if the text has words.
    """
    found = cut_lineage(near_components(docs, id_col=id_col, text_col=text_col, percent=percent), "near-components")
    th = F.xxhash64(docs[text_col])
    gone = found.where("id <> component").select("id", "text_hash").distinct()
    kept = docs.join(gone, (docs[id_col] == gone["id"]) & (th == gone["text_hash"]), "left_anti")
    again = (found.where("id = component AND n_shingles > 0").groupBy("id", "text_hash").count().where("count > 1")
             .select("id", "text_hash"))
    if again.isEmpty():
        return kept
    th = F.xxhash64(kept[text_col])
    same = (kept[id_col] == again["id"]) & (th == again["text_hash"])
    return kept.join(again, same, "left_anti").unionAll(
        kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set, its component of linked documents, and whether it stays."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = near_components(docs, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
