"""Prefix trie of conversations with composable fingerprints.

Conversations are rebuilt: the first turns of a base conversation, then the conversation's own turns
from some place on.  A trie node is a distinct sequence of first turns of rebuilt conversations.

1. *Turns.*  A turn is known by its reference, the SHA-256 of role and text; texts go no further.
   References are sorted by conversation and place in one range partitioning, so a conversation may lie over many
   partitions (pieces).
2. *Monoid.*  A sequence of letters has the fingerprint (length, sum of letter_j * C^j), in four prime fields;
   two sequences combine by (m, x) (n, y) = (m + n, x + C^m y).  A task gives each turn the fingerprint of its piece so
   far; pieces of one conversation are combined in a small table (two rows a partition at most).
3. *Rebuilding.*  For a head of b turns and own turns from h on, the prefix that ends after own turn k - 1 is
   head(b) + (own(k) - own(h)) * C^(b - h): two stored products, no rebuilt sequence and no text.
4. *Nodes.*  Prefixes group by depth and fingerprint.  A group's members must have one turn reference and one parent
   group, which proves their equality by induction over the depth; otherwise the job raises.
5. *Subtrees.*  Each member but the smallest leaves the smaller ones at one place; what a subtree saves is
   the sum, over those members, of the characters from its top to that place, and its leaves are those whose smallest
   member is a member of the top.  So both are sums over members, without a walk over levels.

Defined results: null role and text are empty; a null conv_id is no conversation; turns sort with null first, rows of
one turn by their references; repeated rows are turns each; a turnless rebuilt conversation is a member of the root
only; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut_lineage, read_table, small_batches

#: (prime, base) of each field.
FIELDS = [(2147483647, 1103515245), (2147483629, 1597334677), (2147483587, 1812433253), (2147483579, 1664525003)]
PRIMES = np.array([p for p, _ in FIELDS], np.int64)
BASES = np.array([c for _, c in FIELDS], np.int64)
LANES = range(len(FIELDS))
KEY = ["d", "f", "g"]
Batches = Iterator[pa.RecordBatch]


def powers(n: int) -> np.ndarray:
    """C^0 .. C^(n-1) of each field (fields, n), by doubling."""
    out = np.ones((len(FIELDS), 1), np.int64)
    while out.shape[1] < n:
        step = np.array([[pow(int(c), out.shape[1], int(p))] for p, c in FIELDS], np.int64)
        out = np.concatenate((out, out * step % PRIMES[:, None]), axis=1)
    return out[:, :n]


def _pieces(batches: Batches) -> Batches:
    """Sorted (conv, ref, chars) to the turn's place, fingerprints before and after it, and characters, in its piece."""
    piece, table = TaskContext.get().partitionId(), powers(1024)
    last, count, total, seen = None, 0, np.zeros(len(FIELDS), np.int64), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, 8)
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(start, n))
        go_on = conv[0] == last
        at = np.arange(n) - np.repeat(start, size)
        if go_on:
            at[:size[0]] += count
        while table.shape[1] <= at.max():
            table = powers(2 * table.shape[1])
        term = words[:, 4:].T.astype(np.int64) % PRIMES[:, None] * table[:, at] % PRIMES[:, None]
        chars = batch.column(2).to_numpy()
        run = np.cumsum(term, axis=1)
        ran = np.cumsum(chars)
        base, ran_base = run[:, start] - term[:, start], ran[start] - chars[start]
        if go_on:
            base[:, 0] -= total
            ran_base[0] -= seen
        after = (run - np.repeat(base, size, axis=1)) % PRIMES[:, None]
        x = ran - np.repeat(ran_base, size)
        before = (after - term) % PRIMES[:, None]
        last, count, total, seen = conv[-1], int(at[-1]) + 1, after[:, -1], int(x[-1])
        ref = np.ascontiguousarray(words[:, :4]).view(">i8").astype(np.int64)
        cols = [conv, np.full(n, piece), at, ref[:, 0], ref[:, 1], chars, x, *after, *before]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols],
                                         names=["conv", "piece", "at", "r0", "r1", "chars", "x", *_lane("s"), *_lane("b")])


def _lane(name: str) -> list[str]:
    return [f"{name}{i}" for i in LANES]


def _offsets(batches: Batches) -> Batches:
    """(conv, parts) to what stands before each piece but the first: turns, characters, fingerprint and C^turns."""
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            turns = chars = 0
            total, shift = [0] * len(FIELDS), [1] * len(FIELDS)
            for part in parts:
                if turns:
                    rows.append([conv, part["piece"], turns, chars, *total, *shift])
                for i, (p, c) in enumerate(FIELDS):
                    total[i] = (total[i] + shift[i] * part[f"s{i}"]) % p
                    shift[i] = shift[i] * pow(c, part["n"], p) % p
                turns, chars = turns + part["n"], chars + part["x"]
        cols = list(zip(*rows)) if rows else [[]] * (4 + 2 * len(FIELDS))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["conv", "piece", "turns", "xo", *_lane("o"), *_lane("c")])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, r0, r1, chars, x, s0.., b0..) of every turn: its place, reference and characters, the characters up to
    and with it, and the fingerprints of its conversation after (s) and before (b) it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ref = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    keyed = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", ref.alias("ref"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("salt"))
    # the salt lets even copies of one row lie over several partitions
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("ref"), F.col("salt")]
    lanes = [*_lane("s"), *_lane("b")]
    local = cut_lineage(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "ref", "chars")
        .mapInArrow(_pieces, "conv long, piece long, at long, r0 long, r1 long, chars long, x long, "
                    + ", ".join(f"{c} long" for c in lanes)), "trie-turns")
    ends = local.groupBy("conv", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("x", *_lane("s")), "at").alias("e"))
    # a conversation over several pieces: as many entries as it has partitions
    parts = (ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "n", "e.*"))).alias("parts"))
             .where(F.size("parts") > 1))
    shift = parts.mapInArrow(_offsets, "conv long, piece long, turns long, xo long, "
                             + ", ".join(f"{c} long" for c in [*_lane("o"), *_lane("c")]))
    moved = local.join(F.broadcast(shift), ["conv", "piece"], "left")  # two rows a partition at most

    def whole(name: str, i: int) -> Column:
        part = F.col(f"{name}{i}")
        return F.when(F.col("turns").isNull(), part).otherwise((F.col(f"o{i}") + F.col(f"c{i}") * part) % FIELDS[i][0])

    zero = F.lit(0)
    return moved.select("conv", (F.col("at") + F.coalesce("turns", zero)).alias("pos"), "r0", "r1", "chars",
                        (F.col("x") + F.coalesce("xo", zero)).alias("x"),
                        *[whole(c, i).alias(f"{c}{i}") for c in "sb" for i in LANES])


def _key(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four fields in two longs."""
    return [(F.shiftleft(lanes[2 * k], 31).bitwiseOR(lanes[2 * k + 1])).alias(n) for k, n in enumerate(names)]


def paths(turns: DataFrame, base: Column, head: Column, max_head: int) -> DataFrame:
    """(conv, d, f, g, pf, pg, r0, r1, chars, x, last): every prefix of every rebuilt conversation, with its own
    and its parent's fingerprint.  ``base`` and ``head`` are columns of ``conv``; ``head`` is ``max_head`` at most."""
    own = cut_lineage(prefixes(turns), "trie-prefixes")
    entry = F.struct("pos", "r0", "r1", "chars", "x", *_lane("s"), *_lane("b"))
    each = cut_lineage(own.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < max_head, entry))).alias("first")), "trie-heads")
    asked = each.select("conv", "n", "first", base.alias("base"), head.cast("int").alias("h"))
    heads = each.select(F.col("conv").alias("base"), F.col("first").alias("theirs"), F.col("n").alias("base_n"))
    b = F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0))).cast("int")

    def at(turn: Column, of: str, field: str) -> Column:
        """A field after ``turn`` turns; 0 before the first."""
        return F.when(turn > 0, F.get(F.col(of), turn - 1)[field]).otherwise(F.lit(0))

    rebuilt = (asked.join(heads, "base", "left").withColumn("b", b)
               .withColumn("depth", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
               .select("conv", "h", "b", "depth", "theirs", at(F.col("b"), "theirs", "x").alias("hx"),
                       at(F.col("h"), "first", "x").alias("ox"),
                       *[at(F.col("b"), "theirs", f"s{i}").alias(f"h{i}") for i in LANES],
                       *[at(F.col("h"), "first", f"s{i}").alias(f"o{i}") for i in LANES]))
    rebuilt = cut_lineage(rebuilt, "trie-rebuilt")
    none = F.lit(0).cast("long")
    root = rebuilt.select("conv", none.alias("d"), none.alias("f"), none.alias("g"), none.alias("pf"), none.alias("pg"),
                          none.alias("r0"), none.alias("r1"), none.alias("chars"), none.alias("x"),
                          (F.col("depth") == 0).alias("last"))
    head_rows = (rebuilt.where("b > 0").select("conv", "depth", F.explode(F.slice("theirs", 1, F.col("b"))).alias("t"))
                 .select("conv", (F.col("t.pos") + 1).alias("d"),
                         *_key([F.col(f"t.s{i}") for i in LANES], ("f", "g")),
                         *_key([F.col(f"t.b{i}") for i in LANES], ("pf", "pg")), "t.r0", "t.r1", "t.chars", "t.x",
                         (F.col("t.pos") + 1 == F.col("depth")).alias("last")))
    inverse = [F.array(*[F.lit(pow(pow(c, -1, p), k, p)) for k in range(max_head + 1)]) for p, c in FIELDS]

    def moved(name: str, i: int) -> Column:
        """head + (own - own before the cut) * C^(b - h), of field i."""
        p = FIELDS[i][0]
        return (F.col(f"h{i}") + F.pmod(F.col(f"{name}{i}") - F.col(f"o{i}"), F.lit(p))
                * F.get(inverse[i], F.col("h") - F.col("b"))) % p

    mine = own.join(rebuilt.drop("theirs"), "conv").where("pos >= h")
    d = F.col("b") + F.col("pos") - F.col("h") + 1
    own_rows = mine.select("conv", d.alias("d"), *_key([moved("s", i) for i in LANES], ("f", "g")),
                           *_key([moved("b", i) for i in LANES], ("pf", "pg")), "r0", "r1", "chars",
                           (F.col("hx") + F.col("x") - F.col("ox")).alias("x"), (d == F.col("depth")).alias("last"))
    return root.unionByName(head_rows).unionByName(own_rows)


def _id_chunks(batches: Batches) -> Batches:
    """Sorted (d, f, g, conv) to the ids of each node joined by commas, one row a node and batch."""
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in range(3)]
        n = batch.num_rows
        if not n:
            continue
        new = np.concatenate(([True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])))
        start = np.flatnonzero(new)
        ids = batch.column(3).to_pylist()
        text = [",".join(map(str, ids[a:z])) for a, z in zip(start, np.append(start[1:], n))]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[start]) for k in keys), pa.array([ids[a] for a in start], pa.int64()),
                                          pa.array(text)], names=[*KEY, "first", "ids"])


def _id_digests(batches: Batches) -> Batches:
    """Chunks sorted by (d, f, g, first) to one digest a node; only the running digest is held."""
    key, digest = None, None

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                          names=[*KEY, "ends_sha256"])

    for batch in batches:
        rows = []
        for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key:
                    rows.append([*key, digest.hexdigest()])
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield out(rows)
    if key:
        yield out([[*key, digest.hexdigest()]])


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, f, g, ends_sha256): digest of the sorted ids of each node's rows (d, f, g, conv).

    Ids are joined in the range partitions that sort them, so the task that digests a
    node reads one row for each batch of its ids.
    """
    keys = "d long, f long, g long"
    chunks = (ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").select(*KEY, "conv")
              .mapInArrow(_id_chunks, f"{keys}, first long, ids string"))
    return (chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(_id_digests, f"{keys}, ends_sha256 string"))


def prefix_trie(turns: DataFrame, base: Column | None = None, head: Column | None = None, max_head: int = 0) -> DataFrame:
    """One row a node: (d, f, g) depth and fingerprint, conv_id, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Without ``base`` and ``head`` conversations are taken as they are."""
    small_batches(turns.sparkSession)
    base = F.col("conv") if base is None else base
    head = F.lit(0) if head is None else head
    path = cut_lineage(paths(turns, base, head, max_head), "trie-paths")
    same = reduce(lambda x, y: x & y, [F.min(c) == F.max(c) for c in ("r0", "r1", "pf", "pg")])
    wrong = F.raise_error(F.lit("two turn sequences share a fingerprint")).cast("long")
    found = path.groupBy(*KEY).agg(
        F.when(same, F.min("conv")).otherwise(wrong).alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("pf").alias("pf"), F.min("pg").alias("pg"), F.min("chars").alias("chars"), F.min("x").alias("x"))
    found = cut_lineage(found, "trie-nodes")
    below = found.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("pf").alias("f"), F.col("pg").alias("g"))
    children = below.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select((F.col("d") + 1).alias("d"), F.col("f").alias("pf"), F.col("g").alias("pg"),
                           F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(
        found.join(children, KEY, "left").join(parents, ["d", "pf", "pg"], "left")
        .select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                "chars", "x"), "trie-linked")
    # only shared nodes hold more than one path
    shared = cut_lineage(path.select(*KEY, "conv").join(
        nodes.where("n_convs > 1").select(*KEY, "conv_id", "chars", "x"), KEY), "trie-shared")
    leaves_at = shared.where("conv <> conv_id").groupBy("conv").agg(F.max("x").alias("left_at"))
    tops = nodes.where("n_children = 0").select(F.col("conv_id").alias("conv"), F.lit(1).alias("leaf"))
    saved = F.when(F.col("conv") != F.col("conv_id"), F.col("left_at") - F.col("x") + F.col("chars")).otherwise(F.lit(0))
    sums = (shared.join(leaves_at, "conv", "left").join(tops, "conv", "left").groupBy(*KEY)
            .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens")))
    ends = end_digests(path.where("last").select(*KEY, "conv"))
    return (nodes.join(sums, KEY, "left").join(ends, KEY, "left")
            .select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, each rebuilt on up to five first turns of the first of its hundred."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    c = F.col("conv")
    trie = prefix_trie(turns, base=c - c % 100, head=F.crc32(c.cast("string")) % 6, max_head=5)
    return trie.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                       "saved_tokens", "ends_sha256")
