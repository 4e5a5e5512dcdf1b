"""Conditional-inference forest as DataFrame jobs.

All predictors and the target are numeric, so the association test of a
feature x with the target y in a node reduces to the quadratic form
``c = (n - 1) * corr(x, y)^2`` (one degree of freedom: ordering by p-value is
ordering by c), and the statistic of the cut ``x <= v`` is

    c(v) = (n - 1) S_L^2 / (n_L n_R var(y))

from cumulative counts and sums S_L of y less its node mean (Hothorn, Hornik & Zeileis 2006).  A tree
level is therefore a handful of aggregates:

* node moments: one wide aggregate per (tree, node) -- n, sum of y and, per feature, the
  count, variances and covariance of the pairs without NULL (no row is replicated per
  feature; the built-in variances merge stably, so large offsets don't cancel);
* candidate features (``mtry``) drawn per node from a seeded hash;
* the best cut of the selected feature: counts and sums per distinct value,
  then cumulative sums in value order;
* the split is applied by a join on (tree, node).

Node 1 of every tree holds all its rows, so every key includes the tree id.  A tree's rows travel
together, in bag and out of it, with target and features.  Nodes of more than ``ForestParams.subtree_rows``
rows grow level by level (a driver loop over depth only, each level written to the shared checkpoint
folder); once a node has fewer, one task finishes its whole subtree with the same arithmetic
(:mod:`.subtree`), so what remains of a tree is one job and not some twenty levels.  Either way the
result has splits, leaves, and members (tree, id, leaf, in bag, target), from which predictions,
out-of-bag errors and the base errors of importance are read without routing.  Where a task holds a cohort, members
aren't kept: they are trees times rows, and drawing and routing them again in a task is cheaper than reading them.

Several forests grow in one job: rows carry a ``cohort`` number, and cohort c has the trees from
``c * ntree`` on, so (tree, node) keys tell the cohorts apart.

Rows are identified by ``id`` within a cohort; features travel as one array column ``xs``.  A tree's subsample
has exactly floor(fraction * n) rows, those with the smallest (hash of (seed, tree, id), id).

NULL: a row without a target is not learned from.  A NULL feature (NaN counts as one) takes no part in its
association, its cut candidates and their counts; a row whose split value is NULL goes
left, in growth and in routing alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_half_away
from ..session import cut_lineage, drop_path, scratch_path, ship_package, write_stage
from ..spec import ForestParams
from . import subtree
from .subtree import MAX_LEVELS, ROUND

#: Rows of a subsample's histogram bucket that are ranked, about.
RANKED = 4096
#: Trees that one task draws and grows from a cohort's rows, one after the other.
CHUNK = 20


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash: first 8 hex digits of md5 over '|'-joined parts
    (identical in Spark and DuckDB when parts are integers or text)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8),
                  16, 10).cast("bigint")


def bag_size(n: Column, fraction: float) -> Column:
    """floor(fraction * n), in whole numbers (the fraction in millionths)."""
    of = n * round(fraction * 1_000_000)
    return ((of - of % 1_000_000) / 1_000_000).cast("bigint")


def forest_input(cohort: DataFrame, features: Sequence[str], target: str,
                 id_col: Column | None = None, number: int = 0) -> DataFrame:
    """(cohort, id, y, xs): number of the cohort, row id, target and the feature array."""
    from ..sources.panel import row_id
    rid = id_col if id_col is not None else row_id()

    def feature(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)
    return cohort.where(F.col(target).isNotNull()).select(
        F.lit(number).alias("cohort"), rid.alias("id"), F.col(target).cast("double").alias("y"),
        F.array(*[feature(c) for c in features]).alias("xs"))


# --- M8a: subsample -----------------------------------------------------------

def _with_cohort(inp: DataFrame) -> DataFrame:
    return inp if "cohort" in inp.columns else inp.withColumn("cohort", F.lit(0))


def cohort_of(tree: Column, p: ForestParams) -> Column:
    return F.floor(tree / p.ntree).cast("int")


def _tree_rows(inp: DataFrame, trees: Sequence[int], ntree: int = 0) -> DataFrame:
    """Every row once for each of its cohort's trees, numbered ``cohort * ntree + t`` for t in ``trees``."""
    t0, t1 = min(trees), max(trees)
    tree = F.explode(F.sequence(F.lit(t0), F.lit(t1)))
    out = inp.select("*", tree.alias("tree"))
    return out.withColumn("tree", F.col("tree") + F.col("cohort") * ntree) if "cohort" in inp.columns and ntree else out


def draw(inp: DataFrame, trees: Sequence[int], p: ForestParams) -> DataFrame:
    """(tree, h0, id0): the last row, by (hash, id), of each tree's subsample of exactly floor(fraction * n) rows.

    Selection of the k-th smallest: counts of the hash's top bits per tree, then only the rows of the bucket that
    holds the k-th are ranked.  The number of buckets follows n, so some ``RANKED`` rows a tree are; the
    result doesn't depend on it.  A cohort too small for a subsample (k = 0) gives no row.
    """
    rows = _with_cohort(inp).select("cohort", "id")
    sizes = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 1
    bits = min(16, max(0, math.ceil(math.log2(most / RANKED))))
    pairs = _tree_rows(rows, trees, p.ntree).select(
        "cohort", "tree", "id", hash32(p.seed, "s", F.col("tree"), F.col("id")).alias("h"))
    bucket = F.shiftright("h", 32 - bits).alias("bucket")
    counts = pairs.groupBy("cohort", "tree", bucket).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("tree").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    rank = bag_size(F.col("n"), p.fraction) - F.col("before")
    edge = (counts.withColumn("before", before).join(sizes, "cohort").withColumn("rank", rank)
            .where("rank > 0 AND rank <= m").select("tree", "bucket", "rank"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))
    # one row a tree; unhinted, the planner broadcasts the pairs, whose explode isn't in their size estimate
    return (pairs.withColumn("bucket", bucket).join(F.broadcast(edge), ["tree", "bucket"]).withColumn("place", place)
            .where("place = rank").select("tree", F.col("h").alias("h0"), F.col("id").alias("id0")))


def root_rows(inp: DataFrame, trees: Sequence[int], p: ForestParams, drawn: DataFrame | None = None) -> DataFrame:
    """The columns of ``inp`` with tree and ``bag`` (the row is in the tree's subsample), every row once a tree."""
    drawn = draw(inp, trees, p) if drawn is None else drawn
    h = hash32(p.seed, "s", F.col("tree"), F.col("id"))
    inside = (h < F.col("h0")) | ((h == F.col("h0")) & (F.col("id") <= F.col("id0")))
    # one row a tree: as many as ntree x cohorts, both parameters
    return (_tree_rows(_with_cohort(inp), trees, p.ntree).join(F.broadcast(drawn), "tree", "left")
            .withColumn("bag", F.coalesce(inside, F.lit(False))).drop("h0", "id0"))


def subsample(inp: DataFrame, trees: Sequence[int], p: ForestParams, oob: bool = False) -> DataFrame:
    """(tree, id) of the rows in each tree's subsample (or out of bag): sampling without replacement of
    exactly floor(fraction * n) rows (see :func:`draw`)."""
    rows = root_rows(_with_cohort(inp).select("cohort", "id"), trees, p)
    return rows.where(~F.col("bag") if oob else F.col("bag")).select("tree", "id")


# --- M8b: candidate features ------------------------------------------------------

def _candidate_array(n_features: int, p: ForestParams) -> Column:
    """The node's ``mtry`` candidate features: feature indices ordered by a seeded
    hash of (tree, node, k), first ``mtry`` kept -- a projection, no window."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)),
                        lambda k: F.struct(hash32(p.seed, "c", F.col("tree"), F.col("node"), k).alias("h"),
                                           k.alias("k")))
    return F.slice(F.array_sort(keyed), 1, p.mtry)


def candidates(nodes: DataFrame, n_features: int, p: ForestParams) -> DataFrame:
    """(tree, node, k): ``mtry`` features per node, the smallest seeded hashes."""
    return (nodes.select("tree", "node", F.explode(_candidate_array(n_features, p)).alias("c"))
            .select("tree", "node", F.col("c.k").alias("k")))


# --- node moments -----------------------------------------------------------------

@dataclass(frozen=True)
class Centre:
    """Each cohort's means of y and of its features, by the cohort's number, and whether a feature is never NULL."""
    means: tuple[tuple[float, ...], ...]   # cohort -> (y, x0, x1, ...)
    full: tuple[bool, ...]

    def of(self, i: int, cohort: Column | None) -> Column:
        """The mean of y (0) or of feature i - 1, for a row's cohort."""
        if len(self.means) == 1 or cohort is None:
            return F.lit(self.means[0][i])
        return F.element_at(F.array(*[F.lit(m[i]) for m in self.means]), cohort + 1)


def centre(inp: DataFrame, n_features: int) -> Centre:
    """One aggregate, one row a cohort."""
    xk = [F.col("xs")[k] for k in range(n_features)]
    rows = _with_cohort(inp).groupBy("cohort").agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(x) for x in xk],
                                                   *[F.count(x) for x in xk]).collect()
    found = {r[0]: r for r in rows}
    means = [tuple(v or 0.0 for v in found[c][2:3 + n_features]) if c in found else (0.0,) * (1 + n_features)
             for c in range(max(found, default=0) + 1)]
    return Centre(tuple(means), tuple(all(r[3 + n_features + k] == r[1] for r in rows) for k in range(n_features)))


def node_stats(m: DataFrame, n_features: int, about: Centre | None = None, ntree: int = 0) -> DataFrame:
    """Per (tree, node): n, sy and, per feature over the rows where it isn't NULL, arrays nk (rows),
    my and vy (mean and variance of y), vx and cxy.

    One aggregate of sums of differences from the cohort's means (``ntree`` trees each), so large offsets
    don't cancel; a feature that doesn't vary in the node has variance 0 by its extremes.  Plain sums keep the
    aggregate in generated code, where as many variances and covariances would not fit; a feature without NULL
    shares the sums of y."""
    about = centre(m, n_features) if about is None else about
    cohort = F.floor(F.col("tree") / ntree).cast("int") if ntree else None
    dy = F.col("y") - about.of(0, cohort)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(dy).alias("s"), F.sum(dy * dy).alias("q"),
            F.min("y").alias("ylo"), F.max("y").alias("yhi")]
    for k in range(n_features):
        x = F.col("xs")[k]
        dx = x - about.of(k + 1, cohort)
        sums += [F.sum(dx).alias(f"x{k}"), F.sum(dx * dx).alias(f"xx{k}"), F.sum(dx * dy).alias(f"xy{k}"),
                 F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}")]
        if not about.full[k]:
            y = F.when(x.isNotNull(), dy)
            sums += [F.count(x).alias(f"n{k}"), F.sum(y).alias(f"s{k}"), F.sum(y * y).alias(f"q{k}")]
    st = m.groupBy("tree", "node").agg(*sums)

    def per(k: int) -> tuple[Column, ...]:
        own = [F.col(c if about.full[k] else f"{c}{k}") for c in ("n", "s", "q")]
        n = F.when(own[0] > 0, own[0])
        mx, my = F.col(f"x{k}") / n, own[1] / n
        varies = F.col(f"hi{k}") > F.col(f"lo{k}")
        return (own[0], my + about.of(0, cohort), F.when(F.col("yhi") > F.col("ylo"), own[2] / n - my * my).otherwise(F.lit(0.0)),
                F.when(varies, F.col(f"xx{k}") / n - mx * mx).otherwise(F.lit(0.0)), F.col(f"xy{k}") / n - mx * my)
    arrays = zip(*[per(k) for k in range(n_features)])
    return st.select("tree", "node", "n", "sy", *[F.array(*cols).alias(name) for name, cols in zip(
        ("nk", "my", "vy", "vx", "cxy"), arrays)])


def association(n: Column, vx: Column, vy: Column, cxy: Column) -> Column:
    """c = (n - 1) corr(x, y)^2 from variances and covariance; 0 when either side is constant."""
    return F.when((vx > 0) & (vy > 0), (n.cast("double") - 1) * (cxy / vx) * (cxy / vy)).otherwise(F.lit(0.0))


# --- M8c: split variable --------------------------------------------------------------

def select_variable(stats: DataFrame, n_features: int, p: ForestParams) -> DataFrame:
    """(tree, node, k, stat, n, my, vy): among the node's candidates the feature with the largest
    association (ties: lowest k), for nodes with at least ``minsplit`` rows; n, my and vy
    are of the rows where that feature isn't NULL.  Nodes whose best association is 0 are not split.

    One projection over the node-moment row: candidates, their statistics and
    the arg-max are array expressions, so this step adds no shuffle."""
    def stat_of(e):
        k = e["k"]
        c = association(F.col("nk")[k], F.col("vx")[k], F.col("vy")[k], F.col("cxy")[k])
        return F.struct(round_half_away(c, ROUND).alias("stat"), (-k).alias("nk"))
    best = F.array_max(F.transform(_candidate_array(n_features, p), stat_of))
    k = -best["nk"]
    return (stats.filter(F.col("n") >= p.minsplit)
            .select("tree", "node", k.alias("k"), best["stat"].alias("stat"), F.col("nk")[k].alias("n"),
                    F.col("my")[k].alias("my"), F.col("vy")[k].alias("vy"))
            .filter(F.col("stat") > 0))


# --- M8d: best cut ----------------------------------------------------------------------

def value_blocks(inp: DataFrame, n_features: int, blocks: int = 256) -> list[list[float]]:
    """Per feature, ``blocks - 1`` approximate quantiles of its values: boundaries of
    contiguous value ranges used to split the cumulative sums of the cut search.
    One aggregate; the result is bounded by ``n_features x blocks`` numbers."""
    probs = [i / blocks for i in range(1, blocks)]
    row = inp.agg(*[F.percentile_approx(F.col("xs")[k], probs, 10000).alias(f"b{k}")
                    for k in range(n_features)]).first()
    return [sorted(set(row[f"b{k}"] or [])) for k in range(n_features)]


def with_block(df: DataFrame, k: str, bounds: Sequence[Sequence[float]]) -> DataFrame:
    """``blk``: the number of the value range of feature ``k`` that ``x`` lies in, by binary search in Arrow batches
    (unrolled into expressions, the search blows up in the optimizer)."""
    ship_package(df.sparkSession)
    edges = [np.array(b, float) for b in bounds]

    @F.pandas_udf("int")
    def block(feature: pd.Series, x: pd.Series) -> pd.Series:
        out, which, value = np.zeros(len(x), np.int32), feature.to_numpy(), x.to_numpy()
        for i in np.unique(which):
            own = which == i
            out[own] = np.searchsorted(edges[i], value[own], "left")
        return pd.Series(out)
    return df.withColumn("blk", block(F.col(k), F.col("x")))


def best_cut(m: DataFrame, var: DataFrame, minbucket: int, bounds: list[list[float]],
             spent: list[str] | None = None) -> DataFrame:
    """(tree, node, k, cut, cut_stat): the cut x <= v of the selected feature with the
    largest two-sample statistic, both sides >= minbucket (ties: smallest v).

    Rows are first reduced to (count, sum of y less the node's mean) per distinct value, so a
    value repeated by a third of all rows is one row here.  The cumulative sums over
    a node's values are taken in two levels: totals per value block (at most one block
    per boundary), an exclusive prefix over the blocks, then a running sum inside each block,
    so no window holds more than one block of one node.  The best cut is a map-side maximum.
    ``spent`` gathers the table written on the way."""
    x = F.col("xs")[F.col("k")]
    # one row a node that is searched; unhinted, rows that compress well look smaller and are broadcast
    dv = (m.join(F.broadcast(var.select("tree", "node", "k", "n", "my", "vy")), ["tree", "node"]).filter(x.isNotNull())
          .groupBy("tree", "node", "k", "n", "vy", x.alias("x"))
          .agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col("y") - F.col("my")).alias("s")))
    # read twice
    dv, path = write_stage(with_block(dv, "k", bounds), "cut-values")
    if spent is not None:
        spent.append(path)
    tot = dv.groupBy("tree", "node", "blk").agg(F.sum("cnt").alias("bn"), F.sum("s").alias("bs"))
    wb = Window.partitionBy("tree", "node").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select("tree", "node", "blk", F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("pn"),
                     F.coalesce(F.sum("bs").over(wb), F.lit(0.0)).alias("ps"))
    w = Window.partitionBy("tree", "node", "blk").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cum = (dv.select("tree", "node", "k", "n", "vy", "blk", "x", F.sum("cnt").over(w).alias("nl0"),
                     F.sum("s").over(w).alias("sl0"))
           .join(pre, ["tree", "node", "blk"])
           .select("tree", "node", "k", "n", "vy", "x", (F.col("nl0") + F.col("pn")).alias("nl"),
                   (F.col("sl0") + F.col("ps")).alias("sl")))
    n, nl = F.col("n").cast("double"), F.col("nl").cast("double")
    sides = nl * (n - nl)
    c = F.when((sides > 0) & (F.col("vy") > 0), (n - 1) * F.col("sl") * F.col("sl") / (sides * F.col("vy")))
    best = F.max(F.struct(F.col("cut_stat"), (-F.col("x")).alias("nx"))).alias("b")
    return (cum.filter((F.col("nl") >= minbucket) & (F.col("n") - F.col("nl") >= minbucket))
            .withColumn("cut_stat", round_half_away(c, ROUND)).filter(F.col("cut_stat").isNotNull())
            .groupBy("tree", "node", "k").agg(best)
            .select("tree", "node", "k", (F.lit(0.0) - F.col("b.nx")).alias("cut"), F.col("b.cut_stat").alias("cut_stat")))


def child(node: Column, x: Column, cut: Column) -> Column:
    """The child that a row goes to; a NULL value goes left."""
    return node * 2 + F.when(x > cut, 1).otherwise(0)


# --- M8e: grow ----------------------------------------------------------------------------

@dataclass
class Forest:
    """Fitted forest: internal nodes and leaf statistics, plus what built it."""
    splits: DataFrame      # tree, node, k, cut, depth
    leaves: DataFrame      # tree, node, n, sy
    features: tuple[str, ...]
    params: ForestParams
    depth: int             # deepest level that was split
    members: DataFrame | None = None   # tree, id, node (leaf), bag, y: every row of the cohort in every tree
    largest: int = 0       # rows of the largest cohort
    rows: DataFrame | None = None      # what it was grown from, if a task holds a cohort: members are then made when read
    cohorts: int = 1                   # with the highest number, if some are empty
    trees: int | None = None           # the first trees of each cohort that it has; None: all

    def feature_name(self) -> Column:
        return F.element_at(F.array(*[F.lit(f) for f in self.features]), F.col("k") + 1)

    def first_trees(self, n: int) -> Forest:
        """The forest of each cohort's first ``n`` trees (their numbers stay)."""
        def some(df: DataFrame | None) -> DataFrame | None:
            return None if df is None else df.where(F.col("tree") % self.params.ntree < n)
        f = replace(self, splits=some(self.splits), leaves=some(self.leaves), trees=min(n, self.trees or n))
        return replace(f, members=some(self.members) if f.rows is None else drawn_members(f))


#: Rows of a finished subtree: 0 a split, 1 a leaf, 2 a member.
GROWN = "tree int, node bigint, k int, cut double, depth int, n bigint, sy double, id {id}, bag boolean, y double, kind int"


def _values(table: pa.Table, n_features: int) -> np.ndarray:
    """The feature arrays as a matrix; NULL is NaN."""
    xs = table.column("xs").combine_chunks()
    xs = pa.concat_arrays(xs.chunks) if isinstance(xs, pa.ChunkedArray) else xs
    flat = xs.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(-1, n_features)


def _ids(table: pa.Table) -> pa.Array:
    ids = table.column("id").combine_chunks()
    return pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids


def _grown(tree: int, splits: list, leaves: list, at: np.ndarray, ids: pa.Array, bag: np.ndarray, y: np.ndarray) -> pa.Table:
    """The rows of a finished subtree."""
    a, b, c = len(splits), len(leaves), len(y)

    def column(kind, *parts):
        """Values for splits, leaves and members; None: NULL for all of them."""
        sizes = (a, b, c)
        return pa.concat_arrays([pa.nulls(n, kind) if v is None else pa.array(v, kind) for v, n in zip(parts, sizes)])
    return pa.table({
        "tree": pa.array(np.full(a + b + c, tree), pa.int32()),
        "node": column(pa.int64(), [s[0] for s in splits], [v[0] for v in leaves], at),
        "k": column(pa.int32(), [s[1] for s in splits], None, None),
        "cut": column(pa.float64(), [s[2] for s in splits], None, None),
        "depth": column(pa.int32(), [s[0].bit_length() - 1 for s in splits], None, None),
        "n": column(pa.int64(), None, [v[1] for v in leaves], None),
        "sy": column(pa.float64(), None, [v[2] for v in leaves], None),
        "id": pa.concat_arrays([pa.nulls(a + b, ids.type), ids]),
        "bag": column(pa.bool_(), None, None, bag),
        "y": column(pa.float64(), None, None, y),
        "kind": pa.array(np.repeat([0, 1, 2], [a, b, c]), pa.int32())})


def _finish(p: ForestParams, n_features: int):
    """One group (tree, node) to the rows of its finished subtree."""
    def run(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        y, bag = table.column("y").to_numpy(), table.column("bag").to_numpy()
        return _grown(tree, *subtree.grow(tree, root, _values(table, n_features), y, bag, p), _ids(table), bag, y)
    return run


#: Nodes of whole trees: a split, or a leaf without k, cut and depth.
NODES = "tree int, node bigint, k int, cut double, depth int, n bigint, sy double"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's rows of each cohort as one value."""
    for batch in batches:
        for cohort in pc.unique(batch.column("cohort")).to_pylist():
            own = batch.filter(pc.equal(batch.column("cohort"), cohort)).select(["id", "y", "xs"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            yield pa.record_batch({"cohort": pa.array([cohort], pa.int32()),
                                   "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def by_chunks(rows: DataFrame, cohorts: int, trees: int, schema: str,
              run: Callable[[int, range, pa.Table, pa.Table | None], Iterator[pa.Table]], p: ForestParams,
              nodes: DataFrame | None = None) -> DataFrame:
    """What ``run`` gives for each chunk of each cohort's first ``trees`` trees; it gets the cohort's number, the chunk's tree
    numbers and the cohort's rows by id, and the trees' ``nodes`` if there are any.

    A cohort's rows go once to each chunk, not to each tree, some thousands as one value; nothing is hashed or sorted on the
    way: the chunk's number is its partition's."""
    ship_package(rows.sparkSession)
    size, ntree, routed = CHUNK, p.ntree, nodes is not None
    chunks = -(-trees // size)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        table = pa.Table.from_batches(found) if found else None
        found = None
        for part in pc.unique(table.column("part")).to_pylist() if table is not None else []:
            own = table.filter(pc.equal(table.column("part"), part))
            given = pc.is_valid(own.column("rows"))
            of = [pa.ipc.open_stream(v.as_buffer()).read_all() for v in own.filter(given).column("rows")]
            if not of:
                continue
            of = pa.concat_tables(of).sort_by("id")
            below = None if not routed else own.filter(pc.invert(given)).select(["tree", "node", "k", "cut", "n", "sy"])
            own, cohort = None, part // chunks
            first = part % chunks * size
            for out in run(cohort, range(cohort * ntree + first, cohort * ntree + min(trees, first + size)), of, below):
                yield from out.to_batches(max_chunksize=65536)

    first = (F.col("cohort") * chunks).cast("int")
    sent = (rows.select(F.col("cohort").cast("int").alias("cohort"), "id", "y", "xs").mapInArrow(_packed, "cohort int, rows binary")
            .select(F.explode(F.sequence(first, first + (chunks - 1))).alias("part"), "rows"))
    if routed:
        own = F.col("tree") % ntree
        of = (F.floor(F.col("tree") / ntree) * chunks + F.floor(own / size)).cast("int")
        sent = sent.unionByName(nodes.where(own < trees).select(of.alias("part"), "tree", "node", "k", "cut", "n", "sy"),
                                allowMissingColumns=True)
    return sent.repartitionById(max(1, chunks * cohorts), "part").mapInArrow(task, schema)


def _whole_trees(p: ForestParams, n_features: int):
    """A cohort's rows to the nodes of a chunk's trees: drawn and grown one after the other."""
    def run(cohort: int, trees: range, rows: pa.Table, _) -> Iterator[pa.Table]:
        c, y, ids = subtree.Columns(_values(rows, n_features)), rows.column("y").to_numpy(), _ids(rows).to_numpy()
        text = subtree.digits(ids)
        for t in trees:
            (node, k, cut, _), (leaf, n, sy) = subtree.grow_nodes(t, 1, c, y, subtree.draw(t, ids, p, text), p)
            a, b = len(node), len(leaf)
            depth = np.frexp(node.astype(float))[1] - 1

            def column(kind, split, end):
                return pa.concat_arrays([pa.nulls(m, kind) if v is None else pa.array(v, kind) for v, m in ((split, a), (end, b))])
            yield pa.table({
                "tree": pa.array(np.full(a + b, t), pa.int32()), "node": column(pa.int64(), node, leaf),
                "k": column(pa.int32(), k, None), "cut": column(pa.float64(), cut, None), "depth": column(pa.int32(), depth, None),
                "n": column(pa.int64(), None, n), "sy": column(pa.float64(), None, sy)})
    return run


def grow_whole(inp: DataFrame, p: ForestParams, n_features: int, cohorts: int, path: str) -> DataFrame:
    """Write the nodes of all trees of all cohorts, each of which one task can hold, to ``path``."""
    by_chunks(inp, cohorts, p.ntree, NODES, _whole_trees(p, n_features), p).write.parquet(path)
    return inp.sparkSession.read.schema(NODES).parquet(path)


def _root_cuts(p: ForestParams, n_features: int):
    """A cohort's rows to the first split of each of a chunk's trees, with its statistic."""
    def run(cohort: int, trees: range, rows: pa.Table, _) -> Iterator[pa.Table]:
        c, y, ids = subtree.Columns(_values(rows, n_features)), rows.column("y").to_numpy(), _ids(rows).to_numpy()
        text, found = subtree.digits(ids), []
        for t in trees:
            (node, k, cut, stat), _ = subtree.grow_nodes(t, 1, c, y, subtree.draw(t, ids, p, text), p)
            found += [(t, *s) for s in zip(k.tolist(), cut.tolist(), stat.tolist())]
        if found:
            yield pa.table([pa.array(v, kind) for v, kind in zip(zip(*found), (pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                           ["tree", "k", "cut", "cut_stat"])
    return run


def root_cuts(inp: DataFrame, p: ForestParams, n_features: int) -> DataFrame:
    """M8a-d: (tree, k, cut, cut_stat), the first split of each of ``p.ntree`` trees of each cohort: drawn and searched in a
    task where it can hold a cohort's rows, else by :func:`node_stats` and :func:`best_cut`, ``p.tree_batch`` trees at a time."""
    inp = _with_cohort(inp)
    largest, cohorts = inp.groupBy("cohort").count().agg(F.max("count"), F.max("cohort") + 1).first()
    if not largest or (largest <= p.subtree_rows and dict(inp.dtypes)["id"] in ("bigint", "int")):
        return by_chunks(inp, cohorts or 0, p.ntree, "tree int, k int, cut double, cut_stat double",
                         _root_cuts(replace(p, max_depth=1), n_features), p)
    about, bounds, parts = centre(inp, n_features), value_blocks(inp, n_features, p.blocks), []
    for t0 in range(0, p.ntree, p.tree_batch):
        m, path = write_stage(root_rows(inp, range(t0, min(p.ntree, t0 + p.tree_batch)), p).where("bag")
                              .withColumn("node", F.lit(1).cast("bigint")), "root-rows")
        spent = [path]
        var = select_variable(node_stats(m, n_features, about, p.ntree), n_features, p)
        parts.append(cut_lineage(best_cut(m, var, p.minbucket, bounds, spent).select("tree", "k", "cut", "cut_stat"), "root-cuts"))
        for path in spent:
            drop_path(inp.sparkSession, path)
    return _union(parts)


def tree_nodes(f: Forest) -> DataFrame:
    """(tree, node, k, cut, n, sy): splits and leaves in one table; k is -1 at a leaf."""
    zero = F.lit(0.0)
    return (f.splits.select("tree", "node", "k", "cut", F.lit(0).cast("bigint").alias("n"), zero.alias("sy"))
            .unionByName(f.leaves.select("tree", "node", F.lit(-1).alias("k"), zero.alias("cut"), "n", "sy")))


def chunk_trees(trees: range, nodes: pa.Table) -> Iterator[tuple[int, subtree.Tree]]:
    """The trees of a chunk's nodes, with their numbers."""
    of = nodes.column("tree").to_numpy()
    order = np.argsort(of, kind="stable")
    of, columns = of[order], [nodes.column(c).to_numpy()[order] for c in ("node", "k", "cut", "n", "sy")]
    for t in trees:
        a, b = np.searchsorted(of, (t, t + 1))
        if a < b:
            yield t, subtree.Tree(*[c[a:b] for c in columns])


def _each_tree(p: ForestParams, n_features: int, visit):
    """``visit`` for each of a chunk's trees: its number, the tree, the cohort's x, y and ids, and whether each row is in
    the tree's subsample, drawn anew."""
    def run(cohort: int, trees: range, rows: pa.Table, nodes: pa.Table) -> Iterator[pa.Table]:
        x, y, ids = _values(rows, n_features), rows.column("y").to_numpy(), _ids(rows).to_numpy()
        text = subtree.digits(ids)
        for t, tree in chunk_trees(trees, nodes):
            yield from visit(t, tree, x, y, ids, subtree.draw(t, ids, p, text))
    return run


def each_tree(f: Forest, inp: DataFrame, schema: str, visit) -> DataFrame:
    """The tables that ``visit`` gives for each tree of a forest whose cohorts one task holds (see :func:`_each_tree`)."""
    p, inp = f.params, _with_cohort(inp)
    return by_chunks(inp, f.cohorts, f.trees or p.ntree, schema, _each_tree(p, len(f.features), visit), p, tree_nodes(f))


def _member(t, tree, x, y, ids, bag) -> Iterator[pa.Table]:
    yield pa.table({"tree": pa.array(np.full(len(y), t), pa.int32()), "id": ids, "node": tree.node[tree.leaf(x)], "bag": bag, "y": y})


def drawn_members(f: Forest) -> DataFrame:
    """(tree, id, node, bag, y) of the rows in each tree, drawn and routed anew whenever they are read; they aren't kept."""
    return each_tree(f, f.rows, f"tree int, id {dict(f.rows.dtypes)['id']}, node bigint, bag boolean, y double", _member)


def finish_subtrees(m: DataFrame, p: ForestParams, n_features: int, path: str) -> DataFrame:
    """Write the finished subtrees of all (tree, node) groups of ``m`` to ``path``, a folder for each kind of row."""
    spark = m.sparkSession
    ship_package(spark)
    schema = GROWN.format(id=dict(m.dtypes)["id"])
    (m.groupBy("tree", "node").applyInArrow(_finish(p, n_features), schema)
     .write.partitionBy("kind").parquet(path))
    return spark.read.schema(schema).parquet(path)


def _columns(grown: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (grown.where("kind = 0").select("tree", "node", "k", "cut", "depth"),
            grown.where("kind = 1").select("tree", "node", "n", "sy"),
            grown.where("kind = 2").select("tree", "id", "node", "bag", "y"))


def grow_levels(m: DataFrame, p: ForestParams, n_features: int, about: Centre, bounds: list[list[float]],
                spent: list[str]) -> tuple[list, list, list, DataFrame]:
    """Grow the nodes of more than ``p.subtree_rows`` rows of ``m`` level by level.

    Returns lists of splits, leaves and members of what ended on the way, and the rows of the nodes left, each of
    which one task can finish; ``spent`` gathers the tables to drop."""
    splits, leaves, members, left = [], [], [], []
    keep = ["tree", "node", "id", "y", "xs", "bag"]
    for depth in range(p.max_depth + 1):
        m, path = write_stage(m.select(*keep), "level-rows")
        spent.append(path)
        large, path = write_stage(m.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("rows"))
                                  .where(F.col("rows") > p.subtree_rows).select("tree", "node"), "level-nodes")
        spent.append(path)
        if large.isEmpty():
            return splits, leaves, members, _union([*left, m])
        left.append(m.join(large, ["tree", "node"], "left_anti"))
        m = m.join(large, ["tree", "node"], "left_semi")
        bag = m.where("bag")
        stats = node_stats(bag, n_features, about, p.ntree)
        if depth == p.max_depth:
            if p.max_depth >= MAX_LEVELS:
                raise ValueError(f"a tree is deeper than {MAX_LEVELS} levels: node ids end there")
            here, ended = None, m
        else:
            cuts = best_cut(bag, select_variable(stats, n_features, p), p.minbucket, bounds, spent)
            here, path = write_stage(cuts.select("tree", "node", "k", "cut", F.lit(depth).alias("depth")), "level-splits")
            spent.append(path)
            splits.append(here)
            stats, ended = (d.join(here, ["tree", "node"], "left_anti") for d in (stats, m))
        leaves.append(stats.select("tree", "node", "n", "sy"))
        members.append(ended.select("tree", "id", "node", "bag", "y"))
        if here is None:
            break
        m = m.join(here, ["tree", "node"]).withColumn(
            "node", child(F.col("node"), F.col("xs")[F.col("k")], F.col("cut")))
    return splits, leaves, members, _union(left)


def grow(inp: DataFrame, p: ForestParams, features: Sequence[str]) -> Forest:
    """M8e: grow ``p.ntree`` trees of each cohort, all at once where a task can hold a cohort's rows, else ``p.tree_batch``
    trees of each at a time."""
    n_features = len(features)
    given = _with_cohort(inp)
    inp, path = write_stage(given, "forest-input")
    spark, spent = inp.sparkSession, [path]
    largest, cohorts = inp.groupBy("cohort").count().agg(F.max("count"), F.max("cohort") + 1).first()
    largest = largest or 0
    levels = largest > p.subtree_rows
    if not levels and largest > 0 and dict(inp.dtypes)["id"] in ("bigint", "int"):
        nodes = grow_whole(inp, p, n_features, cohorts, scratch_path(spark, "nodes"))
        drop_path(spark, path)
        splits = nodes.where("k IS NOT NULL").select("tree", "node", "k", "cut", "depth")
        leaves = nodes.where("k IS NULL").select("tree", "node", "n", "sy")
        f = Forest(splits, leaves, tuple(features), p, _deepest(splits), None, largest, given, cohorts)
        return replace(f, members=drawn_members(f))
    about, bounds = (centre(inp, n_features), value_blocks(inp, n_features, p.blocks)) if levels else (None, None)
    parts: tuple[list, list, list] = ([], [], [])
    for t0 in range(0, p.ntree, p.tree_batch):
        trees = range(t0, min(p.ntree, t0 + p.tree_batch))
        drawn, path = write_stage(draw(inp, trees, p), "draw")
        spent.append(path)
        m = root_rows(inp, trees, p, drawn).withColumn("node", F.lit(1).cast("bigint"))
        if levels:
            *ended, m = grow_levels(m, p, n_features, about, bounds, spent)
            for part, more in zip(parts, ended):
                part += more
        path = scratch_path(spark, "members")
        grown = finish_subtrees(m, p, n_features, path)
        if levels:
            spent.append(path)
        for part, more in zip(parts, _columns(grown)):
            part.append(more)
    splits, leaves = (cut_lineage(_union(part), name) for part, name in zip(parts, ("splits", "leaves")))
    # finished subtrees' members stay where they were written; those that ended on a level are copied there
    members = _union(parts[2]) if not levels else cut_lineage(_union(parts[2]), "members")
    depth = _deepest(splits)
    for path in spent:
        drop_path(spark, path)
    return Forest(splits, leaves, tuple(features), p, depth, members, largest)


def _deepest(splits: DataFrame) -> int:
    deepest = splits.agg(F.max("depth")).first()[0]
    return 0 if deepest is None else deepest + 1


def grow_forest(inp: DataFrame, p: ForestParams, n_features: int) -> tuple[DataFrame, DataFrame, int]:
    """Splits, leaves and depth alone, of features without names."""
    f = grow(inp, p, [f"x{k}" for k in range(n_features)])
    spent = {x.rsplit("/kind=", 1)[0].rsplit("/part-", 1)[0] for x in (f.members if f.rows is None else f.splits).inputFiles()}
    splits, leaves = (f.splits, f.leaves) if f.rows is None else (cut_lineage(f.splits, "splits"), cut_lineage(f.leaves, "leaves"))
    for path in spent:
        drop_path(inp.sparkSession, path)
    return splits, leaves, f.depth


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def fit_forest(cohort: DataFrame, features: Sequence[str], target: str,
               p: ForestParams | None = None) -> Forest:
    return grow(forest_input(cohort, features, target), p or ForestParams(), features)


# --- M8f: routing and prediction -----------------------------------------------------------

def route(state: DataFrame, splits: DataFrame, depth: int, lineage_every: int = 8) -> DataFrame:
    """Send (tree, <row key>, node, xs) rows down their trees: one left join with
    the splits per level; a row whose node has no split has reached its leaf and
    passes through unchanged.  Every ``lineage_every`` levels the rows are
    written to shared storage and the finished ones are set aside, so only
    active rows travel further and the plan stays a short linear chain."""
    cur, done = state, []
    sp = splits.select("tree", "node", F.col("k").alias("_sk"), F.col("cut").alias("_cut"))
    for level in range(depth):
        nxt = (cur.join(sp, ["tree", "node"], "left")
               .withColumn("_leaf", F.col("_sk").isNull())
               .withColumn("node", F.when(F.col("_leaf"), F.col("node")).otherwise(
                   child(F.col("node"), F.col("xs")[F.col("_sk")], F.col("_cut"))))
               .drop("_sk", "_cut"))
        if (level + 1) % lineage_every == 0 and level + 1 < depth:
            written = cut_lineage(nxt, "route")
            done.append(written.filter(F.col("_leaf")).drop("_leaf"))
            cur = written.filter(~F.col("_leaf")).drop("_leaf")
        else:
            cur = nxt.drop("_leaf")
    return _union(done + [cur])


def predict_forest(f: Forest, rows: DataFrame, key: str = "id") -> DataFrame:
    """Forest prediction per row: sum of leaf target sums / sum of leaf counts over
    trees (observation-weight averaging).  ``rows`` carries ``key`` and ``xs``."""
    state = _tree_rows(rows.select(key, "xs"), range(f.params.ntree)).withColumn(
        "node", F.lit(1).cast("bigint"))
    leaf = route(state, f.splits, f.depth).join(f.leaves, ["tree", "node"])
    return leaf.groupBy(key).agg((F.sum("sy") / F.sum("n")).alias("pred"))


def _at_leaves(members: DataFrame, f: Forest) -> DataFrame:
    """Members with their leaf's n and sy.  A merge join: leaves grow with the input, and a table of them that is small
    enough to broadcast as a file is some sixteen times larger in the driver's memory."""
    return members.join(f.leaves.hint("merge"), ["tree", "node"])


def _chunk_sums(p: ForestParams, n_features: int):
    """Each row's sums over a chunk's trees of its leaves' target sums and counts."""
    def run(cohort: int, trees: range, rows: pa.Table, nodes: pa.Table) -> Iterator[pa.Table]:
        x, ids = _values(rows, n_features), _ids(rows)
        sy, n = np.zeros((2, len(x)))
        for _, tree in chunk_trees(trees, nodes):
            leaf = tree.leaf(x)
            sy += tree.sy[leaf]
            n += tree.n[leaf]
        yield pa.table({"cohort": pa.array(np.full(len(x), cohort), pa.int32()), "id": ids, "sy": sy, "n": n})
    return run


def predict_members(f: Forest) -> DataFrame:
    """(cohort, id, pred) of the rows that the forest was grown from: sums over a chunk's trees, added up over the chunks, or
    read from the forest's members without routing."""
    if f.rows is not None:
        sums = by_chunks(f.rows, f.cohorts, f.trees or f.params.ntree,
                         f"cohort int, id {dict(f.rows.dtypes)['id']}, sy double, n double",
                         _chunk_sums(f.params, len(f.features)), f.params, tree_nodes(f))
        return sums.groupBy("cohort", "id").agg((F.sum("sy") / F.sum("n")).alias("pred"))
    leaf = _at_leaves(f.members.select("tree", "id", "node"), f)
    return (leaf.groupBy(cohort_of(F.col("tree"), f.params).alias("cohort"), "id")
            .agg((F.sum("sy") / F.sum("n")).alias("pred")))


# --- M9: out-of-bag error --------------------------------------------------------------------

def _tree_error(t, tree, x, y, ids, bag) -> Iterator[pa.Table]:
    out = np.flatnonzero(~bag)
    if len(out):
        leaf = tree.leaf(x[out])
        error = y[out] - tree.sy[leaf] / tree.n[leaf]
        yield pa.table({"tree": pa.array([t], pa.int32()), "n_oob": [len(out)], "oob_mse": [float((error * error).mean())]})


def oob_error(f: Forest, inp: DataFrame | None = None) -> DataFrame:
    """Per tree: mean squared error of the tree's leaf mean on its out-of-bag rows, read from the forest's
    members, or, where a task holds a cohort, its rows drawn and routed there; for a forest stored without either, the rows of
    ``inp`` are routed."""
    if f.rows is not None:
        return each_tree(f, f.rows, "tree int, n_oob bigint, oob_mse double", _tree_error)
    if f.members is not None:
        leaf = _at_leaves(f.members.where(~F.col("bag")).select("tree", "node", "y"), f)
    else:
        oob = root_rows(inp, range(f.params.ntree), f.params).where(~F.col("bag"))
        leaf = route(oob.withColumn("node", F.lit(1).cast("bigint")), f.splits, f.depth).join(f.leaves, ["tree", "node"])
    err = F.col("y") - F.col("sy") / F.col("n")
    return leaf.groupBy("tree").agg(F.count(F.lit(1)).alias("n_oob"),
                                    F.avg(err * err).alias("oob_mse"))
