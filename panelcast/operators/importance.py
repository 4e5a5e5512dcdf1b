"""Conditional permutation importance of a fitted forest (Strobl et al. 2008;
Debeer & Strobl 2020), as DataFrame jobs.

For a tree t and a feature j used by t:
* Z_j = features whose association with j passes the threshold
  (1 - p > threshold, i.e. c = (n - 1) corr^2 above the chi-square(1) quantile),
  screened once on the learning sample from one aggregate;
* the conditioning cells are the intervals cut by t's own split points on the
  features of Z_j that t uses;
* x_j is permuted among t's out-of-bag rows within each cell (seeded);
* importance(t, j) = MSE(permuted) - MSE(original) over t's out-of-bag rows.
A feature that t never splits on scores 0.

A tree whose rows one task can hold (``ForestParams.subtree_rows``) is done by one task, from its
out-of-bag members with their stored leaves (:mod:`.subtree`).  Beyond that the same steps are
DataFrame jobs: intervals come from a merge-rank join, which holds no list of cuts; permutation groups can be as
large as a tree's whole out-of-bag sample, so ranks within a group are taken in two levels over blocks of a
seeded hash; the result is the same full permutation whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chi2_1_quantile, round_half_away
from ..session import cut_lineage, drop_path, ship_package, write_stage
from . import subtree
from .forest import (Forest, _values, _with_cohort, association, centre, child, cohort_of, each_tree, hash32,
                     root_rows, route, tree_nodes, value_blocks, with_block)

__all__ = ["association_pairs", "cells", "cells_fast", "conditional_importance", "conditioning_sets", "per_tree_wide",
           "permute_within", "subtree_features", "tree_features"]


def association_pairs(inp: DataFrame, features: Sequence[str], threshold: float = 0.80) -> DataFrame:
    """(feature, other, stat, conditioned) for every ordered pair, from one aggregate
    over the rows where neither feature is NULL; with a ``cohort`` column first if ``inp`` has one.

    stat = (n - 1) corr(x_j, x_k)^2; conditioned = stat > chi-square(1) quantile
    of ``threshold`` (0.80 -> 1.642374, 0.90 -> 2.705543, 0.95 -> 3.841459).

    Sums of differences from the means: features without NULL share them (a Gram matrix, in generated code); a
    pair with a NULL somewhere takes variances and covariance of its own rows."""
    p, by = len(features), [c for c in ("cohort",) if c in inp.columns]
    about = centre(inp.select(*by, "xs", F.lit(0.0).alias("y")), p)
    x = [F.col("xs")[i] for i in range(p)]
    dx = [x[i] - about.of(i + 1, F.col("cohort") if by else None) for i in range(p)]
    pairs = [(i, k) for i in range(p) for k in range(i + 1, p)]
    whole = {(i, k) for i, k in pairs if about.full[i] and about.full[k]}
    used = sorted({i for pair in whole for i in pair})
    sums = [F.count(F.lit(1)).alias("n")]
    for i in used:
        sums += [F.sum(dx[i]).alias(f"s{i}"), F.sum(dx[i] * dx[i]).alias(f"q{i}"),
                 (F.max(x[i]) > F.min(x[i])).alias(f"v{i}")]
    for i, k in pairs:
        if (i, k) in whole:
            sums.append(F.sum(dx[i] * dx[k]).alias(f"c{i}_{k}"))
        else:
            both = x[i].isNotNull() & x[k].isNotNull()
            sums.append(F.struct(F.count(F.when(both, F.lit(1))).alias("n"), F.var_pop(F.when(both, x[i])).alias("va"),
                                 F.var_pop(F.when(both, x[k])).alias("vb"), F.covar_pop(x[i], x[k]).alias("c"))
                        .alias(f"c{i}_{k}"))
    m = inp.groupBy(*by).agg(*sums) if by else inp.agg(*sums)

    def variance(i: int) -> Column:
        return F.when(F.col(f"v{i}"), F.col(f"q{i}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) ** 2).otherwise(F.lit(0.0))

    def moments(i: int, k: int) -> Column:
        if (i, k) not in whole:
            return F.col(f"c{i}_{k}")
        cov = F.col(f"c{i}_{k}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{k}") / F.col("n")
        return F.struct(F.col("n"), variance(i).alias("va"), variance(k).alias("vb"), cov.alias("c"))
    m = m.where("n > 0").select(*by, F.array(*[moments(i, k) for i, k in pairs]).alias("m"))
    # one row per ordered pair: (k, z, index of the unordered pair's moments)
    at = {pair: t for t, pair in enumerate(pairs)}
    rows = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(features[i]).alias("feature"), F.lit(k).alias("z"),
                              F.lit(features[k]).alias("other"), F.lit(at[min(i, k), max(i, k)]).alias("t"))
                     for i in range(p) for k in range(p) if i != k])
    e = m.select(*by, "m", F.explode(rows).alias("r")).select(*by, "r.*", F.col("m")[F.col("r.t")].alias("v"))
    stat = association(F.col("v.n"), F.col("v.va"), F.col("v.vb"), F.col("v.c"))
    out = e.select(*by, "k", "feature", "z", "other", round_half_away(stat, 6).alias("stat"))
    return out.withColumn("conditioned", F.col("stat") > F.lit(chi2_1_quantile(threshold)))


def tree_features(f: Forest) -> DataFrame:
    """(tree, k, cuts): the sorted distinct split points of each feature in each tree."""
    return f.splits.groupBy("tree", "k").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))


def conditioning_sets(f: Forest, pairs: DataFrame) -> DataFrame:
    """(tree, k, zc): for each feature k used by a tree, the tree's cut lists of the
    features it is conditioned on (those the tree also uses)."""
    used = tree_features(f)
    z = (used.select("tree", F.col("k").alias("z"), "cuts")
         .join(pairs.filter("conditioned").select("k", "z"), "z"))
    zc = z.groupBy("tree", "k").agg(F.array_sort(F.collect_list(F.struct("z", "cuts"))).alias("zc"))
    return (used.select("tree", "k").join(zc, ["tree", "k"], "left")
            .select("tree", "k", F.coalesce("zc", F.array().cast(
                "array<struct<z:int,cuts:array<double>>>")).alias("zc")))


def cells(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Cell key per (tree, k, row): for each conditioning feature the number of
    the tree's cut points below the row's value, joined by ','."""
    j = rows.join(sets, "tree")
    idx = F.transform(F.col("zc"), lambda e: F.size(
        F.filter(e["cuts"], lambda c: F.col("xs")[e["z"]] > c)).cast("string"))
    return j.withColumn("cell", F.concat_ws(",", idx)).drop("zc")


def _with_pair_cohort(pairs: DataFrame) -> DataFrame:
    return _with_cohort(pairs.filter("conditioned")).select("cohort", "k", "z")


def cut_ranks(rows: DataFrame, cuts: DataFrame, bounds: Sequence[Sequence[float]]) -> DataFrame:
    """(tree, z, x, idx): for each distinct value x of feature z among a tree's ``rows`` (tree, z, x), the number of the
    tree's ``cuts`` (tree, z, x) below it.

    A merge-rank join: cuts and values are one sorted stream, in which a value's rank is the number of cuts before it.
    The stream of a (tree, z) is dealt out by value ranges (``bounds``, per feature), so a window holds the cuts and distinct
    values of one range; the cuts of the ranges before come from a prefix over one count a range."""
    both = (rows.select("tree", "z", "x").where("x IS NOT NULL").distinct().withColumn("cut", F.lit(0))
            .unionByName(cuts.select("tree", "z", "x").withColumn("cut", F.lit(1))))
    both = cut_lineage(with_block(both, "z", bounds), "cut-stream")   # read twice
    per = both.groupBy("tree", "z", "blk").agg(F.sum("cut").alias("m"))
    before = F.sum("m").over(Window.partitionBy("tree", "z").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("tree", "z", "blk", F.coalesce(before, F.lit(0)).alias("before"))
    # a value stands before the cut that equals it
    here = Window.partitionBy("tree", "z", "blk").orderBy("x", "cut").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("here", F.sum("cut").over(here)).where("cut = 0").join(per, ["tree", "z", "blk"])
            .select("tree", "z", "x", (F.col("before") + F.col("here")).cast("int").alias("idx")))


def cells_fast(rows: DataFrame, f: Forest, pairs: DataFrame, bounds: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """M10b, the plan used at scale: same cell keys as :func:`cells`, without a list of cuts anywhere.

    ``rows``: (tree, id, xs).  The interval of a row on a conditioning feature is the rank of its value among the
    tree's cuts (:func:`cut_ranks`); the intervals of each feature's conditioning set are gathered by one aggregate per
    (tree, k, row), of as many entries as there are features at most."""
    bounds = value_blocks(rows, len(f.features), f.params.blocks) if bounds is None else bounds
    cuts = f.splits.select("tree", F.col("k").alias("z"), F.col("cut").alias("x")).distinct()
    used = cuts.select("tree", "z").distinct()
    given = (used.withColumn("cohort", cohort_of(F.col("tree"), f.params)).join(_with_pair_cohort(pairs), ["cohort", "z"])
             .select("tree", "z", "k"))
    p = len(f.features)
    long = (rows.select("tree", "id", F.posexplode(F.array(*[F.col("xs")[z] for z in range(p)])).alias("z", "x"))
            .join(used, ["tree", "z"]))
    ranked = (long.join(cut_ranks(long, cuts, bounds), ["tree", "z", "x"], "left")
              .select("tree", "z", "id", F.coalesce("idx", F.lit(0)).alias("idx")))   # NULL is above no cut
    parts = (ranked.join(given, ["tree", "z"]).join(used.withColumnRenamed("z", "k"), ["tree", "k"])
             .groupBy("tree", "k", "id").agg(F.array_sort(F.collect_list(F.struct("z", "idx"))).alias("_zi"))
             .select("tree", "k", "id", F.concat_ws(",", F.transform(
                 "_zi", lambda e: e["idx"].cast("string"))).alias("cell")))
    features = used.groupBy("tree").agg(F.collect_set("z").alias("_ks"))
    base = rows.join(features, "tree").withColumn("k", F.explode("_ks")).drop("_ks")
    return (base.join(parts, ["tree", "k", "id"], "left")
            .withColumn("cell", F.coalesce("cell", F.lit(""))))


def _rank(df: DataFrame, keys: Sequence[str], h, tie: str, out: str, bits: int) -> DataFrame:
    """``out``: the row's place in its group (``keys``, NULL-safe) by the 32-bit hash ``h`` and ``tie``.

    The top ``bits`` of the hash are blocks in order: counts before the block plus the place in the
    block.  A window holds one block of a group, or one group's at most 2^bits block counts."""
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 32 - bits))
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    prefix = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_pb"),
                           F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_pb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", tie))
    return (d.withColumn("_p", place).join(prefix, same)
            .withColumn(out, F.col("_before") + F.col("_p"))
            .drop("_h", "_b", "_p", "_pb", "_before", *[f"_k{i}" for i in range(len(keys))]))


def permute_within(df: DataFrame, keys: Sequence[str], col: str, order: str, seed: int,
                   bits: int = 6, out: str | None = None) -> DataFrame:
    """Seeded permutation of ``col`` within groups ``keys`` (NULL is a group like any other).

    Rows are ranked by two independent seeded hashes of (keys, ``order``); a row takes the value of
    the row whose second rank equals its first.  One rule for every group size: 2^``bits`` blocks
    only say how the ranks are computed."""
    out = out or f"{col}_perm"
    keys = list(keys)
    parts = [*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col(order)]
    a = _rank(df, keys, hash32(seed, "o", *parts), order, "_r", bits)
    b = _rank(df.select(*keys, order, F.col(col).alias(out)), keys, hash32(seed, "p", *parts), order, "_q", bits)
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_q"), out)
    same = F.col("_r") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return a.join(b, same).drop("_r", "_q", *[f"_k{i}" for i in range(len(keys))])


def subtree_features(f: Forest) -> DataFrame:
    """(tree, node, _below): the features split on at or below the node.  Every split names its
    feature to itself and its ancestors (node >> d); one aggregate over splits x depth rows, an
    array of as many entries as there are features at most."""
    anc = f.splits.select("tree", "node", "k", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    return (anc.select("tree", F.expr("shiftright(node, d)").alias("node"), "k")
            .groupBy("tree", "node").agg(F.collect_set("k").alias("_below")))


def _route_permuted(f: Forest, state: DataFrame, lineage_every: int = 8) -> DataFrame:
    """Route (tree, k, id, xs, xk0, node, same) rows where x_k is already permuted in
    ``xs`` and ``xk0`` is the original value.  A row still on its original path
    (``same``) whose current subtree never splits on k must end in its original
    leaf, so it is dropped here (it adds 0 to the importance); other rows
    continue.  Returns the finished rows that left the original path."""
    sp = cut_lineage(f.splits.select("tree", "node", F.col("k").alias("_sk"), F.col("cut").alias("_cut"))
                     .join(subtree_features(f), ["tree", "node"]), "perm-splits")
    cur = state
    for level in range(f.depth):
        j = cur.join(sp, ["tree", "node"], "left")
        k_below = F.array_contains(F.col("_below"), F.col("k"))
        j = j.filter(~F.col("same") | F.coalesce(k_below, F.lit(False)))
        split = F.col("_sk").isNotNull()
        x = F.col("xs")[F.col("_sk")]
        def right(v):
            return F.coalesce(v > F.col("_cut"), F.lit(False))     # a NULL value goes left
        diverge = (F.col("_sk") == F.col("k")) & (right(F.col("xk0")) != right(x))
        nxt = j.select(
            "tree", "k", "id", "y", "xs", "xk0",
            F.when(split, child(F.col("node"), x, F.col("_cut"))).otherwise(F.col("node")).alias("node"),
            (F.col("same") & ~F.coalesce(diverge, F.lit(False))).alias("same"))
        cur = cut_lineage(nxt, "perm-route") if (level + 1) % lineage_every == 0 else nxt
    return cur.filter(~F.col("same"))


def out_of_bag(f: Forest, inp: DataFrame) -> DataFrame:
    """(cohort, tree, id, y, xs, node) of every tree's out-of-bag rows, each with its leaf: the forest's members
    with the rows' features, or, for a forest stored without members, the rows routed."""
    inp = _with_cohort(inp)
    if f.members is None:
        rows = root_rows(inp, range(f.params.ntree), f.params).where(~F.col("bag")).drop("bag")
        return route(rows.withColumn("node", F.lit(1).cast("bigint")), f.splits, f.depth)
    return (f.members.where(~F.col("bag")).select(cohort_of(F.col("tree"), f.params).alias("cohort"), "tree", "id", "node")
            .join(inp.select("cohort", "id", "y", "xs"), ["cohort", "id"]))


def _tree_importance(conditioned: dict[int, dict[int, list[int]]], n_features: int, ntree: int, seed: int):
    """Cogroups (out-of-bag rows, nodes) of a tree to its features' importances."""
    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return pa.table({"tree": pa.array([], pa.int32()), "k": pa.array([], pa.int32()),
                             "value": pa.array([], pa.float64())})
        tree_id = rows.column("tree")[0].as_py()
        node, k, cut, n, sy = (nodes.column(c).to_numpy() for c in ("node", "k", "cut", "n", "sy"))
        value = subtree.importance(
            tree_id, subtree.Tree(node, k, cut, n, sy), _values(rows, n_features), rows.column("y").to_numpy(),
            rows.column("node").to_numpy(), rows.column("id").to_numpy(), conditioned.get(tree_id // ntree, {}), seed)
        return pa.table({"tree": pa.array(np.full(n_features, tree_id), pa.int32()),
                         "k": pa.array(np.arange(n_features), pa.int32()), "value": pa.array(value)})
    return run


def _conditioned(pairs: DataFrame) -> dict[int, dict[int, list[int]]]:
    """Cohort -> feature -> the features it is conditioned on; as many rows as there are ordered pairs, for each cohort."""
    out: dict[int, dict[int, list[int]]] = {}
    for r in _with_pair_cohort(pairs).orderBy("cohort", "k", "z").collect():
        out.setdefault(r.cohort, {}).setdefault(r.k, []).append(r.z)
    return out


def _importance_of(conditioned: dict[int, dict[int, list[int]]], n_features: int, ntree: int, seed: int):
    """A visit of :func:`.forest.each_tree`: the tree's importances."""
    def visit(t, tree, x, y, ids, bag):
        out = np.flatnonzero(~bag)
        if len(out):
            z = x[out]
            value = subtree.importance(t, tree, z, y[out], tree.node[tree.leaf(z)], ids[out], conditioned.get(t // ntree, {}), seed)
            yield pa.table({"tree": pa.array(np.full(n_features, t), pa.int32()),
                            "k": pa.array(np.arange(n_features), pa.int32()), "value": value})
    return visit


def _cells_of(conditioned: dict[int, dict[int, list[int]]], ntree: int):
    """A visit of :func:`.forest.each_tree`: the cell of every out-of-bag row for every feature that the tree uses."""
    def visit(t, tree, x, y, ids, bag):
        out = np.flatnonzero(~bag)
        z, own = x[out], pa.array(ids[out])
        for k, keys in subtree.cell_keys(tree, z, conditioned.get(t // ntree, {})).items() if len(out) else ():
            yield pa.table({"tree": pa.array(np.full(len(out), t), pa.int32()), "k": pa.array(np.full(len(out), k), pa.int32()),
                            "id": own, "cell": keys})
    return visit


def out_of_bag_cells(f: Forest, inp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree, k, id, cell) of every out-of-bag row: by tree where a task holds a cohort, else by :func:`cells_fast`."""
    if f.rows is not None:
        schema = f"tree int, k int, id {dict(inp.dtypes)['id']}, cell string"
        return each_tree(f, inp, schema, _cells_of(_conditioned(pairs), f.params.ntree))
    return (cells_fast(out_of_bag(f, inp).select("tree", "id", "xs"), f, pairs, value_blocks(inp, len(f.features), f.params.blocks))
            .select("tree", "k", "id", "cell"))


def importance_by_tree(f: Forest, inp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree, k, value), a tree by one task; its out-of-bag rows fit into one."""
    ship_package(inp.sparkSession)
    conditioned, p = _conditioned(pairs), f.params
    if f.rows is not None:
        return each_tree(f, inp, "tree int, k int, value double", _importance_of(conditioned, len(f.features), p.ntree, p.seed))
    rows = out_of_bag(f, inp).select("tree", "id", "node", "y", "xs")
    return (rows.groupBy("tree").cogroup(tree_nodes(f).groupBy("tree"))
            .applyInArrow(_tree_importance(conditioned, len(f.features), f.params.ntree, f.params.seed),
                          "tree int, k int, value double"))


def importance_by_joins(f: Forest, inp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree, k, value) of the features that move a row, for trees of any size.

    Only rows whose permuted value leads them off their original path can contribute, and only those are
    routed to the end."""
    p, spark = f.params, inp.sparkSession
    rows, rows_path = write_stage(out_of_bag(f, inp), "perm-rows")
    base, base_path = write_stage(
        rows.join(f.leaves, ["tree", "node"])
        .select("tree", "id", ((F.col("y") - F.col("sy") / F.col("n")) ** 2).alias("e0")), "perm-base")
    n_oob = base.groupBy("tree").agg(F.count(F.lit(1)).alias("n_oob"))
    c = cells_fast(rows.select("tree", "id", "y", "xs"), f, pairs).withColumn("xk", F.col("xs")[F.col("k")])
    perm = permute_within(c, ["tree", "k", "cell"], "xk", "id", p.seed, out="xk_perm")
    st = perm.filter(~F.col("xk_perm").eqNullSafe(F.col("xk"))).select(
        "tree", "k", "id", "y", F.col("xk").alias("xk0"),
        F.transform("xs", lambda v, i: F.when(i == F.col("k"), F.col("xk_perm")).otherwise(v)).alias("xs"),
        F.lit(1).cast("bigint").alias("node"), F.lit(True).alias("same"))
    moved = (_route_permuted(f, st).join(f.leaves, ["tree", "node"])
             .select("tree", "k", "id", ((F.col("y") - F.col("sy") / F.col("n")) ** 2).alias("e1")))
    done = cut_lineage(
        moved.join(base, ["tree", "id"]).groupBy("tree", "k")
        .agg(F.sum(F.col("e1") - F.col("e0")).alias("dsum"))
        .join(n_oob, "tree").select("tree", "k", (F.col("dsum") / F.col("n_oob")).alias("value")), "perm")
    for spent in (rows_path, base_path):
        drop_path(spark, spent)
    return done


def conditional_importance(f: Forest, inp: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(tree, k, value) for every tree and feature (0 when the tree does not use k).

    value = mean over the tree's out-of-bag rows of (permuted error - original error)."""
    inp = _with_cohort(inp)
    pairs = association_pairs(inp, f.features, threshold)
    if f.members is not None and f.largest <= f.params.subtree_rows:
        per = importance_by_tree(f, inp, pairs)
    else:
        per = importance_by_joins(f, inp, pairs)
    trees = f.leaves.select("tree").distinct()
    grid = trees.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(len(f.features))])))
    return (grid.join(per, ["tree", "k"], "left")
            .select("tree", "k", F.coalesce("value", F.lit(0.0)).alias("value")))


def per_tree_wide(imp: DataFrame, features: Sequence[str]) -> DataFrame:
    """perTree matrix: one row per tree, one column per feature."""
    return (imp.groupBy("tree").pivot("k", list(range(len(features)))).agg(F.first("value"))
            .select("tree", *[F.col(str(i)).alias(name) for i, name in enumerate(features)]))

