"""Forest growth, prediction, permutation and partial dependence against
brute-force Python on a small fixture."""

import hashlib
import math
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.operators import forest, importance, pdp, subtree
from panelcast.spec import ForestParams

P = ForestParams(ntree=3, mtry=2, minsplit=20, minbucket=7, seed=7, blocks=8)
FEATS = ("a", "b", "c")


def fixture(spark, n=160):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 30, n)
    b = rng.integers(0, 5, n)
    c = rng.integers(0, 100, n)
    y = (a * 3 + (b == 2) * 40 + rng.integers(0, 10, n)).astype(float)
    rows = [(int(i), float(yy), [float(aa), float(bb), float(cc)]) for i, (yy, aa, bb, cc)
            in enumerate(zip(y, a, b, c))]
    return spark.createDataFrame(rows, "id long, y double, xs array<double>"), rows


def h32(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def r6(x):
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x) if x else 0.0


def brute_tree(rows, tree, p):
    ranked = sorted(rows, key=lambda r: (h32(p.seed, "s", tree, r[0]), r[0]))
    bag = ranked[:len(rows) * round(p.fraction * 1_000_000) // 1_000_000]
    splits, leaves = {}, {}

    def grow(node, rs, depth):
        n = len(rs)
        ys = np.array([r[1] for r in rs])
        if n < p.minsplit or depth >= p.max_depth:
            leaves[node] = (n, ys.sum()); return
        ks = sorted(range(len(FEATS)), key=lambda k: (h32(p.seed, "c", tree, node, k), k))[:p.mtry]
        best = None
        for k in ks:
            x = np.array([r[2][k] for r in rs])
            num = n * (x * ys).sum() - x.sum() * ys.sum()
            den = (n * (x * x).sum() - x.sum() ** 2) * (n * (ys * ys).sum() - ys.sum() ** 2)
            c = r6((n - 1) * num * num / den) if den > 0 else 0.0
            if best is None or c > best[0] or (c == best[0] and k < best[1]):
                best = (c, k)
        if best[0] <= 0:
            leaves[node] = (n, ys.sum()); return
        k = best[1]
        vals = sorted({r[2][k] for r in rs})
        S, Syy = ys.sum(), (ys * ys).sum()
        cut = None
        for v in vals:
            left = [r[1] for r in rs if r[2][k] <= v]
            nl, sl = len(left), sum(left)
            if nl < p.minbucket or n - nl < p.minbucket:
                continue
            den = nl * (n - nl) * (n * Syy - S * S)
            if den <= 0:
                continue
            c = r6((n - 1) * (n * sl - nl * S) ** 2 / den)
            if cut is None or c > cut[0]:
                cut = (c, v)
        if cut is None:
            leaves[node] = (n, ys.sum()); return
        splits[node] = (k, cut[1])
        grow(2 * node, [r for r in rs if r[2][k] <= cut[1]], depth + 1)
        grow(2 * node + 1, [r for r in rs if r[2][k] > cut[1]], depth + 1)

    grow(1, bag, 0)
    return splits, leaves


def brute_predict(trees, xs):
    s = n = 0.0
    for splits, leaves in trees:
        node = 1
        while node in splits:
            k, cut = splits[node]
            node = 2 * node + (1 if xs[k] > cut else 0)
        n += leaves[node][0]; s += leaves[node][1]
    return s / n


@pytest.fixture(scope="module")
def fitted(spark):
    inp, rows = fixture(spark)
    splits, leaves, depth = forest.grow_forest(inp, P, len(FEATS))
    f = forest.Forest(splits, leaves, FEATS, P, depth)
    trees = [brute_tree(rows, t, P) for t in range(P.ntree)]
    return f, inp, rows, trees


def test_forest_matches_brute_force(fitted):
    f, inp, rows, trees = fitted
    got = defaultdict(dict)
    for r in f.splits.collect():
        got[r.tree][r.node] = (r.k, r.cut)
    for t in range(P.ntree):
        assert got[t] == trees[t][0]
    lv = defaultdict(dict)
    for r in f.leaves.collect():
        lv[r.tree][r.node] = (r.n, r.sy)
    for t in range(P.ntree):
        assert lv[t] == {k: (v[0], float(v[1])) for k, v in trees[t][1].items()}


def test_leaf_counts_sum_to_subsample(fitted):
    f, inp, rows, trees = fitted
    sub = forest.subsample(inp, range(P.ntree), P).groupBy("tree").count()
    leaves = f.leaves.groupBy("tree").agg(F.sum("n").alias("n"))
    assert {r.tree: r["count"] for r in sub.collect()} == {r.tree: r.n for r in leaves.collect()}


def test_predict_matches_brute_force(fitted):
    f, inp, rows, trees = fitted
    got = {r.id: r.pred for r in forest.predict_forest(f, inp).collect()}
    for r in rows:
        assert got[r[0]] == pytest.approx(brute_predict(trees, r[2]))


def test_partial_dependence_matches_brute_force(fitted):
    f, inp, rows, trees = fitted
    got = {(r.feature, r.v): r.pd for r in pdp.partial_dependence(f, inp).collect()}
    for k, name in enumerate(FEATS):
        x = [r[2][k] for r in rows]
        ng = min(25, len(set(x)))
        lo, hi = min(x), max(x)
        for g in range(ng):
            v = lo + g * (hi - lo) / (ng - 1) if ng > 1 else lo
            want = np.mean([brute_predict(trees, [v if i == k else r[2][i] for i in range(3)]) for r in rows])
            key = min((kk for kk in got if kk[0] == name), key=lambda kk: abs(kk[1] - v))
            assert abs(key[1] - v) < 1e-9
            assert got[key] == pytest.approx(want)


def test_permutation_keeps_each_cell_multiset(spark):
    rows = [(i, i % 3, float(i * 7 % 11)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g int, x double")
    df = df.unionByName(df.limit(12).withColumn("g", F.lit(None).cast("int")).withColumn("id", F.col("id") + 1000))
    seen = set()
    for bits in (0, 3, 10):    # one answer, whatever the number of blocks
        out = importance.permute_within(df, ["g"], "x", "id", 11, bits=bits).collect()
        assert len(out) == 102
        seen.add(tuple(sorted((r.id, r.x_perm) for r in out)))
        assert len(seen) == 1
        assert sorted(r.x for r in out if r.g is None) == sorted(r.x_perm for r in out if r.g is None)
        for g in range(3):
            assert sorted(r.x for r in out if r.g == g) == sorted(r.x_perm for r in out if r.g == g)
        assert any(r.x != r.x_perm for r in out)


def test_importance_zero_for_unused_feature(fitted):
    f, inp, rows, trees = fitted
    imp = importance.conditional_importance(f, inp, 0.80).collect()
    used = {(t, k) for t, (s, _) in enumerate(trees) for (k, _) in s.values()}
    assert len(imp) == P.ntree * len(FEATS)
    for r in imp:
        if (r.tree, r.k) not in used:
            assert r.value == 0.0


def test_constant_feature_has_no_association(spark):
    rows = [(i, float(i % 7), [float(i % 5), 3.0, float(i)]) for i in range(40)]
    inp = spark.createDataFrame(rows, "id long, y double, xs array<double>")
    pairs = {(r.feature, r.other): r for r in importance.association_pairs(inp, FEATS, 0.80).collect()}
    assert pairs[("b", "a")].stat == 0.0 and not pairs[("b", "a")].conditioned
    assert pairs[("a", "c")].stat == pairs[("c", "a")].stat
    st = forest.node_stats(inp.withColumn("tree", F.lit(0)).withColumn("node", F.lit(1)), 3).first()
    c = spark.range(1).select(forest.association(F.lit(st.nk[1]), F.lit(st.vx[1]), F.lit(st.vy[1]),
                                                 F.lit(st.cxy[1]))).first()[0]
    assert c == 0.0


def test_large_offsets_do_not_cancel(spark):
    rows = [(i, float(i), [1e9 + i, 1e9 + (i * 37 % 101), float(i % 3)]) for i in range(1000)]
    inp = spark.createDataFrame(rows, "id long, y double, xs array<double>")
    st = forest.node_stats(inp.withColumn("tree", F.lit(0)).withColumn("node", F.lit(1)), 3)
    c = st.select(forest.association(F.col("nk")[0], F.col("vx")[0], F.col("vy")[0], F.col("cxy")[0])).first()[0]
    assert c == pytest.approx(999.0, rel=1e-6)
    pairs = {(r.feature, r.other): r.stat for r in importance.association_pairs(inp, FEATS, 0.8).collect()}
    x, z = np.arange(1000.0), np.array([i * 37 % 101 for i in range(1000)], float)
    assert pairs["a", "b"] == pytest.approx(999 * np.corrcoef(x, z)[0, 1] ** 2, abs=1e-4)


def test_null_features_take_no_part(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 3 == 0 else float(rng.integers(0, 20)) for i in range(300)]
    y = [50.0 if v is None else 10.0 * (v > 11) + float(rng.random()) for v in x]
    inp = spark.createDataFrame([(i, y[i], [x[i]]) for i in range(300)], "id long, y double, xs array<double>")
    p = ForestParams(ntree=1, mtry=1, minsplit=20, minbucket=7, seed=7, blocks=8)
    mx = inp.withColumn("tree", F.lit(0)).withColumn("node", F.lit(1).cast("bigint"))
    st = forest.node_stats(mx, 1)
    var = forest.select_variable(st, 1, p)
    seen = [(a, b) for a, b in zip(x, y) if a is not None]
    want = (len(seen) - 1) * np.corrcoef(*np.array(seen).T)[0, 1] ** 2
    assert var.first().n == len(seen) and var.first().stat == pytest.approx(want, abs=1e-5)
    assert forest.best_cut(mx, var, 7, forest.value_blocks(inp, 1, 8)).first().cut == 11.0
    splits, leaves, depth = forest.grow_forest(inp, p, 1)
    assert depth < 12 and splits.where("cut IS NULL").isEmpty()
    assert leaves.agg(F.sum("n")).first()[0] == forest.subsample(inp, range(1), p).count()


def test_subtree_features_beyond_sixty_four(spark):
    splits = spark.createDataFrame([(0, 1, 64, 1.0, 0), (0, 2, 0, 1.0, 1), (0, 5, 70, 1.0, 2)],
                                   "tree int, node bigint, k int, cut double, depth int")
    f = forest.Forest(splits, splits, tuple(f"x{i}" for i in range(71)), P, 3)
    got = {r.node: set(r._below) for r in importance.subtree_features(f).collect()}
    assert got == {1: {64, 0, 70}, 2: {0, 70}, 5: {70}}


def test_pruned_importance_equals_full_routing(fitted, spark):
    """Only rows that leave their original path are routed to the end; the result
    must equal routing every permuted out-of-bag row."""
    f, inp, rows, trees = fitted
    got = {(r.tree, r.k): r.value for r in importance.conditional_importance(f, inp, 0.80).collect()}
    p = f.params
    oob = forest.subsample(inp, range(p.ntree), p, oob=True).join(inp, "id")
    sets = importance.conditioning_sets(f, importance.association_pairs(inp, FEATS, 0.80))
    c = importance.cells(oob, sets).withColumn("xk", F.col("xs")[F.col("k")])
    perm = importance.permute_within(c, ["tree", "k", "cell"], "xk", "id", p.seed, out="xk_perm")
    leaf = {(r.tree, r.node): r.sy / r.n for r in f.leaves.collect()}

    def go(t, xs):
        node = 1
        sp = {(r.tree, r.node): (r.k, r.cut) for r in f.splits.collect()} if not hasattr(go, "sp") else go.sp
        go.sp = sp
        while (t, node) in sp:
            k, cut = sp[(t, node)]
            node = 2 * node + (1 if xs[k] > cut else 0)
        return leaf[(t, node)]
    n_oob = defaultdict(int)
    for r in oob.collect():
        n_oob[r.tree] += 1
    want = defaultdict(float)
    for r in perm.collect():
        xs = list(r.xs)
        e0 = (r.y - go(r.tree, xs)) ** 2
        xs[r.k] = r.xk_perm
        e1 = (r.y - go(r.tree, xs)) ** 2
        want[(r.tree, r.k)] += (e1 - e0) / n_oob[r.tree]
    for key, v in got.items():
        assert v == pytest.approx(want.get(key, 0.0), abs=1e-9)
    assert any(abs(v) > 0 for v in got.values())


def test_fast_cells_equal_reference_cells(fitted):
    f, inp, rows, trees = fitted
    pairs = importance.association_pairs(inp, FEATS, 0.0)     # threshold 0: condition on everything
    oob = forest.subsample(inp, range(P.ntree), P, oob=True).join(inp, "id")
    ref = {(r.tree, r.k, r.id): r.cell for r in
           importance.cells(oob, importance.conditioning_sets(f, pairs)).collect()}
    got = {(r.tree, r.k, r.id): r.cell for r in importance.cells_fast(oob, f, pairs).collect()}
    assert got == ref and any(v for v in got.values())


def test_value_ranges(spark):
    df = spark.createDataFrame([(k, x) for k in (0, 1) for x in (0.5, 1.0, 1.5, 5.0, 9.5)], "k int, x double")
    got = {(r.k, r.x): r.blk for r in forest.with_block(df, "k", [[1.0, 2.0, 5.0, 9.0], []]).collect()}
    assert [got[0, x] for x in (0.5, 1.0, 1.5, 5.0, 9.5)] == [0, 0, 1, 2, 4]
    assert {got[1, x] for x in (0.5, 9.5)} == {0}


def test_lineage_cuts_do_not_change_results(fitted):
    """Rows set aside at lineage cuts (every level here) give the same leaves."""
    f, inp, rows, trees = fitted
    state = forest._tree_rows(inp.select("id", "xs"), range(P.ntree)).withColumn("node", F.lit(1).cast("bigint"))
    a = sorted((r.tree, r.id, r.node) for r in forest.route(state, f.splits, f.depth, 1).collect())
    b = sorted((r.tree, r.id, r.node) for r in forest.route(state, f.splits, f.depth, 100).collect())
    assert a == b and len(a) == P.ntree * len(rows)
    pa = sorted((r.feature, r.v, round(r.pd, 9)) for r in pdp.partial_dependence(f, inp, [0], lineage_every=2).collect())
    pb = sorted((r.feature, r.v, round(r.pd, 9)) for r in pdp.partial_dependence(f, inp, [0], lineage_every=100).collect())
    assert pa == pb


def test_four_level_cells_are_several(spark):
    """The SQL twins of the conditional part compare real cells: most features of a tree have more than one."""
    from panelcast.plans import registry
    registry.load_all()
    df = registry.QUERIES["conditioning_cells_depth4"](spark, "/root/testdata/sf0.01")
    n = [r.c for r in df.groupBy("tree", "k").agg(F.countDistinct("cell").alias("c")).collect()]
    assert len(n) > 40 and sum(c > 1 for c in n) > 0.7 * len(n) and max(n) > 10


def by_levels(p):
    return replace(p, subtree_rows=45)


def table(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_subtree_completion_equals_growth_by_levels(spark):
    """Whole trees in one task, and large nodes level by level with small ones finished: one answer."""
    inp, _ = fixture(spark, 400)
    inp = inp.withColumn("xs", F.when(F.col("id") % 9 == 0, F.array(F.lit(None).cast("double"), F.col("xs")[1], F.col("xs")[2]))
                         .otherwise(F.col("xs")))
    for p in (P, replace(P, max_depth=2)):
        a, b = forest.grow(inp, p, FEATS), forest.grow(inp, by_levels(p), FEATS)
        assert a.depth == b.depth and a.splits.count() > 0
        assert table(a.splits, "tree", "node", "k", "cut", "depth") == table(b.splits, "tree", "node", "k", "cut", "depth")
        assert table(a.leaves, "tree", "node", "n", "sy") == table(b.leaves, "tree", "node", "n", "sy")
        assert table(a.members, "tree", "id", "node", "bag", "y") == table(b.members, "tree", "id", "node", "bag", "y")
        assert a.members.count() == P.ntree * 400


def test_members_give_predictions_and_errors_without_routing(fitted, spark):
    f, inp, rows, trees = fitted
    g = forest.grow(inp, P, FEATS)
    assert table(forest.predict_members(g), "id", "pred") == table(forest.predict_forest(f, inp), "id", "pred")
    assert table(forest.oob_error(g), "tree", "n_oob", "oob_mse") == table(forest.oob_error(f, inp), "tree", "n_oob", "oob_mse")
    assert table(importance.out_of_bag(g, inp), "tree", "id", "y", "node") == table(
        importance.out_of_bag(f, inp), "tree", "id", "y", "node")


def test_importance_and_dependence_by_task_equal_the_joins(fitted):
    f, inp, rows, trees = fitted
    g = forest.grow(inp, P, FEATS)
    assert f.members is None and g.members is not None
    for threshold in (0.0, 0.8):
        assert table(importance.conditional_importance(g, inp, threshold), "tree", "k", "value") == table(
            importance.conditional_importance(f, inp, threshold), "tree", "k", "value")
    for only in (None, [1]):
        assert table(pdp.partial_dependence(g, inp, only), "feature", "v", "pd") == table(
            pdp.partial_dependence(f, inp, only), "feature", "v", "pd")


def test_dependence_of_small_trees_on_many_rows_needs_no_row_of_a_grid_point(spark, monkeypatch):
    """More rows than one task grows from, trees of few leaves: blocks of rows, summed over the rows in the task where all
    trees are in it; as by levels, and as with the trees in two parts."""
    inp, _ = fixture(spark, 400)
    f = forest.grow(inp, by_levels(replace(P, max_depth=2)), FEATS)
    f = replace(f, largest=400)
    assert f.largest > f.params.subtree_rows
    cols = ("feature", "v", "pd")
    monkeypatch.setattr(pdp, "LEAVES", 0)
    by_joins = table(pdp.partial_dependence(f, inp), *cols)
    monkeypatch.undo()
    monkeypatch.setattr(pdp, "BLOCK", 128)
    for name in ("_route_grid", "_block_sums"):
        monkeypatch.setattr(pdp, name, None)
    assert table(pdp.partial_dependence(f, inp), *cols) == by_joins and len(by_joins) > 25
    monkeypatch.undo()
    monkeypatch.setattr(pdp, "TREES", 2)
    monkeypatch.setattr(pdp, "_block_predictions", None)
    assert P.ntree > 2 and table(pdp.partial_dependence(f, inp), *cols) == by_joins


def test_cohorts_grow_together_as_alone(spark):
    a, _ = fixture(spark, 160)
    b = fixture(spark, 230)[0].withColumn("y", F.col("xs")[2] + F.col("y") / 7)
    both = a.withColumn("cohort", F.lit(0)).unionByName(b.withColumn("cohort", F.lit(1)))
    f = forest.grow(both, P, FEATS)
    alone = forest.grow(a, P, FEATS)
    assert table(f.splits.where(f"tree < {P.ntree}"), "tree", "node", "k", "cut") == table(alone.splits, "tree", "node", "k", "cut")
    levels = forest.grow(both, by_levels(P), FEATS)
    assert table(f.splits, "tree", "node", "k", "cut") == table(levels.splits, "tree", "node", "k", "cut")
    assert {r.tree for r in f.leaves.collect()} == set(range(2 * P.ntree))
    sizes = {r.tree: r.n for r in f.members.where("bag").groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {t: (160 if t < P.ntree else 230) * 632 // 1000 for t in range(2 * P.ntree)}
    imp = importance.conditional_importance(f, both, 0.0).where(f"tree < {P.ntree}")
    assert table(imp, "tree", "k", "value") == table(importance.conditional_importance(alone, a, 0.0), "tree", "k", "value")
    pd = pdp.partial_dependence_cohorts(f, both).where("cohort = 0")
    assert table(pd, "feature", "v", "pd") == table(pdp.partial_dependence(alone, a), "feature", "v", "pd")


@pytest.mark.parametrize("n", [1, 2, 5, 130, 1000])
def test_subsample_has_exactly_its_size(spark, n, monkeypatch):
    monkeypatch.setattr(forest, "RANKED", 16)   # several histogram buckets
    inp = spark.range(n).select("id")
    got = defaultdict(set)
    for r in forest.subsample(inp, range(P.ntree), P).collect():
        got[r.tree].add(r.id)
    for t in range(P.ntree):
        want = sorted(range(n), key=lambda i: (h32(P.seed, "s", t, i), i))[:n * 632 // 1000]
        assert got[t] == set(want)
    out = forest.subsample(inp, range(P.ntree), P, oob=True).groupBy("tree").count().collect()
    assert {r.tree: r["count"] for r in out} == {t: n - n * 632 // 1000 for t in range(P.ntree)}


def test_growth_leaves_two_tables(spark):
    import os
    from panelcast.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    inp, _ = fixture(spark)
    before = set(os.listdir(base))
    splits, leaves, _ = forest.grow_forest(inp, ForestParams(ntree=2, mtry=2, max_depth=2, seed=7, blocks=8), 3)
    made = sorted(x.split("-")[1] for x in set(os.listdir(base)) - before if not x.endswith(".crc"))
    assert made == ["leaves", "splits"] and splits.count() > 0 and leaves.count() > 0


def test_checkpoint_folder_is_needed_off_a_local_master():
    from types import SimpleNamespace
    from panelcast.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d: d)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_thresholds_and_variables_are_broadcast_not_the_rows(spark):
    """The trees' explode isn't in the size estimate; the side with one row a tree is the one to broadcast."""
    from panelcast.plans import q_forest
    inp = q_forest.forest_rows(spark, "/root/testdata/sf0.01")
    plan = forest.draw(inp, range(10), P)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "bucket#" in line]
    assert joins and all("BuildRight" in line for line in joins), joins


def test_leaves_of_the_members_are_not_broadcast(spark):
    """A forest's leaves grow with the input; compressed as a file they look small."""
    inp, _ = fixture(spark)
    g = forest.grow(inp, P, FEATS)
    for df in (forest.oob_error(g), forest.predict_members(g)):
        assert df.count() > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_small_cohorts_rows_are_not_copied_for_each_tree(spark, monkeypatch):
    """A cohort that one task holds goes to chunks of trees, drawn there; the result doesn't depend on the chunk."""
    inp, rows = fixture(spark)
    want = forest.grow(inp, by_levels(P), FEATS)
    monkeypatch.setattr(forest, "root_rows", None)
    for chunk in (1, 2, 5):
        monkeypatch.setattr(forest, "CHUNK", chunk)
        f = forest.grow(inp, P, FEATS)
        assert table(f.splits, "tree", "node", "k", "cut") == table(want.splits, "tree", "node", "k", "cut")
        assert table(f.members, "tree", "id", "node", "bag") == table(want.members, "tree", "id", "node", "bag")


def test_importance_hashes_only_rows_that_a_permutation_can_change(monkeypatch):
    """Rows of a cell with one value stay as they are; the importance is that of permuting every row."""
    rng = np.random.default_rng(5)
    n, p = 600, ForestParams()
    x = np.round(rng.random((n, 3)), 2)
    x[rng.random((n, 3)) < 0.05] = np.nan
    y, ids, bag = np.nan_to_num(x[:, 0]) + rng.random(n) / 9, np.arange(n), np.arange(n) % 3 > 0
    splits, leaves, at = subtree.grow(1, 1, x, y, bag, p)
    node, k, cut, count, sy = (np.array(c) for c in zip(*[(*s, 0, 0.0) for s in splits], *[(v[0], -1, 0.0, *v[1:]) for v in leaves]))
    tree, conditioned = subtree.Tree(node, k, cut, count, sy), {0: [1, 2], 1: [0], 2: [0, 1]}
    x, y, leaf, ids = x[~bag], y[~bag], at[~bag], ids[~bag]
    mean, want, possible = tree.sy / np.maximum(tree.n, 1), np.zeros(3), 0
    for k, (cell, intervals) in subtree.cell_codes(tree, x, conditioned).items():
        z = x.copy()
        z[:, k] = subtree.permuted(x[:, k], cell, [",".join(map(str, c)).encode() for c in intervals.tolist()], ids, p.seed, 1, k)
        want[k] = ((y - mean[tree.leaf(z)]) ** 2 - (y - mean[tree.leaf(x)]) ** 2).mean()
        possible += 2 * sum((np.unique(x[cell == c, k]).size > 1) * (cell == c).sum() for c in np.unique(cell))
    seen = []
    monkeypatch.setattr(subtree, "md5", lambda text: seen.append(text) or hashlib.md5(text))
    got = subtree.importance(1, tree, x, y, leaf, ids, conditioned, p.seed)
    assert np.abs(want).max() > 0 and np.allclose(got, want, rtol=0, atol=1e-12)
    assert 0 < len(seen) <= possible < 6 * len(x)


def test_blocks_are_routed_in_steps_to_the_leaves_of_every_grid_value(monkeypatch):
    """A block's nodes come once, its rows go down in bounded steps; sums are those of setting each grid value in turn."""
    rng = np.random.default_rng(6)
    n, p = 300, ForestParams(ntree=2)
    x = np.round(rng.random((n, 3)), 2)
    x[rng.random((n, 3)) < 0.05] = np.nan
    y, nodes = np.nan_to_num(x[:, 0] * x[:, 1]) + rng.random(n) / 9, []
    for t in range(2):
        splits, leaves, _ = subtree.grow(t, 1, x, y, np.arange(n) % 3 > t, p)
        nodes += [(t, *s, 0, 0.0) for s in splits] + [(t, v[0], -1, 0.0, *v[1:]) for v in leaves]
    grid = [np.linspace(0, 1, 5), np.linspace(0.1, 0.9, 3), np.array([0.5])]
    rows = pa.table({"id": np.arange(n), "xs": pa.array([[None if math.isnan(v) else v for v in r] for r in x], pa.list_(pa.float64()))})
    table = pa.table(dict(zip(("tree", "node", "k", "cut", "n", "sy"), map(list, zip(*nodes)))))
    steps, route = [], subtree.Tree.grid_leaves
    monkeypatch.setattr(pdp, "STEP", 64)
    monkeypatch.setattr(subtree.Tree, "grid_leaves", lambda t, rows, k, g: steps.append(len(rows)) or route(t, rows, k, g))
    got = {(r["id"], r["fj"]): r for r in pdp._block_sums({0: grid}, [0, 1, 2], 3, 2)(rows, table).to_pylist()}
    assert max(steps) == 64 and sum(steps) == 2 * 3 * n and len(got) == 3 * n
    trees = [subtree.Tree(*(np.array(c) for c in list(zip(*[v for v in nodes if v[0] == t]))[1:])) for t in range(2)]
    for j, values in enumerate(grid):
        for g, v in enumerate(values):
            z = x.copy()
            z[:, j] = v
            at = [(t, t.leaf(z)) for t in trees]
            assert np.allclose([got[i, j]["s"][g] for i in range(n)], sum(t.sy[a] for t, a in at))
            assert np.allclose([got[i, j]["n"][g] for i in range(n)], sum(t.n[a] for t, a in at))


def test_many_hashes_equal_one_by_one():
    """Steps of md5 on many texts at once: texts of every length up to a block, and beyond, where each is hashed alone."""
    rng = np.random.default_rng(8)
    ids = np.concatenate([rng.integers(0, 10 ** k, 70) for k in range(1, 19)] + [[-5]])
    for head in (b"7|s|3|", b"160617|s|7999|", b"x" * 40, b"y" * 50, b"z" * 120):
        got = subtree.hashes(head, *subtree.digits(ids))
        assert len(ids) > subtree.FEW and got.tolist() == [subtree.hash32(head + b"%d" % i) for i in ids.tolist()]
    nodes = np.array([1, 2, 3, 2 ** 40 + 1, 2 ** 61 + 5])
    for node, row in zip(nodes.tolist(), subtree.candidates(3, nodes, 9, ForestParams())):
        want = sorted(range(9), key=lambda k: (h32(160617, "c", 3, node, k), k))[:4]
        assert np.flatnonzero(row).tolist() == sorted(want)


def test_a_level_of_nodes_is_grown_at_once(monkeypatch):
    """As many searches as there are levels, not nodes; batches of a level's rows give the same tree."""
    rng = np.random.default_rng(9)
    x = np.round(rng.random((3000, 4)), 2)
    x[rng.random(x.shape) < 0.05] = np.nan
    y, bag, p = np.nan_to_num(x[:, 0] * x[:, 1]) + rng.random(3000) / 9, np.arange(3000) % 3 > 0, ForestParams(mtry=2)
    seen, search = [], subtree.candidates
    monkeypatch.setattr(subtree, "candidates", lambda *a: seen.append(a) or search(*a))
    want = subtree.grow(1, 1, x, y, bag, p)
    depth = max(s[0] for s in want[0]).bit_length()
    assert len(seen) <= depth + 1 < len(want[0])
    batches = subtree._batches
    monkeypatch.setattr(subtree, "_batches", lambda start: batches(start, 64))
    got = subtree.grow(1, 1, x, y, bag, p)
    assert got[0] == want[0] and got[1] == want[1] and (got[2] == want[2]).all()


def test_growth_of_whole_trees_keeps_no_row_of_a_member(spark):
    """Members are trees times rows: they are drawn and routed when read, for the first trees alone if only these are asked."""
    import os
    from panelcast.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    inp, rows = fixture(spark)
    before = set(os.listdir(base))
    f = forest.grow(inp, P, FEATS)
    made = [x for x in set(os.listdir(base)) - before if not x.endswith(".crc")]
    assert sum(spark.read.parquet(f"{base}/{x}").count() for x in made) == f.splits.count() + f.leaves.count()
    assert f.members.count() == P.ntree * len(rows) and f.first_trees(2).members.count() == 2 * len(rows)
    alone = replace(f, members=None)
    assert table(forest.oob_error(alone), "tree", "n_oob", "oob_mse") == table(
        forest.oob_error(forest.grow(inp, by_levels(P), FEATS)), "tree", "n_oob", "oob_mse")


def test_roots_of_all_trees_of_the_forests(spark):
    """The first splits are those of the forests of 1000 trees that are grown, for every cohort, in a task or by levels."""
    from panelcast.plans import q_forest, registry
    registry.load_all()
    f = q_forest.FOREST
    assert f.ntree == 1000 and f"range({7 * f.ntree}, {8 * f.ntree})" in registry.ORACLE["forest_root_cohorts"]
    got = registry.QUERIES["forest_root_cohorts"](spark, "/root/testdata/sf0.01").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.min("tree").alias("lo"), F.max("tree").alias("hi")).collect()
    assert {r.cohort: (r.n, r.lo, r.hi) for r in got} == {
        c[0]: (f.ntree, i * f.ntree, (i + 1) * f.ntree - 1) for i, c in enumerate(q_forest.COHORTS)}
    a, b = fixture(spark, 160)[0], fixture(spark, 230)[0]
    both = a.withColumn("cohort", F.lit(0)).unionByName(b.withColumn("cohort", F.lit(1)))
    cuts = [table(forest.root_cuts(both, p, 3), "tree", "k", "cut", "cut_stat") for p in (P, replace(by_levels(P), tree_batch=2))]
    assert cuts[0] == cuts[1] and len(cuts[0]) == 2 * P.ntree


def test_cells_and_importance_by_tree_join_nothing(spark, monkeypatch):
    """A tree's cells are made in the task that draws it, as the join of its rows with their ranks gives them; so is its
    importance.  No member is read for either."""
    inp, _ = fixture(spark)
    inp = inp.withColumn("xs", F.when(F.col("id") % 9 == 0, F.array(F.lit(None).cast("double"), F.col("xs")[1], F.col("xs")[2]))
                         .otherwise(F.col("xs")))
    f, g = forest.grow(inp, P, FEATS), forest.grow(inp, by_levels(P), FEATS)
    pairs = importance.association_pairs(inp, FEATS, 0.0)
    want = table(importance.out_of_bag_cells(g, inp, pairs), "tree", "k", "id", "cell")
    values = table(importance.conditional_importance(g, inp, 0.0), "tree", "k", "value")
    monkeypatch.setattr(importance, "cells_fast", None)
    monkeypatch.setattr(importance, "out_of_bag", None)
    f = replace(f, members=None)
    assert table(importance.out_of_bag_cells(f, inp, pairs), "tree", "k", "id", "cell") == want
    assert len({r[3] for r in want}) > 3
    assert table(importance.conditional_importance(replace(f, members=f.splits), inp, 0.0), "tree", "k", "value") == values
    first = table(importance.out_of_bag_cells(f.first_trees(1), inp, pairs), "tree", "k", "id", "cell")
    assert first == [r for r in want if r[0] == 0]
