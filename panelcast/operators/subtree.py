"""What one task does with a whole subtree: growth, routing, permutation -- numpy over the rows of one node.

The arithmetic is that of :mod:`.forest` and :mod:`.importance`: the same hashes, statistics rounded alike,
the same ties.  A node's rows come here once they are few enough (``ForestParams.subtree_rows``).
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..spec import ForestParams

MAX_LEVELS = 61   # node ids are binary paths in a BIGINT; growth raises beyond, it never just stops
ROUND = 6   # statistics are compared at 6 decimals so that every engine picks the same argmax


def round_half_away(x: np.ndarray) -> np.ndarray:
    scale = 10.0 ** ROUND
    scaled = np.abs(x) * scale
    return np.where(scaled >= 2.0 ** 52, x, np.sign(x) * np.floor(scaled + 0.5) / scale)


def hash32(text: bytes) -> int:
    return int.from_bytes(md5(text).digest()[:4], "big")


#: Fewer texts are hashed one by one: the steps of many at a time would cost more.
FEW = 512
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_step(m: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """The states of md5 after a block of 16 words each, a column of ``m``."""
    a, b, c, d = (v.copy() for v in state)
    f, t = np.empty_like(a), np.empty_like(a)
    used = m.any(axis=1)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINE[i]
        if used[g]:
            f += m[g]
        s = _SHIFT[i // 16][i % 4]
        np.left_shift(f, np.uint32(s), out=t)
        f >>= np.uint32(32 - s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [old + new for old, new in zip(state, (a, b, c, d))]


def hashes(head: bytes, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """:func:`hash32` of ``head`` and each text, a row of bytes with zeros after its ``length``, many at a time."""
    out, at = np.empty(len(text), np.uint32), len(head)
    if len(text) < FEW:
        for i, (t, n) in enumerate(zip(text, length.tolist())):
            out[i] = hash32(head + t[:n].tobytes())
        return out
    blocks = (length + (at + 8)) // 64 + 1
    for count in np.unique(blocks).tolist():
        of = np.flatnonzero(blocks == count)
        for a in range(0, len(of), 8192):
            own = of[a:a + 8192]
            width = min(text.shape[1], 64 * count - at)   # what lies beyond is zeros
            block, n = np.zeros((len(own), 64 * count), np.uint8), length[own] + at
            block[:, :at] = np.frombuffer(head, np.uint8)
            block[:, at:at + width] = text[own, :width]
            block[np.arange(len(own)), n] = 0x80
            block[:, -8:-6] = (n * 8).astype("<u2")[:, None].view(np.uint8)
            words, state = np.ascontiguousarray(block.view("<u4").T), [np.full(len(own), v) for v in _START]
            for i in range(count):
                state = _md5_step(words[16 * i:16 * (i + 1)], state)
            out[own] = state[0].byteswap()
    return out


def digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers as text, a row of bytes for each, and their lengths."""
    text = np.array([b"%d" % v for v in values.tolist()] or [b"0"])[:len(values)]
    return text.view(np.uint8).reshape(len(values), -1), np.char.str_len(text)


def candidates(tree: int, nodes: np.ndarray, n_features: int, p: ForestParams) -> np.ndarray:
    """Which features are each node's candidates: the ``mtry`` with the smallest (hash, number)."""
    text = np.array([b"%d|%d" % (i, k) for i in nodes.tolist() for k in range(n_features)])
    h = hashes(b"%d|c|%d|" % (p.seed, tree), text.view(np.uint8).reshape(len(text), -1), np.char.str_len(text))
    key = h.reshape(len(nodes), n_features).astype(np.int64) * n_features + np.arange(n_features)
    if p.mtry >= n_features:
        return np.ones(key.shape, bool)
    return key <= np.partition(key, p.mtry - 1, axis=1)[:, p.mtry - 1:p.mtry]


def draw(tree: int, ids: np.ndarray, p: ForestParams, text: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which rows are in the tree's subsample: the floor(fraction * n) smallest by (hash, id).  ``text``: ids' digits."""
    n, size = len(ids), len(ids) * round(p.fraction * 1_000_000) // 1_000_000
    if not size:
        return np.zeros(n, bool)
    place = np.arange(n)
    if (ids[1:] < ids[:-1]).any():
        place[np.argsort(ids, kind="stable")] = np.arange(n)
    h = hashes(b"%d|s|%d|" % (p.seed, tree), *(digits(ids) if text is None else text))
    key = h.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    return key <= np.partition(key, size - 1)[size - 1]


class Columns:
    """What the trees of one table have in common: its columns, each value's place among its column's distinct values (from
    1 on; 0: missing), these values, and whether a column has none missing."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.rows = x, len(x)
        self.whole = ~np.isnan(x).any(axis=0)
        self.rank, self.distinct = np.zeros(x.T.shape, np.int32), []
        for v, rank in zip(x.T, self.rank):
            known = ~np.isnan(v)
            distinct, rank[known] = np.unique(v[known], return_inverse=True)
            rank[known] += 1
            self.distinct.append(distinct)


def _batches(start: np.ndarray, rows: int = 32768) -> list[tuple[int, int]]:
    """Ranges of nodes that have some ``rows`` rows together, so that their numbers stay in a core's cache."""
    of = start // rows
    at = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(start)])).tolist()
    return list(zip(at, at[1:]))


def associations(c: Columns, rows: np.ndarray, size: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(n - 1) corr^2 with y of the nodes' wanted features, a row a node; -1 where a feature isn't wanted, 0 where it or y
    doesn't vary.  ``rows`` are those of the nodes, one after the other, ``y`` is theirs; a missing value takes no part."""
    out, x, start = np.full(wanted.shape, -1.0), c.x.take(rows, axis=0), np.cumsum(size) - size
    differs = np.maximum.reduceat(y, start) > np.minimum.reduceat(y, start)
    dy = y - np.repeat(np.add.reduceat(y, start) / size, size)
    vy = np.add.reduceat(dy * dy, start)
    for k in np.flatnonzero(wanted.any(axis=0)):
        own = wanted[:, k]
        here = slice(None) if own.all() else np.flatnonzero(np.repeat(own, size))
        n, v = size[own], x[:, k][here].copy()
        first = np.cumsum(n) - n
        if c.whole[k]:
            known, varies, sy, dk = n, differs[own], vy[own], dy[here]
            varies = varies & (np.maximum.reduceat(v, first) > np.minimum.reduceat(v, first))
            v -= np.repeat(np.add.reduceat(v, first) / n, n)
        else:
            some, yk = ~np.isnan(v), y[here]
            known = np.add.reduceat(some, first, dtype=np.int64)
            varies = np.logical_and(*(np.maximum.reduceat(np.where(some, w, -np.inf), first)
                                      > np.minimum.reduceat(np.where(some, w, np.inf), first) for w in (v, yk)))
            v, dk = (np.where(some, w, 0.0) for w in (v, yk))
            v, dk = (some * (w - np.repeat(np.add.reduceat(w, first) / np.maximum(known, 1), n)) for w in (v, dk))
            sy = np.add.reduceat(dk * dk, first)
        cov, vx = np.add.reduceat(v * dk, first), np.add.reduceat(v * v, first)
        vx, sy = np.where(varies, vx, 1.0), np.where(varies, sy, 1.0)
        out[own, k] = np.where(varies, round_half_away((known - 1) * (cov / vx) * (cov / sy)), 0.0)
    return out


def sorted_nodes(c: Columns, rows: np.ndarray, size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' rows in order of each node's feature ``k``, missing values first, and the values' ranks."""
    place = c.rank.ravel()[np.repeat(k * c.rows, size) + rows].astype(np.int64)
    node = np.repeat(np.arange(len(size)), size)
    low, mid = max(c.rows - 1, 1).bit_length(), max(map(len, c.distinct)).bit_length()
    if len(size).bit_length() + mid + low > 63:
        order = np.lexsort((place, node))
        return rows[order], place[order]
    key = node << (mid + low) | place << low | rows
    key.sort()
    return key & ((1 << low) - 1), key >> low & ((1 << mid) - 1)


def best_cuts(place: np.ndarray, start: np.ndarray, size: np.ndarray, y: np.ndarray, minbucket: int):
    """(node's number, last row of its left side, statistic) of each node that has a cut: the one of the largest two-sample
    statistic with ``minbucket`` rows on either side (ties: smallest).  ``place`` and ``y`` are those of the nodes' sorted
    rows; rows with a missing value (place 0) take no part."""
    known = place > 0
    n = np.add.reduceat(known, start, dtype=np.int64)
    m = np.maximum(n, 1)
    dy = np.where(known, y - np.repeat(np.add.reduceat(np.where(known, y, 0.0), start) / m, size), 0.0)
    var = np.add.reduceat(dy * dy, start) / m
    total = np.cumsum(dy)
    end = np.zeros(len(y), bool)
    end[start + size - 1] = True
    last = np.flatnonzero((place[:-1] != place[1:]) & known[:-1] & ~end[:-1])
    node = np.searchsorted(start, last, "right") - 1
    left = last + 1 - (start + size - n)[node]
    ok = (left >= minbucket) & (n[node] - left >= minbucket) & (var[node] > 0)
    last, node, left = last[ok], node[ok], left[ok].astype(float)
    if not len(last):
        return node, last, left
    s = total[last] - (total[start] - dy[start])[node]
    stat = round_half_away((n[node] - 1) * s * s / (left * (n[node] - left) * var[node]))
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    best = np.flatnonzero(stat == np.repeat(np.maximum.reduceat(stat, first), np.diff(np.append(first, len(node)))))
    best = best[np.concatenate(([True], node[best][1:] != node[best][:-1]))]
    return node[best], last[best], stat[best]


def grow_nodes(tree: int, root: int, c: Columns, y: np.ndarray, bag: np.ndarray, p: ForestParams,
               at: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Splits (node, k, cut, statistic) and leaves (node, n, sum of y) of the subtree at ``root``, learned from the rows
    in ``bag``, whose leaves go to ``at``.  All nodes of a level are done at once: each node's rows stand together, and
    sorted by the split's feature they are its children's, one after the other.  A missing value goes left."""
    splits, leaves = [], []
    rows = np.flatnonzero(bag)
    node, size, depth = np.array([root]), np.array([len(rows)]), root.bit_length() - 1

    def end(nodes, sizes, their):
        s = np.add.reduceat(y[their], np.cumsum(sizes) - sizes) if len(their) else np.zeros(len(nodes))
        leaves.append((nodes, sizes, s))
        if at is not None:
            at[their] = np.repeat(nodes, sizes)

    while len(node):
        large = size >= p.minsplit
        if depth >= p.max_depth:
            if large.any() and p.max_depth >= MAX_LEVELS:
                raise ValueError(f"a tree is deeper than {MAX_LEVELS} levels: node ids end there")
            large[:] = False
        if not large.all():
            here = np.repeat(large, size)
            end(node[~large], size[~large], rows[~here])
            node, size, rows = node[large], size[large], rows[here]
            if not len(node):
                break
        start, wanted = np.cumsum(size) - size, candidates(tree, node, c.x.shape[1], p)
        stat = []
        for a, b in _batches(start):
            here = rows[start[a]:start[b - 1] + size[b - 1]]
            stat.append(associations(c, here, size[a:b], y[here], wanted[a:b]))
        stat = np.concatenate(stat)
        k = stat.argmax(axis=1)
        some = stat[np.arange(len(node)), k] > 0
        if not some.all():
            here = np.repeat(some, size)
            end(node[~some], size[~some], rows[~here])
            node, size, rows, k = node[some], size[some], rows[here], k[some]
            if not len(node):
                break
            start = np.cumsum(size) - size
        place, found = np.empty(len(rows), np.int64), []
        rows = rows.copy()
        for a, b in _batches(start):
            lo, hi = start[a], start[b - 1] + size[b - 1]
            rows[lo:hi], place[lo:hi] = sorted_nodes(c, rows[lo:hi], size[a:b], k[a:b])
            i, at_row, value = best_cuts(place[lo:hi], start[a:b] - lo, size[a:b], y[rows[lo:hi]], p.minbucket)
            found.append((i + a, at_row + lo, value))
        which, last, value = (np.concatenate(part) for part in zip(*found))
        cut = np.zeros(len(node), bool)
        cut[which] = True
        if not cut.all():
            here = np.repeat(cut, size)
            end(node[~cut], size[~cut], rows[~here])
            rows = rows[here]
        place = place[last] - 1
        split, k, left = node[which], k[which], last + 1 - start[which]
        at_cut = np.empty(len(split))
        for f in np.unique(k):
            at_cut[k == f] = c.distinct[f][place[k == f]]
        splits.append((split, k, at_cut + 0.0, value))
        node = np.stack([2 * split, 2 * split + 1], axis=1).ravel()
        size = np.stack([left, size[which] - left], axis=1).ravel()
        depth += 1
    kinds = ((np.int64, np.int64, float, float), (np.int64, np.int64, float))
    return tuple(tuple(np.concatenate([part[i] for part in parts] or [[]]).astype(kind) for i, kind in enumerate(of))
                 for parts, of in zip((splits, leaves), kinds))


def grow(tree: int, root: int, x: np.ndarray, y: np.ndarray, bag: np.ndarray, p: ForestParams):
    """Splits (node, k, cut), leaves (node, n, sum of y) and each row's leaf, of the subtree at ``root``;
    learned from the rows in ``bag``, the others go along (see :func:`grow_nodes`)."""
    at = np.empty(len(y), np.int64)
    splits, leaves = grow_nodes(tree, root, Columns(x), y, bag, p, at)
    along = np.flatnonzero(~bag)
    if len(along):
        t = Tree.of(splits, leaves)
        at[along] = t.node[t.leaf(x[along])]
    return list(zip(*(v.tolist() for v in splits[:3]))), list(zip(*(v.tolist() for v in leaves))), at


class Tree:
    """A grown tree as arrays over its nodes; ``feature`` is -1 at leaves."""

    def __init__(self, node: np.ndarray, k: np.ndarray, cut: np.ndarray, n: np.ndarray, sy: np.ndarray) -> None:
        order = np.argsort(node)
        self.node, self.feature, self.cut = node[order], k[order].astype(np.int64), cut[order]
        self.n, self.sy = n[order], sy[order]
        inner = self.feature >= 0
        self.left = np.where(inner, np.searchsorted(self.node, 2 * self.node), np.arange(len(node)))
        self.right = np.where(inner, np.searchsorted(self.node, 2 * self.node + 1), np.arange(len(node)))

    @classmethod
    def of(cls, splits: tuple[np.ndarray, ...], leaves: tuple[np.ndarray, ...]) -> Tree:
        """The tree of what :func:`grow_nodes` gives."""
        (node, k, cut, _), (leaf, n, sy) = splits, leaves
        none = np.zeros(len(leaf))
        return cls(np.concatenate((node, leaf)), np.concatenate((k, none - 1)), np.concatenate((cut, none)),
                   np.concatenate((np.zeros(len(node), n.dtype), n)), np.concatenate((np.zeros(len(node)), sy)))

    def cuts(self) -> dict[int, np.ndarray]:
        """The sorted distinct cuts of each feature that the tree uses."""
        return {int(k): np.unique(self.cut[self.feature == k]) for k in np.unique(self.feature) if k >= 0}

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Index of each row's leaf."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        rows = rows[self.feature[at] >= 0]
        while len(rows):
            here = at[rows]
            goes = x[rows, self.feature[here]] > self.cut[here]
            at[rows] = here = np.where(goes, self.right[here], self.left[here])
            rows = rows[self.feature[here] >= 0]
        return at

    def grid_leaves(self, x: np.ndarray, k: np.ndarray, grids: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(row, leaf, lo, hi): where each row of ``x`` ends when feature k[row] takes the grid's values lo .. hi."""
        below = np.zeros(len(self.node), np.int64)  # grid points that go left
        for j, g in enumerate(grids):
            own = self.feature == j
            below[own] = np.searchsorted(g, self.cut[own], "right")
        child = np.stack([self.left, self.right], axis=1).ravel()
        row, at, lo = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        hi, flat, width, done = np.array([len(g) - 1 for g in grids])[k], x.ravel(), x.shape[1], []
        while len(row):
            f = self.feature[at]
            ended = f < 0
            if ended.any():
                done.append((row[ended], at[ended], lo[ended], hi[ended]))
                go = np.flatnonzero(~ended)
                row, at, lo, hi, f = row[go], at[go], lo[go], hi[go], f[go]
            here = at
            at = child[2 * here + (flat[row * width + f] > self.cut[here])]
            own = np.flatnonzero(f == k[row])
            if len(own):
                # the first grid points of a range go left, the others right: a range that does both becomes two
                node, first = here[own], below[here[own]]
                at[own] = child[2 * node + (lo[own] >= first)]
                two = (lo[own] < first) & (hi[own] >= first)
                both, node, first = own[two], node[two], first[two]
                row, lo = np.concatenate((row, row[both])), np.concatenate((lo, first))
                at, hi = np.concatenate((at, self.right[node])), np.concatenate((hi, hi[both]))
                hi[both] = first - 1
        return tuple(np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, np.int64),) * 4


def cell_codes(tree: Tree, x: np.ndarray, conditioned: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per feature that the tree uses: each row's cell number, and the cells' intervals, a row of numbers for each."""
    cuts = tree.cuts()
    place = {k: np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k], "left")) for k, c in cuts.items()}
    out = {}
    for k in cuts:
        given, code, most = [z for z in conditioned.get(k, []) if z in cuts], np.zeros(len(x), np.int64), 1
        for z in given:
            width = len(cuts[z]) + 1
            if most * width >= 2 ** 62:   # numbers of the cells so far, in the same order
                found, code = np.unique(code, return_inverse=True)
                most = len(found)
            code, most = code * width + place[z], most * width
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        out[k] = code, np.stack([place[z][first] for z in given], axis=1) if given else np.zeros((len(first), 0), np.int64)
    return out


def cell_keys(tree: Tree, x: np.ndarray, conditioned: dict[int, list[int]]) -> dict[int, pa.Array]:
    """Per feature that the tree uses: each row's cell, its intervals on the conditioning features joined by ','."""
    cuts = tree.cuts()
    place = {k: pc.cast(pa.array(np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k], "left"))), pa.string())
             for k, c in cuts.items()}
    none, out = pa.array([""], pa.string()).take(pa.array(np.zeros(len(x), np.int64))), {}
    for k in cuts:
        given = [place[z] for z in conditioned.get(k, []) if z in cuts]
        out[k] = pc.binary_join_element_wise(*given, ",") if given else none
    return out


def mixed(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Which rows are in a cell of different ``values``; permuting the others changes nothing.  Missing values are alike."""
    some, differ = np.empty(cells), np.zeros(cells, bool)
    some[cell] = values   # of each cell, the value of one of its rows
    differ[cell[~((values == some[cell]) | (np.isnan(values) & np.isnan(some[cell])))]] = True
    return differ[cell]


def permuted(values: np.ndarray, cell: np.ndarray, keys: list[bytes], ids: np.ndarray, seed: int, tree: int,
             k: int) -> np.ndarray:
    """``values`` permuted within cells: the row of rank r by one seeded hash takes the value of rank r by another."""
    text, order = [keys[c] + b"|%d" % i for c, i in zip(cell.tolist(), ids.tolist())], []
    rows = np.array(text) if len(text) >= FEW else None
    for kind in (b"o", b"p"):
        head = b"%d|%s|%d|%d|" % (seed, kind, tree, k)
        if rows is None:
            h = np.frombuffer(b"".join([md5(head + t).digest()[:4] for t in text]), ">u4")
        else:
            h = hashes(head, rows.view(np.uint8).reshape(len(rows), -1), np.char.str_len(rows))
        order.append(np.lexsort((ids, h, cell)))
    out = np.empty_like(values)
    out[order[0]] = values[order[1]]
    return out


def importance(tree_id: int, tree: Tree, x: np.ndarray, y: np.ndarray, leaf: np.ndarray, ids: np.ndarray,
               conditioned: dict[int, list[int]], seed: int) -> np.ndarray:
    """Per feature: mean over the out-of-bag rows of squared error with it permuted, less that without."""
    out = np.zeros(x.shape[1])
    mean = tree.sy / np.maximum(tree.n, 1)
    error = (y - mean[np.searchsorted(tree.node, leaf)]) ** 2
    for k, (cell, intervals) in cell_codes(tree, x, conditioned).items():
        rows = np.flatnonzero(mixed(x[:, k], cell, len(intervals)))
        if not len(rows):
            continue
        own, cell = np.unique(cell[rows], return_inverse=True)
        keys = [",".join(map(str, c)).encode() for c in intervals[own].tolist()]
        old = x[rows, k]
        new = permuted(old, cell, keys, ids[rows], seed, tree_id, k)
        differs = ~((new == old) | (np.isnan(new) & np.isnan(old)))
        moved, new = rows[differs], new[differs]
        if len(moved):
            z = x[moved]
            z[:, k] = new
            out[k] = (((y[moved] - mean[tree.leaf(z)]) ** 2) - error[moved]).sum() / len(y)
    return out
