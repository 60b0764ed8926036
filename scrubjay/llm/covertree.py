"""Embedding near-duplicates by dual traversal of cover trees (operator 8).

Vectors are points of the unit sphere; cosine ``t`` is the distance
``sqrt(2 - 2t)``. A cover tree has nested levels with halving radii: a node's
center is a point of it, its children's centers are too, and its covering
radius is the greatest distance from center to point. A pair of nodes further
apart than both radii and the threshold holds no linked pair; one nearer than
the threshold less both radii holds only linked pairs; other pairs go down to
their children, and pairs of points are compared by cosine in double precision.

Equal vectors become one weighted point first. Points go to the nearest of a
bounded number of pivots, cells are dealt into blocks of about ``BLOCK``
points, each block builds its tree, and pairs of blocks whose cells' balls come
near enough are traversed, each in its own group. A traversal returns link
counts and the forest of its links, at most two rows a point, never the pairs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import components, forest, in_share, written
from scrubjay.llm.topk import valid

#: Points in a block, and pivots at most (the bound of what the driver sees).
BLOCK, PIVOTS = 4096, 256
#: Radii of the tree's levels below the root.
RADII = (0.5, 0.25, 0.125, 0.0625)
#: Bounds are widened by this much against rounding; links are decided exactly.
SLACK = 1e-7
#: And by this much where a matrix is computed in single precision.
SINGLE = 2e-5
_ROWS, _PAIRS = 512, 32_768


class CoverTree:
    """Points in depth-first order, so that every node is a range of them."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, keys: np.ndarray):
        unit = points / np.linalg.norm(points, axis=1)[:, None]
        groups, self.levels = [(np.arange(len(points)), 2.0)], []
        for radius in RADII:
            children, below = [], []
            for g, _ in groups:
                parts = [(g, 0.0)] if len(g) == 1 else _cover(unit, g, radius)
                children.append(len(parts))
                below += parts
            self.levels.append(_level(groups, children))
            groups = below
        self.levels.append(_level(groups, [len(g) for g, _ in groups]))
        order = np.concatenate([g for g, _ in groups]) if groups else np.arange(0)
        self.points, self.weight, self.keys = points[order], weight[order], keys[order]

    def prepare(self) -> CoverTree:
        self.norm = np.linalg.norm(self.points, axis=1)
        self.unit = self.points / self.norm[:, None]
        self.total = np.append(0, np.cumsum(self.weight))
        return self


def _cover(unit: np.ndarray, group: np.ndarray, radius: float) -> list:
    """Greedy cover: (points, first of them the center; covering radius), the group's center first."""
    out = []
    while len(group):
        d = 2 - 2 * (unit[group] @ unit[group[0]])
        inside = d <= radius * radius
        inside[0] = True
        out.append((group[inside], math.sqrt(max(0.0, float(d[inside].max())))))
        group = group[~inside]
    return out


def _level(groups: list, children: list[int]) -> tuple[np.ndarray, ...]:
    """(start, end, radius, first child, child after the last) of every node; its center is its first point."""
    size = np.array([len(g) for g, _ in groups], np.int64)
    end, after = np.cumsum(size), np.cumsum(children)
    return end - size, end, np.array([r for _, r in groups]), after - np.array(children, np.int64), after


class Traversal:
    """Link counts and forest of all pairs between two trees, or within one."""

    def __init__(self, a: CoverTree, b: CoverTree, threshold: float):
        self.a, self.b, self.same, self.threshold = a, b, a is b, threshold
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.base = 0 if self.same else len(a.keys)
        n = self.base + len(b.keys)
        self.links = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.depth = len(a.levels)
        self._made: dict[int, tuple] = {}
        self._expand(0, np.array([0]), np.array([0]))
        self._settle()

    def _settle(self) -> None:
        if self.edges:
            x, y = (np.concatenate(e) for e in zip(*self.edges, strict=True))
            step = forest(len(self.root), self.root[x], self.root[y])
            self.root = step[self.root]
            self.edges, self.held = [], 0

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges.append((x, y))
        self.held += len(x)
        if self.held > 1_000_000:
            self._settle()

    def _expand(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Compare the children of node pairs (i, j): large families as a matrix, small ones pair by pair."""
        a0, a1 = self.a.levels[level][3][i], self.a.levels[level][4][i]
        b0, b1 = self.b.levels[level][3][j], self.b.levels[level][4][j]
        work = (a1 - a0) * (b1 - b0)
        for k in np.flatnonzero(work >= 4096).tolist():
            for r in range(int(a0[k]), int(a1[k]), _ROWS):
                self._dense(level + 1, r, min(r + _ROWS, int(a1[k])), int(b0[k]), int(b1[k]))
        small = np.flatnonzero(work < 4096)
        done = np.cumsum(work[small])
        for part in np.split(small, np.searchsorted(done, np.arange(_PAIRS, int(done[-1]) if len(done) else 0, _PAIRS))):
            if not len(part):
                continue
            w, nb = work[part], (b1 - b0)[part]
            at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            wide = np.repeat(nb, w)
            x, y = np.repeat(a0[part], w) + at // wide, np.repeat(b0[part], w) + at % wide
            if self.same:
                x, y = x[x <= y], y[x <= y]
            if level + 1 == self.depth:
                self._points(x, y)
                continue
            p, q = self.a.levels[level + 1][0][x], self.b.levels[level + 1][0][y]
            self._judge(level + 1, x, y, np.einsum("ij,ij->i", self.a.unit[p], self.b.unit[q]))

    def _sides(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of a, rows of b, bounds): nodes i and j may hold a linked pair only if ``a[i] . b[j] >= bounds[i]``.

        ``2 - 2 cos <= (reach + r_i + r_j)^2`` as one inner product: the unit
        vectors are followed by ``reach + r_i, 1`` and ``r_j, r_j^2 / 2``."""
        if level not in self._made:
            if level == self.depth:
                rows = self.a.unit.astype(np.float32), self.b.unit.astype(np.float32)
                self._made[level] = *rows, np.full(len(rows[0]), self.threshold - SINGLE, np.float32)
            else:
                (at_a, _, r_a, *_), (at_b, _, r_b, *_) = self.a.levels[level], self.b.levels[level]
                wide = self.reach + SLACK + r_a
                self._made[level] = (np.column_stack([self.a.unit[at_a], wide, np.ones(len(wide))]).astype(np.float32),
                                     np.column_stack([self.b.unit[at_b], r_b, r_b * r_b / 2]).astype(np.float32),
                                     (1 - wide * wide / 2 - SINGLE).astype(np.float32))
        return self._made[level]

    def _dense(self, level: int, a0: int, a1: int, b0: int, b1: int) -> None:
        """Nodes (or points) a0 to a1 against b0 to b1 as one matrix in single precision; what passes is judged in double."""
        rows_a, rows_b, bounds = self._sides(level)
        x, y = np.nonzero(rows_a[a0:a1] @ rows_b[b0:b1].T >= bounds[a0:a1, None])
        x, y = x + a0, y + b0
        if self.same:
            x, y = x[x <= y], y[x <= y]
        if level == self.depth:
            self._points(x, y)
            return
        for s in range(0, len(x), _PAIRS):
            i, j = x[s:s + _PAIRS], y[s:s + _PAIRS]
            p, q = self.a.levels[level][0][i], self.b.levels[level][0][j]
            self._judge(level, i, j, np.einsum("ij,ij->i", self.a.unit[p], self.b.unit[q]))

    def _judge(self, level: int, x: np.ndarray, y: np.ndarray, dot: np.ndarray) -> None:
        d = np.sqrt(np.maximum(0, 2 - 2 * dot))
        span = self.a.levels[level][2][x] + self.b.levels[level][2][y]
        whole = d + span <= self.reach - SLACK
        for i, j in zip(x[whole].tolist(), y[whole].tolist(), strict=True):
            self._whole(level, i, j)
        open_ = ~whole & (d - span <= self.reach + SLACK)
        if open_.any():
            self._expand(level, x[open_], y[open_])

    def _whole(self, level: int, i: int, j: int) -> None:
        """Every point of node i links to every point of node j."""
        a0, a1 = self.a.levels[level][0][i], self.a.levels[level][1][i]
        b0, b1 = self.b.levels[level][0][j], self.b.levels[level][1][j]
        p, q = np.arange(a0, a1), np.arange(b0, b1) + self.base
        self.links[p] += self.b.total[b1] - self.b.total[b0]
        if self.same and i == j:
            self.links[p] -= self.a.weight[p]
            self._join(p[1:], np.full(len(p) - 1, a0))
            return
        self.links[q] += self.a.total[a1] - self.a.total[a0]
        self._join(np.concatenate([p, q]), np.concatenate([np.full(len(p), q[0]), np.full(len(q), a0)]))

    def _points(self, x: np.ndarray, y: np.ndarray) -> None:
        if self.same:
            x, y = x[x != y], y[x != y]
        for s in range(0, len(x), _PAIRS):
            i, j = x[s:s + _PAIRS], y[s:s + _PAIRS]
            cos = np.einsum("ij,ij->i", self.a.points[i], self.b.points[j]) / (self.a.norm[i] * self.b.norm[j])
            linked = cos >= self.threshold
            i, j = i[linked], j[linked]
            np.add.at(self.links, i, self.b.weight[j])
            np.add.at(self.links, j + self.base, self.a.weight[i])
            self._join(i, j + self.base)


def _packer(t: pa.Table) -> pa.Table:
    n = t.num_rows
    points = t["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    tree = CoverTree(points, t["n"].combine_chunks().to_numpy(), np.array(t["key"].to_pylist()))
    if np.array_equal(tree.points.astype(np.float32), tree.points):
        tree.points = tree.points.astype(np.float32)
    return pa.table({"block": t["block"][:1], "cell": t["cell"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())},
                    schema=pa.schema([("block", pa.string()), ("cell", pa.int32()), ("tree", pa.binary())]))


def _traverse(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        trees = [pickle.loads(b) for b in t["tree"].to_pylist()]  # written by _packer alone
        for tree in trees:
            tree.points = tree.points.astype(float)
            tree.prepare()
        found = Traversal(trees[0], trees[-1], threshold)
        keys = np.concatenate([x.keys for x in trees])
        some = found.links > 0
        return pa.table({"key": keys[some], "links": found.links[some], "root": keys[found.root[some]]},
                        schema=pa.schema([("key", pa.string()), ("links", pa.int64()), ("root", pa.string())]))
    return run


def _cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each point with its nearest pivot and the distance to it."""
    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            dot = x @ pivots.T
            cell = np.argmax(dot, 1).astype(np.int32)
            d = np.linalg.norm(x - pivots[cell], axis=1)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(d)], names=["key", "n", "v", "cell", "d"])
    return points.mapInArrow(run, "key string, n long, v array<double>, cell int, d double")


def _links(points: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) of every traversal, for points (key, n, v) of one dimension."""
    spark, total = points.sparkSession, points.count()
    n_pivots = max(1, min(PIVOTS, math.ceil(total / BLOCK / 4)))
    few = points.where(in_share(F.col("key"), n_pivots, total))
    pivots = np.array([r["v"] for r in few.orderBy("key").limit(n_pivots).select("v").collect()])
    pivots = pivots / np.linalg.norm(pivots, axis=1)[:, None]
    placed = written(_cells(points, pivots), "cells")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}  # one row a pivot
    sizes = spark.createDataFrame([(c, math.ceil(r["n"] / BLOCK)) for c, r in cells.items()], "cell int, parts int")
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.concat_ws(":", "cell", F.pmod(F.xxhash64("key"), "parts")))
    blocks = written(dealt.select("block", "cell", "key", "n", "v").groupBy("block").applyInArrow(
        _packer, "block string, cell int, tree binary"), "trees")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    near = [(i, j) for i in cells for j in cells if i <= j
            and np.linalg.norm(pivots[i] - pivots[j]) <= cells[i]["d"] + cells[j]["d"] + reach]
    meta = blocks.select("block", "cell")
    pairs = (spark.createDataFrame(near, "i int, j int")
             .join(meta.select(F.col("block").alias("a"), F.col("cell").alias("i")), "i")
             .join(meta.select(F.col("block").alias("b"), F.col("cell").alias("j")), "j")
             .where("i < j OR a <= b"))
    members = pairs.select(F.concat_ws("|", "a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    met = blocks.select("block", "tree").join(members, "block").select("pair", "tree")
    return met.groupBy("pair").applyInArrow(_traverse(threshold), "key string, links long, root string")


def link(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept).

    ``n_links`` counts the other rows with cosine ``threshold`` or more,
    ``component_id`` is the smallest id reachable by links, ``kept`` whether
    that is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different
    dimensions with each other. Equal vectors link, repeated rows too. A null
    id takes part but names no component: alone it gets a null one, and it is
    never kept. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = valid(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = written(rows.select("vec_id", F.when(ok, F.col("v")).alias("v")).withColumn(
        "key", F.when(F.col("v").isNotNull(), F.md5(F.col("v").cast("string").cast("binary")))), "vectors")
    classes = written(rows.where("key IS NOT NULL").groupBy("key", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")), "classes")
    dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    found = None
    for d in dims:
        part = _links(classes.where(F.size("v") == d).select("key", "n", "v"), threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "key string, links long, root string")
    found = written(found, "links")
    roots = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "near")
    least = classes.select("key", "least")
    named = roots.join(least, F.col("node") == F.col("key")).groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(named, "root").select(F.col("node").alias("key"), "component")
    totals = (classes.select("key", "least", "n").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
              .join(named, "key", "left")
              .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")))
    # a vector without links is its own component: only the others are looked up
    totals = written(totals.where("n_links > 0"), "totals")
    out = rows.select("vec_id", "key").join(totals, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS x FROM embeddings),
l AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(r, m) AS (SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.m),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.m GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
