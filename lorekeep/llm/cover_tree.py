"""Exact cosine-threshold pairs by dual traversal of cover trees.

Unit vectors at cosine c are at distance sqrt(2 - 2c), so pairs of cosine >= t are pairs within a radius r. A cover tree
has nested levels of halving radii: the children of a node of level radius R are an R/2-net of its points, and each node
knows its covering radius, the largest distance to a point below it. Two nodes whose centres are farther apart than
r + both covering radii have no pair and are pruned; two that are nearer than r - both covering radii are linked as a
whole; otherwise their children are compared. Single points are compared by their cosine in double precision.

Distributed: vectors are dealt to the nearest of a bounded number of pivots (the top level), and each pivot's vectors to
blocks of at most BLOCK, so a hot pivot only has more blocks. A block's tree is built once. Pairs of pivots are pruned by
the same bound, and the blocks of those left are joined and traversed pair by pair. Equal vectors are one class with a
count, so copies cost nothing. Each pair of blocks gives, for each class, its count of linked vectors and the edges of a
spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, prepare, written

BLOCK = 4096
PIVOTS = 256
#: Rows of a table of distances that are looked at together.
STRIP = 256
#: Bounds are widened by this, above the rounding of distances near 0 (2e-8), so rounding neither prunes nor links.
SLACK = 1e-6
LEAF = 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so very long and very short vectors keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nested nodes over the rows of x. centre[i], cover[i], and the children or the points of node i.

    Levels whose net would part nearly all points are passed over down to the radius ``fine``: in many dimensions most
    vectors are alone at any useful radius, and then only the tight groups among them are worth a node.
    """

    def __init__(self, x: np.ndarray, fine: float = 0.1):
        self.x, self.fine = x, fine
        self.centre, self.cover, self.children, self.points = [], [], [], []
        self.root = self._node(0, np.arange(len(x)), np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0)), 2.0)

    def _node(self, centre: int, points: np.ndarray, far: np.ndarray, radius: float) -> int:
        i = len(self.centre)
        self.centre.append(centre)
        self.cover.append(float(far.max()))
        self.children.append([])
        self.points.append(points)
        stack = [(i, points, far, radius)]
        while stack:  # a level below another: no recursion, however deep
            at, points, far, radius = stack.pop()
            if len(points) <= LEAF or far.max() <= SLACK:
                continue
            while radius >= far.max():
                radius /= 2
            made = self._net(self.centre[at], points, far, radius)
            if len(made) > len(points) / 2 and radius > 2 * self.fine:  # a level that parts nearly all points says nothing
                while radius > self.fine:
                    radius /= 2
                made = self._net(self.centre[at], points, far, radius)
            for c, p, f in made:
                child = len(self.centre)
                self.centre.append(c)
                self.cover.append(float(f.max()))
                self.children.append([])
                self.points.append(p)
                self.children[at].append(child)
                stack.append((child, p, f, radius))
        return i

    def _net(self, centre: int, points: np.ndarray, far: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(centre, points, their distances) of a greedy net; the node's own centre is its first child, as in nested levels."""
        left, d, first, made = points, far, centre, []
        while len(left):
            near = d <= radius
            made.append((first, left[near], d[near]))
            left = left[~near]
            if len(left):
                first = int(left[0])
                d = np.sqrt(np.maximum(2 - 2 * (self.x[left] @ self.x[first]), 0))
        return made


class Links:
    """Counts of linked vectors by class of either side, and a spanning forest of the links."""

    def __init__(self, a: int, b: int, same: bool):
        self.same, self.shift = same, 0 if same else a
        self.count, self.root, self.edges = np.zeros(self.shift + b, np.int64), list(range(self.shift + b)), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        p, q = self.find(i), self.find(j)
        if p != q:
            self.root[max(p, q)] = min(p, q)
            self.edges.append((i, j))


def traverse(a: Tree, b: Tree, many_a: np.ndarray, many_b: np.ndarray, cosine: float, same: bool) -> Links:
    """All links between the points of two trees, or within one if same; many: vectors of each class."""
    r, out = math.sqrt(2 - 2 * cosine), Links(len(a.x), len(b.x), same)

    def link(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(out.count, i, many_b[j])
        if not same:
            np.add.at(out.count, j + out.shift, many_a[i])
        for p, q in zip(i.tolist(), (j + out.shift).tolist(), strict=True):
            if p != q:
                out.join(p, q)

    def all_linked(i: np.ndarray, j: np.ndarray) -> None:
        out.count[i] += many_b[j].sum()
        if not same:
            out.count[j + out.shift] += many_a[i].sum()
        for p in i.tolist():
            out.join(p, int(j[0]) + out.shift)
        for q in j.tolist():
            out.join(int(i[0]), q + out.shift)

    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        down_p, down_q = a.children[p] or [p], b.children[q] or [q]
        if down_p == [p] and down_q == [q]:
            i, j = a.points[p], b.points[q]
            u, v = np.nonzero(a.x[i] @ b.x[j].T >= cosine)
            link(i[u], j[v])
            continue
        right, cover_q = b.x[[b.centre[c] for c in down_q]], np.array([b.cover[c] for c in down_q])
        lone_q = np.array([len(b.points[c]) == 1 for c in down_q])
        for at in range(0, len(down_p), STRIP):
            some = down_p[at : at + STRIP]
            near = a.x[[a.centre[c] for c in some]] @ right.T
            single = np.logical_and.outer([len(a.points[c]) == 1 for c in some], lone_q)
            u, v = np.nonzero(near >= cosine)
            u, v = u[single[u, v]], v[single[u, v]]
            if len(u):
                link(np.array([a.centre[some[s]] for s in u]), np.array([b.centre[down_q[t]] for t in v]))
            u, v = np.nonzero(~single)
            apart = np.sqrt(np.maximum(2 - 2 * near[u, v], 0))
            reach = np.array([a.cover[c] for c in some])[u] + cover_q[v]
            whole, maybe = apart + reach <= r - SLACK, apart <= r + reach + SLACK
            for s, t in zip(u[whole].tolist(), v[whole].tolist(), strict=True):
                all_linked(a.points[some[s]], b.points[down_q[t]])
            stack += [(some[s], down_q[t]) for s, t in zip(u[maybe & ~whole].tolist(), v[maybe & ~whole].tolist(), strict=True)]
    if same:  # a tree against itself meets each pair from both sides, and each class itself
        out.count -= 1
    return out


def _valid(v: str) -> Column:
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _floats(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK, pivots: int = PIVOTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null vectors, those that hold a null or non-finite component and those of length 0 link with nothing; vectors of
    unequal dimension do not link. n_links counts rows, so repeated rows link with each other. component_id is the least
    vec_id reachable, the row's own included; a null vec_id is never less. An empty table gives no rows.

    Only the pivots (at most ``pivots`` vectors), and a count and radius for each, reach the driver.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("v")).withColumn("valid", _valid("v"))
    rows = rows.select("vec_id", "v", "valid", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = rows.where("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    wanted = max(1, min(pivots, -(-classes.count() // block)))
    top: dict[int, list[np.ndarray]] = {}
    for r in classes.select("h1", "h2", "v").orderBy("h1", "h2").limit(wanted).collect():
        top.setdefault(len(r.v), []).append(np.array(r.v))
    tops = {d: unit(np.stack(v)) for d, v in top.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _floats(b.column(2))
            dims = np.array([len(v) for v in vectors], np.int32)
            cells, far = np.zeros(len(vectors), np.int32), np.full(len(vectors), 2.0)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                if int(d) in tops:
                    near = unit(np.stack([vectors[i] for i in at])) @ tops[int(d)].T
                    cells[at], far[at] = near.argmax(1), np.sqrt(np.maximum(2 - 2 * near.max(1), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(far, pa.float64())], names=["cls", "many", "v", "dim", "cell", "far"])

    dealt = written(classes.select("cls", "many", "v").mapInArrow(deal, "cls long, many long, v array<double>, dim int, cell int, far double"), "vector-cells")
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # one row per pivot
    split = {(c.dim, c.cell): (-(-c.n // block), c.far) for c in cells}
    r, pairs = math.sqrt(2 - 2 * cosine), []
    for (d, k), (n, far) in split.items():
        for (e, m), (n2, far2) in split.items():
            if d == e and k <= m and (k == m or np.linalg.norm(tops[d][k] - tops[d][m]) <= r + far + far2 + SLACK):
                pairs.append((d, k, m, n, n2))
    blocks_of = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("cell") == k), n) for (d, k), (n, _) in split.items()]) if split else F.lit(1)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls").combine_chunks()
        x = unit(np.stack(_floats(table.column("v").chunk(0))))
        tree = Tree(x, r / 4)
        data = pickle.dumps((x, tree.centre, tree.cover, tree.children, tree.points, table.column("cls").to_numpy(), table.column("many").to_numpy()), protocol=5)
        return pa.table([table.column("dim")[:1], table.column("cell")[:1], table.column("part")[:1], pa.array([data], pa.binary())], names=["dim", "cell", "part", "tree"])

    def load(data: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
        tree = Tree.__new__(Tree)
        tree.x, tree.centre, tree.cover, tree.children, tree.points, cls, many = pickle.loads(data)  # noqa: S301  written by build()
        tree.root = 0
        return tree, cls, many

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, left, right in zip(*(b.column(i) for i in range(3)), strict=True):
                (a, cls_a, many_a), (c, cls_b, many_b) = load(left.as_py()), load(right.as_py())
                same = same.as_py()
                found = traverse(a, c, many_a, many_b, cosine, same)
                cls = cls_a if same else np.concatenate([cls_a, cls_b])
                hit = np.nonzero(found.count)[0]
                edges = np.array(found.edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.nulls(len(hit), pa.int64()), pa.array(found.count[hit])], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(cls[edges[:, 0]]), pa.array(cls[edges[:, 1]]), pa.nulls(len(edges), pa.int64())], names=["a", "b", "n"])

    part = F.pmod(F.xxhash64("cls"), blocks_of).cast("int")
    trees = dealt.withColumn("part", part).groupBy("dim", "cell", "part").applyInArrow(build, "dim int, cell int, part int, tree binary")
    trees = written(trees, "vector-trees")
    listed = spark.createDataFrame(pairs, "dim int, k int, m int, nk int, nm int")
    listed = listed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nk") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
    listed = listed.where("k < m OR i <= j").withColumn("turn", (F.col("k") + F.col("m") + F.col("i") + F.col("j")) % 2 == 1)
    ends = {s: F.struct("dim", F.when(F.col("turn") == s, F.col("k")).otherwise(F.col("m")).alias("cell"), F.when(F.col("turn") == s, F.col("i")).otherwise(F.col("j")).alias("part")) for s in (True, False)}
    listed = listed.select((F.expr("k = m AND i = j")).alias("same"), ends[True].alias("p"), ends[False].alias("q"))
    one = trees.select(F.struct("dim", "cell", "part").alias("p"), F.col("tree").alias("left"))
    two = trees.select(F.struct("dim", "cell", "part").alias("q"), F.col("tree").alias("right"))
    links = written(listed.join(one, "p").join(two, "q").select("same", "left", "right").mapInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    roots = connected_components(links.where("b IS NOT NULL").select("a", "b"), "vector-components")
    known = classes.select("cls", "h1", "h2", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = written(known.join(least, "root").join(counts, "cls", "left").select("h1", "h2", "n_links", "component_id"), "vector-results")
    keys = rows.select("vec_id", F.when(F.col("valid"), F.col("h1")).alias("h1"), F.when(F.col("valid"), F.col("h2")).alias("h2"))
    out = keys.join(known, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
