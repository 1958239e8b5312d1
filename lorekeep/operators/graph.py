"""Bounded neighbourhoods over typed edges (GRAPH-01..04), degrees, and the recursive walk used to check them.

An edge is walked both ways as two rows (node, other), so expansion is an equi-join and never an OR-join. adjacency()
stores those rows in order of their node, as an index would; walks over it read only the row groups of their frontier.
Every function takes either edges or such a stored adjacency, which is worth making once for many walks.

A walk from one root keeps its frontier on the driver as long as it has at most FRONTIER nodes, and each level is then one
filtered scan; larger frontiers and many roots are tables, and each level is one join that starts from the frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.store import checkpointed

EDGE = ["id", "source_entity_id", "target_entity_id", "relation_type", "confidence"]
#: A frontier is sent to all tasks up to this many rows of two ids of at most 64 bytes (6 MB); larger ones are shuffled.
BROADCAST_ROWS = 50_000
#: Nodes of a single root's walk that the driver keeps.
FRONTIER = 10_000
#: A root's rows are ranked in so many parts first, and only the best of each part are ranked together.
PARTS = 64
#: Rows of an adjacency in a range, about a hundred bytes each.
SORTED = 500_000


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """JOIN-11: (node, other, id, columns) with two rows per active edge; of a stored adjacency, its columns.

    The columns may name out: whether node is the edge's source.
    """
    if "node" in edges.columns:
        first, second = F.when(F.col("out"), F.col("node")), F.when(F.col("out"), F.col("other"))
        ends = {"source_entity_id": first.otherwise(F.col("other")), "target_entity_id": second.otherwise(F.col("node"))}
        return edges.select("node", "other", "id", *[ends[c].alias(c) if c in ends else c for c in columns])
    live = edges.where("status = 'active'")
    end = lambda node, other, out: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(out).alias("out"))
    ends = F.array(end("source_entity_id", "target_entity_id", True), end("target_entity_id", "source_entity_id", False))
    plain = [c for c in columns if c != "out"]
    return live.select("id", *plain, F.explode(ends).alias("e")).select("e.node", "e.other", "id", *["e.out" if c == "out" else c for c in columns])


def adjacency(edges: DataFrame) -> DataFrame:
    """The active edges as a stored table, two rows each, in ranges of (node, id): a hub's rows are spread over files, and
    a filter on node skips all files and row groups but its own. A range has about SORTED rows, which a task sorts in memory;
    an edge's source and target are not stored beside node and other."""
    n = max(1, -(-2 * edges.count() // SORTED))
    return checkpointed(both_ways(edges, "out", *EDGE[3:]).repartitionByRange(n, "node", "id").sortWithinPartitions("node", "id"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _first(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """rows with at: their place within their root by the order; rows that cannot be among the first k are left out.

    A root's rows are ranked in parts before they are ranked together, so no task has all rows of a root.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    early = F.row_number().over(Window.partitionBy("root", "_part").orderBy(*order))
    few = rows.withColumn("_part", part).withColumn("_early", early).where(F.col("_early") <= k).drop("_part", "_early")
    return few.withColumn("at", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("at") <= k)


def levels(edges: DataFrame, roots: DataFrame, max_depth: int, max_nodes: int = 0) -> tuple[DataFrame, DataFrame]:
    """((root, node, lvl), (root, truncated)): nodes at levels 0 .. max_depth - 1 of every root at once.

    roots has a column root. max_nodes (0: no bound) limits each root's nodes, the least ids of a level first; a root
    whose walk was cut is truncated. All roots advance together: one join and one ranking per level, however many.
    """
    pairs = both_ways(edges)
    seen = checkpointed(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("lvl")).distinct())
    cut = seen.select("root", F.lit(False).alias("truncated"))
    front, count = seen, seen.count()
    for lvl in range(1, max_depth):
        near = _small(front.select("root", "node"), count).join(pairs, "node").select("root", F.col("other").alias("node")).distinct()
        near = near.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        if max_nodes:
            room = seen.groupBy("root").agg((max_nodes - F.count("*")).alias("room"))
            ranked = checkpointed(_first(near, max_nodes + 1, "node").join(room, "root").where(F.col("at") <= F.col("room") + 1))
            over = ranked.groupBy("root").agg(F.max(F.col("at") > F.col("room")).alias("over"))
            cut = checkpointed(cut.join(over, "root", "left").select("root", (F.col("truncated") | F.coalesce("over", F.lit(False))).alias("truncated")))
            near = ranked.where(F.col("at") <= F.col("room")).select("root", "node").withColumn("lvl", F.lit(lvl))
            seen = checkpointed(seen.unionByName(near))
            front = seen.where(F.col("lvl") == lvl).join(cut.where("truncated").select("root"), "root", "left_anti")
        else:
            front = checkpointed(near.withColumn("lvl", F.lit(lvl)))
            seen = seen.unionByName(front)
        count = front.count()
        if not count:
            break
    return seen, cut


def _odd(edges: DataFrame, seen: DataFrame) -> DataFrame | None:
    """The roots with a seen node that is the source of an edge and the target of another; None where no node is.

    The edges between a root's other nodes lead from sources to targets, so two nodes of one level have none between them:
    at depth 2 an edge is met from both ends only where one of them is the root, and need not be looked for.
    """
    sides = both_ways(edges, "out").groupBy("node").agg(F.min("out").alias("least"), F.max("out").alias("most"))
    mixed = checkpointed(sides.where("least <> most").select("node"))
    count = mixed.count()
    return checkpointed(seen.join(_small(mixed, count), "node", "left_semi").select("root").distinct()) if count else None


def neighborhoods(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_nodes: int = 1000, max_edges: int = 0) -> DataFrame:
    """GRAPH-01 for many roots: root, depth, relationship_id, the edge's columns, truncated.

    Every active edge that touches a node of a level below max_depth, at depth 1 + its least level; per root ordered by
    (depth, relationship_id) and cut to max_edges (0: no cut). truncated is constant per root. Unknown roots, roots
    without edges and max_depth < 1 give no rows.
    """
    if max_depth < 1:
        return neighborhoods(edges, roots.limit(0), 1, max_nodes, max_edges)
    seen, cut = levels(edges, roots, max_depth, max_nodes)
    kept = [F.first(c).alias(c) for c in EDGE[1:]]
    met = lambda known: _small(known, known.count()).join(both_ways(edges, *EDGE[1:], "out"), "node")
    several = lambda known: met(known).groupBy("root", "id").agg((F.min("lvl") + 1).alias("depth"), *kept)
    once = lambda known: met(known).where(F.when(F.col("lvl") == 0, (F.col("node") != F.col("other")) | F.col("out")).otherwise(F.col("other") != F.col("root"))).select("root", "id", (F.col("lvl") + 1).alias("depth"), *EDGE[1:])
    if max_depth == 1:
        met = once(seen)
    elif max_depth > 2:
        met = several(seen)
    else:
        odd = _odd(edges, seen)
        met = once(seen) if odd is None else once(seen.join(odd, "root", "left_anti")).unionByName(several(seen.join(odd, "root", "left_semi")))
    found = met.join(_small(cut, cut.count()), "root") if max_nodes else met.withColumn("truncated", F.lit(False))
    if max_edges:
        found = checkpointed(_first(found, max_edges + 1, "depth", "id"))
        over = found.where(F.col("at") > max_edges).select("root", F.lit(True).alias("_over"))
        found = found.where(F.col("at") <= max_edges).join(over, "root", "left").withColumn("truncated", F.col("truncated") | F.col("_over").isNotNull())
    return found.select("root", "depth", F.col("id").alias("relationship_id"), *EDGE[1:], "truncated")


def _walk(adj: DataFrame, root: str, max_depth: int, max_nodes: int) -> tuple[dict[str, int], bool] | None:
    """(level by node, truncated) of one root; None where a frontier outgrows the driver's share."""
    seen, front = {root: 0}, [root]
    for lvl in range(1, max_depth):
        room = max_nodes - len(seen) if max_nodes else FRONTIER
        if max_nodes > FRONTIER or not front:
            return (seen, False) if not front else None
        near = adj.where(F.col("node").isin(front) & ~F.col("other").isin(list(seen))).select("other").distinct()
        got = [r[0] for r in (near.orderBy("other") if max_nodes else near).limit(room + 1).collect()]  # at most FRONTIER + 1
        if not max_nodes and len(got) + len(seen) > FRONTIER:
            return None
        seen |= dict.fromkeys(got[:room], lvl)
        if len(got) > room:
            return seen, True
        front = got
    return seen, False


def neighborhood(edges: DataFrame, root: str, max_depth: int = 2, max_nodes: int = 1000, max_edges: int = 0) -> DataFrame:
    """GRAPH-01 for one root, in (depth, relationship_id) order."""
    spark = edges.sparkSession
    adj = both_ways(edges, *EDGE[1:])
    walked = _walk(adj, root, max_depth, max_nodes) if max_depth >= 1 else None
    if walked is None:
        roots = spark.createDataFrame([(root,)], "root string")
        return neighborhoods(edges, roots, max_depth, max_nodes, max_edges).drop("root").orderBy("depth", "relationship_id")
    seen, truncated = walked
    known = F.broadcast(spark.createDataFrame(list(seen.items()), "node string, lvl int"))  # at most FRONTIER rows
    touched = adj.where(F.col("node").isin(list(seen))) if len(seen) <= 1000 else adj
    rows = touched.join(known, "node").join(known.select(F.col("node").alias("other"), F.col("lvl").alias("_far")), "other", "left")
    # An edge between two known nodes is met from both ends: the nearer one counts, and of equal ones the source.
    nearer = F.col("_far").isNull() | (F.col("_far") > F.col("lvl")) | ((F.col("_far") == F.col("lvl")) & (F.col("node") == F.col("source_entity_id")))
    found = rows.where(nearer).select((F.col("lvl") + 1).alias("depth"), F.col("id").alias("relationship_id"), *EDGE[1:])
    if max_edges:
        truncated = truncated or found.limit(max_edges + 1).count() > max_edges
    found = found.withColumn("truncated", F.lit(truncated)).orderBy("depth", "relationship_id")
    return found.limit(max_edges) if max_edges else found


def resolve_heads(entities: DataFrame, ids: DataFrame, hops: int = 8) -> DataFrame:
    """GRAPH-04: (id, head); merges keep pointers one hop deep, so further hops are a defence. Unknown ids are their own."""
    to = entities.where("merged_into_entity_id IS NOT NULL").select(F.col("id").alias("head"), F.col("merged_into_entity_id").alias("next"))
    out = ids.select("id", F.col("id").alias("head"))
    for _ in range(hops):
        out = out.join(to, "head", "left").select("id", F.coalesce("next", "head").alias("head"))
        if hops > 1 and out.join(to, "head", "left_semi").isEmpty():
            break
    return out


def graph_query(state: dict[str, DataFrame], entity_id: str, depth: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """GRAPH-03, JOIN-23, FLT-14: (edges, nodes) around an entity or, if it was merged, around its head."""
    from lorekeep.operators.listing import NotFoundError, clamp

    spark = state["entities"].sparkSession
    head = resolve_heads(state["entities"], spark.createDataFrame([(entity_id,)], "id string")).first().head
    if state["entities"].where(F.col("id") == head).isEmpty():
        raise NotFoundError(f"entity {entity_id}")
    edges = neighborhood(state["relationships"], head, clamp(depth, 2, 1, 5), 1000, clamp(max_edges, 2000, 1, 50_000))
    ends = edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).union(spark.createDataFrame([(head,)], "id string")).distinct()
    return edges, state["entities"].join(ends, "id", "left_semi").select("id", "name", "kind")


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-03: (id, degree) of all entities; edges of any status count, 0 is kept."""
    ends = edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).groupBy("id").count()
    return entities.select("id").join(ends, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree"))


def path_walk_sql(root: str, max_depth: int) -> str:
    """GRAPH-02 as SQL over a view und(node, other): the node set by a recursive walk, for checking levels()."""
    return f"""
        WITH RECURSIVE walk(node, lvl) AS (
          SELECT '{root}', 0 UNION ALL SELECT und.other, walk.lvl + 1 FROM walk JOIN und ON und.node = walk.node WHERE walk.lvl < {max_depth - 1}
        ) SELECT node, min(lvl) AS lvl FROM walk GROUP BY node"""
