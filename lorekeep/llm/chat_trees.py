"""Reply trees to training conversations.

Messages (tree, node, parent, role, text, score) form trees. Iterative self-joins double the distance of each node's
known ancestor, so a tree of depth d takes log2(d) joins; the same joined levels then list the nodes of each chosen
root-to-leaf path. Branches are ranked by the sum of their messages' scores, and each chosen path is formatted as one
conversation, with the spans that training loss covers (the texts of the trained role).

Template: each turn is ``### role: text</turn>`` and a line feed. In roles and texts the escape character and both
control strings are escaped, so reading back is exact: ``\\`` is doubled, ``###`` is ``\\h`` and ``</turn>`` is ``\\e``; in
roles ``:`` is ``\\c``. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))


def unescaped(text: Column) -> Column:
    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>"))
        return F.replace(x, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def paths(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, role, text): the messages of each chosen root-to-leaf path, depth 1 at the root.

    rank 1 is the branch of the highest summed score (null scores count 0; ties by leaf); the first per_tree ranks are
    chosen, all if None. A parent that is not there makes its child a root. Of rows with the same (tree, node) the least
    by (parent, role, text, score) counts. Nodes on or below a cycle have no root and give no path; a null node gives
    none; rows without a tree are one tree. An empty table gives no rows.
    """
    if messages.schema["tree"].nullable and not messages.where("tree IS NULL").isEmpty():
        wrapped = messages.withColumn("tree", F.struct("tree"))  # equal to itself even around a null
        return _paths(wrapped, per_tree).withColumn("tree", F.col("tree.tree"))
    return _paths(messages, per_tree)


def _paths(messages: DataFrame, per_tree: int | None) -> DataFrame:
    fields = F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = messages.where("tree IS NOT NULL AND node IS NOT NULL").groupBy("tree", "node").agg(F.min(fields).alias("m")).select("tree", "node", "m.*")
    nodes = written(nodes, "tree-nodes")
    start = nodes.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth"))
    rooted, climbing, levels = [start.where("up IS NULL")], start.where("up IS NOT NULL"), []
    for _ in range(nodes.count().bit_length() + 1):  # nodes that still climb after that are on or below a cycle
        if climbing.isEmpty():
            break
        levels.append(climbing.select("tree", "node", "up"))
        whole = climbing
        for table in rooted:
            whole = whole.unionByName(table)
        far = whole.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        joined = climbing.join(far, ["tree", "up"], "left")
        step = written(
            joined.select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")),
            "tree-ancestors",
        )
        rooted, climbing = [*rooted, step.where("up IS NULL")], step.where("up IS NOT NULL")
    ends = rooted[0]
    for table in rooted[1:]:
        ends = ends.unionByName(table)
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = ends.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), rank.alias("rank"))
    chosen = chosen if per_tree is None else chosen.where(F.col("rank") <= per_tree)
    on_path = written(chosen.withColumn("node", F.col("leaf")), "tree-paths")
    for level in levels:  # after k levels, the nodes less than 2^k above the leaf; only paths that go on get new rows
        more = on_path.join(level, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        on_path = on_path.unionByName(written(more, "tree-paths"))
    found = nodes.select("tree", "node", "role", "text").join(ends.select("tree", "node", "depth"), ["tree", "node"])
    return on_path.join(found, ["tree", "node"]).select("tree", "leaf", "rank", "depth", "role", "text")


def format_paths(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one row per path; loss has the (start, end) code point spans of the trained
    role's texts within formatted, in order. Null roles and texts count as empty."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(HEAD), role, F.lit(COLON))
    rows = turns.select("tree", "leaf", "rank", "depth", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("trained"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    whole = F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"))))
    return rows.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.array_join(F.transform(whole, lambda x: x["turn"]), "").alias("formatted"), F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss")
    )


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def turn(x: Column) -> Column:
        at = F.locate(COLON, x)
        return F.struct(unescaped(F.substring(x, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"), unescaped(F.substring(x, at + len(COLON), F.length(x))).alias("text"))

    parts = F.split(formatted, END)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss spans, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def reply_chains(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn replies to the one before it.

    Turns go by (turn, role, text), nulls first, so repeated turns stay, in that order.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = F.row_number().over(order).cast("bigint")
    placed = rows.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text")
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
