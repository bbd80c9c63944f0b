"""Merkle trees over the rows of a dataset: a tree a group, a root over all, and every row's proof.

Leaves are numbered within their group by a range shuffle: a task numbers its
own rows, and the sums of the tasks before it come from a table with a row
per task and group.  Trees grow in passes of ``levels`` levels.  A pass deals
the nodes of a group into blocks of 2^levels consecutive ones, so a group of
any size is spread over all tasks, and no run crosses a block.  Within a
block a level is one lag and one lead column at the fixed offset 2^level,
masked by a node's slot in its run and by the length of the run; rows that
begin a run hash it to the parent, and a running ``last`` hands each node's
sibling to the rows below it.  Passes go on while a group has several nodes.
Siblings come back down by joining a block's rows with the node that the
block became.

Defined results: a null field is ``-``; a null group comes first; null order
keys come first; equal keys are ordered by leaf, and equal rows each get a
place and a proof; a group of one leaf has that leaf as its subroot and, if
it is the only group, as root; an empty table has no rows and no root;
columns of the rows named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.tables import Tables
from flowlab.llm.text import quoted

#: Levels of a pass: blocks of 256 nodes.
LEVELS = 8
RESULT = ["leaf", "subroot", "root", "path"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def record_digest(*fields: Column) -> Column:
    """The leaf of a row: each field as its byte count, a colon and its text; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, level by level."""
    return digest(F.array_join(F.filter(path["sibling"], lambda s: s.isNotNull()), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def up(node: Column, step: Column) -> Column:
        sibling = F.coalesce(step["sibling"], F.lit(""))
        return digest(F.when(step["right"], F.concat(sibling, node)).otherwise(F.concat(node, sibling)))

    return F.aggregate(path, leaf, up)


def merkle_paths(rows: DataFrame, leaf: Column, group: str, order: str, levels: int = LEVELS, tables: Tables | None = None) -> DataFrame:
    """``rows`` with RESULT columns: leaf, its group's subroot, the root, and the path (array of sibling, right) from leaf to root.

    The other columns travel through the shuffles with the rows: select those that are needed.
    """
    if tables is None:
        with Tables(rows.sparkSession) as own:
            return merkle_paths(rows, leaf, group, order, levels, own)
    columns = [c for c in rows.columns if c.lower() not in RESULT]
    key = F.col(quoted([group])[0]).cast("string")
    packed = rows.select(F.struct(*quoted(columns)).alias("row"), leaf.alias("node"), F.col(quoted([order])[0]).alias("k"),
                         F.when(key.isNull(), "").otherwise(F.concat(F.lit("+"), key)).alias("g"))
    joined = _tree(tables, packed, levels)
    subroots = joined[-1].select("g", F.col("node").alias("subroot"))
    above = _tree(tables, subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("subroot").alias("node")), levels)
    root = above[-1].select("g", F.col("node").alias("root"))
    tops = _paths(above, root.withColumn("path", F.expr("CAST(array() AS array<struct<sibling:string,right:boolean>>)")), ["root"], levels)
    tops = tables.store(tops.select(F.col("k").alias("g"), F.col("node").alias("subroot"), "root", "path"), rows=None)
    out = _paths(joined, tops, ["subroot", "root"], levels)
    tables.keep(tops)
    for t in joined:
        tables.keep(t)
    return out.withColumnRenamed("node", "leaf").select("row.*", *RESULT)


def _tree(tables: Tables, leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The stored nodes at the bottom of each pass: g, i (place in the group), m (nodes of the group there), node; the last one has a node a group."""
    by = [F.col("g"), F.col("k").asc_nulls_first(), F.col("node"), F.col("salt")]
    dealt = tables.store(leaves.withColumn("salt", F.rand(7)), rows=None)  # equal rows are split at random, and drawn once
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("at", F.monotonically_increasing_id())
    dealt = tables.store(dealt, rows=None).withColumns({"task": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    starts = dealt.groupBy("task", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("g").orderBy("task")
    starts = starts.select("task", "g", (F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") - F.col("first")).alias("shift"),
                           F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    starts = tables.store(starts, rows=None)
    most = starts.agg(F.max("m")).first()[0] or 0
    passes = [tables.store(dealt.join(starts, ["task", "g"]).withColumn("i", F.col("at") + F.col("shift")).drop("task", "at", "shift"), rows=None)]
    while most > 1:
        first = _levels(passes[-1], levels).filter(F.col("i") % (1 << levels) == 0)
        up = first.select("g", F.shiftright("i", levels).alias("i"), F.ceil(F.col("m") / (1 << levels)).alias("m"), F.col(f"node{levels}").alias("node"))
        passes.append(tables.store(up, rows=None))
        most = -(-most // (1 << levels))
    return passes


def _levels(nodes: DataFrame, levels: int) -> DataFrame:
    """Columns node0 … node<levels> (at the first row of a node's leaves) and step0 … (sibling, right; at the same rows), block by block."""
    i, m = F.col("i"), F.col("m")
    of_block = Window.partitionBy("g", "block").orderBy("i")
    out = nodes.withColumn("block", F.shiftright("i", levels)).withColumn("node0", F.col("node"))
    for level in range(levels):
        wide = 1 << level
        begins, second = i % wide == 0, F.shiftright("i", level) % 2 == 1
        grows = m > wide  # the group has several nodes at this level
        out = out.withColumns({"before": F.lag(f"node{level}", wide).over(of_block), "after": F.lead(f"node{level}", wide).over(of_block)})
        sibling = F.when(grows & begins, F.when(second, F.col("before")).otherwise(F.col("after")))
        out = out.withColumn(f"step{level}", F.when(begins, F.struct(sibling.alias("sibling"), second.alias("right")))).drop("before", "after")
        parent = F.when(grows, digest(F.col(f"node{level}"), F.coalesce(F.col(f"step{level}")["sibling"], F.lit("")))).otherwise(F.col(f"node{level}"))
        out = out.withColumn(f"node{level + 1}", F.when(i % (2 * wide) == 0, parent))
    return out


def _paths(passes: list[DataFrame], top: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """The rows of the lowest pass with their whole path and the columns that ``top`` (g, path, carried) has for their group."""
    top = top.withColumn("i", F.lit(0).cast("long"))
    for nodes in reversed(passes[:-1]):
        out = _levels(nodes, levels)
        so_far = Window.partitionBy("g", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = F.array(*[F.last(f"step{level}", ignorenulls=True).over(so_far) for level in range(levels)])
        out = out.withColumn("own", steps).drop(*[f"{c}{level}" for level in range(levels + 1) for c in ("node", "step")])
        used = sum((F.col("m") > (1 << level)).cast("int") for level in range(levels))
        above = top.select("g", F.col("i").alias("block"), F.col("path").alias("rest"), *carried)
        top = out.join(above, ["g", "block"]).withColumn("path", F.concat(F.slice("own", F.lit(1), used), F.col("rest"))).drop("own", "rest", "block")
    if len(passes) == 1:
        top = passes[0].join(top.drop("i"), "g")
    return top
