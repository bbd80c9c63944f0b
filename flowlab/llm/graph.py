"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.tables import Tables


def _forest(batches):
    """Links each node of a batch of edges to the smallest node it reaches in the batch."""
    for batch in batches:
        a, b = np.array(batch.column("a"), dtype=np.int64), np.array(batch.column("b"), dtype=np.int64)
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[:len(a)], ends[len(a):]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (label[a], label[b], a, b):
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[label[moved]], pa.int64())], ["a", "b"])


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) of every node of ``edges`` (a, b: long).

    Edges are contracted within tasks, then large-star and small-star rounds
    alternate until every edge points at its component.  Nothing but row
    counts reaches the driver.  Loops, repeated and reversed edges are fine;
    edges with a null end are left out.  The result is stored in ``tables``.
    """
    edges = tables.store(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    while True:
        parts = edges.rdd.getNumPartitions()
        both = edges.union(edges.select("b", "a")).coalesce(2 * parts if parts > 1 else 1)
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")).coalesce(parts)
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).coalesce(parts)
        low = large.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts)
        small = (large.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low.select("a", F.col("low").alias("b"))).coalesce(parts).distinct())
        before, edges = edges, tables.store(small)
        tables.drop(before)
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        twice = edges.groupBy("a").count().filter("count > 1").limit(1).count()
        if not inner and not twice:
            break
    found = tables.store(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()))
    tables.drop(edges)
    return found
