"""Exact k-nearest neighbours, a k-NN classifier and local outlier factor.

Of reference rows with one vector only the k of least id can be neighbours;
the others are left out first (a partial top-k before the shuffle).  A
reference of at most ``broadcast_bytes``, as counted, is sent to every task.

A larger one is cut twice.  Rows are dealt to cells by the nearest of at most
``SAMPLE`` of them, one a ``block_rows`` rows; a cell is cut into rings by the
distance to its centre, and a ring with more rows than ``block_rows`` into
parts.  So blocks grow in number, not in size, with the reference.  A query
first meets the block at its own place, which gives a bound for its k-th
neighbour; a centre's distance less a ring's radius bounds how near a block's
rows can be, and the query visits just the blocks that may hold one as near
as its bound, ties included.  Blocks travel in groups of ``GROUP_BYTES``, and a
query goes once to a group, with a bit a block that it visits; it leaves with
its nearest rows of the whole group.  Vectors travel as the table has them
(floats stay floats).  A task gets a group once, with at most some ``VISITS``
queries; a group that more queries visit is copied.  ``probes`` makes the join
approximate: a query visits the blocks of just that many rings, by their
bound and the distance of their cell's centre.  The
driver holds the sample and one row a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowlab.session import store

BLOCK_ROWS = 5_000
SAMPLE = 1024
#: Reference vectors up to this size are sent to every task.
BROADCAST_BYTES = 32 << 20
#: Vectors of the blocks that travel together.
GROUP_BYTES = 16 << 20
#: Queries of one task at one group, and queries in one row.
VISITS, BATCH = 32_000, 500
#: Fewer queries of a group are not dealt to more tasks.
SPREAD = 2_000
LOF_EPS = 1e-10
_FOUND = "query_id long, neighbor_id long, distance double"


def _distances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, to rounding errors of the squares."""
    square = (x * x).sum(axis=1)[:, None] + (m * m).sum(axis=1)[None, :] - 2.0 * x @ m.T
    return np.sqrt(np.maximum(square, 0))


def _slack(x: np.ndarray, m: np.ndarray) -> float:
    """More than _distances can be off by."""
    return 1e-6 * (1 + float(np.sqrt(max((x * x).sum(axis=1).max(initial=0), (m * m).sum(axis=1).max(initial=0)))))


def _nearest(x: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest rows, ties by id, with distances summed in full; with finite ``limit`` none much farther."""
    if limit is None or np.isinf(limit).any():
        off = _distances(x, m)
        kth = np.partition(off, k - 1, axis=1)[:, k - 1] if k < len(ids) else off.max(axis=1)
        q, r = np.nonzero(off <= kth[:, None] + 2 * _slack(x, m))
    else:  # |x - m| <= limit as one product: x.m - |m|^2 / 2 >= (|x|^2 - limit^2) / 2
        least = ((x * x).sum(axis=1) - (limit + 2 * _slack(x, m)) ** 2) / 2
        q, r = np.nonzero(np.hstack([x, np.ones((len(x), 1))]) @ np.hstack([m, -0.5 * (m * m).sum(axis=1)[:, None]]).T >= least[:, None])
    diff = x[q] - m[r]
    return _first(q, ids[r], np.sqrt((diff * diff).sum(axis=1)), k)


def _first(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest, ties by id."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], d[keep]


def _nearest_of_blocks(x: np.ndarray, fits: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest rows in the blocks that it visits (``fits`` [queries, blocks])."""
    best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    limit = np.full(len(x), np.inf)
    for some, (ids, m) in zip(map(np.flatnonzero, fits.T), blocks, strict=True):
        if len(some):
            q, r, d = _nearest(x[some], ids, m, k, limit[some])
            best = _first(*(np.concatenate(pair) for pair in zip(best, (some[q], r, d), strict=True)), k)
            last = np.append(best[0][1:] != best[0][:-1], True)  # a query's farthest row
            full = last & (np.arange(len(last)) - np.searchsorted(best[0], best[0]) == k - 1)
            limit[best[0][full]] = best[2][full]
    return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def knn(queries: DataFrame, reference: DataFrame, k: int, qid: str = "id", rid: str = "id",
        vec: str = "embedding", exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
        probes: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k nearest reference rows of every
    query row by Euclidean distance, ties broken by neighbour id.

    ``exclude_self`` drops the reference row whose id equals the query id
    (neighbours of the reference set within itself).  Rows with a null id or
    vector are left out.
    """
    def ready(df, key):
        return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")

    floats = all(df.schema[vec].dataType.simpleString() == "array<float>" for df in (queries, reference))
    kind = "float" if floats else "double"

    spark, take = queries.sparkSession, k + int(exclude_self)
    same = Window.partitionBy("hash", "v").orderBy("id")
    ref = (ready(reference, rid).withColumn("hash", F.xxhash64("v")).withColumn("nth", F.row_number().over(same))
           .where(F.col("nth") <= take).select("id", "v"))
    q = ready(queries, qid)
    size = ref.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    if not size.n:
        return spark.createDataFrame([], _FOUND + ", rank int")
    if 8 * size["values"] <= broadcast_bytes:
        found = _meet_all(q, ref, take)
    else:
        found = _meet_blocks(q, ref, size.n, take, block_rows, probes, kind)
    if exclude_self:
        found = found.where(F.col("query_id") != F.col("neighbor_id"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet_all(q: DataFrame, ref: DataFrame, take: int) -> DataFrame:
    """Every query against the whole of a small reference."""
    rows = ref.collect()  # at most broadcast_bytes of vectors, as counted
    context = q.sparkSession.sparkContext
    shared = context.broadcast((np.array([r.id for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.float64)))
    step = max(1, 4_000_000 // len(rows))

    def meet(it):
        ids, m = shared.value
        for pdf in it:
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at:at + step]
                a, b, d = _nearest(_matrix(some["v"]), ids, m, take)
                yield pd.DataFrame({"query_id": some["id"].to_numpy()[a], "neighbor_id": b, "distance": d})

    few = q.rdd.getNumPartitions() < context.defaultParallelism
    return (q.repartition(context.defaultParallelism) if few else q).mapInPandas(meet, _FOUND)


def _meet_blocks(q: DataFrame, ref: DataFrame, n: int, take: int, block_rows: int, probes: int | None, kind: str) -> DataFrame:
    """Every query against the blocks that may hold one of its neighbours."""
    sample = ref.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(1, n // block_rows))).collect()
    centres = np.array([r.v for r in sample], dtype=np.float64)

    def deal(it):
        for pdf in it:
            if len(pdf):
                d = _distances(_matrix(pdf["v"]), centres)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"cell": cell, "far": d[np.arange(len(cell)), cell], "id": pdf["id"], "v": pdf["v"]})

    dealt = store(ref.mapInPandas(deal, f"cell int, far double, id long, v array<{kind}>"))
    marks = [i / 1000 for i in range(1, 1000)]
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", marks, 10_000).alias("far")).collect()}
    rings = {c: np.unique(np.array(r.far)[np.unique(np.linspace(0, 998, min(999, -(-r.n // block_rows)) + 1).astype(int)[1:-1])]) for c, r in cells.items()}

    def cut(it):
        for pdf in it:
            ring = np.zeros(len(pdf), dtype=np.int64)
            for c in pdf["cell"].unique():
                at = np.flatnonzero(pdf["cell"] == c)
                ring[at] = np.searchsorted(rings[c], pdf["far"].to_numpy()[at], side="left")
            yield pdf.assign(ring=ring)

    cut_ = dealt.mapInPandas(cut, f"cell int, far double, id long, v array<{kind}>, ring int")
    counts = cut_.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    counts = store(counts.withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")))
    meta = counts.orderBy("cell", "ring").collect()  # a row a ring
    of, ring, parts = (np.array([r[c] for r in meta]) for c in ("cell", "ring", "parts"))
    low, high = (np.array([r[c] for r in meta]) for c in ("lo", "hi"))
    # Blocks are numbered by ring and part; those of a group follow each other, and have a place in it.
    first = np.concatenate([[0], np.cumsum(parts)])
    values = len(sample[0].v) * (4 if kind == "float" else 8)
    row_bytes = np.repeat([r.n / r.parts * values for r in meta], parts)
    group = ((np.cumsum(row_bytes) - row_bytes) // GROUP_BYTES).astype(np.int64)
    start = np.searchsorted(group, np.unique(group))  # a group's first block
    grp = np.searchsorted(start, np.arange(first[-1]), side="right") - 1
    place = np.arange(first[-1]) - start[grp]
    numbers = q.sparkSession.createDataFrame([(int(of[j]), int(ring[j]), p, int(grp[first[j] + p]), int(place[first[j] + p])) for j in range(len(meta)) for p in range(parts[j])],
                                             "cell int, ring int, part int, grp int, place int")
    packed = (cut_.join(F.broadcast(counts.select("cell", "ring", "parts")), ["cell", "ring"])  # a row a ring
              .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
              .join(F.broadcast(numbers), ["cell", "ring", "part"])  # a row a block
              .groupBy("grp", "place").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
              .select("grp", "place", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat")))
    packed = store(packed)
    edges = np.append(start, len(grp)).tolist()

    def bounds(x):
        """How near a row of each ring can be, at least."""
        d = _distances(x, centres)[:, of]
        return np.maximum(np.maximum(d - high, low - d), 0), d

    def batches(pdf):
        for at in range(0, len(pdf), BATCH):
            yield pdf.iloc[at:at + BATCH]

    def trips_of(fits, own, x):
        """A row a group that one of the queries visits; ``fits`` [queries, blocks]."""
        for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            some = np.flatnonzero(fits[:, a:b].any(axis=1))
            if len(some):
                yield {"grp": g, "own": own[some], "x": x[some].astype(kind_of).ravel(), "fits": np.packbits(fits[some, a:b], axis=1).tobytes()}

    kind_of = np.float32 if kind == "float" else np.float64

    def home(it):
        for pdf in it:
            for some in batches(pdf):
                x, own = _matrix(some["v"]), some["id"].to_numpy()
                near, _ = bounds(x)
                fits = np.zeros((len(x), len(grp)), dtype=bool)
                fits[np.arange(len(x)), first[near.argmin(axis=1)]] = True
                yield pd.DataFrame(list(trips_of(fits, own, x)))

    def first_bound(own, x, fits, blocks):
        for some, (ids, m) in zip(map(np.flatnonzero, fits.T), blocks, strict=True):
            if len(some) and len(ids) >= take:
                d = np.partition(_distances(x[some], m), take - 1, axis=1)[:, take - 1] + 2 * _slack(x[some], m)
                yield own[some], d

    def visit(it):
        for pdf in it:
            for some in batches(pdf):
                x, own = _matrix(some["v"]), some["id"].to_numpy()
                near, centre = bounds(x)
                if probes:
                    order = np.argsort(near + centre, axis=1, kind="stable")[:, :probes]
                    fits = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(fits, order, True, axis=1)
                else:
                    fits = near <= some["bound"].fillna(np.inf).to_numpy()[:, None] + 4 * _slack(x, centres)
                yield pd.DataFrame(list(trips_of(np.repeat(fits, parts, axis=1), own, x)))

    def nearest(own, x, fits, blocks):
        a, b, d = _nearest_of_blocks(x, fits, blocks, take)
        yield own[a], b, d

    trip = f"grp int, own array<long>, x array<{kind}>, fits binary"
    if not probes:
        bound = _visit(q.mapInPandas(home, trip), packed, first_bound, "id long, bound double").groupBy("id").agg(F.min("bound").alias("bound"))
        q = q.join(bound, "id", "left")
    return _visit(q.mapInPandas(visit, trip), packed, nearest, _FOUND)


def _visit(trips: DataFrame, packed: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` on every batch of queries and the group of blocks that it visits; a group with many visits is copied."""
    trips = store(trips)
    groups, cores = packed.select("grp").distinct().count(), trips.sparkSession.sparkContext.defaultParallelism
    visits = F.sum(F.size("own"))
    few = F.least(F.ceil(visits / SPREAD), F.lit(-(-cores // max(1, groups))))  # a few groups are spread over all cores
    copies = store(trips.groupBy("grp").agg(F.greatest(F.ceil(visits / VISITS), few).cast("int").alias("copies")))  # a row a group
    spread = trips.join(F.broadcast(copies), "grp").withColumn("copy", F.pmod(F.xxhash64(F.element_at("own", 1)), "copies").cast("int")).drop("copies")
    copied = packed.join(F.broadcast(copies), "grp").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    width = to_arrow_schema(T.StructType.fromDDL(schema))

    def meet(visitors: pa.Table, there: pa.Table) -> pa.Table:
        if not len(visitors):
            return width.empty_table()
        blocks = {}
        for place, ids, flat in zip(there.column("place").to_pylist(), there.column("ids"), there.column("flat"), strict=True):
            ids = ids.values.to_numpy()
            blocks[place] = ids, flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        owns = [own.values.to_numpy() for own in visitors.column("own")]
        own = np.concatenate(owns)
        x = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in visitors.column("x")]).reshape(len(own), -1)
        fits = np.vstack([np.frombuffer(f, np.uint8).reshape(len(o), -1) for f, o in zip(visitors.column("fits").to_pylist(), owns, strict=True)])
        found = []
        for at in range(0, len(own), BATCH):
            some = slice(at, at + BATCH)
            visited = np.unpackbits(fits[some], axis=1).astype(bool)[:, list(blocks)]
            found += kernel(own[some], x[some].astype(np.float64), visited, list(blocks.values()))
        return pa.concat_tables(pa.Table.from_arrays([pa.array(c) for c in columns], schema=width) for columns in found) if found else width.empty_table()

    key = ["grp", "copy"]
    return spread.groupBy(*key).cogroup(copied.groupBy(*key)).applyInArrow(meet, schema)


def knn_classify(train: DataFrame, queries: DataFrame, k: int = 5, qid: str = "id", rid: str = "id",
                 vec: str = "embedding", label: str = "label") -> DataFrame:
    """Majority vote of the k nearest training labels (ties → smallest label)."""
    nn = knn(queries, train, k, qid, rid, vec)
    lab = train.select(F.col(rid).cast("long").alias("neighbor_id"), F.col(label).alias("_lab"))
    votes = nn.join(lab, "neighbor_id").groupBy("query_id", "_lab").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("query_id").orderBy(F.col("_n").desc(), F.col("_lab").asc())
    return (votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("query_id", F.col("_lab").alias("prediction")))


def lof_scores(reference: DataFrame, queries: DataFrame, k: int = 35, qid: str = "id",
               rid: str = "id", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Local outlier factor of every query row against a reference ("normal") set.

    Novelty semantics: the reference rows' k-distance and local reachability
    density use their k nearest *other* reference rows; a query's neighbours
    are its k nearest reference rows (itself included if it is one).
    lrd = 1 / (mean reach-dist + 1e-10), reach-dist(a, o) = max(kdist(o), d(a, o)),
    LOF(q) = mean lrd(o) over q's neighbours / lrd(q).  Output (query_id, lof).
    """
    ref_nn = knn(reference, reference, k, rid, rid, vec, exclude_self=True, block_rows=block_rows)
    kdist = ref_nn.where(F.col("rank") == k).select(F.col("query_id").alias("neighbor_id"),
                                                    F.col("distance").alias("kdist"))
    ref_reach = ref_nn.join(kdist, "neighbor_id").select(
        "query_id", F.greatest("distance", "kdist").alias("reach"))
    lrd_ref = ref_reach.groupBy("query_id").agg(
        (F.lit(1.0) / (F.avg("reach") + F.lit(LOF_EPS))).alias("lrd")) \
        .select(F.col("query_id").alias("neighbor_id"), "lrd")
    q_nn = knn(queries, reference, k, qid, rid, vec, block_rows=block_rows)
    j = q_nn.join(kdist, "neighbor_id").join(lrd_ref, "neighbor_id")
    per = j.groupBy("query_id").agg(
        (F.lit(1.0) / (F.avg(F.greatest("distance", "kdist")) + F.lit(LOF_EPS))).alias("_lrd_q"),
        F.avg("lrd").alias("_lrd_nb"))
    return per.select("query_id", (F.col("_lrd_nb") / F.col("_lrd_q")).alias("lof"))
