"""Online (chunked) linear models on Structured Streaming.

Rows arrive as micro-batches of a streaming DataFrame, or a stream of numbers
says which chunks of a stored table come next (the table is dealt to its
chunks in one write; a batch takes BATCH_CHUNKS of them).  Every chunk starts
from the weights of the one before it, so the small chunks of a batch are
learnt in turn by one task of at most TURN_ROWS rows, in one job; chunks of a
batch with more rows are learnt one by one as a batch of rows is.
``foreachBatch`` turns each batch into distributed work:

* log-loss model: a few full-batch gradient steps per micro-batch, each one
  aggregation (``avg((p − y)·w_y·x)``) — the driver only sees d+1 numbers;
* passive-aggressive (PA-I): every partition runs the sequential PA update
  over its rows in ``mapInPandas`` starting from the current weights; the
  partition results are averaged weighted by row count (iterative parameter
  mixing), so the result depends on how a batch is partitioned.  This is a different algorithm from one sequential pass over all
  rows; it is the standard distributed form of PA.

The weights and the last processed ``batchId`` are stored together in the
shared checkpoint folder after every batch, so a replayed batch (restart
after failure) is skipped instead of being applied twice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlab.session import checkpoint_dir

#: Chunks of a batch, and the most rows of a batch that one task learns from chunk by chunk.
BATCH_CHUNKS, TURN_ROWS = 64, 200_000


class ModelState:
    """Weights + last batch id, persisted through Spark (works on HDFS/S3 too).

    Every batch writes a version of its own (``v=<batch id>``), so a crash
    while writing leaves the version before it whole; the newest one is read.
    Only a missing path counts as no state; any other error is raised.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path = spark, path
        self.w = np.zeros(dim + 1)  # last entry = intercept
        self.last_batch = -1
        self.batches = 0
        self.rows = 0
        try:
            r = spark.read.schema(f"{self.FIELDS}, v long").json(path).orderBy(F.col("last_batch").desc()).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            r = None
        if r is not None:
            self.w = np.array(json.loads(r["w"]))
            self.last_batch, self.batches, self.rows = r["last_batch"], r["batches"], r["rows"]

    FIELDS = "w string, last_batch long, batches long, rows long"

    def save(self) -> None:
        rec = [(json.dumps(self.w.tolist()), self.last_batch, self.batches, self.rows)]
        self.spark.createDataFrame(rec, self.FIELDS).coalesce(1).write.mode("overwrite").json(f"{self.path}/v={self.last_batch}")


def _xy(df: DataFrame, features: list[str], y: str, *more: str) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
                     F.col(y).cast("double").alias("_y"), *more)


def _in_turn(rows: DataFrame, column: str, w: np.ndarray, learn) -> np.ndarray:
    """``learn(x, y, w)`` of each chunk's rows as they are stored, chunk after chunk, by one task; ``rows`` come from ``_xy``."""
    start = w.copy()

    def run(it):
        parts = [pdf for pdf in it if len(pdf)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        v = start.copy()
        for _, part in rows.groupby(column, sort=True):  # keeps the rows of a chunk in their order
            v = learn(np.array(part["_x"].tolist(), dtype=np.float64), part["_y"].to_numpy(dtype=np.float64, na_value=np.nan), v)
        yield pd.DataFrame({"w": [v.tolist()]})

    out = rows.coalesce(1).mapInPandas(run, "w array<double>").first()
    return w if out is None else np.array(out.w)


def logistic_step(batch: DataFrame, w: np.ndarray, features: list[str], y: str,
                  class_weight: dict[int, float], lr: float, alpha: float, steps: int = 1, column: str | None = None) -> np.ndarray:
    """One weighted log-loss gradient step over the whole batch (one aggregation).

    With ``column``, ``steps`` of them over each of its chunks in turn (one job).  Rows with a null have no gradient.
    """
    w0, w1 = float(class_weight.get(0, 1.0)), float(class_weight.get(1, 1.0))
    if column:
        def learn(x, t, v):
            x, t = x[~np.isnan(t)], t[~np.isnan(t)]
            for _ in range(steps if len(t) else 0):
                with np.errstate(over="ignore"):
                    r = (1.0 / (1.0 + np.exp(-(x @ v[:-1] + v[-1]))) - t) * np.where(t == 1, w1, w0)
                grad = np.append(r @ x, r.sum()) / len(t)
                grad[:-1] += alpha * v[:-1]
                v = v - lr * grad
            for _ in range(0 if len(t) else steps):  # no gradient but the penalty's
                v = v - lr * alpha * np.append(v[:-1], 0.0)
            return v
        known = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in features]), lambda ok: ok), F.col(y))
        zeros = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
        return _in_turn(_xy(batch.withColumns({y: known}).withColumns(zeros), features, y, column), column, w, learn)
    z = sum((F.col(c).cast("double") * F.lit(float(w[i])) for i, c in enumerate(features)),
            F.lit(float(w[-1])))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    yy = F.col(y).cast("double")
    wy = F.when(yy == 1, F.lit(w1)).otherwise(F.lit(w0))
    r = (p - yy) * wy
    g = batch.agg(*[F.avg(r * F.col(c).cast("double")).alias(f"g{i}") for i, c in enumerate(features)],
                  F.avg(r).alias("gb")).first()
    grad = np.array([g[f"g{i}"] or 0.0 for i in range(len(features))] + [g["gb"] or 0.0])
    grad[:-1] += alpha * w[:-1]
    return w - lr * grad


def pa_mix(batch: DataFrame, w: np.ndarray, features: list[str], y: str,
           class_weight: dict[int, float], c: float = 1.0, column: str | None = None) -> np.ndarray:
    """PA-I per partition from the current weights, averaged by rows (parameter mixing); with ``column``, over each of its chunks in turn."""
    start = w.copy()
    cw0, cw1 = float(class_weight.get(0, 1.0)), float(class_weight.get(1, 1.0))

    def learn(X, t, v):
        Y = np.where(t > 0, 1.0, -1.0)
        for xi, yi in zip(X, Y):
            xa = np.append(xi, 1.0)
            loss = max(0.0, 1.0 - yi * float(v @ xa))
            if loss > 0:
                cap = c * (cw1 if yi > 0 else cw0)
                tau = min(cap, loss / float(xa @ xa))
                v = v + tau * yi * xa
        return v

    if column:
        return _in_turn(_xy(batch, features, y, column), column, w, learn)

    def run(it):
        v = start.copy()
        n = 0
        for pdf in it:
            if pdf.empty:
                continue
            v = learn(np.vstack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(), v)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"w": [json.dumps(v.tolist())], "n": [n]})

    parts = _xy(batch, features, y).mapInPandas(run, "w string, n long").collect()  # one row per partition
    if not parts:
        return w
    tot = sum(r["n"] for r in parts)
    return sum(np.array(json.loads(r["w"])) * (r["n"] / tot) for r in parts)


def run_online(stream: DataFrame, features: list[str], y: str, method: str,
               class_weight: dict[int, float], name: str, lr: float = 0.5, steps: int = 10,
               alpha: float = 1e-4, c: float = 1.0, chunks: "Chunks | None" = None) -> ModelState:
    """Drain ``stream`` (trigger availableNow) through an online model; returns the final state.

    With ``chunks``, batch i of the stream stands for chunks BATCH_CHUNKS * i … of that table.
    """
    if method not in ("log_loss", "passive_aggressive"):
        raise ValueError(f"unknown method {method!r}")
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    state = ModelState(spark, f"{root}/state", len(features))

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= state.last_batch:
            return  # replayed micro-batch: already applied
        b = (chunks.read_batch(batch_id) if chunks else batch).persist()
        sizes = {r[0]: r[1] for r in b.groupBy(chunks.column).count().collect()} if chunks else {None: b.count()}  # a row a chunk
        sizes = {i: n for i, n in sizes.items() if n}
        if chunks and sum(sizes.values()) <= TURN_ROWS:
            turns = [(b, chunks.column)] if sizes else []
        else:
            turns = [(b.where(F.col(chunks.column) == i) if chunks else b, None) for i in sorted(sizes)]
        for rows, column in turns:
            if method == "passive_aggressive":
                state.w = pa_mix(rows, state.w, features, y, class_weight, c, column)
            elif column:
                state.w = logistic_step(rows, state.w, features, y, class_weight, lr, alpha, steps, column)
            else:
                for _ in range(steps):
                    state.w = logistic_step(rows, state.w, features, y, class_weight, lr, alpha)
        state.batches += len(sizes)
        state.rows += sum(sizes.values())
        state.last_batch = batch_id
        state.save()
        b.unpersist()

    q = (stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
         .option("checkpointLocation", f"{root}/stream").start())
    q.awaitTermination()
    return state


def predict(df: DataFrame, w: np.ndarray, features: list[str], out: str = "prediction") -> DataFrame:
    """Linear decision ``w·x + b >= 0`` as 0/1, plus the sigmoid ``score``."""
    z = sum((F.col(c).cast("double") * F.lit(float(w[i])) for i, c in enumerate(features)), F.lit(float(w[-1])))
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).withColumn(out, (z >= 0).cast("int"))


@dataclass(frozen=True)
class Chunks:
    """A table dealt to chunks 0 … n - 1: a folder a chunk."""
    spark: SparkSession
    root: str
    column: str
    schema: StructType
    n: int

    def read(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self.column}={i}")

    def read_batch(self, i: int) -> DataFrame:
        """The chunks of batch ``i``, with their numbers."""
        paths = [f"{self.root}/{self.column}={k}" for k in range(i * BATCH_CHUNKS, min(self.n, (i + 1) * BATCH_CHUNKS))]
        schema = StructType([*self.schema.fields, StructField(self.column, LongType())])
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)

    def stream(self) -> DataFrame:
        """A file a batch, of a number each, so batch i stands for the i-th BATCH_CHUNKS chunks whatever the files' order."""
        return self.spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{self.root}_numbers")


def write_chunks(df: DataFrame, chunk_col: str, root: str) -> Chunks:
    """Deal ``df`` to its chunks in one write, whatever their number, and write the batches' numbers in another; ``df`` is read once."""
    spark = df.sparkSession
    df.repartition(chunk_col).write.partitionBy(chunk_col).parquet(root)
    most = spark.read.parquet(root).agg(F.max(chunk_col)).first()[0]
    n = 0 if most is None else int(most) + 1
    batches = -(-n // BATCH_CHUNKS)
    spark.range(0, batches, 1, max(1, batches)).select(F.col("id").cast("string")).write.text(f"{root}_numbers")
    return Chunks(spark, root, chunk_col, df.drop(chunk_col).schema, n)
