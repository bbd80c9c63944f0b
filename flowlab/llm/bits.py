"""Bit tables: sets of ids that tasks can test without a shuffle, and exact filters built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import U, mix, quoted


class BitTable:
    """A set of ids as a table of bits: holds every member, and others by chance."""

    CHUNK = 1 << 10

    def __init__(self, ids: DataFrame):
        n = ids.count()
        self.log2 = min(26, max(16, (16 * n).bit_length()))
        rows = ids.select("id").coalesce(1 + n // 1_000_000).mapInArrow(self._part(self.log2), "chunk int, part binary")
        if n >= 1_000_000:
            rows = rows.repartition("chunk").mapInArrow(self._either, "chunk int, part binary")
        rows = rows.collect()  # 8 MB at most
        self.bits = np.zeros((1 << self.log2) // 8, dtype=np.uint8)
        for r in rows:
            self.bits[r.chunk * self.CHUNK:(r.chunk + 1) * self.CHUNK] = np.frombuffer(r.part, np.uint8)

    @staticmethod
    def place(ids: np.ndarray, log2: int) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) >> U(64 - log2)).astype(np.int64)

    @classmethod
    def _part(cls, log2):
        def run(batches):
            bits = np.zeros((1 << log2) // 8, dtype=np.uint8)
            for batch in batches:
                at = cls.place(np.array(batch.column("id"), dtype=np.int64), log2)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            parts = bits.reshape(-1, cls.CHUNK)
            some = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["chunk", "part"])
        return run

    @staticmethod
    def _either(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint8)
                total[chunk] = total[chunk] | part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "part"])

    def among(self, ids: pa.Array) -> pa.Array:
        """Which of the ids may be members; null is none."""
        at = self.place(np.array(ids.fill_null(0), dtype=np.int64), self.log2)
        return pa.array(((self.bits[at >> 3] >> (at & 7)) & 1 == 1) & np.array(ids.is_valid()))


def _among(table, inside):
    def run(batches):
        for batch in batches:
            among = np.array(table.value.among(batch.column("doc_id")))
            yield batch.filter(pa.array(among if inside else ~among))
    return run


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (id: long), and a few others."""
    table = docs.sparkSession.sparkContext.broadcast(BitTable(ids))
    return docs.mapInArrow(_among(table, True), docs.schema)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (id: long); only rows that may be are shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(BitTable(ids))
    maybe, clear = (docs.mapInArrow(_among(table, inside), docs.schema) for inside in (True, False))
    return clear.union(maybe.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(quoted(docs.columns)))
