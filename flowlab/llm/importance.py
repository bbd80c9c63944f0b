"""Importance resampling towards a target corpus, by hashed n-gram features.

A document's separator-normalised form (its words, each after one space) is
scanned once, and the running CRC-32 at every word's end is stored.  The CRC
of any n-gram follows from two of them: with A the text before the n-gram and
B the n-gram, crc(AB) = crc(A) * x^(8 |B|) + crc(B) over GF(2), so crc(B) is
crc(AB) with the shifted crc(A) cancelled.  Shifting by some bytes is linear
in the bits of the CRC: tables by byte for lengths below 64, and for each
further power of two its table.

Every feature falls into a bucket (CRC modulo ``buckets``); a bucket's gain
is the log ratio of its smoothed shares in target and corpus.  Counts are
summed within tasks before the shuffle; the driver holds one number a
bucket.  A document's weight is the mean gain of its features, and documents
are drawn without replacement by Gumbel noise from a hash of their id.

Defined results: a null or word-less text has no features and weight 0; an
empty target or corpus counts nothing; repeated rows each count, and each is
scored and ranked; a null id hashes as the empty text and comes after others
of the same score; equal scores go to the lesser id; columns of the documents
named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlab.llm.tables import Tables
from flowlab.llm.text import ALNUM, LOWER, quoted, slices

BUCKETS = 10_000
WEIGHED = ["n_words", "n_features", "weight"]
DRAWN = ["score", "rank"]

#: Bytes of words stay, in lower case; all others become a space.
_NORMAL = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))
_PIECES = re.compile(rb" [^ ]+").findall
_SPACE = np.uint32(zlib.crc32(b" "))


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """The CRC register after one zero byte, bit by bit."""
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


def _look_up(table: np.ndarray, crc: np.ndarray, which: np.ndarray | int = 0) -> np.ndarray:
    """``table``: shift by a number of bytes, for each of the register's four bytes."""
    out = table[which, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ table[which, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Shift:
    """Multiplies CRCs by x^(8 n): the effect of n more bytes."""

    SHORT = 64

    def __init__(self):
        now = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        tables = [now]
        for _ in range(self.SHORT):
            tables.append(_zero_byte(tables[-1]))
        self.short = np.stack(tables[:-1])
        self.doubled = [tables[-1][None]]  # 64, 128, 256, … bytes

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        crc = _look_up(self.short, crc, n & (self.SHORT - 1))
        n, k = n >> 6, 0
        while n.any():
            if k == len(self.doubled):
                self.doubled.append(_look_up(self.doubled[-1], self.doubled[-1]))
            odd = np.flatnonzero(n & 1)
            crc[odd] = _look_up(self.doubled[k], crc[odd])
            n, k = n >> 1, k + 1
        return crc


class Scan:
    """Running CRCs of normalised texts: at every word's end, and where the word begins."""

    def __init__(self, texts: list[bytes | None], shift: Shift):
        self.shift = shift
        ends: list[int] = []
        sizes: list[int] = []
        counts = []
        crc32 = zlib.crc32
        for text in texts:
            c = 0
            pieces = _PIECES(b" " + text.translate(_NORMAL)) if text else []
            ends += [c := crc32(p, c) for p in pieces]
            sizes += map(len, pieces)
            counts.append(len(pieces))
        self.counts = np.array(counts, dtype=np.int64)
        self.end = np.array(ends, dtype=np.uint32)
        self.stop = np.cumsum(np.array(sizes, dtype=np.int64))  # bytes to each word's end, over all texts
        self.size = np.array(sizes, dtype=np.int64) - 1
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        before = np.zeros_like(self.end)
        before[1:] = np.where(self.doc[1:] == self.doc[:-1], self.end[:-1], 0)
        self.begin = _look_up(shift.short, before, 1) ^ _SPACE

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRCs of all runs of n words joined by one space, and the text each is of."""
        last = np.arange(n - 1, len(self.end))
        last = last[self.doc[last] == self.doc[last - n + 1]]
        first = last - n + 1
        length = self.stop[last] - self.stop[first] + self.size[first]
        return self.end[last] ^ self.shift(self.begin[first], length), self.doc[last]


def _scans(batch: pa.RecordBatch, shift: Shift) -> Iterator[tuple[pa.RecordBatch, Scan]]:
    for part in slices(batch):
        yield part, Scan(part.column("text").cast(pa.binary()).to_pylist(), shift)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of 1 to ``longest`` words fall into each bucket, over all rows of ``texts`` (needs ``text``)."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = Shift(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, scan in _scans(batch, shift):
                for n in range(1, longest + 1):
                    total += np.bincount(scan.ngrams(n)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    counts = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 * ln of the ratio of a bucket's shares, one added to every count."""
    buckets = len(corpus)
    source, wanted = int(corpus.sum()) + buckets, int(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float((t + 1) * source) / float((s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``docs`` (needs ``text``) without the text, with n_words, n_features and weight, the floored mean gain of its features."""
    rest = [c for c in docs.columns if c.lower() not in ("text", *WEIGHED)]
    packed = docs.select(F.struct(*quoted(rest)).alias("rest"), "text")
    schema = StructType([packed.schema["rest"], *(StructField(c, LongType()) for c in WEIGHED)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        for batch in batches:
            for part, scan in _scans(batch, shift):
                found, total = np.zeros((2, part.num_rows), dtype=np.int64)
                for n in range(1, longest + 1):
                    crc, doc = scan.ngrams(n)
                    found += np.bincount(doc, minlength=part.num_rows)
                    total += np.bincount(doc, weights=gain[crc % np.uint32(len(gain))], minlength=part.num_rows).astype(np.int64)  # doubles are exact here
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(scan.counts), pa.array(found), pa.array(total // np.maximum(found, 1))], ["rest", *WEIGHED])

    return packed.mapInArrow(kernel, schema).select("rest.*", *WEIGHED)


def gumbel(key: Column) -> Column:
    """Floored 1000-fold Gumbel noise from the first 32 bits of a text's SHA-256."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(rows: DataFrame, id: str, percent: int, least_words: int, seed: str, tables: Tables) -> DataFrame:
    """``rows`` of ``weigh`` with score and rank: of the N rows with enough words, floor(percent N / 100) have a rank."""
    key = quoted([id])[0]
    rows = rows.drop(*DRAWN)
    noise = gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    scored = rows.select(F.struct(*quoted(rows.columns)).alias("rest"), (F.col("n_words") >= least_words).alias("able"), F.col(key).alias("id"),
                         (F.col("weight") + noise).alias("score"), F.rand(7).alias("salt"))
    scored = tables.store(scored, rows=None)
    take = scored.filter("able").count() * percent // 100
    by = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("salt")]
    dealt = scored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = tables.keep(tables.store(dealt.drop("able", "id", "salt"), rows=None)).withColumns({"task": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a task
    starts = tables.keep(tables.store(starts, rows=None))
    place = F.col("start") + F.col("at") + 1
    return dealt.join(F.broadcast(starts), "task").select("rest.*", "score", F.when(place <= take, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", longest: int = 1, buckets: int = BUCKETS, percent: int = 10,
             least_words: int = 20, seed: str = "2024", tables: Tables | None = None) -> DataFrame:
    """``docs`` (needs ``id`` and ``text``) without the text, with WEIGHED and DRAWN columns; ``target`` needs ``text``."""
    if tables is None:
        with Tables(docs.sparkSession) as own:
            return resample(docs, target, id, longest, buckets, percent, least_words, seed, own)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return draw(weigh(docs, gain, longest), id, percent, least_words, seed, tables)
