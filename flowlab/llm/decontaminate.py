"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, a window into its
word shingles.  Shingles are ordered by rarity, counted over all documents;
a document passage that holds the share ``containment`` of a window's
shingles at their places holds one of the window's rarest
``m - ceil(containment * m) + 1``, so only those enter the index that the
documents' shingles are joined with.  A match fixes the passage's place; the
passage must lie inside the document (positional and length bound), and the
words of the item-sized passage are then compared with the window's.

The benchmark is a stated query set: it is worked off in blocks of
``block_bytes``, so what each task holds of it has a fixed size however
large the benchmark is; every document is read against every block.

Defined results: null text has no words; a null item id marks words but is
listed nowhere; repeated items count once; repeated document rows each get
their row; other columns of the documents are kept as they are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.llm.text import ALNUM, U, Words, expand, fresh, shingle_hashes, slices

SHINGLE = 3
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 4096
_BITS = 22


def item_words(text: str | None) -> list[bytes]:
    words = Words(pa.array([text], pa.string()), ALNUM)
    return [words.word(i) for i in range(len(words))]


def _pieces(window: int):
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w.decode() for w in item_words(text)]
                cuts = range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ()
                rows = [" ".join(words[i:i + PIECE_WORDS + window - 1]) for i in cuts]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(rows), pa.string()), pa.array(rows, pa.string())], ["item_id", "words"])
    return run


class Index:
    """Windows of one block of the benchmark and their prefix shingles."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int, containment: float):
        items: dict[tuple[str, ...], set[str | None]] = {}
        for item, text in rows:
            words = text.split(" ")
            for i in range(max(1, len(words) - window + 1)):
                items.setdefault(tuple(words[i:i + window]), set()).add(item)
        self.windows = sorted(items)
        self.items = [sorted(x for x in items[w] if x is not None) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.containment = containment
        self.sizes = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        keys, owners, places = [], [], []
        for k, w in enumerate(self.windows):
            words = Words(pa.array([" ".join(w)]), ALNUM)
            size = min(SHINGLE, len(w))
            h = shingle_hashes(words.hashes(), size)
            keys.append(h + U(size))
            owners.append(np.full(len(h), k))
            places.append(np.arange(len(h)))
        none = np.zeros(0, dtype=np.int64)
        self.keys = np.concatenate([none.astype(np.uint64), *keys])
        self.owners = np.concatenate([none, *owners])
        self.places = np.concatenate([none, *places])
        self.shingles = np.unique(self.keys)
        self._filter(self.shingles)

    def _filter(self, keys: np.ndarray) -> None:
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[keys >> U(64 - _BITS)] = True

    def look(self, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` that occur in the sorted ``among``, and where there."""
        at = np.flatnonzero(self.bitmap[keys >> U(64 - _BITS)])
        if not len(among) or not len(at):
            return at[:0], at[:0]
        found = np.searchsorted(among, keys[at])
        found[found == len(among)] = 0
        same = among[found] == keys[at]
        return at[same], found[same]

    def order(self, counts: dict[int, int]) -> None:
        """Keep each window's necessary prefix: its rarest shingles."""
        rarity = np.array([counts.get(int(k.astype(np.int64)), 0) for k in self.keys], dtype=np.int64)
        by = np.lexsort((self.places, self.keys, rarity, self.owners))
        m = np.bincount(self.owners, minlength=len(self.windows))
        need = np.array([x - math.ceil(self.containment * x - 1e-9) + 1 for x in m.tolist()], dtype=np.int64)
        rank = np.arange(len(by)) - np.repeat(np.cumsum(m) - m, m)
        kept = by[rank < np.minimum(need, m)[self.owners[by]]]
        kept = kept[np.argsort(self.keys[kept], kind="stable")]
        self.prefix, self.prefix_first = np.unique(self.keys[kept], return_index=True)
        self.prefix_last = np.append(self.prefix_first[1:], len(kept))
        self.prefix_owner, self.prefix_place = self.owners[kept], self.places[kept]
        self._filter(self.prefix)

    def document_shingles(self, words: Words):
        """(first words, keys, size) of the shingles that lie inside one text."""
        h, doc = words.hashes(), words.doc()
        for size in self.sizes:
            keys = shingle_hashes(h, size)
            yield np.where(doc[:len(keys)] == doc[size - 1:], keys + U(size), U(0)), size

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence of a window, verified word by word."""
        doc = words.doc()
        out = []
        for keys, _ in self.document_shingles(words):
            at, found = self.look(keys, self.prefix)
            counts = self.prefix_last[found] - self.prefix_first[found]
            entry = expand(self.prefix_first[found], counts)
            begin = np.repeat(at, counts) - self.prefix_place[entry]
            window = self.prefix_owner[entry]
            last = begin + self.length[window] - 1
            inside = (begin >= 0) & (last < len(words))
            begin, window, last = begin[inside], window[inside], last[inside]
            inside = doc[begin] == doc[last]
            out.append(np.stack([begin[inside], window[inside]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        if len(pairs):
            pairs = pairs[[self._holds(words, b, w) for b, w in pairs.tolist()]]
        return pairs[:, 0], pairs[:, 1]

    def _holds(self, words: Words, begin: int, window: int) -> bool:
        want = self.windows[window]
        same = [words.word(begin + i) == w.encode() for i, w in enumerate(want)]
        if self.containment >= 1:
            return all(same)
        size = min(SHINGLE, len(want))
        held = sum(all(same[i:i + size]) for i in range(len(want) - size + 1))
        return held >= math.ceil(self.containment * (len(want) - size + 1) - 1e-9)


def _count(index):
    """Documents that hold each of the block's shingles, summed within a task."""
    def run(batches):
        ix = index.value
        total = np.zeros(len(ix.shingles), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                doc = words.doc()
                for keys, _ in ix.document_shingles(words):
                    at, found = ix.look(keys, ix.shingles)
                    seen = np.unique(doc[at] * len(ix.shingles) + found)
                    np.add.at(total, seen % max(1, len(ix.shingles)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ix.shingles[some].astype(np.int64)), pa.array(total[some])], ["shingle", "n"])
    return run


def _mark(index, columns, own, last):
    """Adds a block's hit words (a bit each) and items to what earlier blocks found; the last block writes RESULT."""
    def run(batches):
        ix = index.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                begin, window = ix.matches(words)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + ix.length[window], -1)
                hit = np.cumsum(edge)[:-1] > 0
                doc = words.doc()
                found: dict[int, set[str]] = {}
                for d, w in zip(doc[begin].tolist(), window.tolist(), strict=True):
                    found.setdefault(d, set()).update(ix.items[w])
                n = part.num_rows
                marks, items = (part.column(c).to_pylist() for c in own) if own else ([None] * n, [None] * n)
                for d in np.unique(doc[hit]).tolist():
                    bits = np.packbits(hit[words.first[d]:words.first[d + 1]])
                    marks[d] = (bits | np.frombuffer(marks[d], np.uint8) if marks[d] else bits).tobytes()
                    items[d] = sorted(set(items[d] or []) | found.get(d, set()))
                kept = [part.column(c) for c in columns]
                if last:
                    yield pa.RecordBatch.from_arrays([*kept, *_results(words.counts, marks, items)], [*columns, *RESULT])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*columns, *_between(columns)])
    return run


def _results(counts, marks, items) -> list[pa.Array]:
    items = [x or [] for x in items]
    hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in marks]
    return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hits], pa.bool_())]


def _between(columns: list[str]) -> list[str]:
    """Names of what blocks hand on to each other."""
    return [fresh(columns, x) for x in ("_hit", "_found")]


#: Columns that mark_contaminated adds.
RESULT = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, containment: float = 1.0,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with RESULT columns; columns of these names in ``docs`` are replaced.

    ``docs`` needs ``text``; ``benchmark`` needs ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULT)
    columns = docs.columns
    pieces = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(
        _pieces(window), "item_id string, words string").distinct()
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    between = T.StructType([*docs.schema.fields, *map(T.StructField, _between(columns), [T.BinaryType(), T.ArrayType(T.StringType())])])
    result = T.StructType([*docs.schema.fields, *map(
        T.StructField, RESULT, [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.StringType(), T.BooleanType()])])
    out = docs
    for block in range(blocks):
        rows = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        index = Index([(r.item_id, r.words) for r in rows], window, containment)
        counting = spark.sparkContext.broadcast(index)
        counts = (docs.select("text").mapInArrow(_count(counting), "shingle long, n long")
                  .groupBy("shingle").agg(F.sum("n").alias("n")).collect() if len(index.keys) else [])
        index.order({r.shingle: r.n for r in counts})
        last = block == blocks - 1
        out = out.mapInArrow(_mark(spark.sparkContext.broadcast(index), columns, _between(columns) if block else [], last), result if last else between)
    return out
