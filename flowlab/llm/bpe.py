"""Byte-level BPE encoding and decoding over a rank file.

A text is cut by the pre-token pattern.  Tier one: a minimal perfect hash
(levels of collision-free bits, ranked) places every vocabulary entry in one
of exactly ``len(ranks)`` slots; a pre-token whose slot holds the same bytes
is one token.  Tier two, for the misses: the bytes form a linked list and a
heap yields the lowest-ranked neighbouring pair, leftmost first, until no
pair is in the vocabulary.  Results of both tiers are kept per worker for up
to ``MEMO`` pre-tokens and dropped together when that is exceeded, which
bounds memory and never changes a result.

Pre-tokens are looked up a slice of texts at a time; ids and bytes are
gathered with numpy.  Defined results: null text is the empty text (no ids);
decoding null ids gives no bytes; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlab.llm.text import U, expand, mix, slices, text_bytes

MEMO = 300_000
RESULT = ["ids", "n_tokens"]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _key_hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hash of each byte string: eight bytes at a time, a whole column of strings at once."""
    lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    h = mix(lengths.astype(np.uint64))
    words = (int(lengths.max(initial=0)) + 7) // 8
    alive = np.arange(len(keys))
    for w in range(words):
        alive = alive[lengths[alive] > 8 * w]
        part = b"".join([keys[i][8 * w:8 * w + 8].ljust(8, b"\0") for i in alive.tolist()])
        h[alive] = mix(h[alive] ^ np.frombuffer(part, dtype="<u8"))
    return h


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: index(x) is 0 .. n - 1 for members, and anything or -1 for others."""

    def __init__(self, hashes: np.ndarray):
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have one hash")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        placed = 0
        while len(hashes):
            size = 2 * len(hashes) + 1
            at = self._at(hashes, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - 1))
            placed += int(alone.sum())
            hashes = hashes[~alone[at]]

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes ^ U(0xA0761D6478BD642F * (level + 1) % (1 << 64))) % U(size)).astype(np.int64)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._at(hashes[left], level, len(alone))
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


class Codec:
    """Encoder and decoder of one vocabulary; sent to the workers as a broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int | None = None):
        self.ranks, self.pattern, self.most = ranks, pattern, memo_size or MEMO
        keys = list(ranks)
        hashes = _key_hashes(keys)
        self.perfect = PerfectHash(hashes)
        self.slot_id = np.zeros(len(keys), dtype=np.int64)
        self.slot_id[self.perfect.index(hashes)] = list(ranks.values())
        self._start()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ranks", "pattern", "most", "perfect", "slot_id")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        # White space as Unicode defines it: \s of this regex library has a few control characters more.
        self.split = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        top = max(self.ranks.values(), default=-1) + 1
        self.token = [b""] * top
        for t, r in self.ranks.items():
            self.token[r] = t
        self.known = np.zeros(top, dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.token_bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.token_size = np.fromiter(map(len, self.token), dtype=np.int64, count=top)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        digits = [b"%d," % i for i in range(top)]
        self.digit_bytes = np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.digit_size = np.fromiter(map(len, digits), dtype=np.int64, count=top)
        self.digit_first = np.cumsum(self.digit_size) - self.digit_size
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.memo_ids, self.memo_first, self.memo_size = array("i"), array("q"), array("q")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a byte string that is not itself a token."""
        n, ranks = len(piece), self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if not alive[i] or middle >= end or after[middle] != end:
                continue
            alive[middle] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i:after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def _learn(self, pieces: list[str]) -> None:
        keys = [p.encode() for p in pieces]
        slot = self.perfect.index(_key_hashes(keys))
        ids = np.where(slot >= 0, self.slot_id[slot] if len(self.slot_id) else 0, -1).tolist()
        for piece, key, one in zip(pieces, keys, ids, strict=True):
            found = [one] if one >= 0 and self.token[one] == key else self.merge(key)
            self.memo[piece] = len(self.memo_first)
            self.memo_first.append(len(self.memo_ids))
            self.memo_size.append(len(found))
            self.memo_ids.extend(found)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more than texts)."""
        if len(self.memo) > self.most:
            self._forget()
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += self.split(text or "")
            ends.append(len(pieces))
        self._learn(list(set(pieces) - self.memo.keys()))
        at = np.fromiter(map(self.memo.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        first, size = np.array(self.memo_first, dtype=np.int64)[at], np.array(self.memo_size, dtype=np.int64)[at]
        ids = np.array(self.memo_ids, dtype=np.int32)[expand(first, size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each row's bytes begin."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return _gather(self.token_bytes, self.token_first, self.token_size, ids, offsets)

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma after it, and where each row's begin."""
        return _gather(self.digit_bytes, self.digit_first, self.digit_size, ids, offsets)


def _gather(data, first, size, ids, offsets):
    sizes = size[ids]
    return data[expand(first[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[offsets]


def _encode(codec, columns, check):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, offsets = codec.value.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                made = [lists, pa.array(np.diff(offsets), pa.int64())]
                if check:
                    text, begins = text_bytes(part.column("text"))
                    back, stops = codec.value.decode(ids, offsets)
                    same = [back[a:b].tobytes() == text[c:d].tobytes() for a, b, c, d in zip(stops[:-1], stops[1:], begins[:-1], begins[1:], strict=True)]
                    made.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made], [*columns, *RESULT, *["round_trip"][:check]])
    return run


def _decode(codec, columns):
    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array(lists.value_lengths().fill_null(0), dtype=np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = codec.value.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), decoded.cast(pa.binary())], [*columns, "decoded"])
    return run


def _digest(codec, columns):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, offsets = codec.value.encode(part.column("text").to_pylist())
                written, ends = codec.value.decimals(ids, offsets)
                decoded, stops = codec.value.decode(ids, offsets)
                written, decoded = memoryview(written), memoryview(decoded)
                hashed = [hashlib.sha256(written[a:max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                back = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(np.diff(offsets), pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())],
                                                 [*columns, "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _share(df: DataFrame, ranks: dict[bytes, int], pattern: str, memo_size: int | None = None):
    return df.sparkSession.sparkContext.broadcast(Codec(ranks, pattern, memo_size))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, check: bool = False, memo_size: int | None = None) -> DataFrame:
    """``docs`` (needs ``text``) with ids (array of int) and n_tokens; columns of these names are replaced.

    With ``check``, the ids are decoded again and ``round_trip`` tells whether they give the text.  ``memo_size``:
    pre-tokens that a worker remembers, for less memory or less time; it changes no result.
    """
    docs = docs.drop(*RESULT, *["round_trip"][:check])
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(_encode(_share(docs, ranks, pattern, memo_size), docs.columns, check), T.StructType([*docs.schema.fields, *made[:2 + check]]))


def decode(rows: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``rows`` (needs ``ids``) with the bytes in ``decoded``."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(_decode(_share(rows, ranks, pattern), rows.columns), schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the written ids and of the bytes they decode to."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.mapInArrow(_digest(_share(docs, ranks, pattern), ["doc_id"]), schema)
