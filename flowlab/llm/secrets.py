"""Secret scans: fixed patterns, and a guess-cost estimate for credential values.

Three patterns give the base spans.  Beyond them, the value of every
credential context (``pwd: ...``, ``passphrase is ...``, ``auth=...``) is cut
into dictionary words, dates, repeats, keyboard walks and brute-force spans;
dynamic programming over the value finds the segmentation that is cheapest
to guess, and a value that needs at least 10 ** ``min_log10`` guesses is a
span of kind ``guess`` unless it lies wholly inside a base span.  Contexts are
looked for inside values too; a value inside a guess span is part of that.

Spans are in code points, end exclusive, and cover a pattern's whole match.
Time and memory of the dynamic programme are linear in the value's length.
Defined results: null text is empty (no spans); repeated rows each get their
row; columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from math import inf, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlab.llm.text import slices

KINDS = ["assign", "access", "hex", "guess"]
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?P<key>(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|credentials?|auth|bearer|login))"""
    r"""["']?(?:\x20*(?::=|=>|[:=])|\x20+(?ai:is))\x20*["']?(?P<value>[^\x00-\x20"'<>]{4,})""")

#: Common parts of passwords, the most common first.
WORDS = [
    "password", "qwerty", "admin", "welcome", "login", "letmein", "dragon", "monkey", "master", "secret", "princess", "football",
    "baseball", "shadow", "sunshine", "superman", "michael", "trustno", "iloveyou", "hello", "freedom", "whatever", "charlie",
    "jordan", "hunter", "hunter2", "pepper", "ginger", "summer", "winter", "spring", "autumn", "george", "andrew", "thomas",
    "daniel", "robert", "jessica", "jennifer", "ashley", "nicole", "amanda", "matrix", "killer", "batman", "soccer", "hockey",
    "ranger", "buster", "tigger", "cookie", "flower", "silver", "golden", "orange", "purple", "yellow", "green", "black", "white",
    "blue", "red", "love", "angel", "baby", "girl", "boy", "cat", "dog", "fish", "bird", "horse", "tiger", "lion", "bear", "wolf",
    "star", "moon", "sun", "sky", "fire", "water", "earth", "wind", "stone", "rock", "snow", "rain", "river", "mountain", "home",
    "house", "office", "work", "school", "test", "testing", "demo", "example", "sample", "changeme", "default", "guest", "user",
    "root", "system", "server", "access", "pass", "token", "key", "api", "auth", "private", "public", "correct", "battery", "staple",
]
#: Rows of keys side by side.
KEY_ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
_BESIDE = {p for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False) for p in ((a, b), (b, a))}
_LEET = str.maketrans("@4031!$57", "aaoeiisst")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)(?!\d)|(?:19|20)\d\d(?!\d)")
_SEGMENT = log10(3)
_MAX_UNIT = 8


def _space(value: str) -> float:
    """log10 of the brute-force guesses for one character."""
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    return log10(size)


def segments(value: str, words: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """The cheapest segmentation: (kind, start, end, log10 of guesses) in order."""
    n = len(value)
    low, plain = value.lower(), value.lower().translate(_LEET)
    if len(low) != n:
        low = plain = value
    brute = _space(value) if value else 0.0
    longest = max(map(len, words), default=0)
    walk = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        step = (low[i], low[i + 1]) in _BESIDE or (low[i + 1].isalnum() and abs(ord(low[i + 1]) - ord(low[i])) == 1)
        walk[i] = walk[i + 1] + 1 if step else 1
    same = {u: [0] * (n + 1) for u in range(1, _MAX_UNIT + 1)}
    for u, run in same.items():
        for i in range(n - u - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + u] else 0

    best = [inf] * (n + 1)  # guesses of the first i characters
    open_ = [inf] * (n + 1)  # the same, the last segment being an open brute-force span
    how: list[tuple[str, int, float]] = [("", 0, 0.0)] * (n + 1)
    open_from = [0] * (n + 1)
    best[0] = 0.0

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if best[i] + cost + _SEGMENT < best[j]:
            best[j], how[j] = best[i] + cost + _SEGMENT, (kind, i, cost)

    for i in range(n):
        if open_[i] < best[i]:
            best[i], how[i] = open_[i], ("brute", open_from[i], brute * (i - open_from[i]))
        if best[i] + _SEGMENT <= open_[i]:
            open_[i + 1], open_from[i + 1] = best[i] + _SEGMENT + brute, i
        else:
            open_[i + 1], open_from[i + 1] = open_[i] + brute, open_from[i]
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = words.get(low[i:j])
            leet = 0.0
            if rank is None and (rank := words.get(plain[i:j])) is not None:
                leet = log10(4)
            if rank is not None:
                offer("word", i, j, log10(rank + 1) + leet + (0 if value[i:j].islower() else log10(2)))
        if m := _DATE.match(value, i):
            offer("date", i, m.end(), log10(130) if m.end() - i == 4 else log10(365 * 130))
        if walk[i] >= 3:
            offer("walk", i, i + walk[i], log10(47 * 2 * walk[i]))
        for u, run in same.items():
            times = 1 + run[i] // u
            if times * u >= 3 and times > 1:
                offer("repeat", i, i + u * times, brute * u + log10(times))
    if open_[n] < best[n]:
        how[n] = ("brute", open_from[n], brute * (n - open_from[n]))
    out, j = [], n
    while j:
        kind, i, cost = how[j]
        out.append((kind, i, j, cost))
        j = i
    return out[::-1]


def guess_cost(value: str, words: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    return sum(cost + _SEGMENT for *_, cost in segments(value, words))


@lru_cache(maxsize=1)
def _ranks(words: tuple[str, ...]) -> dict[str, int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


def find_secrets(text: str, words: Iterable[str] = WORDS, min_log10: float = 8.0) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as in KINDS."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    taken = sorted(spans)
    ranks = _ranks(tuple(words))
    at = 0
    while m := _CONTEXT.search(text, at):
        at = m.end("key")
        start, end = m.span("value")
        while end > start and text[end - 1] in ".,;:!?)]}":
            end -= 1
        if not any(a <= start and end <= b for a, b, _ in taken) and guess_cost(text[start:end], ranks) >= min_log10:
            spans.append((start, end, "guess"))
            taken.append(spans[-1])
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def write_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every maximal union of spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def _scan(columns, words, min_log10, mark):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                spans = [find_secrets(t or "", words, min_log10) for t in texts]
                kept = {c: part.column(c) for c in columns}
                if mark is not None:
                    kept["text"] = pa.array([t if not s else redact(t, s, mark) for t, s in zip(texts, spans, strict=True)], pa.string())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                found = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*kept.values(), found], [*kept, "secrets"])
    return run


def scan_secrets(docs: DataFrame, words: Iterable[str] = WORDS, min_log10: float = 8.0, mark: str | None = None) -> DataFrame:
    """``docs`` (needs ``text``) with ``secrets``, an array of (start, end, kind) in the text that was read.

    With ``mark``, the text comes back with each secret replaced by it.
    """
    docs = docs.drop("secrets")
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", _SPAN)])
    return docs.mapInArrow(_scan(docs.columns, tuple(words), min_log10, mark), schema)


def _digest(words, min_log10):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [find_secrets(t or "", words, min_log10) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(k == kind for *_, k in x) for x in found], pa.int64()) for kind in KINDS]
                base = [hashlib.sha256(write_spans([s for s in x if s[2] != "guess"]).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([write_spans(x) for x in found], pa.string())],
                                                 ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def digest_secrets(docs: DataFrame, words: Iterable[str] = WORDS, min_log10: float = 8.0) -> DataFrame:
    """doc_id, the number of spans of each kind, a hash of the base spans, and all spans written out."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.mapInArrow(_digest(tuple(words), min_log10), schema)
