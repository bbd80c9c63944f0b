import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlab.llm.importance import Scan, Shift, bucket_counts, gains, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ngrams(text, longest):
    w = WORDS.findall(lower(text))
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def test_shift_equals_zero_bytes():
    shift, rng = Shift(), random.Random(1)
    for n in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 4096, 100_001]:
        a, b = rng.randbytes(rng.randrange(1, 20)), rng.randbytes(n)
        got = shift(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([n]))[0]
        assert got ^ np.uint32(zlib.crc32(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_every_ngram(n):
    rng = random.Random(n)
    texts = [None, "", " .,!", "one", "Ünïcode Ça ÀB 日本 x²", "a" * 500 + " b-c_d 12"] + [" ".join(rng.choices(["The", "cat-sat", "é", "x" * 70, "\t9\n"], k=rng.randrange(40))) for _ in range(30)]
    scan = Scan([t if t is None else t.encode() for t in texts], Shift())
    crc, doc = scan.ngrams(n)
    for i, t in enumerate(texts):
        w = WORDS.findall(lower(t))
        assert scan.counts[i] == len(w)
        assert crc[doc == i].tolist() == [zlib.crc32(" ".join(w[k:k + n]).encode()) for k in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent, least):
    count = lambda texts: Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in ngrams(t, longest))
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, text in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in (zlib.crc32(x.encode()) % buckets for x in ngrams(text, longest))]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        rows.append((i, len(WORDS.findall(lower(text))), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    take = len(able) * percent // 100
    ranks = {}
    for place, r in enumerate(able[:take], 1):
        ranks.setdefault(r, []).append(place)
    out = [(*r, (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (3, 35, 2), (2, 100, 0), (1, 0, 0)])
def test_equals_brute_force(spark, longest, percent, least):
    rng = random.Random(longest)
    vocab = ["the", "The", "quick", "fox", "Été", "日本", "x1", "--", "of", "and", "rare" + "z" * 80]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(60)))) for i in range(120)] + [(200, None), (201, ""), (202, "?!"), (7, "the " * 30), (7, "the " * 30), (None, "of " * 25), (300, "w" * 40 + " the" * 30_000)]
    target = ["the quick fox", None, "fox and fox", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=97, percent=percent, least_words=least)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, longest, 97, percent, least)


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "x", 9)], "doc_id long, text string, WEIGHT int, `odd.name x` int, id string, able int")
    none = docs.filter("false")
    got = resample(docs, none, percent=100, least_words=1)
    assert got.columns == ["doc_id", "odd.name x", "id", "able", "n_words", "n_features", "weight", "score", "rank"]
    assert got.first()[:6] == (1, 6, "x", 9, 2, 2) and got.first().rank == 1
    assert resample(none, docs).count() == 0 and bucket_counts(none).sum() == 0
    assert gains(np.array([1, 0]), np.array([0, 0])).tolist() == [math.floor(1000 * math.log(1 * 3 / (2 * 2))), math.floor(1000 * math.log(1 * 3 / (1 * 2)))]
