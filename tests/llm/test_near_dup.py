import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlab.llm.graph import components
from flowlab.llm.tables import Tables
from flowlab.llm.near_dup import Bands, link_documents, set_hashes, short_sketches, sized_sketches, shingle_sets, signatures


def sets_of(docs, size):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        out[i] = {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(docs, size, percent):
    sets = sets_of(docs, size)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(vocab, k=14))
    docs = []
    for i in range(n):
        k = rng.random()
        if k < 0.5 and docs:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 5, 12])):
                if w:
                    at = rng.randrange(len(w))
                    w[at:at + rng.choice([0, 1])] = rng.choices(vocab, k=rng.choice([0, 1]))
            docs.append((i, " ".join(w)))
        else:
            own = rng.choices(vocab, k=rng.choice([1, 3, 4, 8, 15, 40, 150, 600]))
            docs.append((i, " ".join(own) + (" " + line if k < 0.8 else "")))
    return docs


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_equals_brute_force(spark, seed, size, percent):
    docs = corpus(seed)
    rows = link_documents(spark.createDataFrame(docs, "doc_id int, text string").repartition(5), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, size, percent)
    assert len(rows) == len(docs)


def test_hard_rows(spark):
    text = "a b c d e f"
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, text), (5, text.upper()), (5, text.upper()), (None, text), (6, "a b"), (7, "A  B"), (8, "z " * 50000), (9, "z " * 400)]
    rows = link_documents(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int"), 4, 85).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (5, 3, 4), (None, 3, None), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8)], key=str)


def test_empty_table(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 700), st.integers(0, 1 << 30), st.sampled_from([60, 80, 85, 95]))
def test_similar_sets_share_a_signature(size, seed, percent):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
    drop = rng.integers(0, size + 1)
    b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, size // 3 + 1), dtype=np.uint64)])
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b))
    if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
        return
    owner, sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), Bands(percent))
    assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
    x = np.array(short_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
    assert sum(int(v).bit_count() for v in (x[:, 0] ^ x[:, 1]).astype(np.uint64)) <= len(a) + len(b) - 2 * common


def test_few_elements_in_one_group():
    # All elements in one partition: only the single-element signatures can meet.
    a = np.sort(np.arange(1, 30, dtype=np.uint64))
    b = a[1:]
    owner, sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), Bands(85))
    assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_set_hashes_ignore_order_of_texts():
    keys, first = shingle_sets(pa.array(["a b c d e", "x", "a b c d e", None]), 4)
    h1, h2 = set_hashes(keys, first)
    assert h1[0] == h1[2] and h2[0] == h2[2] and h1[0] != h1[1] and np.diff(first).tolist() == [2, 1, 2, 0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 9), (9, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    with Tables(spark) as tables:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), tables).collect()}
        assert got == {x: find(x) for x in up}
        assert components(spark.createDataFrame([], "a long, b long"), tables).count() == 0


def test_sized_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(11)
    sets = [np.sort(rng.choice(2 ** 62, n, replace=False)).astype(np.uint64) for n in (0, 1, 256, 257, 1000, 1600)]
    sets += [np.sort(np.concatenate([s[len(s) // 9:], rng.integers(0, 2 ** 62, 7).astype(np.uint64)])) for s in sets]
    made = sized_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert [len(m) for m in made[:6]] == [4, 4, 4, 8, 16, 32]
    for s, x in zip(sets, made, strict=True):
        for t, y in zip(sets, made, strict=True):
            while len(x) > len(y):
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            while len(y) > len(x):
                y = y[:len(y) // 2] ^ y[len(y) // 2:]
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(s, t))
    apart = np.bitwise_count(made[4] ^ sized_sketches(rng.integers(0, 2 ** 62, 1000).astype(np.uint64), np.array([0, 1000]))[0]).sum()
    assert apart > 400  # of unrelated sets, far more than similar ones may differ in
