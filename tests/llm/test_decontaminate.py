import hashlib
import random
import re

import pytest

from flowlab.llm.decontaminate import mark_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - size + 1)) if v else ():
            win = v[i:i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j:j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    vocab = ["the", "of", "Ça", "été", "x1", "Word", "a", "b", "c", "日本"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 9, 10, 14, 40])))) for i in range(30)]
    items += [(30, None), (None, "the of the of unique-item words here now and then again yes"), (3, items[3][1]), (31, "...")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randrange(0, 60)))
        if i % 3 == 0:
            text += ", " + rng.choice(items)[1].upper() if (pick := rng.choice(items)[1]) and i % 2 else " " + (pick or "")
        docs.append((i, text))
    return docs + [(60, None), (61, ""), (7, docs[7][1]), (None, docs[0][1]), (62, "the of " * 4000)], items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_equals_brute_force(spark, data, block):
    docs, items = data
    rows = mark_contaminated(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_hit string"),
                             spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert len(rows) == len(docs)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        n, hit, found = brute(t, items)
        for r in by_id[d]:
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_partial_containment(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "so " + item.replace("five", "fünf")), (2, item), (3, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    get = lambda c: {r.doc_id: r.contaminated for r in mark_contaminated(docs, bench, containment=c).collect()}
    assert get(1.0) == {1: False, 2: True, 3: False}
    assert get(0.6) == {1: True, 2: True, 3: False}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in mark_contaminated(docs, none).collect()] == [0]
    assert mark_contaminated(docs.filter("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
