import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import toxicity as tx


def brute_kernel(s, t, order, decay):
    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_brute_force():
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(1, 9))), "".join(rng.choices("abc", k=rng.randrange(1, 9)))) for _ in range(60)]
    for order in (1, 2, 3):
        s, t = tx._codes([a for a, _ in pairs], 9)[0], tx._codes([b for _, b in pairs], 9)[0]
        got = tx.string_kernel(s, t, order, 0.7)
        assert np.allclose(got, [brute_kernel(a, b, order, 0.7) for a, b in pairs], rtol=1e-4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "ren", "sta", "vor", "ul", "pe"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice([1, 2, 3])))
    out = []
    for i in range(400):
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(rng.randrange(2, 12))]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.sample(range(len(sentences)), 2):
                sentences[k] = f"{word()} {rng.choice(['blockhead', 'fusspot', 'nitwit'])} {word()}."
        out.append((i, " ".join(sentences), int(toxic)))
    return out


def test_learns_and_bears_gaps(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    model = tx.fit(tx.sample_labelled(docs.drop("toxic"), labels))
    scored = tx.score_toxicity(docs.withColumn("score", F.lit("old")), model).withColumn("held", tx.held_out("doc_id"))
    held = scored.filter("held").collect()
    assert len(held) > 40 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    hidden = ["nit-wit ka. n-i-t-w-i-t", "f u s s p o t lo. fussxpot", "BLOCKhead mi! blo.ckhead?"]
    assert (model.scores(hidden) > 0.5).all()
    assert (model.scores(["ka lo mi ren.", "", None, "staren vorul " * 3000]) < 0.5).all()


def test_hard_rows(spark, rows):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "a" * 50_000), (4, "!!! ... \n\n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1), (4, 0)], "doc_id long, toxic int")
    model = tx.fit(tx.sample_labelled(docs, labels))
    out = tx.score_toxicity(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert tx.score_toxicity(docs.filter("false"), model).count() == 0
    assert docs.select(tx.held_out("doc_id").alias("h")).filter("h is null").count() == 0


def test_long_spans_are_compared_whole():
    similarity = tx.Similarity(["blockhead"])
    spans = ["q" * 70 + "blockhead" + "z" * 50, "q" * 100]
    index = similarity.index(spans)
    assert index[0] != 0 and index[1] == 0


def test_joined_and_dotted_spans_hide_nothing():
    similarity = tx.Similarity(["idiot"])
    spans = ["idiot", "really,idiot", "you.are.such.an.absolute.idiot.so.go.away", "reallyidiot", "qzwvbnmqzwvbnmidiotqzwvbnmqzwvbnmqzwvbnm"]
    value = similarity.rows[similarity.index(spans)][:, 0] if similarity.index(spans).all() else np.zeros(5)
    assert (value[:3] > 0.99).all() and (value[3:] > 0.05).all()


def test_forgetting_changes_nothing(monkeypatch):
    a, b = tx.Similarity(["nitwit"]), tx.Similarity(["nitwit"])
    words = [f"nitw{i}it" for i in range(50)]
    at = a.index(words)
    whole = a.rows[at]
    monkeypatch.setattr(tx, "MEMO", 3)
    parts = []
    for w in words:
        at = b.index([w])
        parts.append(b.rows[at])
    parts = np.vstack(parts)
    assert np.allclose(whole, parts)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    w, b = tx.train_machine(x, y, np.ones(300))
    assert (np.sign(x @ w + b) == y).mean() > 0.97
