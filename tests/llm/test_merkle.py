import hashlib

import pytest
from pyspark.sql import functions as F

from flowlab.llm.merkle import fold, merkle_paths, proof_digest, record_digest
from flowlab.llm.tables import Tables


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((level[j] if j < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def brute(rows):
    """(k, group) rows → sorted (k, leaf, subroot, root, path)."""
    groups = {}
    for k, g, *_ in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, sha(field(k), field(g)), k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grow([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = grow([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3], x[2], trees[g][-1][0], top[-1][0], path(trees[g], i) + path(top, at)))
    return sorted(out, key=repr)


def run(df, levels=8):
    got = merkle_paths(df, record_digest(F.col("k"), F.col("lang")), "lang", "k", levels)
    return sorted(((r.k, r.leaf, r.subroot, r.root, [(s.sibling, s.right) for s in r.path]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_equals_brute_force(spark, levels):
    rows = [(i * 7 % 301, "en") for i in range(301)] + [(i, "de") for i in range(4)] + [(i, "é") for i in range(17)] + [(1, "z"), (None, "fr"), (5, "fr"), (5, "fr"), (3, "fr")]
    rows += [(i, None) for i in range(9)] + [(9, "")]
    assert run(spark.createDataFrame(rows, "k long, lang string").repartition(5), levels) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "en")], [(None, None)], [(1, "en"), (2, "en")], [(1, "en"), (1, "de")], [(4, "en")] * 300], ids=["one", "null", "two", "groups", "equal rows"])
def test_small_and_equal(spark, rows):
    assert run(spark.createDataFrame(rows, "k long, lang string")) == brute(rows)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([(1, "en", "x", 2, 3, 4, None, 6)], "k long, lang string, PATH string, g int, node int, `odd.name x` int, i int, row int")
    got = merkle_paths(df, record_digest(F.col("k")), "lang", "k")
    assert got.columns == ["k", "lang", "g", "node", "odd.name x", "i", "row", "leaf", "subroot", "root", "path"]
    assert got.first()[:7] == (1, "en", 2, 3, 4, None, 6) and got.first().root == sha("1:1")
    assert run(df.filter("false")) == []


def test_proofs_fold_to_the_root_and_changed_rows_do_not(spark):
    rows = [(i, "en" if i % 3 else "de", "x" * (i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, lang string, text string")
    with Tables(spark) as tables:
        paths = merkle_paths(df, record_digest(F.col("k"), F.col("text")), "lang", "k", 4, tables).withColumn("changed", record_digest(F.col("k"), F.concat("text", F.lit("y"))))
        got = paths.select("root", fold(F.col("leaf"), F.col("path")).alias("same"), fold(F.col("changed"), F.col("path")).alias("other"), proof_digest(F.col("path")).alias("proof")).collect()
    assert len(got) == 600 and all(r.same == r.root and r.other != r.root for r in got) and len({r.proof for r in got}) == 600


def test_long_text_and_leaf_format(spark):
    text = "é" * 3_000_000
    got = spark.createDataFrame([(text, None)], "a string, b long").select(record_digest(F.col("a"), F.col("b")).alias("h")).first().h
    assert got == sha(f"6000000:{text}-")
