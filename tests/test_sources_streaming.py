"""Sources, sinks and the online stream."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlab.sources import files as S
from flowlab.sources import results as RS
from flowlab.streaming import online as ON


def test_label_column_resolution():
    assert S.find_label_column(["x", "Label", "label"]) == "label"
    assert S.find_label_column(["x", "LABEL"]) == "LABEL"
    with pytest.raises(KeyError):
        S.find_label_column(["x", "y"])


def test_split_path_unknown():
    assert S.split_path("/d", "test").endswith("KDDTest+.txt")
    with pytest.raises(ValueError):
        S.split_path("/d", "validation")


def test_headerless_csv_failfast(spark):
    path = S.scratch_path(spark, "t-csv")
    spark.createDataFrame([("1", "a"), ("oops", "b")], "x string, y string").coalesce(1).write.csv(path)
    schema = "x long, y string"
    from pyspark.sql import types as T
    df = S.read_headerless_csv(spark, path, T._parse_datatype_string(schema))
    with pytest.raises(Exception):
        df.collect()


def test_run_log_roundtrip(spark):
    path = S.scratch_path(spark, "t-runs")
    assert RS.read_runs(spark, path).count() == 0
    rec = spark.createDataFrame([("id1", "events", 7, {"macro_f1": 0.5})],
                                "experiment_id string, dataset string, seed int, metrics map<string,double>")
    RS.append_runs(rec, path)
    RS.append_runs(rec, path)
    back = RS.read_runs(spark, path)
    assert back.count() == 2 and back.first().metrics == {"macro_f1": 0.5}


def test_pipe_tables(spark):
    path = S.scratch_path(spark, "t-md")
    t = spark.createDataFrame([("rf", 0.5), ("lr", 0.25)], "method string, macro_f1 double")
    md = RS.markdown_lines(t, "binary", ["method", "macro_f1"], {"macro_f1": "%.2f"})
    md.repartition("section").sortWithinPartitions("section", "pos").select("line").write.text(path)
    rows = {(r.section, r.cells[0], r.cells[1]) for r in RS.read_pipe_tables(spark, path, 2).collect()}
    assert rows == {("binary", "rf", "0.50"), ("binary", "lr", "0.25")}


def test_online_stream_and_replay(spark, monkeypatch):
    root = S.scratch_path(spark, "t-stream")
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"),
                                 ((F.col("id") % 2) * 2.0 - 1.0 + F.sin("id") * 0.1).alias("x"),
                                 (F.col("id") / 100).cast("int").alias("chunk"))
    chunks = ON.write_chunks(df, "chunk", root)
    assert chunks.n == 3 and [chunks.read(i).agg(F.min("k"), F.max("k")).first()[:] for i in range(3)] == [(0, 99), (100, 199), (200, 299)]

    def run(method, name, chunks=chunks):
        return ON.run_online(chunks.stream(), ["x"], "y", method, {0: 1.0, 1: 1.0}, name, chunks=chunks)

    st = run("log_loss", "t-online")
    assert st.batches == 3 and st.rows == 300
    acc = ON.predict(df, st.w, ["x"]).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9
    # a restart with the same checkpoint replays nothing and keeps the stored weights
    again = run("log_loss", "t-online")
    assert again.batches == 3 and list(again.w) == list(st.w)
    # a run that fails in the third chunk goes on with it
    good = ON.logistic_step

    def step(batch, *args):
        if batch.agg(F.max("k")).first()[0] == 299:
            raise RuntimeError("lost")
        return good(batch, *args)

    monkeypatch.setattr(ON, "logistic_step", step)
    with pytest.raises(StreamingQueryException):
        run("log_loss", "t-part")
    monkeypatch.setattr(ON, "logistic_step", good)
    rest = run("log_loss", "t-part")
    assert rest.batches == 3 and rest.rows == 300 and np.allclose(rest.w, st.w)
    pa = run("passive_aggressive", "t-pa")
    assert pa.batches == 3
    files = chunks.spark.readStream.schema(chunks.schema).parquet(f"{root}/chunk=*")  # any other stream of rows is drained as it comes
    assert ON.run_online(files.select("x", "y"), ["x"], "y", "log_loss", {0: 1.0, 1: 1.0}, "t-files").rows == 300


def test_chunks_in_turn_equal_chunks_one_by_one(spark, monkeypatch):
    n = ON.BATCH_CHUNKS + 6
    df = spark.range(n * 10).select(F.when(F.col("id") % 37 != 0, F.sin("id")).alias("x"), F.cos("id").alias("z"), (F.col("id") % 3 == 0).cast("int").alias("y"),
                                    (F.col("id") / 10).cast("long").alias("chunk")).where("chunk <> 5")
    chunks = ON.write_chunks(df.unionByName(spark.createDataFrame([(0.5, 0.5, 1, 5)], df.schema)), "chunk", S.scratch_path(spark, "t-turns"))
    assert spark.read.text(f"{chunks.root}_numbers").count() == 2  # batches, not chunks
    weights, step, mix = {0: 0.7, 1: 1.5}, ON.logistic_step, ON.pa_mix
    for method in ("log_loss", "passive_aggressive"):
        calls = []
        monkeypatch.setattr(ON, "logistic_step", lambda *a: calls.append(1) or step(*a))
        monkeypatch.setattr(ON, "pa_mix", lambda *a: calls.append(1) or mix(*a))
        got = ON.run_online(chunks.stream(), ["x", "z"], "y", method, weights, f"t-turn-{method}", steps=2, chunks=chunks)
        assert len(calls) == 2 and (got.batches, got.rows) == (n, (n - 1) * 10 + 1)
        want = np.zeros(3)
        for i in range(n):
            if method == "log_loss":
                for _ in range(2):
                    want = step(chunks.read(i), want, ["x", "z"], "y", weights, 0.5, 1e-4)
            else:
                want = mix(chunks.read(i), want, ["x", "z"], "y", weights)
        assert np.allclose(got.w, want, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(ON, "logistic_step", step)
    monkeypatch.setattr(ON, "TURN_ROWS", 5)  # larger batches: chunk by chunk, by aggregation
    slow = ON.run_online(chunks.stream(), ["x", "z"], "y", "log_loss", weights, "t-slow", steps=1, chunks=chunks)
    assert (slow.batches, slow.rows) == (n, (n - 1) * 10 + 1)
