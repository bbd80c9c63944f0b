"""Registered streaming queries (R01-R03): online models over a stream of event chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.columns import balanced_weights
from flowlab.operators import evaluate as E
from flowlab.operators import prep as P
from flowlab.operators.sample import chunk_ids
from flowlab.plans import finish, query
from flowlab.sources.files import scratch_path
from flowlab.sources.tables import EVENT_NUMERIC, event_features
from flowlab.streaming import online as ON

CHUNK_ROWS = 1000


def _stream_setup(spark, sf):
    ef = event_features(spark, sf)
    fp = P.fit(ef.where(F.col("split") == "train"), [], EVENT_NUMERIC)
    z = fp.apply(ef, keep=["row_key", "split", "attack_family", "binary_label"])
    train = z.where(F.col("split") == "train")
    w = {int(r["binary_label"]): float(r["weight"])
         for r in balanced_weights(train, "binary_label", 2).collect()}  # two rows
    chunks = ON.write_chunks(chunk_ids(train, "row_key", CHUNK_ROWS).drop("split", "attack_family"), "chunk_id", scratch_path(spark, "stream-src"))
    return z.where(F.col("split") == "test"), chunks, w


def _run(spark, sf, method, name):
    test, chunks, w = _stream_setup(spark, sf)
    st = ON.run_online(chunks.stream(), EVENT_NUMERIC, "binary_label", method, w, scratch_path(spark, name).rsplit("/", 1)[-1], chunks=chunks)
    pred = ON.predict(test, st.w, EVENT_NUMERIC)
    return pred, st, chunks.n


def _summary(pred, st, n_chunks, model):
    m = E.binary_metrics(pred, "binary_label", "prediction")
    return finish(m.select(F.lit(model).alias("model"), F.lit(st.batches).alias("chunks_seen"),
                           F.lit(n_chunks).alias("chunks_written"), F.lit(st.rows).alias("rows_seen"),
                           "accuracy", "macro_f1", "normal_recall", "attack_recall"))


@query("r01_online_logistic")
def r01_online_logistic(spark, sf):
    pred, st, n = _run(spark, sf, "log_loss", "r01")
    return _summary(pred, st, n, "online_log_loss")


@query("r02_passive_aggressive")
def r02_passive_aggressive(spark, sf):
    pred, st, n = _run(spark, sf, "passive_aggressive", "r02")
    return _summary(pred, st, n, "passive_aggressive_mixing")


@query("r03_chunks_confusion")
def r03_chunks_confusion(spark, sf):
    pred, st, n = _run(spark, sf, "log_loss", "r03")
    cm = E.confusion(pred, ["normal", "attack"], "binary_label", "prediction")
    return finish(cm.withColumn("chunks_seen", F.lit(st.batches)))
