"""Registered source / sink queries.

Each query first writes files derived from the given tables into a fresh
folder under the shared checkpoint location, then reads them back with the
operator under test, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.plans import finish, query, rounded
from flowlab.plans.label_q import IOT_SPELLINGS, _IOT_SQL
from flowlab.plans.report_q import _MT, method_table
from flowlab.plans.sql import FLOWS, SCORED, with_
from flowlab.sources import files as S
from flowlab.sources import results as RS
from flowlab.sources.tables import flows, nsl_rows, nsl_sql, park_miller, scored, table

LI_SCHEMA = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()),
                          T.StructField("l_extendedprice", T.DoubleType()),
                          T.StructField("l_returnflag", T.StringType())])


_NSL_SUMS = [c for c in S.NSL_FEATURES if c not in S.NSL_CATEGORICAL]


@query("s01_nsl_schema", rounded("SELECT label, protocol_type, service, flag, count(*) AS rows, CAST(sum(difficulty) AS BIGINT) AS difficulty, "
                                 + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in _NSL_SUMS)
                                 + f" FROM ({nsl_sql()}) GROUP BY label, protocol_type, service, flag", *_NSL_SUMS))
def s01_nsl_schema(spark, sf):
    """All 43 columns, written without a header and read back by the fixed schema through the split's name."""
    root = S.scratch_path(spark, "s01n")
    nsl_rows(spark, sf).drop("event_id").write.option("header", "false").csv(S.split_path(root, "train"))
    df = S.load_split(spark, root, "train")
    return finish(df.groupBy("label", "protocol_type", "service", "flag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("difficulty").alias("difficulty"), *[F.sum(c).cast("double").alias(c) for c in _NSL_SUMS]))


@query("s01_headerless_csv", rounded("""
SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price
FROM lineitem GROUP BY l_returnflag""", "quantity", "price"))
def s01_headerless_csv(spark, sf):
    path = S.scratch_path(spark, "s01")
    table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag") \
        .write.option("header", "false").csv(path)
    df = S.read_headerless_csv(spark, path, LI_SCHEMA)
    return finish(df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"),
                                                 F.sum("l_quantity").alias("quantity"),
                                                 F.sum("l_extendedprice").alias("price")))


_FLOW_CSV = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("label", T.StringType()),
                          T.StructField("l_quantity", T.DoubleType())])


@query("s02_split_selection", rounded(with_(FLOWS) + """
SELECT label, count(*) AS rows, sum(l_quantity) AS quantity FROM flows WHERE split = 'test' GROUP BY label""",
    "quantity"))
def s02_split_selection(spark, sf):
    root = S.scratch_path(spark, "s02")
    f = flows(spark, sf)
    names = {"train": "train_csv", "test": "test_csv"}
    for split, name in names.items():
        f.where(F.col("split") == split).select("l_orderkey", "label", "l_quantity") \
            .write.option("header", "false").csv(f"{root}/{name}")
    df = S.load_split(spark, root, "test", names, _FLOW_CSV)
    return finish(df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")))


def _write_iot_csv(spark, sf, name):
    """Events as IoT-style CSV files, one per event type, with a ' Label' header."""
    root = S.scratch_path(spark, name)
    s = scored(spark, sf)
    arr = F.array(*[F.lit(x) for x in IOT_SPELLINGS])
    lab = F.element_at(arr, (park_miller(F.col("row_key")) % len(IOT_SPELLINGS) + 1).cast("int"))
    ev = table(spark, sf, "events")
    out = s.join(ev.select(F.col("event_id").alias("row_key"), "value", "event_type"), "row_key") \
        .select("row_key", "value", lab.alias(" Label"), "event_type")
    # the manifest queries count one file a type, so the rows of a type meet in one writer
    out.repartition("event_type").write.partitionBy("event_type").option("header", "true").csv(root)
    return root


_IOT_SCHEMA = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("value", T.DoubleType()),
                            T.StructField(" Label", T.StringType())])


@query("s03_csv_discovery", "SELECT count(*) AS rows FROM events")
def s03_csv_discovery(spark, sf):
    root = _write_iot_csv(spark, sf, "s03")
    return S.csv_files(spark, root).agg(F.sum("rows").alias("rows"))


@query("s04_csv_sample", _IOT_SQL.replace("d AS (SELECT row_key, split,", "d AS (SELECT row_key, split, label AS event_type,")
       .replace("m AS (SELECT label,", "m AS (SELECT row_key, event_type, label,")
       .replace("c AS (SELECT trim(raw_label) AS label,", "c AS (SELECT row_key, event_type, trim(raw_label) AS label,") + """
SELECT row_key, label, attack_category, CAST((attack_category != 'Benign')::INT AS INT) AS binary_label FROM m
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ((row_key % 2147483647) * 48271) % 2147483647, row_key) <= 300""")
def s04_csv_sample(spark, sf):
    root = _write_iot_csv(spark, sf, "s04")
    df = S.load_csv_sample(spark, root, 300, key="row_key", schema=_IOT_SCHEMA)
    return df.select("row_key", "label", "attack_category", "binary_label")


@query("s05_dual_label_parquet", _IOT_SQL.replace("m AS (SELECT label,", "m AS (SELECT d2.label,")
       .replace("FROM c)", "FROM c d2)") + """
SELECT attack_category, CAST((attack_category != 'Benign')::INT AS INT) AS binary_label, count(*) AS n FROM m GROUP BY ALL""")
def s05_dual_label_parquet(spark, sf):
    path = S.scratch_path(spark, "s05")
    s = scored(spark, sf)
    arr = F.array(*[F.lit(x) for x in IOT_SPELLINGS])
    lab = F.element_at(arr, (park_miller(F.col("row_key")) % len(IOT_SPELLINGS) + 1).cast("int"))
    from flowlab.operators.label import attack_category
    x = s.select("row_key", "score", lab.alias("Label")) \
        .withColumn("attack_class", attack_category(F.col("Label"))) \
        .withColumn("lbl", (attack_category(F.col("Label")) != "Benign").cast("int"))
    prev = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        x.withColumnRenamed("lbl", "label").write.parquet(path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", prev)
    df = S.read_dual_label_parquet(spark, path)
    return df.groupBy("attack_category", "binary_label").agg(F.count(F.lit(1)).alias("n"))


@query("s06_label_column", "SELECT 'Label' AS label_column, count(*) AS rows FROM events")
def s06_label_column(spark, sf):
    root = _write_iot_csv(spark, sf, "s06")
    df = S.read_csv_tree(spark, root, _IOT_SCHEMA)
    found = S.find_label_column([c for c in df.columns if c not in ("source_file", "source_path")])
    return df.groupBy(F.lit(found).alias("label_column")).agg(F.count(F.lit(1)).alias("rows"))


@query("s07_header_trim", "SELECT 'Label' AS name, count(*) AS rows FROM events")
def s07_header_trim(spark, sf):
    root = _write_iot_csv(spark, sf, "s07")
    df = S.read_csv_tree(spark, root, _IOT_SCHEMA)
    trimmed = [c for c in df.columns if c.strip() == "Label"]
    return df.groupBy(F.lit(trimmed[0]).alias("name")).agg(F.count(F.lit(1)).alias("rows"))


@query("s08_text_manifest", """
SELECT CAST(1 AS BIGINT) AS distinct_column_counts, true AS consistent, CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT event_type) AS BIGINT) AS files FROM events""")
def s08_text_manifest(spark, sf):
    root = _write_iot_csv(spark, sf, "s08")
    m = S.text_manifest(spark, root, ",", header=True, glob="*.csv")
    return S.column_count_consistency(m)


@query("s09_assign_roles", "SELECT event_type AS role, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY event_type")
def s09_assign_roles(spark, sf):
    root = _write_iot_csv(spark, sf, "s09")
    ev = table(spark, sf, "events")
    expected = {int(r[1]): r[0] for r in ev.groupBy("event_type").count().collect()}  # one row per type
    m = S.text_manifest(spark, root, ",", header=True, glob="*.csv")
    return S.assign_roles(m, expected).select("role", "rows")


@query("s10_file_digests", """
SELECT count(DISTINCT event_type) AS files, count(DISTINCT event_type) AS digests, count(DISTINCT event_type) AS distinct_digests FROM events""")
def s10_file_digests(spark, sf):
    root = _write_iot_csv(spark, sf, "s10")
    d = S.file_digests(spark, root, "*.csv")
    return d.agg(F.count(F.lit(1)).alias("files"), F.count("sha256").alias("digests"),
                 F.count_distinct("sha256").alias("distinct_digests"))


@query("s11_result_sink", rounded(with_(SCORED) + """
SELECT attack_family AS family, avg(CASE WHEN attack_family = 'normal' THEN (yhat = 0)::INT ELSE (yhat = 1)::INT END)::DOUBLE AS recall,
  count(*) AS rows FROM scored GROUP BY attack_family""", "recall"))
def s11_result_sink(spark, sf):
    from flowlab.operators.evaluate import family_recall
    from flowlab.sources.tables import FAMILIES
    path = S.scratch_path(spark, "s11")
    RS.write_table(family_recall(scored(spark, sf), FAMILIES, "attack_family", "yhat"), path, "csv")
    back = spark.read.option("header", "true").schema("family_order int, family string, recall double, rows long").csv(path)
    return finish(back.select("family", "recall", "rows"))


@query("s12_run_log", rounded(with_(SCORED) + """
SELECT substr(sha256(concat_ws('::', 'events', label)), 1, 16) AS experiment_id, label AS run_name, m.metric, m.value
FROM (SELECT label, count(*)::DOUBLE AS rows, avg(score) AS mean_score FROM scored GROUP BY label) g,
  LATERAL (VALUES ('rows', g.rows), ('mean_score', g.mean_score)) m(metric, value)""", "value"))
def s12_run_log(spark, sf):
    from flowlab.functions.columns import stable_id
    path = S.scratch_path(spark, "s12")
    runs = RS.read_runs(spark, path)  # absent log → empty table
    assert runs.count() == 0
    g = scored(spark, sf).groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("rows"),
                                               F.avg("score").alias("mean_score"))
    rec = g.select(stable_id(F.lit("events"), F.col("label")).alias("experiment_id"),
                   F.lit("events").alias("dataset"), F.lit("binary").alias("task"),
                   F.lit("rule").alias("model_family"), F.col("label").alias("run_name"),
                   F.lit(42).alias("seed"), F.lit("ok").alias("status"),
                   F.create_map(F.lit("rows"), F.col("rows"), F.lit("mean_score"), F.col("mean_score")).alias("metrics"))
    RS.append_runs(rec, path)
    back = RS.read_runs(spark, path)
    return finish(back.select("experiment_id", "run_name", F.explode("metrics").alias("metric", "value")))


@query("s13_read_runs", """
SELECT 'absent' AS log, NULL AS run_name, CAST(0 AS BIGINT) AS seeds
UNION ALL SELECT 'written' AS log, event_type AS run_name, CAST(count(DISTINCT user_id) AS BIGINT) AS seeds FROM events GROUP BY event_type""")
def s13_read_runs(spark, sf):
    """A run for every (event type, user) is written and read again, after the log was found absent."""
    path = S.scratch_path(spark, "s13")
    absent = RS.read_runs(spark, path).agg(F.count(F.lit(1)).alias("seeds")).select(
        F.lit("absent").alias("log"), F.lit(None).cast("string").alias("run_name"), "seeds")
    absent = spark.createDataFrame(absent.collect(), absent.schema)  # one row, before the log is written
    ev = table(spark, sf, "events").select(F.col("event_type").alias("run_name"), F.col("user_id").cast("int").alias("seed")).distinct()
    RS.append_runs(ev, path)
    back = RS.read_runs(spark, path).groupBy("run_name").agg(F.count_distinct("seed").alias("seeds"))
    return absent.unionByName(back.select(F.lit("written").alias("log"), "run_name", "seeds"))


@query("s14_pipe_tables", rounded(_MT + """
SELECT split AS section, method, round(macro_f1, 4) AS macro_f1, round(accuracy, 4) AS accuracy FROM mt""",
    "macro_f1", "accuracy"))
def s14_pipe_tables(spark, sf):
    path = S.scratch_path(spark, "s14")
    mt = method_table(spark, sf)
    parts = None
    for split in ("train", "test"):
        md = RS.markdown_lines(mt.where(F.col("split") == split), split, ["method", "macro_f1", "accuracy"],
                               {"macro_f1": "%.4f", "accuracy": "%.4f"})
        parts = md if parts is None else parts.unionByName(md)
    # whole sections per file, in order: files are written in parallel by section
    parts.repartition("section").sortWithinPartitions("section", "pos").select("line").write.text(path)
    t = RS.read_pipe_tables(spark, path, 3)
    return finish(t.select("section", F.col("cells")[0].alias("method"),
                           F.col("cells")[1].try_cast("double").alias("macro_f1"),
                           F.col("cells")[2].try_cast("double").alias("accuracy")))
