"""Readers for the test tables and the two flow-shaped adapters over them.

``scored`` turns the ``events`` table into a labelled prediction table
(truth, hard prediction, score, family, split); ``flows`` turns
``lineitem`` ⋈ ``orders`` ⋈ ``part`` into a labelled flow-feature table
(three categoricals, numeric features, a constant column, a time split).
Both are plain projections/joins, so Catalyst prunes columns and pushes
filters into the parquet scans of whatever query is built on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# The five attack families in code order (index = class code).
FAMILIES = ["normal", "DoS", "Probe", "R2L", "U2R"]
BINARY_CLASSES = ["normal", "attack"]

# Adapter mapping of event types and line flags to families.
EVENT_FAMILY = {"view": "normal", "click": "DoS", "purchase": "Probe",
                "signup": "R2L", "error": "U2R"}
FLOW_FAMILY = {"NO": "normal", "NF": "DoS", "AO": "DoS", "AF": "Probe",
               "RO": "R2L", "RF": "U2R"}

FLOW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FLOW_CATEGORICAL = ["protocol_type", "service", "flag"]
FLOW_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice",
                "p_size", "p_retailprice", "disc_price", "is_large", "zero_var"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def park_miller(key: Column, modulus: int = 2147483647) -> Column:
    """Deterministic pseudo-random order of an integer key: key*48271 mod (2^31-1).

    The key is reduced first so the product never overflows a long.
    """
    return ((key % F.lit(modulus)) * F.lit(48271)) % F.lit(modulus)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    label = F.col("event_type")
    score = F.col("value") / F.lit(200.0)
    return ev.select(
        F.col("event_id").alias("row_key"), "ts", "user_id", label.alias("label"),
        _case(label, EVENT_FAMILY).alias("attack_family"),
        F.when(label == "view", 0).otherwise(1).cast("int").alias("y"),
        F.least(score, F.lit(1.0)).alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("yhat"),
        (park_miller(F.col("event_id")) % 5).cast("int").alias("yhat5"),
        F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-21 00:00:00'"), "train")
        .otherwise("test").alias("split"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    lab = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey,
        lab.alias("label"), _case(lab, FLOW_FAMILY).alias("attack_family"),
        F.when(lab == "NO", 0).otherwise(1).cast("int").alias("binary_label"),
        F.col("o_orderpriority").alias("protocol_type"), F.col("p_type").alias("service"),
        F.concat(F.lit("Y"), F.year("l_shipdate").cast("string")).alias("flag"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice",
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("disc_price"),
        F.when(F.col("l_quantity") >= 25, 1).otherwise(0).cast("int").alias("is_large"),
        F.lit(0.0).alias("zero_var"),
        F.when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), "train")
        .otherwise("test").alias("split"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the float vector widened to ``array<double>``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                    "label")


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binary dataset: ``labels`` ⋈ ``documents`` on ``doc_id``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id")


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric view of ``events`` for outlier work: value, user_id and the JSON ``k``."""
    ev = table(spark, sf_dir, "events")
    label = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("row_key"),
        F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-21 00:00:00'"), "train")
        .otherwise("test").alias("split"),
        label.alias("label"), _case(label, EVENT_FAMILY).alias("attack_family"),
        F.when(label == "view", 0).otherwise(1).cast("int").alias("binary_label"),
        F.col("value"), F.col("user_id").cast("double").alias("user_id"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


EVENT_NUMERIC = ["value", "user_id", "k"]


#: The categories and labels that nsl_rows deals out by event id.
NSL_VALUES = {"protocol_type": ["tcp", "udp", "icmp"], "service": ["http", "smtp", "ftp", "domain_u", "private"], "flag": ["SF", "S0", "REJ", "RSTR"]}
NSL_ROW_LABELS = ["normal", "smurf", "nmap", "normal", "ftp_write", "rootkit", "normal"]


def _nsl_expressions(pick, integer, double) -> dict[str, str]:
    """Column → SQL expression over ``event_id``; the attack columns follow the label, so that models can learn."""
    from flowlab.sources.files import NSL_BINARY, NSL_FEATURES, NSL_RATES
    attack = "(CASE WHEN event_id % 7 IN (0, 3, 6) THEN 0 ELSE 1 END)"
    out = {}
    for i, c in enumerate(NSL_FEATURES):
        if c in NSL_VALUES:
            out[c] = pick(NSL_VALUES[c], f"event_id * {i + 3} + {attack}")
        elif c in NSL_BINARY:
            out[c] = integer(f"event_id % {i + 2} = 0")
        elif c in NSL_RATES:
            out[c] = double(f"(event_id * {2 * i + 1} + {attack} * 40) % 101")
        elif c == "num_outbound_cmds":
            out[c] = "0"
        else:
            out[c] = f"(event_id * {2 * i + 1}) % {10 + i} + {attack} * ((event_id * 13) % {5 + i})"
    out["label"] = pick(NSL_ROW_LABELS, "event_id")
    out["difficulty"] = "event_id % 22"
    return out


def nsl_sql() -> str:
    """DuckDB SELECT of the rows that nsl_rows makes."""
    cols = _nsl_expressions(lambda xs, k: "[" + ", ".join(f"'{x}'" for x in xs) + f"][({k}) % {len(xs)} + 1]",
                            lambda cond: f"({cond})::INT", lambda e: f"({e}) / 100.0::DOUBLE")
    return "SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + " FROM events"


def nsl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the 43-column connection schema, with ``event_id`` before them."""
    from flowlab.sources.files import nsl_schema
    cols = _nsl_expressions(lambda xs, k: "element_at(array(" + ", ".join(f"'{x}'" for x in xs) + f"), CAST(({k}) % {len(xs)} + 1 AS INT))",
                            lambda cond: f"CAST({cond} AS INT)", lambda e: f"CAST({e} AS DOUBLE) / 100.0D")
    kinds = {f.name: f.dataType.simpleString() for f in nsl_schema().fields}
    return table(spark, sf_dir, "events").selectExpr("event_id", *[f"CAST({e} AS {kinds[c]}) AS {c}" for c, e in cols.items()])
