"""Registered labelling / projection / rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.columns import coerce_double, first_float
from flowlab.operators import label as L
from flowlab.operators import prep as P
from flowlab.plans import query
from flowlab.plans.prep_q import _VOCAB, _fitted
from flowlab.plans.sql import FLOWS, SCORED, SCORED5, with_
from flowlab.sources import files as S
from flowlab.sources.tables import FAMILIES, FLOW_CATEGORICAL, FLOW_NUMERIC, flows, nsl_rows, nsl_sql, park_miller, scored

NSL_LABELS = sorted(L.ATTACK_FAMILY_MAP)

# Raw IoT label spellings (separator / case / whitespace variants)
# used to exercise the tolerant category mapper.
IOT_SPELLINGS = ["BenignTraffic", "DDoS-UDP_Flood", "DDoS_ICMP_Flood", "DoS-SYN_Flood",
                 "DoS-HTTP_Flood", "Recon-PortScan", "Recon-OSScan", "VulnerabilityScan",
                 "Mirai-greeth_flood", "DNS_Spoofing", "MITM-ArpSpoofing", "DictionaryBruteForce",
                 "SqlInjection", "XSS", "Uploading_Attack", "Backdoor_Malware", "BrowserHijacking",
                 "CommandInjection", " ddos-syn_flood "]


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _pick(spark, sf, names, col="raw_label"):
    """Derive a raw label for every event row: names[hash(row_key) mod len]."""
    s = scored(spark, sf)
    arr = F.array(*[F.lit(x) for x in names])
    return s.select("row_key", "split", F.element_at(arr, (park_miller(F.col("row_key")) % len(names) + 1)
                                                     .cast("int")).alias(col))


def _pick_sql(names) -> str:
    return with_(SCORED, f"""d AS (SELECT row_key, split,
  {_sql_list(names)}[CAST(((row_key % 2147483647) * 48271) % 2147483647 % {len(names)} AS INT) + 1] AS raw_label FROM scored)""")


_FAMILY_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(L.ATTACK_FAMILY_MAP.items()))


@query("p01_family_map", _pick_sql(NSL_LABELS) + f"""
SELECT m.attack_family, count(*) AS n FROM d JOIN (VALUES {_FAMILY_VALUES}) m(label, attack_family)
  ON d.raw_label = m.label GROUP BY m.attack_family""")
def p01_family_map(spark, sf):
    d = L.add_label_columns(_pick(spark, sf, NSL_LABELS), "raw_label")
    return d.groupBy("attack_family").agg(F.count(F.lit(1)).alias("n"))


@query("p03_binary_label", _pick_sql(NSL_LABELS) + """
SELECT CAST((raw_label != 'normal')::INT AS INT) AS binary_label, count(*) AS n FROM d GROUP BY ALL""")
def p03_binary_label(spark, sf):
    d = L.add_label_columns(_pick(spark, sf, NSL_LABELS), "raw_label")
    return d.groupBy("binary_label").agg(F.count(F.lit(1)).alias("n"))


@query("p02_unknown_labels", with_(SCORED) + f"""
SELECT DISTINCT label FROM scored WHERE label NOT IN (SELECT unnest({_sql_list(NSL_LABELS)}))""")
def p02_unknown_labels(spark, sf):
    return L.unknown_labels(scored(spark, sf), "label")


_IOT_SQL = _pick_sql(IOT_SPELLINGS) + """,
c AS (SELECT trim(raw_label) AS label, regexp_replace(lower(trim(raw_label)), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM d),
m AS (SELECT label, CASE WHEN k IN ('benign','benigntraffic','normal') THEN 'Benign'
  WHEN starts_with(k, 'ddos') THEN 'DDoS' WHEN starts_with(k, 'dos') THEN 'DoS'
  WHEN starts_with(k, 'recon') OR k IN ('vulnerabilityscan','portsweep','pingsweep','osscan','hostdiscovery') THEN 'Recon'
  WHEN starts_with(k, 'mirai') THEN 'Mirai' WHEN contains(k, 'spoof') THEN 'Spoofing'
  WHEN contains(k, 'bruteforce') THEN 'Brute Force'
  WHEN k IN ('sqlinjection','commandinjection','backdoormalware','uploadingattack','xss','browserhijacking') THEN 'Web-based'
  END AS attack_category FROM c)
"""


@query("p04_category_mapper", _IOT_SQL + "SELECT label, attack_category, count(*) AS n FROM m GROUP BY ALL")
def p04_category_mapper(spark, sf):
    d = L.add_category(_pick(spark, sf, IOT_SPELLINGS).withColumnRenamed("raw_label", "label"))
    return d.groupBy("label", "attack_category").agg(F.count(F.lit(1)).alias("n"))


@query("p05_add_label_columns", _IOT_SQL + """
SELECT attack_category, CAST((attack_category != 'Benign')::INT AS INT) AS binary_label, count(*) AS n FROM m GROUP BY ALL""")
def p05_add_label_columns(spark, sf):
    d = L.add_category(_pick(spark, sf, IOT_SPELLINGS).withColumnRenamed("raw_label", "label"))
    return d.groupBy("attack_category", "binary_label").agg(F.count(F.lit(1)).alias("n"))


@query("p06_feature_columns", """
SELECT event_id, user_id, value, props FROM events""")
def p06_feature_columns(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "label")
    return ev.select(*L.feature_columns(ev, L.NON_FEATURE_COLUMNS | {"ts"}))


_ATTRS = FLOW_CATEGORICAL + FLOW_NUMERIC


@query("p07_attribute_type", with_(FLOWS) + """
SELECT a AS attribute, CASE WHEN a IN ('protocol_type','service','flag') THEN 'categorical'
  WHEN a IN ('is_large') THEN 'binary_numeric' ELSE 'numeric' END AS raw_type, n AS filled
FROM (UNPIVOT (SELECT """ + ", ".join(f"count({a}) AS {a}" for a in _ATTRS) + """ FROM flows) ON COLUMNS(*) INTO NAME a VALUE n)""")
def p07_attribute_type(spark, sf):
    f = flows(spark, sf)
    attrs = [c for c in f.columns if c in _ATTRS]
    filled = f.agg(*[F.count(c).alias(c) for c in attrs]).unpivot([], attrs, "attribute", "filled")
    return filled.select("attribute", L.raw_type(F.col("attribute"), FLOW_CATEGORICAL, ["is_large"]).alias("raw_type"), "filled")


_NAMES_SQL = _VOCAB + """, names AS (
  SELECT feature || '_' || category AS name FROM v
  UNION ALL SELECT unnest(""" + _sql_list(FLOW_NUMERIC) + """) AS name)"""


@query("p08_encoded_to_attribute", _NAMES_SQL + """
SELECT name, CASE WHEN starts_with(name, 'protocol_type_') THEN 'protocol_type'
  WHEN starts_with(name, 'service_') THEN 'service' WHEN starts_with(name, 'flag_') THEN 'flag' ELSE name END AS attribute
FROM names""")
def p08_encoded_to_attribute(spark, sf):
    _, fp = _fitted(spark, sf)
    names = spark.createDataFrame([(n,) for n in fp.feature_names()], "name string")
    return names.select("name", L.encoded_to_attribute(F.col("name"), FLOW_CATEGORICAL).alias("attribute"))


_P15_SQL = f"""WITH n AS ({nsl_sql()}),
names AS (SELECT DISTINCT 'protocol_type' AS attr, 'protocol_type_' || protocol_type AS name FROM n UNION SELECT DISTINCT 'service', 'service_' || service FROM n
  UNION SELECT DISTINCT 'flag', 'flag_' || flag FROM n UNION SELECT x, x FROM (SELECT unnest({_sql_list([c for c in S.NSL_FEATURES if c not in S.NSL_CATEGORICAL])}) AS x)),
g AS (SELECT 'all_features' AS grp, name FROM names
  UNION ALL SELECT 'categorical_one_hot', name FROM names WHERE attr != name UNION ALL SELECT 'numeric_only', name FROM names WHERE attr = name
  UNION ALL SELECT 'protocol_service_flag', name FROM names WHERE attr != name
  UNION ALL SELECT 'byte_volume', name FROM names WHERE attr IN {tuple(L.BYTE_FEATURES)}
  UNION ALL SELECT 'connection_count_rates', name FROM names WHERE attr IN {tuple(L.CONNECTION_FEATURES)}
  UNION ALL SELECT 'dst_host_behavior', name FROM names WHERE starts_with(attr, 'dst_host')
  UNION ALL SELECT 'content_login_shell', name FROM names WHERE attr IN {tuple(L.CONTENT_FEATURES)})
SELECT grp AS "group", count(*) AS size, string_agg(name, ',' ORDER BY name) AS members FROM g GROUP BY grp"""


@query("p15_feature_groups", _P15_SQL)
def p15_feature_groups(spark, sf):
    """All eight named groups, over the encoded columns of the 43-column rows."""
    fp = P.fit(nsl_rows(spark, sf), S.NSL_CATEGORICAL, [c for c in S.NSL_FEATURES if c not in S.NSL_CATEGORICAL])
    names = spark.createDataFrame(list(enumerate(fp.feature_names())), "position int, name string")
    m = L.feature_group_members(names, categorical=S.NSL_CATEGORICAL)
    return m.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"))


@query("p09_label_encoding", with_(SCORED5) + """
SELECT y5 AS label_index, attack_family, count(*) AS n FROM scored5 GROUP BY ALL""")
def p09_label_encoding(spark, sf):
    d = L.encode(scored(spark, sf), "attack_family", FAMILIES, "label_index")
    return d.groupBy("label_index", "attack_family").agg(F.count(F.lit(1)).alias("n"))


@query("p10_fine_classes", with_(FLOWS) + """
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS position, label AS class
FROM (SELECT DISTINCT label FROM flows WHERE split = 'train')""")
def p10_fine_classes(spark, sf):
    f = flows(spark, sf)
    _, classes = L.scheme_target(f.where(F.col("split") == "train"), "fine")
    return spark.createDataFrame(list(enumerate(classes)), "position int, class string")


@query("p12_mask_filter", with_(FLOWS) + """
SELECT split, count(*) AS normal_rows, avg(l_quantity) AS mean_quantity FROM flows
WHERE attack_family = 'normal' GROUP BY split""")
def p12_mask_filter(spark, sf):
    f = flows(spark, sf).where(F.col("attack_family") == "normal")
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("normal_rows"),
                                  F.avg("l_quantity").alias("mean_quantity"))


@query("p16_numeric_coercion", """
SELECT event_id AS row_key,
  CASE WHEN regexp_extract(props, '[-+]?\\d*\\.?\\d+', 0) = '' THEN NULL
       ELSE TRY_CAST(regexp_extract(props, '[-+]?\\d*\\.?\\d+', 0) AS DOUBLE) END AS first_float,
  TRY_CAST(trim(props) AS DOUBLE) AS strict_value,
  TRY_CAST(trim(CAST(user_id AS VARCHAR)) AS DOUBLE) AS user_value
FROM events""")
def p16_numeric_coercion(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select(F.col("event_id").alias("row_key"), first_float(F.col("props")).alias("first_float"),
                     coerce_double(F.col("props")).alias("strict_value"),
                     coerce_double(F.col("user_id")).alias("user_value"))
