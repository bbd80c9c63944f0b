"""DuckDB oracle building blocks: the two adapters as CTEs, written independently
of the Spark code (they are the statements of FIXTURES.md §2)."""

SCORED = """scored AS (
SELECT event_id AS row_key, ts, user_id, event_type AS label,
  CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'DoS' WHEN 'purchase' THEN 'Probe'
       WHEN 'signup' THEN 'R2L' WHEN 'error' THEN 'U2R' END AS attack_family,
  CAST(CASE WHEN event_type='view' THEN 0 ELSE 1 END AS INT) AS y,
  least(value/CAST(200 AS DOUBLE), CAST(1 AS DOUBLE)) AS score,
  CAST(CASE WHEN value/CAST(200 AS DOUBLE) >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS INT) AS yhat,
  CAST((event_id*48271)%2147483647%5 AS INT) AS yhat5,
  CASE WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM events)"""

# family code 0..4 in the fixed family order
SCORED5 = SCORED + """,
scored5 AS (
SELECT *, CAST(CASE attack_family WHEN 'normal' THEN 0 WHEN 'DoS' THEN 1 WHEN 'Probe' THEN 2
       WHEN 'R2L' THEN 3 WHEN 'U2R' THEN 4 END AS INT) AS y5 FROM scored)"""

FLOWS = """flows AS (
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(l_returnflag,l_linestatus) AS label,
  CASE concat(l_returnflag,l_linestatus) WHEN 'NO' THEN 'normal' WHEN 'NF' THEN 'DoS' WHEN 'AO' THEN 'DoS'
       WHEN 'AF' THEN 'Probe' WHEN 'RO' THEN 'R2L' WHEN 'RF' THEN 'U2R' END AS attack_family,
  CAST(CASE WHEN concat(l_returnflag,l_linestatus)='NO' THEN 0 ELSE 1 END AS INT) AS binary_label,
  o_orderpriority AS protocol_type, p_type AS service, concat('Y',CAST(year(l_shipdate) AS VARCHAR(4))) AS flag,
  l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
  l_extendedprice*(CAST(1 AS DOUBLE)-l_discount) AS disc_price,
  CAST(CASE WHEN l_quantity>=25 THEN 1 ELSE 0 END AS INT) AS is_large, CAST(0 AS DOUBLE) AS zero_var,
  CASE WHEN l_shipdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)"""

FAMILY_LIST = "['normal','DoS','Probe','R2L','U2R']"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice",
           "p_size", "p_retailprice", "disc_price", "is_large", "zero_var"]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

EVENT_FEATURES = """ef AS (
SELECT event_id AS row_key, CASE WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 'train' ELSE 'test' END AS split,
  event_type AS label,
  CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'DoS' WHEN 'purchase' THEN 'Probe'
       WHEN 'signup' THEN 'R2L' WHEN 'error' THEN 'U2R' END AS attack_family,
  CAST(CASE WHEN event_type='view' THEN 0 ELSE 1 END AS INT) AS binary_label,
  value, CAST(user_id AS DOUBLE) AS user_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
FROM events)"""
EVENT_NUMERIC = ["value", "user_id", "k"]


def bundle_sql(k: int) -> str:
    """Metric-bundle SELECT over a CTE ``pairs(y_true, y_pred)`` with K declared classes."""
    return f""", grid AS (SELECT CAST(a.range AS INT) AS y_true, CAST(b.range AS INT) AS y_pred FROM range({k}) a, range({k}) b),
c AS (SELECT y_true, y_pred, count(*) AS n FROM pairs GROUP BY ALL),
cm AS (SELECT g.y_true, g.y_pred, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN c USING (y_true, y_pred)),
st AS (SELECT t.y_true AS k, sum(CASE WHEN t.y_true = t.y_pred THEN t.n ELSE 0 END) AS tp, sum(t.n) AS support,
  (SELECT sum(n) FROM cm p WHERE p.y_pred = t.y_true) AS predicted FROM cm t GROUP BY t.y_true),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM st)
SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
  avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
  avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
  CASE WHEN (sum(support)::DOUBLE ^ 2 - sum(predicted::DOUBLE ^ 2)) * (sum(support)::DOUBLE ^ 2 - sum(support::DOUBLE ^ 2)) = 0 THEN 0.0
  ELSE (sum(tp) * sum(support)::DOUBLE - sum(support::DOUBLE * predicted))
    / sqrt((sum(support)::DOUBLE ^ 2 - sum(predicted::DOUBLE ^ 2)) * (sum(support)::DOUBLE ^ 2 - sum(support::DOUBLE ^ 2))) END AS mcc
FROM pc"""


BUNDLE_COLS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1",
               "balanced_accuracy", "mcc")
