"""Registered neighbour queries on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import evaluate as E
from flowlab.operators import neighbours as N
from flowlab.operators import sample as S
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import BUNDLE_COLS, bundle_sql
from flowlab.sources.tables import embeddings

_PAIRS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""


@query("j10_knn_join", rounded(f"""WITH {_PAIRS},
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance
  FROM e a, e b WHERE a.vec_id != b.vec_id)
SELECT query_id, neighbor_id, distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
WHERE rank <= 5""", "distance"))
def j10_knn_join(spark, sf):
    e = embeddings(spark, sf)
    return finish(N.knn(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True))


# Stratified 20 % validation split of the embeddings by label (hash order of vec_id),
# 5-NN majority vote from the training part, scored with the 10-class metric bundle.
_SPLIT = """r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY ((vec_id % 2147483647) * 48271) % 2147483647, vec_id) AS rk,
  count(*) OVER (PARTITION BY label) AS nc FROM embeddings),
sp AS (SELECT vec_id, CASE WHEN rk <= round_even(nc * 0.2, 0) THEN 'validation' ELSE 'train' END AS role FROM r)"""


@query("m08_knn_classifier", f"""WITH {_PAIRS}, {_SPLIT},
d AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, t.label, list_distance(q.v, t.v) AS distance
  FROM e q JOIN sp qs ON qs.vec_id = q.vec_id AND qs.role = 'validation',
       e t JOIN sp ts ON ts.vec_id = t.vec_id AND ts.role = 'train'),
nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 5),
v AS (SELECT query_id, label, count(*) AS n FROM nn GROUP BY ALL)
SELECT query_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""")
def m08_knn_classifier(spark, sf):
    e = embeddings(spark, sf)
    sp = S.stratified_split(e, "label", "vec_id", 0.2)
    train = sp.where(F.col("role") == "train")
    val = sp.where(F.col("role") == "validation")
    return N.knn_classify(train, val, 5, "vec_id", "vec_id", "embedding", "label")


_M08_SQL = f"""WITH {_PAIRS}, {_SPLIT},
d AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, t.label, list_distance(q.v, t.v) AS distance
  FROM e q JOIN sp qs ON qs.vec_id = q.vec_id AND qs.role = 'validation',
       e t JOIN sp ts ON ts.vec_id = t.vec_id AND ts.role = 'train'),
nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 5),
v AS (SELECT query_id, label, count(*) AS n FROM nn GROUP BY ALL)
SELECT query_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1"""


@query("m08_knn_metrics", rounded("WITH pred AS (" + _M08_SQL + "), pairs AS (SELECT e.label AS y_true, p.prediction AS y_pred "
                                  "FROM pred p JOIN embeddings e ON e.vec_id = p.query_id)" + bundle_sql(10), *BUNDLE_COLS))
def m08_knn_metrics(spark, sf):
    e = embeddings(spark, sf)
    pred = m08_knn_classifier(spark, sf).join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return finish(E.metric_bundle(pred, [str(i) for i in range(10)], "label", "prediction"))


_LOF_REF = "label <= 4"


@query("m11_lof", rounded(f"""WITH {_PAIRS},
ref AS (SELECT * FROM e WHERE {_LOF_REF}),
rr AS (SELECT a.vec_id AS o, b.vec_id AS p, list_distance(a.v, b.v) AS d FROM ref a, ref b WHERE a.vec_id != b.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY d, p) AS r FROM rr),
kd AS (SELECT o, d AS kdist FROM rk WHERE r = 35),
lrd AS (SELECT rk.o, 1.0 / (avg(greatest(rk.d, kd.kdist)) + 1e-10) AS lrd FROM rk JOIN kd ON kd.o = rk.p
  WHERE rk.r <= 35 GROUP BY rk.o),
qq AS (SELECT a.vec_id AS q, b.vec_id AS o, list_distance(a.v, b.v) AS d FROM e a, ref b),
qk AS (SELECT * FROM qq QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, o) <= 35),
s AS (SELECT qk.q, 1.0 / (avg(greatest(qk.d, kd.kdist)) + 1e-10) AS lrd_q, avg(lrd.lrd) AS lrd_nb
  FROM qk JOIN kd ON kd.o = qk.o JOIN lrd ON lrd.o = qk.o GROUP BY qk.q)
SELECT q AS query_id, lrd_nb / lrd_q AS lof FROM s""", "lof"))
def m11_lof(spark, sf):
    e = embeddings(spark, sf)
    ref = e.where(F.expr(_LOF_REF))
    return finish(N.lof_scores(ref, e, 35, "vec_id", "vec_id", "embedding"))
