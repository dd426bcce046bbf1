"""Registered clustering, retrieval and geo queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import cluster as C
from strata.operators import geo as G
from strata.operators import retrieve as RV
from strata.operators.features import standard_scale
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.plans.q_aggregates import _r
from strata.session import checkpoint_dir, cut_lineage
from strata.sources.tables import read_table

DIMS = 64
EMB_COLS = [f"e{i}" for i in range(DIMS)]


def emb(spark, sf, dims=DIMS):
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label",
                    *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(dims)])


_EMB_LONG = f"""lf AS (SELECT vec_id AS id, label, CAST(x AS DOUBLE) AS x, i
       FROM (SELECT vec_id, label, unnest(embedding[1:{DIMS}]) AS x, generate_subscripts(embedding[1:{DIMS}], 1) AS i
             FROM embeddings))"""


def churn_scaled(spark, sf):
    c = st.churn(spark, sf).select("customerID", "tenure", "MonthlyCharges", "n_orders",
                                   F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"))
    return cut_lineage(standard_scale(c, ["tenure", "MonthlyCharges", "n_orders"], digits=None))


@register("kmeans")
def q_kmeans(spark, sf):
    data = churn_scaled(spark, sf)
    _, assigned = C.kmeans(data, ["tenure", "MonthlyCharges", "n_orders"], 4, seed=42,
                           keep=["customerID", "label"])
    return assigned.select("customerID", "cluster")


@register("cluster_profile")
def q_cluster_profile(spark, sf):
    data = churn_scaled(spark, sf)
    _, assigned = C.kmeans(data, ["tenure", "MonthlyCharges", "n_orders"], 4, seed=42,
                           keep=["customerID", "label"])
    return C.cluster_profile(assigned, "cluster", "label", ["tenure", "MonthlyCharges", "n_orders"])


@register("elbow")
def q_elbow(spark, sf):
    return C.elbow(cut_lineage(emb(spark, sf)), EMB_COLS, range(1, 10))


@register("silhouette_select")
def q_silhouette_select(spark, sf):
    return C.silhouette_select(cut_lineage(emb(spark, sf)), EMB_COLS, range(2, 9), key="id")


@register("silhouette_samples", sql=f"""WITH {_EMB_LONG},
d AS (SELECT a.id, a.label, b.label AS other, SUM((a.x - b.x) * (a.x - b.x)) AS d2
      FROM lf a JOIN lf b ON a.i = b.i GROUP BY a.id, a.label, b.id, b.label),
m AS (SELECT id, label, other, SUM(d2) AS s, COUNT(*) AS n FROM d GROUP BY id, label, other),
ab AS (SELECT id, label,
              MAX(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a,
              MAX(CASE WHEN other = label THEN n END) AS n_own,
              MIN(CASE WHEN other <> label THEN s / n END) AS b
       FROM m GROUP BY id, label)
SELECT id, label AS cluster,
       CASE WHEN n_own <= 1 THEN 0.0 ELSE {_r('(b - a) / GREATEST(a, b)', 6)} END AS silhouette FROM ab""")
def q_silhouette_samples(spark, sf):
    """Per-point silhouette of the given labels as clusters."""
    return C.silhouette_samples(emb(spark, sf).withColumnRenamed("label", "cluster"), EMB_COLS, "cluster", "id")


def _points2d(spark, sf):
    return st.points(spark, sf).select("id", "x", "y")


def _dbscan_sql(settings: str, pts: str) -> str:
    """CTEs of DBSCAN by its definition: ``lab (s, id, root)``, where noise has no root.  ``settings``: rows of s, eps, m;
    ``pts``: a select of id, x, y."""
    return f"""setting(s, eps, m) AS (VALUES {settings}), pts AS ({pts}),
near AS (SELECT s, a.id, b.id AS nid FROM setting, pts a JOIN pts b
         ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= eps * eps),
core AS (SELECT s, id FROM near JOIN setting USING (s) GROUP BY s, id HAVING COUNT(*) >= MIN(m)),
link AS (SELECT near.s, near.id, nid FROM near JOIN core USING (s, id) JOIN core c ON c.s = near.s AND c.id = near.nid),
reach AS (SELECT s, id AS root, id FROM core
          UNION SELECT reach.s, root, nid FROM reach JOIN link ON link.s = reach.s AND link.id = reach.id),
roots AS (SELECT s, id, MIN(root) AS root FROM reach GROUP BY s, id),
lab AS (SELECT near.s, near.id, CASE WHEN MIN(own.root) IS NULL THEN MIN(roots.root) ELSE MIN(own.root) END AS root
        FROM near LEFT JOIN roots ON roots.s = near.s AND roots.id = nid LEFT JOIN roots own ON own.s = near.s AND own.id = near.id
        GROUP BY near.s, near.id)"""


_PTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


@register("dbscan", sql=f"""WITH RECURSIVE {_dbscan_sql("(0, 0.05::DOUBLE, 5)", _PTS)},
number AS (SELECT root, CAST(ROW_NUMBER() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT root FROM lab WHERE root IS NOT NULL))
SELECT id, COALESCE(cluster, -1) AS cluster FROM lab LEFT JOIN number USING (root)""")
def q_dbscan(spark, sf):
    return C.dbscan(_points2d(spark, sf), "x", "y", "id", eps=0.05, min_samples=5)


SWEEP_EPS, SWEEP_SAMPLES = (0.1, 0.2, 0.3, 0.35), (2, 10, 20, 100, 150, 250)


def sweep_points(spark, sf):
    """The points with mean 0 and deviation 1 in each coordinate, rounded: the scale that the sweep's ``eps`` refer to."""
    return standard_scale(_points2d(spark, sf), ["x", "y"], 9)


_SETTINGS = ", ".join(f"({k}, {e}::DOUBLE, {m})" for k, (e, m) in enumerate((e, m) for e in SWEEP_EPS for m in SWEEP_SAMPLES))


@register("dbscan_sweep", sql=f"""WITH RECURSIVE raw AS ({_PTS}),
stat AS (SELECT AVG(x) AS mx, STDDEV_POP(x) AS sx, AVG(y) AS my, STDDEV_POP(y) AS sy FROM raw),
{_dbscan_sql(_SETTINGS, f"SELECT id, {_r('(x - mx) / sx', 9)} AS x, {_r('(y - my) / sy', 9)} AS y FROM raw, stat")}
SELECT eps, m AS min_samples, CAST(COUNT(DISTINCT root) AS INTEGER) AS n_clusters, CAST(COUNT(*) - COUNT(root) AS INTEGER) AS n_noise
FROM lab JOIN setting USING (s) GROUP BY eps, m""")
def q_dbscan_sweep(spark, sf):
    return C.dbscan_sweep(sweep_points(spark, sf), "x", "y", "id", SWEEP_EPS, SWEEP_SAMPLES)


# ----------------------------------------------------------------- retrieval

def _index(spark, sf):
    return RV.vector_index(read_table(spark, sf, "embeddings"), "vec_id", "embedding")


def _written_index(spark, sf):
    """The embeddings as an index in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    RV.write_index(_index(spark, sf), path, most=10)
    return RV.read_index(spark, path)


_FULL_LONG = """flf AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                     generate_subscripts(embedding, 1) AS i FROM embeddings)"""
_CENTROIDS = """cen AS (SELECT CAST(label AS BIGINT) AS qid, i, AVG(x) AS x FROM flf GROUP BY label, i)"""


@register("vector_index", sql="""
SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings""")
def q_vector_index(spark, sf):
    return _index(spark, sf)


_TOPK_CENTROID = f"""WITH {_FULL_LONG}, {_CENTROIDS},
d AS (SELECT c.qid, f.id, SUM((c.x - f.x) * (c.x - f.x)) AS dist FROM cen c JOIN flf f ON c.i = f.i
      GROUP BY c.qid, f.id),
r AS (SELECT qid, id, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, dist FROM d)"""


@register("vector_topk", headline=True, sql=_TOPK_CENTROID + f"""
SELECT qid, id, rank, {_r('dist', 6)} AS dist FROM r WHERE rank <= 5""")
def q_vector_topk(spark, sf):
    e = read_table(spark, sf, "embeddings")
    queries = RV.label_centroids(e, "embedding", "label")
    return RV.vector_topk(queries, _written_index(spark, sf), k=5)


@register("topk_neighbors", sql=f"""WITH {_FULL_LONG},
d AS (SELECT a.id AS qid, b.id, SUM((a.x - b.x) * (a.x - b.x)) AS dist FROM flf a JOIN flf b ON a.i = b.i
      WHERE a.id <> b.id GROUP BY a.id, b.id),
r AS (SELECT qid, id, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, dist FROM d)
SELECT qid, id, rank, {_r('dist', 6)} AS dist FROM r WHERE rank <= 5""")
def q_topk_neighbors(spark, sf):
    idx = _index(spark, sf)
    r = RV.knn_points(idx, idx, k=5, exclude_self=True)
    return r.select("qid", "id", "rank", round_half_up("dist", 6).alias("dist"))


@register("corpus_text", sql="""
SELECT doc_id, concat_ws(' ', lang, source, text) AS corpus FROM documents""")
def q_corpus_text(spark, sf):
    from strata.functions.text import join_text
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", join_text("lang", "source", "text").alias("corpus"))


@register("rag_context", sql=_TOPK_CENTROID + """
SELECT r.qid, 'Context:' || chr(10) || string_agg(d.text, chr(10) ORDER BY r.rank) || chr(10) || chr(10)
       || 'Question: ' || 'Which passages describe label ' || CAST(r.qid AS VARCHAR) || '?' || chr(10) || 'Answer:' AS prompt
FROM r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 3 GROUP BY r.qid""")
def q_rag_context(spark, sf):
    """Top-3 vectors per label centroid; the text of a vector is the document
    with the same id (the stand-in chunk store)."""
    e = read_table(spark, sf, "embeddings")
    hits = RV.search_cells(RV.label_centroids(e, "embedding", "label"), *_written_index(spark, sf), k=3)
    texts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    questions = hits.select("qid").distinct().select(
        "qid", F.concat(F.lit("Which passages describe label "), F.col("qid").cast("string"), F.lit("?"))
        .alias("question"))
    return RV.rag_context(hits, texts, questions)


# ----------------------------------------------------------------------- geo

@register("points_geojson", sql=f"""WITH {st.POINTS_SQL}
SELECT to_json({{'type': 'Feature',
                 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}},
                 'properties': {{'id': id, 'region': region, 'value': FLOOR(value * 100 + 0.5) / 100}}}})::VARCHAR AS feature
FROM points""")
def q_points_geojson(spark, sf):
    return G.points_geojson(st.points(spark, sf), "lat", "lon", ["id", "region"], value="value", digits=2)


@register("geo_cluster", sql=f"""WITH {st.POINTS_SQL}
SELECT FLOOR(lat / 0.5) AS cell_lat, FLOOR(lon / 0.5) AS cell_lon, COUNT(*) AS n,
       {_r('AVG(lat)', 6)} AS centroid_lat, {_r('AVG(lon)', 6)} AS centroid_lon, {_r('SUM(value)', 6)} AS sum_value
FROM points GROUP BY 1, 2""")
def q_geo_cluster(spark, sf):
    g = G.geo_cluster(st.points(spark, sf), "lat", "lon", 0.5, value="value")
    return g.select(F.col("cell_lat").cast("double").alias("cell_lat"),
                    F.col("cell_lon").cast("double").alias("cell_lon"), "n", "centroid_lat",
                    "centroid_lon", "sum_value")
