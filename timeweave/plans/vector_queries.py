"""Queries of the vector operators on the embedding samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators import rules as R
from timeweave.operators import vectors as V
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T

SM = T.SAMPLES_SQL
_UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
CENTROIDS_SQL = f"""parts AS (SELECT name, i, sum(x / n) AS s FROM (SELECT name, unnest(v) AS x, unnest(range(len(v))) AS i, sqrt(list_inner_product(v, v)) AS n FROM samples) GROUP BY ALL),
sums AS (SELECT name, list(s ORDER BY i) AS s FROM parts GROUP BY ALL), centroids AS (SELECT name, {_UNIT.format(v='s')} AS centroid FROM sums)"""
#: Queries: every vector, in ten clusters.
QUERIES_SQL = "q AS (SELECT sample_no AS query_id, CAST(sample_no % 10 AS INTEGER) AS cluster, v AS q FROM samples)"
PREFILTER_SQL = "pre AS (SELECT query_id, q, name, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INTEGER) AS rank FROM (SELECT query_id, q, name, list_inner_product(q, centroid) AS score FROM q, centroids)) WHERE rank <= 5)"
TOPK_SQL = "topk AS (SELECT query_id, name, avg(d) AS score FROM (SELECT query_id, p.name, d, row_number() OVER (PARTITION BY query_id, p.name ORDER BY d DESC, sample_no) AS r FROM (SELECT query_id, pre.name, sample_no, list_inner_product(pre.q, v) AS d FROM pre JOIN samples USING (name)) p) WHERE r <= 3 GROUP BY ALL)"


def _sql(*relations, body):
    return f"WITH {', '.join([SM, *relations])}\n{body}"


def _queries(spark, sf_dir):
    return T.samples(spark, sf_dir).select(F.col("sample_no").alias("query_id"), F.col("v").alias("q"))


def _prefilter(spark, sf_dir):
    samples = T.samples(spark, sf_dir)
    return V.centroid_prefilter(_queries(spark, sf_dir), V.mean_normalized(samples, ("name",)))


def _topk(spark, sf_dir):
    return V.topk_scores(_prefilter(spark, sf_dir), T.samples(spark, sf_dir))


@query("centroid", _sql(CENTROIDS_SQL, body="SELECT name, i - 1 AS i, round(centroid[i], 6) AS x FROM centroids, range(1, 65) t(i)"))
def centroid(spark, sf_dir):
    """A2, A3 in long form."""
    return V.mean_normalized(T.samples(spark, sf_dir), ("name",)).select("name", F.posexplode("centroid").alias("i", "_x")).select("name", F.col("i").cast("long").alias("i"), F.round("_x", 6).alias("x"))


@query("centroid_prefilter", _sql(CENTROIDS_SQL, QUERIES_SQL, PREFILTER_SQL, body="SELECT query_id, name, round(score, 6) AS score, rank FROM pre"))
def centroid_prefilter(spark, sf_dir):
    return _prefilter(spark, sf_dir).select("query_id", "name", F.round("score", 6).alias("score"), "rank")


@query("topk_score", _sql(CENTROIDS_SQL, QUERIES_SQL, PREFILTER_SQL, TOPK_SQL, body="SELECT query_id, name, round(score, 6) AS score FROM topk"))
def topk_score(spark, sf_dir):
    return _topk(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("best_candidate", _sql(CENTROIDS_SQL, QUERIES_SQL, PREFILTER_SQL, TOPK_SQL, body="SELECT query_id, name, round(score, 6) AS score FROM topk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) = 1"))
def best_candidate(spark, sf_dir):
    return V.best_candidate(_topk(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("speaker_score", _sql(CENTROIDS_SQL, QUERIES_SQL, PREFILTER_SQL, TOPK_SQL, body="SELECT CAST(query_id % 10 AS INTEGER) AS cluster, name, round(median(score), 6) AS score FROM topk GROUP BY ALL"))
def speaker_score(spark, sf_dir):
    return V.speaker_scores(_topk(spark, sf_dir).withColumn("cluster", (F.col("query_id") % 10).cast("int"))).withColumn("score", F.round("score", 6))


@query("unique_matches", _sql(CENTROIDS_SQL, QUERIES_SQL, PREFILTER_SQL, TOPK_SQL, body="""
, s AS (SELECT CAST(query_id % 10 AS INTEGER) AS cluster, name, median(score) AS score FROM topk GROUP BY ALL)
SELECT cluster, name, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, name) = 1"""))
def unique_matches(spark, sf_dir):
    return V.unique_matches(V.speaker_scores(_topk(spark, sf_dir).withColumn("cluster", (F.col("query_id") % 10).cast("int"))), 0.1).withColumn("score", F.round("score", 6))


@query("near_duplicate_vectors", _sql(body="""
, s AS (SELECT * FROM samples UNION ALL SELECT name, sample_no + 1000000, session, v FROM samples WHERE sample_no % 9 = 0)
SELECT a.sample_no AS a, b.sample_no AS b, round(list_inner_product(a.v, b.v), 6) AS cosine FROM s a JOIN s b ON a.sample_no <> b.sample_no WHERE list_inner_product(a.v, b.v) >= 0.999"""))
def near_duplicate_vectors(spark, sf_dir):
    rows = T.samples(spark, sf_dir)
    planted = rows.select(F.col("sample_no").alias("id"), "v").unionByName(rows.where("sample_no % 9 = 0").select((F.col("sample_no") + 1000000).alias("id"), "v"))
    return V.near_duplicates(planted, planted).withColumn("cosine", F.round("cosine", 6))


@query("robust_floor", _sql(CENTROIDS_SQL, body="""
, s AS (SELECT name, list_inner_product(v, centroid) AS c FROM samples JOIN centroids USING (name)),
m AS (SELECT name, median(c) AS m, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT s.name, median(abs(c - m)) AS mad FROM s JOIN m USING (name) GROUP BY ALL)
SELECT name, n, round(CASE WHEN n >= 5 THEN m - greatest(4 * 1.4826 * mad, 0.05) END, 6) AS floor FROM m JOIN d USING (name)"""))
def robust_floor(spark, sf_dir):
    samples = T.samples(spark, sf_dir)
    rated = samples.join(V.mean_normalized(samples, ("name",)), "name").withColumn("c", X.dot(F.col("v"), F.col("centroid")))
    return V.mad_floor(rated, ("name",), "c", 0.05).withColumn("floor", F.round("floor", 6))


@query("sample_neighbourhoods", _sql(body="""
, p AS (SELECT a.name, a.sample_no, b.sample_no AS other, b.session AS other_session, list_inner_product(a.v, b.v) AS d, a.session <> b.session AS f FROM samples a JOIN samples b ON a.name = b.name AND a.sample_no <> b.sample_no),
c AS (SELECT *, sum(f::INT) OVER (PARTITION BY name, sample_no) AS n FROM p)
SELECT name, sample_no, other, other_session, round(d, 6) AS d, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name, sample_no ORDER BY d DESC, other) AS INTEGER) AS rank FROM c WHERE n < 10 OR f) WHERE rank <= 5"""))
def sample_neighbourhoods(spark, sf_dir):
    return V.neighbourhoods(T.samples(spark, sf_dir)).withColumn("d", F.round("d", 6))


def _review(spark, sf_dir):
    return V.review(T.samples(spark, sf_dir), 0.2)


@query("sample_review")
def sample_review(spark, sf_dir):
    """M11 on every sample."""
    return _review(spark, sf_dir).select("name", "sample_no", F.round("center_similarity", 6).alias("center_similarity"), F.round("own_score", 6).alias("own_score"), "rival", F.round("rival_score", 6).alias("rival_score"), "isolated", "flag")


def _kept(spark, sf_dir):
    return T.samples(spark, sf_dir).withColumn("kept_by_user", F.col("sample_no") % 17 == 0)


def _findings(spark, sf_dir):
    history = T.samples(spark, sf_dir).select("name", "session").distinct().withColumn("pos", F.col("session"))
    return V.findings(_review(spark, sf_dir), _kept(spark, sf_dir), history, 0.2)


@query("tidy_plan")
def tidy_plan(spark, sf_dir):
    """Verdicts over the review, within the pass's limit."""
    return _findings(spark, sf_dir).select("name", "sample_no", "reason", "rival", F.round("severity", 6).alias("severity"), "verdict")


@query("tidy_summary")
def tidy_summary(spark, sf_dir):
    """Findings of each person by verdict."""
    return R.tidy_summary(_findings(spark, sf_dir))


@query("agglomerate")
def agglomerate(spark, sf_dir):
    """M6, M7 for each person's samples."""
    return V.clustered(T.samples(spark, sf_dir), "name", 0.9, 2)


@query("removal_budget", _sql(body="""
, f AS (SELECT name, sample_no, round(v[1], 6) AS severity, CASE WHEN sample_no % 3 = 0 THEN 'remove' ELSE 'kept' END AS verdict, count(*) OVER (PARTITION BY name) AS n FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY name, verdict = 'remove' ORDER BY severity DESC, sample_no) AS k FROM f)
SELECT name, sample_no, severity, CASE WHEN verdict = 'remove' AND k > least(CAST(floor(n * 0.1) AS BIGINT), greatest(n - 20, 0)) THEN 'deferred' ELSE verdict END AS verdict FROM r"""))
def removal_budget(spark, sf_dir):
    """K4."""
    rows = T.samples(spark, sf_dir)
    n = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_samples"))
    found = rows.join(n, "name").select("name", "sample_no", F.round(F.get("v", F.lit(0)), 6).alias("severity"), F.when(F.col("sample_no") % 3 == 0, "remove").otherwise("kept").alias("verdict"), "n_samples")
    return V.limit_removals(found).drop("n_samples")


@query("mds_layout")
def mds_layout(spark, sf_dir):
    """The people's centres in a plane; one row a person, so the matrix is small."""
    centres = V.mean_normalized(T.samples(spark, sf_dir), ("name",))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        v = np.array(g["centroid"].tolist())
        x, stress = V.layout(np.maximum(0, 1 - v @ v.T) * (1 - np.eye(len(v))))
        return pd.DataFrame({"name": g["name"], "x": x[:, 0], "y": x[:, 1], "stress": stress})

    return centres.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda g: run(g), "name string, x double, y double, stress double")


@query("principal_directions")
def principal_directions(spark, sf_dir):
    """M15 for each person's samples."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample_no")
        v = np.array(g["v"].tolist())
        axes = V.principal_directions(v)
        p = (v - v.mean(axis=0)) @ axes.T
        return pd.DataFrame({"name": g["name"], "sample_no": g["sample_no"], "x": p[:, 0], "y": p[:, 1]})

    return T.samples(spark, sf_dir).select("name", "sample_no", "v").groupBy("name").applyInPandas(run, "name string, sample_no long, x double, y double")
