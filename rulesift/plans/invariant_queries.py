"""Invariants of the fitted operators as rows (M2, M4, M8, B2), so that SQL can check what it cannot compute; S2 from CSV; ranks
of the sorts (O1, O2, O4)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from rulesift.functions.text import text_key
from rulesift.operators import features as M
from rulesift.operators.balance import balanced_clusters
from rulesift.operators.explore import sort_keys
from rulesift.operators.ranking import global_row_number
from rulesift.plans import jobs as J
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import TASK_ID, points, round0, round1, with_views
from rulesift.plans.ml_queries import _vectors
from rulesift.session import shared_path
from rulesift.sources import ingest as I
from rulesift.sources import sinks as K


def one_row_of(*tables):
    """Tables of one row each side by side (a union and one aggregate, no join on a constant)."""
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


@register("kmeans_invariants", """
SELECT count(*) AS vectors, least(4, count(*)) AS clusters, CAST(0 AS BIGINT) AS not_nearest FROM embeddings WHERE embedding IS NOT NULL
""")
def kmeans_invariants(spark, sf_dir):
    """M2 + M3: every vector has a cluster, all k are used, and no centre is nearer than its own."""
    v = M.with_vector(_vectors(spark, sf_dir))
    n = v.count()
    model = M.fit_kmeans(v, n)
    placed = M.assign_clusters(model, v).select("vec_id", "cluster")
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "label int, centroid array<double>")  # k rows
    near = M.nearest_centroid(v.select("vec_id", "embedding"), centres)
    return (placed.join(near, "vec_id").agg(F.count("*").alias("vectors"), F.count_distinct("cluster").alias("clusters"),
                                            F.count_if((F.col("cluster") != F.col("nearest")) & (F.col("distance2") > 0)).alias("not_nearest")))


@register("pca_invariants", """
SELECT count(*) AS vectors, true AS centred, true AS uncorrelated, true AS widest_first FROM embeddings WHERE embedding IS NOT NULL
""")
def pca_invariants(spark, sf_dir):
    """M4: both coordinates have mean 0, do not correlate, and the first has the larger variance."""
    v = M.with_vector(_vectors(spark, sf_dir))
    p = M.project(M.fit_projection(v), v)
    return p.agg(F.count("*").alias("vectors"), ((F.abs(F.avg("pca_x")) < 1e-6) & (F.abs(F.avg("pca_y")) < 1e-6)).alias("centred"),
                 (F.abs(F.corr("pca_x", "pca_y")) < 1e-6).alias("uncorrelated"), (F.variance("pca_x") >= F.variance("pca_y")).alias("widest_first"))


@register("balanced_invariants", """
SELECT count(*) AS rules, count(*) // 15 + 1 AS clusters, true AS within_limits, true AS each_once FROM embeddings WHERE embedding IS NOT NULL
""")
def balanced_invariants(spark, sf_dir):
    """M6-M8: the number of clusters, their sizes and their cover."""
    rows = balanced_clusters(_vectors(spark, sf_dir).where("embedding is not null").select("uid", "embedding"))
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("u"))
    return sizes.agg(F.sum("n").alias("rules"), F.count("*").alias("clusters"), F.min(F.col("n").between(10, 20)).alias("within_limits"),
                     (F.sum("n") == F.sum("u")).alias("each_once"))


@register("discover_invariants", with_views("""
SELECT count(*) AS rows, count(*) AS placed, count(*) AS with_rule, true AS one_text_a_rule, true AS suggested FROM r0
WHERE upper(trim(guideline_improvement)) <> 'EMPTY'
"""))
def discover_invariants(spark, sf_dir):
    """B2: every proposed rule keeps its row, with a place and a final rule; a rule number has one text and is among the suggestions."""
    sugg, edge = J.discover_edge_cases(points(spark, sf_dir), TASK_ID, 0, shared_path(spark, "work"), J.offline_plugins())
    edge = edge.checkpoint()
    texts = edge.where("edge_case_id is not null").groupBy("edge_case_id").agg(F.count_distinct("guideline_improvement").alias("t"), F.min("guideline_improvement").alias("rule"))
    known = texts.join(sugg.select(F.col("rule_no").alias("edge_case_id"), F.col("rule").alias("r")), "edge_case_id", "left")
    rules = known.agg((F.max("t") == 1).alias("one_text_a_rule"), F.coalesce(F.min(F.col("r") == F.col("rule")) & (F.count("r") == F.count("*")), F.lit(False)).alias("suggested"))
    rows = edge.agg(F.count("*").alias("rows"), F.count_if(F.col("pca_x").isNotNull() & F.col("pca_y").isNotNull()).alias("placed"), F.count("edge_case_id").alias("with_rule"))
    return one_row_of(rows, rules)


@register("read_round_csv", with_views("""
SELECT uid, text_to_annotate, annotation, confidence, new_edge_case FROM r1
"""))
def read_round_csv(spark, sf_dir):
    """S2 + S4: two rounds written as CSV, one read back by the declared schema; line breaks, quotes and blanks in texts survive."""
    path = shared_path(spark, "rounds_csv")
    cols = ["task_id", "round", "uid", "text_to_annotate", "annotation", "confidence", "new_edge_case"]
    K.write_round(round0(spark, sf_dir).select(cols), path, fmt="csv")
    last = round1(spark, sf_dir).select(cols)
    K.write_round(last, path, fmt="csv")
    return I.read_round(spark, path, TASK_ID, 1, last.schema, fmt="csv").select(*cols[2:])


@register("sort_ranks", with_views("""
, k AS (SELECT 'new' AS sorted_by, uid, doc_id, text_to_annotate AS t, CASE WHEN coalesce(is_reannotated, false) THEN 0 ELSE 1 END AS g, -coalesce(confidence, 0.0) AS v FROM r1
        UNION ALL SELECT 'confidence', uid, doc_id, text_to_annotate, 0, coalesce(confidence, 0.0) FROM r1
        UNION ALL SELECT 'class', uid, doc_id, text_to_annotate, 0, CASE WHEN annotation = '-1' THEN -1.0 WHEN annotation = '1' THEN 1.0 ELSE 0.0 END FROM r1)
SELECT sorted_by, uid, doc_id, row_number() OVER (PARTITION BY sorted_by ORDER BY g, v, uid NULLS FIRST, sha256(t), doc_id) AS rank FROM k
"""))
def sort_ranks(spark, sf_dir):
    """The place of every row of round 1 in three sorts, by a distributed rank."""
    out = None
    for option in ("new", "confidence", "class"):
        keyed = sort_keys(round1(spark, sf_dir), option).select("sort_group", "sort_value", "uid", text_key("text_to_annotate").alias("_tk"), "doc_id")
        part = global_row_number(keyed, ["sort_group", "sort_value", "uid", "_tk", "doc_id"], "rank").select(F.lit(option).alias("sorted_by"), "uid", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out
