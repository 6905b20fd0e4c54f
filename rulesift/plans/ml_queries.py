"""Embedding, clustering and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesift.operators import features as M
from rulesift.operators.balance import balanced_clusters
from rulesift.operators.generalise import generalise, merge_similar
from rulesift.operators.rules import numbered_lists
from rulesift.plans import rules_queries
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import with_views
from rulesift.session import ensure_checkpoint_dir, shared_path, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), "vec_id", "embedding", "label")


@register("nearest_centroid", with_views("""
, e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
c AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY label, pos),
d AS (SELECT e.vec_id, c.label, sum((e.v - c.m) * (e.v - c.m)) AS d2 FROM e JOIN c ON e.pos = c.pos
      GROUP BY e.vec_id, c.label),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), label) AS rn FROM d)
SELECT vec_id, label AS nearest, round(round(d2, 9), 6) AS distance2 FROM b WHERE rn = 1
"""))
def nearest_centroid(spark, sf_dir):
    """M3 (SQL form): nearest of the per-label centres for every embedding."""
    emb = table(spark, sf_dir, "embeddings")
    return M.nearest_centroid(emb, M.centroids_by_label(emb))


@register("kmeans_texts")
def kmeans_texts(spark, sf_dir):
    """M2: k-means (k = 4, seed 42) fit and assignment."""
    v = M.with_vector(_vectors(spark, sf_dir))
    model = M.fit_kmeans(v, v.count())
    return M.assign_clusters(model, v).select("vec_id", "cluster")


@register("pca_projection")
def pca_projection(spark, sf_dir):
    """M4: centred PCA to 2-D."""
    v = M.with_vector(_vectors(spark, sf_dir))
    return M.project(M.fit_projection(v), v).select("vec_id", "pca_x", "pca_y")


@register("model_reuse")
def model_reuse(spark, sf_dir):
    """M5: models saved per task/round and reused when the training keys match."""
    ensure_checkpoint_dir(spark)
    root = shared_path(spark, "models")
    v = M.with_vector(_vectors(spark, sf_dir))
    m1, fitted1 = M.load_or_fit(spark, root, "docs", 0, "projection", v, M.fit_projection)
    m2, fitted2 = M.load_or_fit(spark, root, "docs", 0, "projection", v, M.fit_projection)
    out = M.project(m2, v).select("vec_id", "pca_x", "pca_y")
    return out.withColumn("first_fit", F.lit(fitted1)).withColumn("second_fit", F.lit(fitted2))


@register("balanced_rule_clusters")
def balanced_rule_clusters(spark, sf_dir):
    """M8: size-constrained clusters (n div 15 + 1 of them, sizes within M7's limits)."""
    return balanced_clusters(_vectors(spark, sf_dir).select("uid", "embedding"))


_GEN_SQL = r"""
, rr AS (SELECT *, CAST(doc_id // 20 AS INTEGER) AS cluster_id FROM r0
         WHERE guideline_improvement IS NOT NULL
           AND upper(regexp_replace(guideline_improvement, '^\s+|\s+$', '', 'g')) <> 'EMPTY'),
nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY uid) AS INTEGER) AS n,
              regexp_replace(split_part(guideline_improvement, '->', 1), '^\s+|\s+$', '', 'g') AS cond FROM rr),
fc AS (SELECT cluster_id, cond, min(n) AS first_n FROM nr GROUP BY cluster_id, cond),
cn AS (SELECT cluster_id, cond, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY first_n) AS INTEGER)
              AS category_no FROM fc)
SELECT nr.cluster_id, cn.category_no, nr.cond || ' -> handle as the members agree' AS category_description,
       nr.n AS edge_case
FROM nr JOIN cn ON nr.cluster_id = cn.cluster_id AND nr.cond = cn.cond
"""


@register("generalise_rules", with_views(_GEN_SQL))
def generalise_rules(spark, sf_dir):
    """One synthesizer call per rule cluster, answers parsed into categories."""
    from rulesift.plans.rules_queries import numbered
    return generalise(numbered_lists(numbered(spark, sf_dir)))


_MERGE_SQL = rules_queries._CHAIN + r"""
, nrm AS (SELECT rule_no, rule, regexp_replace(lower(trim(rule)), '\s+', ' ', 'g') AS norm FROM ordered),
st AS (SELECT rule_no, norm, list_distinct(list_filter(regexp_split_to_array(norm, '\W+'), lambda w: w <> '')) AS ws FROM nrm),
wd AS (SELECT rule_no, len(ws) AS size, unnest(ws) AS w FROM st),
lk AS (SELECT a.rule_no AS a, b.rule_no AS b FROM wd a JOIN wd b ON a.w = b.w AND a.rule_no <> b.rule_no
       GROUP BY 1, 2, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
       UNION SELECT x.rule_no, y.rule_no FROM nrm x JOIN nrm y ON x.norm = y.norm AND x.rule_no <> y.rule_no),
hop1 AS (SELECT rule_no AS a, rule_no AS b FROM nrm UNION SELECT a, b FROM lk),
hop2 AS (SELECT DISTINCT x.a, y.b FROM hop1 x JOIN hop1 y ON x.b = y.a),
hop4 AS (SELECT DISTINCT x.a, y.b FROM hop2 x JOIN hop2 y ON x.b = y.a),
hop8 AS (SELECT DISTINCT x.a, y.b FROM hop4 x JOIN hop4 y ON x.b = y.a),
hop16 AS (SELECT DISTINCT x.a, y.b FROM hop8 x JOIN hop8 y ON x.b = y.a),
hop32 AS (SELECT DISTINCT x.a, y.b FROM hop16 x JOIN hop16 y ON x.b = y.a),
cmp AS (SELECT a AS rule_no, min(b) AS component FROM hop32 GROUP BY a)
SELECT CAST(c.rule_no AS BIGINT) AS rule_no, CAST(c.component AS BIGINT) AS component, n.rule AS merged_rule
FROM cmp c JOIN nrm n ON n.rule_no = c.component
"""


@register("merge_similar_rules", with_views(_MERGE_SQL))
def merge_similar_rules(spark, sf_dir):
    """Similar generalised rules merged (exact links, components)."""
    from rulesift.plans.rules_queries import rule_chain
    return merge_similar(rule_chain(spark, sf_dir)["ordered"])
