"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesift.operators import explore as X
from rulesift.operators import rounds as R
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import edge_cases, history, points, round0, round1, suggestions, with_views
from rulesift.plans.rounds_queries import _PU

SEARCH_TERM = "From SRC1"
PINNED_UID = "b1"


def _p3_input(spark, sf_dir):
    e = edge_cases(spark, sf_dir)
    return e.select(
        F.when(F.col("source") != "src3", F.col("uid")).alias("uid"),
        "text_to_annotate",
        F.when(F.col("lang") != "en", F.col("cluster")).alias("cluster"),
        (F.col("edge_case_id") + 0.5).alias("edge_case_id"),
        "pca_x", "pca_y", "raw_annotations", "analyses", "annotation", "confidence",
        F.when(F.col("new_edge_case"), F.lit("True")).otherwise(F.lit("false")).alias("new_edge_case"),
        "guideline_improvement")


@register("normalise_records", with_views("""
, inp AS (SELECT CASE WHEN source <> 'src3' THEN uid END AS uid, text_to_annotate,
                 CASE WHEN lang <> 'en' THEN cluster END AS cluster,
                 CAST(edge_case_id AS DOUBLE) + 0.5 AS edge_case_id, pca_x, pca_y, raw_annotations,
                 analyses, annotation, confidence,
                 CASE WHEN new_edge_case THEN 'True' ELSE 'false' END AS new_edge_case,
                 guideline_improvement FROM ec)
SELECT coalesce(text_to_annotate, '') AS text_to_annotate,
       coalesce(CASE WHEN uid <> '' THEN uid END,
                concat('text_', sha256(coalesce(text_to_annotate, '')))) AS uid,
       coalesce(cluster, CAST(floor(edge_case_id) AS INTEGER), 0) AS cluster_id,
       coalesce(pca_x, 0.0) AS pca_x, coalesce(pca_y, 0.0) AS pca_y,
       coalesce(raw_annotations, '') AS raw_annotations, coalesce(analyses, '') AS analyses,
       coalesce(annotation, '0') AS annotation, coalesce(confidence, 0.0) AS confidence,
       coalesce(lower(new_edge_case) = 'true', false) AS new_edge_case,
       coalesce(guideline_improvement, '') AS guideline_improvement
FROM inp
"""))
def normalise_records(spark, sf_dir):
    """Records from mixed producers normalised into one shape."""
    return X.normalise_records(_p3_input(spark, sf_dir))


@register("nan_to_null", with_views("""
SELECT uid, CASE WHEN isfinite(pca_x) THEN pca_x END AS pca_x,
       CASE WHEN isfinite(pca_y) THEN pca_y END AS pca_y,
       CASE WHEN isfinite(confidence) THEN confidence END AS confidence
FROM pts
"""))
def nan_to_null(spark, sf_dir):
    """NaN / infinite floats become null before JSON output."""
    return X.nan_to_null(points(spark, sf_dir).select("uid", "pca_x", "pca_y", "confidence"))


@register("search_rows", with_views(f"""
SELECT uid, doc_id FROM pts
WHERE coalesce(contains(lower(text_to_annotate), lower('{SEARCH_TERM}')), false)
   OR coalesce(contains(lower(analyses), lower('{SEARCH_TERM}')), false)
   OR coalesce(contains(lower(raw_annotations), lower('{SEARCH_TERM}')), false)
"""))
def search_rows(spark, sf_dir):
    """Case-insensitive search over text, analysis and raw response."""
    return X.search(points(spark, sf_dir), SEARCH_TERM).select("uid", "doc_id")


@register("finite_points", with_views("""
SELECT uid, pca_x, pca_y FROM pts WHERE isfinite(pca_x) AND isfinite(pca_y)
"""))
def finite_points(spark, sf_dir):
    """Points with finite coordinates."""
    return X.finite_points(points(spark, sf_dir)).select("uid", "pca_x", "pca_y")


@register("plot_extents", with_views("""
SELECT coalesce(min(pca_x) FILTER (WHERE isfinite(pca_x)), -1.0) AS x_min,
       coalesce(max(pca_x) FILTER (WHERE isfinite(pca_x)), 1.0) AS x_max,
       coalesce(min(pca_y) FILTER (WHERE isfinite(pca_y)), -1.0) AS y_min,
       coalesce(max(pca_y) FILTER (WHERE isfinite(pca_y)), 1.0) AS y_max
FROM pts
"""))
def plot_extents(spark, sf_dir):
    """Coordinate extents (-1..1 when nothing is finite)."""
    return X.plot_extents(points(spark, sf_dir))


_BAND = """CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'missing'
     WHEN confidence < 30 THEN '<30' WHEN confidence < 50 THEN '30-50'
     WHEN confidence < 70 THEN '50-70' WHEN confidence < 90 THEN '70-90' ELSE '>=90' END"""


@register("confidence_bands", with_views(f"""
SELECT round, annotation, {_BAND} AS band, count(*) AS rows FROM hist GROUP BY ALL
"""))
def confidence_bands(spark, sf_dir):
    """P10: confidence band histogram per round and label."""
    return X.confidence_histogram(history(spark, sf_dir))


@register("unclear_points", with_views("""
SELECT uid, round, annotation,
       coalesce(starts_with(regexp_replace(CAST(annotation AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '-1'),
                false) AS unclear
FROM hist
"""))
def unclear_points(spark, sf_dir):
    """Unclassifiable flag per row of every round."""
    return history(spark, sf_dir).select("uid", "round", "annotation", X.is_unclear().alias("unclear"))


@register("cluster_groups", with_views("""
SELECT coalesce(cluster, 0) AS cluster_id, count(*) AS rows, round(avg(confidence), 6) AS mean_confidence,
       count(*) FILTER (WHERE coalesce(new_edge_case, false)) AS edge_rows, min(uid) AS first_uid
FROM pts GROUP BY 1
"""))
def cluster_groups(spark, sf_dir):
    """A10: groups of points by text cluster, ascending."""
    return X.cluster_groups(points(spark, sf_dir).withColumnRenamed("cluster", "cluster_id"))


@register("shown_groups", with_views("""
, g AS (SELECT coalesce(edge_case_id * 4 + cluster, 0) AS cluster_id, count(*) AS rows,
               round(avg(confidence), 6) AS mean_confidence,
               count(*) FILTER (WHERE coalesce(new_edge_case, false)) AS edge_rows, min(uid) AS first_uid
        FROM ec GROUP BY 1)
SELECT * FROM g
WHERE (SELECT count(*) FROM g) <= 20
   OR cluster_id IN (SELECT cluster_id FROM g ORDER BY cluster_id LIMIT 15)
"""))
def shown_groups(spark, sf_dir):
    """O7 + A10: rule x text sub-clusters; more than 20 -> the first 15."""
    e = edge_cases(spark, sf_dir).withColumn("cluster_id", F.col("edge_case_id") * 4 + F.col("cluster"))
    return X.shown_groups(X.cluster_groups(e))


@register("rule_lookup", with_views("""
, k AS (SELECT uid, concat('edge_case_', CAST(coalesce(CAST(edge_case_id AS BIGINT),
          CAST(floor(TRY_CAST(json_extract_string(raw_annotations, '$.edge_case_id') AS DOUBLE)) AS BIGINT),
          CAST(cluster AS BIGINT)) AS VARCHAR)) AS rule_key FROM ec),
s AS (SELECT rule_key, min(rule) AS rule FROM sugg GROUP BY rule_key)
SELECT k.uid, k.rule_key, coalesce(s.rule, '') AS rule_text FROM k LEFT JOIN s ON k.rule_key = s.rule_key
"""))
def rule_lookup(spark, sf_dir):
    """Each edge case's rule text via its id, raw JSON id or cluster."""
    out = X.attach_rule_text(edge_cases(spark, sf_dir), suggestions(spark, sf_dir))
    return out.select("uid", "rule_key", "rule_text")


@register("sort_new_first", with_views("""
SELECT uid, doc_id, CASE WHEN coalesce(is_reannotated, false) THEN 0 ELSE 1 END AS sort_group,
       -coalesce(confidence, 0.0) AS sort_value FROM r1
"""))
def sort_new_first(spark, sf_dir):
    """O1: re-labelled rows first, then confidence descending."""
    return X.sort_rows(round1(spark, sf_dir), "new").select("uid", "doc_id", "sort_group", "sort_value")


@register("sort_confidence", with_views("""
SELECT uid, doc_id, 0 AS sort_group, coalesce(confidence, 0.0) AS sort_value FROM r1
"""))
def sort_confidence(spark, sf_dir):
    """O2: by confidence, missing as 0."""
    return X.sort_rows(round1(spark, sf_dir), "confidence").select("uid", "doc_id", "sort_group", "sort_value")


@register("sort_confidence_change", with_views(", " + _PU.replace("FROM r1d c", "FROM r1 c") + """
, c AS (SELECT uid, doc_id, coalesce(CASE WHEN uid IS NOT NULL AND match_way <> 'none'
                                          THEN confidence - prev_confidence END, 0.0) AS ch FROM m)
SELECT uid, doc_id, CASE WHEN ch > 0 THEN 0 ELSE 1 END AS sort_group,
       CASE WHEN ch > 0 THEN ch ELSE -abs(ch) END AS sort_value FROM c
"""))
def sort_confidence_change(spark, sf_dir):
    """O3: gained rows first (smallest gain first), then the rest by |change| descending."""
    m = R.match_rounds(round1(spark, sf_dir), round0(spark, sf_dir))
    m = m.withColumn("confidence_change", F.when(
        F.col("uid").isNotNull() & (F.col("match_way") != "none"),
        F.col("confidence") - F.col("prev_confidence")))
    return X.sort_rows(m, "confidence_increase").select("uid", "doc_id", "sort_group", "sort_value")


@register("sort_class", with_views("""
SELECT uid, doc_id, 0 AS sort_group,
       CAST(CASE WHEN annotation = '-1' THEN -1.0 WHEN annotation = '1' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS sort_value
FROM r1
"""))
def sort_class(spark, sf_dir):
    """By class -1, 0, 1 (other labels count as 0)."""
    return X.sort_rows(round1(spark, sf_dir), "class").select("uid", "doc_id", "sort_group", "sort_value")


@register("sort_alphabetical", with_views("""
SELECT uid, doc_id, text_to_annotate FROM r1
"""))
def sort_alphabetical(spark, sf_dir):
    """Locale-aware alphabetical order (ICU UNICODE collation)."""
    return X.sort_rows(round1(spark, sf_dir), "alphabetical").select("uid", "doc_id", "text_to_annotate")


@register("first_page", with_views(f"""
, k AS (SELECT uid, doc_id, 0 AS sort_group, coalesce(confidence, 0.0) AS sort_value FROM r1),
top AS (SELECT *, row_number() OVER (ORDER BY sort_group, sort_value, uid NULLS FIRST) AS page_rank
        FROM k ORDER BY sort_group, sort_value, uid NULLS FIRST LIMIT 50),
sel AS (SELECT * FROM k WHERE uid = '{PINNED_UID}' ORDER BY sort_group, sort_value, uid LIMIT 1)
SELECT uid, doc_id, sort_group, sort_value, page_rank FROM top
UNION ALL
SELECT uid, doc_id, sort_group, sort_value, CAST(51 AS BIGINT) FROM sel
WHERE NOT EXISTS (SELECT 1 FROM top WHERE uid = '{PINNED_UID}')
"""))
def first_page(spark, sf_dir):
    """First page of 50 by confidence plus the selected row."""
    p = X.page(round1(spark, sf_dir), "confidence", pinned_uid=PINNED_UID)
    return p.select("uid", "doc_id", "sort_group", "sort_value", "page_rank")


@register("label_union", with_views("""
SELECT DISTINCT CAST(annotation AS VARCHAR) AS label FROM (SELECT annotation FROM r0 UNION ALL SELECT annotation FROM r1)
"""))
def label_union(spark, sf_dir):
    """Distinct labels of both rounds."""
    return X.label_values(round0(spark, sf_dir), round1(spark, sf_dir))


@register("palette_slots", with_views("""
, l AS (SELECT DISTINCT CAST(annotation AS VARCHAR) AS label
        FROM (SELECT annotation FROM r0 UNION ALL SELECT annotation FROM r1))
SELECT label, dense_rank() OVER (ORDER BY label NULLS FIRST) - 1 AS position,
       (dense_rank() OVER (ORDER BY label NULLS FIRST) - 1) % 4 AS slot FROM l
"""))
def palette_slots(spark, sf_dir):
    """The same colour slot for a label in both plots."""
    return X.palette_slots(X.label_values(round0(spark, sf_dir), round1(spark, sf_dir)))
