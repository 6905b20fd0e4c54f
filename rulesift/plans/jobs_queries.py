"""Whole-table job queries (B1-B5, T1) with the offline plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesift.functions.text import split_template
from rulesift.plans import jobs as J
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import GUIDELINE, TASK_ID, points, round0, round1, with_views
from rulesift.session import ensure_checkpoint_dir, shared_path, table


def _examples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.lit(TASK_ID).alias("task_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))


def _guidelines(spark):
    return spark.createDataFrame([(TASK_ID, GUIDELINE)], "task_id string, guideline string")


def _round0_job(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    work = shared_path(spark, "work")
    ann = J.annotate_round(_examples(spark, sf_dir), _guidelines(spark), TASK_ID, 0, work, J.offline_plugins(),
                           out_path=f"{work}/rounds")
    return work, ann


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD, _MIDDLE, _TAIL = split_template(J.DEFAULT_TEMPLATE)


def _labels_sql(name: str, texts: str) -> str:
    """CTEs for the offline annotator's labels of cleaned, distinct texts (t) of ``texts``: uid, annotation, confidence, edge."""
    return rf"""
, {name}_c AS (SELECT DISTINCT regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t
               FROM ({texts})),
{name}_h AS (SELECT substr(sha256(concat('{TASK_ID}', chr(31), t)), 1, 32) AS uid,
                    CAST(concat('0x', substr(sha256(concat({_quoted(_HEAD + GUIDELINE + _MIDDLE)}, t, {_quoted(_TAIL)})), 1, 8)) AS BIGINT) AS h
             FROM {name}_c WHERE t IS NOT NULL AND length(t) > 0),
{name} AS (SELECT uid, CAST(h % 2 AS VARCHAR) AS annotation, CAST(40 + (h // 256) % 61 AS DOUBLE) AS confidence,
                  40 + (h // 256) % 61 <= 75 AS new_edge_case FROM {name}_h)
"""


@register("annotate_round_labels", with_views(_labels_sql("r", "SELECT text AS t FROM documents") + """
SELECT uid, annotation, confidence, new_edge_case, true AS parse_ok, CAST(NULL AS VARCHAR) AS error FROM r
"""))
def annotate_round_labels(spark, sf_dir):
    """B1: what the round's calls answered, for each distinct document."""
    _, ann = _round0_job(spark, sf_dir)
    return ann.select("uid", "annotation", "confidence", "new_edge_case", "parse_ok", "error")


_INCREMENT_SQL = _labels_sql("r", "SELECT text AS t FROM documents") + _labels_sql("n", "SELECT text AS t FROM benchmark") + """
SELECT uid, annotation, confidence, new_edge_case, false AS is_reannotated FROM r WHERE uid NOT IN (SELECT uid FROM n)
UNION ALL SELECT uid, annotation, confidence, new_edge_case, true FROM n
"""


@register("annotate_increment_labels", with_views(_INCREMENT_SQL))
def annotate_increment_labels(spark, sf_dir):
    """The annotation table after benchmark passages were added, without places."""
    work, ann = _round0_job(spark, sf_dir)
    new = table(spark, sf_dir, "benchmark").select(
        F.lit(TASK_ID).alias("task_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    out = J.annotate_increment(new, ann, _guidelines(spark), TASK_ID, 0, work, J.offline_plugins())
    return out.annotations.select("uid", "annotation", "confidence", "new_edge_case", "is_reannotated")


@register("annotate_round")
def annotate_round(spark, sf_dir):
    """B1: every document embedded, clustered, projected, labelled (cached) and parsed."""
    _, ann = _round0_job(spark, sf_dir)
    return ann.select("uid", "cluster", "pca_x", "pca_y", "annotation", "confidence", "new_edge_case", "parse_ok")


@register("discover_edge_cases")
def discover_edge_cases(spark, sf_dir):
    """B2: round 0's proposed rules clustered, generalised, merged and assigned."""
    ensure_checkpoint_dir(spark)
    work = shared_path(spark, "work")
    _, edge = J.discover_edge_cases(points(spark, sf_dir), TASK_ID, 0, work, J.offline_plugins())
    return edge.select("uid", "edge_case_id", "guideline_improvement", "low_level_rule", "pca_x", "pca_y")


@register("annotate_increment")
def annotate_increment(spark, sf_dir):
    """Benchmark passages scored with round 0's stored models and upserted."""
    work, ann = _round0_job(spark, sf_dir)
    new = table(spark, sf_dir, "benchmark").select(
        F.lit(TASK_ID).alias("task_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    out = J.annotate_increment(new, ann, _guidelines(spark), TASK_ID, 0, work, J.offline_plugins())
    return out.annotations.select("uid", "cluster", "annotation", "confidence", "is_reannotated")


@register("iterate")
def iterate(spark, sf_dir):
    """Guideline + saved rules -> round 1 labelling and edge-case discovery."""
    work, ann = _round0_job(spark, sf_dir)
    sugg, _ = J.discover_edge_cases(ann, TASK_ID, 0, work, J.offline_plugins())
    saved = sugg.select(F.lit(TASK_ID).alias("task_id"), F.col("rule_no").alias("cluster_no"), "rule")
    out = J.iterate(_examples(spark, sf_dir), _guidelines(spark), saved, TASK_ID, 1, work, J.offline_plugins(),
                    out_path=f"{work}/rounds")
    return out["annotations"].select("uid", "round", "annotation", "confidence", "new_edge_case")


@register("compare_rounds", with_views("""
SELECT count(*) AS paired_rows, round(avg(r.confidence - o.confidence), 6) AS mean_paired_change,
       count(*) FILTER (WHERE o.new_edge_case AND NOT r.new_edge_case) AS true_to_false,
       count(*) FILTER (WHERE NOT o.new_edge_case AND r.new_edge_case) AS false_to_true,
       count(*) FILTER (WHERE o.new_edge_case) AS paired_edges_before,
       count(*) FILTER (WHERE r.new_edge_case) AS paired_edges_after
FROM r0 o JOIN r1 r ON o.uid = r.uid
"""))
def compare_rounds(spark, sf_dir):
    """One-row evaluation of round 1 against round 0."""
    return J.round_summary(round0(spark, sf_dir), round1(spark, sf_dir))


def _stream(spark, sf_dir):
    from rulesift.streaming.increment import current_table, start
    work, ann = _round0_job(spark, sf_dir)
    inp = shared_path(spark, "stream_in")
    new = table(spark, sf_dir, "benchmark").select(
        F.lit(TASK_ID).alias("task_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    new.repartition(2, "ordinal").write.mode("overwrite").parquet(inp)
    out = shared_path(spark, "stream_out")
    q = start(spark, inp, out, shared_path(spark, "stream_ckpt"), ann, _guidelines(spark), TASK_ID, 0, work,
              J.offline_plugins(), max_files_per_trigger=1)
    q.awaitTermination()
    return current_table(spark, ann, out)


@register("stream_increment")
def stream_increment(spark, sf_dir):
    """Benchmark passages arrive as files; each micro-batch is scored and
    the annotation table is the base upserted with all batches."""
    return _stream(spark, sf_dir).select("uid", "cluster", "annotation", "confidence", "is_reannotated")


@register("stream_increment_labels", with_views(_INCREMENT_SQL))
def stream_increment_labels(spark, sf_dir):
    """The labels after the stream equal those of the batch increment."""
    return _stream(spark, sf_dir).select("uid", "annotation", "confidence", "new_edge_case", "is_reannotated")
