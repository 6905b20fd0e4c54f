"""Round comparison queries (J4-J6, A1-A6, W5) over the fixture rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesift.operators import rounds as R
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import history, round0, round1, with_views

# Tie-break used by the oracle for "one previous row per text / per uid"; it
# mirrors Spark's min(struct(...)) which orders nulls first.
_PU = """
pu AS (SELECT * FROM (SELECT uid, confidence, new_edge_case, annotation,
         row_number() OVER (PARTITION BY uid ORDER BY confidence NULLS FIRST,
           new_edge_case NULLS FIRST, annotation NULLS FIRST) AS rn
       FROM r0 WHERE uid IS NOT NULL) WHERE rn = 1),
pt AS (SELECT * FROM (SELECT text_to_annotate, uid, confidence, new_edge_case, annotation,
         row_number() OVER (PARTITION BY text_to_annotate ORDER BY uid IS NULL, uid NULLS FIRST,
           confidence NULLS FIRST, new_edge_case NULLS FIRST, annotation NULLS FIRST) AS rn
       FROM r0 WHERE text_to_annotate IS NOT NULL) WHERE rn = 1),
m AS (SELECT c.*,
        CASE WHEN pu.uid IS NOT NULL THEN 'uid' WHEN pt.rn IS NOT NULL THEN 'text' ELSE 'none' END
          AS match_way,
        CASE WHEN pu.uid IS NOT NULL THEN pu.uid ELSE pt.uid END AS prev_uid,
        CASE WHEN pu.uid IS NOT NULL THEN pu.confidence ELSE pt.confidence END AS prev_confidence,
        CASE WHEN pu.uid IS NOT NULL THEN pu.new_edge_case ELSE pt.new_edge_case END AS prev_new_edge_case
      FROM r1d c LEFT JOIN pu ON c.uid = pu.uid
                LEFT JOIN pt ON c.text_to_annotate = pt.text_to_annotate)
"""


@register("compare_rounds_paired", with_views("""
SELECT o.new_edge_case AS edge_before, count(*) AS rows,
       round(avg(r.confidence - o.confidence), 6) AS mean_change,
       count(*) FILTER (WHERE o.new_edge_case AND NOT r.new_edge_case) AS resolved,
       count(*) FILTER (WHERE NOT o.new_edge_case AND r.new_edge_case) AS new_edges
FROM r0 o JOIN r1 r ON o.uid = r.uid
GROUP BY ROLLUP (o.new_edge_case)
"""))
def compare_rounds_paired(spark, sf_dir):
    """J4 + A5: paired confidence change and resolved edge cases by previous flag."""
    paired = R.pair_rounds(round0(spark, sf_dir), round1(spark, sf_dir))
    return R.paired_confidence_change(paired)


@register("edge_transitions", with_views("""
SELECT o.new_edge_case AS edge_before, r.new_edge_case AS edge_after, count(*) AS rows
FROM r0 o JOIN r1 r ON o.uid = r.uid
GROUP BY 1, 2
"""))
def edge_transitions(spark, sf_dir):
    """J4 + A4: True->False / False->True transitions and edge counts."""
    return R.edge_transitions(R.pair_rounds(round0(spark, sf_dir), round1(spark, sf_dir)))


@register("round_counts", with_views("""
, ids AS (SELECT uid AS k, count(*) FILTER (WHERE side = 0) AS nb, count(*) FILTER (WHERE side = 1) AS na
          FROM (SELECT uid, 0 AS side FROM r0 UNION ALL SELECT uid, 1 FROM r1d) GROUP BY uid)
SELECT CAST(sum(nb) AS BIGINT) AS rows_before, CAST(sum(na) AS BIGINT) AS rows_after,
       CAST(coalesce(sum(nb) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_ids_before,
       CAST(coalesce(sum(na) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_ids_after,
       count(*) FILTER (WHERE k IS NOT NULL AND nb > 0 AND na = 0) AS ids_only_before,
       count(*) FILTER (WHERE k IS NOT NULL AND na > 0 AND nb = 0) AS ids_only_after,
       (sum(nb) = sum(na)
        AND count(*) FILTER (WHERE k IS NOT NULL AND nb > 0 AND na = 0) = 0
        AND count(*) FILTER (WHERE k IS NOT NULL AND na > 0 AND nb = 0) = 0
        AND coalesce(sum(nb) FILTER (WHERE k IS NULL), 0) = 0
        AND coalesce(sum(na) FILTER (WHERE k IS NULL), 0) = 0) AS same_ids
FROM ids
"""))
def round_counts(spark, sf_dir):
    """Row counts and id-set equality of two rounds."""
    return R.round_counts(round0(spark, sf_dir), round1(spark, sf_dir, removed=True))


@register("round_match", with_views(", " + _PU + """
SELECT uid, doc_id, match_way, prev_uid, prev_confidence, confidence,
       round(confidence - prev_confidence, 6) AS confidence_change
FROM m
"""))
def round_match(spark, sf_dir):
    """Each round-1 row matched to round 0 by uid, else by text."""
    m = R.match_rounds(round1(spark, sf_dir, removed=True), round0(spark, sf_dir))
    return m.select("uid", "doc_id", "match_way", "prev_uid", "prev_confidence", "confidence",
                    F.round(F.col("confidence") - F.col("prev_confidence"), 6).alias("confidence_change"))


@register("round_match_summary", with_views(", " + _PU + """
SELECT match_way, count(*) AS rows,
       round(avg(CASE WHEN confidence BETWEEN 0 AND 100 THEN confidence END)
             - avg(CASE WHEN prev_confidence BETWEEN 0 AND 100 THEN prev_confidence END), 6) AS mean_shift
FROM m GROUP BY match_way
"""))
def round_match_summary(spark, sf_dir):
    """J5 summary: rows and mean shift per way of matching."""
    return R.match_summary(R.match_rounds(round1(spark, sf_dir, removed=True), round0(spark, sf_dir)))


@register("point_membership", with_views("""
, e AS (SELECT * FROM r0 WHERE new_edge_case)
SELECT c.uid, c.doc_id,
       (c.uid IN (SELECT uid FROM r0 WHERE uid IS NOT NULL)
        OR c.text_to_annotate IN (SELECT text_to_annotate FROM r0 WHERE text_to_annotate IS NOT NULL))
         IS TRUE AS in_annotations,
       (c.uid IN (SELECT uid FROM e WHERE uid IS NOT NULL)
        OR c.text_to_annotate IN (SELECT text_to_annotate FROM e WHERE text_to_annotate IS NOT NULL))
         IS TRUE AS in_edge_cases
FROM r1 c
"""))
def point_membership(spark, sf_dir):
    """Is each round-1 point among round 0's annotations / edge cases."""
    r0 = round0(spark, sf_dir)
    out = R.membership(round1(spark, sf_dir), r0, r0.where("new_edge_case"))
    return out.select("uid", "doc_id", "in_annotations", "in_edge_cases")


@register("round_statistics", with_views("""
SELECT count(*) FILTER (WHERE side = 1) AS total_rows,
       count(*) FILTER (WHERE side = 1 AND e) AS edge_rows,
       round(coalesce(avg(c) FILTER (WHERE side = 1 AND e AND c BETWEEN 0 AND 100), 0.0), 6)
         AS edge_mean_confidence,
       round(coalesce(avg(c) FILTER (WHERE side = 1 AND NOT e AND c BETWEEN 0 AND 100), 0.0), 6)
         AS other_mean_confidence,
       coalesce(bool_or(side = 1 AND r), false) AS any_reannotated,
       count(*) FILTER (WHERE side = 1 AND e) - count(*) FILTER (WHERE side = 0 AND e)
         AS edge_rows_change
FROM (SELECT 1 AS side, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END AS c,
             coalesce(new_edge_case, false) AS e, coalesce(is_reannotated, false) AS r FROM r1
      UNION ALL
      SELECT 0, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END,
             coalesce(new_edge_case, false), false FROM r0)
"""))
def round_statistics(spark, sf_dir):
    """A1 + A3 + A14: panel statistics of round 1 against round 0."""
    return R.round_statistics(round1(spark, sf_dir), round0(spark, sf_dir))


@register("confidence_shift_by_class", with_views("""
, cu AS (SELECT * FROM (SELECT uid, confidence,
           row_number() OVER (PARTITION BY uid ORDER BY confidence NULLS FIRST) AS rn
         FROM r1 WHERE uid IS NOT NULL) WHERE rn = 1),
ct AS (SELECT * FROM (SELECT text_to_annotate, confidence,
          row_number() OVER (PARTITION BY text_to_annotate ORDER BY uid IS NULL, uid NULLS FIRST,
                             confidence NULLS FIRST) AS rn
        FROM r1 WHERE text_to_annotate IS NOT NULL) WHERE rn = 1),
j AS (SELECT coalesce(p.new_edge_case, false) AS prev_edge, p.confidence AS pc,
             (cu.uid IS NOT NULL OR ct.rn IS NOT NULL) AS matched,
             CASE WHEN cu.uid IS NOT NULL THEN cu.confidence ELSE ct.confidence END AS cc
      FROM r0 p LEFT JOIN cu ON p.uid = cu.uid
                LEFT JOIN ct ON p.text_to_annotate = ct.text_to_annotate)
SELECT prev_edge, count(*) AS prev_rows, count(*) FILTER (WHERE matched) AS matched_rows,
       round(avg(CASE WHEN matched AND cc BETWEEN 0 AND 100 THEN cc END)
             - avg(CASE WHEN pc BETWEEN 0 AND 100 THEN pc END), 6) AS confidence_shift
FROM j GROUP BY prev_edge
"""))
def confidence_shift_by_class(spark, sf_dir):
    """A2: unpaired round difference by previous class."""
    return R.confidence_shift_by_class(round1(spark, sf_dir), round0(spark, sf_dir))


@register("confidence_lag", with_views("""
SELECT uid, round, confidence,
       CASE WHEN uid IS NOT NULL THEN lag(confidence) OVER (PARTITION BY uid ORDER BY round) END
         AS prev_confidence,
       round(confidence - CASE WHEN uid IS NOT NULL
                               THEN lag(confidence) OVER (PARTITION BY uid ORDER BY round) END, 6)
         AS confidence_change
FROM hist
"""))
def confidence_lag(spark, sf_dir):
    """Per-uid change against the previous round, over all rounds."""
    return R.confidence_lag(history(spark, sf_dir)).select(
        "uid", "round", "confidence", "prev_confidence", "confidence_change")
