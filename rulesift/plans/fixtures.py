"""Deterministic annotation rounds derived from the driver tables.

Two twins per view: a DataFrame builder (what the Spark queries use) and the
same view as portable SQL (what the DuckDB oracle uses). Both read the whole
``documents`` / ``labels`` / ``benchmark`` tables; nothing is sampled.

Round 0 labels every document: label from ``labels.toxic`` (missing -> -1),
a confidence derived from the id, an edge-case flag by the annotation prompt's
own rule (confidence <= 75 or label -1) and a rule text for edge cases.

Round 1 is the re-labelling after rules were added:
* the whole ``src3`` source was re-imported without ids (uid null), so those
  rows can only be matched to round 0 by text;
* the ``benchmark`` passages arrive as new examples (no round-0 match);
* confidences move up for earlier edge cases and jitter for the rest.

Where removed rows are the feature (matching and counting rounds), ``removed`` leaves the German documents out (``r1d`` in SQL); every
other query reads all of round 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.session import table

TASK_ID = "docs"

# Fixed guideline used by the fixture queries (labels are indexed from 0).
GUIDELINE = (
    "Decide whether the text is toxic.\n"
    "- A text is toxic when it insults or threatens a person or a group.\n"
    "\n"
    "Labels:\n"
    "- 0\n"
    "- 1"
)


def _edge(conf: str = "confidence", ann: str = "annotation"):
    return (F.col(conf) <= 75) | (F.col(ann) == "-1")


def _rule(edge, lang: str = "lang", source: str = "source", ann: str = "annotation"):
    return F.when(edge, F.concat(F.lit("When text in "), F.coalesce(F.col(lang), F.lit("any")),
                                 F.lit(" comes from "), F.col(source),
                                 F.lit(" -> classify as "), F.col(ann))).otherwise(F.lit("EMPTY"))


def round0(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    base = docs.join(labels, "doc_id", "left").select(
        F.lit(TASK_ID).alias("task_id"),
        F.lit(0).alias("round"),
        F.col("doc_id").cast("string").alias("uid"),
        "doc_id",
        F.col("text").alias("text_to_annotate"),
        "lang", "source",
        F.coalesce(F.col("toxic"), F.lit(-1)).cast("string").alias("annotation"),
        ((F.col("doc_id") * 37) % 101).cast("double").alias("confidence"),
    )
    edge = _edge()
    return base.select("*", edge.alias("new_edge_case"), _rule(edge).alias("guideline_improvement"))


def round1(spark: SparkSession, sf_dir: str, removed: bool = False) -> DataFrame:
    r0 = round0(spark, sf_dir)
    if removed:
        r0 = r0.where(F.col("lang") != "de")
    step = F.when(F.col("new_edge_case"), 20 - F.col("doc_id") % 7).otherwise(F.col("doc_id") % 5 - 2)
    docs = r0.select(
        "task_id",
        F.lit(1).alias("round"),
        F.when(F.col("source") != "src3", F.col("uid")).alias("uid"),
        "doc_id", "text_to_annotate", "lang", "source", "annotation",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("confidence") + step)).alias("confidence"),
        F.col("new_edge_case").alias("is_reannotated"),
    )
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit(TASK_ID).alias("task_id"),
        F.lit(1).alias("round"),
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("uid"),
        F.lit(None).cast("bigint").alias("doc_id"),
        F.col("text").alias("text_to_annotate"),
        F.lit(None).cast("string").alias("lang"),
        F.lit("benchmark").alias("source"),
        F.lit("-1").alias("annotation"),
        ((F.col("item_id") * 53) % 101).cast("double").alias("confidence"),
        F.lit(False).alias("is_reannotated"),
    )
    both = docs.unionByName(bench)
    edge = _edge()
    return both.select("*", edge.alias("new_edge_case"), _rule(edge).alias("guideline_improvement"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rounds in one table (rounds are partitions of one table)."""
    cols = ["task_id", "round", "uid", "text_to_annotate", "annotation", "confidence",
            "new_edge_case", "guideline_improvement"]
    return round0(spark, sf_dir).select(cols).unionByName(round1(spark, sf_dir).select(cols))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 0 as plotted points: text cluster, 2-D coordinates (a few NaN and
    +Inf values, as an unguarded projection can give), the model's raw JSON and
    the analysis text."""
    r0 = round0(spark, sf_dir)
    d = F.col("doc_id")
    x = F.when(d % 97 == 0, F.lit(float("nan"))).otherwise(((d * 17) % 200 - 100) / 50.0)
    y = F.when(d % 89 == 0, F.lit(float("inf"))).otherwise(((d * 29) % 200 - 100) / 40.0)
    raw = F.concat(
        F.lit('{"analysis": "Text in '), F.col("lang"), F.lit(' from '), F.col("source"),
        F.lit('", "annotation": "'), F.col("annotation"),
        F.lit('", "confidence": '), F.col("confidence").cast("bigint").cast("string"),
        F.lit(', "edge_case_id": '), ((d * 3) % 20).cast("string"), F.lit("}"))
    return r0.select(
        "*", ((d * 7) % 4).cast("int").alias("cluster"), x.alias("pca_x"), y.alias("pca_y"),
        raw.alias("raw_annotations"),
        F.concat(F.lit("Text in "), F.col("lang"), F.lit(" from "), F.col("source"), F.lit("."))
        .alias("analyses"))


def edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge-case rows of round 0 with a rule id from their source; rows of the
    last source are not covered by any rule (null id)."""
    p = points(spark, sf_dir).where(F.col("guideline_improvement") != "EMPTY")
    src_no = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return p.select("*", F.when(F.col("source") != "src19", src_no).alias("edge_case_id"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generalised rule per source number (keys ``edge_case_<n>``)."""
    src = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1)
    return src.select(
        F.concat(F.lit("edge_case_"), n).alias("rule_key"),
        F.concat(F.lit("When text comes from "), F.col("source"), F.lit(" -> review by hand"))
        .alias("rule"))


# The same views as SQL common table expressions (DuckDB and Spark SQL).
SQL_VIEWS = r"""
r0 AS (
  SELECT b.*,
         (b.confidence <= 75 OR b.annotation = '-1') AS new_edge_case,
         CASE WHEN b.confidence <= 75 OR b.annotation = '-1'
              THEN concat('When text in ', coalesce(b.lang, 'any'), ' comes from ', b.source,
                          ' -> classify as ', b.annotation)
              ELSE 'EMPTY' END AS guideline_improvement
  FROM (SELECT 'docs' AS task_id, 0 AS round, CAST(d.doc_id AS VARCHAR) AS uid, d.doc_id,
               d.text AS text_to_annotate, d.lang, d.source,
               CAST(COALESCE(l.toxic, -1) AS VARCHAR) AS annotation,
               CAST((d.doc_id * 37) % 101 AS DOUBLE) AS confidence
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) b),
r1 AS (
  SELECT c.*,
         (c.confidence <= 75 OR c.annotation = '-1') AS new_edge_case,
         CASE WHEN c.confidence <= 75 OR c.annotation = '-1'
              THEN concat('When text in ', coalesce(c.lang, 'any'), ' comes from ', c.source,
                          ' -> classify as ', c.annotation)
              ELSE 'EMPTY' END AS guideline_improvement
  FROM (SELECT task_id, 1 AS round, CASE WHEN source <> 'src3' THEN uid END AS uid, doc_id,
               text_to_annotate, lang, source, annotation,
               GREATEST(0.0, LEAST(100.0, confidence +
                 CASE WHEN new_edge_case THEN 20 - doc_id % 7 ELSE doc_id % 5 - 2 END)) AS confidence,
               new_edge_case AS is_reannotated
        FROM r0
        UNION ALL
        SELECT 'docs', 1, concat('b', CAST(item_id AS VARCHAR)), CAST(NULL AS BIGINT), text,
               CAST(NULL AS VARCHAR), 'benchmark', '-1', CAST((item_id * 53) % 101 AS DOUBLE), false
        FROM benchmark) c),
r1d AS (SELECT * FROM r1 WHERE source = 'benchmark' OR lang <> 'de'),
pts AS (
  SELECT r0.*, CAST((doc_id * 7) % 4 AS INTEGER) AS cluster,
         CASE WHEN doc_id % 97 = 0 THEN CAST('NaN' AS DOUBLE)
              ELSE ((doc_id * 17) % 200 - 100) / 50.0 END AS pca_x,
         CASE WHEN doc_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE)
              ELSE ((doc_id * 29) % 200 - 100) / 40.0 END AS pca_y,
         concat('{"analysis": "Text in ', lang, ' from ', source, '", "annotation": "', annotation,
                '", "confidence": ', CAST(CAST(confidence AS BIGINT) AS VARCHAR),
                ', "edge_case_id": ', CAST((doc_id * 3) % 20 AS VARCHAR), '}') AS raw_annotations,
         concat('Text in ', lang, ' from ', source, '.') AS analyses
  FROM r0),
ec AS (
  SELECT pts.*, CASE WHEN source <> 'src19'
                     THEN CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) END AS edge_case_id
  FROM pts WHERE guideline_improvement <> 'EMPTY'),
sugg AS (
  SELECT DISTINCT concat('edge_case_', regexp_extract(source, '(\d+)$', 1)) AS rule_key,
         concat('When text comes from ', source, ' -> review by hand') AS rule
  FROM documents),
hist AS (
  SELECT task_id, round, uid, text_to_annotate, annotation, confidence, new_edge_case,
         guideline_improvement FROM r0
  UNION ALL
  SELECT task_id, round, uid, text_to_annotate, annotation, confidence, new_edge_case,
         guideline_improvement FROM r1)
"""


def with_views(body: str) -> str:
    """An oracle query that can read r0, r1 and hist."""
    return "WITH " + SQL_VIEWS.strip() + "\n" + body.strip()
