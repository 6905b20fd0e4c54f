"""Ingest, id and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesift.functions import parse as P
from rulesift.functions import text as TX
from rulesift.operators.identity import assign_ids
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import GUIDELINE, TASK_ID, history, round0, with_views
from rulesift.session import ensure_checkpoint_dir, shared_path, table
from rulesift.sources import ingest as I

# Our own prompt template (the wording is a parameter of the engine).
PROMPT_TEMPLATE = (
    "You label texts by the guideline below.\n"
    "<guideline>\n{guideline}\n</guideline>\n"
    "Answer as JSON with the keys analysis, annotation, confidence, new_edge_case and "
    "new_edge_case_rule, for example {{\"annotation\": 0}}.\n"
    "<text>\n{text}\n</text>\n"
)

NL = "chr(10)"


def _sql_lit(s: str) -> str:
    """A SQL string expression for a Python string (newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts) if len(parts) > 1 else f"'{parts[0]}'"


# --- fixtures derived from the tables ------------------------------------------------

def task_guidelines(spark, sf_dir):
    """One guideline per source: labels are the source's languages (sorted);
    version 2 adds saved rules after ``Edge Case Handling:``."""
    tl = (table(spark, sf_dir, "documents").groupBy(F.col("source").alias("task_id"))
          .agg(F.array_sort(F.collect_set("lang")).alias("labels")))
    task = F.concat(F.lit("Label the language of texts from "), F.col("task_id"),
                    F.lit(".\n- Use the main language."))
    v1 = tl.select("task_id", F.lit(1).alias("version"), TX.compose_guideline(task, "labels").alias("guideline"))
    v2 = v1.select("task_id", F.lit(2).alias("version"), F.concat(
        "guideline", F.lit("\n\n" + TX.EDGE_SECTION + "\n1. When the text mixes languages -> label the first one"))
        .alias("guideline"))
    return v1.unionByName(v2)


_TG = r"""
, tl AS (SELECT DISTINCT source AS task_id, lang AS label FROM documents),
tg1 AS (SELECT task_id, 1 AS version,
               concat('Label the language of texts from ', task_id, '.', chr(10), '- Use the main language.',
                      chr(10), chr(10), 'Labels:', chr(10),
                      string_agg('- ' || label, chr(10) ORDER BY label)) AS guideline
        FROM tl GROUP BY task_id),
tg AS (SELECT * FROM tg1
       UNION ALL
       SELECT task_id, 2, concat(guideline, chr(10), chr(10), 'Edge Case Handling:', chr(10),
                                 '1. When the text mixes languages -> label the first one') FROM tg1)
"""


def raw_responses(spark, sf_dir):
    """Round 0 written back as model responses, one key per line, in six
    styles by ``doc_id % 6``: clean, code fences, after a reasoning block,
    confidence as a string, trailing comma, Python booleans."""
    r0 = round0(spark, sf_dir)
    style = F.col("doc_id") % 6
    conf = F.col("confidence").cast("bigint").cast("string")
    conf_txt = F.when(style == 3, F.concat(F.lit('"'), conf, F.lit('"'))).otherwise(conf)
    flag = F.when(style == 5, F.when(F.col("new_edge_case"), "True").otherwise("False")) \
        .otherwise(F.when(F.col("new_edge_case"), "true").otherwise("false"))
    body = F.concat(
        F.lit('{\n"analysis": "Text in '), F.col("lang"), F.lit(" from "), F.col("source"),
        F.lit('",\n"annotation": "'), F.col("annotation"),
        F.lit('",\n"confidence": '), conf_txt,
        F.lit(',\n"new_edge_case": '), flag,
        F.lit(',\n"new_edge_case_rule": "'), F.col("guideline_improvement"),
        F.when(style == 4, F.lit('",\n}')).otherwise(F.lit('"\n}')))
    raw = (F.when(style == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(style == 2, F.concat(F.lit("<think>\nweighing the labels\n</think>\n"), body))
           .otherwise(body))
    return r0.select("uid", "doc_id", "annotation", "confidence", "new_edge_case",
                     "guideline_improvement", "lang", "source", raw.alias("raw_annotations"))


# --- S1 / P1 / P2 / P14 --------------------------------------------------------------

CSV_FILE_BYTES = 64 << 20


@register("csv_ingest", with_views("""
SELECT 'docs' AS task_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS ordinal,
       text AS text_to_annotate
FROM documents
"""))
def csv_ingest(spark, sf_dir):
    """Documents written as CSV (messy header, multi-line quoted texts) and
    scanned back; ordinal = row position across files."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "csv_ingest")
    docs = table(spark, sf_dir, "documents")
    # a file with line breaks inside quotes is read by one task: as many files as keep each small
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    (docs.select(F.col("doc_id"), F.col("source").alias("Source "),
                 F.col("text").alias(" Text_To_Annotate "))
     .repartitionByRange(max(4, -(-size // CSV_FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
     .write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .mode("overwrite").csv(path))
    return I.read_texts_csv(spark, path, TASK_ID)


_EXAMPLES_SQL = r"""
, ex AS (SELECT 'docs' AS task_id, doc_id AS ordinal, text AS t FROM documents
         UNION ALL SELECT 'conv', conv_id * 10000 + turn, text FROM conversations),
c AS (SELECT task_id, ordinal,
             regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'),
                            '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS text_to_annotate FROM ex)
"""


def _examples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("task_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    c = table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("task_id"), (F.col("conv_id") * 10000 + F.col("turn")).alias("ordinal"),
        F.col("text").alias("text_to_annotate"))
    return d.unionByName(c)


@register("dedup_texts", with_views(_EXAMPLES_SQL + """
SELECT task_id, ordinal, text_to_annotate FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, text_to_annotate ORDER BY ordinal) AS rn
  FROM c WHERE text_to_annotate IS NOT NULL AND length(text_to_annotate) > 0) WHERE rn = 1
"""))
def dedup_texts(spark, sf_dir):
    """P1 + P2: cleaned, non-blank, first of exact duplicates per task."""
    return I.clean_examples(_examples(spark, sf_dir))


@register("strip_controls", with_views(r"""
SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS text_clean,
       length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS removed
FROM documents
"""))
def strip_controls(spark, sf_dir):
    """Control characters removed from every text."""
    d = table(spark, sf_dir, "documents")
    clean = TX.strip_controls("text")
    return d.select("doc_id", clean.alias("text_clean"),
                    (F.length("text") - F.length(clean)).cast("bigint").alias("removed"))


@register("input_report", with_views(_EXAMPLES_SQL + _TG + r"""
, e AS (SELECT task_id, count(*) AS examples,
               count(*) FILTER (WHERE t IS NULL OR length(regexp_replace(t, '^\s+|\s+$', '', 'g')) = 0)
                 AS blank_examples FROM ex GROUP BY task_id
        UNION ALL SELECT 'bench', count(*), count(*) FILTER (WHERE text IS NULL OR
               length(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 0) FROM benchmark),
g AS (SELECT 'docs' AS task_id, guideline FROM tg WHERE task_id = 'src0' AND version = 1
      UNION ALL SELECT 'bench', 'Tell whether the passage is from the benchmark.' || chr(10) || chr(10)
                                 || 'Labels: 1 (yes) or 0 (no)'
      UNION ALL SELECT 'empty', 'Labels:' || chr(10) || '- a' || chr(10) || '- b'),
gl AS (SELECT task_id,
              length(regexp_replace(regexp_extract(guideline, '(?s)^(.*?)(\n[ \t]*Labels:|$)', 1),
                                    '^\s+|\s+$', '', 'g')) AS task_len,
              len(list_filter(string_split(regexp_extract(guideline, '(?s)\n[ \t]*Labels:(.*)$', 1), chr(10)),
                  lambda s: starts_with(regexp_replace(s, '^\s+|\s+$', '', 'g'), '-'))) AS labels
       FROM g)
SELECT coalesce(e.task_id, gl.task_id) AS task_id, coalesce(e.examples, 0) AS examples,
       coalesce(e.blank_examples, 0) AS blank_examples, CAST(coalesce(gl.labels, 0) AS INTEGER) AS labels,
       (coalesce(e.task_id, gl.task_id) IS NULL OR length(trim(coalesce(e.task_id, gl.task_id))) = 0)
         AS missing_task_id,
       coalesce(gl.task_len = 0, true) AS missing_task_text,
       coalesce(e.examples, 0) = 0 AS no_examples,
       coalesce(gl.labels, 0) < 1 AS too_few_labels,
       coalesce(gl.labels, 0) = 1 AS one_label_warning
FROM e FULL OUTER JOIN gl ON e.task_id = gl.task_id
"""))
def input_report(spark, sf_dir):
    """Per-task violation counts over documents, conversations and benchmark."""
    ex = _examples(spark, sf_dir).unionByName(table(spark, sf_dir, "benchmark").select(
        F.lit("bench").alias("task_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("text_to_annotate")))
    tg = task_guidelines(spark, sf_dir)
    docs_g = tg.where((F.col("task_id") == "src0") & (F.col("version") == 1)).select(
        F.lit("docs").alias("task_id"), "guideline")
    others = spark.createDataFrame(
        [("bench", "Tell whether the passage is from the benchmark.\n\nLabels: 1 (yes) or 0 (no)"),
         ("empty", "Labels:\n- a\n- b")], "task_id string, guideline string")
    return I.input_report(ex, docs_g.unionByName(others))


# --- J1 ----------------------------------------------------------------------------

def _registry(spark, sf_dir):
    """Ids handed out by an earlier run over the English documents."""
    d = table(spark, sf_dir, "documents").where(F.col("lang") == "en")
    first = d.groupBy("text").agg(F.min("doc_id").alias("d"))
    return first.select(F.lit(TASK_ID).alias("task_id"), TX.text_key("text").alias("text_key"),
                        F.col("text").alias("text_to_annotate"),
                        F.concat(F.lit("u"), F.col("d").cast("string")).alias("uid"))


_REG_SQL = """
, reg AS (SELECT 'docs' AS task_id, sha256(text) AS text_key, concat('u', CAST(min(doc_id) AS VARCHAR)) AS uid
          FROM documents WHERE lang = 'en' GROUP BY text),
ids AS (SELECT d.doc_id, d.text, coalesce(r.uid, substr(sha256(concat('docs', chr(31), d.text)), 1, 32)) AS uid,
               r.uid IS NULL AS is_new
        FROM documents d LEFT JOIN reg r ON r.task_id = 'docs' AND r.text_key = sha256(d.text))
"""


@register("assign_ids", with_views(_REG_SQL + "SELECT doc_id, uid, is_new FROM ids"))
def assign_ids_q(spark, sf_dir):
    """Known texts keep their uid, new texts get a content id."""
    ex = table(spark, sf_dir, "documents").select(
        F.lit(TASK_ID).alias("task_id"), "doc_id", F.col("text").alias("text_to_annotate"))
    out, _ = assign_ids(ex, _registry(spark, sf_dir))
    return out.select("doc_id", "uid", "is_new")


@register("registry_additions", with_views(_REG_SQL + """
SELECT 'docs' AS task_id, sha256(text) AS text_key, min(uid) AS uid FROM ids WHERE is_new GROUP BY text
"""))
def registry_additions(spark, sf_dir):
    """One new registry row per distinct new text (duplicates share an id)."""
    ex = table(spark, sf_dir, "documents").select(
        F.lit(TASK_ID).alias("task_id"), "doc_id", F.col("text").alias("text_to_annotate"))
    _, add = assign_ids(ex, _registry(spark, sf_dir))
    return add.select("task_id", "text_key", "uid")


# --- F1 / F2 / F3 / F9 -----------------------------------------------------------------

@register("guideline_labels", with_views(r"""
, tl AS (SELECT DISTINCT source AS task_id, lang AS label FROM documents)
SELECT task_id, v.version, CAST(row_number() OVER (PARTITION BY task_id, v.version ORDER BY label) - 1 AS INTEGER)
         AS idx, label
FROM tl, (SELECT 1 AS version UNION ALL SELECT 2) v
"""))
def guideline_labels(spark, sf_dir):
    """label list of every guideline version (rules never become labels)."""
    return TX.labels_table(task_guidelines(spark, sf_dir))


@register("guideline_tasks", with_views(_TG + """
SELECT task_id, version,
       'Label the language of texts from ' || task_id || '.' || chr(10) || '- Use the main language.' AS task_text
FROM tg
"""))
def guideline_tasks(spark, sf_dir):
    """task text of every guideline version (its own '-' lines stay in it)."""
    return task_guidelines(spark, sf_dir).select("task_id", "version",
                                                 TX.guideline_task("guideline").alias("task_text"))


@register("compose_guideline", with_views(_TG + "SELECT task_id, guideline FROM tg1"))
def compose_guideline(spark, sf_dir):
    """guideline text composed from task text and ordered labels."""
    return task_guidelines(spark, sf_dir).where("version = 1").select("task_id", "guideline")


def _prompt_sql() -> str:
    head, middle, tail = TX.split_template(PROMPT_TEMPLATE)
    return f"concat({_sql_lit(head)}, {_sql_lit(GUIDELINE)}, {_sql_lit(middle)}, text_to_annotate, {_sql_lit(tail)})"


@register("prompt_keys", with_views(f"""
SELECT uid, sha256({_prompt_sql()}) AS prompt_key, CAST(length({_prompt_sql()}) AS INTEGER) AS prompt_chars FROM r0
"""))
def prompt_keys(spark, sf_dir):
    """one prompt per text; its SHA-256 is the response-cache key."""
    p = TX.render_prompt(PROMPT_TEMPLATE, F.lit(GUIDELINE), F.col("text_to_annotate"))
    return round0(spark, sf_dir).select("uid", F.sha2(p, 256).alias("prompt_key"),
                                        F.length(p).alias("prompt_chars"))


@register("rule_key_numbers", with_views(r"""
, k AS (SELECT DISTINCT source AS k FROM documents
        UNION SELECT DISTINCT 'edge_case_' || regexp_extract(source, '(\d+)$', 1) FROM documents
        UNION SELECT DISTINCT 'rule ' || lang FROM documents)
SELECT k AS rule_key,
       TRY_CAST(CASE WHEN regexp_extract(k, 'edge_case_(\d+)', 1) <> '' THEN regexp_extract(k, 'edge_case_(\d+)', 1)
                     WHEN regexp_extract(k, '(\d+)', 1) <> '' THEN regexp_extract(k, '(\d+)', 1) END AS INTEGER)
         AS rule_no
FROM k
"""))
def rule_key_numbers(spark, sf_dir):
    """rule key -> number (``edge_case_12`` -> 12, else first digits)."""
    d = table(spark, sf_dir, "documents")
    keys = (d.select(F.col("source").alias("rule_key"))
            .union(d.select(F.concat(F.lit("edge_case_"), F.regexp_extract("source", r"(\d+)$", 1))))
            .union(d.select(F.concat(F.lit("rule "), F.col("lang")))).distinct())
    return keys.select("rule_key", TX.rule_key_number("rule_key").alias("rule_no"))


# --- F4 - F6 -------------------------------------------------------------------------

@register("parse_responses", with_views("""
SELECT uid, 'Text in ' || lang || ' from ' || source AS analyses, annotation, confidence, new_edge_case,
       guideline_improvement, doc_id % 6 IN (0, 1, 2, 3) AS parse_ok
FROM r0
"""))
def parse_responses(spark, sf_dir):
    """Six response styles parsed back to round 0's values."""
    labels = TX.guideline_label_lines(F.lit(GUIDELINE))
    raw = raw_responses(spark, sf_dir).select("uid", "raw_annotations", labels.alias("labels"))
    out = P.parse_annotations(raw)
    return out.select("uid", "analyses", "annotation", "confidence", "new_edge_case",
                      "guideline_improvement", "parse_ok")


@register("label_mapping", with_views("""
, v AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '-1' WHEN 3 THEN '2'
                               WHEN 4 THEN 'one' WHEN 5 THEN '0' ELSE '-3' END AS raw FROM documents)
SELECT doc_id, raw, CASE raw WHEN '1' THEN '1' WHEN '1.0' THEN '1' WHEN '0' THEN '0' ELSE '-1' END AS annotation
FROM v
"""))
def label_mapping(spark, sf_dir):
    """label numbers as text / float / out of range / words / negative."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    raw = (F.when(F.col("doc_id") % 7 == 0, "1").when(F.col("doc_id") % 7 == 1, "1.0")
           .when(F.col("doc_id") % 7 == 2, "-1").when(F.col("doc_id") % 7 == 3, "2")
           .when(F.col("doc_id") % 7 == 4, "one").when(F.col("doc_id") % 7 == 5, "0").otherwise("-3"))
    labels = TX.guideline_label_lines(F.lit(GUIDELINE))
    return d.select("doc_id", raw.alias("raw")).select(
        "doc_id", "raw", P.label_text(F.col("raw"), labels).alias("annotation"))


# --- S2 -----------------------------------------------------------------------------

@register("read_round", with_views("""
SELECT uid, round, confidence, new_edge_case FROM hist WHERE task_id = 'docs' AND round = 1
"""))
def read_round(spark, sf_dir):
    """Rounds written partitioned by task and round; one round read back
    (partition pruning reads only that folder)."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "rounds")
    history(spark, sf_dir).write.partitionBy("task_id", "round").mode("overwrite").parquet(path)
    return I.read_round(spark, path, TASK_ID, 1).select("uid", "round", "confidence", "new_edge_case")
