"""Cache, registry and export queries (J2, J3, W2, A12, J7, U2, U3, J12, J13,
W4, S4-S9, A9, A13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulesift.functions import text as TX
from rulesift.operators import cache as C
from rulesift.operators import registry as G
from rulesift.operators.rules import complete_guideline
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import edge_cases, points, round0, round1, with_views
from rulesift.plans.ingest_queries import PROMPT_TEMPLATE, _prompt_sql, task_guidelines
from rulesift.plans.fixtures import GUIDELINE, TASK_ID
from rulesift.session import ensure_checkpoint_dir, shared_path, table
from rulesift.sources import sinks as K

_TG_SQL = r"""
, tl AS (SELECT DISTINCT source AS task_id, lang AS label FROM documents),
tg1 AS (SELECT task_id, concat('Label the language of texts from ', task_id, '.', chr(10), '- Use the main language.',
                      chr(10), chr(10), 'Labels:', chr(10),
                      string_agg('- ' || label, chr(10) ORDER BY label)) AS guideline
        FROM tl GROUP BY task_id)
"""


def _requests(spark, sf_dir):
    p = TX.render_prompt(PROMPT_TEMPLATE, F.lit(GUIDELINE), F.col("text_to_annotate"))
    return round0(spark, sf_dir).select("uid", "doc_id", "lang", "new_edge_case", "text_to_annotate",
                                        p.alias("prompt"))


def _known_cache(spark, sf_dir):
    """Responses stored by an earlier run over the English documents."""
    r = _requests(spark, sf_dir).where(F.col("lang") == "en")
    return r.select(F.lit("annotator").alias("model"), F.sha2("prompt", 256).alias("prompt_key")).distinct()


_REQ_SQL = f"""
, req AS (SELECT uid, doc_id, lang, new_edge_case, text_to_annotate, {_prompt_sql()} AS prompt FROM r0),
kc AS (SELECT DISTINCT sha256(prompt) AS prompt_key FROM req WHERE lang = 'en'),
rk AS (SELECT req.*, sha256(prompt) AS prompt_key, sha256(prompt) IN (SELECT prompt_key FROM kc) AS hit FROM req)
"""


@register("request_batches", with_views("""
SELECT uid, CAST(doc_id // 20 AS BIGINT) AS batch_no, CAST(doc_id % 20 AS INTEGER) AS pos_in_batch FROM r0
"""))
def request_batches(spark, sf_dir):
    """Batches of 20 requests in input order."""
    return C.batches(round0(spark, sf_dir), "doc_id").select("uid", "batch_no", "pos_in_batch")


@register("response_cache_split", with_views(_REQ_SQL + """
SELECT count(*) AS requests, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
       count(DISTINCT prompt_key) FILTER (WHERE NOT hit) AS distinct_misses
FROM rk
"""))
def response_cache_split(spark, sf_dir):
    """Requests split into cache hits and (deduplicated) misses."""
    keyed = _requests(spark, sf_dir).withColumn("prompt_key", F.sha2("prompt", 256))
    hits, misses = C.split_hits(keyed, _known_cache(spark, sf_dir), "prompt_key")
    tagged = hits.select("prompt_key", F.lit(True).alias("hit")).unionByName(
        misses.select("prompt_key", F.lit(False).alias("hit")))
    return tagged.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"),
                      F.count_if(~F.col("hit")).alias("misses"),
                      F.count_distinct(F.when(~F.col("hit"), F.col("prompt_key"))).alias("distinct_misses"))


@register("answer_with_cache", with_views(_REQ_SQL + """
, h AS (SELECT uid, prompt_key, prompt, CAST(concat('0x', substr(sha256(prompt), 1, 8)) AS BIGINT) AS h FROM rk),
a AS (SELECT *, h % 2 AS label, 40 + (h // 256) % 61 AS conf FROM h)
SELECT uid, prompt_key, false AS cache_hit, CAST(ceil(length(prompt) / 4.0) AS BIGINT) AS input_tokens,
       CAST(ceil(length('{"analysis": "offline checksum answer", "annotation": "' || label || '", "confidence": ' || conf
            || ', "new_edge_case": ' || CASE WHEN conf <= 75 THEN 'true' ELSE 'false' END || ', "new_edge_case_rule": "'
            || CASE WHEN conf <= 75 THEN 'When the text is short and unclear -> classify as 0' ELSE 'EMPTY' END || '"}') / 4.0)
            AS BIGINT) AS output_tokens, true AS answered
FROM a
"""))
def answer_with_cache(spark, sf_dir):
    """J2 end to end: every request misses the new cache and is answered by the offline annotator."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "response_cache")
    req = _requests(spark, sf_dir).select("uid", "prompt")
    ans = C.respond_with_cache(req, path, "annotator", C.offline_annotator())
    return ans.select("uid", "prompt_key", "cache_hit", "input_tokens", "output_tokens",
                      F.col("response").isNotNull().alias("answered"))


@register("run_cost", with_views(_REQ_SQL + """
, calls AS (SELECT DISTINCT prompt_key, CASE WHEN new_edge_case THEN 'synthesizer' ELSE 'annotator' END AS model,
                   CAST(ceil(length(prompt) / 4.0) AS BIGINT) AS input_tokens,
                   CAST(60 + length(text_to_annotate) // 100 AS BIGINT) AS output_tokens
            FROM rk WHERE NOT hit),
pr AS (SELECT * FROM (VALUES ('annotator', 2.0, 8.0), ('synthesizer', 0.55, 2.19)) p(model, i, o)),
s AS (SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
             CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM calls GROUP BY model)
SELECT s.model, calls, input_tokens, output_tokens,
       round(input_tokens / 1e6 * CAST(i AS DOUBLE) + output_tokens / 1e6 * CAST(o AS DOUBLE), 6) AS cost_usd
FROM s LEFT JOIN pr ON s.model = pr.model
"""))
def run_cost(spark, sf_dir):
    """Tokens and cost per model over the computed (missed) calls."""
    keyed = _requests(spark, sf_dir).withColumn("prompt_key", F.sha2("prompt", 256))
    _, misses = C.split_hits(keyed, _known_cache(spark, sf_dir), "prompt_key")
    calls = misses.select(
        "prompt_key",
        F.when(F.col("new_edge_case"), "synthesizer").otherwise("annotator").alias("model"),
        F.ceil(F.length("prompt") / 4.0).cast("bigint").alias("input_tokens"),
        (60 + F.floor(F.length("text_to_annotate") / 100)).cast("bigint").alias("output_tokens"),
        F.lit(False).alias("cache_hit")).distinct()
    prices = spark.createDataFrame([("annotator", 2.0, 8.0), ("synthesizer", 0.55, 2.19)],
                                   "model string, input_usd_per_mtok double, output_usd_per_mtok double")
    return C.run_cost(calls, prices)


@register("embedding_cache", with_views("""
SELECT item_id, 64 AS dims, CAST(NULL AS VARCHAR) AS embed_error FROM benchmark
"""))
def embedding_cache(spark, sf_dir):
    """J3 + M1: benchmark passages embedded once (offline hashing embedder) through the cache."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "embedding_cache")
    b = table(spark, sf_dir, "benchmark")
    out = C.embed_with_cache(b, path, "hashing-64", C.hashing_embedder(64))
    return out.select("item_id", F.size("embedding").alias("dims"), "embed_error")


# --- J7 / U2 -------------------------------------------------------------------------

def _new_rows(spark, sf_dir):
    """The increment: round-1 rows of French texts (uid match), of the id-less
    source (text match) and the benchmark passages (appended)."""
    r1 = round1(spark, sf_dir)
    return r1.where((F.col("lang") == "fr") | (F.col("source").isin("src3", "benchmark"))).select(
        "uid", "doc_id", "text_to_annotate", "annotation", "confidence", "new_edge_case",
        F.when(F.col("doc_id").isNotNull(), (F.col("doc_id") % 10) / 10.0).alias("pca_x"),
        F.lit(None).cast("double").alias("pca_y"))


_NEW_SQL = """
, nw AS (SELECT uid, doc_id, text_to_annotate, annotation, confidence, new_edge_case,
                CASE WHEN doc_id IS NOT NULL THEN (doc_id % 10) / 10.0 END AS pca_x, CAST(NULL AS DOUBLE) AS pca_y
         FROM r1 WHERE lang = 'fr' OR source IN ('src3', 'benchmark')),
bt AS (SELECT DISTINCT text_to_annotate FROM nw
       WHERE uid IS NULL OR uid NOT IN (SELECT uid FROM r0 WHERE uid IS NOT NULL))
"""


@register("upsert_relabelled", with_views(_NEW_SQL + """
, un AS (SELECT * FROM r0 WHERE uid IS NULL OR uid NOT IN (SELECT uid FROM nw WHERE uid IS NOT NULL)),
rp AS (SELECT text_to_annotate AS t, min(uid) AS u FROM un
       WHERE text_to_annotate IN (SELECT text_to_annotate FROM bt) GROUP BY 1)
SELECT uid, doc_id, confidence, false AS is_reannotated FROM un LEFT JOIN rp ON t = text_to_annotate
WHERE t IS NULL OR uid IS DISTINCT FROM u
UNION ALL
SELECT uid, doc_id, confidence, true FROM nw
"""))
def upsert_relabelled(spark, sf_dir):
    """Re-labelled rows replace their match (uid, else text); the rest are appended."""
    out = G.upsert_relabelled(round0(spark, sf_dir).drop("is_reannotated"), _new_rows(spark, sf_dir))
    return out.select("uid", "doc_id", "confidence", "is_reannotated")


@register("update_edge_cases", with_views(_NEW_SQL + """
, nu AS (SELECT * FROM (SELECT uid, confidence, pca_x, pca_y,
           row_number() OVER (PARTITION BY uid ORDER BY confidence NULLS FIRST, annotation NULLS FIRST,
                              pca_x NULLS FIRST, pca_y NULLS FIRST) AS rn FROM nw WHERE uid IS NOT NULL) WHERE rn = 1),
nt AS (SELECT * FROM (SELECT text_to_annotate, confidence, pca_x, pca_y,
           row_number() OVER (PARTITION BY text_to_annotate ORDER BY confidence NULLS FIRST, annotation NULLS FIRST,
                              pca_x NULLS FIRST, pca_y NULLS FIRST) AS rn FROM nw) WHERE rn = 1)
SELECT e.uid,
       CASE WHEN nu.rn IS NOT NULL THEN nu.confidence WHEN nt.rn IS NOT NULL THEN nt.confidence
            ELSE e.confidence END AS confidence,
       coalesce(CASE WHEN nu.rn IS NOT NULL THEN nu.pca_x WHEN nt.rn IS NOT NULL THEN nt.pca_x END, e.pca_x) AS pca_x,
       coalesce(CASE WHEN nu.rn IS NOT NULL THEN nu.pca_y WHEN nt.rn IS NOT NULL THEN nt.pca_y END, e.pca_y) AS pca_y,
       (nu.rn IS NOT NULL OR nt.rn IS NOT NULL) AS updated
FROM ec e LEFT JOIN nu ON e.uid = nu.uid LEFT JOIN nt ON e.text_to_annotate = nt.text_to_annotate
"""))
def update_edge_cases(spark, sf_dir):
    """Matched edge cases take new values; coordinates only when present."""
    out = G.update_edge_cases(edge_cases(spark, sf_dir), _new_rows(spark, sf_dir))
    return out.select("uid", "confidence", "pca_x", "pca_y", "updated")


@register("append_examples", with_views("""
SELECT uid, annotation, confidence, new_edge_case FROM r0
UNION ALL
SELECT concat('m', CAST(item_id AS VARCHAR)), '0', 50.0::DOUBLE, false FROM benchmark
"""))
def append_examples(spark, sf_dir):
    """Manually added examples appended with default values."""
    added = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("uid"), F.col("text").alias("text_to_annotate"))
    out = G.append_examples(round0(spark, sf_dir), added)
    return out.select("uid", "annotation", "confidence", "new_edge_case")


# --- saved rules (J12, J13, A9, W4) ---------------------------------------------------------

def _saved0(spark, sf_dir):
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    src = table(spark, sf_dir, "documents").select("source").distinct()
    return src.select(F.lit(TASK_ID).alias("task_id"), n.alias("cluster_no"), F.concat(
        F.lit("When text comes from "), F.col("source"), F.when(n % 2 == 0, " -> review by hand").otherwise(" -> keep")).alias("rule"))


_SAVED_SQL = r"""
, src AS (SELECT DISTINCT source, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS n FROM documents),
saved0 AS (SELECT 'docs' AS task_id, n AS cluster_no,
                  'When text comes from ' || source || CASE WHEN n % 2 = 0 THEN ' -> review by hand' ELSE ' -> keep' END AS rule
           FROM src)
"""


@register("save_rules", with_views(_SAVED_SQL + r"""
, prop AS (SELECT 'docs' AS task_id, CAST(n // 2 AS INTEGER) AS cluster_no,
                  ' When text comes from ' || source || ' -> review by hand ' AS rule FROM src),
cand AS (SELECT task_id, cluster_no, min(rule) AS rule FROM (
           SELECT task_id, arg_min(cluster_no, cluster_no) AS cluster_no, arg_min(rule, cluster_no) AS rule
           FROM prop WHERE regexp_replace(rule, '^\s+|\s+$', '', 'g') NOT IN (SELECT rule FROM saved0)
           GROUP BY task_id, regexp_replace(rule, '^\s+|\s+$', '', 'g')) GROUP BY task_id, cluster_no)
SELECT * FROM saved0 WHERE cluster_no NOT IN (SELECT cluster_no FROM cand)
UNION ALL SELECT * FROM cand
"""))
def save_rules(spark, sf_dir):
    """Proposals saved unless equal (trimmed) to a saved rule; replace by number."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    src = table(spark, sf_dir, "documents").select("source").distinct()
    prop = src.select(F.lit(TASK_ID).alias("task_id"), F.floor(n / 2).cast("int").alias("cluster_no"),
                      F.concat(F.lit(" When text comes from "), F.col("source"), F.lit(" -> review by hand "))
                      .alias("rule"))
    return G.save_rules(_saved0(spark, sf_dir), prop)


@register("edit_rules", with_views(_SAVED_SQL + """
SELECT task_id, cluster_no, CASE WHEN cluster_no % 3 = 1 THEN rule || ' (edited)' ELSE rule END AS rule
FROM saved0 WHERE cluster_no % 3 <> 0
"""))
def edit_rules(spark, sf_dir):
    """Edits and removals applied to the saved rules."""
    s = _saved0(spark, sf_dir)
    ch = s.select("task_id", "cluster_no",
                  F.when(F.col("cluster_no") % 3 == 0, "remove").otherwise("edit").alias("op"),
                  F.concat("rule", F.lit(" (edited)")).alias("rule"), F.lit(2).alias("seq"))
    first = s.select("task_id", "cluster_no", F.lit("edit").alias("op"), F.col("rule"), F.lit(1).alias("seq"))
    changes = ch.where(F.col("cluster_no") % 3 != 2).unionByName(first)
    return G.edit_rules(s, changes)


@register("save_all_rules", with_views(r"""
, s AS (SELECT DISTINCT 'docs' AS task_id, concat('edge_case_', regexp_extract(source, '(\d+)$', 1)) AS k,
               'When text comes from ' || source || ' -> review by hand' AS rule FROM documents)
SELECT task_id, CAST(regexp_extract(k, 'edge_case_(\d+)', 1) AS INTEGER) AS cluster_no, max(rule) AS rule
FROM s GROUP BY 1, 2
"""))
def save_all_rules(spark, sf_dir):
    """J13 save-all: the saved set replaced by all suggestions, keyed by number."""
    from rulesift.plans.fixtures import suggestions
    s = suggestions(spark, sf_dir).withColumn("task_id", F.lit(TASK_ID))
    return G.save_all_rules(s)


@register("complete_guideline", with_views(_TG_SQL + r"""
, sv AS (SELECT task_id, label, CAST(dense_rank() OVER (PARTITION BY task_id ORDER BY label) * 10 AS INTEGER) AS cluster_no,
                'When a ' || label || ' text is unclear -> label it -1' AS rule FROM tl)
SELECT g.task_id, regexp_replace(g.guideline, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Edge Case Handling:' || chr(10)
       || string_agg(CAST(rn AS VARCHAR) || '. ' || rule, chr(10) ORDER BY rn) AS guideline
FROM tg1 g JOIN (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY cluster_no, rule) AS rn FROM sv) s
  ON g.task_id = s.task_id
GROUP BY g.task_id, g.guideline
"""))
def complete_guideline_q(spark, sf_dir):
    """Guideline + numbered saved rules (ascending cluster number)."""
    g = task_guidelines(spark, sf_dir).where("version = 1").select("task_id", "guideline")
    tl = table(spark, sf_dir, "documents").select(F.col("source").alias("task_id"), F.col("lang").alias("label")).distinct()
    # One window per task over its few distinct languages.
    sv = tl.select("task_id", (F.dense_rank().over(Window.partitionBy("task_id").orderBy("label")) * 10)
                   .cast("int").alias("cluster_no"),
                   F.concat(F.lit("When a "), F.col("label"), F.lit(" text is unclear -> label it -1")).alias("rule"))
    return complete_guideline(g, sv)


@register("first_per_rule", with_views("""
SELECT edge_case_id, uid, guideline_improvement FROM (
  SELECT *, row_number() OVER (PARTITION BY edge_case_id ORDER BY uid) AS rn FROM ec WHERE edge_case_id IS NOT NULL)
WHERE rn = 1
"""))
def first_per_rule(spark, sf_dir):
    """First row per rule id (lowest uid); rows without an id dropped."""
    e = edge_cases(spark, sf_dir).select("edge_case_id", "uid", "guideline_improvement")
    return G.first_per_rule(e)


# --- S8 / S9 / U3 ----------------------------------------------------------------------------

@register("latest_snapshot", with_views("""
SELECT user_id, event_id, ts, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
"""))
def latest_snapshot(spark, sf_dir):
    """Latest saved snapshot per user (events stand for snapshots)."""
    ev = table(spark, sf_dir, "events")
    return G.latest(ev, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "ts", "event_type", "value", "props")


@register("merge_sections", with_views("""
SELECT user_id, event_type, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE props IS NOT NULL) WHERE rn = 1
"""))
def merge_sections(spark, sf_dir):
    """Partial saves merged: latest non-null value per user and section."""
    return G.merge_sections(table(spark, sf_dir, "events"), ["user_id"], "event_type", "props", ["ts", "event_id"])


@register("append_round", with_views("""
SELECT round, count(*) AS rows, count(*) FILTER (WHERE new_edge_case) AS edge_rows FROM hist GROUP BY round
"""))
def append_round(spark, sf_dir):
    """U3 + S4: round 0 written, round 1 appended as a new partition, read back."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "rounds_table")
    cols = ["task_id", "round", "uid", "confidence", "new_edge_case"]
    K.write_round(round0(spark, sf_dir).select(cols), path)
    K.write_round(round1(spark, sf_dir).select(cols), path)
    t = spark.read.parquet(path)
    return t.groupBy("round").agg(F.count(F.lit(1)).alias("rows"), F.count_if("new_edge_case").alias("edge_rows"))


# --- A13 / S5-S7 ----------------------------------------------------------------------------

@register("export_metadata", with_views("""
SELECT 'docs' AS task_id, 1 AS round,
       (SELECT count(*) FROM r1) AS annotations, (SELECT count(*) FROM ec) AS edge_cases,
       (SELECT count(*) FROM sugg) AS rules, (SELECT count(*) FROM r0) AS previous_annotations
"""))
def export_metadata(spark, sf_dir):
    """One metadata row of section counts for an export."""
    from rulesift.plans.fixtures import suggestions
    return K.export_metadata(TASK_ID, 1, annotations=round1(spark, sf_dir), edge_cases=edge_cases(spark, sf_dir),
                             rules=suggestions(spark, sf_dir), previous_annotations=round0(spark, sf_dir))


@register("export_bundle", with_views("""
SELECT 'docs' AS task_id, 1 AS round,
       (SELECT count(*) FROM r1) AS annotations, (SELECT count(*) FROM ec) AS edge_cases,
       (SELECT count(*) FROM sugg) AS rules, (SELECT count(*) FROM r0) AS previous_annotations
"""))
def export_bundle(spark, sf_dir):
    """S5 + S6 + S7: sections written as folders (NaN cleaned), JSON snapshot,
    guideline text; returns the metadata row read back."""
    from rulesift.plans.fixtures import suggestions
    ensure_checkpoint_dir(spark)
    base = shared_path(spark, "export")
    pts = points(spark, sf_dir)
    K.write_snapshot(pts.select("uid", "pca_x", "pca_y", "confidence"), base + "/json")
    K.write_guideline(task_guidelines(spark, sf_dir).where("version = 1"), base + "/guideline")
    return K.export_bundle(base + "/bundle", TASK_ID, 1, annotations=round1(spark, sf_dir),
                           edge_cases=edge_cases(spark, sf_dir), rules=suggestions(spark, sf_dir),
                           previous_annotations=round0(spark, sf_dir))
