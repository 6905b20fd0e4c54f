"""State that outlives a run: keyed store (J2, J3), guideline history (U3), template versions (F3), merges by the model
(J9, F8), the stream's registry and edge cases (T1, J1, J7), order and links of rounds (A6, J6)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rulesift.functions.text import text_key
from rulesift.operators import cache as C
from rulesift.operators import history as H
from rulesift.operators import rounds as R
from rulesift.operators import templates as TP
from rulesift.operators.keyed_store import KeyedStore, distinct_keys, one_row
from rulesift.operators.merge_blocks import merge_by_model
from rulesift.operators.ranking import global_row_number
from rulesift.operators.search_index import SearchIndex, build
from rulesift.operators.stored_pages import StoredPages, write_pages
from rulesift.plans import jobs as J
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import GUIDELINE, TASK_ID, edge_cases, points, round0, round1, with_views
from rulesift.plans.ingest_queries import _TG, _sql_lit, task_guidelines
from rulesift.plans.jobs_queries import _HEAD, _MIDDLE, _TAIL, _examples, _guidelines, _labels_sql, _quoted
from rulesift.schema import RESPONSE_CACHE
from rulesift.session import shared_path, table
from rulesift.sources import sinks as K2

# --- J2 / J3: keyed store -----------------------------------------------------------


@register("keyed_store_lookup", """
SELECT sha256(concat('doc ', doc_id)) AS prompt_key,
       CASE WHEN doc_id % 14 = 0 THEN concat('second answer ', doc_id) WHEN doc_id % 7 <> 0 THEN concat('answer ', doc_id) END AS response,
       CASE WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN 'failed' END AS error
FROM documents
""")
def keyed_store_lookup(spark, sf_dir):
    """J2 + J3: answers appended and folded into a sorted run, failed ones partly answered by a later batch; every document's key
    and keys that were never stored (benchmark) are looked up."""
    def answers(docs, text, failed):
        return docs.select(F.lit("m").alias("model"), F.sha2(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), 256).alias("prompt_key"),
                           F.when(~failed, F.concat(F.lit(text), F.col("doc_id").cast("string"))).alias("response"), F.lit(None).cast("string").alias("response_reasoning"),
                           F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.when(failed, "failed").alias("error"))

    docs = table(spark, sf_dir, "documents").select("doc_id")
    store = KeyedStore(spark, shared_path(spark, "keyed_store"), RESPONSE_CACHE, "prompt_key", "m")
    store.append(answers(docs, "answer ", F.col("doc_id") % 7 == 0))
    store.fold(1)
    store.append(answers(docs.where(F.col("doc_id") % 14 == 0), "second answer ", F.lit(False)))
    unknown = table(spark, sf_dir, "benchmark").select(F.sha2(F.concat(F.lit("item "), F.col("item_id").cast("string")), 256).alias("prompt_key"))
    keys = distinct_keys(answers(docs, "", F.lit(False)).select("prompt_key").union(unknown), "prompt_key")
    return one_row(store.lookup(keys), "prompt_key", RESPONSE_CACHE).select("prompt_key", "response", "error")


# --- U3: guideline history ----------------------------------------------------------

def _source_number(c="source"):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def _history(spark, sf_dir):
    """Four saves of every source's guideline: version 1, version 2, version 2 again (no change), version 1 again."""
    g = task_guidelines(spark, sf_dir)
    path = shared_path(spark, "guideline_history")
    for version, after in ((1, 0), (2, 40), (2, 60), (1, 80)):
        H.record(g.where(F.col("version") == version).select("task_id", "guideline"), path, _source_number("task_id") + after)
    return H.read_history(spark, path)


_HISTORY_SQL = _TG + r"""
, gh AS (SELECT task_id, CAST(v.n AS INTEGER) AS version, CAST(CAST(regexp_extract(task_id, '(\d+)$', 1) AS INTEGER) + v.after AS INTEGER) AS valid_from,
                sha256(guideline) AS digest
         FROM tg JOIN (VALUES (1, 1, 0), (2, 2, 40), (3, 1, 80)) v(n, version, after) ON v.version = tg.version)
"""


@register("guideline_history", with_views(_HISTORY_SQL + """
SELECT task_id, version, valid_from, CAST(lead(valid_from) OVER (PARTITION BY task_id ORDER BY valid_from) AS INTEGER) AS valid_to, digest FROM gh
"""))
def guideline_history(spark, sf_dir):
    """The intervals in which each source's guideline versions were in force."""
    return H.intervals(_history(spark, sf_dir))


@register("guideline_as_of", with_views(_HISTORY_SQL + """
, a AS (SELECT doc_id, source, CAST((doc_id * 37) % 131 AS INTEGER) AS answered_at FROM documents)
SELECT a.doc_id, a.answered_at, gh.version AS guideline_version, gh.digest AS guideline_digest
FROM a ASOF LEFT JOIN gh ON a.source = gh.task_id AND a.answered_at >= gh.valid_from
"""))
def guideline_as_of(spark, sf_dir):
    """The guideline version that was in force for each document's answer."""
    answers = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task_id"), ((F.col("doc_id") * 37) % 131).cast("int").alias("answered_at"))
    return H.as_of(answers, _history(spark, sf_dir), "answered_at").drop("task_id")


# --- F3: template versions ----------------------------------------------------------

_PLAIN = "Label by {{the}} guideline.\n{guideline}\nText: {text}\n"
_WITH_RULES = "Label by {{the}} guideline and its rules.\n{guideline}\nRules: {rules}\nText: {text}\n"
_RULES, _MORE_RULES = "1. When unclear -> -1", "1. When unclear -> -1 2. When {text} is empty -> 0"
#: version, template, rules of sources with an even and an odd number
_VERSIONS = [(1, _PLAIN, "", ""), (2, _PLAIN, _RULES, _RULES), (3, _WITH_RULES, _RULES, _RULES), (4, _WITH_RULES, _MORE_RULES, _RULES), (5, _PLAIN, "", "")]


def _versions(spark, sf_dir):
    steps = spark.createDataFrame(_VERSIONS, "version int, template string, even string, odd string")
    g = task_guidelines(spark, sf_dir).where("version = 1").select("task_id", "guideline", F.explode(F.sequence(F.lit(1), F.lit(len(_VERSIONS)))).alias("version"))
    return g.join(F.broadcast(steps), "version").select(  # five rows
        "version", "task_id", "template", "guideline", F.when(_source_number("task_id") % 2 == 0, F.col("even")).otherwise(F.col("odd")).alias("rules"))


def _versioned_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("task_id"), "doc_id", F.col("text").alias("text_to_annotate"), (1 + F.col("doc_id") % 3).cast("int").alias("since"))


_VERSION_VALUES = ", ".join(f"({v}, {_sql_lit(t)}, {_sql_lit(e)}, {_sql_lit(o)})" for v, t, e, o in _VERSIONS)
_VERSIONS_SQL = rf"""
, tv AS (SELECT v.version, task_id, v.template, guideline,
                CASE WHEN CAST(regexp_extract(task_id, '(\d+)$', 1) AS INTEGER) % 2 = 0 THEN v.even ELSE v.odd END AS rules
         FROM tg1, (VALUES {_VERSION_VALUES}) v(version, template, even, odd)),
td AS (SELECT version, task_id, concat(template, '/', CASE WHEN contains(template, '{{rules}}') THEN rules ELSE '' END) AS made FROM tv),
vr AS (SELECT source AS task_id, doc_id, text, 1 + doc_id % 3 AS since FROM documents)
"""


@register("reasked_rows", with_views(_TG + _VERSIONS_SQL + """
SELECT a.version, a.task_id, count(*) AS rows, CAST(count(*) FILTER (WHERE NOT EXISTS (
         SELECT 1 FROM td b WHERE b.task_id = a.task_id AND b.version < a.version AND b.version >= vr.since AND b.made = a.made)) AS BIGINT) AS reasked
FROM td a JOIN vr ON vr.task_id = a.task_id AND a.version >= vr.since GROUP BY a.version, a.task_id
"""))
def reasked_rows(spark, sf_dir):
    """rows that each of five versions asks again: a template without rules, rules it does not show, a template with rules, changed rules
    of half the sources, and the first template again; documents arrive with the first three versions."""
    return TP.plan_versions(_versioned_rows(spark, sf_dir), _versions(spark, sf_dir))


@register("ask_versions", with_views(_TG + _VERSIONS_SQL + """
, ask AS (SELECT vr.task_id, vr.text, td.made, min(td.version) AS version FROM vr JOIN td ON td.task_id = vr.task_id AND td.version >= vr.since GROUP BY 1, 2, 3)
SELECT CAST(version AS INTEGER) AS version, count(*) AS asked FROM ask GROUP BY version
"""))
def ask_versions(spark, sf_dir):
    """F3 + J2: the same versions asked one after another through the cache; distinct prompts that each had to ask."""
    path, out = shared_path(spark, "version_cache"), None
    versions, rows = _versions(spark, sf_dir).checkpoint(), _versioned_rows(spark, sf_dir)
    for v, *_ in _VERSIONS:
        got = TP.ask_version(rows.where(F.col("since") <= v), versions, v, path, "annotator", C.offline_annotator(), keep=["doc_id"])
        part = got.where("not cache_hit").select(F.lit(v).alias("version"), "prompt_key").distinct()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("version").agg(F.count("*").alias("asked"))


# --- J9 / F8: merging by the model's answers ----------------------------------------

def _by_class(prompt: str) -> str:
    """Stands for a model that wants one rule for each language and class, wherever the texts come from."""
    sets: dict[tuple, list[str]] = {}
    for n, lang, label in re.findall(r"^(\d+)\. When text in (\S+)(?: comes from \S+)? -> classify as (\S+)$", prompt, re.M):
        sets.setdefault((lang, label), []).append(n)
    return "\n".join(f"Merge [{', '.join(n)}]: When text in {lang} -> classify as {label}" for (lang, label), n in sets.items() if len(n) > 1) or "NO MERGE"


@register("merge_blocks", with_views(r"""
, p AS (SELECT DISTINCT guideline_improvement AS rule FROM r0 WHERE guideline_improvement <> 'EMPTY'),
n AS (SELECT row_number() OVER (ORDER BY rule) AS rule_no, rule, regexp_extract(rule, 'in (\S+)', 1) AS lang, regexp_extract(rule, 'as (\S+)$', 1) AS label FROM p)
SELECT rule_no, min(rule_no) OVER (PARTITION BY lang, label) AS component,
       CASE WHEN count(*) OVER (PARTITION BY lang, label) > 1 THEN concat('When text in ', lang, ' -> classify as ', label) ELSE rule END AS merged_rule
FROM n
"""))
def merge_blocks(spark, sf_dir):
    """J9 + F8: round 0's distinct rules merged by a model that sees blocks of at most twenty; answers of several passes united."""
    rules = round0(spark, sf_dir).where("guideline_improvement <> 'EMPTY'").select(F.col("guideline_improvement").alias("rule")).distinct()
    return merge_by_model(global_row_number(rules, ["rule"], "rule_no").select("rule_no", "rule"), _by_class, limit=20, cache_path=shared_path(spark, "merge_cache"))


# --- T1 / J1 / J7: registry and edge cases of the stream -----------------------------

def _imported_ids(spark, sf_dir):
    """Ids that came with the English documents: a registry from before."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit(TASK_ID).alias("task_id"), F.col("text").alias("text_to_annotate"), "doc_id")
    from rulesift.functions.text import clean_text
    d = d.withColumn("text_to_annotate", clean_text("text_to_annotate")).where("length(text_to_annotate) > 0")
    return d.groupBy("task_id", text_key("text_to_annotate").alias("text_key"), "text_to_annotate").agg(
        F.concat(F.lit("doc-"), F.min("doc_id").cast("string")).alias("uid"))


def _arrivals(spark, sf_dir):
    """What arrives: all documents once more and the benchmark passages."""
    docs = table(spark, sf_dir, "documents").select(F.lit(TASK_ID).alias("task_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    return docs.unionByName(table(spark, sf_dir, "benchmark").select(
        F.lit(TASK_ID).alias("task_id"), (F.col("item_id") + (1 << 40)).alias("ordinal"), F.col("text").alias("text_to_annotate")))


def _fitted(spark, sf_dir):
    work = shared_path(spark, "work")
    ann = J.annotate_round(_examples(spark, sf_dir), _guidelines(spark), TASK_ID, 0, work, J.offline_plugins(), registry=_imported_ids(spark, sf_dir))
    return work, ann


def _state_sql() -> str:
    return _labels_sql("nl", "SELECT text AS t FROM documents UNION ALL SELECT text FROM benchmark") + r"""
, ct AS (SELECT regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t, doc_id, lang
         FROM (SELECT text, doc_id, lang FROM documents UNION ALL SELECT text, NULL, NULL FROM benchmark)),
rg AS (SELECT t, substr(sha256(concat('docs', chr(31), t)), 1, 32) AS made, min(doc_id) FILTER (WHERE lang = 'en') AS d FROM ct WHERE length(t) > 0 GROUP BY t),
ri AS (SELECT t, made, CASE WHEN d IS NOT NULL THEN concat('doc-', d) ELSE made END AS uid FROM rg),
ne AS (SELECT ri.uid, ri.t, nl.annotation, nl.confidence FROM ri JOIN nl ON nl.uid = ri.made)
SELECT 'registry' AS kind, uid, CAST(NULL AS VARCHAR) AS annotation, CAST(NULL AS DOUBLE) AS confidence, true AS updated FROM ri
UNION ALL
SELECT 'edge', e.uid, coalesce(ne.annotation, e.annotation), coalesce(ne.confidence, e.confidence), ne.uid IS NOT NULL
FROM ec e LEFT JOIN ne ON ne.t = e.text_to_annotate
"""


def _state(tables):
    return (tables.registry.select(F.lit("registry").alias("kind"), "uid", F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("double").alias("confidence"),
                                   F.lit(True).alias("updated"))
            .unionByName(tables.edge_cases.select(F.lit("edge").alias("kind"), "uid", "annotation", "confidence", "updated")))


@register("stream_state", with_views(_state_sql()))
def stream_state(spark, sf_dir):
    """Registry and edge cases after all documents and the benchmark passages arrived in three micro-batches; texts with
    imported ids keep them."""
    from rulesift.streaming.increment import current_tables, start
    work, ann = _fitted(spark, sf_dir)
    inp, out = shared_path(spark, "stream_in"), shared_path(spark, "stream_out")
    _arrivals(spark, sf_dir).repartition(3, "ordinal").write.parquet(inp)
    q = start(spark, inp, out, shared_path(spark, "stream_ckpt"), ann, _guidelines(spark), TASK_ID, 0, work, J.offline_plugins(),
              registry=_imported_ids(spark, sf_dir), max_files_per_trigger=1)
    q.awaitTermination()
    return _state(current_tables(spark, ann, out, TASK_ID, edge_cases(spark, sf_dir)))


@register("increment_state", with_views(_state_sql()))
def increment_state(spark, sf_dir):
    """B3 + J1: registry and edge cases after the same examples came in one batch."""
    work, ann = _fitted(spark, sf_dir)
    path = shared_path(spark, "registry")
    J.registry_of(spark, path, TASK_ID).append(_imported_ids(spark, sf_dir))
    made = J.annotate_increment(_arrivals(spark, sf_dir), ann, _guidelines(spark), TASK_ID, 0, work, J.offline_plugins(),
                                edge_cases=edge_cases(spark, sf_dir), registry_path=path)
    return _state(J.Increment(made.annotations, made.edge_cases, J.registry_of(spark, path, TASK_ID).rows()))


# --- A6 / J6 --------------------------------------------------------------------------

@register("round_order", with_views("""
SELECT x.name, true AS same_ids, x.name <> 'swapped' AS same_order FROM (VALUES ('again'), ('later'), ('swapped')) x(name), (SELECT count(*) AS n FROM r0) WHERE n > 1
"""))
def round_order(spark, sf_dir):
    """Round 0 against itself, against itself at later positions, and with neighbouring rows swapped."""
    r0 = round0(spark, sf_dir).select("uid", F.col("doc_id").alias("ordinal"))
    others = {"again": r0, "later": r0.withColumn("ordinal", F.col("ordinal") + 7), "swapped": r0.withColumn("ordinal", F.col("ordinal").bitwiseXOR(F.lit(1).cast("long")))}
    out = None
    for name, other in others.items():
        part = R.round_counts(r0, other, order="ordinal").select(F.lit(name).alias("name"), "same_ids", "same_order")
        out = part if out is None else out.unionByName(part)
    return out


@register("point_links", with_views("""
, a AS (SELECT uid, text_to_annotate AS t, row_number() OVER (PARTITION BY text_to_annotate ORDER BY uid IS NULL, uid) AS k
        FROM r1 WHERE uid IS NULL OR uid NOT IN (SELECT uid FROM ec)),
b AS (SELECT uid, text_to_annotate AS t, row_number() OVER (PARTITION BY text_to_annotate ORDER BY uid) AS k
      FROM ec WHERE uid NOT IN (SELECT uid FROM r1 WHERE uid IS NOT NULL))
SELECT r1.uid, ec.uid AS target_uid, 'uid' AS way FROM r1 JOIN ec ON r1.uid = ec.uid
UNION ALL SELECT a.uid, b.uid, 'text' FROM a JOIN b ON a.t = b.t AND a.k = b.k
"""))
def point_links(spark, sf_dir):
    """Which edge case each row of round 1 stands for, by id, else copy by copy of its text."""
    return R.point_links(round1(spark, sf_dir), edge_cases(spark, sf_dir))


# --- M5 / M8: stored rule clusters ------------------------------------------------------

@register("stored_rule_clusters", """
WITH n AS (SELECT count(*) FILTER (WHERE vec_id % 5 <> 0) AS old, count(*) FILTER (WHERE vec_id % 5 = 0) AS new FROM embeddings WHERE embedding IS NOT NULL)
SELECT old AS stored_rules, new AS new_rules, old + new AS clustered_rules, true AS within_limits, CAST(0 AS BIGINT) AS moved_without_refit FROM n
""")
def stored_rule_clusters(spark, sf_dir):
    """M5 + M8: four fifths of the vectors clustered and stored, the others join these clusters; sizes stay within the limits, and no stored
    rule moves whose cluster was not clustered anew."""
    from rulesift.operators.balance import balanced_clusters
    from rulesift.operators.stored_cells import assign_new_rules
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("uid"), "embedding", (F.col("vec_id") % 5 != 0).alias("old"))
    old, new = e.where("old").drop("old"), e.where("not old").drop("old")
    before = balanced_clusters(old).join(old, "uid").checkpoint()
    after = assign_new_rules(before, new)
    sizes = after.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.min(F.col("n").between(10, 20)), F.lit(True)).alias("within_limits"))
    moved = (before.select("uid", F.col("cluster_id").alias("was")).join(after, "uid").agg(
        F.count("*").alias("stored_rules"), F.count_if((F.col("was") != F.col("cluster_id")) & (F.col("how") != "refit")).alias("moved_without_refit")))
    counts = after.join(before.select("uid", F.lit(1).alias("_o")), "uid", "left").agg(F.count_if(F.col("_o").isNull()).alias("new_rules"), F.count("*").alias("clustered_rules"))
    from rulesift.plans.invariant_queries import one_row_of
    return (one_row_of(moved, counts, sizes)
            .select("stored_rules", "new_rules", "clustered_rules", "within_limits", "moved_without_refit"))


# --- S5-S7: what was exported, read back --------------------------------------------------

def _bundle(spark, sf_dir):
    from rulesift.plans.fixtures import suggestions
    from rulesift.plans.store_queries import _saved0
    path = shared_path(spark, "bundle")
    g = task_guidelines(spark, sf_dir)
    K2.export_bundle(path, TASK_ID, 1, annotations=points(spark, sf_dir).drop("doc_id"), edge_cases=edge_cases(spark, sf_dir).drop("doc_id"),
                     rules=suggestions(spark, sf_dir), previous_annotations=round0(spark, sf_dir), guideline=g.where("version = 2").drop("version"),
                     saved_rules=_saved0(spark, sf_dir), history=g)
    return path


_BUNDLE_SQL = _TG + r"""
, src AS (SELECT count(DISTINCT source) AS n FROM documents)
"""


@register("export_manifest", with_views(_BUNDLE_SQL + """
SELECT section, rows, rows AS found_rows, true AS intact FROM (
  SELECT 'annotations' AS section, (SELECT count(*) FROM r0) AS rows UNION ALL SELECT 'edge_cases', (SELECT count(*) FROM ec)
  UNION ALL SELECT 'rules', (SELECT count(*) FROM sugg) UNION ALL SELECT 'previous_annotations', (SELECT count(*) FROM r0)
  UNION ALL SELECT 'guideline', (SELECT n FROM src) UNION ALL SELECT 'saved_rules', (SELECT n FROM src) UNION ALL SELECT 'history', (SELECT 2 * n FROM src))
"""))
def export_manifest(spark, sf_dir):
    """A bundle with guideline, saved rules and history is written and checked against its manifest."""
    return K2.verify_bundle(spark, _bundle(spark, sf_dir))


@register("exported_points", with_views("""
SELECT uid, CASE WHEN isfinite(pca_x) THEN pca_x END AS pca_x, CASE WHEN isfinite(pca_y) THEN pca_y END AS pca_y, confidence, annotation, raw_annotations FROM pts
"""))
def exported_points(spark, sf_dir):
    """The annotations of a bundle, read back (no NaN or infinity is written)."""
    return K2.read_section(spark, _bundle(spark, sf_dir), "annotations").select("uid", "pca_x", "pca_y", "confidence", "annotation", "raw_annotations")


@register("snapshot_content", with_views("""
SELECT uid, CASE WHEN isfinite(pca_x) THEN pca_x END AS pca_x, CASE WHEN isfinite(pca_y) THEN pca_y END AS pca_y, confidence, text_to_annotate FROM pts
"""))
def snapshot_content(spark, sf_dir):
    """A JSON snapshot, read back."""
    rows = points(spark, sf_dir).select("uid", "pca_x", "pca_y", "confidence", "text_to_annotate")
    return spark.read.schema(rows.schema).json(K2.write_snapshot(rows, shared_path(spark, "json")))


@register("guideline_files", with_views(_TG + """
SELECT task_id, concat(guideline, chr(10)) AS content FROM tg WHERE version = 2
"""))
def guideline_files(spark, sf_dir):
    """Each task's guideline as a text file, read back whole."""
    path = shared_path(spark, "guidelines")
    K2.write_guideline(task_guidelines(spark, sf_dir).where("version = 2"), path)
    return spark.read.text(path, wholetext=True).select(F.col("task_id").cast("string").alias("task_id"), F.col("value").alias("content"))


# --- O6: stored pages -----------------------------------------------------------------------

@register("stored_page", with_views("""
, k AS (SELECT uid, doc_id, confidence, row_number() OVER (ORDER BY coalesce(confidence, 0.0), uid NULLS FIRST, sha256(text_to_annotate)) AS page_rank FROM r1),
p AS (SELECT page_rank FROM k WHERE uid = '5')
SELECT uid, doc_id, confidence, page_rank FROM k WHERE page_rank BETWEEN 351 AND 400 OR page_rank IN (SELECT page_rank FROM p)
"""))
def stored_page(spark, sf_dir):
    """Page 8 of round 1 by confidence from a stored sort in parts of 200 rows, with the selected row."""
    path = shared_path(spark, "pages")
    write_pages(round1(spark, sf_dir), "confidence", path, part_rows=200)
    return StoredPages(spark, path).page(8, pinned_uid="5").select("uid", "doc_id", "confidence", "page_rank")


# --- A12: cost of the jobs ------------------------------------------------------------------

_PROMPT_SQL = f"concat({_quoted(_HEAD + GUIDELINE + _MIDDLE)}, t, {_quoted(_TAIL)})"


@register("job_costs", with_views(rf"""
, c AS (SELECT DISTINCT regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t
        FROM (SELECT text AS t FROM documents UNION ALL SELECT text FROM benchmark)),
p AS (SELECT {_PROMPT_SQL} AS prompt FROM c WHERE t IS NOT NULL AND length(t) > 0),
h AS (SELECT prompt, CAST(concat('0x', substr(sha256(prompt), 1, 8)) AS BIGINT) AS h FROM p),
a AS (SELECT prompt, h % 2 AS label, 40 + (h // 256) % 61 AS conf FROM h),
s AS (SELECT count(*) AS calls, CAST(sum(ceil(length(prompt) / 4.0)) AS BIGINT) AS input_tokens,
             CAST(sum(ceil(length('{{"analysis": "offline checksum answer", "annotation": "' || label || '", "confidence": ' || conf
            || ', "new_edge_case": ' || CASE WHEN conf <= 75 THEN 'true' ELSE 'false' END || ', "new_edge_case_rule": "'
            || CASE WHEN conf <= 75 THEN 'When the text is short and unclear -> classify as 0' ELSE 'EMPTY' END || '"}}') / 4.0)) AS BIGINT) AS output_tokens FROM a)
SELECT '{TASK_ID}' AS task_id, 0 AS round, 'annotator' AS model, calls, input_tokens, output_tokens, CAST(0 AS BIGINT) AS failed,
       round(input_tokens / 1e6 * 2.0::DOUBLE + output_tokens / 1e6 * 8.0::DOUBLE, 6) AS cost_usd FROM s
"""))
def job_costs(spark, sf_dir):
    """What round 0 and an increment by the benchmark passages cost together; cached prompts cost nothing."""
    work = shared_path(spark, "work")
    ann = J.annotate_round(_examples(spark, sf_dir), _guidelines(spark), TASK_ID, 0, work, J.offline_plugins())
    J.annotate_increment(_arrivals(spark, sf_dir), ann, _guidelines(spark), TASK_ID, 0, work, J.offline_plugins())
    prices = spark.createDataFrame([("annotator", 2.0, 8.0)], "model string, input_usd_per_mtok double, output_usd_per_mtok double")
    return J.job_costs(spark, work, prices)


# --- P8: indexed search -----------------------------------------------------------------------

_TERMS = ("from src7", "SRC1", "é", "q", "no such text at all")


@register("indexed_search", with_views(f"""
, terms AS (SELECT unnest([{', '.join(f"'{t}'" for t in _TERMS)}]) AS term)
SELECT term, uid FROM pts JOIN terms ON coalesce(contains(lower(text_to_annotate), lower(term)), false)
   OR coalesce(contains(lower(analyses), lower(term)), false) OR coalesce(contains(lower(raw_annotations), lower(term)), false)
"""))
def indexed_search(spark, sf_dir):
    """The rows that hold each of five terms, long and short, found through trigram postings."""
    path = shared_path(spark, "search")
    build(points(spark, sf_dir).select("uid", "text_to_annotate", "analyses", "raw_annotations"), path, block_rows=16)
    index, out = SearchIndex(spark, path), None
    for term in _TERMS:
        part = index.search(term).select(F.lit(term).alias("term"), "uid")
        out = part if out is None else out.unionByName(part)
    return out
