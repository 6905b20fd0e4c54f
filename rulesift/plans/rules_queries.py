"""Rule discovery queries.

Fixture: round 0's edge cases, grouped into rule clusters of at most 20 rows
(blocks of consecutive ids, standing in for the balanced clustering). The
synthesizer's answer per cluster is built from the data: one category per
(language, source, label) with the members whose number is not a multiple of
5 (so some rows stay uncovered), plus a "repeats a line" category over the
multiples of 3 (so some rows are in two rules) and one number past the end
(so out-of-range numbers are exercised). Even clusters answer in fenced
JSON, odd clusters in broken JSON that only the line recovery can read.
Merge answers: per language block, one ``Merge [...]`` line per label with
at least two rules; the block of rules without a language says NO MERGE.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulesift.functions import parse as P
from rulesift.operators import rules as RU
from rulesift.plans.catalog import register
from rulesift.plans.fixtures import round0, with_views

REPEAT_RULE = "When the text repeats a line -> keep the label"
NO_LANG = "none"


def rule_rows(spark, sf_dir):
    r = RU.proposed_rules(round0(spark, sf_dir))
    return r.withColumn("cluster_id", F.floor(F.col("doc_id") / 20).cast("int"))


def numbered(spark, sf_dir):
    return RU.number_in_cluster(rule_rows(spark, sf_dir))


def _category_members(nr):
    desc = F.concat(F.lit("When a "), F.col("lang"), F.lit(" text from "), F.col("source"),
                    F.lit(" is labelled "), F.col("annotation"), F.lit(" -> keep the label"))
    cat = nr.select("cluster_id", "n", desc.alias("d"))
    # Bounded windows: one rule cluster (<= 20 rows) each.
    cat = cat.withColumn("category_no", F.dense_rank().over(Window.partitionBy("cluster_id").orderBy("d")))
    per_cluster = cat.groupBy("cluster_id").agg(F.max("category_no").alias("kmax"), F.count(F.lit(1)).alias("size"))
    main = cat.where(F.col("n") % 5 != 0).select(
        "cluster_id", "category_no", F.col("d").alias("category_description"), F.col("n").alias("edge_case"))
    rep = cat.where(F.col("n") % 3 == 0).join(per_cluster, "cluster_id").select(
        "cluster_id", (F.col("kmax") + 1).alias("category_no"), F.lit(REPEAT_RULE).alias("category_description"),
        F.col("n").alias("edge_case"))
    past = per_cluster.select("cluster_id", (F.col("kmax") + 1).alias("category_no"),
                              F.lit(REPEAT_RULE).alias("category_description"),
                              (F.col("size") + 5).cast("int").alias("edge_case"))
    cats = cat.select("cluster_id", "category_no", F.col("d").alias("category_description")).distinct() \
        .unionByName(per_cluster.select("cluster_id", (F.col("kmax") + 1).alias("category_no"),
                                        F.lit(REPEAT_RULE).alias("category_description")))
    return cats, main.unionByName(rep).unionByName(past)


def category_responses(spark, sf_dir):
    """One synthesizer answer per rule cluster (fenced JSON or broken JSON)."""
    cats, members = _category_members(numbered(spark, sf_dir))
    m = members.groupBy("cluster_id", "category_no").agg(F.array_sort(F.collect_list("edge_case")).alias("cases"))
    c = cats.join(m, ["cluster_id", "category_no"], "left").select(
        "cluster_id", "category_no", "category_description", F.coalesce("cases", F.array().cast("array<int>")).alias("cases"))
    per = c.groupBy("cluster_id").agg(F.array_sort(F.collect_list(
        F.struct("category_no", "category_description", "cases"))).alias("cats"))
    js = F.to_json(F.struct(F.transform("cats", lambda x: F.struct(
        x["category_description"].alias("category_description"), x["cases"].alias("edge_cases"))).alias("categories")))
    lines = F.array_join(F.transform("cats", lambda x: F.concat(
        F.lit('{\n"category_description": "'), x["category_description"], F.lit('",\n"edge_cases": ['),
        F.array_join(x["cases"].cast("array<string>"), ", "), F.lit("]\n},"))), "\n")
    broken = F.concat(F.lit('Here are the categories:\n{\n"categories": [\n'), lines, F.lit("\n]"))
    fenced = F.concat(F.lit("Categories below.\n```json\n"), js, F.lit("\n```"))
    return per.select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, fenced).otherwise(broken).alias("response"))


def parsed_categories(spark, sf_dir):
    return P.parse_categories(category_responses(spark, sf_dir), "cluster_id")


def mapped_members(spark, sf_dir):
    return RU.map_members(parsed_categories(spark, sf_dir), numbered(spark, sf_dir))


def ordered_rules(spark, sf_dir, mapped=None):
    return RU.rule_order(mapped if mapped is not None else mapped_members(spark, sf_dir))


def merge_responses(spark, sf_dir, ordered=None):
    o = ordered if ordered is not None else ordered_rules(spark, sf_dir)
    lang = F.regexp_extract("rule", r"^When a (\S+) text", 1)
    label = F.regexp_extract("rule", r" is labelled (\S+) -> ", 1)
    o = o.select("rule_no", F.when(lang != "", lang).otherwise(F.lit(NO_LANG)).alias("block"), label.alias("label"))
    groups = (o.where(F.col("block") != NO_LANG).groupBy("block", "label")
              .agg(F.array_sort(F.collect_list("rule_no")).alias("nums"))
              .where(F.size("nums") >= 2))
    line = F.concat(F.lit("Merge ["), F.array_join(F.col("nums").cast("array<string>"), ", "), F.lit("]: When a "),
                    F.col("block"), F.lit(" text is labelled "), F.col("label"), F.lit(" -> keep the label"))
    per_block = groups.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("label", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("Merge Suggestions:\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    blocks = o.select("block").distinct().join(per_block, "block", "left")
    return blocks.select("block", F.coalesce(text, F.lit("Merge Suggestions:\nNO MERGE")).alias("response"))


def rule_chain(spark, sf_dir):
    """The fixture chain with each stage built once (the global ranking of
    rules is the costly step; it is checkpointed inside ``rule_order``)."""
    mapped = mapped_members(spark, sf_dir)
    ordered = ordered_rules(spark, sf_dir, mapped)
    merges = P.parse_merges(merge_responses(spark, sf_dir, ordered), "block")
    merged = RU.merge_rules(ordered, merges)
    members = (mapped.join(ordered, mapped["category_description"] == ordered["rule"]).select("uid", "rule_no")
               .join(merged, "rule_no").select("uid", "final_no", "final_rule"))
    return {"mapped": mapped, "ordered": ordered, "merges": merges, "merged": merged, "members": members}


# ---- SQL twin of the fixture chain --------------------------------------------------------

_CHAIN = r"""
, rr AS (SELECT *, CAST(doc_id // 20 AS INTEGER) AS cluster_id FROM r0
         WHERE guideline_improvement IS NOT NULL
           AND upper(regexp_replace(guideline_improvement, '^\s+|\s+$', '', 'g')) <> 'EMPTY'),
nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY uid) AS INTEGER) AS n FROM rr),
cat AS (SELECT cluster_id, n, 'When a ' || lang || ' text from ' || source || ' is labelled ' || annotation
               || ' -> keep the label' AS d FROM nr),
catn AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY cluster_id ORDER BY d) AS INTEGER) AS category_no FROM cat),
cl AS (SELECT cluster_id, max(category_no) AS kmax, count(*) AS size FROM catn GROUP BY cluster_id),
mem AS (SELECT cluster_id, category_no, d AS category_description, n AS edge_case FROM catn WHERE n % 5 <> 0
        UNION ALL
        SELECT c.cluster_id, cl.kmax + 1, 'When the text repeats a line -> keep the label', c.n
        FROM catn c JOIN cl USING (cluster_id) WHERE c.n % 3 = 0
        UNION ALL
        SELECT cluster_id, kmax + 1, 'When the text repeats a line -> keep the label', CAST(size + 5 AS INTEGER)
        FROM cl),
mapped AS (SELECT m.cluster_id, m.category_no, m.category_description, nr.uid
           FROM mem m JOIN nr ON m.cluster_id = nr.cluster_id AND m.edge_case = nr.n),
firsts AS (SELECT category_description AS rule, min(cluster_id * 1000 + category_no) AS f FROM (
             SELECT m.*, (SELECT 1) AS one FROM mapped m) GROUP BY category_description),
ordered AS (SELECT rule, row_number() OVER (ORDER BY f, rule) AS rule_no FROM firsts),
lab AS (SELECT rule_no,
               CASE WHEN regexp_extract(rule, '^When a (\S+) text', 1) <> ''
                    THEN regexp_extract(rule, '^When a (\S+) text', 1) ELSE 'none' END AS block,
               regexp_extract(rule, ' is labelled (\S+) -> ', 1) AS label FROM ordered),
grp AS (SELECT block, label, CAST(dense_rank() OVER (PARTITION BY block ORDER BY label) AS INTEGER) AS merge_no,
               'When a ' || block || ' text is labelled ' || label || ' -> keep the label' AS merged_rule
        FROM (SELECT block, label FROM lab WHERE block <> 'none' GROUP BY block, label HAVING count(*) >= 2)),
merges AS (SELECT g.block, g.merge_no, CAST(l.rule_no AS INTEGER) AS member, g.merged_rule
           FROM grp g JOIN lab l ON g.block = l.block AND g.label = l.label),
firstm AS (SELECT member AS rule_no, arg_min(merged_rule, block || lpad(CAST(merge_no AS VARCHAR), 10, '0')) AS mr
           FROM merges GROUP BY member),
fr AS (SELECT o.rule_no, coalesce(f.mr, o.rule) AS final_rule FROM ordered o LEFT JOIN firstm f ON o.rule_no = f.rule_no),
fnum AS (SELECT final_rule, CAST(row_number() OVER (ORDER BY min(rule_no), final_rule) - 1 AS INTEGER) AS final_no
         FROM fr GROUP BY final_rule),
merged AS (SELECT fr.rule_no, fnum.final_no, fr.final_rule FROM fr JOIN fnum USING (final_rule)),
fm AS (SELECT mp.uid, mg.final_no, mg.final_rule FROM mapped mp JOIN ordered o ON mp.category_description = o.rule
       JOIN merged mg ON o.rule_no = mg.rule_no)
"""


@register("proposed_rules", with_views(r"""
SELECT uid, regexp_replace(split_part(guideline_improvement, '->', 1), '^\s+|\s+$', '', 'g') AS condition
FROM r0 WHERE guideline_improvement IS NOT NULL
  AND upper(regexp_replace(guideline_improvement, '^\s+|\s+$', '', 'g')) <> 'EMPTY'
"""))
def proposed_rules(spark, sf_dir):
    """P5 + P6: rows with a proposed rule and its condition part."""
    return RU.proposed_rules(round0(spark, sf_dir)).select("uid", "condition")


@register("rule_cluster_plan", with_views(r"""
, t AS (SELECT source || '/' || lang || '/' || annotation AS task_id, count(*) AS rules FROM r0
        WHERE guideline_improvement IS NOT NULL
          AND upper(regexp_replace(guideline_improvement, '^\s+|\s+$', '', 'g')) <> 'EMPTY'
        GROUP BY 1)
SELECT task_id, rules, CAST(rules // 15 + 1 AS INTEGER) AS clusters,
       CAST(CASE WHEN rules <= 20 THEN NULL WHEN rules <= 40 THEN 5 ELSE 10 END AS INTEGER) AS size_min,
       CAST(CASE WHEN rules <= 20 THEN NULL ELSE 20 END AS INTEGER) AS size_max,
       CASE WHEN rules = 0 THEN 'none' WHEN rules = 1 THEN 'single' ELSE 'cluster' END AS path
FROM t
"""))
def rule_cluster_plan(spark, sf_dir):
    """M6 + M7 + M9: clusters and size limits per task (source/language)."""
    r = RU.proposed_rules(round0(spark, sf_dir)).withColumn(
        "task_id", F.concat_ws("/", "source", "lang", "annotation"))
    return RU.cluster_plan(r)


@register("single_rule_cases", with_views(r"""
, r AS (SELECT source || '/' || lang || '/' || annotation AS task_id, * FROM r0
        WHERE guideline_improvement IS NOT NULL
          AND upper(regexp_replace(guideline_improvement, '^\s+|\s+$', '', 'g')) <> 'EMPTY')
SELECT task_id, uid, 0 AS edge_case_id, 0.0::DOUBLE AS pca_x, 0.0::DOUBLE AS pca_y, guideline_improvement
FROM r WHERE task_id IN (SELECT task_id FROM r GROUP BY task_id HAVING count(*) = 1)
"""))
def single_rule_cases(spark, sf_dir):
    """M9: a task with a single rule gets edge case 0 at the origin."""
    r = RU.proposed_rules(round0(spark, sf_dir)).withColumn(
        "task_id", F.concat_ws("/", "source", "lang", "annotation"))
    return RU.single_rule_cases(r)


@register("rule_numbering", with_views(_CHAIN + "SELECT uid, cluster_id, n FROM nr"))
def rule_numbering(spark, sf_dir):
    """Number of each rule inside its cluster, by uid."""
    return numbered(spark, sf_dir).select("uid", "cluster_id", "n")


@register("rule_lists", with_views(_CHAIN + """
SELECT cluster_id, count(*) AS rules,
       string_agg(CAST(n AS VARCHAR) || '. ' || guideline_improvement, chr(10) ORDER BY n) AS rule_list
FROM nr GROUP BY cluster_id
"""))
def rule_lists(spark, sf_dir):
    """The numbered rule list sent for generalisation, per cluster."""
    return RU.numbered_lists(numbered(spark, sf_dir))


@register("parse_categories", with_views(_CHAIN + "SELECT * FROM mem"))
def parse_categories(spark, sf_dir):
    """categories from fenced JSON and from broken JSON (line recovery)."""
    return parsed_categories(spark, sf_dir)


@register("map_members", with_views(_CHAIN + "SELECT * FROM mapped"))
def map_members(spark, sf_dir):
    """Category numbers mapped back to uids (out-of-range numbers drop)."""
    return mapped_members(spark, sf_dir)


@register("rule_order", with_views(_CHAIN + "SELECT rule, rule_no FROM ordered"))
def rule_order(spark, sf_dir):
    """Generalised rules numbered by first appearance; equal texts join up."""
    return ordered_rules(spark, sf_dir)


@register("parse_merges", with_views(_CHAIN + "SELECT block, merge_no, member, merged_rule FROM merges"))
def parse_merges(spark, sf_dir):
    """F8: merge suggestions parsed from the merge answers."""
    return P.parse_merges(merge_responses(spark, sf_dir), "block")


@register("merge_rules", with_views(_CHAIN + "SELECT rule_no, final_no, final_rule FROM merged"))
def merge_rules(spark, sf_dir):
    """Rules replaced by their first merge suggestion, renumbered."""
    return rule_chain(spark, sf_dir)["merged"]


@register("final_rules", with_views(_CHAIN + """
, last AS (SELECT uid, max(final_no) AS final_no, arg_max(final_rule, final_no) AS final_rule FROM fm GROUP BY uid)
SELECT r.uid, l.final_no AS edge_case_id, l.final_rule AS guideline_improvement,
       r.guideline_improvement AS low_level_rule
FROM rr r LEFT JOIN last l ON r.uid = l.uid
"""))
def final_rules(spark, sf_dir):
    """J10 + P7: final rule id and text per edge case (last rule wins; uncovered -> null)."""
    out = RU.assign_final_rules(rule_rows(spark, sf_dir), rule_chain(spark, sf_dir)["members"])
    return out.select("uid", "edge_case_id", "guideline_improvement", "low_level_rule")


def cluster_result_documents(spark, sf_dir):
    """One result document per rule cluster in one of the three shapes
    (cluster_id % 3: object, pair, single), one document per line."""
    rr = numbered(spark, sf_dir)
    row = F.struct("text_to_annotate", "uid", F.col("cluster_id").cast("double").alias("edge_case_id"),
                   F.lit(0.0).alias("pca_x"), F.lit(0.0).alias("pca_y"), "raw_annotations", "annotation",
                   F.col("confidence").cast("string").alias("confidence"), "guideline_improvement")
    per = rr.withColumn("raw_annotations", F.lit(None).cast("string")).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"))                  # <= 20 rows per cluster
    sugg = F.create_map(F.concat(F.lit("edge_case_"), F.col("cluster_id").cast("string")),
                        F.concat(F.lit("Rules of cluster "), F.col("cluster_id").cast("string")))
    obj = F.to_json(F.struct(sugg.alias("suggestions"), F.col("rows").alias("improvement_clusters")))
    pair = F.concat(F.lit("["), F.to_json(sugg), F.lit(", "), F.to_json("rows"), F.lit("]"))
    single = F.concat(F.lit('[{"suggestions": '), F.to_json(sugg), F.lit("}]"))
    shape = F.col("cluster_id") % 3
    return per.select(F.when(shape == 0, obj).when(shape == 1, pair).otherwise(single).alias("value"))


@register("cluster_results", with_views(_CHAIN + """
SELECT uid, CAST(cluster_id AS DOUBLE) AS edge_case_id, CAST(confidence AS VARCHAR) AS confidence
FROM nr WHERE cluster_id % 3 IN (0, 1)
"""))
def cluster_results(spark, sf_dir):
    """S3: result documents in the object / pair / single shapes read back."""
    from rulesift.session import ensure_checkpoint_dir, shared_path
    from rulesift.sources.ingest import read_cluster_results
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "cluster_results")
    cluster_result_documents(spark, sf_dir).write.mode("overwrite").text(path)
    _, edge = read_cluster_results(spark, path, lines=True)
    return edge.select("uid", "edge_case_id", "confidence")


@register("cluster_result_rules", with_views(_CHAIN + """
SELECT DISTINCT 'edge_case_' || CAST(cluster_id AS VARCHAR) AS rule_key,
       'Rules of cluster ' || CAST(cluster_id AS VARCHAR) AS rule FROM nr
"""))
def cluster_result_rules(spark, sf_dir):
    """S3: the suggestions of every shape read back."""
    from rulesift.session import ensure_checkpoint_dir, shared_path
    from rulesift.sources.ingest import read_cluster_results
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "cluster_results")
    cluster_result_documents(spark, sf_dir).write.mode("overwrite").text(path)
    rules, _ = read_cluster_results(spark, path, lines=True)
    return rules.select("rule_key", "rule")
