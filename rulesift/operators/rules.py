"""From proposed edge-case rules to a short numbered rule list (P5-P7, M6, M7,
M9, W1, A7-A9, J8-J10).

The reference keeps an ordered ``rule -> [uid]`` dict; here it is the long
table ``(rule_no, rule, uid)`` and every order it relied on is an explicit
column. Per-cluster windows and lists are bounded by the cluster size limit
(at most 20 rules per cluster); global numbering uses the distributed ranker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulesift.functions.text import EDGE_SECTION, is_empty_rule, rule_condition, ws_trim
from rulesift.operators.ranking import global_row_number

RULES_PER_CLUSTER = 15     # target cluster size: n div 15 + 1 clusters
# Size limits by number of rules: n <= 20 none; 21..40 -> 5..20; > 40 -> 10..20.
SMALL_N, MID_N = 20, 40
MID_LIMITS, LARGE_LIMITS = (5, 20), (10, 20)

# Fixed value: the columns of a cluster result, in their published order.
OUTPUT_FIELDS = ("text_to_annotate", "uid", "edge_case_id", "pca_x", "pca_y", "raw_annotations",
                 "analyses", "annotation", "confidence", "guideline_improvement")


def proposed_rules(df: DataFrame, rule: str = "guideline_improvement",
                   require_flag: bool = False) -> DataFrame:
    """P5 + P6: rows with a real rule (null / EMPTY dropped, ledger L3) and
    its condition part. ``require_flag`` also needs ``new_edge_case`` (L14)."""
    keep = ~is_empty_rule(rule)
    if require_flag:
        keep = keep & F.coalesce(F.col("new_edge_case"), F.lit(False))
    return df.where(keep).withColumn("condition", rule_condition(rule))


def cluster_count(n: str | Column) -> Column:
    """M6: number of rule clusters for n rules."""
    x = F.col(n) if isinstance(n, str) else n
    return (F.floor(x / RULES_PER_CLUSTER) + 1).cast("int")


def size_limits(n: str | Column) -> tuple[Column, Column]:
    """M7: (size_min, size_max) for n rules; null when unconstrained."""
    x = F.col(n) if isinstance(n, str) else n
    lo = F.when(x <= SMALL_N, F.lit(None)).when(x <= MID_N, F.lit(MID_LIMITS[0])).otherwise(LARGE_LIMITS[0])
    hi = F.when(x <= SMALL_N, F.lit(None)).when(x <= MID_N, F.lit(MID_LIMITS[1])).otherwise(LARGE_LIMITS[1])
    return lo.cast("int"), hi.cast("int")


def cluster_plan(rules: DataFrame, task: str = "task_id") -> DataFrame:
    """M6 + M7 + M9 per task: rules, clusters, size limits and the path taken
    (none / single / cluster)."""
    g = rules.groupBy(task).agg(F.count(F.lit(1)).alias("rules"))
    lo, hi = size_limits("rules")
    path = F.when(F.col("rules") == 0, "none").when(F.col("rules") == 1, "single").otherwise("cluster")
    return g.select(task, "rules", cluster_count("rules").alias("clusters"),
                    lo.alias("size_min"), hi.alias("size_max"), path.alias("path"))


def single_rule_cases(rules: DataFrame, task: str = "task_id") -> DataFrame:
    """M9: a task with exactly one rule: that rule is edge case 0 at (0, 0)."""
    n = rules.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    one = rules.join(n.where("_n = 1").drop("_n"), task, "left_semi")
    return one.select(task, "uid", F.lit(0).alias("edge_case_id"), F.lit(0.0).alias("pca_x"),
                      F.lit(0.0).alias("pca_y"), F.col("guideline_improvement"))


def number_in_cluster(rules: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """1-based number of each rule inside its cluster, by uid."""
    w = Window.partitionBy(cluster).orderBy("uid")
    return rules.withColumn("n", F.row_number().over(w))


def numbered_lists(numbered: DataFrame, cluster: str = "cluster_id",
                   rule: str = "guideline_improvement") -> DataFrame:
    """``1. rule\\n2. rule ...`` per cluster (bounded by the size limit)."""
    items = F.array_sort(F.collect_list(F.struct(F.col("n"), F.col(rule).alias("r"))))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["r"])), "\n")
    return numbered.groupBy(cluster).agg(F.count(F.lit(1)).alias("rules"), text.alias("rule_list"))


def map_members(categories: DataFrame, numbered: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Category member numbers -> uids; numbers outside 1..n drop out
    (an inner equi-join on (cluster, n), ledger L4)."""
    m = numbered.select(cluster, "n", "uid")
    return (categories.join(m, (categories[cluster] == m[cluster]) & (categories["edge_case"] == m["n"]))
            .select(categories[cluster], "category_no", "category_description", "uid"))


def rule_order(mapped: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Distinct generalised rules numbered by first appearance over
    (cluster, category); the same text from two clusters is one rule."""
    first = mapped.groupBy(F.col("category_description").alias("rule")).agg(
        F.min(F.struct(F.col(cluster).alias("c"), F.col("category_no").alias("k"))).alias("_f"))
    first = first.select("rule", F.col("_f.c").alias("_c"), F.col("_f.k").alias("_k"))
    return global_row_number(first, ["_c", "_k", "rule"], "rule_no").drop("_c", "_k")


def merge_rules(ordered: DataFrame, merges: DataFrame, block: str = "block") -> DataFrame:
    """Each rule takes the first merge suggestion (by block, merge_no) that
    lists its number; rules with the same resulting text are one final rule,
    numbered (from 0) by first appearance. Returns (rule_no, final_no, final_rule)."""
    firsts = merges.groupBy(F.col("member").alias("rule_no")).agg(
        F.min(F.struct(F.col(block).alias("b"), F.col("merge_no").alias("m"), F.col("merged_rule").alias("r")))
        .alias("_s"))
    j = ordered.join(firsts, "rule_no", "left").select(
        "rule_no", F.coalesce(F.col("_s.r"), F.col("rule")).alias("final_rule"))
    first = j.groupBy("final_rule").agg(F.min("rule_no").alias("_first"))
    numbered = global_row_number(first, ["_first", "final_rule"], "_fn")
    return (j.join(numbered.select("final_rule", (F.col("_fn") - 1).cast("int").alias("final_no")), "final_rule")
            .select("rule_no", "final_no", "final_rule"))


def assign_final_rules(edge_rows: DataFrame, members: DataFrame) -> DataFrame:
    """J10 + P7: each edge-case row gets its final rule number and text; with
    several rules the last (highest number) wins; rows no rule covers get a
    null id (ledger L12). The proposed rule is kept as ``low_level_rule``."""
    last = members.groupBy("uid").agg(F.max(F.struct("final_no", "final_rule")).alias("_r"))
    j = edge_rows.join(last, "uid", "left")
    out = j.withColumn("low_level_rule", F.col("guideline_improvement")) \
        .withColumn("edge_case_id", F.col("_r.final_no")) \
        .withColumn("guideline_improvement", F.col("_r.final_rule")).drop("_r")
    present = [c for c in OUTPUT_FIELDS if c in out.columns]
    return out.select(*present, "low_level_rule")


def complete_guideline(guidelines: DataFrame, saved: DataFrame, max_rules: int | None = None) -> DataFrame:
    """Guideline + ``Edge Case Handling:`` + saved rules numbered 1..n in
    ascending cluster order (per task); rules with a null number are left out
    (ledger L12).

    The result is one string per task that goes into every prompt. A caller
    whose model bounds the prompt gives ``max_rules``; more rules than that
    in one task are an error (nothing is dropped).
    """
    s = saved.where(F.col("cluster_no").isNotNull() & F.col("rule").isNotNull())
    if max_rules is not None:
        most = s.groupBy("task_id").count().agg(F.max("count")).first()[0] or 0
        if most > max_rules:
            raise ValueError(f"a task has {most} saved rules; the guideline takes at most {max_rules}")
    lists = s.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("cluster_no", "rule"))).alias("_l"))
    numbered = F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["rule"]))
    j = guidelines.join(lists, "task_id", "left")
    base = ws_trim("guideline")
    return j.select("task_id", F.when(F.size(F.coalesce("_l", F.array())) > 0, F.concat(
        base, F.lit("\n\n" + EDGE_SECTION + "\n"), F.array_join(numbered, "\n")))
        .otherwise(base).alias("guideline"))
