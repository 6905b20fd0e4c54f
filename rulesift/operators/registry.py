"""Keeping tables current: upserts, saved rules, rounds and snapshots
(J7, J12, J13, U2, U3, W4, S8, S9).

Every change is expressed as anti-joins and unions over keyed tables (there is
no MERGE without a table format); "latest" is a ``max_by`` aggregate, which
combines partially per key instead of sorting a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.functions.text import rule_key_number, text_key, ws_trim
from rulesift.operators.rounds import spread_uid

DEFAULT_LABEL = "0"
DEFAULT_CONFIDENCE = 50.0
EDGE_FIELDS = ("confidence", "annotation", "pca_x", "pca_y", "analyses", "raw_annotations", "guideline_improvement")


def upsert_relabelled(annotations: DataFrame, new_rows: DataFrame,
                      text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """New rows replace the annotation with the same uid, else one with the same
    text (the lowest uid of those no new row matches by uid); rows matching nothing
    are appended. New rows are flagged ``is_reannotated``."""
    new_uids = new_rows.where(F.col(uid).isNotNull()).select(F.col(uid).alias("_u")).distinct()
    uid_hit = annotations.select(F.col(uid).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    # New rows whose uid is unknown fall back to text matching.
    by_text = (new_rows.select(uid, text_key(text).alias("_tk")).withColumn("_uk", spread_uid(uid))
               .join(uid_hit, F.col("_uk") == F.col("_u"), "left_anti").select("_tk").distinct())
    keep = annotations.withColumn("_tk", text_key(text)).withColumn("_uk", spread_uid(uid))
    keep = keep.join(new_uids, F.col("_uk") == F.col("_u"), "left_anti").drop("_uk")
    replaced = (keep.join(by_text, "_tk", "left_semi").groupBy(F.col("_tk").alias("_k")).agg(F.min(uid).alias("_first")))
    keep = keep.join(replaced, (F.col("_tk") == F.col("_k")) & F.col(uid).eqNullSafe(F.col("_first")), "left_anti").drop("_tk")
    fresh = new_rows.withColumn("is_reannotated", F.lit(True))
    if "is_reannotated" not in keep.columns:
        keep = keep.withColumn("is_reannotated", F.lit(False))
    return keep.unionByName(fresh, allowMissingColumns=True)


def update_edge_cases(edge_cases: DataFrame, new_rows: DataFrame,
                      text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """J7 (edge side): an edge case matched by a new row (uid, else text)
    takes the new row's values, the answer and the rule included; coordinates
    come from the new row when present."""
    fields = [c for c in EDGE_FIELDS if c in edge_cases.columns and c in new_rows.columns]
    values = F.min(F.struct(*fields))
    nu = new_rows.where(F.col(uid).isNotNull()).groupBy(F.col(uid).alias("_u")).agg(values.alias("_nu"))
    nt = new_rows.groupBy(text_key(text).alias("_tk")).agg(values.alias("_nt"))
    e = (edge_cases.withColumn("_tk", text_key(text)).withColumn("_uk", spread_uid(uid))
         .join(nu, F.col("_uk") == F.col("_u"), "left").join(nt, "_tk", "left"))
    pick = F.coalesce(F.col("_nu"), F.col("_nt"))
    return e.select(
        *[c for c in edge_cases.columns if c not in fields],
        *[F.coalesce(pick[c], F.col(c)).alias(c) for c in fields],
        pick.isNotNull().alias("updated"))


def append_examples(annotations: DataFrame, added: DataFrame) -> DataFrame:
    """Manually added examples with defaults (label 0, confidence 50, not an edge case)."""
    a = (added.withColumn("annotation", F.coalesce(
            F.col("annotation") if "annotation" in added.columns else F.lit(None).cast("string"),
            F.lit(DEFAULT_LABEL)))
         .withColumn("confidence", F.coalesce(
            F.col("confidence") if "confidence" in added.columns else F.lit(None).cast("double"),
            F.lit(DEFAULT_CONFIDENCE)))
         .withColumn("new_edge_case", F.coalesce(
            F.col("new_edge_case") if "new_edge_case" in added.columns else F.lit(None).cast("boolean"),
            F.lit(False))))
    return annotations.unionByName(a, allowMissingColumns=True)


def save_rules(saved: DataFrame, proposals: DataFrame) -> DataFrame:
    """Save proposed rules unless an equal rule (trimmed) is already saved
    or proposed earlier (lower cluster number); an accepted rule replaces the
    saved rule with the same cluster number."""
    known = saved.select("task_id", ws_trim("rule").alias("_t")).distinct()
    cand = (proposals.select("task_id", "cluster_no", "rule", ws_trim("rule").alias("_t"))
            .groupBy("task_id", "_t").agg(F.min(F.struct("cluster_no", "rule")).alias("_p"))
            .join(known, ["task_id", "_t"], "left_anti")
            .select("task_id", F.col("_p.cluster_no").alias("cluster_no"), F.col("_p.rule").alias("rule")))
    cand = cand.groupBy("task_id", "cluster_no").agg(F.min("rule").alias("rule"))
    kept = saved.join(cand.select("task_id", "cluster_no"), ["task_id", "cluster_no"], "left_anti")
    return kept.unionByName(cand)


def edit_rules(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change table ``(task_id, cluster_no, op, rule)`` with op
    'edit' or 'remove' (the last change per rule number wins via ``seq``)."""
    last = changes.groupBy("task_id", "cluster_no").agg(F.max_by(F.struct("op", "rule"), "seq").alias("_c"))
    kept = saved.join(last.select("task_id", "cluster_no"), ["task_id", "cluster_no"], "left_anti")
    edits = last.where(F.col("_c.op") == "edit").select("task_id", "cluster_no", F.col("_c.rule").alias("rule"))
    return kept.unionByName(edits)


def save_all_rules(suggestions: DataFrame, key: str = "rule_key") -> DataFrame:
    """J13 "save all": the whole saved set is replaced by the suggestions,
    keyed by the number in their key (F9)."""
    return (suggestions.withColumn("cluster_no", rule_key_number(key)).where(F.col("cluster_no").isNotNull())
            .groupBy("task_id", "cluster_no").agg(F.max("rule").alias("rule")))


def first_per_rule(df: DataFrame, rule_id: str = "edge_case_id", uid: str = "uid") -> DataFrame:
    """One row per rule id (lowest uid), rows without an id dropped."""
    cols = [c for c in df.columns if c not in (rule_id, uid)]
    return (df.where(F.col(rule_id).isNotNull()).groupBy(rule_id)
            .agg(F.min(F.struct(F.col(uid), *[F.col(c) for c in cols])).alias("_f"))
            .select(rule_id, "_f.*"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key by ``order`` (``max_by`` on a struct)."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_l"))
            .select(*keys, "_l.*"))


def merge_sections(df: DataFrame, keys: list[str], section: str, value: str, order: list[str],
                   defaults: dict[str, str] | None = None) -> DataFrame:
    """Per key and section, the latest non-null value: defaults, then
    stored saves, then newer saves win; sections a save does not carry keep
    their earlier value. ``defaults`` maps section -> value (a small fixed
    set) and is generated per key with ``explode`` (no join); it ranks below
    any save."""
    saves = df.where(F.col(value).isNotNull()).select(
        *keys, section, value, F.struct(F.lit(1).alias("_layer"), *order).alias("_o"))
    if defaults:
        pad = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
        lit_defaults = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(v).alias("v")) for k, v in defaults.items()])
        dflt = (df.select(*keys).distinct()
                .select(*keys, F.explode(lit_defaults).alias("_d"))
                .select(*keys, F.col("_d.s").alias(section), F.col("_d.v").alias(value),
                        F.struct(F.lit(0).alias("_layer"), *pad).alias("_o")))
        saves = saves.unionByName(dflt)
    return saves.groupBy(*keys, section).agg(F.max_by(F.col(value), F.col("_o")).alias(value))
