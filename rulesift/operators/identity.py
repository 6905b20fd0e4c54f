"""Stable example ids.

A known text keeps its uid; a new text gets a content-derived one, so a retried
task or a re-run gives the same ids (``uuid()`` would change on retry). The
registry is a table keyed by (task, text digest); joins use the digest so the
shuffle does not carry the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.functions.text import text_key

UID_HEX = 32      # 128-bit ids, the length of a UUID without dashes


def content_uid(task: str | Column, text: str | Column) -> Column:
    t = F.col(task) if isinstance(task, str) else task
    x = F.col(text) if isinstance(text, str) else text
    return F.substring(F.sha2(F.concat(t, F.lit("\u001f"), x), 256), 1, UID_HEX)


def assign_ids(examples: DataFrame, registry: DataFrame | None,
               text: str = "text_to_annotate", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(examples with uid and is_new, registry additions)``.

    The registry side is reduced to one row per (task, digest) with a partial
    aggregate, so the left join never multiplies example rows. ``key``: a column with the
    texts' digests, kept, so that rows that lie by it need not move again.
    """
    tk = key or "_tk"
    ex = examples if key else examples.withColumn(tk, text_key(text))
    if registry is None:
        known = None
    else:
        known = (registry.groupBy("task_id", F.col("text_key").alias(tk))
                 .agg(F.min("uid").alias("_known_uid")))
    if known is not None:
        ex = ex.join(known, ["task_id", tk], "left")
    else:
        ex = ex.withColumn("_known_uid", F.lit(None).cast("string"))
    out = (ex.withColumn("is_new", F.col("_known_uid").isNull())
           .withColumn("uid", F.coalesce(F.col("_known_uid"), content_uid("task_id", text))))
    additions = (out.where("is_new")
                 .groupBy("task_id", F.col(tk).alias("text_key"))
                 .agg(F.min(F.col(text)).alias(text), F.min("uid").alias("uid")))
    return out.drop(*([] if key else [tk]), "_known_uid"), additions
