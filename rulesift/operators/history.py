"""Guideline history (U3): versions as an append-only table, and which version an answer was given under.

A version is one row (task_id, version, valid_from, guideline, digest); nothing is ever changed. ``valid_from`` is any
ordered value (a round number, a time). Versions of a task are numbered from 1 in the order they came into force. A guideline
that equals the one in force makes no new version.

The as-of join never multiplies or sorts answers: the versions of a task are one row with a sorted array, joined by task, and the
last one not after the answer is picked inside the row. A task can hold any share of the answers; its array is as long as
its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.operators.cache import path_exists

#: Versions up to which the arrays of all tasks are sent to every task of the join; with more, answers are joined by shuffle.
BROADCAST_VERSIONS = 20_000

HISTORY = "task_id string, version int, valid_from {at}, guideline string, digest string"


def append_versions(history: DataFrame | None, guidelines: DataFrame, valid_from: Column | str) -> DataFrame:
    """The rows that (task_id, guideline) adds to ``history``: one for each task whose guideline differs from the
    one in force, which is its latest. A new guideline cannot come into force before the latest version did, or
    the history would be rewritten; such rows are raised as an error by ``check_order``. Without a task a row is left out."""
    at = F.col(valid_from) if isinstance(valid_from, str) else valid_from
    new = (guidelines.where("task_id is not null and guideline is not null")
           .groupBy("task_id").agg(F.min(F.struct(at.alias("valid_from"), "guideline")).alias("_g"))
           .select("task_id", F.col("_g.valid_from").alias("valid_from"), F.col("_g.guideline").alias("guideline"))
           .withColumn("digest", F.sha2("guideline", 256)))
    if history is None:
        return new.select("task_id", F.lit(1).alias("version"), "valid_from", "guideline", "digest")
    last = history.groupBy("task_id").agg(F.max(F.struct("version", "digest")).alias("_l"))
    return (new.join(last, "task_id", "left").where(F.col("_l").isNull() | (F.col("_l.digest") != F.col("digest")))
            .select("task_id", (F.coalesce("_l.version", F.lit(0)) + 1).alias("version"), "valid_from", "guideline", "digest"))


def check_order(history: DataFrame, added: DataFrame) -> None:
    """Raise if a version comes into force before the one before it (a round that is run again may replace its own)."""
    last = history.groupBy("task_id").agg(F.max("valid_from").alias("_last"))
    bad = added.join(last, "task_id").where(F.col("valid_from") < F.col("_last")).select("task_id").limit(1).collect()
    if bad:
        raise ValueError(f"task {bad[0][0]!r}: a guideline version cannot come into force before the latest one")


def read_history(spark: SparkSession, path: str, at: str = "int") -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.schema(HISTORY.format(at=at)).parquet(path)


def record(guidelines: DataFrame, path: str, valid_from: Column | str, at: str = "int") -> DataFrame:
    """Append the versions that (task_id, guideline) adds to the history at ``path``; returns the whole history."""
    spark = guidelines.sparkSession
    history = read_history(spark, path, at)
    added = append_versions(history, guidelines, valid_from).withColumn("valid_from", F.col("valid_from").cast(at)).checkpoint()
    if history is not None:
        check_order(history, added)
    if not added.isEmpty():
        added.write.mode("append").parquet(path)
    return read_history(spark, path, at) or added


def intervals(history: DataFrame) -> DataFrame:
    """task_id, version, valid_from, valid_to (null: still in force), digest."""
    following = F.lead("valid_from").over(W.partitionBy("task_id").orderBy("valid_from", "version"))  # versions of one task
    return history.select("task_id", "version", "valid_from", following.alias("valid_to"), "digest")


def as_of(rows: DataFrame, history: DataFrame, at: str, task: str = "task_id") -> DataFrame:
    """``rows`` with ``guideline_version`` and ``guideline_digest`` in force at the value of ``at``; null before the first version,
    for a null value or task, and for tasks without a history. Of versions with one ``valid_from`` the greatest holds."""
    taken = {c.lower() for c in rows.columns}
    versions, key = "_versions", "_task"
    while versions in taken or key in taken:
        versions, key = versions + "_", key + "_"
    lists = (history.where("task_id is not null").groupBy(F.col("task_id").alias(key))
             .agg(F.array_sort(F.collect_list(F.struct("valid_from", "version", "digest"))).alias(versions)))
    if history.count() <= BROADCAST_VERSIONS:
        lists = F.broadcast(lists)
    past = F.filter(versions, lambda v: v["valid_from"] <= F.col(at))
    found = F.try_element_at(past, F.lit(-1))
    return (rows.join(lists, rows[task] == lists[key], "left")
            .select(*rows.columns, found["version"].alias("guideline_version"), found["digest"].alias("guideline_digest")))
