"""New examples as a Structured Streaming source.

New examples arrive as parquet files in a folder. Each micro-batch is scored with the round's stored models and the caches
(B3's scoring). What the stream has learned lies below ``out_dir``:

* ``registry``: a keyed store of text ids (J1). A batch looks up its own texts only, keeps their ids and appends the new ones;
  ids are content hashes, so a replayed batch adds the same rows again.
* ``scored/batch=<epoch>``: the scored rows, overwritten when an epoch is replayed after a failure.
* ``folded/upto=<epoch>``: every ``FOLD_EVERY`` batches, the latest row of each id up to that epoch. Readers take the newest
  complete fold and the batches after it, so the number of folders stays bounded; folders that a fold replaced are
  deleted by the next one, and an epoch that is complete in a fold is not folded again.

``current_tables`` is the state as B3 returns it: annotations and edge cases after the upsert (J7), and the registry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulesift.operators.cache import path_exists
from rulesift.operators.registry import update_edge_cases, upsert_relabelled
from rulesift.plans.jobs import Increment, Plugins, annotate_increment, at_rules, registry_of
from rulesift.schema import EXAMPLES

FOLD_EVERY = 8


def start(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str, annotations: DataFrame,
          guidelines: DataFrame, task_id: str, round_no: int, work_dir: str, plugins: Plugins,
          registry: DataFrame | None = None, available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Score what arrives in ``input_dir``; ``registry`` (known ids) is taken into the stream's own once, when it is new."""
    out = out_dir.rstrip("/")
    reader = spark.readStream.schema(EXAMPLES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(input_dir)
    base_empty = annotations.limit(0)
    store = registry_of(spark, f"{out}/registry", task_id)
    if registry is not None and not store.manifest()["version"]:
        store.append(registry.where(F.col("task_id") == task_id))

    def score(batch: DataFrame, epoch: int) -> None:
        # Score against an empty base: the batch's own rows, then persist them.
        scored = annotate_increment(batch, base_empty, guidelines, task_id, round_no, work_dir, plugins, registry_path=f"{out}/registry").annotations
        scored.write.mode("overwrite").parquet(f"{out}/scored/batch={epoch}")
        fold(spark, out, epoch)

    w = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The complete ``name=<number>`` folders of a folder, ascending."""
    if not path_exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    found = (int(m.group(1)) for n in names if (m := re.fullmatch(rf"{name}=(\d+)", n)))
    return sorted(n for n in found if path_exists(spark, f"{folder}/{name}={n}/_SUCCESS"))


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _live(spark: SparkSession, out: str) -> tuple[int, list[str]]:
    """(epoch of the newest fold or -1, folders that hold the state)."""
    upto = max(_numbers(spark, f"{out}/folded", "upto"), default=-1)
    batches = [b for b in _numbers(spark, f"{out}/scored", "batch") if b > upto]
    return upto, [f"{out}/folded/upto={upto}"] * (upto >= 0) + [f"{out}/scored/batch={b}" for b in batches]


def scored_rows(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The latest scored row of each id; None while nothing has been scored."""
    _, folders = _live(spark, out_dir.rstrip("/"))
    if not folders:
        return None
    rows = None
    for f in folders:  # at most FOLD_EVERY batches and a fold
        part = spark.read.parquet(f)
        if "batch" not in part.columns:
            part = part.withColumn("batch", F.lit(int(f.rsplit("=", 1)[1])))
        rows = part if rows is None else rows.unionByName(part)
    return (rows.groupBy("uid").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "uid"]), "batch").alias("_l"))
            .select("uid", "_l.*"))


def fold(spark: SparkSession, out_dir: str, epoch: int, every: int = FOLD_EVERY) -> bool:
    """Write the latest rows up to ``epoch`` as one folder once ``every`` batches lie after the last fold."""
    out = out_dir.rstrip("/")
    upto, folders = _live(spark, out)
    if len(folders) - (upto >= 0) < every:
        return False
    scored_rows(spark, out).write.mode("overwrite").parquet(f"{out}/folded/upto={epoch}")
    for b in _numbers(spark, f"{out}/scored", "batch"):
        if b <= upto:  # readers of the fold before this one do not use them
            _delete(spark, f"{out}/scored/batch={b}")
    for u in _numbers(spark, f"{out}/folded", "upto"):
        if u < upto:
            _delete(spark, f"{out}/folded/upto={u}")
    return True


def current_tables(spark: SparkSession, annotations: DataFrame, out_dir: str, task_id: str, edge_cases: DataFrame | None = None) -> Increment:
    """Annotations and edge cases with every scored row upserted (the latest batch wins per uid), and the registry."""
    rows = scored_rows(spark, out_dir)
    registry = registry_of(spark, f"{out_dir.rstrip('/')}/registry", task_id).rows()
    if rows is None:
        return Increment(annotations, edge_cases, registry)
    rows = rows.drop("is_reannotated", "batch")
    return Increment(upsert_relabelled(annotations, rows), None if edge_cases is None else update_edge_cases(edge_cases, at_rules(rows)), registry)


def current_table(spark: SparkSession, annotations: DataFrame, out_dir: str) -> DataFrame:
    """The annotations of ``current_tables``."""
    rows = scored_rows(spark, out_dir)
    return annotations if rows is None else upsert_relabelled(annotations, rows.drop("is_reannotated", "batch"))
