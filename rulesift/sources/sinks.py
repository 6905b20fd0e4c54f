"""Writing results (S4-S7) and the export metadata row."""

from __future__ import annotations

import datetime as _dt
import json
import uuid as _uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulesift.operators.explore import nan_to_null


def write_round(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results partitioned by task and round; rewriting a round replaces
    only that round's partition (dynamic overwrite)."""
    w = (df.write.partitionBy("task_id", "round").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic"))
    if fmt == "csv":
        # blanks around texts are kept, and quotes are doubled as readers expect
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)


def write_snapshot(df: DataFrame, path: str) -> str:
    """A timestamped JSON snapshot; NaN / infinities become null first.

    No two snapshots share a name, whatever the clock's resolution, and none is overwritten."""
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    out = f"{path.rstrip('/')}/snapshot_{stamp}_{_uuid.uuid4().hex[:8]}"
    nan_to_null(df).write.option("ignoreNullFields", False).mode("error").json(out)
    return out


def write_guideline(guidelines: DataFrame, path: str) -> None:
    """Each task's complete guideline as text (one folder per task)."""
    guidelines.select("task_id", "guideline").write.partitionBy("task_id").mode("overwrite").text(path)


def export_metadata(task_id: str, round_no: int, **sections: DataFrame) -> DataFrame:
    """One row of counts per export section (one tagged union, one aggregate)."""
    parts = None
    for name, df in sections.items():
        p = df.select(F.lit(name).alias("_s"))
        parts = p if parts is None else parts.unionByName(p)
    aggs = [F.count_if(F.col("_s") == n).alias(n) for n in sections]
    row = parts.agg(*aggs)
    return row.select(F.lit(task_id).alias("task_id"), F.lit(round_no).alias("round"), *sections.keys())


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table's rows in any order: hashes of whole rows summed modulo two numbers, partial sums merge."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))) if df.columns else F.lit("")
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(i), row), F.lit(p))) % p for i, p in ((1, 2147483629), (2, 2147483587))]
    r = df.agg(F.count("*").alias("n"), F.concat_ws("-", *(x.cast("string") for x in sums)).alias("d")).first()
    return r["n"], r["d"]


def export_bundle(path: str, task_id: str, round_no: int, **sections: DataFrame) -> DataFrame:
    """One folder per section plus a one-row metadata table; never one giant JSON document.

    The manifest, written last, holds for each section its rows, schema and the digest of what was written, and the time of the
    export; ``verify_bundle`` checks a bundle against it. Sections are any tables: annotations, edge cases, rules, guideline,
    saved rules, history, earlier rounds."""
    base = path.rstrip("/")
    spark = next(iter(sections.values())).sparkSession
    rows = []
    for name, df in sections.items():
        clean = nan_to_null(df)
        clean.write.mode("overwrite").parquet(f"{base}/{name}")
        stored = spark.read.schema(clean.schema).parquet(f"{base}/{name}")
        rows.append((name, *table_digest(stored), clean.schema.json()))
    meta = export_metadata(task_id, round_no, **sections)
    meta.write.mode("overwrite").json(f"{base}/metadata")
    now = _dt.datetime.now(_dt.timezone.utc)
    (spark.createDataFrame([(task_id, round_no, now, *r) for r in rows], MANIFEST).coalesce(1)  # a row for each section
     .write.mode("overwrite").json(f"{base}/manifest"))
    return meta.sparkSession.read.schema(meta.schema).json(f"{base}/metadata")


MANIFEST = "task_id string, round int, exported_at timestamp, section string, rows long, digest string, schema string"


def read_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One section of a bundle as it was exported."""
    found = read_manifest(spark, path).where(F.col("section") == section).first()
    if found is None:
        raise ValueError(f"the bundle at {path} has no section {section!r}")
    return spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(f"{path.rstrip('/')}/{section}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """section, rows (as exported), found_rows, intact: whether a section's rows are those that were exported; a section whose
    folder is gone or can't be read has null found_rows."""
    out = []
    for r in read_manifest(spark, path).collect():  # a row for each section
        try:
            n, digest = table_digest(read_section(spark, path, r["section"]))
        except PySparkException:
            n, digest = None, None
        out.append((r["section"], r["rows"], n, n == r["rows"] and digest == r["digest"]))
    return spark.createDataFrame(out, "section string, rows long, found_rows long, intact boolean")
