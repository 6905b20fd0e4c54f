"""Reading texts and earlier results (S1-S3), cleaning (P1, P2) and input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.functions.text import clean_text, guideline_label_lines, guideline_task, text_key, ws_trim

TEXT_COLUMN = "text_to_annotate"


def read_texts_csv(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """Texts from CSV files with a header row.

    Header names are matched after trimming and lower-casing; quoted fields may
    hold newlines and ``""`` is an escaped quote. Rows get a 0-based
    ``ordinal`` in file order (files by path, rows by position): rows of one
    file are contiguous inside a read partition, so the position is the
    distance from the file's first row; file offsets come from a per-file
    count (one row per file), so no global window is used.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
           .option("enforceSchema", False)  # a file with other columns is an error, not read by position
           .csv(path))
    by_name = {c.strip().lower(): c for c in raw.columns}
    if TEXT_COLUMN not in by_name:
        raise ValueError(f"CSV must have a '{TEXT_COLUMN}' column; found {raw.columns}")
    if raw.limit(1).count() == 0:
        raise ValueError(f"CSV at {path} has a header but no data row")
    rows = raw.select(F.col(f"`{by_name[TEXT_COLUMN]}`").alias(TEXT_COLUMN),
                      F.col("_metadata.file_path").alias("_file"),
                      F.monotonically_increasing_id().alias("_mid"))
    files = rows.groupBy("_file").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per input file: a window over the file list is small.
    files = files.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(F.broadcast(files.select("_file", "_first", "_offset")), "_file")
    return out.select(F.lit(task_id).alias("task_id"),
                      (F.col("_offset") + F.col("_mid") - F.col("_first")).alias("ordinal"),
                      TEXT_COLUMN)


def _cleaned(examples: DataFrame, text: str, key: str) -> DataFrame:
    return (examples.select("task_id", "ordinal", clean_text(text).alias(text))
            .where(F.col(text).isNotNull() & (F.length(text) > 0))
            .withColumn(key, text_key(text)))


def clean_examples(examples: DataFrame, text: str = TEXT_COLUMN, key: str | None = None) -> DataFrame:
    """P1 + P2: trim, strip control characters, drop blanks, keep the first of
    exact duplicates in file order (per task).

    "First" is ``min(ordinal)`` and ``min_by(text, ordinal)`` per (task, text
    digest): declarative aggregates combined map-side, so a text repeated in a
    third of all rows is reduced before the shuffle, in one pass over the data.
    ``key`` names a column that keeps the digest.
    """
    by = key or "_tk"
    return (_cleaned(examples, text, by).groupBy("task_id", by)
            .agg(F.min("ordinal").alias("ordinal"), F.min_by(text, "ordinal").alias(text))
            .select("task_id", "ordinal", text, *([key] if key else [])))


def cleaned_keys(examples: DataFrame, text: str = TEXT_COLUMN, key: str = "text_key") -> DataFrame:
    """The digests of the texts that ``clean_examples`` keeps; texts do not move."""
    return _cleaned(examples, text, key).select(key)


def input_report(examples: DataFrame, guidelines: DataFrame, text: str = TEXT_COLUMN) -> DataFrame:
    """One row of violation counts per task (raise on request).

    Checks: examples present and non-blank, task id present, task text
    present in the guideline, at least one label (one label is a warning).
    """
    ex = examples.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.col(text).isNull() | (F.length(ws_trim(text)) == 0)).alias("blank_examples"))
    g = guidelines.select(
        "task_id",
        F.length(guideline_task("guideline")).alias("_task_len"),
        F.size(guideline_label_lines("guideline")).alias("labels"))
    j = ex.join(g, "task_id", "full_outer")
    return j.select(
        "task_id",
        F.coalesce(F.col("examples"), F.lit(0)).alias("examples"),
        F.coalesce(F.col("blank_examples"), F.lit(0)).alias("blank_examples"),
        F.coalesce(F.col("labels"), F.lit(0)).alias("labels"),
        (F.col("task_id").isNull() | (F.length(ws_trim("task_id")) == 0)).alias("missing_task_id"),
        F.coalesce(F.col("_task_len") == 0, F.lit(True)).alias("missing_task_text"),
        (F.coalesce(F.col("examples"), F.lit(0)) == 0).alias("no_examples"),
        (F.coalesce(F.col("labels"), F.lit(0)) < 1).alias("too_few_labels"),
        (F.coalesce(F.col("labels"), F.lit(0)) == 1).alias("one_label_warning"),
    )


def raise_on_violations(report: DataFrame) -> None:
    """Fail fast with the first violating task (one small aggregate).

    Blank examples are reported, not fatal: cleaning (P2) drops them.
    """
    bad = report.where("missing_task_id OR missing_task_text OR no_examples OR too_few_labels"
                       ).limit(1).collect()
    if bad:
        raise ValueError(f"input check failed: {bad[0].asDict()}")


def read_round(spark: SparkSession, path: str, task_id: str, round_no: int,
               schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """One task's round from a table partitioned by ``task_id`` / ``round``
    (partition pruning keeps the scan to that folder). ``fmt`` as for ``write_round``; CSV needs the schema."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV round is read by a declared schema")
        # the columns of the folders' names are not in the files
        inside = T.StructType([f for f in schema.fields if f.name not in ("task_id", "round")] + [f for f in schema.fields if f.name in ("task_id", "round")])
        reader = spark.read.schema(inside).option("header", True).option("escape", '"').option("multiLine", True).option("lineSep", "\n")
        return reader.csv(path).where((F.col("task_id") == task_id) & (F.col("round") == round_no))
    return reader.parquet(path).where((F.col("task_id") == task_id) & (F.col("round") == round_no))


# --- S3 -------------------------------------------------------------------------

_ROW = T.StructType([
    T.StructField("text_to_annotate", T.StringType()), T.StructField("uid", T.StringType()),
    T.StructField("edge_case_id", T.DoubleType()), T.StructField("pca_x", T.DoubleType()),
    T.StructField("pca_y", T.DoubleType()), T.StructField("raw_annotations", T.StringType()),
    T.StructField("analyses", T.StringType()), T.StructField("annotation", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("guideline_improvement", T.StringType()),
])
_SUGG = T.MapType(T.StringType(), T.StringType())


def read_cluster_results(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: cluster-result JSON documents in any of the three shapes.

    * object ``{"suggestions": {...}, "improvement_clusters": [...]}``
    * pair ``[{...suggestions...}, [...rows...]]``
    * single ``[{"suggestions": {...}}]``

    With ``lines=False`` each file is one document (pretty-printed JSON, one
    task's result per file; files are read in parallel). With ``lines=True``
    every line is a document, so large collections split across tasks.
    Returns ``(rules, edge_cases)``: ``rules(file, doc_no, rule_key, rule)``
    and the rows with their file and document number.
    """
    docs = spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.xxhash64("value").alias("doc_no"), F.col("value").alias("doc")).drop("_blk")
    obj = F.from_json("doc", T.StructType([
        T.StructField("suggestions", _SUGG), T.StructField("improvement_clusters", T.ArrayType(_ROW))]))
    pair_s = F.from_json(F.get_json_object("doc", "$[0]"), _SUGG)
    pair_r = F.from_json(F.get_json_object("doc", "$[1]"), T.ArrayType(_ROW))
    single = F.from_json(F.get_json_object("doc", "$[0].suggestions"), _SUGG)
    is_obj = F.ltrim("doc").startswith("{")
    sugg = F.when(is_obj, obj["suggestions"]).when(single.isNotNull(), single).otherwise(pair_s)
    rows = F.when(is_obj, obj["improvement_clusters"]).when(single.isNotNull(), F.lit(None)) \
        .otherwise(pair_r)
    parsed = docs.select("file", "doc_no", sugg.alias("_s"), rows.alias("_r"))
    rules = parsed.select("file", "doc_no", F.explode("_s").alias("rule_key", "rule"))
    edge = parsed.select("file", "doc_no", F.explode("_r").alias("_x")).select("file", "doc_no", "_x.*")
    return rules, edge
