"""Exact global numbering without a single-partition window.

``row_number() over (order by k)`` with no partition moves every row into one
task. Instead: range-partition on the keys and sort inside partitions, number
rows per partition (Arrow batches, in order), cut lineage with a reliable
checkpoint so the range bounds are fixed, then add each partition's offset.
Only the per-partition counts (one number per partition) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.session import cut_lineage


ROWS_PER_PARTITION, PARTITION_BYTES = 1_000_000, 64 << 20


def _row_bytes(df: DataFrame):
    """About how many bytes a row has, from the lengths of its strings and lists."""
    def of(f):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        if isinstance(f.dataType, T.ArrayType):
            return 8 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
        return F.lit(8)
    return sum((of(f) for f in df.schema.fields), F.lit(0)).cast("long")


def global_row_number(df: DataFrame, order: list[str], out: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over a total order (ties are in any order).

    Range partitions hold at most about a million rows and ``PARTITION_BYTES`` each, however many that makes (one
    aggregate sizes them); rows with equal keys may lie in several.
    """
    spark = df.sparkSession
    by = list(order)
    if partitions:
        n = partitions
    else:
        # the aggregate, the bounds and the sort read the same rows once computed, so that the row's place can divide equal keys
        df = cut_lineage(df).withColumn("_place", F.monotonically_increasing_id())
        by.append("_place")
        rows, size = df.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
        n = max(1, -(-rows // ROWS_PER_PARTITION), -(-size // PARTITION_BYTES))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_place")
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_pid", T.IntegerType(), False), T.StructField("_ln", T.LongType(), False)])

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        seen = 0
        for b in batches:
            own = [pa.array([pid] * b.num_rows, pa.int32()), pa.array(range(seen + 1, seen + 1 + b.num_rows), pa.int64())]
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "_pid", "_ln"])

    local = cut_lineage(ranged.mapInArrow(number, schema))
    counts = {r["_pid"]: r["_n"] for r in
              local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()}
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return (local.join(F.broadcast(off), "_pid")          # one row per partition
            .withColumn(out, (F.col("_off") + F.col("_ln")).cast("bigint"))
            .drop("_pid", "_ln", "_off"))
