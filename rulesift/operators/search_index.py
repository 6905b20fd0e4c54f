"""Substring search over stored rows (P8) by trigrams: postings choose blocks of rows, the rows themselves decide.

Rows are stored in blocks of about ``block_rows``; postings say which blocks hold which three characters in a row (lower-cased, in any
searched column). A term of three characters or more can only be in blocks that hold all its trigrams. Texts are padded, so that every character and every
pair begins a trigram too: shorter terms look up all trigrams that begin with them. Postings are partitioned by a hash of the trigram's first
character, so a lookup reads few of them; rows are partitioned by groups of blocks. What the postings let through is checked by ``explore.search``:
the result is the same as without an index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.operators.explore import search

BLOCK_ROWS, GROUP_BLOCKS, BUCKETS = 256, 512, 64
COLUMNS = ("text_to_annotate", "analyses", "raw_annotations")
#: Bits of a code point in a packed trigram.
_BITS = 21
_SHIFT = np.array([1 << 2 * _BITS, 1 << _BITS, 1], np.int64)


def _bucket(first: Column) -> Column:
    return F.pmod(F.xxhash64(first), F.lit(BUCKETS)).cast("int")


def _group(block: str = "block") -> Column:
    return F.concat(F.shiftright(block, 32).cast("string"), F.lit("-"), F.floor(F.col(block).bitwiseAND(F.lit((1 << 32) - 1)) / GROUP_BLOCKS).cast("string"))


def trigrams(text: str) -> np.ndarray:
    """Distinct packed trigrams of a lower-cased text with two null characters behind it."""
    points = np.frombuffer((text + "\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] * _SHIFT[0] + points[1:-1] * _SHIFT[1] + points[2:] * _SHIFT[2])


def _number(block_rows: int):
    """Deal the rows of a task to blocks of its own."""
    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        seen = 0
        for b in batches:
            block = first + (seen + np.arange(b.num_rows)) // block_rows
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=[*b.schema.names, "block"])
    return run


def _postings(batches):
    """(trigram, block) pairs, each once for a batch's rows."""
    for b in batches:
        blocks = b.column(0).to_numpy()
        for block in np.unique(blocks):
            found = [trigrams(t) for c in b.columns[1:] for t in c.filter(pa.array(blocks == block)).to_pylist() if t]
            if found:
                own = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block))], names=["trigram", "block"])


def build(df: DataFrame, path: str, cols: tuple[str, ...] = COLUMNS, block_rows: int = BLOCK_ROWS) -> None:
    """Store ``df`` with its postings below ``path``."""
    spark = df.sparkSession
    cols = tuple(c for c in cols if c in df.columns)
    kind = T.StructType([*df.schema.fields, T.StructField("block", T.LongType())])
    (df.mapInArrow(_number(block_rows), kind).withColumn("block_group", _group())
     .write.partitionBy("block_group").mode("overwrite").parquet(f"{path}/rows"))
    # from the stored rows: a task that ran twice may have dealt its rows differently
    stored = spark.read.parquet(f"{path}/rows").select("block", *(F.lower(F.col(c)).alias(c) for c in cols))
    pairs = stored.mapInArrow(_postings, "trigram long, block long").distinct()
    (pairs.withColumn("bucket", _bucket(F.shiftright("trigram", 2 * _BITS)))
     .repartition("bucket").sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings"))


class SearchIndex:
    """Searches rows that ``build`` has stored."""

    def __init__(self, spark: SparkSession, path: str, cols: tuple[str, ...] = COLUMNS):
        self.spark, self.path, self.cols = spark, path, cols

    def blocks(self, term: str) -> DataFrame:
        """block: those that may hold a lower-cased term of one character or more."""
        points = [ord(c) for c in term]
        postings = self.spark.read.schema("trigram long, block long, bucket int").parquet(f"{self.path}/postings")
        if len(points) < 3:
            low = sum(p << _BITS * (2 - i) for i, p in enumerate(points))
            high = low + (1 << _BITS * (3 - len(points)))
            return postings.where((F.col("bucket") == self._buckets(points[:1])[0]) & F.col("trigram").between(low, high - 1)).select("block").distinct()
        wanted = sorted({sum(p << _BITS * (2 - i) for i, p in enumerate(points[at:at + 3])) for at in range(len(points) - 2)})
        hits = postings.where(F.col("bucket").isin(self._buckets(points[:-2])) & F.col("trigram").isin(wanted))
        return hits.groupBy("block").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted)).select("block")

    def _buckets(self, points: list[int]) -> list[int]:
        """Partitions of the trigrams that begin with these characters."""
        return [r[0] for r in self.spark.createDataFrame([(p,) for p in points], "p long").select(_bucket(F.col("p"))).distinct().collect()]

    def search(self, term: str) -> DataFrame:
        """The rows that ``explore.search`` finds in the table that was stored; a blank term finds all of them."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if term.strip():
            rows = rows.join(self.blocks(term.lower()).withColumn("block_group", _group()), ["block_group", "block"], "left_semi")
        return search(rows.drop("block", "block_group"), term, self.cols)

