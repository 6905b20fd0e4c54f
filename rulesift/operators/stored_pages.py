"""A sorted list stored for paging (O6): any page reads one range of rows, not everything before it.

``write_pages`` numbers the rows of a sort once (distributed, exact) and stores them in parts of ``part_rows`` consecutive rows, so a
page's part follows from its number alone. A second table holds each row's number by id, in hash buckets: the selected
row's place is one bucket and one part away.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.functions.text import text_key
from rulesift.operators.explore import PAGE_SIZE, sort_keys
from rulesift.operators.ranking import global_row_number

PART_ROWS, BUCKET_ROWS = 50_000, 1_000_000


def write_pages(df: DataFrame, option: str, path: str, change: str | None = None, ascending: bool = True, part_rows: int = PART_ROWS) -> int:
    """Store ``df`` in the order of a sort option (O1-O4) below ``path``; returns how many rows there are. Rows with equal keys are in the
    order of uid, then of their texts."""
    spark = df.sparkSession
    keyed = sort_keys(df, option, change, ascending).withColumn("_tk", text_key("text_to_annotate"))
    ranked = global_row_number(keyed, ["sort_group", "sort_value", "uid", "_tk"], "page_rank").drop("_tk")
    # tasks hold consecutive ranks already; a part that two of them share has two files
    (ranked.withColumn("part", F.floor((F.col("page_rank") - 1) / part_rows)).sortWithinPartitions("part", "page_rank")
     .write.partitionBy("part").mode("overwrite").parquet(f"{path}/rows"))
    rows = spark.read.schema(ranked.schema).parquet(f"{path}/rows")
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    ranks = rows.where("uid is not null").groupBy("uid").agg(F.min("page_rank").alias("page_rank"))
    ranks.withColumn("bucket", _bucket(F.col("uid"), buckets)).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/ranks")
    meta = {"rows": n, "part_rows": part_rows, "buckets": buckets, "schema": ranked.schema.json()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")  # written last
    return n


def _bucket(uid, buckets: int):
    return F.pmod(F.xxhash64(uid), F.lit(buckets))


class StoredPages:
    """Reads pages of a stored sort."""

    def __init__(self, spark: SparkSession, path: str):
        from pyspark.sql.types import StructType
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        self.rows, self.part_rows, self.buckets = meta["rows"], meta["part_rows"], meta["buckets"]
        self.schema = StructType.fromJson(json.loads(meta["schema"]))

    def between(self, first: int, last: int) -> DataFrame:
        """The rows numbered ``first`` to ``last``; reads only their parts."""
        first, last = max(first, 1), min(last, self.rows)
        if first > last:
            return self.spark.createDataFrame([], self.schema)
        parts = range((first - 1) // self.part_rows, (last - 1) // self.part_rows + 1)
        return (self.spark.read.schema(self.schema).parquet(*(f"{self.path}/rows/part={p}" for p in parts))
                .where(F.col("page_rank").between(first, last)))

    def rank(self, uid: str) -> int | None:
        """The number of a row's place; None for an unknown id."""
        b = self.spark.range(1).select(_bucket(F.lit(uid), self.buckets)).first()[0]
        ranks = self.spark.read.schema("uid string, page_rank long, bucket long").parquet(f"{self.path}/ranks")
        found = ranks.where((F.col("bucket") == b) & (F.col("uid") == uid)).first()
        return None if found is None else found["page_rank"]

    def page(self, number: int, pinned_uid: str | None = None, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 1), and the selected row where it lies on another page."""
        first, last = (number - 1) * size + 1, number * size
        rows = self.between(first, last)
        place = self.rank(pinned_uid) if pinned_uid is not None else None
        if place is None or first <= place <= last:
            return rows
        return rows.unionByName(self.between(place, place))
