"""Stored rule clusters (M5 for M8): new rules join the clusters of an earlier run, whose sizes keep their limits.

A store holds the members (uid, cluster_id, vector) of each cluster. New rules are placed by bidding:

1. Every unplaced rule bids for the nearest cluster that has room (squared distance to the cluster's stored centre, ties to the lower id).
2. A cluster takes the nearest bidders up to its room (ties to the lower uid); the others bid again, for the next nearest with room.

A round fills a cluster or places all its bidders, so the rounds end. Where rules are left and no cluster has room they are a
misfit: they are clustered on their own (balanced bisection, M8), or, where they are fewer than a cluster's least size, together with the
members of the full cluster that is nearest to most of them. Clusters that get no rule and are not part of a refit keep their id and members.

A rule meets its ``CANDIDATES`` nearest clusters at a time, never all; those whose candidates are all full look further in the next
round, since full clusters are left out of the search.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.operators.balance import balanced_clusters
from rulesift.operators.cache import path_exists
from rulesift.operators.nearest import nearest
from rulesift.operators.rules import LARGE_LIMITS
from rulesift.session import cut_lineage, shared_path

CANDIDATES = 8
SPLITS = 16          # parts in which a cluster's bidders are first reduced to its room


def centres_of(members: DataFrame) -> DataFrame:
    """cluster_id, size, centre: the mean of a cluster's vectors."""
    return (members.groupBy("cluster_id").agg(F.count("*").alias("size"), Summarizer.mean(array_to_vector("embedding")).alias("_m"))
            .select("cluster_id", "size", vector_to_array("_m").alias("centre")))


def bid(new: DataFrame, cells: DataFrame, size_max: int) -> tuple[DataFrame, DataFrame]:
    """(placed (uid, cluster_id), left (uid, embedding)): ``new`` (uid, embedding) into ``cells`` (cluster_id, size, centre)."""
    room = cut_lineage(cells.select("cluster_id", "centre", (F.lit(size_max) - F.col("size")).alias("room")).where("room > 0"))
    left = cut_lineage(new.select("uid", "embedding"))
    placed = left.select("uid", F.lit(0).cast("long").alias("cluster_id")).limit(0)
    spark, folder, rounds = new.sparkSession, shared_path(new.sparkSession, "placed"), 0
    of = lambda numbers: spark.read.schema(placed.schema).parquet(*(f"{folder}/{i}" for i in numbers))
    while not left.isEmpty() and not room.isEmpty():
        found = cut_lineage(nearest(left, room, "cluster_id", "centre", "embedding", k=CANDIDATES)
                            .select("uid", F.posexplode(F.arrays_zip("_labels", "_distances")).alias("place", "c"))
                            .select("uid", "place", F.col("c._labels").alias("cluster_id"), F.col("c._distances").alias("d")))
        free, waiting, first = room.select("cluster_id", "room"), found, rounds
        while not waiting.isEmpty():
            # each rule bids for its first candidate that still has room
            open_bids = waiting.join(free.where("room > 0"), "cluster_id")
            bids = open_bids.groupBy("uid").agg(F.min(F.struct("place", "cluster_id", "d", "room")).alias("b")).select("uid", "b.cluster_id", "b.d", "b.room")
            # a cluster's room is small: reduced in parts first, so that a cluster many bid for is in no single window
            part = W.partitionBy("cluster_id", F.pmod(F.xxhash64("uid"), F.lit(SPLITS))).orderBy("d", "uid")
            some = bids.withColumn("_k", F.row_number().over(part)).where("_k <= room").drop("_k")
            taken = some.withColumn("_k", F.row_number().over(W.partitionBy("cluster_id").orderBy("d", "uid"))).where("_k <= room")
            taken.select("uid", F.col("cluster_id").cast("long").alias("cluster_id")).write.parquet(f"{folder}/{rounds}")
            taken, rounds = of([rounds]), rounds + 1
            if taken.isEmpty():  # nobody's candidates have room
                break
            # all rounds are read as one table, so that every round has the same plan
            used = of(range(first, rounds)).groupBy("cluster_id").agg(F.count("*").alias("_n"))
            free = room.select("cluster_id", "room").join(used, "cluster_id", "left").select("cluster_id", (F.col("room") - F.coalesce("_n", F.lit(0))).cast("int").alias("room"))
            waiting = cut_lineage(waiting.join(taken.select("uid"), "uid", "left_anti"))
        placed = of(range(rounds)) if rounds else placed
        room = cut_lineage(room.drop("room").join(free.where("room > 0"), "cluster_id"))
        left = cut_lineage(left.join(placed.select("uid"), "uid", "left_anti"))
    return placed, left


def assign_new_rules(members: DataFrame, new: DataFrame, limits: tuple[int, int] = LARGE_LIMITS) -> DataFrame:
    """uid, cluster_id, embedding, how: 'stored', 'joined' or 'refit', for the stored ``members`` (uid, cluster_id, embedding) and
    the ``new`` rules (uid, embedding). New rules without a vector, and uids that are stored already, are left out.

    Sizes keep ``limits`` if those of the stored clusters did and there are at least as many rules as a cluster holds at least.
    """
    low, high = limits
    members = cut_lineage(members.select("uid", F.col("cluster_id").cast("long").alias("cluster_id"), "embedding"))
    fresh = cut_lineage(new.where("embedding is not null").join(members.select("uid"), "uid", "left_anti").groupBy("uid").agg(F.min("embedding").alias("embedding")))
    cells = cut_lineage(centres_of(members))
    placed, left = bid(fresh, cells, high)
    joined = placed.join(fresh, "uid").select("uid", "cluster_id", "embedding", F.lit("joined").alias("how"))
    table = cut_lineage(members.withColumn("how", F.lit("stored")).unionByName(joined))
    rest = left.count()
    if not rest:
        return table
    # all clusters are full now: fewer rules than a cluster holds at least share the rows of the full cluster nearest to most of them
    opened: list[int] = []
    if rest < low and not cells.isEmpty():
        near = (nearest(left, cells, "cluster_id", "centre", "embedding").select(F.explode("_labels").alias("cluster_id"))
                .groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").first())
        opened.append(near["cluster_id"])
    again = table.where(F.col("cluster_id").isin(list(opened))).select("uid", "embedding") if opened else table.limit(0).select("uid", "embedding")
    pool = cut_lineage(left.select("uid", "embedding").unionByName(again))
    parts = -(-pool.count() // high)
    last = table.agg(F.max("cluster_id")).first()[0]
    top = 0 if last is None else last + 1
    made = cut_lineage(balanced_clusters(pool, k=parts).select("uid", (F.col("cluster_id") + top).cast("long").alias("cluster_id")))
    refit = made.join(pool, "uid").select("uid", "cluster_id", "embedding", F.lit("refit").alias("how"))
    kept = table.where(~F.col("cluster_id").isin(list(opened))) if opened else table
    return cut_lineage(kept.unionByName(refit))


# --- M5: the clusters of a round as a stored model -------------------------------------

def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the clusters at ``path``, ascending."""
    if not path_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = (s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    numbers = (int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return sorted(n for n in numbers if path_exists(spark, f"{path}/v={n}/_SUCCESS"))


def rule_clusters(vectors: DataFrame, path: str, reuse: bool = False) -> DataFrame:
    """M8 with M5: (uid, cluster_id) of ``vectors`` (uid, embedding), stored as one more version below ``path``.

    With ``reuse`` and a stored version, rules of that version keep their clusters and the others join them (``assign_new_rules``); else all
    are clustered anew. Stored rules that ``vectors`` no longer has are dropped first.
    """
    spark = vectors.sparkSession
    versions = stored_versions(spark, path)
    vectors = cut_lineage(vectors.select("uid", "embedding"))
    if reuse and versions:
        members = spark.read.parquet(f"{path}/v={versions[-1]}").join(vectors.select("uid"), "uid", "left_semi")
        made = assign_new_rules(members, vectors).select("uid", F.col("cluster_id").cast("int").alias("cluster_id"), "embedding")
    else:
        made = balanced_clusters(vectors).join(vectors, "uid").select("uid", "cluster_id", "embedding")
    target = f"{path}/v={versions[-1] + 1 if versions else 0}"
    made.write.mode("overwrite").parquet(target)  # an incomplete version of a job that was stopped is replaced
    return spark.read.parquet(target).select("uid", "cluster_id")
