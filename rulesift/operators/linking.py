"""Connected components of similar items, without comparing all pairs of a group.

``components`` labels the nodes of an edge table. ``connect_sets`` finds the components
of sets that are linked by Jaccard similarity, given groups that linked sets share. Partition counts follow the row counts, so small
rounds cost few tasks and large ones spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of (node, label) for each partition of a written round.
ROWS_PER_PARTITION = 200_000
#: Sets in a block of inverted lists, and the parts that a block's queries are divided into.
BLOCK_SETS, QUERY_PARTS = 4096, 16


def _partitions(rows: int, df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the component's smallest node.

    Every node hooks to its smallest neighbour if that is smaller, pointers are
    doubled until they reach the roots, and the edges are redrawn between roots, until
    none is left: logarithmically many rounds, each cut with a reliable checkpoint.
    """
    left = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    labels = None
    while n := left.count():
        parts = _partitions(2 * n, left)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        up = up.coalesce(parts).checkpoint()
        while True:
            over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            new = (up.join(over, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
                   .coalesce(parts).checkpoint())
            up = new.select("node", "p")
            if new.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.withColumnRenamed("p", "label")
        else:
            labels = (labels.join(up.withColumnRenamed("node", "label"), "label", "left")
                      .select("node", F.coalesce("p", "label").alias("label")).coalesce(parts).checkpoint())
        a, b = up.toDF("a", "pa"), up.toDF("b", "pb")
        left = (left.join(a, "a").join(b, "b").where("pa != pb")
                .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct().coalesce(parts).checkpoint())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels


def connect_sets(store: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Labels (cls, label): components of sets whose Jaccard similarity is ``percent`` hundredths or more.

    ``store``: cls, size, hub, elements (distinct; those that no other set has may be left out, ``size`` counts them).
    ``groups``: (sig, cls) so that two linked sets share a group at least. No pairs of a group are listed:

    1. A star: the member with the greatest ``hub`` of each group is compared with the others, which
       connects most of a group of near copies.
    2. Where a group still holds several components, all its members but those of its largest one query the
       members by scanning inverted lists. Members lie in blocks by component, large components in
       several; a query goes to the blocks that its groups lie in, and each block returns one link for each
       query and component. The lists give whole intersections, so the result is exact.
    """
    spark = store.sparkSession
    ends = groups.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("sig")
    groups = groups.join(ends, "sig").select("sig", "cls").distinct().checkpoint()
    n = groups.count()
    labels = store.select("cls", F.col("cls").alias("label"))
    if not n:
        return labels
    parts = _partitions(n, groups)
    sizes = store.select("cls", "size", "hub")
    known = groups.join(sizes, "cls")
    center = known.groupBy("sig").agg(F.max(F.struct("hub", "cls", "size")).alias("c"))
    pairs = (known.join(center, "sig").where("cls != c.cls").where(f"100 * least(size, c.size) >= {percent} * greatest(size, c.size)")
             .select(F.col("c.cls").alias("a"), F.col("cls").alias("b")).distinct())
    found = _confirmed(pairs, store, percent).coalesce(parts).checkpoint()
    labels = _labelled(labels, found).coalesce(parts).checkpoint()

    known = groups.join(labels, "cls").select("sig", "cls", "label").coalesce(parts).checkpoint()
    by_label = known.groupBy("sig", "label").agg(F.count("*").alias("n"))
    largest = (by_label.groupBy("sig").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
               .select("sig", F.col("top.label").alias("top")))
    open_groups = known.join(largest, "sig").coalesce(parts).checkpoint()
    members = open_groups.select("cls", "label").distinct()
    n_members = members.count()
    if not n_members:
        return labels
    # components lie together; one larger than a block is spread over as many as it needs
    blocks = max(1, -(-n_members // BLOCK_SETS))
    own = members.groupBy("label").agg(F.count("*").alias("m"))
    spread = F.ceil(F.col("m") / BLOCK_SETS)
    block = F.pmod(F.xxhash64("label") + F.pmod(F.xxhash64("cls"), spread), F.lit(blocks)).cast("int")
    placed = members.join(own, "label").select("cls", "label", block.alias("block")).coalesce(parts).checkpoint()
    index = (placed.join(store.select("cls", "size", "elements"), "cls").select("block", "cls", "label", "size", "elements"))
    reach = open_groups.select("sig", "cls").join(placed.select("cls", "block"), "cls").groupBy("sig").agg(F.collect_set("block").alias("blocks"))
    queries = (open_groups.where("label != top").select("sig", "cls", "label").join(reach, "sig")
               .groupBy("cls", "label").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
               .select("cls", "label", F.explode("blocks").alias("block"))
               .join(store.select("cls", "size", "elements"), "cls")
               .select("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(QUERY_PARTS)).cast("int").alias("part"), "cls", "label", "size", "elements"))
    packed = "block int, cls binary, label binary, size binary, count binary, elements binary"
    left = index.groupBy("block").applyInArrow(_pack_sets, packed)
    right = (queries.groupBy("block", "part").applyInArrow(_pack_sets, packed)
             .select("block", *(F.col(c).alias(f"q_{c}") for c in ("cls", "label", "size", "count", "elements"))))
    more = left.join(right, "block").mapInArrow(_scan(percent), "a long, b long").checkpoint()
    return _labelled(store.select("cls", F.col("cls").alias("label")), found.union(more)).coalesce(parts).checkpoint()


def _labelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    return (labels.select("cls").join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
            .select("cls", F.coalesce("label", "cls").alias("label")))


def _confirmed(pairs: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    a = store.select(F.col("cls").alias("a"), F.col("size").alias("sa"), F.col("elements").alias("ea"))
    b = store.select(F.col("cls").alias("b"), F.col("size").alias("sb"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return (pairs.join(b, "b").join(a, "a").withColumn("both", both)
            .where(F.col("both") * 100 >= (F.col("sa") + F.col("sb") - F.col("both")) * percent).select("a", "b"))


def _pack_sets(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sets as arrays in one row."""
    elements = table.column("elements").combine_chunks()
    count = np.diff(elements.offsets.to_numpy())
    raw = [np.ascontiguousarray(x).astype("<i8").tobytes() for x in
           (*(table.column(c).to_numpy() for c in ("cls", "label", "size")), count, elements.flatten().to_numpy(zero_copy_only=False))]
    names = ("cls", "label", "size", "count", "elements")
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([r], pa.binary()) for c, r in zip(names, raw)}})


def _scan(percent: int):
    """Queries against a block's inverted lists: one (query, member) link for each query and other component."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: np.frombuffer(v, "<i8") for c, v in batch.slice(i, 1).drop_columns(["block"]).to_pylist()[0].items()}
                owner = np.repeat(np.arange(len(row["cls"])), row["count"])
                order = np.argsort(row["elements"], kind="stable")
                lists, owner = row["elements"][order], owner[order]
                ends = np.cumsum(row["q_count"])
                out: list = [[], []]
                for q, (lo, hi) in enumerate(zip(ends - row["q_count"], ends)):
                    own = row["q_elements"][lo:hi]
                    first = np.searchsorted(lists, own)
                    n = np.searchsorted(lists, own, side="right") - first
                    hit = owner[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
                    both = np.bincount(hit, minlength=len(row["cls"]))
                    ok = np.flatnonzero((both * 100 >= (row["size"] + row["q_size"][q] - both) * percent) & (row["label"] != row["q_label"][q]))
                    _, one = np.unique(row["label"][ok], return_index=True)
                    out[0].append(np.full(len(one), row["q_cls"][q]))
                    out[1].append(row["cls"][ok[one]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["a", "b"])
    return run
