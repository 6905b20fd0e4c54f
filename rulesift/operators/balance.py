"""Size-constrained clustering of rules by balanced bisection (M8).

There is no size-constrained k-means in Spark, and a flow-based solver is
single-machine with point x centre work, while k grows with n (n div 15 + 1).
Balanced bisection gives the same number of clusters with the same size
limits and full cover, but different shapes: a cell of m rows that must
become p clusters is ordered along its widest coordinate (ties by uid) and
cut after ``(m * (p div 2) + p div 2) div p`` rows; the two halves get
``p div 2`` and ``p - p div 2`` clusters. Sizes end within floor/ceil of n/k,
so for n > 40 they lie in 10..20 and for 21..40 in 5..20.

Up to 20 rules have no size limits and are clustered by k-means.

Coordinates are the rows' centred principal components, all of them unless the caller keeps
fewer, so each cell's widest dimension is one aggregate.

Large cells are split with Spark: one level is a distributed global rank
over (cell, projection, uid) and a per-cell offset (no window over a cell, so
no cell is ever sorted in one task); lineage is cut each level. Cells at or
below ``leaf_rows`` finish in ``applyInPandas`` (one bounded cell per call).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.operators.features import assign_clusters, fit_kmeans, fit_projection, with_vector
from rulesift.operators.ranking import global_row_number
from rulesift.operators.rules import RULES_PER_CLUSTER, SMALL_N, cluster_count
from rulesift.session import cut_lineage

LEAF_ROWS = 20_000


def left_size(m: int, p: int) -> int:
    h = p // 2
    return (m * h + h) // p


def _bisect_leaf(coords: np.ndarray, uids: list[str], base: int, parts: int) -> np.ndarray:
    """Cluster id per row of one cell (numpy; the cell is bounded)."""
    out = np.empty(len(uids), dtype=np.int64)
    stack = [(np.arange(len(uids)), base, parts)]
    while stack:
        idx, b, p = stack.pop()
        if p <= 1 or len(idx) == 0:
            out[idx] = b
            continue
        sub = coords[idx]
        dim = int(np.argmax(sub.max(axis=0) - sub.min(axis=0))) if sub.size else 0
        order = sorted(range(len(idx)), key=lambda i: (sub[i, dim], uids[idx[i]]))
        srt = idx[order]
        cut = left_size(len(idx), p)
        stack.append((srt[:cut], b, p // 2))
        stack.append((srt[cut:], b + p // 2, p - p // 2))
    return out


def balanced_clusters(rules: DataFrame, vec: str = "embedding", uid: str = "uid",
                      k: int | None = None, leaf_rows: int = LEAF_ROWS, max_dims: int | None = None) -> DataFrame:
    """(uid, cluster_id) for one task's rules; k defaults to n div 15 + 1.

    Cells are halved along the widest of all principal coordinates; ``max_dims`` keeps only the
    first ones, for very wide embeddings."""
    spark = rules.sparkSession
    base = with_vector(rules.select(uid, vec), vec, "features")
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], f"{uid} string, cluster_id int")
    if k is None and n <= SMALL_N:  # no size limits: plain k-means
        parts = n // RULES_PER_CLUSTER + 1
        model = fit_kmeans(base, n, k=parts, features="features") if parts > 1 else None
        return cut_lineage(assign_clusters(model, base).select(uid, F.col("cluster").cast("int").alias("cluster_id")))
    parts = k if k is not None else int(spark.range(1).select(cluster_count(F.lit(n))).first()[0])
    wide = len(base.select(vec).first()[0])
    dims = max(1, min(wide if max_dims is None else max_dims, wide, n))
    proj = fit_projection(base, k=dims) if n > 1 else None
    if proj is not None:
        pts = proj.transform(base).select(uid, vector_to_array("_proj").alias("x"))
    else:
        pts = base.select(uid, F.array(F.lit(0.0)).alias("x"))
    # a row's place divides rows that are equal otherwise
    cells = cut_lineage(pts.select(uid, "x", F.lit(0).alias("base"), F.lit(parts).alias("parts"), F.lit(0).cast("bigint").alias("cell"),
                                   F.monotonically_increasing_id().alias("_i")))

    # Spark levels while some cell is larger than a leaf.
    while True:
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.first("parts").alias("parts"))
        big = cut_lineage(sizes.where((F.col("m") > leaf_rows) & (F.col("parts") > 1)))  # fewer than n / leaf_rows rows
        if big.isEmpty():
            break
        d = dims if proj is not None else 1
        spans = cells.join(F.broadcast(big.select("cell")), "cell").groupBy("cell").agg(
            *[(F.max(F.col("x")[i]) - F.min(F.col("x")[i])).alias(f"s{i}") for i in range(d)])
        widest = F.array_position(F.array(*[F.col(f"s{i}") for i in range(d)]),
                                  F.array_max(F.array(*[F.col(f"s{i}") for i in range(d)]))) - 1
        spans = cut_lineage(spans.select("cell", widest.cast("int").alias("dim")))
        at = F.element_at("x", F.col("dim") + 1)
        # only the keys are ranked; the first row of each right half is where its cell is cut
        ranked = global_row_number(cells.join(F.broadcast(spans), "cell").select("cell", at.alias("proj"), uid, "_i"), ["cell", "proj", uid, "_i"], "_g")
        start = ranked.groupBy("cell").agg(F.min("_g").alias("_s"))
        h = F.floor(F.col("parts") / 2)
        cut = F.floor((F.col("m") * h + h) / F.col("parts"))
        cuts = cut_lineage(ranked.join(F.broadcast(start), "cell").join(F.broadcast(big), "cell").where(F.col("_g") - F.col("_s") == cut)
                           .select("cell", F.struct("proj", uid, "_i").alias("_cut")).join(F.broadcast(spans), "cell"))
        left = F.struct(at.alias("proj"), uid, "_i") < F.col("_cut")
        whole = F.col("_cut").isNull()
        cells = cut_lineage(cells.join(F.broadcast(cuts), "cell", "left").select(
            uid, "x",
            F.when(whole | left, F.col("base")).otherwise(F.col("base") + h).cast("int").alias("base"),
            F.when(whole, F.col("parts")).when(left, h).otherwise(F.col("parts") - h).cast("int").alias("parts"),
            F.when(whole, F.col("cell")).otherwise(F.col("cell") * 2 + F.when(left, 1).otherwise(2)).cast("bigint").alias("cell"), "_i"))

    out_schema = T.StructType([T.StructField(uid, T.StringType()), T.StructField("cluster_id", T.IntegerType())])

    def finish(pdf):
        import pandas as pd
        coords = np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
        ids = _bisect_leaf(coords, list(pdf[uid]), int(pdf["base"].iloc[0]), int(pdf["parts"].iloc[0]))
        return pd.DataFrame({uid: pdf[uid], "cluster_id": ids.astype("int32")})

    return cells.drop("_i").groupBy("cell").applyInPandas(finish, out_schema)
