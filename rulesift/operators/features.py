"""Embeddings, clustering and projection with Spark ML (M2-M5).

Embeddings arrive as ``ARRAY<FLOAT>`` and become ML vectors only inside fits.
Models are Spark ML pipelines saved per (task, round, kind) together with a
fingerprint of their training keys, so they are reused only for the same data
(ledger L25).
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.operators.cache import path_exists
from rulesift.operators.nearest import nearest

TEXT_CLUSTERS = 4
SEED = 42


def with_vector(df: DataFrame, array_col: str = "embedding", out: str = "features") -> DataFrame:
    """Rows with a usable vector only (null embeddings are left out of fits, L11)."""
    return df.where(F.col(array_col).isNotNull()).withColumn(out, array_to_vector(F.col(array_col)))


def fingerprint(df: DataFrame, key: str = "uid") -> str:
    """Order-independent fingerprint of the training keys and their vectors (bounded aggregate): another
    embedding model gives another fit."""
    h = F.xxhash64(F.col(key), *([F.col("embedding")] if "embedding" in df.columns else []))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
               F.sum(F.pmod(h, F.lit(2147483629))).alias("s")).first()
    return f"{r['n']}:{r['x']}:{r['s']}"


def fit_projection(df: DataFrame, k: int = 2, features: str = "features") -> PipelineModel:
    """M4: centre, then PCA to ``k`` dimensions (Spark's PCA does not centre)."""
    pipe = Pipeline(stages=[
        StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_proj"),
    ])
    return pipe.fit(df)


def project(model: PipelineModel, df: DataFrame, names: tuple[str, ...] = ("pca_x", "pca_y")) -> DataFrame:
    out = model.transform(df).withColumn("_pa", vector_to_array("_proj"))
    for i, n in enumerate(names):
        out = out.withColumn(n, F.col("_pa")[i])
    return out.drop("_centred", "_proj", "_pa")


def fit_kmeans(df: DataFrame, n_rows: int, k: int = TEXT_CLUSTERS, seed: int = SEED,
               features: str = "features") -> PipelineModel | None:
    """M2: k-means with k = min(k, n); None when fewer than 2 rows (all cluster 0)."""
    if n_rows < 2:
        return None
    return Pipeline(stages=[KMeans(k=min(k, n_rows), seed=seed, featuresCol=features,
                                   predictionCol="cluster")]).fit(df)


def assign_clusters(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """M3: nearest existing centre (constant 0 without a model)."""
    if model is None:
        return df.withColumn("cluster", F.lit(0))
    return model.transform(df).withColumn("cluster", F.col("cluster").cast("int"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str = "vec_id",
                     vec: str = "embedding", label: str = "label") -> DataFrame:
    """M3: nearest centre by squared distance (compared to nine decimals), ties to the lower label; see ``operators.nearest``."""
    found = nearest(points.select(key, vec), centroids, label, "centroid", vec, digits=9)
    return found.where(F.size("_labels") > 0).select(key, F.col("_labels")[0].cast(centroids.schema[label].dataType).alias("nearest"),
                                                     F.round(F.col("_distances")[0], 6).alias("distance2"))


def centroids_by_label(df: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Per-label mean vector (one partial aggregate per (label, dimension))."""
    e = df.select(label, F.posexplode(vec).alias("pos", "v"))
    m = e.groupBy(label, "pos").agg(F.avg("v").alias("m"))
    return (m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_a"))
            .select(label, F.transform("_a", lambda x: x["m"]).alias("centroid")))


# --- M5: model store -------------------------------------------------------------

def model_path(root: str, task_id: str, round_no: int, kind: str) -> str:
    return f"{root.rstrip('/')}/{task_id}/round={round_no}/{kind}"


def load_or_fit(spark: SparkSession, root: str, task_id: str, round_no: int, kind: str,
                train: DataFrame, fit, key: str = "uid", reuse: bool = False):
    """M5: load the model for (task, round, kind) when its training keys match
    (or ``reuse`` is set); otherwise fit and save it. Returns (model, refitted)."""
    path = model_path(root, task_id, round_no, kind)
    fp = fingerprint(train, key)
    if path_exists(spark, path + "/_fingerprint/_SUCCESS"):  # written after the model
        meta = json.loads(spark.read.text(path + "/_fingerprint").first()[0])
        if reuse or meta.get("fingerprint") == fp:
            return PipelineModel.load(path + "/model"), False
    model = fit(train)
    if model is not None:
        model.write().overwrite().save(path + "/model")
        spark.createDataFrame([(json.dumps({"fingerprint": fp}),)], "value string") \
            .write.mode("overwrite").text(path + "/_fingerprint")
    return model, True
