"""Session helpers: a tuned local session for tests/bench and shared-folder paths.

Library code never picks a machine-local folder. Anything that must be written
(lineage cuts, scratch tables, caches) goes below the folder the cluster names
in ``spark.checkpoint.dir``; only tests and the bench set it, and only when it
is unset.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid as _uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Session settings we rely on at scale; AQE re-plans joins, splits skewed
# partitions and coalesces small ones at run time.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "rulesift") -> SparkSession:
    """Local session for tests and the bench (never used by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in the workers are pickled by module name, so a worker
    needs the package even where the driver was started from another folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="rulesift-ship-")  # Spark serves the file from here until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "rulesift_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("rulesift", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; the package is shipped to the workers with it.

    A scratch folder is made only for a local master, where driver and executors
    are one process. On a cluster an unset folder is an error: executors would
    write checkpoints to disks of their own.
    """
    ship_package(spark)
    current = checkpoint_dir(spark)
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; name a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="rulesift-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return checkpoint_dir(spark) or path


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return str(jdir.get())
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    return None


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared checkpoint folder (never machine-local)."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; rulesift writes scratch tables "
            "only to the shared folder the cluster names there")
    return "/".join([base.rstrip("/"), "rulesift", *parts, _uuid.uuid4().hex])


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table of files in the shared folder (survives executor loss).

    They are computed and written by one job, compressed by column, and later plans read only the columns that they use.
    A row type that Parquet has no place for is checkpointed: it is persisted first, so that the checkpoint's second job
    does not compute the lineage again.
    """
    spark = df.sparkSession
    if not checkpoint_dir(spark):
        raise RuntimeError("spark.checkpoint.dir is not set")
    if _storable(df.schema):
        path = shared_path(spark, "cut")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def _storable(kind: T.DataType) -> bool:
    """Whether Parquet holds rows of this type: named columns that differ in more than case, no void, no interval."""
    if isinstance(kind, T.StructType):
        return 0 < len(kind.names) == len({n.lower() for n in kind.names}) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    if isinstance(kind, T.UserDefinedType):
        return _storable(kind.sqlType())
    return isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) \
        and not isinstance(kind, (T.CharType, T.VarcharType))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
