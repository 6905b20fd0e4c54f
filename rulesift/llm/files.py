"""Files in the shared folder, read and written by tasks, and sizes for planning.

The folder is the one the cluster names in ``spark.checkpoint.dir``. A task
writes under a name of its own, so a retried or duplicate task never touches the
file of another; only names returned by successful tasks are read.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rulesift.session import ensure_checkpoint_dir


def size_hint(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df`` (the scanned files' size); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards_for(df: DataFrame, bytes_each: int, most: int = 1 << 16) -> int:
    """How many shards keep each near ``bytes_each`` of input: a power of two, at
    least twice the cores, so that a shard's memory does not grow with the input."""
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    want = max(least, -(-min(size_hint(df), bytes_each * most) // bytes_each), 2)
    return 1 << (int(want) - 1).bit_length()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared folder; the driver removes it when it exits."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, folder)
    return folder


def _forget(folder: str) -> None:
    with contextlib.suppress(OSError):  # gone with the shared folder, or out of reach at the end
        delete(folder)


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri if uri.startswith("/") else uri)


def write_bytes(folder: str, name: str, *parts) -> str:
    """Write one file under a name no other attempt uses; returns its address."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, path = _open(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)
    return uri


def read_bytes(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def delete(uri: str) -> None:
    """Remove a file or folder this library wrote, if it is there."""
    from pyarrow import fs
    system, path = _open(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def map_array(uri: str, dtype, count: int, offset: int = 0) -> np.ndarray:
    """Memory-map an array of a shared file.

    On a mounted folder the file itself is mapped. From other stores it is copied
    to an unnamed temporary file first, which goes when the mapping goes.
    """
    if not count:
        return np.zeros(0, dtype)
    from pyarrow import fs
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", offset, (count,))
    with tempfile.TemporaryFile() as own, system.open_input_stream(path, compression=None) as f:
        while block := f.read(1 << 22):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype, "r", offset, (count,))
