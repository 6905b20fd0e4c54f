"""Nearest centres of vectors (M3) without a row for each pair or dimension.

Centres are sorted by their norms and written in blocks to the shared folder. Rows meet them inside Arrow batches as
matrix products; since |x - c| is at least the difference of the norms, blocks of centres whose norms are too far from those of a block of rows
to beat what the rows have already found are skipped, and a task reads only the files it needs, one at a time. The
products only choose candidates, with room for their rounding; the distances of candidates are summed from differences.

Neither centres nor rows pass through the driver; it gets one row of norms for each file.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.session import cut_lineage, shared_path

FILE_NUMBERS = 1 << 21           # numbers of one file of centres: 16 MB as doubles
ROWS, CENTRES = 128, 256         # of one matrix product


@dataclass
class Centres:
    """Centres by rising norm, with their labels."""

    numbers: np.ndarray
    matrix: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(numbers: np.ndarray, matrix: np.ndarray) -> Centres:
        norms = np.sqrt((matrix * matrix).sum(1))
        order = np.argsort(norms, kind="stable")
        return Centres(numbers[order], np.ascontiguousarray(matrix[order]), norms[order])

    def search(self, x: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(squared distances, numbers) of the ``k`` nearest of each row, ascending (inf and -1 where there are fewer), and the
        blocks multiplied. With ``digits`` distances are rounded first, so that near ties go to the lower number."""
        n = len(x)
        d2 = np.full((n, k), np.inf) if best is None else best[0].copy()
        number = np.full((n, k), -1, np.int64) if best is None else best[1].copy()
        norm = np.sqrt((x * x).sum(1))
        order = np.argsort(norm, kind="stable")
        done = 0
        for at in range(0, n, ROWS):
            rows = order[at:at + ROWS]
            lo, hi = norm[rows[0]], norm[rows[-1]]
            starts = np.arange(0, len(self.numbers), CENTRES)
            first, last = self.norms[starts], self.norms[np.minimum(starts + CENTRES, len(self.numbers)) - 1]
            gap = np.maximum(np.maximum(first - hi, lo - last), 0)
            for b in np.argsort(gap, kind="stable"):
                worst = d2[rows, -1].max()
                if gap[b] ** 2 > worst * (1 + 1e-9) + 1e-9:
                    break  # so are all later ones
                c = slice(starts[b], starts[b] + CENTRES)
                self._add(x, rows, norm, c, k, d2, number, digits)
                done += 1
        return d2, number, done

    def _add(self, x, rows, norm, c, k, d2, number, digits):
        own, matrix = x[rows], self.matrix[c]
        size = norm[rows][:, None] ** 2 + self.norms[c][None] ** 2
        rough = size - 2 * own @ matrix.T
        room = 1e-9 * size + 2e-9
        limit = d2[rows, -1]
        if len(matrix) >= k:
            limit = np.minimum(limit, np.partition(rough + room, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(rough - room <= limit[:, None])
        if not len(i):
            return
        difference = own[i] - matrix[j]
        exact = (difference * difference).sum(1)
        if digits is not None:
            exact = np.round(exact, digits)
        # the best k of what a row had and its candidates
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
        dist = np.concatenate([d2[rows].ravel(), exact])
        num = np.concatenate([number[rows].ravel(), self.numbers[c][j]])
        order = np.lexsort((num, dist, row))
        row, dist, num = row[order], dist[order], num[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        d2[rows[row[keep]], place[keep]] = dist[keep]
        number[rows[row[keep]], place[keep]] = num[keep]


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def write_centres(centres: DataFrame, label: str, centre: str) -> list[tuple[float, float, str]]:
    """(least norm, greatest norm, path) of files of centres, sorted by norm; labels are integers."""
    spark = centres.sparkSession
    rows = centres.where(f"{centre} is not null and {label} is not null").select(
        F.col(label).cast("long").alias("label"), F.transform(centre, lambda x: x.cast("double")).alias("centre"))
    rows = cut_lineage(rows.withColumn("norm", F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x))))
    size = rows.agg(F.sum(F.size("centre")).alias("n")).first()[0] or 0
    if not size:
        return []
    path = shared_path(spark, "centres")
    rows.repartitionByRange(max(1, -(-size // FILE_NUMBERS)), "norm").sortWithinPartitions("norm").write.parquet(path)
    made = spark.read.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return sorted((r["lo"], r["hi"], r["path"]) for r in made.collect())  # a row for each file


def _load(uri: str) -> Centres:
    import pyarrow.parquet as pq
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri)
    table = pq.read_table(path, columns=["label", "centre"], filesystem=system)
    return Centres.of(table.column("label").to_numpy(), _vectors(table.column("centre")))


def nearest(points: DataFrame, centres: DataFrame, label: str, centre: str, vec: str, k: int = 1, digits: int | None = None) -> DataFrame:
    """``points`` with ``_labels`` (longs) and ``_distances`` (squared) of the ``k`` nearest centres, nearer first, ties to the lower label
    (fewer, if there are fewer; none for rows without a vector). All vectors have one length and no nulls; labels are distinct integers."""
    files = write_centres(centres, label, centre)
    columns = points.columns
    wide = T.StructType([*points.schema.fields, T.StructField("_labels", T.ArrayType(T.LongType())), T.StructField("_distances", T.ArrayType(T.DoubleType()))])

    def run(batches):
        held: tuple[str, Centres] | None = None
        for b in batches:
            column = b.column(b.schema.get_field_index(vec))
            have = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            x = _vectors(column.take(pa.array(have)))
            best = np.full((len(have), k), np.inf), np.full((len(have), k), -1, np.int64)
            if len(have) and files:
                norm = np.sqrt((x * x).sum(1))
                gap = [max(lo - norm.max(), norm.min() - hi, 0.0) for lo, hi, _ in files]
                for i in np.argsort(gap, kind="stable"):
                    if gap[i] ** 2 > best[0][:, -1].max() * (1 + 1e-9) + 1e-9:
                        break
                    if held is None or held[0] != files[i][2]:
                        held = files[i][2], _load(files[i][2])
                    best = held[1].search(x, k, best, digits)[:2]
            keep = best[1] >= 0
            count = np.zeros(b.num_rows, np.int64)
            count[have] = keep.sum(1)
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns),
                                              pa.ListArray.from_arrays(ends, pa.array(best[1][keep])), pa.ListArray.from_arrays(ends, pa.array(best[0][keep]))],
                                             names=wide.names)

    return points.mapInArrow(run, wide)
