"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Each component of a vector becomes floor(64 * x). Vectors are dealt to blocks by a hash of their id. A
block's index holds its postings (dimension, vector, quantised impact) in segments of descending absolute
impact, then the remainders that quantisation left, and for each vector the length of what is still missing
after each wave of segments.

A block of queries meets a block of the index. Waves of segments are added to the accumulators, highest
impacts first. By Cauchy-Schwarz a true score lies within |q| * |missing part| of its accumulator, so after a
wave the k-th highest lower bound is a proven threshold, and only vectors whose upper bound reaches it can be
among the k best. When those are few for every query the remaining segments are skipped; the
possible members are scored exactly from the integer vectors. If the proof never comes the last wave makes
the accumulators exact. Each block gives its k best for each query, and the k best of all are taken per query.

Queries are a stated set against all rows, in blocks: memory is one index block and one query block a task.

Edge cases: vectors that are null or empty or hold null or non-finite components take no part, as rows
without an id; a query meets only vectors of its own length and no row of its own id; of repeated
rows of one id one is kept (the least vector); equal scores go to the smaller id; a component outside
+-2**20 raises an error; other columns are ignored; no vectors give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulesift.llm import textarrays as T
from rulesift.session import ensure_checkpoint_dir

BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024
#: Queries whose accumulators are held at once.
STRIP = 128
LEVELS = 8
#: Lowest quantised impact of each wave; the remainders follow.
WAVES = (5, 3, 2, 1)
LIMIT = 1 << 20


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): one usable integer vector for each id."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    checked = F.transform(whole, lambda c: F.when(F.abs(c) <= LIMIT, c.cast("int")).otherwise(
        F.raise_error(F.lit("a component is outside +-2**20")).cast("int")))
    finite = F.forall(x, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    return (rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(column, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


_INDEX = "block int, dim int, ids binary, vectors binary, step long, postings array<binary>, missing binary"


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block's impact-ordered segments."""
    ids = table.column("vec_id").to_numpy()
    v = _matrix(table.column("v"), len(ids))
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    step = max(1, -(-int(np.abs(v).max()) // LEVELS))
    impact = (np.abs(v) + step // 2) // step
    quantised = np.sign(v) * impact * step
    rest = v.astype(np.float64)
    waves, missing, above = [], [], np.inf
    for low in WAVES:
        own = (impact >= low) & (impact < above)
        vec, dim = np.nonzero(own)
        order = np.lexsort((vec, dim, -impact[own]))  # segments: descending impact, then dimension
        waves.append(T.pack_many((dim[order], False), (vec[order], False), (quantised[own][order] + (LIMIT << 4), False)))
        rest[own] -= quantised[own]
        missing.append(np.sqrt((rest * rest).sum(1)) * (1 + 1e-6))
        above = low
    vec, dim = np.nonzero(rest)
    waves.append(T.pack_many((dim, False), (vec, False), (rest[vec, dim].astype(np.int64) + (LIMIT << 4), False)))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()),
                     "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([v.astype("<i4").tobytes()], pa.binary()),
                     "step": pa.array([step], pa.int64()), "postings": pa.array([waves], pa.list_(pa.binary())),
                     "missing": pa.array([np.array(missing, "<f4").tobytes()], pa.binary())})


def _query_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    v = _matrix(table.column("v"), len(ids))
    return pa.table({"dim": pa.array([key[1].as_py()], pa.int32()), "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                     "queries": pa.array([v.astype("<i4").tobytes()], pa.binary())})


def search_block(row: dict, k: int):
    """(query ids, vector ids, scores): the k best of one index block for each query of one query block."""
    ids = np.frombuffer(row["ids"], "<i8")
    v = np.frombuffer(row["vectors"], "<i4").reshape(len(ids), -1).astype(np.int64)
    query_ids = np.frombuffer(row["query_ids"], "<i8")
    q = np.frombuffer(row["queries"], "<i4").reshape(len(query_ids), -1).astype(np.int64)
    dims, n = v.shape[1], len(ids)
    missing = np.frombuffer(row["missing"], "<f4").reshape(len(WAVES), n)
    # whole numbers up to 2**24 are exact in single precision
    exact = np.float32 if dims * float(np.abs(v).max(initial=0) + row["step"]) * float(np.abs(q).max(initial=0)) < 1 << 24 else np.float64
    waves = []
    for data in row["postings"]:
        dim, vec, value = T.unpack_many(data)
        m = np.zeros((dims, n), exact)
        m[dim.astype(np.int64), vec.astype(np.int64)] = value.astype(np.int64) - (LIMIT << 4)
        waves.append(m)
    out: list = [[], [], []]
    for a in range(0, len(q), STRIP):
        part = q[a:a + STRIP]
        weights = part.astype(exact)
        norm = np.sqrt((part * part).sum(1)) * (1 + 1e-6)
        own = ids == query_ids[a:a + STRIP][:, None]  # no vector answers itself
        score = np.zeros((len(part), n), exact)
        few = max(4 * k, n // 64)
        for wave, m in enumerate(waves):
            score += weights @ m
            last = wave + 1 == len(waves)
            if wave < 2 or n <= few and not last:
                continue
            width = np.zeros(n, exact) if last else missing[wave].astype(exact)
            low = score - norm[:, None].astype(exact) * width
            low[own] = -np.inf
            at = max(n - 1 - k, 0)  # one more than k: a query's own row may be among them
            threshold = np.partition(low, at, axis=1)[:, at] if n > k else np.full(len(part), -np.inf)
            high = score + norm[:, None].astype(exact) * width * exact(1.0001) + (0 if last else 1)
            possible = (high >= threshold[:, None]) & ~own
            if last or (possible.sum(1) <= few).all():
                break
        who, vec = np.nonzero(possible)
        exact_score = np.einsum("ij,ij->i", part[who], v[vec])
        order = np.lexsort((ids[vec], -exact_score, who))
        who, vec, exact_score = who[order], vec[order], exact_score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < k
        out[0].append(query_ids[a:a + STRIP][who[best]])
        out[1].append(ids[vec[best]])
        out[2].append(exact_score[best])
    return [np.concatenate(x) for x in out]


def top_k(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products of each query."""
    ensure_checkpoint_dir(rows.sparkSession)
    vectors = integer_vectors(rows).withColumn("dim", F.size("v")).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, n_queries = vectors.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("block")
    index = (vectors.select(deal(blocks), "dim", "vec_id", "v").groupBy("block", "dim").applyInArrow(_build, _INDEX).checkpoint())
    queries = (vectors.where("is_query").select(deal(query_blocks), "dim", "vec_id", "v").groupBy("block", "dim")
               .applyInArrow(_query_rows, "dim int, query_ids binary, queries binary")
               .select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, c = search_block(batch.slice(i, 1).to_pylist()[0], k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                                 names=["query_id", "vec_id", "score"])

    # a row for each pair of blocks; so many partitions that each holds one pair or a few
    pairs = index.join(queries, ["block", "dim"]).repartition(min(blocks * query_blocks, 1 << 16), F.xxhash64("query_ids", "block"))
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
