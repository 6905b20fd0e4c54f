"""Filter interaction audit over a sparse document-term matrix.

Words are dictionary-encoded globally: each task sends its distinct word hashes once, they are dealt by their first bits,
sorted and written as files; the id of a word is the rank of its hash. A second pass maps the files and builds compressed
sparse row (CSR) shards: for each document the sorted ids of its words and how often each occurs. The row sums of a shard are the words of
its documents, the nonzero counts their distinct words. The shards are a table in the shared folder (``TermMatrix``).

``audit`` takes five filters over the documents, each a failure condition, and reports for all orders of applying them what each
step removes. Which documents fail which filters decides all orders at once, so documents are counted by the set of filters
they fail (32 sets for five filters) and the orders are computed from these counts.

Identical texts are found by SHA-256. No task gets all copies of a text: rows are counted by (digest, doc_id) first, then by
digest with the count at the smallest doc_id, so a group of copies shrinks to a few rows before it meets.

Words are 64-bit hashes; two words of equal hash would count as one.

Edge cases: null and empty texts have no words (both fail the first two filters' word test as SQL does: 0 < 200, and 0 < 0 is
false) and are identical to each other; a null doc_id is never identical to a smaller one and has no labels; repeated rows are counted each, and
rows of one doc_id are not copies of each other; of several labels of one document any 1 counts; null labels are ignored; a null
``part`` is the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.llm import files
from rulesift.llm import textarrays as T

#: Input bytes whose words make one shard of the dictionary, bytes of text of one CSR shard, and distinct hashes a task holds.
TERM_BYTES, SHARD_BYTES, FLUSH = 8 << 20, 1 << 20, 1 << 20
_ROWS_OUT = 1 << 16
#: Estimates from here on are Spark's default for rows without statistics.
UNKNOWN_SIZE = 1 << 56

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Characters that the symbol filter looks for.
SYMBOLS = "#$%&*|"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Bytes that begin a UTF-8 character.
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


class Terms:
    """The global dictionary: sorted word hashes in files, mapped on first use in a process."""

    def __init__(self, bits: int, parts: list[tuple[int, str, int, int]]):
        """``parts``: (shard, path, place in the file, hashes); the shard is the first ``bits`` bits of a hash."""
        self.bits = bits
        self.parts = {shard: (path, place, n) for shard, path, place, n in parts}
        self.starts, at = {}, 0
        for shard in sorted(self.parts):
            self.starts[shard] = at
            at += self.parts[shard][2]
        self.size = at
        self._maps: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    @staticmethod
    def build(docs: DataFrame, folder: str) -> Terms:
        """Of all words of ``docs.text``, case-sensitive."""
        spark, size = docs.sparkSession, files.size_hint(docs)
        # without statistics (no files behind the rows) Spark's own number of partitions is taken
        by_size = -(-size // TERM_BYTES) if size < UNKNOWN_SIZE else int(spark.conf.get("spark.sql.shuffle.partitions"))
        bits = (max(2 * spark.sparkContext.defaultParallelism, by_size, 2) - 1).bit_length()
        hashes = docs.select("text").mapInArrow(_distinct_hashes, "hash long")
        made = (hashes.repartition(1 << bits, F.shiftrightunsigned("hash", 64 - bits))
                .mapInArrow(_write_terms(folder, bits), "shard long, path string, place long, n long").collect())  # one row a shard
        return Terms(bits, [tuple(r) for r in made])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, all of them in the dictionary."""
        out = np.empty(len(hashes), np.int64)
        shards = (hashes >> T.U64(64 - self.bits)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
        for a, b in zip(heads, [*heads[1:], len(shards)]):
            s = int(shards[a])
            path, place, n = self.parts[s]
            if s not in self._maps:
                self._maps[s] = files.map_array(path, np.uint64, n, 8 * place)
            out[a:b] = self.starts[s] + np.searchsorted(self._maps[s], hashes[a:b])
        return out


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(T.concat(parts))


def _distinct_hashes(batches):
    """The distinct word hashes of a task, each once for about FLUSH of them."""
    def rows(h):
        for at in range(0, len(h), _ROWS_OUT):
            yield pa.RecordBatch.from_arrays([pa.array(h[at:at + _ROWS_OUT].view(np.int64))], names=["hash"])

    held, size = [], 0
    for _, buf, offsets in T.chunks(batches):
        held.append(np.unique(T.word_table(buf, offsets, lower=False)[0]))
        size += len(held[-1])
        if size >= FLUSH:
            held = [_merged(held)]
            size = len(held[0])
            if size >= FLUSH // 2:
                yield from rows(held[0])
                held, size = [], 0
    yield from rows(_merged(held))


def _write_terms(folder: str, bits: int):
    """The hashes of a task's shards, sorted, as one file; a row for each shard says where it is."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(T.U64))
            size += len(held[-1])
            if size >= FLUSH:
                held = [_merged(held)]
                size = 0
        terms = _merged(held)
        if not len(terms):
            return
        path = files.write_bytes(folder, "terms", terms.tobytes())
        shards = (terms >> T.U64(64 - bits)).astype(np.int64)
        some, first, n = np.unique(shards, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([path] * len(some), pa.string()), pa.array(first.astype(np.int64)),
                                          pa.array(n.astype(np.int64))], names=["shard", "path", "place", "n"])
    return run


#: What a shard keeps of each document beside its matrix row.
_DOC = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("n_chars", pa.int64()), ("n_upper", pa.int64()), ("symbol", pa.bool_()),
                  ("digest", pa.binary())])
_SHARD = ("docs array<struct<doc_id: long, part: string, n_chars: long, n_upper: long, symbol: boolean, digest: binary>>, "
          "indptr binary, indices binary, counts binary")


def csr_rows(words: np.ndarray, first: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, sorted ids of each row, counts) of word hashes, ``first`` the first word of each text."""
    distinct, place = np.unique(words, return_inverse=True)
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    # ids rise with the hashes, so (text, place) has the order of (text, id)
    cells, counts = T.counted((text.astype(T.U64) << T.U64(32)) | place.astype(T.U64))
    ids = terms.ids(distinct)[(cells & T.U64(0xFFFFFFFF)).astype(np.int64)]
    indptr = np.searchsorted(cells, np.arange(n + 1).astype(T.U64) << T.U64(32))
    return indptr, ids, counts


def _bytes_of(kind: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are of ``kind`` (a table of 256 flags)."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(kind[buf], offsets[:-1][full], dtype=np.int64)
    return out


def _shards(terms: Terms):
    def run(batches):
        for rows, buf, offsets in T.chunks(batches, size=SHARD_BYTES):
            words, first = T.word_table(buf, offsets, lower=False)
            indptr, ids, counts = csr_rows(words, first, terms)
            total = lambda kind: _bytes_of(kind, buf, offsets)
            data = memoryview(buf)
            docs = pa.StructArray.from_arrays(
                [rows.column(0), rows.column(1), pa.array(total(_LEAD)), pa.array(total(_UPPER)), pa.array(total(_SYMBOL) > 0),
                 pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                fields=list(_DOC))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([T.pack(indptr, True)], pa.binary()),
                 pa.array([_pack_ids(ids, indptr)], pa.binary()), pa.array([T.pack(counts)], pa.binary())],
                names=["docs", "indptr", "indices", "counts"])
    return run


def _pack_ids(ids: np.ndarray, indptr: np.ndarray) -> bytes:
    """Ids of all rows; each but the first of a row as the distance from the one before."""
    gaps = np.diff(ids, prepend=0)
    starts = indptr[:-1][np.diff(indptr) > 0]
    gaps[starts] = ids[starts]
    return T.pack(gaps)


def unpack_ids(data: bytes, indptr: np.ndarray) -> np.ndarray:
    total = np.cumsum(T.unpack(data).astype(np.int64))
    size = np.diff(indptr)
    before = np.concatenate([[0], total])[indptr[:-1]]
    return total - np.repeat(before, size)


def _row_sums(batches):
    """One row a document from the shards: row sums and nonzero counts beside what the shard kept."""
    for b in batches:
        for i in range(b.num_rows):
            docs = b.column(0).slice(i, 1).flatten()
            indptr = T.unpack(b.column(1)[i].as_py()).astype(np.int64)
            counts = T.unpack(b.column(3)[i].as_py()).astype(np.int64)
            sums = np.diff(np.concatenate([[0], np.cumsum(counts)])[indptr])
            yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(sums), pa.array(np.diff(indptr))],
                                             names=[f.name for f in _DOC] + ["n_words", "n_distinct"])


class TermMatrix:
    """CSR shards of a table of texts: a Parquet table, and the dictionary of its columns."""

    def __init__(self, terms: Terms, path: str):
        self.terms, self.path = terms, path

    @staticmethod
    def build(docs: DataFrame, part: Column) -> TermMatrix:
        """Of ``docs`` (doc_id, text); ``part`` is the group a document is counted in."""
        spark = docs.sparkSession
        folder = files.scratch(spark, "term-matrix")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
        terms = Terms.build(rows, folder)
        rows.mapInArrow(_shards(terms), _SHARD).write.parquet(f"{folder}/csr")
        return TermMatrix(terms, f"{folder}/csr")

    def shards(self, spark: SparkSession) -> DataFrame:
        """docs, and indptr, indices and counts as packed arrays (``textarrays.unpack``, ``unpack_ids``)."""
        return spark.read.schema(_SHARD).parquet(self.path)

    def documents(self, spark: SparkSession) -> DataFrame:
        """One row a document: n_words is the sum of its matrix row, n_distinct its nonzero cells."""
        fields = "doc_id long, part string, n_chars long, n_upper long, symbol boolean, digest binary, n_words long, n_distinct long"
        return self.shards(spark).mapInArrow(_row_sums, fields)


#: Failure conditions over the columns of ``TermMatrix.documents``; the last filter, E, is being a copy.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_upper > 3 * n_chars", "D": "symbol"}
COPY = "E"


def failures(documents: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, mask (bit i: fails the i-th filter; the last bit: its text is that of a smaller doc_id), good, toxic and how many rows."""
    mask = sum((F.expr(c).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    by_id = documents.groupBy("digest", "doc_id", "part", mask.alias("mask")).agg(F.count("*").alias("n"))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")))
    # rows without an id are spread by their text instead of meeting at the null key
    spread = F.coalesce("doc_id", F.xxhash64("digest", "part"))
    rows = (by_id.withColumn("spread", spread).join(marks, (F.col("spread") == F.col("labelled")) & F.col("doc_id").isNotNull(), "left")
            .select("digest", "doc_id", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    cells = (rows.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("no_id"))
             .agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")))
    first = F.min("least").over(W.partitionBy("digest"))  # a few rows a digest by now
    single = F.when(F.col("no_id"), F.col("n")).when(F.col("least") == first, F.col("n_least")).otherwise(0)
    return (cells.withColumn("single", single)
            .select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("single").alias("n")),
                                                               F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("single")).alias("n")))).alias("c"))
            .groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("n_good"),
                                                                F.sum(F.col("c.n") * F.col("toxic")).alias("n_toxic")))


def interactions(failed: DataFrame, names: str) -> DataFrame:
    """Every order of the filters ``names``, step by step, from the counts of each set of failed filters."""
    orders = ["".join(p) for p in itertools.permutations(names)]
    bit = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (c, 1 << i)))
    steps = (failed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # a cell for each set
             .select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
             .withColumn("own", bit[F.substring("filter_order", F.col("step"), F.lit(1))])
             .withColumn("before", F.aggregate(F.sequence(F.lit(1), F.lit(len(names))), F.lit(0),
                                               lambda a, k: a + F.when(k < F.col("step"), bit[F.substring("filter_order", k, F.lit(1))]).otherwise(0))))

    def total(of, *tests):
        """Sum of ``of`` over the cells whose mask passes all tests."""
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(
            functools.reduce(lambda x, y: x & y, [t(c["mask"]) for t in tests]), of(c)).otherwise(0))

    own = lambda m: m.bitwiseAND(F.col("own")) != 0
    not_before = lambda m: m.bitwiseAND(F.col("before")) == 0
    n = lambda c: c["n"]
    return steps.select(
        "part", "filter_order", "step",
        total(n, not_before, lambda m: ~own(m)).alias("kept"),
        total(n, not_before, own).alias("removed"),
        total(n, own, lambda m: ~not_before(m)).alias("redundant"),
        total(n, lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda c: c["n_good"], not_before, own).alias("good_lost"),
        total(lambda c: c["n_toxic"], not_before, own).alias("toxic_lost"),
        # of all orders, the filter comes first among those a document fails in one of so many
        total(lambda c: (c["n"] * len(orders) / F.bit_count(c["mask"])).cast("long"), own).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step, for every order of ``filters`` and being a copy."""
    documents = TermMatrix.build(docs, part).documents(docs.sparkSession)
    return interactions(failures(documents, labels, filters), "".join(filters) + COPY)
