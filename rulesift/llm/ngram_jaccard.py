"""N-gram Jaccard join: components of documents whose shingle sets overlap by a share.

Size-aware heavy-light join:

1. Documents with equal sets become one class (a 64-bit key of the set).
2. Every task sends its classes' shingles, as sorted packed hashes, to the shard of
   the hash. Hashes held by one class only can't make a link and stop there; the
   others go back to their class with the number of classes that hold them.
3. A class of s shingles links only to sets with which it shares at least
   ceil(s * 3/4) of them, so a class with fewer shared shingles is alone. For the
   others, rarest shingles first: two linked sets share at least one of the first
   ``m - need + 1`` of their m shared shingles, and at least two of the first ``m - need + 2``.
4. Light sets (up to a boundary size) enumerate all 2-subsets of that longer prefix;
   a set above the boundary scans the inverted lists of its shorter prefix, which also
   hold the light sets large enough to link with it. The boundary minimises the summed
   cost, subsets against list lengths, over size classes.
5. Candidates that share a subset or a list are not listed as pairs. A star per group (its most shared member
   against the others) connects near copies; where a group still holds several components, all but its
   largest one scan the inverted lists of the others' blocks (``operators.linking``). So every link either is
   verified or lies between classes already connected.

Verification is exact on the shared shingles' hashes (64-bit words, 40 bits and the
shard of each shingle): intersection sizes of at least 75 of 100 parts of the union.

Edge cases: null and empty texts and texts without words have no shingles and link with
nothing; fewer words than the width give one shingle of all words; repeated rows
are each returned, linked through their equal sets; a null ``doc_id`` is smaller than
all others and is returned as null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm import files
from rulesift.llm import textarrays as T
from rulesift.operators.linking import connect_sets
from rulesift.session import ensure_checkpoint_dir

FLUSH_SHINGLES = 3_000_000
SHARD_BYTES = 12 << 20
#: Bits of a shingle's hash kept beside the shard.
KEPT_BITS = 40
#: Cost of comparing two sets, in rows of an index.
COMPARE_COST = 8


def need(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection a set of this size can have with a linked set."""
    return (sizes * percent + 99) // 100


def _sets(buf: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct shingles of each text: (hash, text), sizes and class keys."""
    words, first = T.word_table(buf, offsets)
    shingle, text = T.windows(words, first, width)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    if len(shingle):
        keep = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])])
        shingle, text = shingle[keep], text[keep]
    n = len(offsets) - 1
    sizes = np.bincount(text, minlength=n)
    total = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mix(shingle ^ T.U64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    keys = T.mix(total[ends] - total[ends - sizes] + sizes.astype(T.U64))
    return shingle, text, sizes, keys


def _documents(width: int):
    def run(batches):
        for rows, buf, offsets in T.chunks(batches):
            _, _, sizes, keys = _sets(buf, offsets, width)
            yield pa.RecordBatch.from_arrays(
                [T.arrow_ids(T.column_ids(rows)), pa.array(sizes, pa.int64()), pa.array(keys.view(np.int64), mask=sizes == 0)],
                names=["doc_id", "n_shingles", "cls"])
    return run


def _postings(width: int, bits: int):
    """Packed (hash, class) postings by shard; equal sets within a flush are sent once."""
    def run(batches):
        held: list = []
        seen, n = np.zeros(0, T.U64), 0
        for _, buf, offsets in T.chunks(batches):
            shingle, text, sizes, keys = _sets(buf, offsets, width)
            distinct, where = np.unique(keys, return_index=True)
            new = np.zeros(len(keys), bool)
            new[where[~np.isin(distinct, seen)]] = True
            new &= sizes > 0
            seen = np.concatenate([seen, keys[new]])
            sel = new[text]
            held.append((shingle[sel], keys[text[sel]], sizes[text[sel]]))
            n += int(sel.sum())
            if n >= FLUSH_SHINGLES:
                yield from _send(held, bits)
                held, seen, n = [], np.zeros(0, T.U64), 0
        if n:
            yield from _send(held, bits)
    return run


def _send(held: list, bits: int) -> Iterator[pa.RecordBatch]:
    shingle = np.concatenate([h[0] for h in held])
    order = np.argsort(shingle)
    shingle = shingle[order]
    keys = np.concatenate([h[1] for h in held])[order]
    sizes = np.concatenate([h[2] for h in held])[order]
    cuts = np.searchsorted((shingle >> T.U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    kept = (shingle >> T.U64(64 - bits - KEPT_BITS)) & T.U64((1 << KEPT_BITS) - 1)
    for s in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[s], cuts[s + 1])
        own, where, place = np.unique(keys[part], return_index=True, return_inverse=True)
        payload = T.pack_many((own, True), (sizes[part][where], False), (kept[part], True), (place, False))
        yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "payload"])


def _shared(bits: int):
    """Of a shard of hashes: those that two or more classes hold, sent to the shards of the classes."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [T.unpack_many(c.as_py()) for c in table.column("payload")]
        kept = np.concatenate([p[2] for p in parts])
        order = np.argsort(kept, kind="stable")
        ordered = kept[order]
        more = np.zeros(len(kept), bool)
        same = ordered[1:] == ordered[:-1]
        more[1:] |= same
        more[:-1] |= same
        order = order[more]
        # (hash, class) once, then how many classes hold the hash
        base = np.cumsum([0, *(len(p[2]) for p in parts)])
        keys, sizes = np.empty(len(order), T.U64), np.empty(len(order), T.U64)
        part = np.searchsorted(base, order, side="right") - 1
        by_part = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by_part], np.arange(len(parts) + 1))
        for i, p in enumerate(parts):
            at = by_part[cuts[i]:cuts[i + 1]]
            own = p[3][order[at] - base[i]].astype(np.int64)
            keys[at], sizes[at] = p[0][own], p[1][own]
        kept = kept[order]
        del parts
        order = np.lexsort((keys, kept))
        kept, keys, sizes = kept[order], keys[order], sizes[order]
        if len(kept):
            once = np.concatenate([[True], (kept[1:] != kept[:-1]) | (keys[1:] != keys[:-1])])
            kept, keys, sizes = kept[once], keys[once], sizes[once]
        distinct, place, df = np.unique(kept, return_inverse=True, return_counts=True)
        df = df[place]
        ok = df >= 2
        full = kept[ok] | T.U64(key[0].as_py() << KEPT_BITS)
        keys, sizes, df = keys[ok], sizes[ok], df[ok]
        order = np.argsort(keys, kind="stable")
        full, keys, sizes, df = full[order], keys[order], sizes[order], df[order]
        cuts = np.searchsorted((keys >> T.U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        shards = np.flatnonzero(np.diff(cuts))
        out = []
        for s in shards:
            a = slice(cuts[s], cuts[s + 1])
            own, where, n = np.unique(keys[a], return_index=True, return_counts=True)
            out.append(T.pack_many((own, True), (sizes[a][where], False), (n, False), (full[a], False), (df[a], False)))
        return pa.table({"shard": pa.array(shards, pa.int32()), "payload": pa.array(out, pa.binary())})
    return run


_STORE = "cls long, size long, elements array<long>, prefix array<long>, hub double"


def _store(percent: int):
    """Classes that can link at all, with their shared shingles and the rarest of them."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [T.unpack_many(c.as_py()) for c in table.column("payload")]
        keys = np.concatenate([np.repeat(p[0], p[2].astype(np.int64)) for p in parts])
        sizes = np.concatenate([np.repeat(p[1], p[2].astype(np.int64)) for p in parts]).astype(np.int64)
        full = np.concatenate([p[3] for p in parts])
        df = np.concatenate([p[4] for p in parts]).astype(np.int64)
        del parts
        distinct, place, m = np.unique(keys, return_inverse=True, return_counts=True)
        ok = m[place] >= need(sizes, percent)
        keys, sizes, full, df = keys[ok], sizes[ok], full[ok], df[ok]
        order = np.lexsort((full, df, keys))
        keys, sizes, full, df = keys[order], sizes[order], full[order], df[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys)) if len(keys) else [0]
        rows: list = [[], [], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            size, m1 = int(sizes[a]), b - a
            short = m1 - int(need(sizes[a], percent)) + 1
            rows[0].append(int(keys[a].view(np.int64)))
            rows[1].append(size)
            rows[2].append(full[a:b].astype(np.int64))
            rows[3].append(full[a:a + min(short + 1, m1)].astype(np.int64))
            rows[4].append(float(np.log(df[a:b]).sum() / size))  # high where all its shingles are much shared
        return pa.table({"cls": pa.array(rows[0], pa.int64()), "size": pa.array(rows[1], pa.int64()),
                         "elements": pa.array(rows[2], pa.list_(pa.int64())), "prefix": pa.array(rows[3], pa.list_(pa.int64())),
                         "hub": pa.array(rows[4], pa.float64())})
    return run


def boundary(store: DataFrame) -> int:
    """The largest size of a light set: least sum of subset and list costs over size classes.

    A subset costs a row. An entry of an inverted list costs a row and, as the lists are
    less selective, up to one comparison with its list's center.
    """
    q = F.size("prefix")
    costs = (store.groupBy(F.floor(F.log2("size") * 4).alias("k"))
             .agg(F.max("size").alias("size"), F.sum(q * (q - 1) / 2).alias("subsets"), F.sum((q - 1) * (1 + COMPARE_COST)).alias("scan"))
             .orderBy("k").collect())  # a few size classes per doubling
    best, at = float("inf"), 0
    for i in range(len(costs) + 1):
        total = sum(c.subsets for c in costs[:i]) + sum(c.scan for c in costs[i:])
        if total < best:
            best, at = total, (costs[i - 1].size if i else 0)
    return at


def _groups(limit: int, percent: int):
    """(sig, cls): 2-subsets of the light sets, inverted lists for the heavy ones."""
    def run(batches):
        for batch in batches:
            sig, cls = [], []
            for c, s, prefix in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f = np.array(prefix, np.int64).view(T.U64)
                own = []
                if s <= limit and len(f) > 1:
                    i, j = np.triu_indices(len(f), 1)
                    low, high = np.minimum(f[i], f[j]), np.maximum(f[i], f[j])
                    own.append(T.mix(low * T.U64(0x9E3779B97F4A7C15) + T.mix(high)))
                if s * 100 >= limit * percent:
                    own.append(T.mix(f[:max(len(f) - 1, 1)] ^ T.U64(0xC2B2AE3D27D4EB4F)))
                own = T.concat(own)
                sig.append(own)
                cls.append(np.full(len(own), c))
            yield pa.RecordBatch.from_arrays([pa.array(T.concat(sig).view(np.int64)), pa.array(T.concat(cls, np.int64), pa.int64())],
                                             names=["sig", "cls"])
    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links of Jaccard similarity
    of at least ``percent`` hundredths over distinct ``width``-word shingles.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    bits = (files.shards_for(docs, SHARD_BYTES) - 1).bit_length()
    packed = "shard int, payload binary"
    store = (rows.select("text").mapInArrow(_postings(width, bits), packed).groupBy("shard").applyInArrow(_shared(bits), packed)
             .groupBy("shard").applyInArrow(_store(percent), _STORE).checkpoint())
    limit = boundary(store)
    groups = store.select("cls", "size", "prefix").mapInArrow(_groups(limit, percent), "sig long, cls long")
    labels = connect_sets(store.drop("prefix"), groups, percent).withColumnRenamed("cls", "node")
    return with_component_ids(rows.mapInArrow(_documents(width), "doc_id long, n_shingles long, cls long"), labels)


def with_component_ids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's smallest reachable doc_id; rows without a class stand alone."""
    known = rows.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # a null id is the smallest; min() would skip it
    smallest = (known.where("label is not null").groupBy("label")
                .agg(F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("none"))
                .select("label", F.when(~F.col("none"), F.col("lo")).alias("component_id")))
    return (known.join(smallest.withColumn("found", F.lit(True)), "label", "left")
            .select("doc_id", "n_shingles", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
