"""Benchmark decontamination over a distributed positional inverted index.

``PositionalIndex.build`` stores the postings of every training token. The index is
partitioned by document: a block holds some documents' sorted term hashes, their
counts and the positions of each term, packed, as one row of a Parquet table in the shared
folder. A term that a third of all documents use is therefore as spread as any other.

``search`` runs the test items against every block where the block lies, without a shuffle.
The items' windows are written once as packed files by the tasks that read the items and are
read back one file at a time, so neither the driver nor a worker holds a large test set
whole. Within a block each window starts from the postings of its rarest term, shifted by
the term's offset, and is intersected with the next rarest terms' lists until all have been met:
what is left are exact phrase matches. Proximity matches have all terms of a window within
``slop`` words of an occurrence of its rarest term, in any order.

Words are runs of ASCII letters and digits, A-Z folded, and of bytes over 0x7F. Word hashes
are 64 bits wide and stand for the words.

Edge cases: null and empty texts have no words and no hits; items without words match nothing; an
item of fewer words than ``width`` is one window; a null ``item_id`` takes part and
is shown as ``null``; repeated items count once; repeated documents are each returned; other
columns are ignored; an empty test set gives no hits and an empty table an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rulesift.llm import files
from rulesift.llm import textarrays as T

#: Words in an index block, and windows in a file of test windows (one longer text is a block of its own).
BLOCK_WORDS = 500_000
FILE_WINDOWS = 50_000
#: Free positions between documents, so that no window reaches over.
GAP = 1 << 7
_INDEX = "doc_ids binary, starts binary, n_words binary, terms binary, counts binary, positions binary"
_SPANS = "array<struct<item_id: bigint, start: bigint, end: bigint>>"
_FOUND = f"doc_id long, n_words long, n_hit long, items array<long>, phrases {_SPANS}, near {_SPANS}"


def _block(ids: np.ndarray, n_words: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    starts = np.concatenate([[0], np.cumsum(n_words + GAP)[:-1]]) if len(ids) else np.zeros(0, np.int64)
    place = np.arange(len(words)) + np.repeat(starts - (np.cumsum(n_words) - n_words), n_words)
    order = np.argsort(words, kind="stable")  # positions stay in order within a term
    terms, counts = T.counted(words)
    columns = [T.pack(ids.view(T.U64)), T.pack(starts, True), T.pack(n_words), T.pack(terms, True), T.pack(counts), T.pack(place[order])]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns],
                                      names=["doc_ids", "starts", "n_words", "terms", "counts", "positions"])


def _index_blocks(batches):
    held, n = [], 0
    for rows, buf, offsets in T.chunks(batches):
        words, first = T.word_table(buf, offsets, T.ALNUM)
        held.append((T.column_ids(rows), np.diff(first), words))
        n += len(words)
        if n >= BLOCK_WORDS:
            yield _block(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield _block(*map(np.concatenate, zip(*held)))


def _write_windows(folder: str, width: int):
    """Pack the windows of the items: (term hashes, words, item) of each."""
    def run(batches):
        held, n = [], 0
        for rows, buf, offsets in T.chunks(batches):
            words, first = T.word_table(buf, offsets, T.ALNUM)
            n_words = np.diff(first)
            n_runs = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
            item = np.repeat(np.arange(len(n_words)), n_runs)
            start = np.arange(len(item)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + first[:-1][item]
            size = np.minimum(n_words, width)[item]
            padded = np.concatenate([words, np.zeros(width, T.U64)])
            held.append((padded[start[:, None] + np.arange(width)], size, T.column_ids(rows, "item_id")[item]))
            n += len(item)
            if n >= FILE_WINDOWS:
                yield written(held)
                held, n = [], 0
        if n:
            yield written(held)

    def written(held):
        terms, size, item = (np.concatenate(x) for x in zip(*held))
        data = T.pack_many((terms.ravel(), False), (size, False), (item.view(T.U64), False))
        return pa.RecordBatch.from_arrays([pa.array([files.write_bytes(folder, "windows", data)])], names=["path"])
    return run


@lru_cache(maxsize=2)
def _read_windows(path: str, width: int):
    """(distinct test terms, window rows as places in them, words of each, item of each)."""
    terms, size, item = T.unpack_many(files.read_bytes(path))
    size = size.astype(np.int64)
    vocabulary, place = np.unique(terms, return_inverse=True)
    return vocabulary, place.reshape(-1, width), size, item.view(np.int64)


class _Postings:
    """The lists of one block's terms that a test file uses."""

    def __init__(self, vocabulary, terms, bounds, positions):
        at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        found = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.df = np.where(found, bounds[at + 1] - bounds[at], 0) if len(terms) else np.zeros(len(vocabulary), np.int64)
        first = np.where(found, bounds[at], 0) if len(terms) else self.df
        self.first = np.cumsum(self.df) - self.df
        take = np.arange(int(self.df.sum())) + np.repeat(first - self.first, self.df)
        self.positions = positions[take]
        #: (term, position), sorted: intersections are binary searches in it
        self.keys = np.repeat(np.arange(len(vocabulary)), self.df).astype(T.U64) << T.U64(40) | self.positions.astype(T.U64)

    def at_or_after(self, term, position):
        """The place in ``keys`` of the term's first position not before ``position``."""
        return np.searchsorted(self.keys, term.astype(T.U64) << T.U64(40) | np.maximum(position, 0).astype(T.U64))

    def holds(self, term, low, high):
        """Whether the term occurs from ``low`` to ``high``."""
        i = self.at_or_after(term, low)
        key = self.keys[np.minimum(i, max(len(self.keys) - 1, 0))]
        return (i < len(self.keys)) & (key <= (term.astype(T.U64) << T.U64(40) | np.maximum(high, 0).astype(T.U64))) & (high >= 0)


def _match(lists: _Postings, windows, size, slop: int):
    """(window, start) of phrase matches and (window, place of the rarest term) of proximity matches."""
    z = np.zeros(0, np.int64)
    if not len(windows) or not len(lists.keys):
        return (z, z), (z, z)
    width = windows.shape[1]
    inside = np.arange(width) < size[:, None]
    df = np.where(inside, lists.df[windows], np.iinfo(np.int64).max)
    some = np.flatnonzero((df > 0).all(1))
    order = np.argsort(df[some], axis=1, kind="stable")  # rarest first, padding last
    rare = windows[some, order[:, 0]]
    n = lists.df[rare]
    who = np.repeat(np.arange(len(some)), n)
    at = lists.positions[np.arange(len(who)) + np.repeat(lists.first[rare] - (np.cumsum(n) - n), n)]
    start = at - order[who, 0]
    near_who, near_at = who, at
    ok = start >= 0
    who, start = who[ok], start[ok]
    for r in range(1, width):
        ok = size[some[who]] > r  # shorter windows are complete
        offset = order[who, r]
        term = windows[some[who], offset]
        p = start + offset
        keep = ~ok
        keep[ok] = lists.holds(term[ok], p[ok], p[ok])
        who, start = who[keep], start[keep]
        if slop:
            ok = size[some[near_who]] > r
            term = windows[some[near_who], order[near_who, r]]
            keep = ~ok
            keep[ok] = lists.holds(term[ok], near_at[ok] - slop, near_at[ok] + slop)
            near_who, near_at = near_who[keep], near_at[keep]
    return (some[who], start), ((some[near_who], near_at) if slop else (z, z))


def _spans(doc, item, start, end, n_docs, origin):
    """For each document a list of (item, start, end): united spans by item, words counted from 0."""
    out: list = [[] for _ in range(n_docs)]
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    last = None
    for d, i, a, b in zip(doc.tolist(), item.tolist(), (start - origin[doc]).tolist(), (end - origin[doc]).tolist()):
        if last is not None and last[0] == (d, i) and a <= last[1]["end"]:
            last[1]["end"] = max(last[1]["end"], b)
        else:
            span = {"item_id": None if i == T.NULL_ID else i, "start": a, "end": b}
            out[d].append(span)
            last = ((d, i), span)
    return out


def _search(paths: list[str], width: int, slop: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield found(row)

    def found(row):
        ids, starts, n_words, terms, counts, positions = (T.unpack(row[c]) for c in ("doc_ids", "starts", "n_words", "terms", "counts", "positions"))
        ids, starts, n_words, positions = ids.view(np.int64), starts.astype(np.int64), n_words.astype(np.int64), positions.astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        hit = np.zeros(int(starts[-1] + n_words[-1]) + 1, np.int32)
        phrase, near = [], []
        for path in paths:
            vocabulary, windows, size, item = _read_windows(path, width)
            lists = _Postings(vocabulary, terms, bounds, positions)
            (w, start), (nw, at) = _match(lists, windows, size, slop)
            doc = np.searchsorted(starts, start, side="right") - 1
            phrase.append((doc, item[w], start, start + size[w]))
            np.add.at(hit, start, 1)
            np.add.at(hit, start + size[w], -1)
            near.append((np.searchsorted(starts, at, side="right") - 1, item[nw], at, at + 1))
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
        n_hit = covered[starts + n_words] - covered[starts]
        z = np.zeros(0, np.int64)
        doc, item, a, b = (np.concatenate(x) for x in zip(*phrase)) if phrase else (z, z, z, z)
        spans = _spans(doc, item, a, b, len(ids), starts)
        close = _spans(*((np.concatenate(x) for x in zip(*near)) if near else (z, z, z, z)), len(ids), starts)
        items = [sorted({s["item_id"] for s in x}, key=lambda i: (i is None, i or 0)) for x in spans]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([T.arrow_ids(ids), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                                           pa.array(spans, kind), pa.array(close, kind)],
                                          names=["doc_id", "n_words", "n_hit", "items", "phrases", "near"])
    return run


class PositionalIndex:
    """A stored index; open an earlier one by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def build(docs: DataFrame, path: str | None = None) -> PositionalIndex:
        """Index every word of ``docs`` (doc_id, text) as a table at ``path`` (default: in the shared folder)."""
        path = path or files.scratch(docs.sparkSession, "positions")
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
        rows.mapInArrow(_index_blocks, _INDEX).write.option("compression", "none").parquet(path)
        return PositionalIndex(docs.sparkSession, path)

    def search(self, items: DataFrame, width: int = 10, slop: int = 15) -> DataFrame:
        """One row for each indexed document: doc_id, n_words, n_hit (words inside phrase matches),
        items with phrase matches, and the spans (item, first word, end) of phrase and proximity
        matches. ``slop`` 0 leaves proximity out."""
        if not 1 <= width + slop < GAP:
            raise ValueError(f"width and slop together must stay under {GAP}")
        folder = files.scratch(self.spark, "windows")
        rows = items.select(items["item_id"].cast("long").alias("item_id"), "text")
        paths = [r.path for r in rows.mapInArrow(_write_windows(folder, width), "path string").collect()]  # names of files only
        return self.spark.read.schema(_INDEX).parquet(self.path).mapInArrow(_search(sorted(paths), width, slop), _FOUND)
