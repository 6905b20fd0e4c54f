"""Interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped for scoring.

Counting is two shuffles of sorted, packed hash arrays, one row per (task, shard):

1. words: every task sends its distinct word hashes and counts to the shard of
   the hash; a shard writes its sorted hashes and counts. A word's id is its place
   in the sorted arrays.
2. bigrams: tasks map words to ids through the mapped arrays and send distinct
   (context id, word id) keys with counts, dealt by a hash of the whole key, so
   that a context holding a third of the corpus spreads over all shards. A shard
   writes its sorted keys and counts and sends, for each word, how many contexts it
   follows and, for each context, how many words follow once, twice, more often.
   Those sums are written by ranges of ids.

Nothing but file names and a few totals reaches the driver. The workers that score
map the files; their size grows with the corpus, the workers' memory does not.

Probability of word w after v (Chen and Goodman's modified form):
``max(c(vw) - D(c), 0) / c(v) + gamma(v) * P(w)`` and
``P(w) = max(k(w) - D'(k), 0) / K + gamma' / (V + 1)``, k(w) the number of
distinct contexts before w, K their sum, V the number of distinct training tokens;
one more class stands for all unknown words. A text starts from a begin context and
ends with an end token, which is predicted and counted. After an unknown word P(w)
is used alone. All probabilities of a context sum to one.

Edge cases: null and empty texts have the end token only; a null ``doc_id`` counts as
training; repeated rows count as often as they occur and are all returned; with no
training rows every token has probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm import files
from rulesift.llm import textarrays as T

#: The hash of the end token: a byte string that can't be a word.
END = T.hash_bytes(b" ")
#: Tokens a task gathers before it sends their distinct keys.
FLUSH_TOKENS = 2_000_000
#: Input bytes for each shard of counts.
SHARD_BYTES = 16 << 20
_PACKED = "shard int, payload binary"


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by the end token, and the end positions."""
    words, first = T.word_table(buf, offsets)
    n = len(first) - 1
    ends = first[1:] + np.arange(n)
    out = np.empty(len(words) + n, T.U64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = T.U64(END)
    out[keep] = words
    return out, ends


def _rows(shards: np.ndarray, make) -> Iterator[pa.RecordBatch]:
    """One packed row for each run of equal ``shards`` (sorted)."""
    if not len(shards):
        return
    cuts = np.append(np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])), len(shards))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield pa.RecordBatch.from_arrays([pa.array([int(shards[a])], pa.int32()), pa.array([make(a, b)], pa.binary())],
                                         names=["shard", "payload"])


def _flushes(batches, train_only: bool):
    """Gather (tokens, ends) until FLUSH_TOKENS, whatever the partition's size."""
    held, n = [], 0
    for rows, buf, offsets in T.chunks(batches):
        if train_only:
            keep = rows.column(rows.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(bool)
        else:
            keep = np.ones(rows.num_rows, bool)
        if not keep.any():
            continue
        tokens, ends = _tokens(buf, offsets)
        text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[-1], ends])))
        sel = keep[text]
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        held.append((tokens[sel], is_end[sel]))
        n += int(sel.sum())
        if n >= FLUSH_TOKENS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> T.U64(64 - bits)).astype(np.int64)


def _word_counts(bits: int):
    def run(batches):
        for tokens, _ in _flushes(batches, True):
            words, counts = T.counted(tokens)
            yield from _rows(_shard_of(words, bits), lambda a, b: T.pack_many((words[a:b], True), (counts[a:b], False)))
    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for cell in table.column("payload"):
        k, c = T.unpack_many(cell.as_py())
        keys.append(k)
        counts.append(c.astype(np.int64))
    return T.counted(T.concat(keys), T.concat(counts, np.int64))


_FILE = "shard int, path string, n long, total long, ones array<long>"


def _file_row(shard: int, path: str, n: int, total: int, ones) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "n": pa.array([n], pa.int64()),
                     "total": pa.array([total], pa.int64()), "ones": pa.array([list(map(int, ones))], pa.list_(pa.int64()))})


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4 and at least 3."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())]


def _write_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, counts = _merged(table)
        path = files.write_bytes(folder, f"words-{key[0].as_py():05d}", words.tobytes(), counts.astype(np.int64).tobytes())
        return _file_row(key[0].as_py(), path, len(words), int(counts.sum()), [])
    return run


@dataclass
class Discounts:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts."""

    d: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @staticmethod
    def fit(n: list[int]) -> Discounts:
        """``n``: how many keys have count 1, 2, 3, 4. Where a formula's denominator
        is 0 (tiny corpora) or its value leaves [0, k], k/2 is used."""
        n1, n2, n3, n4 = n[:4]
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        out = []
        for k, low, high in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
            d = k - (k + 1) * y * high / low if low else k / 2
            out.append(d if 0 < d < k else k / 2)
        return Discounts(tuple(out))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.d])[np.minimum(counts, 3)]


@dataclass
class Words:
    """The sorted word hashes over all shards, mapped on first use in a process."""

    bits: int
    paths: dict[int, tuple[str, int]]
    starts: np.ndarray
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def maps(self, shard: int):
        if shard not in self._maps:
            path, n = self.paths.get(shard, ("", 0))
            self._maps[shard] = (files.map_array(path, np.uint64, n), files.map_array(path, np.int64, n, 8 * n))
        return self._maps[shard]

    def look_up(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count or 0) of sorted hashes."""
        ids = np.full(len(sorted_hashes), -1, np.int64)
        counts = np.zeros(len(sorted_hashes), np.int64)
        shards = _shard_of(sorted_hashes, self.bits)
        cuts = np.searchsorted(shards, np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[s], cuts[s + 1]
            words, n = self.maps(int(s))
            if not len(words):
                continue
            at = np.minimum(np.searchsorted(words, sorted_hashes[a:b]), len(words) - 1)
            hit = words[at] == sorted_hashes[a:b]
            ids[a:b] = np.where(hit, at + self.starts[s], -1)
            counts[a:b] = np.where(hit, n[at], 0)
        return ids, counts


def _bigram_counts(words: Words, begin: int, shard_bits: int):
    def run(batches):
        for tokens, is_end in _flushes(batches, True):
            distinct, place = np.unique(tokens, return_inverse=True)
            ids = words.look_up(distinct)[0][place]
            context = np.concatenate([[begin], ids[:-1]])
            context[1:][is_end[:-1]] = begin
            keys, counts = T.counted(context.astype(T.U64) << T.U64(32) | ids.astype(T.U64))
            shards = _shard_of(T.mix(keys), shard_bits)
            order = np.argsort(shards, kind="stable")
            keys, counts, shards = keys[order], counts[order], shards[order]
            yield from _rows(shards, lambda a, b: T.pack_many((keys[a:b], True), (counts[a:b], False)))
    return run


_STATS = "shard int, payload binary, path string, n long, ones array<long>"


def _write_bigrams(folder: str, range_bits: int):
    """One file of sorted keys and counts; rows of sums for each range of ids and one manifest row."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _merged(table)
        path = files.write_bytes(folder, f"bigrams-{shard:05d}", keys.tobytes(), counts.astype(np.uint32).tobytes())
        follows, n_contexts = T.counted(keys & T.U64(0xFFFFFFFF))
        context = keys >> T.U64(32)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        some = context[head]
        by = [np.add.reduceat((counts == k) if k < 3 else (counts >= 3), head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)
              for k in (1, 2, 3)]
        shards, payloads = [], []
        a_cut = (follows >> T.U64(range_bits)).astype(np.int64)
        b_cut = (some >> T.U64(range_bits)).astype(np.int64)
        for r in np.unique(np.concatenate([a_cut, b_cut])):
            a, b = np.searchsorted(a_cut, [r, r + 1]), np.searchsorted(b_cut, [r, r + 1])
            a, b = slice(*a), slice(*b)
            shards.append(int(r))
            payloads.append(T.pack_many((follows[a], True), (n_contexts[a], False), (some[b], True), *((x[b], False) for x in by)))
        n = len(shards)
        return pa.table({"shard": pa.array([*shards, shard], pa.int32()), "payload": pa.array([*payloads, None], pa.binary()),
                         "path": pa.array([None] * n + [path]), "n": pa.array([0] * n + [len(keys)], pa.int64()),
                         "ones": pa.array([[]] * n + [_of_counts(counts)], pa.list_(pa.int64()))})
    return run


def _write_sums(folder: str, range_bits: int):
    """For one range of ids: k(w) and the three counts of followers, as dense arrays."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, size = key[0].as_py(), 1 << range_bits
        sums = np.zeros((4, size), np.int64)
        for cell in table.column("payload"):
            follows, n, some, *by = T.unpack_many(cell.as_py())
            base = T.U64(r << range_bits)
            sums[0, (follows - base).astype(np.int64)] += n.astype(np.int64)
            for j, x in enumerate(by):
                sums[1 + j, (some - base).astype(np.int64)] += x.astype(np.int64)
        path = files.write_bytes(folder, f"sums-{r:05d}", sums.astype(np.uint32).tobytes())
        return _file_row(r, path, size, int(sums[0].sum()), _of_counts(sums[0]))
    return run


class KneserNey:
    """A trained model: file names and a few totals; ``score`` maps the files in the workers."""

    def __init__(self, words: Words, n_words: int, total: int, shard_bits: int, bigrams: dict, range_bits: int,
                 sums: dict, high: Discounts, low: Discounts, pairs: int, low_ones: list[int]):
        self.words, self.V, self.N = words, n_words, total
        self.shard_bits, self.bigrams, self.range_bits, self.sums = shard_bits, bigrams, range_bits, sums
        self.high, self.low, self.K, self.low_ones = high, low, pairs, low_ones
        self._maps: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    @staticmethod
    def train(docs: DataFrame, train: Column) -> KneserNey:
        """Count all texts of ``docs`` for which ``train`` is true."""
        spark = docs.sparkSession
        folder = files.scratch(spark, "kneser-ney")
        rows = docs.select("text", F.coalesce(train, F.lit(True)).alias("train")).where("train")
        bits = (files.shards_for(docs, SHARD_BYTES) - 1).bit_length()
        made = (rows.mapInArrow(_word_counts(bits), _PACKED).groupBy("shard")
                .applyInArrow(_write_words(folder), _FILE).collect())  # one row a shard
        made.sort(key=lambda r: r.shard)
        starts = np.zeros(1 << bits, np.int64)
        at = 0
        for r in made:
            starts[r.shard] = at
            at += r.n
        if at >= 1 << 32:
            raise ValueError("ids of words are 32 bits; the corpus has more distinct words")
        words = Words(bits, {r.shard: (r.path, r.n) for r in made}, starts)
        total = sum(r.total for r in made)
        begin = at
        range_bits = max(10, at.bit_length() - bits + 1)
        parts = (rows.mapInArrow(_bigram_counts(words, begin, bits), _PACKED).groupBy("shard")
                 .applyInArrow(_write_bigrams(folder, range_bits), _STATS).checkpoint())
        files_made = parts.where("path is not null").select("shard", "path", "n", "ones").collect()  # one row a shard
        sums = (parts.where("payload is not null").select("shard", "payload").groupBy("shard")
                .applyInArrow(_write_sums(folder, range_bits), _FILE).collect())  # one row a range of ids
        high = Discounts.fit([sum(r.ones[k] for r in files_made) for k in range(4)])
        ones = [sum(r.ones[k] for r in sums) for k in range(5)]
        return KneserNey(words, at, total, bits, {r.shard: (r.path, r.n) for r in files_made}, range_bits,
                         {r.shard: r.path for r in sums}, high, Discounts.fit(ones), sum(r.total for r in sums), ones)

    # --- inside the workers ---------------------------------------------------

    def _sums(self, ids: np.ndarray) -> np.ndarray:
        """The four sums of sorted ids, 4 x n."""
        out = np.zeros((4, len(ids)), np.int64)
        size = 1 << self.range_bits
        ranges = ids >> self.range_bits
        for r in np.unique(ranges):
            a, b = np.searchsorted(ranges, [r, r + 1])
            if int(r) in self.sums:
                if ("s", r) not in self._maps:
                    self._maps["s", r] = files.map_array(self.sums[int(r)], np.uint32, 4 * size).reshape(4, size)
                out[:, a:b] = self._maps["s", r][:, ids[a:b] - (int(r) << self.range_bits)]
        return out

    def _counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted bigram keys."""
        out = np.zeros(len(keys), np.int64)
        shards = _shard_of(T.mix(keys), self.shard_bits)
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange((1 << self.shard_bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s]:cuts[s + 1]]
            path, n = self.bigrams.get(int(s), ("", 0))
            if not n:
                continue
            if ("b", s) not in self._maps:
                self._maps["b", s] = (files.map_array(path, np.uint64, n), files.map_array(path, np.uint32, n, 8 * n))
            stored, counts = self._maps["b", s]
            at = np.minimum(np.searchsorted(stored, keys[own]), n - 1)
            out[own] = np.where(stored[at] == keys[own], counts[at], 0)
        return out

    def log10_of(self, tokens: np.ndarray, is_end: np.ndarray, n_train_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token; texts follow one another."""
        distinct, place = np.unique(tokens, return_inverse=True)
        ids, counts = self.words.look_up(distinct)
        if not self.V:
            return np.zeros(len(tokens)), counts[place]
        known = ids >= 0
        sums = np.zeros((4, len(ids)), np.int64)
        order = np.flatnonzero(known)  # ids rise with the hashes
        sums[:, order] = self._sums(ids[order])
        k = sums[0]
        rest = sum(d * n for d, n in zip(self.low.d, (self.low_ones[0], self.low_ones[1], self.low_ones[4])))
        low = (np.maximum(k - self.low.of(k), 0) + rest / (self.V + 1)) / max(self.K, 1)
        gamma = np.ones(len(ids))
        c = np.maximum(counts[order], 1)
        gamma[order] = (np.array(self.high.d) @ sums[1:, order]) / c
        begin = self._sums(np.array([self.V]))[1:, 0]
        begin_gamma = float(np.array(self.high.d) @ begin) / max(n_train_texts, 1)
        before = np.concatenate([[-1], place[:-1]])
        before[1:][is_end[:-1]] = -1
        first = before < 0
        context = np.where(first, self.V, ids[before])
        context_gamma = np.where(first, begin_gamma, gamma[before])
        context_count = np.where(first, n_train_texts, counts[before])
        p = context_gamma * low[place]
        both = (context >= 0) & known[place]
        keys, back = np.unique(context[both].astype(T.U64) << T.U64(32) | ids[place][both].astype(T.U64), return_inverse=True)
        seen = self._counts(keys)
        p[both] += (np.maximum(seen - self.high.of(seen), 0))[back] / np.maximum(context_count[both], 1)
        return np.log10(p), counts[place]

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row."""
        model = self
        end = T.U64(END)

        def run(batches):
            n_texts = int(model.words.look_up(np.array([end], T.U64))[1][0])  # each text has one end token
            held, size = [], 0
            for rows, buf, offsets in T.chunks(batches):
                held.append((T.column_ids(rows), *_tokens(buf, offsets)))
                size += len(held[-1][1])
                if size >= FLUSH_TOKENS:
                    yield out(held, n_texts)
                    held, size = [], 0
            if held:
                yield out(held, n_texts)

        def out(held, n_texts):
            ids = np.concatenate([h[0] for h in held])
            tokens = np.concatenate([h[1] for h in held])
            base = np.cumsum([0, *(len(h[1]) for h in held)])
            ends = np.concatenate([h[2] + b for h, b in zip(held, base)])
            is_end = np.zeros(len(tokens), bool)
            is_end[ends] = True
            logs, counts = model.log10_of(tokens, is_end, n_texts)
            plain = np.log10((counts + 1) / (model.N + model.V + 1))
            starts = np.concatenate([[0], ends[:-1] + 1])
            return pa.RecordBatch.from_arrays([
                T.arrow_ids(ids), pa.array(ends + 1 - starts, pa.int64()),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts), pa.int64()),
                pa.array(np.full(len(ids), model.N), pa.int64()),
                pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat(logs, starts))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
