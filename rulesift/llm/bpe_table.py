"""SentencePiece encoding and decoding by a merge-type prefix table.

A merge-type (BPE) segmentation is decided by neighbouring pairs: a sequence of
pieces is the encoding of its text exactly if each neighbouring pair is *compatible*, that is, if
encoding the pair's text gives the pair. So every prefix of a word has one last
piece. The table holds it for each prefix: of the pieces that end there (found by the
automaton, longest first), the one that is compatible with the last piece of the prefix before it.
The pieces are then recovered backwards.

Compatibility undoes merges on both sides of the border, latest first, and fails when a pair across
the border would have been merged earlier; results are kept in a direct-mapped cache. Pieces of
several marks share one score; of merges of equal score the leftmost comes first.

The library's options: identity normalisation, a mark before each text that isn't empty, byte fallback.

Edge cases: null and empty texts have the begin and end ids only; repeated rows and null ids are
returned as they are; other columns are ignored; texts are encoded whole at any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulesift.llm import textarrays as T
from rulesift.llm.pieces import BYTE, MARK, SPACES, WORD, Automaton, Pieces, batches_of_words, char_sizes, distinct_words, normalised, ragged, units

_CACHE_BITS = 20


class PrefixTable:
    """Tables of one vocabulary; made on the driver, the automaton in each worker on first use."""

    def __init__(self, pieces: Pieces, bos: int | None = 1, eos: int | None = 2):
        self.pieces, self.bos, self.eos = pieces, bos, eos
        runs = {len(s): i for i, s in enumerate(pieces.strings) if i not in pieces.special and s and not s.strip(MARK)}
        if len({float(pieces.scores[i]) for k, i in runs.items() if k > 1}) > 1:
            raise ValueError("pieces of several marks must share one score")
        self.runs = runs
        of_runs = {i for k, i in runs.items() if k > 1}
        self.ids = [i for i in range(len(pieces.strings)) if i not in pieces.special and i not in of_runs]
        pieces.check(self.ids)
        merged = [i for i in self.ids if len(pieces.strings[i]) > 1]
        order = sorted(merged, key=lambda i: -pieces.scores[i])
        if len({float(pieces.scores[i]) for i in merged}) != len(merged):
            raise ValueError("pieces of more than one character must have distinct scores")
        base = [i for i in self.ids if len(pieces.strings[i]) == 1]
        #: the order in which pieces arise; single characters first
        self.rank = np.zeros(len(pieces.strings) + 5, np.int64)
        self.rank[base + order] = np.arange(len(base) + len(order))
        self.id_of = np.array(base + order)
        rank_of = {pieces.strings[i]: int(self.rank[i]) for i in self.ids}
        n = len(self.id_of)
        self.left, self.right = np.arange(n), np.arange(n)
        reachable = set(base)
        keys, values = [], []
        for i in order:
            s = pieces.strings[i]
            for k in range(1, len(s)):
                if s[:k] in rank_of and s[k:] in rank_of:
                    keys.append(rank_of[s[:k]] * n + rank_of[s[k:]])
                    values.append(rank_of[s])
            split = _last_merge(s, rank_of)
            if split:
                self.left[rank_of[s]], self.right[rank_of[s]] = split
                reachable.add(i)
        self.ids = [i for i in self.ids if i in reachable]
        at = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys)[at], np.array(values)[at]
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def made(self):
        """(automaton, cache keys, cache values, bytes of the pieces, their places)."""
        if self._made is None:
            size = 1 << _CACHE_BITS
            body = [b"" for _ in self.pieces.strings]
            for i, s in enumerate(self.pieces.strings):
                if i not in self.pieces.special:
                    body[i] = s.replace(MARK, " ").encode()
            for b, i in enumerate(self.pieces.byte_ids):
                body[i] = bytes([b])
            count = np.array([len(b) for b in body])
            self._made = (Automaton(self.pieces.strings, self.ids), np.full(size, -1, np.int64), np.zeros(size, bool),
                          np.frombuffer(b"".join(body), np.uint8), np.cumsum(count) - count, count)
        return self._made

    def run_pieces(self, n: int) -> list[int]:
        """Ids of n marks: equal scores, so the leftmost pair that makes a piece is merged, again and again."""
        done: list[int] = []  # sizes; no neighbouring two of them make a piece
        for _ in range(n):
            done.append(1)
            # a new pair at the end is merged first where it lies left of the marks still to come
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return [self.runs[k] for k in done]

    # --- pairs -----------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``b`` may follow pieces ``a`` (ids)."""
        _, keys, values = self.made()[:3]
        key = a * len(self.rank) + b
        slot = (T.mix(key.astype(T.U64)) >> T.U64(64 - _CACHE_BITS)).astype(np.int64)
        out = values[slot]
        miss = np.flatnonzero(keys[slot] != key)
        if len(miss):
            some, place = np.unique(key[miss], return_inverse=True)
            found = self._undo(self.rank[some // len(self.rank)], self.rank[some % len(self.rank)])
            out[miss] = found[place]
            where = slot[miss]
            keys[where], values[where] = key[miss], found[place]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge of the two pieces at the border until both are characters."""
        n = len(self.id_of)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            out[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            can_a, can_b = self.right[x] != x, self.left[y] != y
            undo_a = can_a & ((x > y) | ~can_b)
            undo_b = can_b & ~undo_a
            # a merge on the right side yields to an equal one on the left, which comes first
            limit[live] = np.where(undo_a, x, y + 1)
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_b, self.left[y], y)
            live = live[undo_a | undo_b]
        return out

    # --- encoding ---------------------------------------------------------------

    def encode_words(self, buf, start, end, marked):
        """Ids of words: (flat ids, first, count). ``marked`` words begin with the mark."""
        auto = self.made()[0]
        n_ids = len(self.pieces.strings)
        flats, firsts, counts = [], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        base = 0
        for where, matrix, size in batches_of_words(buf, start, end, marked):
            last = self._table(auto, matrix, size)
            flat, count = self._recover(auto, matrix, size, last, n_ids)
            flats.append(flat)
            counts[where] = count
            firsts[where] = base + np.cumsum(count) - count
            base += len(flat)
        return T.concat(flats, np.int64), firsts, counts

    def _table(self, auto, matrix, size):
        """last[w, p]: the last piece of the first p bytes of word w (-1: no border there)."""
        n, wide = matrix.shape
        unknown = len(self.pieces.strings)  # + size: a character that is no piece
        chars = char_sizes(matrix)
        last = np.full((n, wide + 1), -1, np.int32)
        state = np.zeros(n, np.int64)
        active = np.searchsorted(-size, -np.arange(1, wide + 1), side="right")
        for p in range(1, wide + 1):
            m = active[p - 1]
            state = auto.goto[state[:m], auto.cls[matrix[:m, p - 1]]]
            who = np.arange(m)
            t = auto.out[state]
            while len(who):
                ok = t >= 0
                who, t = who[ok], t[ok]
                if not len(who):
                    break
                piece = auto.piece[t]
                at = p - auto.size[piece]
                before = last[who, at]
                good = at == 0
                test = np.flatnonzero(~good & (before >= 0))
                free = before[test] >= unknown
                good[test[free]] = True
                test = test[~free]
                if len(test):
                    good[test] = self.compatible(before[test].astype(np.int64), piece[test])
                last[who[good], p] = piece[good]
                who, t = who[~good], auto.shorter[t[~good]]
            alone = np.flatnonzero((last[:m, p] < 0) & (chars[:m, p - 1] > 0))
            if len(alone):
                c = chars[alone, p - 1]
                alone = alone[last[alone, p - c] >= 0] if p > c.min() else alone
                c = chars[alone, p - 1]
                known = self._is_piece(auto, matrix, alone, p, c)
                last[alone[~known], p] = unknown + c[~known]
        return last

    @staticmethod
    def _is_piece(auto, matrix, who, p, c):
        """Whether the character that ends at byte p is a piece."""
        state = np.zeros(len(who), np.int64)
        for k in range(4, 0, -1):
            step = c >= k
            state[step] = auto.goto[state[step], auto.cls[matrix[who[step], p - k]]]
        piece = auto.piece[state]
        return (piece >= 0) & (auto.size[piece] == c)

    def _recover(self, auto, matrix, size, last, unknown):
        """Walk the tables backwards: ids of all words, one after another."""
        n = len(size)
        length = np.concatenate([auto.size[:unknown], np.arange(5)])
        at, live = size.copy(), np.arange(n)
        steps = []
        while len(live):
            piece = last[live, at[live]].astype(np.int64)
            if (piece < 0).any():
                raise AssertionError("a prefix without a last piece")
            steps.append((live, piece, at[live]))
            at[live] -= length[piece]
            live = live[at[live] > 0]
        who, piece, stop = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((stop, who))
        who, piece, stop = who[order], piece[order], stop[order]
        times = np.where(piece >= unknown, piece - unknown, 1)
        flat = np.repeat(piece, times)
        more = np.repeat(piece >= unknown, times)
        if more.any():  # a character that is no piece becomes its bytes
            k = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
            byte = matrix[np.repeat(who, times), np.repeat(stop - times, times) + k]
            flat = np.where(more, self.pieces.byte_ids[byte], flat)
        return flat, np.bincount(who, times, n).astype(np.int64)

    def encode_chunk(self, buf, offsets):
        """(flat ids of all texts, number of ids of each)."""
        n = len(offsets) - 1
        buf, offsets = normalised(buf, offsets)
        auto = self.made()[0]
        kind, start, end, text = units(buf, offsets, auto.known)
        is_word = kind == WORD
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == SPACES) & (text[1:] == text[:-1])
        marked = after[is_word]
        place, where = distinct_words(buf, start[is_word], end[is_word], marked)
        ids, first, count = self.encode_words(buf, start[is_word][where], end[is_word][where], marked[where])
        # a word's mark joins the run before it if it stays a piece of its own
        one = self.runs[1]
        alone = marked[where] & (count > 0)
        alone[alone] = ids[first[alone]] == one
        first, count = first + alone, count - alone
        run = np.where(kind == SPACES, end - start, 0)
        takes = np.zeros(len(kind), bool)
        takes[np.flatnonzero(is_word)[marked & ~alone[place]] - 1] = True
        run -= takes
        runs, run_place = np.unique(run, return_inverse=True)
        parts = [np.array(self.run_pieces(r), np.int64) for r in runs.tolist()]
        run_count = np.array([len(x) for x in parts], np.int64)
        table = np.concatenate([ids, *parts, self.pieces.byte_ids, [self.bos or 0, self.eos or 0]])
        run_first = len(ids) + np.cumsum(run_count) - run_count
        byte_first = len(ids) + int(run_count.sum())
        f, c = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        f[is_word], c[is_word] = first[place], count[place]
        s = kind == SPACES
        f[s], c[s] = run_first[run_place[s]], run_count[run_place[s]]
        b = kind == BYTE
        f[b], c[b] = byte_first + buf[start[b]].astype(np.int64), 1
        # begin and end ids around each text
        cuts = np.searchsorted(text, np.arange(n + 1))
        if self.bos is not None:
            f, c = np.insert(f, cuts[:-1], byte_first + 256), np.insert(c, cuts[:-1], 1)
            cuts = cuts + np.arange(n + 1)
        if self.eos is not None:
            f, c = np.insert(f, cuts[1:], byte_first + 257), np.insert(c, cuts[1:], 1)
            cuts = cuts + np.arange(n + 1)
        total = np.concatenate([[0], np.cumsum(c)])[cuts]
        return ragged(table, f, c).astype("<u4"), np.diff(total)

    # --- decoding ----------------------------------------------------------------

    def decode_chunk(self, ids, counts):
        """UTF-8 bytes of each id sequence, as (buffer, offsets): the mark that encoding put first is dropped."""
        _, _, _, body, first, size = self.made()
        out = ragged(body, first[ids], size[ids])
        total = np.concatenate([[0], np.cumsum(size[ids])])
        cuts = total[np.concatenate([[0], np.cumsum(counts)])]
        lead = cuts[:-1][np.diff(cuts) > 0]
        # the first piece with text is dropped its mark, not a byte piece that holds a space
        where = np.searchsorted(total, lead, side="right") - 1
        drop = lead[(out[lead] == 0x20) & (ids[where] != self.pieces.byte_ids[0x20])]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def _last_merge(s: str, rank_of: dict[str, int]) -> tuple[int, int] | None:
    """The two pieces whose merge completes ``s`` when it is encoded alone; None if it never is."""
    parts = list(s)
    while len(parts) > 2:
        best = min(((rank_of.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            return None
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return rank_of[parts[0]], rank_of[parts[1]]


def encode(docs: DataFrame, table: PrefixTable, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (and ``ids`` if asked for)."""
    tables = docs.sparkSession.sparkContext.broadcast(table)  # as large as the vocabulary

    def run(batches):
        t = tables.value
        for rows, buf, offsets in T.chunks(batches):
            ids, counts = t.encode_chunk(buf, offsets)
            out, cuts = t.decode_chunk(ids, counts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns = [rows.column(0), pa.array(counts, pa.int64()),
                       pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                       pa.array([hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string())]
            if keep_ids:
                columns.append(pa.LargeListArray.from_arrays(ends, ids.astype(np.int32)).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(columns)])

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
