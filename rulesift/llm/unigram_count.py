"""Token counts by count-only Viterbi over a unigram vocabulary.

The automaton enumerates, at each byte, the vocabulary pieces that end there, longest first. Dynamic
programming carries the best score and its number of tokens only; no path is kept. Of equal scores
the path whose last piece starts first wins (a later one must be strictly better), which is the
rule of the ``tokenizers`` library's Unigram model; a character that is no piece costs the least score less 10
and counts as its bytes (byte fallback).

The public vocabularies hold no unigram model, so ``Pieces`` of a merge-type file are read as
one: its strings with its scores. The white-space mark only begins pieces, so the best path of a
text is the best paths of its words with the marks before them, and each distinct word of a chunk is solved once; all words of a group
are advanced together, a byte a step. Scores must be whole numbers, for then sums are exact in doubles
and ties are decided as in the library, which adds from the start of the text.

Edge cases: null and empty texts have 0 tokens; repeated rows and null ids are returned as they
are; other columns are ignored; texts are counted whole at any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulesift.llm import textarrays as T
from rulesift.llm.pieces import BYTE, MARK, SPACES, WORD, Automaton, Pieces, batches_of_words, char_sizes, distinct_words, normalised, units

UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """A vocabulary; the automaton is made in each worker on first use."""

    def __init__(self, pieces: Pieces):
        if (pieces.scores != np.round(pieces.scores)).any():
            raise ValueError("scores must be whole numbers")
        if any(MARK in s.lstrip(MARK) for s in pieces.strings) or MARK not in pieces.strings:
            raise ValueError("the white-space mark must be a piece and only begin pieces")
        self.pieces = pieces
        self.unknown_score = float(pieces.scores.min()) - UNKNOWN_PENALTY
        #: most marks at the start of a piece; farther back in a run nothing depends on the word behind it
        self.window = max(len(s) - len(s.lstrip(MARK)) for s in pieces.strings)
        self._auto: Automaton | None = None

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def automaton(self) -> Automaton:
        if self._auto is None:
            self._auto = Automaton(self.pieces.strings, range(len(self.pieces.strings)))
            self._scores = self.pieces.scores.astype(np.float64)
        return self._auto

    def count_words(self, buf, start, end, marks, table) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, best score) of each word with the ``marks`` marks before it; ``table``: of marks alone."""
        auto = self.automaton()
        tokens, scores = np.zeros(len(start), np.int64), np.zeros(len(start))
        near = np.minimum(marks, self.window)
        for where, matrix, size in batches_of_words(buf, start, end, near):
            n, wide = matrix.shape
            best = np.full((n, wide + 1), -np.inf)
            count = np.zeros((n, wide + 1), np.int64)
            for i in range(int(near[where].max()) + 1):
                w = np.flatnonzero(near[where] >= i)
                k = (marks - near)[where[w]] + i
                count[w, 3 * i], best[w, 3 * i] = table[0][k], table[1][k]
            chars = char_sizes(matrix)
            state = np.zeros(n, np.int64)
            active = np.searchsorted(-size, -np.arange(1, wide + 1), side="right")
            for p in range(1, wide + 1):
                m = active[p - 1]
                state = auto.goto[state[:m], auto.cls[matrix[:m, p - 1]]]
                c = chars[:m, p - 1]
                single = np.zeros(m, bool)
                who, t = np.arange(m), auto.out[state]
                while True:
                    ok = t >= 0
                    who, t = who[ok], t[ok]
                    if not len(who):
                        break
                    piece = auto.piece[t]
                    length = auto.size[piece]
                    at = p - length
                    score = best[who, at] + self._scores[piece]
                    better = score > best[who, p]
                    w = who[better]
                    best[w, p] = score[better]
                    count[w, p] = count[w, at[better]] + 1
                    single[who[length == c[who]]] = True
                    t = auto.shorter[t]
                who = np.flatnonzero(~single & (c > 0))
                if len(who):
                    at = p - c[who]
                    score = best[who, at] + self.unknown_score
                    better = score > best[who, p]
                    w = who[better]
                    best[w, p] = score[better]
                    count[w, p] = count[w, at[better]] + c[w]
            tokens[where] = count[np.arange(n), size]
            scores[where] = best[np.arange(n), size]
        return tokens, scores

    def count_chunk(self, buf, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, best score) of each text."""
        n = len(offsets) - 1
        buf, offsets = normalised(buf, offsets)
        auto = self.automaton()
        kind, start, end, text = units(buf, offsets, auto.known)
        tokens, scores = np.zeros(len(kind), np.int64), np.zeros(len(kind))
        is_word, spaces, bytes_ = kind == WORD, kind == SPACES, kind == BYTE
        after = np.zeros(len(kind), bool)
        after[1:] = spaces[:-1] & (text[1:] == text[:-1])
        marked = np.flatnonzero(after & is_word)
        marks = np.zeros(len(kind), np.int64)
        run = np.where(spaces, end - start, 0)
        marks[marked] = run[marked - 1]
        table = self._mark_table(int(run.max()) if len(run) else 0)
        run[marked - 1] = 0  # taken with the word
        place, where = distinct_words(buf, start[is_word], end[is_word], marks[is_word])
        a, b = self.count_words(buf, start[is_word][where], end[is_word][where], marks[is_word][where], table)
        tokens[is_word], scores[is_word] = a[place], b[place]
        tokens[spaces], scores[spaces] = table[0][run[spaces]], table[1][run[spaces]]
        tokens[bytes_], scores[bytes_] = 1, self.unknown_score
        cuts = np.searchsorted(text, np.arange(n + 1))
        total, sums = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0.0], np.cumsum(scores)])
        return np.diff(total[cuts]), np.diff(sums[cuts])

    def _mark_table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, best score) of 0 to n marks alone."""
        sizes = sorted(((len(s), float(self.pieces.scores[i])) for i, s in enumerate(self.pieces.strings) if s and not s.strip(MARK)), reverse=True)
        counts, bests = [0], [0.0]
        for p in range(1, n + 1):
            best, count = -np.inf, 0
            for size, score in sizes:  # earliest start first
                if size <= p and bests[p - size] + score > best:
                    best, count = bests[p - size] + score, counts[p - size] + 1
            counts.append(count)
            bests.append(best)
        return np.array(counts, np.int64), np.array(bests)


def count_tokens(docs: DataFrame, counter: UnigramCounter) -> DataFrame:
    """doc_id, n_tokens and best_score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(counter)  # as large as the vocabulary

    def run(batches):
        for rows, buf, offsets in T.chunks(batches):
            tokens, scores = shared.value.count_chunk(buf, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tokens, pa.int64()), pa.array(scores)],
                                             names=["doc_id", "n_tokens", "best_score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, best_score double")
