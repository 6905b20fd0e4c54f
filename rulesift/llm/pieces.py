"""Piece vocabularies as automatons, and texts as sequences of units.

``Pieces`` holds a vocabulary of strings with scores. ``Automaton`` is its Aho-Corasick
automaton as dense numpy tables, stepped for many words at once. ``units`` cuts
normalised texts where no piece can reach across: at the white-space mark and at bytes that occur in no piece.
A distinct word of a chunk is then encoded once, and the documents are put together from the results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rulesift.llm import textarrays as T

#: The white-space mark of SentencePiece vocabularies, U+2581.
MARK = "▁"
_MARK_BYTES = MARK.encode()


@dataclass
class Pieces:
    """A vocabulary: strings, scores and the ids of the 256 byte pieces."""

    strings: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    special: set[int]

    @staticmethod
    def load(path: str) -> Pieces:
        """From a SentencePiece model file with byte fallback."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        strings = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, -1)
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(strings[i][3:5], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return Pieces(strings, np.array([sp.get_score(i) for i in range(n)]), byte_ids, special)

    def check(self, ids) -> None:
        """The mark only begins pieces, and every character of a piece is a piece."""
        known = {self.strings[i] for i in ids}
        for i in ids:
            s = self.strings[i]
            if MARK in s.lstrip(MARK):
                raise ValueError(f"piece {s!r} reaches over the white-space mark")
            if any(c not in known for c in s):
                raise ValueError(f"a character of piece {s!r} is no piece")


class Automaton:
    """Aho-Corasick automaton over the bytes of the pieces ``ids``."""

    def __init__(self, strings: list[str], ids):
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in ids:
            s = 0
            for b in strings[i].encode():
                t = children[s].get(b)
                if t is None:
                    t = children[s][b] = len(children)
                    children.append({})
                    piece.append(-1)
                s = t
            piece[s] = i
        used = sorted({b for c in children for b in c})
        self.cls = np.zeros(256, np.int64)
        self.cls[used] = np.arange(1, len(used) + 1)
        self.known = self.cls > 0
        n = len(children)
        self.piece = np.array(piece)
        self.goto = np.zeros((n, len(used) + 1), np.int32)
        fail = np.zeros(n, np.int64)
        #: nearest state on the failure chain, itself included, that ends a piece
        self.out = np.full(n, -1, np.int64)
        level = np.array([0])
        while len(level):
            if level[0]:
                self.goto[level] = self.goto[fail[level]]
            self.out[level] = np.where(self.piece[level] >= 0, level, self.out[fail[level]] if level[0] else -1)
            nxt = []
            for s in level.tolist():
                for b, t in children[s].items():
                    fail[t] = self.goto[s, self.cls[b]] if s else 0
                    self.goto[s, self.cls[b]] = t
                    nxt.append(t)
            level = np.array(nxt, np.int64)
        #: the next shorter piece that ends where the piece of a state ends
        self.shorter = self.out[fail]
        self.shorter[0] = -1
        self.size = np.zeros(len(strings) + 5, np.int64)
        for i in ids:
            self.size[i] = len(strings[i].encode())


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in the text as spaces, and a space before each text that isn't empty."""
    at = np.flatnonzero((buf[:-2] == _MARK_BYTES[0]) & (buf[1:-1] == _MARK_BYTES[1]) & (buf[2:] == _MARK_BYTES[2])) if len(buf) > 2 else []
    if len(at):
        keep = np.ones(len(buf), bool)
        keep[at + 1] = keep[at + 2] = False
        buf = buf.copy()
        buf[at] = 0x20
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        buf = buf[keep]
    full = np.diff(offsets) > 0
    buf = np.insert(buf, offsets[:-1][full], np.uint8(0x20))
    return buf, offsets + np.concatenate([[0], np.cumsum(full)])


#: Kinds of units.
WORD, SPACES, BYTE = 0, 1, 2


def units(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray):
    """Runs of spaces, bytes that no piece has, and the words between, in order.

    Returns kind, start, end and text of each unit.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    table = np.where(known, WORD, BYTE)
    table[0x20] = SPACES
    table[0x80:] = WORD  # a byte of a longer character is taken with its character
    kind = table[buf]
    cut = np.ones(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BYTE)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    return kind[start], start, np.append(start[1:], n), np.searchsorted(offsets, start, side="right") - 1


def batches_of_words(buf, start, end, marks, most_bytes: int = 1 << 20):
    """Words longest first, in groups: (places, byte matrix, lengths); ``marks`` marks come before each word."""
    marks = marks.astype(np.int64)
    length = end - start + 3 * marks
    order = np.argsort(-length, kind="stable")
    a = 0
    while a < len(order):
        wide = int(length[order[a]])
        b = min(len(order), a + max(1, most_bytes // max(wide, 1)))
        # no word of a group is much shorter than the longest
        b = min(b, a + max(1, int(np.searchsorted(-length[order[a:b]], -(wide * 2 // 3), side="left"))) if wide > 24 else b)
        o = order[a:b]
        size = length[o]
        matrix = np.zeros((len(o), wide), np.uint8)
        column = np.arange(wide)
        lead = 3 * marks[o][:, None]
        ok = (column < size[:, None]) & (column >= lead)
        matrix[ok] = buf[(start[o][:, None] + column - lead)[ok]]
        front = column < lead
        matrix[front] = np.frombuffer(_MARK_BYTES, np.uint8)[np.broadcast_to(column % 3, front.shape)[front]]
        yield o, matrix, size
        a = b


def char_sizes(matrix: np.ndarray) -> np.ndarray:
    """At the last byte of each character its size in bytes, elsewhere 0."""
    n, wide = matrix.shape
    lead = np.select([matrix < 0x80, matrix >= 0xF0, matrix >= 0xE0, matrix >= 0xC0], [1, 4, 3, 2], 0)
    out = np.zeros((n, wide), np.int64)
    for k in (1, 2, 3, 4):
        if k <= wide:
            out[:, k - 1:][lead[:, :wide - k + 1] == k] = k
    return out


def ragged(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices flat[first:first + count], one after another."""
    total = int(count.sum())
    return flat[np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)]


def distinct_words(buf, start, end, marks):
    """(place of each word among the distinct ones, a representative of each)."""
    h = T.hash_ranges(buf, start, end) ^ (marks.astype(T.U64) * T.U64(0x9E3779B97F4A7C15))
    _, where, place = np.unique(h, return_index=True, return_inverse=True)
    return place, where
