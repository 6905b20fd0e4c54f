"""Alignment of two tokenizers' tokens over the bytes of each text, and corpus-wide counts of aligned pairs.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and sees a space and the text; B is a SentencePiece model, which puts the space
itself. Both cut the same bytes. Where they end in the text comes from the libraries' own spans: character offsets for A,
the begin and end of the proto's pieces for B. They are coarse: tokens that share a multibyte character have the same characters, and byte-fallback
pieces have spans of a whole character or of nothing. Between two clean borders such tokens are refined by the lengths of their decoded bytes,
and every token's decoded bytes must equal the text where it lies.

A text is cut before each single space that stands between characters other than white space. There both tokenizers always have a border (A's pattern starts
a word with the space; only the first character of a piece of B is a mark), so a segment that a task has aligned is not aligned again and texts are put
together from their segments; for the same reason segments that begin and end in a word are encoded many at a time. A long text without such spaces is one segment.

The alignment is stored, a row for each chunk of texts, and read for counting and for measuring. Linked pairs (A id, B id) are counted by
documents: each task counts its pairs, sums come from one aggregate by pair, and the table is written as sorted arrays that the measuring tasks map. Its size is bounded by the two vocabularies, not by the corpus.

Edge cases: null and empty texts, and texts whose joined token bytes differ from space and text (such as texts with U+2581), have no tokens;
special tokens' strings are plain text; repeated rows and null ids are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm import files
from rulesift.llm import textarrays as T
from rulesift.llm.pieces import MARK, ragged

#: Bytes of text in a chunk, of segments aligned at once, of segments encoded as one text; texts of one library call; chunks whose segments a task
#: remembers; pairs it holds.
CHUNK_BYTES, STEP_BYTES, RUN_BYTES, BATCH, KEPT, FLUSH = 3 << 19, 1 << 16, 1 << 10, 64, 12, 1 << 20
#: Pairs in one file of the table of counts.
PAIRS_A_FILE = 1 << 22


def byte_level() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes as: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


class TokenizerPair:
    """The files of two tokenizers as bytes, so that workers need no path; the libraries load them on first use."""

    def __init__(self, first: str, second: str):
        with open(first, encoding="utf-8") as f:
            self.first = f.read()
        with open(second, "rb") as f:
            self.second = f.read()
        self._made = None
        spec = json.loads(self.first)
        split = spec.get("pre_tokenizer") or {}
        pieces = self.made()[1]
        #: Whether both tokenizers have a border before each single space between words; if not, a text is one segment.
        self.separable = (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
                          and split.get("use_regex", True) and all(MARK not in pieces.id_to_piece(i).lstrip(MARK) for i in range(pieces.get_piece_size())))

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def made(self):
        if self._made is None:
            import sentencepiece
            from tokenizers import Tokenizer
            a = Tokenizer.from_str(self.first)
            a.encode_special_tokens = True
            b = sentencepiece.SentencePieceProcessor(model_proto=self.second)
            of = byte_level()
            tokens_a = [b""] * a.get_vocab_size(with_added_tokens=True)
            for token, i in a.get_vocab(with_added_tokens=False).items():
                tokens_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else b""
            tokens_b = []
            for i in range(b.get_piece_size()):
                piece = b.id_to_piece(i)
                tokens_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else piece.replace(MARK, " ").encode())
            self._made = a, b, _table(tokens_a), _table(tokens_b)
        return self._made

    def align(self, buf: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids of A, how many each segment has, ids of B, how many, whether a segment's tokens are its bytes; the others have none).
        Each segment begins with a space; those that aren't to be encoded ``alone`` also begin a word there and end in one, so that neighbours don't change each other's tokens."""
        parts, n = [], len(offsets) - 1
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
            parts.append(self._align(buf[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], alone[at:to]))
            at = to
        return _joined(parts)

    def _align(self, buf: np.ndarray, offsets: np.ndarray, alone: np.ndarray):
        a, b, bytes_a, bytes_b = self.made()
        # runs of segments that are encoded as one text
        n = len(offsets) - 1
        block = offsets[:-1] // RUN_BYTES
        head = np.ones(n, bool)
        head[1:] = (block[1:] != block[:-1]) | alone[1:] | alone[:-1]
        cuts = np.append(offsets[:-1][head], offsets[-1])
        data = buf.tobytes()
        texts = [data[x:y].decode() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        # the place of each character
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        place, first_char = np.append(lead, len(buf)), np.searchsorted(lead, cuts)
        found = [x for at in range(0, len(texts), BATCH) for x in _spans_a(a, texts[at:at + BATCH])]
        count = np.array([len(f[0]) for f in found], np.int64)
        ids_a = T.concat([f[0] for f in found], np.int64)
        span = (np.concatenate([f[1] for f in found]) if found else np.zeros((0, 2), np.int64)) + np.repeat(first_char[:-1], count)[:, None]
        ends_a, fit_a = refine(buf, cuts, ids_a, count, place[span[:, 0]], place[span[:, 1]], bytes_a)
        found = [x for at in range(0, len(texts), BATCH) for x in _spans_b(b, [t[1:] for t in texts[at:at + BATCH]])]
        count = np.array([len(f[0]) for f in found], np.int64)
        ids_b = T.concat([f[0] for f in found], np.int64)
        # spans are in bytes of the text after the space; the first piece takes the space too
        span = (np.concatenate([f[1] for f in found]) if found else np.zeros((0, 2), np.int64)) + np.repeat(cuts[:-1] + 1, count)[:, None]
        span[(np.cumsum(count) - count)[count > 0], 0] -= 1
        ends_b, fit_b = refine(buf, cuts, ids_b, count, span[:, 0], span[:, 1], bytes_b)
        ok, parts = np.ones(n, bool), []
        for ids, ends, fit in ((ids_a, ends_a, fit_a), (ids_b, ends_b, fit_b)):
            own = np.clip(np.searchsorted(offsets, ends - 1, side="right") - 1, 0, n - 1)
            ok[own[~fit]] = False
            # tokens fill a segment: the last of it ends with it
            full = np.zeros(n, bool)
            full[own[ends == offsets[own + 1]]] = True
            ok &= full
            parts.append((ids, own))
        out = []
        for ids, own in parts:
            keep = ok[own]
            out += [ids[keep].astype(np.int32), np.bincount(own[keep], minlength=n).astype(np.int32)]
        return *out, ok


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 4 + (np.zeros(0, bool),)


class Known:
    """Aligned segments that a task has met, by hash: what each of the last ``KEPT`` chunks had new."""

    def __init__(self):
        self.blocks: deque[tuple[np.ndarray, tuple[np.ndarray, ...]]] = deque(maxlen=KEPT)

    def align(self, pair: TokenizerPair, keys: np.ndarray, cut) -> tuple[np.ndarray, ...]:
        """``TokenizerPair.align`` of the segments of sorted distinct ``keys``; ``cut`` makes its arguments for some of them."""
        todo, places, parts = np.arange(len(keys)), [], []
        for stored, block in self.blocks:
            at = np.minimum(np.searchsorted(stored, keys[todo]), len(stored) - 1)
            hit = stored[at] == keys[todo]
            places.append(todo[hit])
            parts.append(_taken(block, at[hit]))
            todo = todo[~hit]
        if len(todo):
            new = pair.align(*cut(todo))
            self.blocks.append((keys[todo], new))
            places.append(todo)
            parts.append(new)
        return _taken(_joined(parts), np.argsort(T.concat(places, np.int64)))


def _taken(parts: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments at some places."""
    a, count_a, b, count_b, ok = parts
    first_a, first_b = np.cumsum(count_a, dtype=np.int64) - count_a, np.cumsum(count_b, dtype=np.int64) - count_b
    return ragged(a, first_a[at], count_a[at].astype(np.int64)), count_a[at], ragged(b, first_b[at], count_b[at].astype(np.int64)), count_b[at], ok[at]


def _spans_a(tokenizer, texts: list[str]):
    """(ids, character spans) of each text."""
    for e in tokenizer.encode_batch(texts, add_special_tokens=False):
        yield np.array(e.ids, np.int64), _pairs(e.offsets)


def _spans_b(tokenizer, texts: list[str]):
    """(ids, byte spans) of each text: the begin and end of its proto's pieces, which the library also gives as an offset mapping."""
    for m in tokenizer.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1):
        yield np.array(m["ids"], np.int64), _pairs(m["offsets"])


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def refine(buf: np.ndarray, cuts: np.ndarray, ids: np.ndarray, count: np.ndarray, begin: np.ndarray, end: np.ndarray,
           table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(end of each token in ``buf``, whether the token is the bytes there) from coarse spans and the tokens' bytes; texts lie between ``cuts``."""
    flat, first, size = table
    total = len(ids)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(cuts) - 1), count)
    # a border is clean where the next token begins at this one's end and this one isn't empty
    last = np.cumsum(count)[count > 0] - 1
    clean = np.zeros(total, bool)
    clean[:-1] = (begin[1:] == end[:-1]) & (end[:-1] > begin[:-1])
    clean[last] = True
    coarse = end.copy()
    coarse[last] = cuts[1:][count > 0]
    # bytes of tokens since the last clean border
    length = size[ids]
    run = np.cumsum(length)
    from_clean = np.concatenate([[True], clean[:-1]])
    start = np.where(np.concatenate([[True], text[1:] != text[:-1]]), cuts[text], np.concatenate([[0], coarse[:-1]]))
    anchor = np.maximum.accumulate(np.where(from_clean, np.arange(total), 0))
    fine = start[anchor] + run - (run[anchor] - length[anchor])
    ends = np.where(clean, coarse, fine)
    begins = np.concatenate([[0], ends[:-1]])
    begins[from_clean] = start[from_clean]
    good = (ends - begins == length) & (length > 0) & (begins >= 0) & (ends <= len(buf))
    # tokens of the right length must have the text's bytes there
    test = np.flatnonzero(good)
    mine = ragged(flat, first[ids[test]], length[test])
    there = ragged(buf, begins[test], length[test])
    same = np.concatenate([[0], np.cumsum(mine != there)])
    ends_of = np.concatenate([[0], np.cumsum(length[test])])
    good[test] = same[ends_of[1:]] == same[ends_of[:-1]]
    return ends, good


@dataclass
class Segments:
    """Token ids and ends (in one buffer) of segments; both tokenizations are the segments' bytes."""

    offsets: np.ndarray
    a: np.ndarray
    count_a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    count_b: np.ndarray
    ends_b: np.ndarray
    _links: tuple = field(default=(), repr=False)

    @staticmethod
    def of(a: np.ndarray, count_a: np.ndarray, b: np.ndarray, count_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Segments:
        """Of aligned tokens: ``size_a`` and ``size_b``, the bytes of each token, give where they end."""
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        offsets = np.concatenate([[0], ends_a])[np.concatenate([[0], np.cumsum(count_a)])]
        return Segments(offsets, a, count_a, ends_a, b, count_b, ends_b)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, links of each segment): two tokens overlap in one piece of the common refinement of both cuts."""
        if not self._links:
            cuts = _distinct(np.sort(np.concatenate([self.ends_a, self.ends_b])))
            # the tokens that hold the byte before each cut
            self._links = (np.searchsorted(self.ends_a, cuts), np.searchsorted(self.ends_b, cuts),
                           np.diff(np.searchsorted(cuts, self.offsets, side="right")))
        return self._links

    def groups(self) -> np.ndarray:
        """How many groups each segment has: ends that both tokenizations share."""
        both = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        return np.diff(np.searchsorted(both, self.offsets, side="right"))

    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first, count) of each segment as ``a1,a2|b1;a3|b2,b3;``."""
        shared_a, shared_b = np.isin(self.ends_a, self.ends_b), np.isin(self.ends_b, self.ends_a)
        digits, first, size = _decimals(max(int(self.a.max(initial=0)), int(self.b.max(initial=0))) + 1)
        # tokens in writing order: by the group's end, A before B
        group_a = np.searchsorted(self.ends_a[shared_a], self.ends_a)
        group_b = np.searchsorted(self.ends_b[shared_b], self.ends_b)
        order = np.lexsort((np.concatenate([np.zeros(len(group_a), np.int8), np.ones(len(group_b), np.int8)]), np.concatenate([group_a, group_b])))
        ids = np.concatenate([self.a, self.b])[order]
        mark = np.concatenate([np.where(shared_a, ord("|"), ord(",")), np.where(shared_b, ord(";"), ord(","))])[order].astype(np.uint8)
        length = size[ids] + 1
        out = ragged(digits, first[ids], length)  # each number has a place for its mark
        out[np.cumsum(length) - 1] = mark
        segment = np.searchsorted(self.offsets, np.concatenate([self.ends_a, self.ends_b])[order] - 1, side="right") - 1
        total = np.bincount(segment, length, len(self.count_a)).astype(np.int64)
        return out, np.cumsum(total) - total, total


_DECIMALS: dict[int, tuple] = {}


def _decimals(n: int):
    """Decimal numbers below a power of two of at least n, each with one byte after it: (bytes, first, digits)."""
    n = 1 << max(n - 1, 1).bit_length()
    if n not in _DECIMALS:
        words = [str(i).encode() for i in range(n)]
        size = np.array([len(w) for w in words], np.int64)
        _DECIMALS[n] = np.frombuffer(b",".join(words) + b",", np.uint8).copy(), np.cumsum(size + 1) - size - 1, size
    return _DECIMALS[n]


_SPACE = ~T.NOT_SPACE
#: White space beyond ASCII as UTF-8 (fixed values): these runs of code points, first and last.
_WIDE_SPACE = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_MARK_BYTES = MARK.encode()


def white(buf: np.ndarray) -> np.ndarray:
    """Bytes of white-space characters and of the mark, which SentencePiece takes for a space."""
    out = _SPACE[buf]
    if (buf >= 0x80).any():
        wide = [chr(c).encode() for lo, hi in _WIDE_SPACE for c in range(lo, hi + 1)] + [_MARK_BYTES]
        for first in {w[0] for w in wide}:
            at = np.flatnonzero(buf == first)
            for w in (w for w in wide if w[0] == first):
                hit = at[at + len(w) <= len(buf)]
                for k in range(1, len(w)):
                    hit = hit[buf[hit + k] == w[k]]
                for k in range(len(w)):
                    out[hit + k] = True
    return out


def segments(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first segment of each text) of the segments; every one but a text's first begins with its space. ``space``: ``white(buf)``."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = buf == 0x20
    cut[0] = cut[-1] = False
    cut[1:-1] &= ~space[:-2] & ~space[2:]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    # a space that ends a text stays with the word before it
    cut[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of each slice between neighbouring cuts."""
    total = np.concatenate([[0], np.cumsum(values)])[cuts]
    return np.diff(total)


class Chunk:
    """Texts as sequences of distinct, aligned segments: ``place`` is the segment of each step, ``text`` its text."""

    def __init__(self, n: int, text: np.ndarray, place: np.ndarray, segments: Segments):
        self.n, self.text, self.place, self.segments = n, text, place, segments

    @staticmethod
    def align(pair: TokenizerPair, buf: np.ndarray, offsets: np.ndarray, known: Known | None = None) -> Chunk:
        known = known or Known()
        space = white(buf)
        starts, ends, first = segments(buf, offsets, space if pair.separable else np.ones(len(buf), bool))
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        # a text's first segment gets the space it lacks; the others' own space is the same one
        bare = np.zeros(len(starts), bool)
        bare[first[:-1][np.diff(first) > 0]] = True
        starts = starts + ~bare
        keys, where, place = np.unique(T.hash_ranges(buf, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[where], ends[where]
        marks = np.concatenate([[0], np.cumsum((buf == _MARK_BYTES[0]) & space)])

        def cut(some: np.ndarray):
            a, b = starts[some], ends[some]
            size = b - a
            cuts = np.concatenate([[0], np.cumsum(size + 1)])
            spaced = np.full(int(cuts[-1]), 0x20, np.uint8)
            spaced[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)] = ragged(buf, a, size)
            return spaced, cuts, space[a] | space[b - 1] | (marks[b] > marks[a]) | (not pair.separable)

        *tokens, ok = known.align(pair, keys, cut)
        aligned = Segments.of(*tokens, pair.made()[2][2], pair.made()[3][2])
        bad = np.zeros(n, bool)
        bad[text[~ok[place]]] = True
        keep = ~bad[text]  # texts without tokens lose their segments
        return Chunk(n, text[keep], place[keep], aligned)

    def packed(self) -> bytes:
        s = self.segments
        return T.pack_many(*((np.asarray(x), False) for x in (np.bincount(self.text, minlength=self.n), self.place, s.count_a, s.a, s.count_b, s.b)))

    @staticmethod
    def unpacked(data: bytes, size_a: np.ndarray, size_b: np.ndarray) -> Chunk:
        """``size_a`` and ``size_b``: bytes of each token; they give the ends of the tokens again."""
        steps, place, count_a, a, count_b, b = (x.astype(np.int64) for x in T.unpack_many(data))
        return Chunk(len(steps), np.repeat(np.arange(len(steps)), steps), place, Segments.of(a, count_a, b, count_b, size_a, size_b))

    def sums(self, of_segment: np.ndarray) -> np.ndarray:
        """Sum over each text's segments."""
        return _sums(of_segment[self.place].astype(np.int64), np.searchsorted(self.text, np.arange(self.n + 1)))

    def link_keys(self, wide: int) -> np.ndarray:
        a, b, _ = self.segments.links()
        return self.segments.a[a].astype(T.U64) * T.U64(wide) + self.segments.b[b].astype(T.U64)

    def pairs(self, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair, how many of the texts hold it linked)."""
        keys, rank = np.unique(self.link_keys(wide), return_inverse=True)
        count = self.segments.links()[2]
        used, _ = T.counted((self.text.astype(T.U64) << T.U64(32)) | self.place.astype(T.U64))
        place, text = (used & T.U64(0xFFFFFFFF)).astype(np.int64), used >> T.U64(32)
        of_text = np.repeat(text, count[place])
        ranks = ragged(rank, (np.cumsum(count) - count)[place], count[place])
        cells = _distinct(np.sort((of_text << T.U64(32)) | ranks.astype(T.U64)))
        n = np.bincount((cells & T.U64(0xFFFFFFFF)).astype(np.int64), minlength=len(keys))
        return keys[n > 0], n[n > 0]


def _aligned(shared):
    """One row a chunk: the documents' ids and the packed alignment."""
    def run(batches):
        known = Known()
        for rows, buf, offsets in T.chunks(batches, size=CHUNK_BYTES):
            ids = rows.column(0)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                              pa.array([Chunk.align(shared.value, buf, offsets, known).packed()], pa.binary())], names=["doc_ids", "payload"])
    return run


def _chunks(batches, sizes):
    """(document ids, chunk) of stored rows."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0).slice(i, 1).flatten(), Chunk.unpacked(b.column(1)[i].as_py(), *sizes.value)


def _pair_counts(sizes, wide: int):
    def out(keys, n):
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)].view(np.int64)), pa.array(n[at:at + (1 << 16)].astype(np.int64))],
                                             names=["pair", "n"])

    def run(batches):
        held, size = [], 0

        def merged():
            return T.counted(T.concat([h[0] for h in held]), T.concat([h[1] for h in held], np.int64))

        for _, chunk in _chunks(batches, sizes):
            held.append(chunk.pairs(wide))
            size += len(held[-1][0])
            if size >= FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*merged())
    return run


@dataclass
class PairCounts:
    """Documents of each linked pair, in files of sorted pairs: (first pair, path, pairs)."""

    wide: int
    parts: list[tuple[int, str, int]]
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whether no pair of the A id has more) of sorted pairs."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        cuts = np.append(np.searchsorted(keys, np.array([p[0] for p in self.parts], T.U64)), len(keys))
        for (_, path, n), a, b in zip(self.parts, cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if path not in self._maps:
                self._maps[path] = (files.map_array(path, np.uint64, n), files.map_array(path, np.int64, n, 8 * n), files.map_array(path, np.bool_, n, 16 * n))
            stored, counts, bests = self._maps[path]
            at = np.minimum(np.searchsorted(stored, keys[a:b]), n - 1)
            hit = stored[at] == keys[a:b]
            count[a:b] = np.where(hit, counts[at], 0)
            best[a:b] = hit & bests[at]
        return count, best


def _write_pairs(folder: str):
    def run(batches):
        parts = list(batches)  # one range of about PAIRS_A_FILE pairs
        if not sum(b.num_rows for b in parts):
            return
        pair, n, best = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(3))
        path = files.write_bytes(folder, "pairs", pair.astype(np.uint64).tobytes(), n.astype(np.int64).tobytes(), best.astype(np.bool_).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([int(pair[0])], pa.int64()), pa.array([path]), pa.array([len(pair)], pa.int64())],
                                         names=["first", "path", "n"])
    return run


class Aligner:
    """The aligned texts of a table, stored in the shared folder: each text is encoded once."""

    def __init__(self, docs: DataFrame, pair: TokenizerPair):
        self.spark = docs.sparkSession
        size_a, size_b = (t[2] for t in pair.made()[2:])
        self.wide = len(size_b)
        self.sizes = self.spark.sparkContext.broadcast((size_a, size_b))  # a number for each token of the vocabularies
        shared = self.spark.sparkContext.broadcast(pair)                  # two vocabulary files
        self.path = f"{files.scratch(self.spark, 'aligned')}/chunks"
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_aligned(shared), self._CHUNK).write.parquet(self.path)

    _CHUNK = "doc_ids array<long>, payload binary"

    def chunks(self) -> DataFrame:
        """doc_ids and the packed alignment of their texts (``Chunk.unpacked``)."""
        return self.spark.read.schema(self._CHUNK).parquet(self.path)

    def tokens(self) -> DataFrame:
        """doc_id, the ids of both tokenizations and the byte offsets (in space and text) where each token ends."""
        sizes = self.sizes

        def run(batches):
            for ids, c in _chunks(batches, sizes):
                columns = [ids]
                for token, count, size in ((c.segments.a, c.segments.count_a, sizes.value[0]), (c.segments.b, c.segments.count_b, sizes.value[1])):
                    own = ragged(token, (np.cumsum(count) - count)[c.place], count[c.place])
                    cuts = np.concatenate([[0], np.cumsum(c.sums(count))])
                    total = np.concatenate([[0], np.cumsum(size[own])])
                    ends = total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))
                    columns += [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind)) for x, kind in ((own, pa.int32()), (ends, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "a_ends", "b", "b_ends"])

        return self.chunks().mapInArrow(run, "doc_id long, a array<int>, a_ends array<long>, b array<int>, b_ends array<long>")

    def link_counts(self) -> DataFrame:
        """a, b, n: how many documents hold the pair linked."""
        return (self.chunks().mapInArrow(_pair_counts(self.sizes, self.wide), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                .select(F.expr(f"pair div {self.wide}").alias("a"), F.pmod("pair", F.lit(self.wide)).alias("b"), "n"))

    def stored_counts(self) -> PairCounts:
        """``link_counts`` as files, each pair with whether its count is its A id's highest."""
        folder = files.scratch(self.spark, "token-pairs")
        counts = self.link_counts().checkpoint()
        n = counts.count()
        highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))  # at most a row for each id of A
        marked = counts.join(highest, "a").select((F.col("a") * self.wide + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"))
        made = (marked.repartitionByRange(max(1, -(-n // PAIRS_A_FILE)), "pair").sortWithinPartitions("pair")
                .mapInArrow(_write_pairs(folder), "first long, path string, n long").collect())  # a row for each file
        return PairCounts(self.wide, sorted(tuple(r) for r in made))

    def measures(self, counts: PairCounts) -> DataFrame:
        """Of every row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
        sizes, wide = self.sizes, self.wide

        def run(batches):
            for ids, c in _chunks(batches, sizes):
                s = c.segments
                n_links = s.links()[2]
                keys, rank = np.unique(c.link_keys(wide), return_inverse=True)
                count, best = counts.look_up(keys)
                cuts = np.concatenate([[0], np.cumsum(n_links)])
                of = lambda x: _sums(x[rank].astype(np.int64), cuts)
                flat, first, size = s.written()
                out = ragged(flat, first[c.place], size[c.place]).tobytes()
                ends = np.concatenate([[0], np.cumsum(c.sums(size))]).tolist()
                digests = [hashlib.sha256(out[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c.sums(x)) for x in (s.count_a, s.count_b, s.groups(), n_links, of(best), of(count))), pa.array(digests, pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        return self.chunks().mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_corpus(docs: DataFrame, pair: TokenizerPair) -> DataFrame:
    """``Aligner.measures`` with the counts of the whole table."""
    aligner = Aligner(docs, pair)
    return aligner.measures(aligner.stored_counts())
