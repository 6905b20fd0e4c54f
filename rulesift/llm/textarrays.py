"""Columnar text helpers used inside Arrow tasks.

A batch of texts is one byte buffer plus offsets. Words, hashes and windows are
numpy arrays over that buffer, so no Python object is made per word.

Hashes are 64 bits: a polynomial over the bytes modulo 2**64 (prefix sums give
the hash of any byte range in O(1)), finished with a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Null document ids travel as this value inside the operators.
NULL_ID = -(1 << 63)

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the two tokenisations the operators use.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(n - 1, 1).bit_length()
            inverse = pow(int(_BASE), -1, 1 << 64)
            for name, base in (("up", int(_BASE)), ("down", inverse)):
                out = np.full(size, U64(base), U64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up, self.down


_POWERS = _Powers()


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: entry i covers ``buf[:i]``."""
    up, _ = _POWERS.get(len(buf) + 1)
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum(_TABLE[buf] * up[:len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end) from ``prefix_sums`` (not yet mixed)."""
    _, down = _POWERS.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, buffer, offsets): slices of about ``size`` bytes of whole texts.

    A null text is empty. Offsets start at 0.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        kind = column.type
        if not (pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)):
            column = column.cast(pa.large_binary() if pa.types.is_binary(kind) else pa.large_string())
        n, off0 = len(column), column.offset
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], np.int64, n + 1, off0 * 8).copy()
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        if column.null_count:
            # null slots may span bytes in a sliced array; rebuild them as empty
            column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
            raw = column.buffers()
            offsets = np.frombuffer(raw[1], np.int64, n + 1, column.offset * 8).copy()
            data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), n)
            lo, hi = int(offsets[at]), int(offsets[to])
            yield batch.slice(at, to - at), data[lo:hi], offsets[at:to + 1] - lo
            at = to


def column_ids(rows: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """A long column as int64, null as ``NULL_ID``."""
    col = rows.column(rows.schema.get_field_index(name))
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def arrow_ids(ids: np.ndarray) -> pa.Array:
    """Inverse of ``column_ids``."""
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def find_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes inside each text: (start, end, first word of each text)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[buf]
    first = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
    s = m.copy()
    s[1:] &= ~m[:-1]
    s[first] = m[first]
    e = m.copy()
    e[:-1] &= ~m[1:]
    last = np.append(first[1:], n) - 1
    e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each (ordered, disjoint) byte range; blocks bound the memory."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(ends, lo + CHUNK_BYTES, side="right"))
        to = max(to, at + 1)
        hi = int(ends[to - 1])
        prefix = prefix_sums(buf[lo:hi])
        h = range_hash(prefix, starts[at:to] - lo, ends[at:to] - lo)
        out[at:to] = mix(h + (ends[at:to] - starts[at:to]).astype(U64))
        at = to
    return out


def hash_bytes(word: bytes) -> int:
    """The hash ``hash_ranges`` gives to one byte string."""
    buf = np.frombuffer(word, np.uint8)
    return int(hash_ranges(buf, np.array([0]), np.array([len(buf)]))[0])


def word_table(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE,
               lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text) with A-Z folded to a-z."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = find_words(buf, offsets, is_word)
    return hash_ranges(buf, starts, ends), first


_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                     0x589965CC75374CC3], U64)


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words inside one text, text of each run).

    A text with fewer words, but not none, has one run: all its words.
    """
    n_words = np.diff(first)
    n_runs = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n_words)), n_runs)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + first[:-1][text]
    length = np.minimum(n_words[text], width)
    acc = np.zeros(len(text), U64)
    factor = U64(1)
    for j in range(width):
        factor = U64((int(factor) * int(_SHINGLE[j % 5]) + 2 * j + 1) & ((1 << 64) - 1) | 1)
        ok = length > j
        if ok.all():
            acc += words[start + j] * factor
        else:
            acc[ok] += words[start[ok] + j] * factor
    return mix(acc + length.astype(U64)), text


# --- packed integer arrays for shuffles -------------------------------------------------

_CODEC = "zstd"


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Unsigned integers as byte planes, compressed; ``ordered`` stores differences."""
    v = np.ascontiguousarray(values, U64)
    if ordered and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T if len(v) else np.zeros((width, 0), np.uint8)
    raw = np.ascontiguousarray(planes).tobytes()
    body = pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b""
    return np.array([len(v), width, int(ordered)], "<u4").tobytes() + body


def unpack(data: bytes) -> np.ndarray:
    n, width, ordered = (int(x) for x in np.frombuffer(data, "<u4", 3))
    if not n:
        return np.zeros(0, U64)
    raw = pa.decompress(memoryview(data)[12:], n * width, codec=_CODEC, asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    v = out.reshape(-1).view(U64)
    return np.cumsum(v, dtype=U64) if ordered else v


def pack_many(*arrays: tuple[np.ndarray, bool]) -> bytes:
    parts = [pack(a, o) for a, o in arrays]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_many(data: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", k, 4)
    out, at = [], 4 * (k + 1)
    for size in sizes:
        out.append(unpack(data[at:at + int(size)]))
        at += int(size)
    return out


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with what weight) each occurs."""
    if weights is None:
        v = np.sort(values)
    else:
        order = np.argsort(values)
        v, weights = values[order], weights[order]
    if not len(v):
        return v, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    if weights is None:
        return v[head], np.diff(np.append(head, len(v)))
    return v[head], np.add.reduceat(weights, head)


def concat(parts: list[np.ndarray], dtype=U64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
