"""Suffix-array dedup: every byte covered by a ``length``-byte string that starts earlier.

1. Anchors. In each window of ``length`` bytes the leftmost smallest hash among its
   ``SEED``-byte strings is the window's anchor, a function of the window's bytes
   alone, so equal windows have equal anchors at equal places. An anchor's context is the
   ``length`` bytes around it on either side that its windows can reach. A task sends each distinct
   (anchor, context) once, with its first place, to the shard of the anchor's hash;
   later equal contexts within the task are covered at once.
2. A shard drops anchors that occur once, covers all but the first of equal contexts, and asks
   for the bytes of the distinct contexts where an anchor has several.
3. The bytes are fetched from their documents and dealt by anchor; there a suffix array and its
   Burrows-Wheeler transform are made of the contexts, and threshold-bounded interval expansion
   (breadth-first backward extension; each new interval boundary at string length l is a common
   prefix of length l) marks the boundaries of all strings shorter than ``length``. What stays
   unmarked are the suffixes that share ``length`` bytes with a neighbour: all but the first of
   each interval are covered.
4. Covers are united per document and cut from the text. Covers and wanted places travel packed, one row for each task or shard and
   bucket of documents, and are put together by bucket before they meet the texts.

Places are ordered by doc_id (null first), then, for documents of one id but different texts, by a
hash of the text. Hashes only choose candidates, except that contexts (100 to 150 bytes)
with equal 48-bit hashes around an equal anchor count as equal.

Edge cases: null and empty texts have 0 bytes; matches never cross documents; repeated rows (same id
and same text) are one document and give one result row; texts shorter than ``length`` lose
nothing; overlapping repeats inside a text count; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm import files
from rulesift.llm import textarrays as T
from rulesift.llm.pieces import ragged
from rulesift.session import ensure_checkpoint_dir

SEED = 50
FLUSH_ANCHORS = 400_000
SHARD_BYTES = 6 << 20
ANCHOR_BITS, CONTEXT_BITS = 40, 48
#: Context bytes in one suffix array; the contexts of one key are never divided.
BWT_BYTES = 1 << 19
_PLACE_BITS = 26
_OTHER = T.U64(0x6A09E667F3BCC909)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(place, text) of the anchors of all windows, and the prefix sums of the buffer.

    Blocks of 2**26 bytes bound the packing of (hash, place) in 64 bits.
    """
    n, wide = len(buf), length - SEED + 1
    prefix = T.prefix_sums(buf)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, prefix
    start = np.arange(n - SEED + 1)
    h = T.mix(T.range_hash(prefix, start, start + SEED))
    places = []
    step = (1 << _PLACE_BITS) - wide
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    room = offsets[1:][text_of] - np.arange(n)  # bytes left in the text
    for lo in range(0, len(h) - wide + 1, step):
        part = h[lo:lo + step + wide - 1]
        packed = (part >> T.U64(_PLACE_BITS) << T.U64(_PLACE_BITS)) | np.arange(len(part), dtype=T.U64)
        smallest = sliding_min(packed, wide)
        ok = room[lo:lo + len(smallest)] >= length
        at = (smallest[ok] & T.U64((1 << _PLACE_BITS) - 1)).astype(np.int64) + lo
        if len(at):
            places.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    at = np.unique(T.concat(places, np.int64)) if len(places) > 1 else T.concat(places, np.int64)
    return at, text_of[at], prefix


def sliding_min(v: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of every ``wide`` consecutive values, by doubling."""
    out, have = v, 1
    while have * 2 <= wide:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < wide:
        out = np.minimum(out[:len(v) - wide + 1], out[wide - have:wide - have + len(v) - wide + 1])
    return out


_SENT = "shard int, bucket int, payload binary"


def _find_anchors(length: int, bits: int):
    """Rows without a bucket: a shard's packed anchors; with one: covers of its documents."""
    def run(batches):
        held, n = [], 0
        for rows, buf, offsets in T.chunks(batches):
            at, text, prefix = anchors(buf, offsets, length)
            left = np.minimum(at - offsets[text], length - SEED)
            right = np.minimum(offsets[text + 1] - at, length)
            # anchors have small hashes; another hash of the same bytes deals them evenly
            key = T.mix(T.range_hash(prefix, at, at + SEED) ^ _OTHER)
            context = T.mix(T.range_hash(prefix, at - left, at + right) + (left * 256 + right).astype(T.U64)) >> T.U64(64 - CONTEXT_BITS)
            held.append((key, context, T.column_ids(rows)[text], T.column_ids(rows, "tie")[text], at - offsets[text],
                         left.astype(np.int16), right.astype(np.int16)))
            n += len(at)
            if n >= FLUSH_ANCHORS:
                yield from _send(held, bits)
                held, n = [], 0
        if n:
            yield from _send(held, bits)
    return run


def _equal_runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows: whether a row equals the one before in all ``columns``."""
    same = np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    return np.concatenate([[False], same]) if len(columns[0]) else np.zeros(0, bool)


def _in_runs(equal: np.ndarray) -> np.ndarray:
    """Members of runs of two or more."""
    out = equal.copy()
    out[:-1] |= equal[1:]
    return out


def _collapse(key, context, ids, ties, at):
    """(rows to keep, rows that repeat an equal context elsewhere): the first place of each (key, context) is kept."""
    order = np.argsort(key)
    equal = _equal_runs(key[order])
    twice = _in_runs(equal)
    alone, order = order[~twice], order[twice]
    order = order[np.lexsort((at[order], ties[order], ids[order], context[order], key[order]))]
    equal = _equal_runs(key[order], context[order])
    first = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))] if len(order) else order
    # repeated rows of one document meet at one place, which is no repeat
    other = equal & ((ids[order] != ids[first]) | (ties[order] != ties[first]) | (at[order] != at[first]))
    return np.concatenate([alone, order[~equal]]), order[other]


def _send(held: list, bits: int) -> Iterator[pa.RecordBatch]:
    key, context, ids, ties, at, left, right = (np.concatenate(x) for x in zip(*held))
    keep, covered = _collapse(key, context, ids, ties, at)
    yield _spans(ids[covered], ties[covered], at[covered] - left[covered], at[covered] + right[covered], bits)
    order = keep[np.argsort(key[keep])]
    key, context, ids, ties, at, left, right = (x[order] for x in (key, context, ids, ties, at, left, right))
    cuts = np.searchsorted((key >> T.U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    kept = (key >> T.U64(64 - bits - ANCHOR_BITS)) & T.U64((1 << ANCHOR_BITS) - 1)
    shards = np.flatnonzero(np.diff(cuts))
    out = []
    for s in shards:
        a = slice(cuts[s], cuts[s + 1])
        docs, place = _distinct_docs(ids[a], ties[a])
        out.append(T.pack_many((kept[a], True), (context[a], False), (place, False), (at[a], False), (left[a], False), (right[a], False),
                               (docs[0].view(T.U64), False), (docs[1].view(T.U64), False)))
    yield _packed_rows(shards, out)


def _packed_rows(shards, payloads) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.nulls(len(shards), pa.int32()), pa.array(payloads, pa.binary())],
                                      names=["shard", "bucket", "payload"])


def _distinct_docs(ids, ties):
    order = np.lexsort((ties, ids))
    new = ~_equal_runs(ids[order], ties[order])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    head = order[new]
    return (ids[head], ties[head]), place


def _united(ids, ties, start, end):
    """(documents, document of each united span, spans as start * 2**32 + bytes), by document."""
    docs, doc = _distinct_docs(ids, ties)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    far = (int(end.max()) + 1) if len(end) else 1
    s, e = unite(start + doc * far, end + doc * far)
    doc = s // far
    return docs, doc, ((s - doc * far) << 32) | (e - s)


def _spans(ids, ties, start, end, bits: int, shard: int | None = None) -> pa.RecordBatch:
    """Covers, united per document. Without ``shard`` the rows are dealt over the shards, to travel with the anchors."""
    return _bucket_rows(*_united(ids, ties, start, end), bits, shard)


def _bucket_rows(docs, doc, flat, bits: int, shard: int | None) -> pa.RecordBatch:
    """One row for each of 2**bits buckets that documents fall in: packed ids, ties, how many numbers each has, the numbers."""
    ids, ties = docs
    count = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    bucket = (T.mix(ids.view(T.U64) ^ T.mix(ties.view(T.U64))) >> T.U64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    flat = ragged(flat, (np.cumsum(count) - count)[order], count[order])
    ids, ties, count, bucket = ids[order], ties[order], count[order], bucket[order]
    some, first = np.unique(bucket, return_index=True)
    cuts, ends = np.append(first, len(ids)), np.concatenate([[0], np.cumsum(count)])
    payloads = [T.pack_many((ids[a:b].view(T.U64), False), (ties[a:b].view(T.U64), False), (count[a:b], False), (flat[ends[a]:ends[b]], False))
                for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(some if shard is None else np.full(len(some), shard), pa.int32()), pa.array(some, pa.int32()),
                                       pa.array(payloads, pa.binary())], names=["shard", "bucket", "payload"])


def _gather(covers: bool):
    """One row a document from the packed rows, which come by bucket: its united covers, or its wanted places."""
    def rows(parts):
        ids, ties, count, flat = (np.concatenate(x).view(np.int64) for x in zip(*parts))
        ids, ties = np.repeat(ids, count), np.repeat(ties, count)
        if covers:
            docs, doc, flat = _united(ids, ties, flat >> 32, (flat >> 32) + (flat & 0xFFFFFFFF))
        else:
            docs, doc = _distinct_docs(ids, ties)
            order = np.lexsort((flat, doc))
            doc, flat = doc[order], flat[order]
        cuts = np.searchsorted(doc, np.arange(len(docs[0]) + 1))
        return pa.RecordBatch.from_arrays([pa.array(docs[0]), pa.array(docs[1]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))],
                                          names=["doc_id", "tie", "spans"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if held and bucket != last:
                    yield rows(held)
                    held = []
                held.append(T.unpack_many(payload.as_py()))
                last = bucket
        if held:
            yield rows(held)
    return run


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans sorted by start; touching spans are one run."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[head], reach[np.append(head[1:], len(start)) - 1]


def _split(table: pa.Table) -> tuple[pa.Table, list[list[np.ndarray]]]:
    """(cover rows that only pass, unpacked payloads)."""
    sent = table.column("bucket").is_null()
    passed = table.filter(pc.invert(sent))
    passed = passed.set_column(0, "shard", pa.array(np.full(len(passed), -1), pa.int32()))
    return passed, [T.unpack_many(c.as_py()) for c in table.filter(sent).column("payload")]


def _meet(length: int, bits: int):
    """Of a shard of anchors: covers (shard -1) and the places whose bytes are needed (shard -2)."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        passed, parts = _split(table)
        if not parts:
            return passed
        kept = np.concatenate([p[0] for p in parts])
        order = np.argsort(kept)
        order = np.sort(order[_in_runs(_equal_runs(kept[order]))])
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        cuts = np.searchsorted(order, base)
        columns: list = [[], [], [], [], [], []]
        for i, p in enumerate(parts):
            own = order[cuts[i]:cuts[i + 1]] - base[i]
            doc = p[2][own].astype(np.int64)
            for c, v in zip(columns, (p[1][own], p[6].view(np.int64)[doc], p[7].view(np.int64)[doc], *(p[k][own].astype(np.int64) for k in (3, 4, 5)))):
                c.append(v)
        del parts
        kept = kept[order]
        context, ids, ties, at, left, right = map(np.concatenate, columns)
        keep, covered = _collapse(kept, context, ids, ties, at)
        out = [_spans(ids[covered], ties[covered], at[covered] - left[covered], at[covered] + right[covered], bits, -1)]
        keep = keep[np.argsort(kept[keep])]
        _, place, n = np.unique(kept[keep], return_inverse=True, return_counts=True)
        n = n[place]
        keep, n = keep[n > 1], n[n > 1]
        tier = np.searchsorted(TIERS, n)  # contexts of an anchor, by tens and thousands
        docs, doc = _distinct_docs(ids[keep], ties[keep])
        order = np.argsort(doc, kind="stable")
        out.append(_bucket_rows(docs, doc[order], (at[keep] * 4 + tier)[order], bits, -2))
        return pa.concat_tables([passed, pa.Table.from_batches(out)])
    return run


#: Groups of so many distinct contexts are divided by longer keys: the windows around an anchor are taken
#: in runs of REACH + 1 offsets, each run keyed by the bytes all its windows share (``length`` - REACH). The
#: last is the windows themselves: equal keys are then equal contexts, and no group is left.
TIERS = np.array([64, 4096, 65536])
REACH = (50, 25, 6, 0)


def _fetch(length: int, bits: int):
    """Cut the wanted contexts out of their texts and pack them by shard."""
    def run(batches):
        held, n = [], 0
        for rows, buf, offsets in T.chunks(batches):
            ids, ties = T.column_ids(rows), T.column_ids(rows, "tie")
            wanted = rows.column(rows.schema.get_field_index("spans"))
            flat = wanted.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets.to_numpy()))
            prefix = T.prefix_sums(buf)
            begin, stop = offsets[row], offsets[row + 1]
            place, tiers = begin + (flat >> 2), flat & 3
            for tier, reach in enumerate(REACH):
                own = np.flatnonzero(tiers == tier)
                for low in range(0, length - SEED + 1, reach + 1) if len(own) else ():
                    at, b, e = place[own], begin[own], stop[own]
                    least = np.maximum(low, at + length - e)  # offsets of windows inside the text
                    most = np.minimum(min(low + reach, length - SEED), at - b)
                    ok = least <= most
                    at, least, most, r, b = at[ok], least[ok], most[ok], row[own][ok], b[ok]
                    wide = length - min(reach, length - SEED - low)
                    key = T.mix(T.range_hash(prefix, at - low, at - low + wide) + T.U64(low) ^ _OTHER)
                    start, size = at - most, most - least + length
                    total = int(size.sum())
                    take = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
                    held.append((key, ids[r], ties[r], start - b, size, buf[take]))
                    n += total
                    if n >= 2 << 20:
                        yield from _send_contexts(held, bits)
                        held, n = [], 0
        if n:
            yield from _send_contexts(held, bits)
    return run


def _context_hashes(body, size):
    base = np.cumsum(size) - size
    return T.hash_ranges(body, base, base + size)


def _send_contexts(held: list, bits: int) -> Iterator[pa.RecordBatch]:
    key, ids, ties, start, size, body = (np.concatenate(x) for x in zip(*held))
    keep, covered = _collapse(key, _context_hashes(body, size), ids, ties, start)
    yield _spans(ids[covered], ties[covered], start[covered], start[covered] + size[covered], bits)
    base = np.cumsum(size) - size
    keep = keep[np.argsort(key[keep])]
    cuts = np.searchsorted((key[keep] >> T.U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    shards = np.flatnonzero(np.diff(cuts))
    out = []
    for s in shards:
        o = keep[cuts[s]:cuts[s + 1]]
        out.append(T.pack_many((key[o], True), (ids[o].view(T.U64), False), (ties[o].view(T.U64), False), (start[o], False), (size[o], False),
                               (ragged(body, base[o], size[o]), False)))
    yield _packed_rows(shards, out)


def _expand(length: int, bits: int):
    """Suffix array, BWT and interval expansion over a shard's contexts; covers of all but the first."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        passed, parts = _split(table)
        if not parts:
            return passed
        key, start, size = (np.concatenate([p[i] for p in parts]) for i in (0, 3, 4))
        start, size = start.astype(np.int64), size.astype(np.int64)
        ids, ties = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (1, 2))
        body = np.concatenate([p[5].astype(np.uint8) for p in parts])
        del parts
        base = np.cumsum(size) - size
        keep, covered = _collapse(key, _context_hashes(body, size), ids, ties, start)
        out = [_spans(ids[covered], ties[covered], start[covered], start[covered] + size[covered], bits, -1)]
        keep = keep[np.argsort(key[keep])]
        keep = keep[_in_runs(_equal_runs(key[keep]))]
        heads = np.append(np.flatnonzero(~_equal_runs(key[keep])), len(keep))
        total = np.concatenate([[0], np.cumsum(size[keep] + 1)])
        spans, a = [], 0
        for i in range(1, len(heads)):
            if i + 1 == len(heads) or total[heads[i + 1]] - total[a] > BWT_BYTES:
                o = keep[a:heads[i]]
                spans.append(_repeats(body, base[o], size[o], ids[o], ties[o], start[o], length))
                a = heads[i]
        if spans:
            out.append(_spans(*map(np.concatenate, zip(*spans)), bits, -1))
        return pa.concat_tables([passed, pa.Table.from_batches(out)])
    return run


def _repeats(body, base, size, ids, ties, start, length):
    """Covered spans among contexts."""
    n = len(base)
    out = np.cumsum(size + 1)
    text = np.full(int(out[-1]), 0xFF, np.uint8)  # never a byte of UTF-8: ends each context
    head = out - size - 1
    text[ragged(np.arange(len(text)), head, size)] = ragged(body, base, size)
    owner = np.repeat(np.arange(n), size + 1)
    sa = suffix_array(text, length)
    bounded = expand_intervals(text, sa, length)
    inside = sa - head[owner[sa]]
    valid = inside + length <= size[owner[sa]]
    group = np.cumsum(bounded)[valid]
    who, inside = owner[sa[valid]], inside[valid]
    twice = _in_runs(_equal_runs(group))
    group, who = group[twice], who[twice]
    at = start[who] + inside[twice]
    if not len(group):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    order = np.lexsort((at, ties[who], ids[who], group))
    group, who, at = group[order], who[order], at[order]
    first = np.maximum.accumulate(np.where(_equal_runs(group), 0, np.arange(len(group))))
    other = (ids[who] != ids[who][first]) | (ties[who] != ties[who][first]) | (at != at[first])
    return ids[who][other], ties[who][other], at[other], at[other] + length


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first ``depth`` bytes, by prefix doubling from 8 bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(T.U64)
    word = np.zeros(n, T.U64)
    for j in range(8):
        word = (word << T.U64(8)) | padded[j:j + n]
    have = 8
    sa = np.argsort(word)
    rank = np.empty(n, T.U64)
    key = word
    while True:
        ordered = key[sa]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        place = np.cumsum(new)
        rank[sa] = place.astype(T.U64)
        if have >= depth or place[-1] == n:
            return sa
        key = rank << T.U64(32)
        key[:max(n - have, 0)] |= rank[have:]
        # only suffixes that are still tied move, each within its run
        tied = np.zeros(n, bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        t = np.flatnonzero(tied)
        sa[t] = sa[t][np.argsort(key[sa[t]])]
        have *= 2


def expand_intervals(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each suffix whether it differs from the one before within ``length`` bytes.

    Breadth-first backward extension: the interval of a string w holds the suffixes that
    begin with w; the byte before each suffix (the transform) leads to the intervals of cw. An
    interval found at string length l whose upper boundary is still unset has a common prefix of
    l - 1 with what follows; intervals with a set boundary lead to nothing new. Only
    strings shorter than ``length`` are followed.
    """
    n = len(sa)
    bwt = text[sa - 1]
    bounded = np.zeros(n + 1, bool)
    bounded[0] = bounded[n] = True
    by_byte = np.argsort(bwt, kind="stable")  # rows of each byte, in order
    place = np.empty(n, np.int64)
    # Row r leads to row place[r]. The suffixes are sorted by their first ``length`` bytes at least, so
    # single rows may be misplaced among deeper ties, but whole intervals of shorter strings are not.
    place[by_byte] = np.arange(n)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    low, high = (ends - counts)[counts > 0], ends[counts > 0]
    for _ in range(length):
        fresh = ~bounded[high]
        bounded[high] = True
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        # all rows of the fresh intervals, then one interval for each (interval, byte before)
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - low, size)
        key = owner * 256 + bwt[rows]
        order = np.argsort(key, kind="stable")
        key, to = key[order], place[rows][order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ok = (key[head] & 255) != 0xFF  # strings never reach over the end of a context
        last = np.append(head[1:], len(key)) - 1
        low, high = to[head][ok], to[last][ok] + 1
    return bounded[:n]


_CUT = "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(carry: list[str]):
    def run(batches):
        for rows, buf, offsets in T.chunks(batches):
            covers = rows.column(rows.schema.get_field_index("spans")).to_pylist()
            removed, spans, digests, kept = [], [], [], []
            for i, spans_of in enumerate(covers):
                body = memoryview(buf[offsets[i]:offsets[i + 1]])
                digest, runs, gone = hashlib.sha256(), [], 0
                if spans_of:
                    flat = np.sort(np.array(spans_of, np.int64))
                    runs = list(zip(*(x.tolist() for x in unite(flat >> 32, (flat >> 32) + (flat & 0xFFFFFFFF)))))
                at, pieces = 0, []
                for a, b in runs:
                    pieces.append(body[at:a])
                    gone += b - a
                    at = b
                pieces.append(body[at:])
                for p in pieces:
                    digest.update(p)
                removed.append(gone)
                spans.append(len(runs))
                digests.append(digest.hexdigest())
                if carry:
                    # a cut may divide a character: its remaining bytes go too
                    kept.append(b"".join(pieces).decode("utf-8", "ignore"))
            out = [T.arrow_ids(T.column_ids(rows)), rows.column(rows.schema.get_field_index("tie")), pa.array(np.diff(offsets), pa.int64()),
                   pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if carry:
                out += [pa.array(kept, pa.string()), *(rows.column(rows.schema.get_field_index(c)) for c in carry)]
                names += ["kept_text", *carry]
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def cut_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each distinct (doc_id, text) row.

    With ``keep_text`` also ``kept_text`` (characters that a cut divided are dropped) and
    ``row``, a struct of the row's columns other than doc_id and text.
    """
    if length < 2 * SEED - 25 or length > 255:
        raise ValueError(f"length must be from {2 * SEED - 25} to 255 bytes")
    ensure_checkpoint_dir(docs.sparkSession)
    key = ["doc_id", "tie"]
    text = F.coalesce("text", F.lit(""))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carry = ["row"] if keep_text else []
    extra = [(F.struct(*(docs[c] for c in others)) if others else F.lit(None).cast("struct<x:int>")).alias("row")] if keep_text else []
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(T.NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("tie"),
                       text.alias("text"), *extra)
    bits = (files.shards_for(docs, SHARD_BYTES) - 1).bit_length()
    met = (base.select("doc_id", "tie", "text").mapInArrow(_find_anchors(length, bits), _SENT).groupBy("shard").applyInArrow(_meet(length, bits), _SENT)
           .checkpoint())

    def gathered(rows: DataFrame, covers: bool) -> DataFrame:
        return (rows.select("bucket", "payload").repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(_gather(covers), "doc_id long, tie long, spans array<long>").hint("shuffle_hash"))

    wanted = gathered(met.where("shard = -2"), False)
    # the same columns as in the last join, so that one shuffle of the texts serves both
    contexts = base.join(wanted, key).select(*base.columns, "spans").mapInArrow(_fetch(length, bits), _SENT)
    expanded = contexts.groupBy("shard").applyInArrow(_expand(length, bits), _SENT)
    covers = gathered(met.where("shard = -1").union(expanded), True)
    row = f", kept_text string, row {base.schema['row'].dataType.simpleString()}" if keep_text else ""
    return (base.join(covers, key, "left").select(*base.columns, "spans").mapInArrow(_cut(carry), _CUT + row)
            .dropDuplicates(key).drop("tie"))
