"""Plain-Python statements of what the operators compute."""

import collections
import hashlib
import math
import re


def words(text):
    return (text or "").encode().lower().split()


def alnum(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def components(rows, width=5, percent=75):
    """{doc_id: (shingles, smallest id of the component)}"""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[j:j + width]) for j in range(len(w) - width + 1)}
    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    both = collections.Counter((a, b) for ids in lists.values() for k, a in enumerate(ids) for b in ids[:k])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def cut(rows, length=100):
    """{doc_id: (bytes, removed, spans, digest of the rest)}"""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            if w in seen:
                gone[j:j + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def kneser_ney(train, texts):
    """log10 probabilities of texts under the interpolated modified Kneser-Ney bigram model of ``train``."""
    end, begin = ("end",), ("begin",)
    bigrams, unigrams = collections.Counter(), collections.Counter()
    for t in train:
        seq = [*words(t), end]
        unigrams.update(seq)
        bigrams.update(zip([begin, *seq], seq))
    context, follows, before = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (v, w), n in bigrams.items():
        context[v] += n
        follows[v][min(n, 3)] += 1
        before[w] += 1

    def discounts(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
        return [0, *(x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d))]

    high, low = discounts(list(bigrams.values())), discounts(list(before.values()))
    total, size = sum(before.values()), len(unigrams)
    rest = sum(low[min(c, 3)] for c in before.values())

    def p(v, w):
        k = before[w]
        base = (max(k - low[min(k, 3)], 0) + rest / (size + 1)) / total
        if v not in context:
            return base
        gamma = sum(high[j] * follows[v][j] for j in (1, 2, 3)) / context[v]
        c = bigrams[v, w]
        return max(c - high[min(c, 3)], 0) / context[v] + gamma * base

    out = []
    for t in texts:
        seq = [*words(t), end]
        out.append(sum(math.log10(p(v, w)) for v, w in zip([begin, *seq], seq)))
    return out, unigrams, p


def hits(docs, items, width=10):
    """{doc_id: (words, hit, sorted items)}"""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for j in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[j:j + width])].add(i)
    out = {}
    for d, t in docs:
        w = alnum(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                own = windows.get(tuple(w[j:j + size]))
                if own:
                    found |= own
                    hit.update(range(j, j + size))
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out
