"""Filter audit, compression classifier and token alignment: brute force, library results and the edge cases of the docstrings."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import LONG, SF001, SF01, edge, no_docs, pairs  # noqa: F401 (fixtures)
from rulesift.llm import queries as Q
from rulesift.llm import textarrays as T

LABELS = "doc_id long, quality int, toxic int"


# --- op11 ------------------------------------------------------------------------

def _audit(rows, labels):
    """(doc_id, text, part) rows and (doc_id, quality, toxic) labels -> {(part, order, step): counts}, filter by filter."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                  "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((p or "", {k for k, v in failed.items() if v}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        left = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            for part in {d[0] for d in docs}:
                gone = [k for k in left if docs[k][0] == part and f in docs[k][1]]
                fails = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = (sum(docs[k][0] == part for k in left) - len(gone), len(gone), len(fails) - len(gone),
                                                   sum(d[1] == {f} for d in fails), sum(docs[k][2] for k in gone), sum(docs[k][3] for k in gone))
                shapley[part, f] += len(gone)
            left = [k for k in left if f not in docs[k][1]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_applying_every_order(spark, edge):
    from rulesift.llm.filter_audit import audit
    texts = ["word " * 300, "A B C " * 100, "a " * 150 + "#", " ".join(map(str, range(400))), "", None, "Same text | here", "x"]
    rows = [(i, texts[i % 8], ["en", "fr", None, ""][i % 4]) for i in range(60)] + [(None, texts[0], "en"), (None, None, None), (7, "x", "en"), (7, "x", "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(i, t, p, "z", True) for i, t, p in rows], "doc_id long, text string, lang string, digest string, symbol boolean").repartition(3)
    got = _audit_rows(audit(docs, spark.createDataFrame(labels, LABELS), F.col("lang")))
    assert got == _audit(rows, labels) and len(got) == 3 * 600
    rows = [(r.doc_id, r.text, r["shard"]) for r in edge.collect()]
    assert _audit_rows(audit(edge, spark.createDataFrame([], LABELS), F.col("shard"))) == _audit(rows, [])


def test_audit_of_nothing(spark, no_docs):
    from rulesift.llm.filter_audit import audit
    assert audit(no_docs, spark.createDataFrame([(1, 1, 1)], LABELS), F.col("lang")).collect() == []


def test_term_matrix_holds_the_words(spark, edge):
    from rulesift.llm import filter_audit as A
    docs = edge.unionByName(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").limit(40), allowMissingColumns=True)
    matrix = A.TermMatrix.build(docs, F.lit("p"))
    words = sorted({int(T.hash_bytes(w.encode())) for _, t in pairs(docs) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")})
    assert matrix.terms.size == len(words)
    rank = {h: i for i, h in enumerate(words)}
    want = sorted(((i if i is not None else -1), tuple(sorted(collections.Counter(rank[int(T.hash_bytes(w.encode()))] for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")).items())))
                  for i, t in pairs(docs))
    got = []
    for r in matrix.shards(spark).collect():
        indptr = T.unpack(r.indptr).astype(int)
        ids, counts = A.unpack_ids(r.indices, indptr), T.unpack(r.counts)
        for d, a, b in zip(r.docs, indptr[:-1], indptr[1:]):
            got.append(((d.doc_id if d.doc_id is not None else -1), tuple(zip(ids[a:b].tolist(), counts[a:b].tolist()))))
    assert sorted(got) == want


def test_flushes_and_shards_of_small_pieces(monkeypatch):
    """In one process, where the limits can be small: every word once in a flush's rows, and one row for each document."""
    import pyarrow as pa
    from rulesift.llm import filter_audit as A
    monkeypatch.setattr(A, "FLUSH", 64)
    monkeypatch.setattr(A, "_ROWS_OUT", 10)
    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(200)]
    batches = [pa.record_batch({"text": texts[i:i + 7]}) for i in range(0, 200, 7)]
    words = {w for t in texts for w in t.split()}
    got = np.concatenate([b.column(0).to_numpy() for b in A._distinct_hashes(iter(batches))])
    assert {int(h) for h in got.view(np.uint64)} == {T.hash_bytes(w.encode()) for w in words}


# --- op12 ------------------------------------------------------------------------

def _separation(rows):
    """Area under the curve of (score, label) rows."""
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark):
    got = Q.QUERIES["op12_quality_classifier"](spark, SF01).collect()
    labels = {r.doc_id: r.quality for r in Q.read(spark, SF01, "labels").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == Q.read(spark, SF01, "documents").count() and len(held) > 80
    assert _separation([h[:2] for h in held]) > 0.97
    assert sum(p == y for _, y, p in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    # calibrated: the mean score is near the share of good labels
    assert abs(np.mean([h[0] for h in held]) - np.mean([h[1] for h in held])) < 0.06
    again = {r.doc_id: r.score for r in Q.QUERIES["op12_quality_classifier"](spark, SF01).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_difference_is_that_of_the_compressed_sizes():
    import zstandard
    from rulesift.llm.compression_quality import CompressionClassifier, build_dictionary
    good = [b"the quick brown fox jumps over number %d" % i for i in range(3000)]
    bad = [b"BUY $$$ NOW ### click %d" % (i * 7) for i in range(3000)]
    m = CompressionClassifier(build_dictionary(good, 4096), build_dictionary(bad, 4096), 0.0, 1.0)
    sizes = []
    text = b"the quick brown fox " * 90
    for d in (m.good, m.bad):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text[i:i + 512])) for i in range(0, len(text), 512)))
    assert m.difference(text) == (sizes[1] - sizes[0]) / (sizes[1] + sizes[0]) > 0 > m.difference(b"BUY $$$ NOW ### click " * 9)
    assert build_dictionary([b"few"], 4096) == b"few" and build_dictionary([], 4096) == b""


def test_the_curve_is_the_most_likely_one():
    from rulesift.llm.compression_quality import fit_curve
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 20 * x)))).astype(float)
    a, b = fit_curve(x, y)
    assert a == pytest.approx(0.5, abs=0.15) and b == pytest.approx(20, rel=0.12)
    assert fit_curve(np.zeros(0), np.zeros(0)) == (0.0, 0.0)
    a, b = fit_curve(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))  # separable: still finite
    assert np.isfinite([a, b]).all() and b > 0
    assert fit_curve(np.array([1.0, -1.0]), np.array([0.0, 1.0]))[1] == 0  # a reversed one is not used


def test_quality_edges(spark, edge, no_docs):
    from rulesift.llm import compression_quality as C
    learn = F.lit(True)
    none = spark.createDataFrame([], LABELS)
    assert C.train(edge, none, learn) == 0.5
    got = C.score(edge, 0.5).collect()
    assert len(got) == edge.count() and all(r.score == 0.5 and r.difference is None and r.predicted == 1 for r in got)
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, None, 0), (None, 0, 0)], LABELS)
    assert C.train(edge, one, learn) == 1.0
    both = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (5, 0, 0), (6, 0, 0), (1, 1, 0)], LABELS)
    model = C.train(edge, both, learn)
    got = C.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.difference for r in got if r.doc_id in (1, 2)} == {0.0}
    assert C.score(no_docs, model).collect() == [] and C.train(no_docs, both, learn) == 0.5


def test_one_id_on_many_rows_is_one_text(spark):
    from rulesift.llm import compression_quality as C
    docs = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id")).cast("long").alias("doc_id"),
                                   F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 0, 0), *[(i, i % 2, 0) for i in range(200, 300)]], LABELS)
    seen = C.train(docs, labels, F.lit(True))
    assert isinstance(seen, C.CompressionClassifier)
    assert C.train(docs.orderBy(F.desc("text")).repartition(5), labels, F.lit(True)) == seen


# --- op13 ------------------------------------------------------------------------

def _files():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _aligned(rows):
    """Rows of op13 from whole texts, token by token, and the linked pairs' counts."""
    import sentencepiece
    from tokenizers import Tokenizer
    from rulesift.llm.token_alignment import byte_level
    of = byte_level()
    first, second = _files()
    a_tok = Tokenizer.from_file(first)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=second)
    docs, counts = [], collections.Counter()
    for i, t in rows:
        found = None
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            raw_a = [bytes(of[c] for c in a_tok.id_to_token(x)) for x in a]
            raw_b = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                ends_a, ends_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
                groups, links, at_a, at_b = [], [], 0, 0
                for e in sorted(set(ends_a) & set(ends_b)):
                    to_a, to_b = ends_a.index(e, at_a) + 1, ends_b.index(e, at_b) + 1
                    groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
                    links += [(a[x], b[y]) for x in range(at_a, to_a) for y in range(at_b, to_b)
                              if max(ends_a[x] - len(raw_a[x]), ends_b[y] - len(raw_b[y])) < min(ends_a[x], ends_b[y])]
                    at_a, at_b = to_a, to_b
                counts.update(set(links))
                found = a, b, ends_a, ends_b, groups, links
        docs.append((i, found))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
           (i, len(f[0]), len(f[1]), len(f[4]), len(f[5]), sum(counts[p] == best[p[0]] for p in f[5]), sum(counts[p] for p in f[5]),
            hashlib.sha256(";".join(f[4]).encode()).hexdigest()) for i, f in docs]
    return out, counts, docs


ODD = ["a é 日本 \U0001F600 <s> x  y\n z", "x", " lead", "  two", "trail ", "tr  ", "\n", "a▁b", " ", "<|endoftext|> hi <unk>", "\x00 a", "a  b 　 c",
       "\U0010ffff q", "it's   we'll", "é" * 50, "ab " * 30, "日" * 30 + " กิ x", "a\t b", "a \tb", "x <0x0A> y", "a  b", "  x", "x  ", "y" * 3000, "\U0001F468‍\U0001F469‍\U0001F467 ź ﬁ"]


def test_alignment_equals_token_by_token(spark, edge):
    from rulesift.llm.token_alignment import Aligner, TokenizerPair, align_corpus
    rows = list(enumerate(ODD, 100))
    docs = edge.unionByName(spark.createDataFrame([*rows, (None, ODD[0]), (100, ODD[0])], "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    want, counts, found = _aligned(pairs(docs))
    got = [tuple(r) for r in align_corpus(docs, TokenizerPair(*_files())).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty and U+2581
    aligner = Aligner(docs, TokenizerPair(*_files()))
    assert {(r.a, r.b): r.n for r in aligner.link_counts().collect()} == counts
    tokens = collections.Counter((r.doc_id, tuple(r.a), tuple(r.a_ends), tuple(r.b), tuple(r.b_ends)) for r in aligner.tokens().collect())
    assert tokens == collections.Counter((i, *map(tuple, (f[0], f[2], f[1], f[3]) if f else ((),) * 4)) for i, f in found)


def test_alignment_of_documents(spark):
    from rulesift.llm import token_alignment as A
    docs = Q.read(spark, SF001, "documents")
    want, _, _ = _aligned(pairs(docs))
    assert collections.Counter(tuple(r) for r in A.align_corpus(docs, A.TokenizerPair(*_files())).collect()) == collections.Counter(want)


def test_small_steps_and_runs_change_nothing(monkeypatch):
    import pyarrow as pa
    from rulesift.llm import token_alignment as A
    pair = A.TokenizerPair(*_files())
    batch = pa.record_batch({"doc_id": list(range(len(ODD))), "text": ODD})
    for limits in ((4 << 20, 1 << 18, 1 << 12, 32), (100, 10, 5, 1), (1, 1, 1, 3)):
        for name, value in zip(("CHUNK_BYTES", "STEP_BYTES", "RUN_BYTES", "BATCH"), limits):
            monkeypatch.setattr(A, name, value)
        found = []
        for _, buf, offsets in T.chunks(iter([batch]), size=A.CHUNK_BYTES):
            c = A.Chunk.align(pair, buf, offsets)
            flat, first, size = c.segments.written()
            out = A.ragged(flat, first[c.place], size[c.place]).tobytes()
            ends = np.concatenate([[0], np.cumsum(c.sums(size))])
            found += [out[a:max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:])]
        want = [";".join(f[4]) if f else "" for _, f in _aligned(list(enumerate(ODD)))[2]]
        assert found == want and pair.separable
        pair.separable = False  # whole texts as segments give the same
        for _, buf, offsets in T.chunks(iter([batch])):
            c = A.Chunk.align(pair, buf, offsets)
            assert len(c.segments.count_a) <= len(ODD) and c.sums(c.segments.groups()).tolist() == [len(w.split(";")) if w else 0 for w in want]
        pair.separable = True


def test_spans_alone_decide_clean_borders():
    """The refinement only moves ends between clean borders, and wrong spans show."""
    from rulesift.llm.token_alignment import _table, refine
    table = _table([b"ab", b"c", b"\xe6", b"\x97\xa5"])
    buf = np.frombuffer("abc日ab".encode(), np.uint8)
    offsets, ids, count = np.array([0, 8]), np.array([0, 1, 2, 3, 0]), np.array([5])
    begin, end = np.array([0, 2, 3, 3, 6]), np.array([2, 3, 6, 6, 8])
    ends, ok = refine(buf, offsets, ids, count, begin, end, table)
    assert ends.tolist() == [2, 3, 4, 6, 8] and ok.all()
    assert not refine(buf, offsets, np.array([0, 1, 2, 3, 1]), count, begin, end, table)[1].all()
    assert refine(buf, offsets, np.array([0, 1, 3, 2, 0]), count, begin, end, table)[1].tolist() == [True, True, False, False, True]


def test_alignment_of_nothing(spark, no_docs):
    from rulesift.llm.token_alignment import TokenizerPair, align_corpus
    pair = TokenizerPair(*_files())
    assert align_corpus(no_docs, pair).collect() == []
    got = align_corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), pair).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_long_text_without_spaces_is_one_segment(spark):
    from rulesift.llm.token_alignment import TokenizerPair, align_corpus
    docs = spark.createDataFrame([(1, "Zq9" * 20_000), (2, LONG)], "doc_id long, text string")
    want, _, _ = _aligned(pairs(docs))
    assert sorted(tuple(r) for r in align_corpus(docs, TokenizerPair(*_files())).collect()) == sorted(want)
