"""Vectors, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

import brute
from llm_cases import SF001, edge, no_docs, pairs  # noqa: F401 (fixtures)
from rulesift.llm import queries as Q


# --- op2 -------------------------------------------------------------------------

def _brute_top(rows, k):
    import math
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted(v):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("block,strip", [(8192, 128), (37, 5)])
def test_top_k(spark, monkeypatch, block, strip):
    from rulesift.llm import topk_search as S
    monkeypatch.setattr(S, "BLOCK_VECTORS", block)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 11)
    monkeypatch.setattr(S, "STRIP", strip)
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [rng.gauss(c, 0.2) for c in centers[i % 6]]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, []), (2040, [float("nan")] * 12), (2060, [float("inf")] + [0.0] * 11), (2080, [None] * 12), (None, [1.0] * 12),
             (2100, [0.0] * 12), (2120, [1.0, 2.0]), (2121, [3.0, -1.0])]
    table = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, score string")
    exact = [(r.vec_id, r.embedding) for r in table.collect()]  # single precision, as stored
    for k in (20, 3):
        got = [tuple(r) for r in S.top_k(table, F.col("vec_id") % 20 == 0, k).collect()]
        assert sorted(got) == sorted(_brute_top(exact, k))
    assert S.top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    again = table.union(table)  # repeated rows
    assert sorted(tuple(r) for r in S.top_k(again, F.col("vec_id") % 20 == 0, 3).collect()) == sorted(_brute_top(exact, 3))


def test_search_stops_on_proof():
    """Clustered vectors: few can be among the best after the high impacts, and the result is still exact."""
    import numpy as np
    import pyarrow as pa
    from rulesift.llm import topk_search as S
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (40, 64))
    v = np.floor(64 * (base[np.arange(4000) % 40] + rng.normal(0, 0.05, (4000, 64)))).astype(int)
    table = pa.table({"vec_id": pa.array(np.arange(4000)), "v": pa.array(v.tolist(), pa.list_(pa.int32()))})
    row = S._build((pa.scalar(0), pa.scalar(64)), table).to_pylist()[0]
    assert [len(x) > 12 for x in row["postings"]]
    own = v[:50]
    row |= {"query_ids": np.arange(50, dtype="<i8").tobytes(), "queries": own.astype("<i4").tobytes()}
    q, c, s = S.search_block(row, 20)
    scores = own @ v.T
    for i in range(50):
        order = sorted((-scores[i, j], j) for j in range(4000) if j != i)[:20]
        assert [(-a, b) for a, b in order] == list(zip(s[q == i].tolist(), c[q == i].tolist()))


# --- op9 -------------------------------------------------------------------------

def _pages():
    rng = random.Random(6)
    big = "".join(rng.choice("<p>ab é\r\n0") for _ in range(200_000))
    return [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "line\r\nWARC-Type: x", "0\r\n\r\n"),
            (10, "http://b", big), (11, "http://c", big[:40_000]), (12, "http://c", big), (None, "n", "no id"), (None, "n", "same"),
            (13, "r", "twice"), (13, "r", "twice"), (14, "t", "WARC/1.1\r\n\r\n")]


def _want(rows, least=0):
    out = {}
    for i, _, h in set(rows):
        b = (h or "").encode()
        equal = [j for j, _, x in rows if (x or "").encode() == b]
        top = max((j for j in equal if j is not None), default=None)
        revisit = len(b) >= least and top is not None and i != top
        out[i, h or ""] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)
    return sorted((k[0] or -1, *v[:3], v[3] or -1) for k, v in out.items())


@pytest.mark.parametrize("least,segment", [(0, 32 << 10), (0, 100), (5, 1000)])
def test_archives_round_trip(spark, least, segment):
    from rulesift.llm.warc import read_archives, write_archives
    pages = spark.createDataFrame([(*r, "x") for r in _pages()], "page_id long, url string, html string, payload string").repartition(3)
    files = write_archives(pages, min_bytes=least, segment_bytes=segment)
    got = read_archives(spark, files).collect()
    assert not [r for r in got if r.error]
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == _want(_pages(), least)


def test_archive_format(spark):
    """Members, headers and segments as the format has them, read by other means."""
    from rulesift.llm.warc import write_archives
    pages = spark.createDataFrame([(1, "http://a", "x" * 5000), (2, "http://b", "short")], "page_id long, url string, html string").coalesce(1)
    path = write_archives(pages, segment_bytes=2000).first().path
    raw = gzip.GzipFile(fileobj=io.BytesIO(open(path.removeprefix("file:"), "rb").read())).read()
    heads, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        heads.append(dict(x.split(": ", 1) for x in lines[1:]))
        at = end + 4 + int(heads[-1]["Content-Length"])
        assert raw[at:at + 4] == b"\r\n\r\n"
        at += 4
    big = [h for h in heads if h.get("X-Page-ID") == "1"][0]
    more = [h for h in heads if h.get("WARC-Segment-Origin-ID") == big["WARC-Record-ID"]]
    assert [h["WARC-Segment-Number"] for h in [big, *more]] == ["1", "2", "3"]
    assert int(more[-1]["WARC-Segment-Total-Length"]) == sum(int(h["Content-Length"]) for h in [big, *more])
    assert {h["WARC-Type"] for h in more} == {"continuation"}


def test_broken_archives_are_told(spark, tmp_path):
    """A missing segment and a wrong length are errors of their record only."""
    from rulesift.llm import warc
    payload = b"y" * 3000
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    whole = list(warc.records(1, "u", payload, digest, None, False, 1000))
    short = list(warc.records(2, "u", payload + b"z", digest, None, False, 1000))
    fine = list(warc.records(3, "u", payload, digest, None, False, 1000))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join([*whole[:1], *whole[2:], *short, *reversed(fine)]))
    got = {r.page_id: r for r in warc.read_archives(spark, spark.createDataFrame([(f"file:{path}",)], "path string")).collect()}
    assert got[1].error == "segments are missing" and got[1].payload_digest is None
    assert "digest" in got[2].error
    assert got[3].error is None and got[3].payload_bytes == 3000
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_no_pages(spark):
    from rulesift.llm.warc import read_archives, write_archives
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(spark, write_archives(pages)).collect() == []


# --- pipeline ----------------------------------------------------------------------

def test_pipeline_against_plain_python(spark):
    import public_tokenizers
    import sentencepiece
    import corpus_pipeline as P
    docs = Q.read(spark, SF001, "documents")
    stages = dict(P.STAGES)
    kept = stages["toxicity"](spark, docs, SF001)
    assert kept.columns == docs.columns
    calm = {r.doc_id for r in Q.QUERIES["op8_toxicity"](spark, SF001).where("predicted = 0").collect()}
    rows = [(i, t) for i, t in pairs(docs) if i in calm]
    rows = [(i, t) for i, t in rows if brute.components(rows)[i][1] == i]
    seen, cut = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j:j + 100]
            if w in seen:
                gone[j:j + 100] = b"\1" * 100
            seen.add(w)
        cut.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    items = [(r.item_id, r.text) for r in Q.read(spark, SF001, "benchmark").collect()]
    hit = brute.hits(cut, items)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: sp.encode(t, add_bos=True, add_eos=True) for i, t in cut if not hit[i][1]}
    got = {r.doc_id: r.ids for r in P.run(spark, SF001).collect()}
    assert got == want and len(want) < len(rows) < docs.count()


def test_stage_edges(spark, edge, no_docs):
    import corpus_pipeline as P
    docs, empty = edge, no_docs
    for name, stage in P.STAGES:
        docs, empty = stage(spark, docs, SF001).checkpoint(), stage(spark, empty, SF001)
        assert empty.count() == 0
        if name != P.STAGES[-1][0]:
            assert docs.columns == edge.columns
    ids = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i or 0))
    # 4 and 7 are near copies of 3 and 6, a row without id is a copy of 5, and the repeated row 3 is one
    assert ids == [1, 2, 3, 5, 6, 8, 9, 10, None]


def test_groups_are_judged_by_row(spark):
    """Near copies without ids, and one whose id another text has too: one row of the group stays."""
    import corpus_pipeline as P
    words = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join(words[:i] + ["other"] + words[i + 1:])
    rows = [(None, near(0)), (None, near(59)), (7, " ".join(words)), (8, near(1)), (8, "a text of its own with enough words to be one"), (None, ""), (9, ""), (8, near(1))]
    docs = spark.createDataFrame([(i, t, "row", 1) for i, t in rows], "doc_id long, text string, row_key string, kept int").repartition(3)
    got = P.one_of_each_group(spark, docs, SF001)
    assert got.columns == docs.columns
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in got.collect()) == sorted([(7, " ".join(words)), (8, rows[4][1]), (-1, ""), (9, "")])
