"""Operators over documents: SQL twins, brute force and the edge cases of the docstrings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import brute
from llm_cases import SF001, SF01, edge, no_docs, pairs  # noqa: F401 (fixtures)
from rulesift.llm import queries as Q
from rulesift.plans.oracle_check import compare


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, name):
    r = compare(spark, name, Q.QUERIES[name], Q.ORACLE[name], SF01)
    assert r["ok"], r["why"]


# --- op1 -----------------------------------------------------------------------

def test_kneser_ney_is_the_textbook_model(spark):
    docs = Q.read(spark, SF001, "documents")
    rows = pairs(docs)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want, counts, p = brute.kneser_ney(train, [t for _, t in rows])
    got = {r.doc_id: r for r in Q.QUERIES["op1_lm_scoring"](spark, SF001).collect()}
    total, size = sum(counts.values()), len(counts)
    for (i, t), score in zip(rows, want):
        seq = [*brute.words(t), ("end",)]
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(1 for w in seq if counts[w]), total)
        assert r.score == pytest.approx(score, rel=1e-9)
        import math
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in seq), rel=1e-9)
    # a distribution: over all known tokens and the class of unknown ones, after any context
    for v in [("begin",), next(iter(counts)), b"never seen"]:
        assert sum(p(v, w) for w in counts) + p(v, b"never seen either") == pytest.approx(1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_kneser_ney_edges(spark, edge, no_docs):
    from rulesift.llm.kneser_ney import KneserNey
    model = KneserNey.train(edge, F.lit(True))
    got = model.score(edge).collect()
    assert len(got) == edge.count() and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 8)} == {1}
    nothing = KneserNey.train(no_docs, F.lit(True))
    assert nothing.score(no_docs).collect() == []
    assert all(r.score == 0 and r.n_known == 0 for r in nothing.score(edge).collect())


# --- op3, op4 --------------------------------------------------------------------

def _texts():
    rng = random.Random(5)
    alphabet = "abcdeeeiothn  \n.,-=_▁éü日1230\"'<>()/\t🙂"
    parts = ["the", "ing", " ", "  ", "tion", "re", "\n", "==", "http", "://", "aa", "AA", "Class", "();", "▁", "日本"]
    return ([None, "", " ", " " * 70 + "x" + " " * 37, "a" * 500, "é" * 90, "\x00", "<s> <0x41>", "▁▁ ▁", "�"]
            + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(400)]
            + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)])


def test_encoding_is_the_library_s(spark):
    import public_tokenizers
    import sentencepiece
    from rulesift.llm.bpe_table import PrefixTable, encode
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t, "c") for i, t in enumerate(_texts())] + [(10_000 + i, t, "c") for i, t in pairs(Q.read(spark, SF001, "documents"))]
    got = {r.doc_id: r for r in encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"),
                                       PrefixTable(Q.vocabulary("piece_bpe_32k.model")), keep_ids=True).collect()}
    import numpy as np
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids, repr(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), repr(t)


def test_token_counts_are_the_library_s(spark, edge, no_docs):
    from tokenizers import Tokenizer, models
    from rulesift.llm.unigram_count import UnigramCounter, count_tokens
    pieces = Q.vocabulary("piece_bpe_32k.model")
    library = Tokenizer(models.Unigram(list(zip(pieces.strings, pieces.scores.tolist())), unk_id=0, byte_fallback=True))
    rows = list(enumerate(_texts())) + [(10_000 + i, t) for i, t in pairs(Q.read(spark, SF001, "documents"))]
    counter = UnigramCounter(pieces)
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), counter).collect()}
    for i, t in rows:
        assert got[i] == (len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), repr(t)
    assert count_tokens(edge, counter).count() == edge.count()
    assert count_tokens(no_docs, counter).collect() == []


def test_encoding_edges(spark, edge, no_docs):
    from rulesift.llm.bpe_table import PrefixTable, encode
    table = PrefixTable(Q.vocabulary("piece_bpe_32k.model"))
    got = encode(edge, table).collect()
    assert len(got) == edge.count()
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {2}
    assert encode(no_docs, table).collect() == []


# --- op5 -------------------------------------------------------------------------

def _near_copies():
    """Groups of near copies of several sizes, a chain of neighbours, and texts that share a passage only."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for size in (3, 6, 30, 80, 300):
        base = [word() for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(size)] = word()
            rows.append(" ".join(w))
    chain = [word() for _ in range(120)]
    for k in range(20):
        rows.append(" ".join(chain[k * 3:k * 3 + 60]))
    passage = [word() for _ in range(40)]
    for _ in range(25):
        rows.append(" ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_components(spark):
    from rulesift.llm.ngram_jaccard import jaccard_components
    rows = _near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_jaccard_light_and_heavy_agree(spark, monkeypatch):
    """Any boundary gives the same links: all sets by subsets, all by lists."""
    from rulesift.llm import ngram_jaccard
    rows = [r for r in _near_copies() if len(r[1]) < 600]
    want = brute.components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 10_000):
        monkeypatch.setattr(ngram_jaccard, "boundary", lambda store: limit)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()}
        assert got == want


def test_jaccard_edges(spark, edge, no_docs):
    from rulesift.llm.ngram_jaccard import jaccard_components
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(edge).collect())
    assert len(got) == edge.count()
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[8] == (0, 8)  # without words linked with nothing
    assert by[3] == (1, 3) and by[4] == (1, 3)
    assert by[5] == (8, None)  # reaches the row without id
    assert by[6][1] == 6 and by[7][1] == 6
    assert jaccard_components(no_docs).collect() == []


# --- op6 -------------------------------------------------------------------------

def test_phrases_and_proximity(spark, edge, no_docs):
    from rulesift.llm.decontaminate import PositionalIndex
    docs = [(0, "x A b-c d e f g h i j k y"), (1, "a b c d e f g h i"), (2, "only Four words HERE now"), (3, None),
            (4, "j i h g f e d c b a"), (5, "a b c d e f g h i j a b c d e f g h i j")]
    items = [(7, "a b c d e f g h i j"), (8, "four words here"), (9, ""), (None, "b c d e f g h i j k"), (7, "a b c d e f g h i j")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in PositionalIndex.build(d).search(b).collect()}
    assert got[0].n_hit == 11 and got[0].items == [7, None] and got[0].n_words == 13
    assert got[1].n_hit == 0 and got[2].items == [8] and got[2].n_hit == 3 and got[3].n_words == 0
    assert got[4].n_hit == 0 and {x.item_id for x in got[4].near} == {7}  # all words, other order
    assert [(x.start, x.end) for x in got[5].phrases] == [(0, 20)]
    out = Q.contamination(spark, edge, b)
    assert out.count() == edge.count()
    assert Q.contamination(spark, no_docs, b).collect() == []
    assert {r.n_hit for r in Q.contamination(spark, d, b.limit(0)).collect()} == {0}


def test_blocks_do_not_matter(spark, monkeypatch):
    from rulesift.llm import decontaminate as D
    docs, items = Q.read(spark, SF001, "documents"), Q.read(spark, SF001, "benchmark")
    want = brute.hits(pairs(docs), [(r.item_id, r.text) for r in items.collect()])
    out = D.PositionalIndex.build(docs).search(items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(map(str, r.items))) for r in out} == want


# --- op7 -------------------------------------------------------------------------

def _repeats():
    rng = random.Random(3)
    bits = [rng.choice(["abc", "de ", "é", "日", "xyz", " ", "\n", "0"]) for _ in range(60)]
    passages = ["".join(rng.choice(bits) for _ in range(n)) for n in (20, 60, 100, 101, 160, 400)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [rng.choice(passages), "".join(rng.choice("qwertzuiop") for _ in range(rng.randint(0, 80)))]
        rows.append((i, "".join(parts)))
    return [*rows, (100, "a" * 1000), (101, "ab" * 300), (102, "a" * 99), (103, None), (104, ""), (105, rows[3][1])]


@pytest.mark.parametrize("tiers", [(64, 4096, 65536), (0, 0, 0), (0, 0, 1 << 30), (0, 1 << 30, 1 << 30)])
def test_suffix_dedup(spark, monkeypatch, tiers):
    """Whatever keys divide the groups, the covers are those of the definition."""
    import numpy as np
    from rulesift.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "TIERS", np.array(tiers))
    monkeypatch.setattr(suffix_dedup, "BWT_BYTES", 5000)
    rows = _repeats()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.cut([(i, t or "") for i, t in rows])


def by_text(docs, doc_id):
    return docs.where(F.col("doc_id") == doc_id).first().text


def test_suffix_dedup_edges(spark, edge, no_docs):
    from rulesift.llm.suffix_dedup import cut_repeats
    got = cut_repeats(edge, keep_text=True).collect()
    assert len(got) == edge.count() - 1  # the repeated row is one document
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[7].n_spans == 1
    assert (by[6].n_bytes, by[6].n_removed) == brute.cut([(6, by_text(edge, 6))])[6][:2]
    assert by[3].kept_text == "Short text" and by[3].row.spans == "row"
    assert by[6].n_removed == by[6].n_bytes - 24  # period 24: every window from the second period on starts earlier too
    assert cut_repeats(no_docs).collect() == []


def test_interval_expansion():
    import numpy as np
    from rulesift.llm.suffix_dedup import expand_intervals, suffix_array
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(97, 99, n), 0xFF) for n in (200, 1, 50, 400)]).astype(np.uint8)
    for length in (2, 5, 9):
        sa = suffix_array(text, length)
        bounded = expand_intervals(text, sa, length)
        rows = [text[i:i + length].tobytes() for i in sa]
        for k in range(1, len(sa)):
            if b"\xff" not in rows[k] and b"\xff" not in rows[k - 1] and len(rows[k]) == len(rows[k - 1]) == length:
                assert bounded[k] == (rows[k] != rows[k - 1])


# --- op8 -------------------------------------------------------------------------

def test_toxicity_learns_pairs():
    """Two words that are harmless alone: a linear model can't tell, the pairwise terms do."""
    import numpy as np
    from rulesift.llm.toxicity import FactorizationMachine
    rng = np.random.default_rng(2)
    a, b = rng.random(3000) < 0.4, rng.random(3000) < 0.4
    label = (a & b).astype(int)
    text = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.full(a.sum(), 5), np.full(b.sum(), 9)]).astype(np.uint64)
    order = np.lexsort((term, text))
    m = FactorizationMachine.fit(text[order], term[order], label)
    place = np.searchsorted(m.terms, term[order])
    assert ((m.raw(place, text[order], 3000) >= 0) == label).mean() > 0.99


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in Q.read(spark, sf, "labels").collect()}
    held = [(got[i], y) for i, y in labels.items() if got[i].held_out]
    right = sum(r.predicted == y for r, y in held)
    wrong = sum(r.predicted and not y for r, y in held)
    assert right / len(held) > 0.97 and wrong / len(held) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    from rulesift.llm import toxicity
    docs, labels = Q.read(spark, SF001, "documents"), Q.read(spark, SF001, "labels")
    a, b = (toxicity.train(d, labels, F.lit(True)) for d in (docs, docs.repartition(7)))
    assert a.bias == b.bias and (a.terms == b.terms).all() and (a.w == b.w).all() and (a.v == b.v).all()


def test_toxicity_edges(spark, edge, no_docs):
    from rulesift.llm import toxicity
    labels = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels, F.lit(True))
    out = toxicity.score(edge, model)
    assert out.count() == edge.count()
    assert toxicity.train(edge, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score(edge, None).collect()} == {0.0}
    carried = toxicity.score(edge, model, carry=True)
    assert carried.columns == [*edge.columns, "score_", "predicted"]
    assert toxicity.score(no_docs, model).collect() == []


# --- op10 ------------------------------------------------------------------------

def test_fuzzy_passages(spark):
    from rulesift.llm.passage_chains import fuzzy_passages
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    noise = lambda n: [word() for _ in range(n)]
    p = noise(80)
    fuzzy = list(p)
    for k in (20, 41, 62):
        fuzzy[k] = word()
    del fuzzy[30]
    docs = [noise(40) + p + noise(40), noise(10) + fuzzy + noise(60), noise(90) + p[:51], noise(100), p[:30] + noise(50), noise(55)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(9, " ".join(docs[5])), (10, "x y z"), (11, "x y z")]
    got = {(r.doc_id, r.earlier_id): r for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == {(1, 0), (2, 0), (9, 5)}
    r = got[1, 0]
    assert (r.start, r.end, r.earlier_start, r.earlier_end, r.equal_words) == (10, 89, 40, 120, 76)
    assert (got[2, 0].start, got[2, 0].end) == (90, 141) and got[9, 5].whole_copy


def test_every_long_run_is_inside_a_passage(spark):
    docs = Q.read(spark, SF01, "documents")
    seen, need = {}, []
    for i, t in sorted(pairs(docs)):
        w = brute.words(t)
        own = {}
        for j in range(len(w) - 50):
            h = tuple(w[j:j + 51])
            if h in seen:
                need.append((i, j))
            own.setdefault(h, i)
        for h in own:
            seen.setdefault(h, i)
    got = {}
    for r in Q.QUERIES["op10_substring_dedup"](spark, SF01).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert need and all(any(s <= j and j + 51 <= e for s, e in got.get(i, [])) for i, j in need)


def test_chains_take_the_best_order():
    from rulesift.llm.passage_chains import chains, diagonal_runs
    import numpy as np
    assert diagonal_runs(np.array([0, 5, 12, 40]), np.array([3, 8, 15, 90]), 8) == [(0, 3, 20), (40, 90, 8)]
    runs = [(0, 0, 20), (25, 200, 9), (30, 30, 20), (60, 10, 8), (200, 300, 30)]
    assert chains(runs) == [[(0, 0, 20), (30, 30, 20)], [(200, 300, 30)], [(25, 200, 9)], [(60, 10, 8)]]


def test_fuzzy_edges(spark, edge, no_docs):
    from rulesift.llm.passage_chains import fuzzy_passages
    got = fuzzy_passages(edge, min_words=10).collect()
    assert (5, None) in {(r.doc_id, r.earlier_id) for r in got}
    assert fuzzy_passages(no_docs).collect() == []


def test_changed_passages_are_found(spark):
    """Share of passages with random changed words that are found, against dense alignment of the pair (word by word, all of them hold)."""
    from rulesift.llm.passage_chains import fuzzy_passages
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    noise = lambda n: [word() for _ in range(n)]
    rows, kind = [], {}
    for changed in (5, 10, 15, 20):
        for length in (60, 80, 120):
            for _ in range(40):
                p = noise(length)
                other = list(p)
                for k in rng.sample(range(length), length * changed // 100):
                    other[k] = word()
                i = 2 * len(kind)
                kind[i + 1] = (changed, length)
                rows += [(i, " ".join(noise(30) + p + noise(30))), (i + 1, " ".join(noise(20) + other + noise(50)))]
    got = {(r.doc_id, r.earlier_id) for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(e == d - 1 and d % 2 for d, e in got)
    for changed, length, least in [(5, 60, 1), (10, 60, .97), (15, 60, .9), (20, 60, .8), (10, 80, 1), (20, 80, .85), (10, 120, 1), (20, 120, .9)]:
        own = [d for d, k in kind.items() if k == (changed, length)]
        share = sum((d, d - 1) in got for d in own) / len(own)
        print(changed, length, share)
        assert share >= least, (changed, length, share)


@pytest.mark.parametrize("block", [2, 1024])
def test_changed_passages_of_later_texts(spark, monkeypatch, block):
    """Smaller ids hold parts of a changed passage: the later texts that hold all of it are still linked."""
    from rulesift.llm import passage_chains as P
    monkeypatch.setattr(P, "BLOCK_HOLDERS", block)
    rng = random.Random(16)
    noise = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 40, 4):
        p = noise(70)
        other = list(p)
        for j in range(5, 70, 8):
            other[j] = noise(1)[0]
        rows += [(k + i, " ".join(d)) for i, d in enumerate([noise(30) + p[:35] + noise(20), noise(10) + p[35:] + noise(40), noise(20) + p + noise(30),
                                                             noise(40) + other + noise(5)])]
        want.add((k + 3, k + 2))
    got = P.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.earlier_id) for r in got} == want and len(got) == len(want)
    assert all(r.component_id == r.earlier_id and (r.start, r.end, r.earlier_start, r.earlier_end, r.equal_words) == (40, 109, 20, 89, 61) for r in got)


def test_exact_passages_of_later_texts(spark):
    """Smaller ids hold parts of a passage, or the beginning of it at another place: later texts still share all of it."""
    from rulesift.llm.passage_chains import fuzzy_passages
    rng = random.Random(6)
    noise = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p, q = noise(60), noise(60)
    docs = [noise(30) + p[:35] + noise(20), noise(10) + p[25:] + noise(40), noise(20) + p + noise(30), noise(40) + p + noise(5), p + noise(9),
            noise(20) + q[:12] + noise(30) + q + noise(10), noise(50) + q]
    rows = [(i + 1, " ".join(d)) for i, d in enumerate(docs)]
    got = {(r.doc_id, r.earlier_id, r.start, r.end, r.earlier_start, r.earlier_end)
           for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(4, 3, 40, 100, 20, 80), (5, 3, 0, 60, 20, 80), (7, 6, 50, 110, 62, 122)}


def test_holders_of_a_phrase_are_not_paired(spark):
    """A phrase that many texts hold leads to no rows; the two of them that share a changed passage around it are linked."""
    from rulesift.llm import passage_chains as P
    rng = random.Random(21)
    noise = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    phrase, p = noise(5), noise(60)
    other = [noise(1)[0] if k % 8 == 3 else w for k, w in enumerate(p)]
    docs = [noise(40) + phrase + noise(40) for _ in range(120)] + [p[:30] + phrase + p[30:], noise(9) + other[:30] + phrase + other[30:]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = P.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.earlier_id) for r in got} == {(121, 120)}
    assert not hasattr(P, "_pairs")
    assert P.outermost([(0, 60, 0, 60, 60), (5, 60, 5, 60, 55), (5, 70, 5, 70, 50)]) == [(0, 60, 0, 60, 60), (5, 70, 5, 70, 50)]


def test_changed_passages_of_connected_texts(spark):
    """Later texts that another passage connects already: a changed passage of which earlier texts hold parts has its row too."""
    from rulesift.llm.passage_chains import fuzzy_passages
    rng = random.Random(25)
    noise = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p, shared = noise(70), noise(60)
    other = [noise(1)[0] if k % 8 == 5 else w for k, w in enumerate(p)]
    docs = [noise(20) + shared + noise(20), noise(30) + p[:37] + noise(20), noise(10) + p[33:] + noise(40),
            noise(90) + p + noise(150) + shared, shared + noise(160) + other + noise(80)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {(r.doc_id, r.earlier_id, r.start, r.end, r.earlier_start, r.earlier_end)
           for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {(3, 0, 310, 370, 20, 80), (4, 0, 0, 60, 20, 80), (4, 3, 220, 289, 90, 159)} <= got
    assert {(d, e) for d, e, *_ in got} == {(3, 0), (4, 0), (4, 3)}


def test_a_phrase_alone_does_not_make_a_candidate():
    """23 words beside a seed that any holder may have: of the others in 50 words, ten must be shared (over 37 words, none)."""
    import numpy as np
    from rulesift.llm import passage_chains as P
    near = P.Neighbours(None, None, 50, 75)
    given = (near.offsets < -12) | (near.offsets >= P.SEED_WORDS + 11)
    inside = np.ones((1, len(given)), bool)
    assert (~given).sum() == 23 and near.needed(given[None], inside).tolist() == [10]
    # a text that ends there has no stretch of 50 words, and no partner either
    assert near.needed(np.zeros_like(inside), ~given[None]).tolist() == [10]


def test_extensions_that_can_gain_nothing_more_are_left():
    import numpy as np
    from rulesift.llm.passage_chains import extend
    rng = np.random.default_rng(5)
    b, a = rng.integers(0, 1 << 30, (2, 40, 79))
    a[0, :60] = b[0, :60]
    a[1, 1:50] = b[1, :49]
    a[2, 40:] = b[2, 40:]
    assert [tuple(int(v[i]) for v in extend(b, a, 1)) for i in range(4)] == [(60, 60, 60), (49, 50, 49), (0, 0, 0), (0, 0, 0)]


def test_steps_of_the_longest_common_subsequence():
    import numpy as np
    from rulesift.llm.passage_chains import common_steps, common_words
    rng = np.random.default_rng(8)
    for width in (1, 64, 150):
        x, y = rng.integers(0, 12, (30, 90)), rng.integers(0, 12, (30, width))
        got = common_steps(x, y)
        for r in range(30):
            assert got[0][r].tolist() == np.diff([common_words(x[r, :i], y[r]) for i in range(91)]).astype(bool).tolist()
            assert got[1][r].tolist() == np.diff([common_words(x[r], y[r, :j]) for j in range(width + 1)]).astype(bool).tolist()
