"""The registered queries of this subpackage, one for each operator, with SQL twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    """Register ``fn`` under its name; the session must name a shared folder."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@register
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.kneser_ney import KneserNey
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = KneserNey.train(docs, ~held_out)
    return model.score(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@register
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.ngram_jaccard import jaccard_components
    return jaccard_components(read(spark, sf_dir, "documents"))


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.suffix_dedup import cut_repeats
    return cut_repeats(read(spark, sf_dir, "documents"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of op6 from the index's matches."""
    from rulesift.llm.decontaminate import PositionalIndex
    ids = F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    return (PositionalIndex.build(docs).search(items, width=10)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op6_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
             FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
       FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, coalesce(it.h, sha256('')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+')"

ORACLE["op5_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS h
      FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

ORACLE["op7_suffix_dedup"] = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 99]) AS h
      FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 99)) AS i FROM t WHERE octet_length(b) >= 100)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS brk FROM c)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM s
      UNION ALL SELECT t.doc_id, coalesce(max(s.z), 0) + 1, max(octet_length(t.b)) FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
k AS (SELECT e.doc_id, string_agg(lower(hex(t.b[e.a:e.z])), '' ORDER BY e.a) AS x FROM e JOIN t USING (doc_id) WHERE e.z >= e.a GROUP BY e.doc_id),
q AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(t.b) AS BIGINT) AS n_bytes, CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(q.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
FROM t LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def vocabulary(name: str):
    """A public vocabulary file by name; the path is only read here, on the driver."""
    import public_tokenizers
    from rulesift.llm.pieces import Pieces
    return Pieces.load(public_tokenizers.path(name))


@register
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.bpe_table import PrefixTable, encode
    return encode(read(spark, sf_dir, "documents"), PrefixTable(vocabulary("piece_bpe_32k.model")))


@register
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.unigram_count import UnigramCounter, count_tokens
    return count_tokens(read(spark, sf_dir, "documents"), UnigramCounter(vocabulary("piece_bpe_32k.model")))


@register
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.topk_search import top_k
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLE["op2_topk_search"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
u AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS d FROM e),
p AS (SELECT q.vec_id AS query_id, b.vec_id, sum(q.c * b.c) AS score
      FROM u q JOIN u b ON q.d = b.d AND q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm import toxicity
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@register
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.warc import read_archives, write_archives
    archives = write_archives(read(spark, sf_dir, "pages"), min_bytes=0)
    return read_archives(spark, archives).drop("error")


#: Base 32 of the digest: its hexadecimal digits as bits, five bits a character.
ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
m AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM m)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
              + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


@register
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.passage_chains import fuzzy_passages
    return fuzzy_passages(read(spark, sf_dir, "documents"), min_words=50, percent=75)


@register
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm.filter_audit import audit
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("lang"))


ORACLE["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a,
             100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c,
             regexp_matches(x, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda n: CASE n WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failed
      FROM f),
h AS (SELECT part, failed, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM g GROUP BY part, failed),
x AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, generate_series(1, 5) q(step)),
y AS (SELECT part, filter_order, step, n, n_good, n_toxic, list_contains(failed, own) AS hit, len(failed) AS k,
             len(list_intersect(failed, before)) > 0 AS gone
      FROM h, s),
r AS (SELECT part, filter_order, step, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN hit AND k = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN hit AND NOT gone THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN hit AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM y GROUP BY part, filter_order, step),
z AS (SELECT part, filter_order[step] AS own, sum(removed) AS shapley FROM r GROUP BY part, filter_order[step])
SELECT r.part, r.filter_order, CAST(r.step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN z ON z.part = r.part AND z.own = filter_order[step]
"""


@register
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulesift.llm import compression_quality as quality
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@register
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from rulesift.llm.token_alignment import TokenizerPair, align_corpus
    pair = TokenizerPair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align_corpus(read(spark, sf_dir, "documents"), pair)
