"""Corpus pipeline: from raw documents to tokens, five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet in the shared
folder and reads it again for the next stage, so a lost executor costs part of one stage. All stages but the last return
the columns of ``documents``; other columns of the input pass through.

Edge cases: null and empty texts pass the filters (no toxic terms, no shingles, no test words) and give the begin and end
ids; identical rows (id and text) are one document from the second stage on; rows without an id, and rows that share one, are judged
by their texts; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.llm import files, ngram_jaccard, suffix_dedup, toxicity
from rulesift.llm.bpe_table import PrefixTable, encode
from rulesift.llm.queries import contamination, read, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic. Learns from labelled rows of ``docs``
    whose crc32(doc_id) mod 5 is not 0, as op8 does."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), learn), carry=True)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents: that of the least doc_id (rows without one last), then of the least row key.

    Rows are told apart by a key of id and text, so ids that occur twice and rows without ids are judged row by row."""
    key = F.xxhash64("doc_id", "text")
    found = ngram_jaccard.jaccard_components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").checkpoint()
    ids = docs.select(key.alias("row_key"), "doc_id").distinct()
    kept = (found.distinct().join(ids, "row_key").groupBy("component_id")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("kept")))
    rows = docs.join(kept, key == kept["kept"], "left_semi")
    if found.groupBy("row_key").count().where("count > 1").isEmpty():
        return rows
    # identical rows become one
    digest = "_".join(["row_key", uuid.uuid4().hex])
    return rows.withColumn(digest, key).dropDuplicates([digest]).drop(digest)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 100-byte repeats cover; n_chars follows the text."""
    cut = suffix_dedup.cut_repeats(docs, length=100, keep_text=True)
    column = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*((column[c] if c in column else F.col("row").getField(c)).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    key = F.xxhash64("doc_id", "text")
    found = contamination(spark, docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, key == bad["bad"], "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids themselves."""
    return encode(docs, PrefixTable(vocabulary("piece_bpe_32k.model")), keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokens),
]

#: SQL can express neither the model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    folder = files.scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
