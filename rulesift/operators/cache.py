"""Response and embedding caches with pluggable functions.

One mechanism for the annotator, the synthesizer and the embedder:

1. Requests are keyed by a digest of what is asked (model, context such as template and guideline, item).
2. Keys are looked up in the cache (``operators.keyed_store``: only prefixes in which an asked key may be are read); only distinct
   misses go on, dealt over ``tasks`` tasks (an explicit number, which adaptive execution keeps, since the cost of a call has
   nothing to do with the bytes of its request).
3. Each task calls the user function with at most ``batch_size`` items. A failing batch, or one with a wrong number of
   answers, is halved until the failing items stand alone; those are tried again, then keep an error and no answer.
4. Answers are appended to the cache before they are used, then the requests' keys are read back from the recent
   batches. So a retried task or a repeated job does not call again for stored keys, and readers of
   one cache see one answer for each key, whatever a function says when asked twice.
5. Many batches are folded into sorted runs, so the number of files stays bounded.

A prompt is made inside the call from the item and the context. Neither the context nor the prompt is shuffled or checkpointed.

The joined result is checkpointed before it is returned. A later plan that
also reads the cache folder (an earlier or later round) would otherwise hold
two scans of the same path with different file listings, which Spark treats
as the same exchange and may reuse - giving one of them stale contents.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.functions.text import text_key
from rulesift.operators.keyed_store import KeyedStore, distinct_keys, one_row
from rulesift.schema import EMBEDDING_CACHE, RESPONSE_CACHE
from rulesift.session import cut_lineage

BATCH_SIZE = 20          # items per call to a pluggable function
MAX_ATTEMPTS = 3         # calls for an item that fails alone, then its error is kept (ledger L10)
TASKS_PER_CORE = 4       # tasks that calls are dealt over, by default, for each core

Annotator = Callable[[list[str]], list[dict]]
Embedder = Callable[[list[str]], list[list[float]]]


def batches(df: DataFrame, ordinal: str = "ordinal", size: int = BATCH_SIZE) -> DataFrame:
    """Fixed-size batches in input order (no window: arithmetic on the ordinal)."""
    return df.withColumn("batch_no", F.floor(F.col(ordinal) / size).cast("bigint")) \
        .withColumn("pos_in_batch", F.pmod(F.col(ordinal), F.lit(size)).cast("int"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def call_tasks(spark: SparkSession, tasks: int | None) -> int:
    return tasks or TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def split_hits(keyed: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, distinct misses) of keyed requests against a cache."""
    known = cache.select(F.col(key)).distinct()
    hits = keyed.join(known, key, "left_semi")
    misses = keyed.join(known, key, "left_anti")
    return hits, misses


def call_halving(fn: Callable[[list], list], items: Sequence) -> list[tuple[object, str | None]]:
    """(answer, error) for each item; a failing batch is halved until the failing items stand alone, and
    those are tried ``MAX_ATTEMPTS`` times (L10, L11)."""
    error = None
    for _ in range(MAX_ATTEMPTS if len(items) == 1 else 1):
        try:
            answers = fn(list(items))
            if len(answers) != len(items):
                raise ValueError(f"{len(answers)} answers for {len(items)} items")
            return [(a, None) for a in answers]
        except Exception as e:  # noqa: BLE001 - the user's function; its error is kept with the item
            error = f"{type(e).__name__}: {e}"
    if len(items) == 1:
        return [(None, error)]
    mid = len(items) // 2
    return call_halving(fn, items[:mid]) + call_halving(fn, items[mid:])


# --- responses (J2) -------------------------------------------------------------

def _call_annotator(fn: Annotator, model: str, batch_size: int, render: Callable[[str], str] | None):
    def run(frames):
        import pandas as pd
        for pdf in frames:
            out = []
            keys, items = list(pdf["prompt_key"]), list(pdf["item"])
            for i in range(0, len(items), batch_size):
                prompts = [render(x) if render else x for x in items[i:i + batch_size]]
                for k, (r, err) in zip(keys[i:i + batch_size], call_halving(fn, prompts)):
                    r = r or {}
                    out.append({"model": model, "prompt_key": k, "response": r.get("response"),
                                "response_reasoning": r.get("reasoning"),
                                "input_tokens": r.get("input_tokens"), "output_tokens": r.get("output_tokens"),
                                "error": err})
            yield pd.DataFrame(out, columns=[f.name for f in RESPONSE_CACHE.fields])
    return run


def respond_with_cache(requests: DataFrame, cache_path: str, model: str, annotator: Annotator,
                       prompt: str = "prompt", batch_size: int = BATCH_SIZE, context: str | None = None,
                       render: Callable[[str], str] | None = None, tasks: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every request gets its response; only misses call ``annotator``.

    ``prompt`` names the column with the item that is asked about. With ``render`` the prompt is
    ``render(item)``, made inside the call, and ``context`` (whatever else ``render`` depends on) is part of
    the key. Returns the requests (``keep``: these columns of them, so that long texts need not move with the answers) with
    prompt_key, response, tokens, error and ``cache_hit``. New rows are
    appended to the cache at ``cache_path``; a failed item is asked again by the next job.
    """
    spark = requests.sparkSession
    item = F.col(prompt)
    if render:
        digest = hashlib.sha256((context or "").encode()).hexdigest()
        item = F.concat(F.lit(digest + "\u001f"), F.coalesce(item, F.lit("")))
    keyed = requests.withColumn("prompt_key", F.sha2(item, 256))
    _, known, one = _through_store(
        KeyedStore(spark, cache_path, RESPONSE_CACHE, "prompt_key", model), keyed, "prompt_key",
        # One item for each key before items move, then the misses only (a semi join would be pushed below the first step).
        lambda missing: keyed.select("prompt_key", F.col(prompt).alias("item")).dropDuplicates(["prompt_key"])
        .join(missing, "prompt_key").repartition(call_tasks(spark, tasks), "prompt_key")
        .mapInPandas(_call_annotator(annotator, model, batch_size, render), RESPONSE_CACHE))
    asked = keyed if keep is None else keyed.select(*keep, "prompt_key")
    return cut_lineage(asked.join(one, "prompt_key", "left")
                       .join(known.select("prompt_key", F.lit(True).alias("cache_hit")), "prompt_key", "left")
                       .select(*asked.columns, "response", "response_reasoning", "input_tokens", "output_tokens", "error",
                               F.coalesce("cache_hit", F.lit(False)).alias("cache_hit")))


def _through_store(store: KeyedStore, keyed: DataFrame, key: str, call) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked keys, stored answers, one row for each asked key): ``call(missing keys)`` makes the rows of the misses."""
    store.adopt()
    keys = distinct_keys(keyed, key)
    known = cut_lineage(one_row(store.lookup(keys).where(F.col("error").isNull()), key, store.schema))
    missing = keys.join(known.select(key), key, "left_anti")
    if missing.isEmpty():
        return keys, known, known
    store.append(call(missing))
    one = cut_lineage(one_row(known.unionByName(store.recent(keys)), key, store.schema))
    store.fold()
    return keys, known, one


def run_cost(answered: DataFrame, prices: DataFrame, model_col: str = "model") -> DataFrame:
    """Tokens and USD per model over computed (not cached) calls.

    ``prices``: the caller's list (model, input_usd_per_mtok, output_usd_per_mtok); a model
    that is not in it has a null cost.
    """
    p = prices
    m = answered.where(~F.col("cache_hit")).groupBy(model_col).agg(
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.count(F.lit(1)).alias("calls"))
    j = m.join(p, m[model_col] == p["model"], "left")
    cost = (F.col("input_tokens") / 1e6 * F.col("input_usd_per_mtok")
            + F.col("output_tokens") / 1e6 * F.col("output_usd_per_mtok"))
    return j.select(m[model_col], "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"))


# --- embeddings (J3 / M1) -------------------------------------------------------

def _call_embedder(fn: Embedder, model: str, batch_size: int):
    def run(frames):
        import pandas as pd
        for pdf in frames:
            keys, texts = list(pdf["text_key"]), list(pdf["text"])
            rows = []
            for i in range(0, len(texts), batch_size):
                for k, (v, err) in zip(keys[i:i + batch_size], call_halving(fn, texts[i:i + batch_size])):
                    rows.append({"model": model, "text_key": k, "embedding": None if err else list(map(float, v)), "error": err})
            yield pd.DataFrame(rows, columns=[f.name for f in EMBEDDING_CACHE.fields])
    return run


def embed_with_cache(df: DataFrame, cache_path: str, model: str, embedder: Embedder,
                     text: str = "text", batch_size: int = BATCH_SIZE, tasks: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """J3 + M1: attach ``embedding`` (ARRAY<FLOAT>) and ``embed_error`` by
    (text, model); only texts missing from the cache are embedded. ``keep``: the columns of ``df`` that are returned, all by
    default; texts that are not among them move only to be embedded."""
    spark = df.sparkSession
    keyed = df.withColumn("text_key", text_key(text))
    _, _, one = _through_store(
        KeyedStore(spark, cache_path, EMBEDDING_CACHE, "text_key", model), keyed, "text_key",
        lambda missing: keyed.select("text_key", F.col(text).alias("text")).dropDuplicates(["text_key"])
        .join(missing, "text_key").repartition(call_tasks(spark, tasks), "text_key")
        .mapInPandas(_call_embedder(embedder, model, batch_size), EMBEDDING_CACHE))
    one = one.select("text_key", F.col("embedding").alias("_e"), F.col("error").alias("_error"))
    kept = df.columns if keep is None else keep
    return cut_lineage(keyed.select(*dict.fromkeys([*kept, "text_key"])).join(one, "text_key", "left").select(
        *kept, "text_key", F.col("_e").alias("embedding"), F.col("_error").alias("embed_error")))


# --- offline plug-ins (deterministic, no network) ----------------------------------

def hashing_embedder(dim: int = 64) -> Embedder:
    """Offline embedder: signed feature hashing of lower-cased words, L2-normalised."""
    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np
        rows = []
        for t in texts:
            row = [0] * (2 * dim)  # words that count for and against each place
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8"))
                row[2 * (h % dim) + ((h >> 16) & 1)] += 1
            rows.append(row)
        counts = np.array(rows, dtype=np.float64).reshape(len(texts), dim, 2)
        out = counts[:, :, 1] - counts[:, :, 0]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        norms[norms == 0] = 1.0
        return (out / norms).astype(np.float32).tolist()
    return embed


def offline_annotator(labels: int = 2) -> Annotator:
    """Offline annotator: a deterministic JSON answer per prompt (label and
    confidence from the first 32 bits of the prompt's SHA-256, which SQL can
    compute too), with token counts."""
    def annotate(prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            h = int(hashlib.sha256(p.encode("utf-8")).hexdigest()[:8], 16)
            label, conf = h % labels, 40 + (h >> 8) % 61
            edge = conf <= 75
            rule = "When the text is short and unclear -> classify as 0" if edge else "EMPTY"
            body = json.dumps({"analysis": "offline checksum answer", "annotation": str(label),
                               "confidence": conf, "new_edge_case": edge, "new_edge_case_rule": rule})
            out.append({"response": body, "reasoning": None,
                        "input_tokens": math.ceil(len(p) / 4), "output_tokens": math.ceil(len(body) / 4)})
        return out
    return annotate
