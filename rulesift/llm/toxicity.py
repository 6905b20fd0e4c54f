"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms of a text. The pair term is
half of (sum v)**2 - sum v**2 per factor, so scoring is linear in the terms, yet the model learns
combinations, such as an insult with a group mention, that a sum of single weights can't express.

Terms are runs of letters and digits (A-Z folded) and the stems of longer ones, by 64-bit hash, so no dictionary is kept; the model has
entries for terms that tell the classes apart in the training rows (chi-squared), at most ``max_terms``. It is
fitted in one task on at most ``max_rows`` labelled rows, those with the smallest hash of doc_id: both are
documented bounds, and so the model's size is bounded and it can be broadcast. Scoring covers every
row and whole texts, without a shuffle.

Edge cases: null and empty texts have no terms and score sigmoid(w0); with no labelled rows every
score is 0; with one class the score is near it; labels that are null are ignored, of several labels of one document
the greatest holds; repeated rows and null ids are scored as they are; other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rulesift.llm import textarrays as T

MAX_ROWS, MAX_TERMS = 12_000, 1 << 16
FACTORS, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 8, 12, 600, 64, 0.1, 1e-3, 17
#: Chi-squared with one degree of freedom at one in a thousand.
LEAST_CHI = 10.8
#: Bytes of the stems of words that are terms beside the words.
STEMS = (4, 5)
#: Toxic rows are the rarer class; how much more an error on one weighs.
POSITIVE_WEIGHT = 2.0


@dataclass
class FactorizationMachine:
    """``terms`` sorted; ``w`` their weights, ``v`` their factors."""

    bias: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def raw(self, place: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid; (place, text) pairs sorted by text."""
        out = np.full(n, self.bias)
        if len(place):
            out += np.bincount(text, self.w[place], n)
            for f in range(self.v.shape[1]):
                x = self.v[place, f]
                total = np.bincount(text, x, n)
                out += 0.5 * (total * total - np.bincount(text, x * x, n))
        return out

    @staticmethod
    def fit(text: np.ndarray, term: np.ndarray, label: np.ndarray, max_terms: int = MAX_TERMS) -> FactorizationMachine:
        """From distinct (text, term) pairs sorted by text, and a 0/1 label for each text."""
        n, positive = len(label), int(label.sum())
        terms, place, df = np.unique(term, return_inverse=True, return_counts=True)
        hits = np.bincount(place, label[text], len(terms))
        a, b = hits, df - hits
        c, d = positive - a, (n - positive) - b
        bottom = (a + b) * (c + d) * (a + c) * (b + d)
        chi = np.divide(n * (a * d - b * c) ** 2, bottom, out=np.zeros(len(terms)), where=bottom > 0)
        chosen = np.flatnonzero((chi >= LEAST_CHI) & (df > 2))
        if len(chosen) > max_terms:
            chosen = np.sort(chosen[np.argsort(-chi[chosen], kind="stable")[:max_terms]])
        new = np.full(len(terms), -1)
        new[chosen] = np.arange(len(chosen))
        keep = new[place] >= 0
        text, place = text[keep], new[place][keep]
        first = np.searchsorted(text, np.arange(n + 1))
        rng = np.random.default_rng(SEED)
        rate = min(max(positive / max(n, 1), 1e-4), 1 - 1e-4)
        bias = float(np.log(rate / (1 - rate)))
        w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS))
        gw, gv, gb = np.full(len(chosen), 1e-6), np.full((len(chosen), FACTORS), 1e-6), 1e-6
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(n, 1)))):  # few rows are gone through more often
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                rows = order[at:at + BATCH]
                size = first[rows + 1] - first[rows]
                own = np.repeat(np.arange(len(rows)), size)
                p = place[np.arange(len(own)) + np.repeat(first[rows] - (np.cumsum(size) - size), size)]
                x = v[p]
                total = np.zeros((len(rows), FACTORS))
                np.add.at(total, own, x)
                raw = bias + np.bincount(own, w[p], len(rows)) + 0.5 * ((total * total).sum(1) - np.bincount(own, (x * x).sum(1), len(rows)))
                slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
                slope *= np.where(label[rows] == 1, POSITIVE_WEIGHT, 1.0)
                some, back = np.unique(p, return_inverse=True)
                dw = np.bincount(back, slope[own], len(some)) + DECAY * w[some]
                dv = DECAY * v[some]
                np.add.at(dv, back, slope[own][:, None] * (total[own] - x))
                gw[some] += dw * dw
                gv[some] += dv * dv
                gb += slope.sum() ** 2
                w[some] -= RATE * dw / np.sqrt(gw[some])
                v[some] -= 0.3 * RATE * dv / np.sqrt(gv[some])
                bias -= RATE * slope.sum() / np.sqrt(gb)
        return FactorizationMachine(bias, terms[chosen], w, v)


def distinct_terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) once each, sorted by text: the words and, of longer words, their first bytes."""
    buf = T.LOWER[buf]
    starts, ends, first = T.find_words(buf, offsets, T.ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words, texts = [T.hash_ranges(buf, starts, ends)], [text]
    for k in STEMS:
        longer = ends - starts > k
        words.append(T.hash_ranges(buf, starts[longer], starts[longer] + k) ^ T.U64(k))
        texts.append(text[longer])
    words, text = np.concatenate(words), np.concatenate(texts)
    order = np.lexsort((words, text))
    words, text = words[order], text[order]
    if len(words):
        new = np.concatenate([[True], (words[1:] != words[:-1]) | (text[1:] != text[:-1])])
        words, text = words[new], text[new]
    return text, words


def _terms(batches):
    for rows, buf, offsets in T.chunks(batches):
        text, words = distinct_terms(buf, offsets)
        cuts = np.searchsorted(text, np.arange(rows.num_rows + 1))
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), rows.column(rows.schema.get_field_index("label")),
                                          pa.array([words[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                                         names=["doc_id", "label", "terms"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> FactorizationMachine | None:
    """Fit on at most ``max_rows`` of the labelled rows for which ``learn`` (over doc_id) holds; None if there are none."""
    sample = (labels.where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows ids
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text"))

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # the order in which tasks deliver rows must not change the model
        found = sorted(zip(table.column("doc_id").to_pylist(), table.column("label").to_pylist(), table.column("terms").to_pylist()))
        label = np.array([f[1] for f in found], np.int64)
        parts = [np.frombuffer(f[2], T.U64) for f in found]
        text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        m = FactorizationMachine.fit(text, T.concat(parts), label, max_terms)
        return pa.table({"bias": [m.bias], "terms": [m.terms.tobytes()], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    made = (rows.mapInArrow(_terms, "doc_id long, label int, terms binary").groupBy(F.lit(0).alias("one"))
            .applyInArrow(fit, "bias double, terms binary, w binary, v binary").collect())
    if not made:
        return None
    m = made[0]
    return FactorizationMachine(m.bias, np.frombuffer(m.terms, T.U64), np.frombuffer(m.w), np.frombuffer(m.v).reshape(-1, FACTORS))


def score(docs: DataFrame, model: FactorizationMachine | None, carry: bool = False) -> DataFrame:
    """doc_id, score and predicted of every row; with ``carry`` the row's columns instead of doc_id
    (score and predicted are the last two columns and get underscores where the row has such names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_terms terms

    def run(batches):
        m = shared.value
        for rows, buf, offsets in T.chunks(batches):
            n = rows.num_rows
            out = np.zeros(n)
            if m is not None:
                text, words = distinct_terms(buf, offsets)
                if len(m.terms):
                    place = np.minimum(np.searchsorted(m.terms, words), len(m.terms) - 1)
                    hit = m.terms[place] == words
                    text, place = text[hit], place[hit]
                else:
                    text = place = np.zeros(0, np.int64)
                out = 1 / (1 + np.exp(-np.clip(m.raw(place, text, n), -500, 500)))
            names = [c for c in rows.schema.names if carry or c != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(out),
                                              pa.array((out >= 0.5).astype(np.int32))], names=schema.names)

    if carry:
        base, schema = docs, docs.schema
    else:
        base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
        schema = base.select("doc_id").schema
    taken = {c.lower() for c in schema.names}
    for name, kind in (("score", "double"), ("predicted", "int")):
        while name in taken:
            name += "_"
        schema = StructType([*schema.fields, StructField(name, DoubleType() if kind == "double" else IntegerType())])
    return base.mapInArrow(run, schema)
