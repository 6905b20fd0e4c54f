"""Quality by compression: which labelled texts help a compressor more.

One zstandard dictionary is built from good texts and one from bad texts. A text is cut into blocks, each block is compressed with
both, and the normalised difference of the sizes, (bad - good) / (bad + good), is above 0 where the good dictionary
saves more. A logistic curve fitted on labelled texts that the dictionaries have not seen turns the difference into a probability.
Blocks are short, so that the dictionary and not the text's own beginning decides, and all blocks of a text count.

Learning is bounded by parameters: at most ``max_rows`` labelled documents, those with the least hash of doc_id (of several texts of one
doc_id the one of least hash); a quarter of them fits the curve, the others give blocks, of which each class keeps
the ``max_blocks`` of least hash. So the dictionaries have a fixed size and are sent to every task. Scoring is one pass over
whole texts, without a shuffle.

Edge cases: null and empty texts have one empty block and are scored at the difference 0; where one class has no labelled text, every score is
the share of good labels (one half without labels); too few blocks to train a dictionary on are a dictionary as they are;
labels that are null are ignored, of several labels of one document the greatest holds; repeated rows and null ids are scored as they
are; other columns are never inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm import textarrays as T

MAX_ROWS, MAX_BLOCKS = 12_000, 12_000
BLOCK, DICTIONARY_BYTES, LEVEL = 512, 64 << 10, 3
#: One in so many labelled documents fits the curve.
FOLDS = 4
#: Weight of the prior of the curve: a ridge on the scaled slope, so that separable rows give a finite one.
RIDGE = 1e-2


@dataclass
class CompressionClassifier:
    """Two dictionaries and the curve; the compressors are made on first use in a process."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float
    block: int = BLOCK
    level: int = LEVEL
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": []}

    def difference(self, text: memoryview | bytes) -> float:
        """The normalised difference of the compressed sizes of a whole text."""
        if not self._made:
            import zstandard
            for data in (self.good, self.bad):
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False,
                                                           write_content_size=False, write_dict_id=False))
        a, b = self._made
        good = bad = 0
        for at in range(0, max(len(text), 1), self.block):
            part = text[at:at + self.block]
            good += len(a.compress(part))
            bad += len(b.compress(part))
        return (bad - good) / (bad + good)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -500, 500)))


def build_dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on the blocks; where they are too few or too alike, the blocks themselves, the last ones of ``size`` bytes."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def fit_curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's method; the slope is not below 0."""
    n, positive = len(label), float(label.sum())
    # a row of each class is added, so that no probability is 0 or 1
    base = math.log((positive + 1) / (n - positive + 1))
    scale = float(np.std(x)) if n else 0.0
    if scale == 0 or positive in (0.0, float(n)):
        return base, 0.0
    z = np.column_stack([np.ones(n), x / scale])
    w = np.array([base, 0.0])
    penalty = np.array([0.0, RIDGE])

    def loss(w):
        raw = z @ w
        return float(np.logaddexp(0, raw).sum() - label @ raw + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (p - label) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10:
            break
    if w[1] <= 0:
        return base, 0.0
    return float(w[0]), float(w[1] / scale)


def _texts(batches):
    """(rows, text as bytes) of each row."""
    for rows, buf, offsets in T.chunks(batches):
        data = memoryview(buf.tobytes())
        yield rows, [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _blocks(size: int):
    def run(batches):
        for rows, texts in _texts(batches):
            names = ("doc_id", "label")
            ids, labels = (rows.column(rows.schema.get_field_index(c)) for c in names)
            for i, text in enumerate(texts):
                parts = [bytes(text[at:at + size]) for at in range(0, len(text), size)]
                n = len(parts)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * n, pa.int64()), pa.array([labels[i].as_py()] * n, pa.int32()),
                                                      pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())],
                                                     names=["doc_id", "label", "at", "block"])
    return run


def _differences(shared):
    def run(batches):
        for rows, texts in _texts(batches):
            x = [shared.value.difference(t) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("label")), pa.array(x, pa.float64())], names=["label", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS, max_blocks: int = MAX_BLOCKS,
          block: int = BLOCK, size: int = DICTIONARY_BYTES) -> CompressionClassifier | float:
    """From at most ``max_rows`` labelled rows for which ``learn`` (over doc_id) holds; a constant probability where a class is missing."""
    sample = (labels.where("doc_id is not null and quality is not null").where(learn).groupBy("doc_id").agg(F.max("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows ids; an id that many rows have gives one text
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").checkpoint())
    counts = dict(rows.groupBy("label").count().collect())  # a row for each class
    n, good = sum(counts.values()), counts.get(1, 0)
    if good in (0, n):
        return good / n if n else 0.5
    held = F.abs(F.xxhash64(F.lit("curve"), "doc_id") % FOLDS) == 0
    seen = dict(rows.where(~held).groupBy("label").count().collect())
    if len(seen) < 2:  # too few rows to keep some apart
        held = F.lit(False)
    blocks = rows.where(~held).mapInArrow(_blocks(block), "doc_id long, label int, at long, block binary")
    key = F.xxhash64("block", "doc_id", "at")
    chosen = [blocks.where(F.col("label") == k).orderBy(key, "doc_id", "at").limit(max_blocks) for k in (0, 1)]

    def build(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # the order in which tasks deliver blocks must not change the dictionary
        cells = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "at", "block"))))
        return pa.table({"label": pa.array([group[0].as_py()], pa.int32()), "data": pa.array([build_dictionary([c[2] for c in cells], size)], pa.binary())})

    made = dict(chosen[0].unionByName(chosen[1]).groupBy("label").applyInArrow(build, "label int, data binary").collect())  # a dictionary a class
    model = CompressionClassifier(made.get(1, b""), made.get(0, b""), 0.0, 0.0, block)
    fitting = rows.where(held)
    kinds = dict(fitting.groupBy("label").count().collect())
    if len(kinds) < 2:
        fitting = rows
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    points = fitting.mapInArrow(_differences(shared), "label int, x double").orderBy("x", "label").collect()  # at most max_rows numbers
    model.intercept, model.slope = fit_curve(np.array([p.x for p in points]), np.array([float(p.label == 1) for p in points]))
    return model


def score(docs: DataFrame, model: CompressionClassifier | float) -> DataFrame:
    """doc_id, difference (null without a model), score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, texts in _texts(batches):
            if isinstance(m, float):
                x, p = pa.nulls(len(texts), pa.float64()), np.full(len(texts), m)
            else:
                d = np.array([m.difference(t) for t in texts])
                x, p = pa.array(d), m.probability(d)
            yield pa.RecordBatch.from_arrays([rows.column(0), x, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["doc_id", "difference", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, difference double, score double, predicted int")
