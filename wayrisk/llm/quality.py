"""Quality classifier: nearest-neighbour voting in a latent-semantic space (operator 8).

Terms are hashed byte trigrams and a few shape terms (repeats, capitals,
symbols and so on) of the whole text. A bounded, documented sample of labelled
rows (`sample` rows, those with the smallest hash of their id and text) is
factored by SVD in one task, which meets `sample` rows of terms whatever the
size of the corpus; the driver and all tasks get the projection, and the sample's
latent vectors and labels (sample x dims floats). Every document's exact cosines
with all of them are computed in blocks, and the labels of its nearest
neighbours vote with a weight that grows with similarity. Labels, language,
source and id never enter a score.

Defined results: a null, empty or blank text scores 0; without labelled rows
every other text scores 0.5. Repeated rows score alike; several labels of one
id count each; null labels are not learned from. Where rows share an id, each
of their texts may be learned from, within `sample` in all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.shared import shared_table, small_batches

GRAMS = 2048
SHAPES = 10
BLOCK = 256


def terms(text: str | None) -> np.ndarray:
    """Term counts of a text: GRAMS hashed byte trigrams, then SHAPES shares between 0 and 1."""
    out = np.zeros(GRAMS + SHAPES, np.float32)
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    a = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    h = (a[:-2] * 0x9E3779B1) ^ (a[1:-1] * 0x85EBCA77) ^ (a[2:] * 0xC2B2AE3D)
    out[:GRAMS] = np.bincount((h >> 15) % GRAMS, minlength=GRAMS)
    n, kinds = len(words), np.bincount(a, minlength=256)
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()
    lines = data.split(b"\n")
    out[GRAMS:] = (
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        kinds[65:91].sum() / max(1, letters),
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / len(data),
        kinds[48:58].sum() / len(data),
        1 - len(set(lines)) / len(lines),
        min(1.0, len(data) / n / 20),
        1 / n,
        min(1.0, n / 64),
        kinds[124] / n if n else 0,
    )
    return out


class Model:
    """Projection to the latent space, and the labelled vectors in it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int, shape_weight: float, neighbours: int, sharpness: float):
        self.shape_weight, self.neighbours, self.sharpness = shape_weight, neighbours, sharpness
        self.idf = np.log((1 + len(rows)) / (1 + (rows[:, :GRAMS] > 0).sum(0))).astype(np.float32) + 1
        for i in range(0, len(rows), BLOCK):  # weighed in their place, which needs no further memory
            rows[i : i + BLOCK] = self.weigh(rows[i : i + BLOCK])
        self.basis = self._subspace(rows, dims).astype(np.float32)
        self.vectors = np.vstack([self.unit(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
        self.labels = labels.astype(np.float32)

    def _subspace(self, rows: np.ndarray, dims: int, more: int = 32, rounds: int = 20) -> np.ndarray:
        """The `dims` strongest right singular vectors of weighed rows, by subspace iteration from a seeded start; memory for `dims` + `more` vectors."""
        size = GRAMS + SHAPES
        q = np.linalg.qr(np.random.default_rng(8).standard_normal((size, min(dims + more, size))))[0]
        for k in range(rounds + 1):
            z, small = np.zeros_like(q), 0.0
            for i in range(0, len(rows), BLOCK):
                weighed = rows[i : i + BLOCK].astype(np.float64)
                at = weighed @ q
                z += weighed.T @ at
                small += at.T @ at
            if k == rounds:  # the vectors of the subspace, strongest first
                values, vectors = np.linalg.eigh(small)
                return q @ vectors[:, np.argsort(-values)[:dims]]
            q = np.linalg.qr(z)[0]

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        g = np.log1p(rows[:, :GRAMS]) * self.idf
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-9)
        return np.hstack([g, self.shape_weight * rows[:, GRAMS:]])

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return self.unit(self.weigh(rows))

    def unit(self, weighed: np.ndarray) -> np.ndarray:
        v = weighed @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        near = self.latent(rows) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.exp(self.sharpness * (np.take_along_axis(near, top, 1).astype(np.float64) - 1))
        out = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.where(rows[:, :GRAMS].any(1), np.clip(out, 0, 1), 0.0)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, dims: int = 48, shape_weight: float = 0.5, neighbours: int = 15, sharpness: float = 20.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from at most `sample` labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0).cast(pa.string()), b.column(1), pa.array([terms(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["id", "label", "terms"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if found:
            labels = np.array([label for _, label, _ in found])
            rows = np.empty((len(found), GRAMS + SHAPES), np.float32)
            for i in range(len(found)):
                rows[i], found[i] = np.frombuffer(found[i][2], np.float32), ()
            model = Model(rows, labels, dims, shape_weight, neighbours, sharpness)
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # Written, as the order's limit and the repartition would each count terms anew. Where rows share ids there may be more than `sample`.
    rows = shared_table(given.mapInArrow(counted, "id string, label int, terms binary"), "terms")
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("terms")).limit(sample)
    found = chosen.repartition(1).mapInArrow(learned, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column `name` added (or put in place of one so called). Only texts go to the workers, and only scores come back."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            out = [np.zeros(0)]
            for i in range(0, len(texts), BLOCK):
                rows = np.stack([terms(t.as_py()) for t in texts[i : i + BLOCK]])
                out.append(model.score(rows) if model else np.where(rows[:, :GRAMS].any(1), 0.5, 0.0))
            yield pa.array(np.concatenate(out))

    return docs.withColumn(name, F.arrow_udf(scores, "double")(F.col(text_col)))
