"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its 5-grams of lower-case bytes, which carry its words, and 4-grams of its shape (letters become ``a`` or ``A``, digits ``0``, other
characters stay), which don't depend on the language. Each kind is hashed to half of ``TERMS`` places, log-damped and weighted by inverse document frequency.
Beside them stand, with less weight, a few ratios: repeated words and lines, capitals, punctuation, digits, shortness. A singular value decomposition of a bounded sample of labelled rows gives ``DIMENSIONS``
directions; the sample's vectors and labels go to every task. There each block of documents is
multiplied with all of them, so cosines are exact, and the ``NEIGHBOURS`` nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, small_batches

TERMS, RATIOS = 4096, 7
DIMENSIONS, NEIGHBOURS = 64, 15
#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
SAMPLE = 4096
#: Weight of the ratios beside the terms, of which each kind has length 1.
RATIO_WEIGHT = 0.5
#: Documents multiplied at once.
BLOCK = 64

LOWER = np.arange(256, dtype=np.uint64)
LOWER[ord("A") : ord("Z") + 1] += 32
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[[9, 11, 12, 13]] = ord(" ")


def ratios(data: bytes, shape: np.ndarray) -> list[float]:
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = np.bincount(shape, minlength=256)
    letters = kinds[ord("a")] + kinds[ord("A")]
    marks = size - letters - kinds[ord("0")] - kinds[ord(" ")] - kinds[10]
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 3 else 0.0,
        float(kinds[ord("A")] / max(1, letters)),
        float(min(1.0, 4 * marks / size)),
        float(min(1.0, 4 * kinds[ord("0")] / size)),
        1 - len(set(lines)) / max(1, len(lines)),
        1 / (1 + n / 20),
    ]


def raw_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Damped term counts and ratios of each text; an empty text has no terms."""
    counts = np.zeros((len(texts), TERMS), np.float32)
    extra = np.zeros((len(texts), RATIOS), np.float32)
    for k, data in enumerate(texts):
        s = SHAPE[np.frombuffer(data, np.uint8)]
        if len(s) >= 4:
            g = (s[:-3] | s[1:-2] << np.uint32(7) | s[2:-1] << np.uint32(14) | s[3:] << np.uint32(21)) * np.uint32(2654435761)
            counts[k, : TERMS // 2] = np.bincount(g >> np.uint32(21), minlength=TERMS // 2)
        if len(s) >= 5:
            t = LOWER[np.frombuffer(data, np.uint8)]
            g = t[:-4] | t[1:-3] << np.uint64(8) | t[2:-2] << np.uint64(16) | t[3:-1] << np.uint64(24) | t[4:] << np.uint64(32)
            counts[k, TERMS // 2 :] = np.bincount(((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64), minlength=TERMS // 2)
        extra[k] = ratios(data, s)
    return np.log1p(counts, out=counts), extra


@dataclass
class Model:
    """Directions, sample vectors of length 1, their labels, and what is subtracted or weighted first."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, terms: np.ndarray, extra: np.ndarray) -> np.ndarray:
        kinds = np.split(terms * self.idf, 2, axis=1)
        for x in kinds:
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return np.hstack([*kinds, RATIO_WEIGHT * extra])

    def latent(self, texts: list[bytes]) -> np.ndarray:
        v = self.weigh(*raw_terms(texts)) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The share of label 1 in the neighbours' votes; 0.5 if nothing was learned. Of equally near ones the first of the sample vote, which stands in the order of ids."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        close = self.latent(texts) @ self.vectors.T
        k = min(NEIGHBOURS, close.shape[1])
        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(close, near, axis=1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((close >= least).sum(axis=1) > k):  # ties at the last neighbour: the first of the sample
            near[row] = np.lexsort((np.arange(close.shape[1]), -close[row]))[:k]
        weight = np.maximum(np.take_along_axis(close, near, axis=1).astype(np.float64), 1e-6) ** 8
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit(terms: np.ndarray, extra: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Inverse document frequencies and singular directions (randomised, three passes) of the sample."""
    idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
    m = Model(idf, np.zeros((TERMS + RATIOS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), labels.astype(np.float64))
    if not len(labels):
        return m
    x = m.weigh(terms, extra)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    m.basis[:, : min(DIMENSIONS, len(vt))] = (q @ vt.T)[:, :DIMENSIONS]
    v = x @ m.basis
    m.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows of ``docs`` whose id falls in the training folds.

    The sample is the ``sample`` ids with the smallest hash, so it is spread evenly and bounded;
    rows with a null label or id aren't learned from, and of repeated ids the lower label counts. Term vectors are made on the executors; the
    driver gets ``sample`` rows of ``TERMS`` single-byte counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = bytes_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, extra = raw_terms([x or b"" for x in b.column(2).to_pylist()])
            small = np.minimum(np.rint(terms * 16), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.tobytes() for x in small], pa.binary()), pa.array([x.tobytes() for x in extra], pa.binary())],
                ["doc_id", "label", "terms", "extra"],
            )

    made = rows.mapInArrow(run, "doc_id long, label int, terms binary, extra binary")
    # repeated ids in docs can't make the sample larger than its bound
    found = sorted(made.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect(), key=lambda r: (r.doc_id, bytes(r.terms), bytes(r.extra)))
    terms = np.frombuffer(b"".join(bytes(r.terms) for r in found), np.uint8).reshape(-1, TERMS).astype(np.float32) / 16
    extra = np.frombuffer(b"".join(bytes(r.extra) for r in found), np.float32).reshape(-1, RATIOS)
    return fit(terms, extra, np.array([r.label for r in found]))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` for every row.

    A null text is scored as an empty one. A null id is not held out. Without any label every score
    is 0.5. Ids may repeat. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            s = [sent.value.scores(texts[k : k + BLOCK]) for k in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s) if s else [], pa.float64())], ["doc_id", "score"])

    found = bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns as they are, whatever their names.

    Each row is judged by its text alone: a null one as an empty one, repeated rows alike. Ids aren't read. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        data = [x.encode() if isinstance(x, str) else b"" for x in texts]
        return pd.Series(np.concatenate([sent.value.scores(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK)] or [np.zeros(0)]))

    return docs.where(quality(docs[text_col].cast("string")) >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
