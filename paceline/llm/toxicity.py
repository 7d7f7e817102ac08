"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents are labelled. Each sentence gets the probability ``sigmoid(bias + weights of its terms)``, and a
document's score is their noisy-or, ``1 - product of (1 - p)``. Weights and bias are trained on the documents' labels through the
noisy-or, so that the sentences that make the labels likely are found without having been labelled, and can be located.

A term is a whole word (marked ``=``) or a word's first ``PREFIXES`` bytes, in lower case. Terms are chosen by the likelihood ratio
of their presence in toxic and other documents. A sentence without any chosen term has probability 0, so that length alone never makes a text toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, small_batches, staged

#: Labelled rows that are learned from, at most, toxic ones and others: those with the smallest hash of their id.
TOXIC, OTHERS = 4096, 8192
#: Terms of toxic documents that are counted among the others, and terms that get a weight, at most.
CANDIDATES, TERMS = 16384, 2048
#: A term stands in this many toxic documents at least, and its likelihood ratio is at least this.
LEAST_DOCS, LEAST_RATIO = 3, 12.0
#: Different sentences of one document that are learned from, at most.
SENTENCES = 256
#: Weight of the squared weights beside the loss; steps of the fit.
RIDGE, STEPS = 0.1, 80
#: Words whose terms a task remembers.
REMEMBERED = 1 << 17
PREFIXES = range(3, 9)
TOXIC_FROM = 0.7

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTENCE = re.compile(rb"[^.!?\n]+")


def terms_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


def terms_in(data: bytes) -> set[bytes]:
    return {t for w in set(WORD.findall(data.lower())) for t in terms_of(w)}


class Places(dict):
    """From a word to the places of its chosen terms; forgets all when it holds ``REMEMBERED`` words."""

    def __init__(self, places: dict[bytes, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.places[t] for t in terms_of(word) if t in self.places)
        return found


def sentence_terms(data: bytes, places: Places) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Begin, end and places of the different chosen terms of each sentence that has any."""
    for s in SENTENCE.finditer(data.lower()):
        found = [p for p in map(places.__getitem__, WORD.findall(s[0])) if p]
        if found:
            yield s.start(), s.end(), tuple(sorted({x for p in found for x in p}))


@dataclass
class Model:
    terms: list[bytes]
    weights: np.ndarray
    bias: float
    places: Places | None = field(default=None, repr=False)

    def sentences(self, data: bytes) -> list[tuple[int, int, float]]:
        """Begin and end in bytes and probability of the sentences that have a chosen term."""
        if self.places is None:
            self.places = Places({t: k for k, t in enumerate(self.terms)})
        return [(a, b, float(1 / (1 + np.exp(-(self.bias + self.weights[list(t)].sum()))))) for a, b, t in sentence_terms(data, self.places)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": None}


def noisy_or(chances: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(chances, 1 - 1e-12)).sum())) if chances else 0.0


def likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: float, others: float) -> np.ndarray:
    """Twice the log likelihood ratio of a term in ``a`` of ``toxic`` and ``b`` of ``others`` documents against one common rate."""
    x = lambda n: n * np.log(np.maximum(n, 1e-12))
    c, d = toxic - a, others - b
    return 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(a + c) - x(b + d) + x(a + b + c + d))


def fit(doc: np.ndarray, sizes: np.ndarray, times: np.ndarray, cols: np.ndarray, labels: np.ndarray, balance: np.ndarray, n_terms: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likely through the noisy-or of sentences.

    A sentence has its document ``doc``, ``sizes`` places of ``cols``, and stands there ``times`` times; ``labels`` and ``balance`` are those of the documents.
    Batch gradient steps with running means of the gradient and its square; no randomness.
    """
    row = np.repeat(np.arange(len(doc)), sizes)
    w, mean, square = np.zeros(n_terms + 1), np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    w[-1] = -2.0
    for step in range(1, STEPS + 1):
        z = np.clip(w[-1] + np.bincount(row, w[cols], len(doc)), -30, 30)
        silent = np.bincount(doc, times * np.logaddexp(0, z), len(labels))  # minus the log of the chance that no sentence is toxic
        slope = np.where(labels > 0, -np.exp(-silent) / np.maximum(-np.expm1(-silent), 1e-9), 1.0) * balance
        g = times * slope[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(cols, g[row], n_terms) + RIDGE * w[:-1], g.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, others: int = OTHERS) -> Model:
    """Learn from the labelled rows of ``docs`` whose id falls in the training folds.

    Rows with a null label or id aren't learned from; of repeated ids in ``labels`` the lower label counts. The sample has at most ``toxic`` rows of label 1
    and ``others`` of label 0, spread evenly by a hash of the id and written to the shared folder once; if the others were thinned, they weigh
    the more. Terms are counted on the executors. The driver gets at most ``CANDIDATES`` terms, and of each
    document at most ``SENTENCES`` sets of places, four bytes a place.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    in_all = dict(known.groupBy("label").count().collect())
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    most = {1: toxic, 0: others}
    chosen = known.where("label = 1").orderBy(*by_hash).limit(most[1]).unionByName(known.where("label = 0").orderBy(*by_hash).limit(most[0]))
    rows = bytes_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("data", F.expr("X''")).alias("data"))
    # a repeated id is one row of the sample, with the smallest of its texts
    rows = staged(rows.groupBy("doc_id", "label").agg(F.min("data").alias("data")))
    n = dict(rows.groupBy("label").count().collect())
    if not n.get(1) or not n.get(0):
        return Model([], np.zeros(0), 0.0)

    def counted(label: int, among: set[bytes] | None = None) -> DataFrame:
        only = None if among is None else spark.sparkContext.broadcast(among)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[bytes] = Counter()
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            for b in batches:
                for data in b.column(0).to_pylist():
                    seen.update(terms_in(data) if only is None else terms_in(data) & only.value)
                    if len(seen) > REMEMBERED:
                        yield flush()
                        seen.clear()
            yield flush()

        return rows.where(F.col("label") == label).select("data").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))

    a = {bytes(r.term): r.n for r in counted(1).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    b = {bytes(r.term): r.n for r in counted(0, set(a)).collect()}
    names = sorted(a)
    in_toxic, in_others = (np.array([x.get(t, 0) for t in names], np.float64) for x in (a, b))
    ratio = likelihood_ratio(in_toxic, in_others, n[1], n[0])
    good = np.flatnonzero((ratio >= LEAST_RATIO) & (in_toxic / n[1] > in_others / n[0]))
    names = [names[k] for k in good[np.argsort(-ratio[good], kind="stable")][:TERMS]]
    sent = spark.sparkContext.broadcast({t: k for k, t in enumerate(names)})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(sent.value)
        for b in batches:
            found = [Counter(t for *_, t in sentence_terms(x, places)) for x in b.column(1).to_pylist()]
            found = [sorted(c.items(), key=lambda x: hash(x[0]))[:SENTENCES] for c in found]  # numbers hash alike everywhere
            packed = [
                pa.array([np.fromiter(it, "<i4").tobytes() for it in column], pa.binary())
                for column in (
                    [[len(t) for t, _ in c] for c in found],
                    [[k for _, k in c] for c in found],
                    [[x for t, _ in c for x in t] for c in found],
                )
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int64()), *packed], ["label", "n", "sizes", "times", "places"])

    made = rows.select("label", "data").mapInArrow(sets, "label int, n long, sizes binary, times binary, places binary").where("n > 0")
    found = made.toArrow().sort_by([(c, "ascending") for c in ("label", "n", "places", "times", "sizes")])
    if not found.num_rows:
        return Model([], np.zeros(0), 0.0)
    told = found.column("label").to_numpy()
    sizes, times, cols = (np.frombuffer(b"".join(found.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("sizes", "times", "places"))
    thinned = (in_all[0] / n[0]) / (in_all[1] / n[1])
    doc = np.repeat(np.arange(len(told)), found.column("n").to_numpy())
    weights, bias = fit(doc, sizes, times.astype(np.float64), cols, told, np.where(told > 0, 1.0, thinned), len(names))
    return Model(names, weights, bias)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``, ``n_suspect``, ``worst`` for every row.

    ``n_suspect`` counts the sentences with a probability of ``TOXIC_FROM`` or more, ``worst`` is the likeliest sentence (the first of equal ones):
    its ``begin`` and ``end`` in bytes and its ``chance``; null where no sentence has a chosen term. A null or empty text scores 0, and so does every
    text if nothing was learned. A null id is not held out. Ids and rows may repeat. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, suspects, worst = [], [], []
            for data in b.column(1).to_pylist():
                found = sent.value.sentences(data or b"")
                scores.append(noisy_or([c for *_, c in found]))
                suspects.append(sum(c >= TOXIC_FROM for *_, c in found))
                top = max(found, key=lambda x: x[2], default=None)
                worst.append(top and dict(zip(("begin", "end", "chance"), top, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array(suspects, pa.int64()), pa.array(worst, kind)], ["doc_id", "score", "n_suspect", "worst"]
            )

    made = bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_suspect long, worst struct<begin: long, end: long, chance: double>")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_suspect", "worst")


def locate(docs: DataFrame, model: Model, least: float = TOXIC_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``begin``, ``end`` (in bytes), ``chance``, ``sentence``: one row for each sentence whose probability is ``least`` or more.

    Null and empty texts have none; repeated rows have theirs each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in enumerate(b.column(1).to_pylist()):
                found = [(x, y, c) for x, y, c in sent.value.sentences(data or b"") if c >= least]
                if found:
                    begin, end, chance = zip(*found, strict=True)
                    ids = pa.array([b.column(0)[at].as_py()] * len(found), pa.int64())
                    words = pa.array([data[x:y].decode() for x, y, _ in found], pa.string())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(begin), pa.array(end), pa.array(chance), words], ["doc_id", "begin", "end", "chance", "sentence"])

    return bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, begin long, end long, chance double, sentence string")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
