"""Language identification with error-correcting output codes.

Every language has a code word of +1 and -1. For each bit a linear classifier over letter trigrams
tells the languages with +1 from those with -1; its weights are log-likelihood ratios of hashed
trigrams, learned from a sample of each language. A text is decoded to the language whose code word has
the least logistic loss under all margins; a runner-up that comes close makes the answer ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, small_batches

#: Places that trigrams are hashed to, as a power of two.
PLACES_BITS = 13
#: Rows learned from per language, about: rows whose hash falls below this share of the language.
SAMPLE = 5000
#: Most languages that are learned; their counts come to the driver.
MOST_LANGUAGES = 1000
#: Steepness of the loss in the mean log-likelihood ratio of a trigram.
STEEP = 8.0
#: A runner-up with at least this share of the winner's weight makes the answer ambiguous.
CLOSE = 0.5
#: Texts counted at once, and bytes.
BLOCK, BLOCK_BYTES = 64, 1 << 20
LETTER = re.compile(r"[^\W\d_]")

FOLD = np.full(256, 32, np.uint32)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed trigrams of letters and word ends, one row per text."""
    out = np.zeros((len(texts), 1 << PLACES_BITS), np.float32)
    for k, data in enumerate(texts):
        for at in range(0, len(data), BLOCK_BYTES):
            s = FOLD[np.frombuffer(b" " + data[at : at + BLOCK_BYTES + 2] + b" ", np.uint8)]
            s = s[np.r_[True, (s[1:] != 32) | (s[:-1] != 32)]]
            g = (s[:-2] | s[1:-1] << np.uint32(8) | s[2:] << np.uint32(16)) * np.uint32(2654435761)
            out[k] += np.bincount(g >> np.uint32(32 - PLACES_BITS), minlength=1 << PLACES_BITS)
    return out


def code_words(k: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each of ``k`` languages.

    Up to six languages get every two-sided split; more get random splits, the best of 50 draws by
    smallest distance between two rows.
    """
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        splits = [set(c) for n in range(1, k) for c in combinations(range(k), n) if 0 in c]
        return np.array([[1.0 if i in s else -1.0 for s in splits] for i in range(k)])
    rng, bits, best, most = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(k))) + 8, None, -1.0
    for _ in range(50):
        m = np.where(rng.permuted(np.tile(np.arange(k)[:, None], (1, bits)), axis=0) < k // 2, 1.0, -1.0)
        apart = (bits - m @ m.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > most:
            best, most = m, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """Language, share of its weight among all, whether the runner-up is close."""
        names, sure, close = [], [], []
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        counts = trigram_counts(texts)
        margins = STEEP * (counts @ self.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        loss = np.stack([np.logaddexp(0, -margins * word).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        for data, s in zip(texts, share, strict=True):
            if not LETTER.search(data.decode()):
                names.append("und"), sure.append(0.0), close.append(True)
                continue
            order = np.argsort(-s, kind="stable")
            names.append(self.languages[order[0]])
            sure.append(float(s[order[0]]))
            close.append(len(s) > 1 and bool(s[order[1]] >= CLOSE * s[order[0]]))
        return names, sure, close


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with text, language and id outside the held-out fold.

    Each language gives about ``sample`` rows, picked by a hash of the id, so the work and what
    comes to the driver (one count per language and trigram place) don't grow with the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").cast("binary").alias("data")
    ).where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    found = rows.where("data IS NOT NULL").groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((1 << PLACES_BITS, 1), np.float32))
    share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], min(1.0, sample / r["count"]))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where("data IS NOT NULL").where(drawn < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(data), BLOCK):
                for name, row in zip(names[k : k + BLOCK], trigram_counts(data[k : k + BLOCK]), strict=True):
                    total[name] = total[name] + row if name in total else row.astype(np.float64)
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "place", "n"])

    sums = picked.select("lang", "data").mapInArrow(run, "lang string, place long, n double").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), 1 << PLACES_BITS))
    index = {x: k for k, x in enumerate(languages)}
    for r in sums.toLocalIterator():
        counts[index[r["lang"]], r["place"]] = r["n"]
    code = code_words(len(languages))
    p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((1 << PLACES_BITS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        if len(languages) > 1:
            weights[:, bit] = np.log(p[code[:, bit] > 0].mean(axis=0) / p[code[:, bit] < 0].mean(axis=0))
    return Model(languages, code, weights)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` for every row.

    A text that is null or has no letter gets ``und`` with score 0. A null id is not held out. With
    no language learned all get ``und``. Ids may repeat. An empty table gives an empty result; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = [x or b"" for x in b.column(1).to_pylist()], b.column(0)
            for k in range(0, len(texts), BLOCK):
                lang, sure, close = sent.value.predict(texts[k : k + BLOCK])
                yield pa.RecordBatch.from_arrays([ids.slice(k, BLOCK), pa.array(lang), pa.array(sure), pa.array(close)], names)

    found = bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
