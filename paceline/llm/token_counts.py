"""Token counts with a shortcut for pre-tokens that are proven to be one token.

Offline, every string of the vocabulary is encoded by itself; those that come back as their own
single id make up the proven set. A pre-token in that set counts one without any merge. The merges
run for the others only, once for each that a worker hasn't seen lately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import vocab
from paceline.llm.common import bytes_of, small_batches

VOCABULARY = "byte_bpe_50k.json"
#: A vocabulary beyond this isn't sent to the executors as a proven set.
LARGEST_VOCABULARY = 1 << 20


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that encode alone as one token."""
    t = vocab.tokenizer(path)
    n = t.get_vocab_size(with_added_tokens=False)
    if n > LARGEST_VOCABULARY:
        raise ValueError(f"{path}: {n} strings; at most {LARGEST_VOCABULARY} are taken")
    strings = t.decode_batch([[i] for i in range(n)], skip_special_tokens=False)
    found = t.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for i, (s, e) in enumerate(zip(strings, found, strict=True)) if e.ids == [i])


class Counter:
    """Counts tokens of texts; ``seen`` holds the proven set and what was merged lately."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.path, self.whole, self.seen = path, whole, vocab.memory(path, "counts")
        if not self.seen:
            self.seen.update(dict.fromkeys(whole, 1))

    def stretch(self, text: str) -> int:
        if vocab.OUTSIDE.search(text):
            split = vocab.tokenizer(self.path).pre_tokenizer.pre_tokenize_str(text)
            found = [text[a:b] for _, (a, b) in split]
        else:
            found = vocab.BYTE_RULE.findall(text)
        counts = list(map(self.seen.get, found))
        if None in counts:
            if len(self.seen) > len(self.whole) + vocab.REMEMBERED:
                self.seen.clear()
                self.seen.update(dict.fromkeys(self.whole, 1))
            new = {x: len(vocab.merged(self.path, x)) for x in {x for x, n in zip(found, counts, strict=True) if n is None}}
            self.seen.update(new)
            return sum(new[x] if n is None else n for x, n in zip(found, counts, strict=True))
        return sum(counts)

    def count(self, text: str) -> int:
        return sum(1 if k % 2 else self.stretch(x) for k, x in enumerate(vocab.pieces(self.path, text)) if x)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``).

    Special strings in a text count one, as the library has it by default; nothing is added at
    either end. A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row
    is counted by itself. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    proven = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, proven.value)
        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            n = [counter.count(x.decode()) for x in data]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
