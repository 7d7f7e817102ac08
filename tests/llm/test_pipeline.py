"""Each stage of the pipeline against a plain loop over its own input."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paceline.llm import entry, huffman, mixing, quality
from paceline.llm.common import staged
from tests.llm.test_contracts import component, simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input of every stage and the output of the last, as lists of rows."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = staged(stage(spark, docs, sf))
    return [*out, docs]


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_quality_stage(spark, sf, stages):
    """Cosines and votes in double precision, document by document."""
    model = quality.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    keep, close = set(), set()
    for r in stages[0].collect():
        v = model.latent([(r.text or "").encode()])[0].astype(np.float64)
        cosine = model.vectors.astype(np.float64) @ v
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        votes = [(max(cosine[k], 1e-6) ** 8, model.labels[k]) for k in near]
        score = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        (close if abs(score - 0.5) < 0.02 else keep if score >= 0.5 else set()).add(r.doc_id)
    got = set(ids(stages[1]))
    assert got - close == keep and 0 < len(got) < len(ids(stages[0]))


def test_near_duplicates_stage(stages):
    rows = sorted(((r.doc_id, r.text or "") for r in stages[1].collect()))
    fp = [simhash(text) for _, text in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    root = component(len(rows), links)
    assert ids(stages[2]) == Counter(rows[k][0] for k in set(root))


def test_decontamination_stage(spark, sf, stages):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w and r.item_id is not None else set()
    sizes, keep = {len(w) for w in windows}, []
    for r in stages[2].collect():
        w, hit = words(r.text), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            keep.append(r.doc_id)
    assert ids(stages[3]) == Counter(keep)


def test_mixing_stage(stages):
    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    assert ids(stages[4]) == Counter(x for (x,) in con.execute(f"SELECT doc_id FROM ({mixing.OP8_SQL})").fetchall())


def test_token_output_stage(stages):
    t = Tokenizer.from_file(str(public_tokenizers.path(huffman.VOCABULARY)))
    t.no_truncation()
    t.no_padding()
    start, expected = 0, []
    for r in sorted(stages[4].collect(), key=lambda r: r.doc_id):
        of = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(of), zlib.crc32(np.array(of, "<u4").tobytes())))
        start += len(of)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect())
    assert got == sorted(expected)


def test_run_gives_the_last_stage(spark, sf, stages):
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = lambda df: Counter(map(tuple, df.select(*columns).collect()))
    assert rows(entry.QUERIES["pipeline"](spark, sf)) == rows(stages[5])
