"""The numbered queries over the smallest tables, held against plain loops over the same rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from paceline.llm import decontaminate, entry, huffman, mixing, token_counts

TABLES = ("documents", "benchmark", "labels")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: (r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    out = entry.QUERIES[name](spark, sf).collect()
    return {r.doc_id: r for r in out}, len(out)


def sql(text, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = con.execute(text)
    return [c[0] for c in out.description], out.fetchall()


@pytest.mark.parametrize(("name", "text"), [("op1_benchmark_decontamination", decontaminate.OP1_SQL), ("op8_poisson_mix", mixing.OP8_SQL)])
def test_sql(spark, sf, name, text):
    columns, expected = sql(text, sf)
    got = entry.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    """The same rows whether the benchmark goes to the executors at once or in blocks; the same for the filter, for which columns may clash."""
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumn("hits", docs.n_chars).withColumn("items", docs.lang)
    whole = sorted(map(repr, decontaminate.report(decontaminate.contamination(docs, benchmark)).collect()))
    kept = sorted(map(repr, decontaminate.clean(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(repr, decontaminate.report(decontaminate.contamination(docs, benchmark)).collect())) == whole
    assert sorted(map(repr, decontaminate.clean(docs, benchmark).collect())) == kept
    dirty = {r.doc_id for r in decontaminate.report(decontaminate.contamination(docs, benchmark)).where("contaminated").collect()}
    assert dirty and len(kept) == docs.count() - docs.where(docs.doc_id.isin(dirty)).count()


def test_media_round_trip(spark, sf, documents):
    got, n = rows(spark, sf, "op2_media_columns")
    assert n == len(documents)
    for d, (text, _) in documents.items():
        data = text.encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])


def test_token_counts(spark, sf, documents):
    t = Tokenizer.from_file(str(public_tokenizers.path(token_counts.VOCABULARY)))
    t.no_truncation()
    t.no_padding()
    got, n = rows(spark, sf, "op3_token_counts")
    assert n == len(documents)
    for d, (text, _) in documents.items():
        expected = len(t.encode(text, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(text.encode()), expected, expected > 512)


def test_quality_held_out(spark, sf):
    got, _ = rows(spark, sf, "op4_quality_classifier")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    told = [(got[d].predicted, q) for d, q in labels.items() if d in got and got[d].held_out]
    assert told and np.mean([p == q for p, q in told]) >= 0.8


def test_token_output(spark, sf, documents):
    t = Tokenizer.from_file(str(public_tokenizers.path(huffman.VOCABULARY)))
    t.no_truncation()
    t.no_padding()
    got, n = rows(spark, sf, "op5_token_output")
    assert n == len(documents)
    start = 0
    for d in sorted(documents):
        ids = [*t.encode(documents[d][0], add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_held_out(spark, sf, documents):
    got, n = rows(spark, sf, "op6_language_id")
    assert n == len(documents)
    told = []
    for d, (text, lang) in documents.items():
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        if not re.search(r"[^\W\d_]", text):
            assert r.lang_pred == "und"
        elif r.held_out and lang is not None:
            told.append(r.lang_pred == lang)
    assert np.mean(told) >= 0.9


def component(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]


def simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, documents):
    got, n = rows(spark, sf, "op9_simhash_near_dedup")
    assert n == len(documents)
    ids = sorted(documents)
    fp = [simhash(documents[d][0]) for d in ids]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    for d, f, c in zip(ids, fp, component(len(ids), links), strict=True):
        assert (got[d].fingerprint, got[d].component_id) == (f"{f:016x}", ids[c])


def without_repeats(documents, length=100):
    seen, out = set(), {}
    for d in sorted(documents):
        data = documents[d][0].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeated_substrings(spark, sf, documents):
    got, n = rows(spark, sf, "op10_suffix_array_dedup")
    assert n == len(documents)
    for d, expected in without_repeats(documents).items():
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 2000, "merge_bytes": 1 << 20}, {"shard_bytes": 2000, "crowded": 1}])
def test_repeated_substrings_across_shards(spark, sizes):
    """Lines that many texts share, nested and overlapping, in shards of a few texts; NUL bytes among them."""
    from paceline.llm import suffix_dedup

    rng = np.random.default_rng(7)
    line = lambda n: "".join(chr(c) for c in rng.integers(0, 4, n))
    lines = [line(n) for n in (60, 99, 100, 130, 400, 3000)]
    texts = {}
    for d in range(900):
        parts = [lines[int(k)][int(a) : int(a) + 500] for k, a in zip(rng.integers(0, 6, 3), rng.integers(0, 120, 3), strict=True)]
        texts[d] = (line(int(rng.integers(0, 300))).join(parts), None)
    docs = spark.createDataFrame([(d, x) for d, (x, _) in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, **sizes).collect()}
    for d, (n, n_gone, n_spans, kept) in without_repeats(texts).items():
        r = got[d]
        assert (r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (n, n_gone, n_spans, kept), d


def test_near_passages_find_planted_ones(spark):
    from paceline.llm import passages

    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    text = lambda n: [word() for _ in range(n)]
    shared = text(90)
    edited = shared[:40] + ["changed"] + shared[41:]
    plain = {10 + k: text(150) for k in range(10)}
    rows_ = [(1, text(60) + shared + text(60)), (2, text(10) + shared + text(80)), (3, text(75) + edited), *plain.items()]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows_], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.near_passages(docs).collect()}
    assert {d: got[d].component_id for d in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert all(got[d].component_id == d and not got[d].n_passages for d in plain)
    lengths = defaultdict(int) | {d: r.n_words for d, r in got.items()}
    assert 85 <= lengths[2] <= 95
