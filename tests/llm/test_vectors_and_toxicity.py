"""Toxicity, whitening and hard negatives against held-out labels, numpy and plain loops; their edge cases."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import negatives, toxicity, whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, v string"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    told = [(got[d].predicted, t) for d, t in labels.items() if d in got and got[d].held_out]
    assert np.mean([p == t for p, t in told]) >= 0.94  # 0.92 have label 0
    assert np.mean([t for p, t in told if p]) >= 0.9 and np.mean([p for p, t in told if t]) >= 0.7


@pytest.fixture(scope="module")
def taught(spark):
    """Texts of neutral sentences; a third of them has one sentence with one of two bad words."""
    rng = np.random.default_rng(3)
    neutral = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    sentence = lambda *more: " ".join([*rng.choice(neutral, 6), *more])
    texts = {}
    for d in range(600):
        parts = [sentence() for _ in range(int(rng.integers(1, 8)))]
        if d % 3 == 0:
            parts.insert(int(rng.integers(0, len(parts) + 1)), sentence(("Zorgelbad", "quimphorrid")[d // 3 % 2]))
        texts[d] = ". ".join(parts) + "."
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d in texts], "doc_id long, toxic int")
    return toxicity.train(docs, labels), texts, docs


def test_toxic_sentences_are_located(taught):
    model, texts, docs = taught
    found = toxicity.locate(docs, model).collect()
    assert {r.doc_id for r in found} == {d for d in texts if d % 3 == 0} and len(found) == 200
    for r in found:
        assert texts[r.doc_id].encode()[r.begin : r.end].decode() == r.sentence and ("Zorgelbad" in r.sentence or "quimphorrid" in r.sentence)


def test_toxicity_edges(spark, taught):
    model, *_ = taught
    long = "calm words here. " * 20_000
    rows = [(1, None), (2, ""), (3, "...\n!"), (4, long), (5, long + "a zorgelbad thing."), (5, long + "a zorgelbad thing."), (None, "ZORGELBAD")]
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, data string, score double")
    got = sorted(((r.doc_id or 0, r.score >= 0.7, r.n_suspect, r.held_out) for r in toxicity.score(docs, model).collect()))
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    assert got == [(0, True, 1, False), *((d, False, 0, out(d)) for d in (1, 2, 3, 4)), (5, True, 1, out(5)), (5, True, 1, out(5))]
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_noisy_or_is_trained_through_labels():
    """Two sentences of a toxic document, one of which also stands in clean ones: the other one gets the blame."""
    doc, sizes, times = np.array([0, 0, 1, 2]), np.ones(4, int), np.ones(4)
    w, bias = toxicity.fit(doc, sizes, times, np.array([0, 1, 1, 1]), np.array([1, 0, 0]), np.ones(3), 2)
    assert w[0] + bias > 1 and w[1] + bias < -1


def plain_whitening(x, components=32):
    n = len(x)
    near = x.min(axis=0)
    s = x.sum(axis=0)
    c = (x - near) - (s - n * near) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return c @ u / np.sqrt(e), e / np.trace(cov), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def test_whitening(spark, sf):
    got = whitening.op12_embedding_whitening(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(table.embedding).astype(float) * 64).astype(np.int64) + 1_000_000
    z, shares, deviation = plain_whitening(x)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(z)).max() < 1e-9
    assert len(got) == 32 * len(table) and set(got.n) == {len(table)} and set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-10
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-10)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[table.vec_id].tolist() == deviation


def test_jacobi_keeps_small_eigenvalues():
    """Graded matrices: eigenvalues over 20 orders of magnitude come out to 12 digits each; odd and even sizes, multiple eigenvalues, zeros."""
    for n in (1, 2, 7, 16):
        scale = np.logspace(0, -10, n)
        g = np.full((n, n), 0.1) + 0.9 * np.eye(n)
        e, v = whitening.jacobi(scale[:, None] * g * scale)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and (np.diff(e) <= 0).all()
        det = np.prod(scale**2) * (0.9 + 0.1 * n) * 0.9 ** (n - 1)
        assert np.isclose(np.log(e).sum(), np.log(det), rtol=1e-12)
    e, v = whitening.jacobi(np.diag([2.0, 5.0, 2.0, 0.0]))
    assert e.tolist() == [5.0, 2.0, 2.0, 0.0] and np.allclose(v.T @ v, np.eye(4))


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    good = [(d, [float(a) for a in rng.normal(size=3)] + [0.25], 1, 9, "x") for d in range(40)]
    bad = [(90, None, 1, 1, "y"), (91, [1.0, None, 2.0, 0.0], 1, 1, "y"), (92, [float("nan")] * 4, 1, 1, None), (93, [float("inf"), 0.0, 0.0, 0.0], 1, 1, None)]
    rows = [*good, good[0], (None, *good[1][1:]), *bad]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert len(got) == 42 * 4 and set(got.n) == {42} and got.vec_id.isna().sum() == 4 and (got.vec_id == 0).sum() == 8
    x = np.floor(np.array([r[1] for r in rows[:42]]) * 64).astype(np.int64) + 1_000_000
    z, _, deviation = plain_whitening(x[:, :3])
    assert np.allclose(np.abs(got[(got.vec_id == 7) & (got.component <= 3)].sort_values("component").whitened), np.abs(z[7]))
    # a constant dimension is a direction without variance: null, share 0
    assert got[got.component == 4].whitened.isna().all() and set(got[got.component == 4].explained) == {0.0} and got.identity_error[0] < 1e-10
    assert got[(got.vec_id == 7)].deviation.tolist() == [deviation[7]] * 4
    for few in ([], bad):
        assert whitening.whitened(spark.createDataFrame(few, VECTORS)).count() == 0
    one = whitening.whitened(spark.createDataFrame(good[:1], VECTORS)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in sorted(one, key=lambda r: r.component)] == [(k, 0, None, 0.0) for k in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(spark.createDataFrame([*good, (77, [1.0], 1, 1, "z")], VECTORS).coalesce(1)).count()


def plain_negatives(rows):
    """Rows ``(id, vector of whole numbers, label)``; a loop over anchors."""
    out = []
    for a, x, la in rows:
        if a % 50:
            continue
        score = sorted((-int(np.dot(x, y)), b, lb) for b, y, lb in rows if b != a)
        for p, positive, _ in [t for t in score if t[2] == la][:5]:
            fit = [(s, b) for s, b, lb in score if lb != la and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, k, b, -p, -s) for k, (s, b) in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, F.col("id") % 50 == 0, df.label).collect())


@pytest.mark.parametrize("block", [None, 60])
def test_hard_negatives(spark, sf, monkeypatch, block):
    if block:
        monkeypatch.setattr(negatives, "ANCHORS", 3)
        monkeypatch.setattr(negatives, "CANDIDATES", block)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    expected = con.sql(negatives.OP13_SQL)
    columns = expected.columns
    got = [tuple(r[c] for c in columns) for r in negatives.op13_hard_negatives(spark, sf).collect()]
    assert sorted(got) == sorted(expected.fetchall()) and got


def test_hard_negatives_of_clusters(spark, monkeypatch):
    """Where rows lie in clusters, bounds keep candidates from groups, and nothing is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    centres *= 9 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(d, [float(x) for x in centres[d % 12] + rng.normal(size=6) * 0.05], int(rng.integers(0, 3))) for d in range(1500)]
    sent, best = [], negatives.best

    def spy(anchors, others, by, run, schema):
        sent.append((others.count(), others.select("group").distinct().count()))
        return best(anchors, others, by, run, schema)

    monkeypatch.setattr(negatives, "best", spy)
    got = mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got == plain_negatives([(d, np.floor(np.array(v) * 256).astype(np.int64), k) for d, v, k in rows])
    assert all(groups > 1 and n < 0.9 * groups * len(rows) for n, groups in sent)


def test_hard_negatives_edges(spark):
    """Equal vectors (ties by id), repeated rows, zero and opposite vectors, nulls; a label of one row; clashing columns."""
    rng = np.random.default_rng(4)
    base = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(12)]
    rows = [(d, base[d % 12], int(rng.integers(0, 3)), d, "x") for d in range(260)] + [(300, [0.0] * 4, 0, 1, "x"), (350, [-1.0] * 4, 9, 1, None)]
    bad = [(None, base[0], 1, 1, "x"), (50, base[1], None, 1, "x"), (600, None, 1, 1, "x"), (650, [1.0, None, 1.0, 1.0], 1, 1, "x"), (700, [float("nan")] * 4, 1, 1, "x")]
    got = mined(spark.createDataFrame([*rows, *rows[:60], *bad], VECTORS))
    assert got == plain_negatives([(d, np.array(v, np.int64) * 256, k) for d, v, k, *_ in rows])
    for few in ([], bad, [(3, base[0], 1, 1, "x")], [(50, base[0], 1, 1, "x")]):
        assert mined(spark.createDataFrame(few, VECTORS)) == []
