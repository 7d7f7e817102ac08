"""Stretches of passages against all stretches of short flag sequences."""

import numpy as np

from paceline.llm.passages import Shingles, checked, near_passages, spread, verify


def test_spread_covers_every_stretch_that_balances():
    rng, rate = np.random.default_rng(0), 1.6 / 1.8
    for _ in range(200):
        flags = rng.random(int(rng.integers(1, 80))) < rng.choice([0.3, 0.8, 0.9, 0.95])
        sums = np.r_[0, np.cumsum(np.where(flags, 1 - rate, -rate))]
        n, got = len(flags), spread(flags, 0.8, 10)
        fit = {(a, b) for a in range(n) for b in range(a + 10, n + 1) if sums[b] >= sums[a] - 1e-9 and flags[a] and flags[b - 1]}
        assert set(got) <= fit
        assert all(any(c <= a and b <= d for c, d in got) for a, b in fit)


def test_a_changed_word_in_the_middle():
    shared = np.arange(1000, 1086)
    edited = shared.copy()
    edited[36:41] = range(5)
    found = verify(np.r_[np.arange(2000, 2100), shared], np.r_[edited, np.arange(3000, 3050)], 50, 0.8)
    assert found == [(100, 190, 0, 90)]


def texts_of(seed):
    rng = np.random.default_rng(seed)
    return lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def passages_of(spark, texts):
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    return {r.doc_id: r for r in near_passages(docs).collect()}


def test_passages_around_a_line_that_many_texts_have(spark):
    """Each text against all others by their runs of 50 words: the line alone is too short, a pair's own words around it are not."""
    text = texts_of(11)
    for others in (1, 40):  # few enough to be compared pair by pair, and too many
        line = text(40)
        texts = {d: text(60) + line + text(60) for d in range(others)}
        for k in range(24):
            shared = text(4 + k % 12) + line + text(16 - k % 12)
            texts |= {100 + 2 * k + i: text(50 + 20 * i) + shared + text(70) for i in (0, 1)}
        runs = {}
        for d, w in texts.items():
            for a in range(len(w) - 49):
                runs.setdefault(tuple(w[a : a + 50]), []).append((d, a))
        truth = {d: [] for d in texts}
        for places in runs.values():
            if len({d for d, _ in places}) > 1:
                for d, a in places:
                    truth[d].append(a)
        got = passages_of(spark, texts)
        assert {d for d in truth if truth[d]} == set(range(100, 148))
        lost = [d for d in truth if not all(any(s.begin <= a and a + 50 <= s.end for s in got[d].passages) for a in truth[d])]
        assert not lost
        assert all(got[d].component_id == d - d % 2 for d in range(100, 148))


def test_near_passages_around_a_line_that_many_texts_have(spark):
    """Pairs whose passages differ by a word, in the line or in their own words, among many texts that have the line alone, or with one more line."""
    text = texts_of(13)
    line, second = text(42), text(30)
    texts = {d: text(60) + line + (second if d % 2 else []) + text(60) for d in range(60)}
    for k in range(24):
        shared = text(14) + line + text(14)
        edited = shared.copy()
        edited[6 + 2 * k] = text(1)[0]
        texts |= {100 + 2 * k: text(50) + shared + text(70), 101 + 2 * k: text(70) + edited + text(70)}
    got = passages_of(spark, texts)
    assert {d: got[d].component_id for d in range(100, 148)} == {d: d - d % 2 for d in range(100, 148)}
    assert {got[d].component_id for d in range(0, 60, 2)} == set(range(0, 60, 2))
    assert {got[d].component_id for d in range(1, 60, 2)} == {1}  # both lines are a passage


def test_recall_against_all_pairs(spark):
    """Component by component against a comparison of every text with every other by runs of 46 shingles of which 41 or more are shared."""
    text, rng = texts_of(14), np.random.default_rng(15)
    lines = [text(n) for n in (8, 20, 30, 44)]
    texts = {}
    for d in range(120):
        if d % 3:
            parent = texts[int(rng.integers(max(0, d - 40), d))]
            a = int(rng.integers(0, max(1, len(parent) - 70)))
            own = parent[a : a + int(rng.integers(52, 110))]
            for at in rng.integers(0, len(own), rng.integers(0, 3)):
                own[at] = text(1)[0]
        else:
            own = text(80)
        texts[d] = text(int(rng.integers(5, 50))) + own + lines[int(rng.integers(4))] + text(int(rng.integers(0, 60)))
    sets = {d: [frozenset(tuple(w[i : i + 5]) for i in range(a, a + 46)) for a in range(len(w) - 49)] for d, w in texts.items()}
    runs = [(d, s) for d in sets for s in sets[d]]
    number = {}
    matrix = np.zeros((len(runs), len({x for _, s in runs for x in s})), np.float32)
    for k, (_, s) in enumerate(runs):
        matrix[k, [number.setdefault(x, len(number)) for x in s]] = 1
    owner = np.array([d for d, _ in runs])
    links = set()
    for k in range(0, len(runs), 2048):
        x, y = np.nonzero(matrix[k : k + 2048] @ matrix.T >= 41)
        links |= {(int(a), int(b)) for a, b in zip(owner[x + k], owner[y], strict=True) if a < b}
    got = passages_of(spark, texts)
    together = [got[a].component_id == got[b].component_id for a, b in links]
    assert len(links) > 60 and np.mean(together) >= 0.98
    touched = {d for pair in links for d in pair}
    assert np.mean([got[d].n_passages > 0 for d in touched]) >= 0.98
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in texts.items()}
    for d, r in got.items():  # nothing is reported that other texts don't have most of
        others = set().union(*(shingles[e] for e in texts if e != d))
        for s in r.passages:
            own = {tuple(texts[d][i : i + 5]) for i in range(s.begin, s.end - 4)}
            assert s.end - s.begin >= 50 and len(own & others) >= 0.8 * len(own)


def test_every_occurrence_within_a_text(spark):
    text = texts_of(12)
    shared = text(70)
    often = [w for _ in range(10) for w in text(30) + shared]
    got = passages_of(spark, {1: often, 2: text(20) + shared + text(20), 3: text(200)})
    for k in range(10):
        assert any(s.begin <= 100 * k + 30 and 100 * k + 100 <= s.end for s in got[1].passages), k
    assert got[2].component_id == 1 and got[3].n_passages == 0


def test_recall_where_common_lines_are_combined_freely(spark):
    """Texts of lines out of one pool, and pairs that hold the same two lines side by side, one of them with a word changed: every pair is linked."""
    text = texts_of(16)
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        pool = [text(25) for _ in range(12)]
        texts = {d: sum((pool[k] for k in rng.permutation(12)[:8]), []) for d in range(300)}
        for k in range(30):
            a, b = rng.permutation(12)[:2]
            both = pool[a] + pool[b]
            edited = both.copy()
            edited[int(rng.integers(5, 45))] = text(1)[0]
            texts |= {1000 + 2 * k: text(30) + both + text(30), 1001 + 2 * k: text(40) + edited + text(20)}
        got = passages_of(spark, texts)
        assert all(got[1000 + 2 * k].component_id == got[1001 + 2 * k].component_id for k in range(30))
        for k in range(30):
            for d, begin in ((1000 + 2 * k, 30), (1001 + 2 * k, 40)):
                assert any(s.begin <= begin and begin + 50 <= s.end for s in got[d].passages), d


def test_pairs_compared_together_are_those_compared_one_by_one(monkeypatch):
    """A batch of pairs, of which only those that may have a passage are compared in full."""
    text, rng, hasher, calls = texts_of(17), np.random.default_rng(18), Shingles(), []
    rows = []
    for k in range(200):
        own, other = text(120), text(120)
        if k % 4 == 0:
            other[30:110] = own[20:100]
            for at in rng.integers(30, 110, k % 3):
                other[at] = text(1)[0]
        if k % 4 == 1:
            other[:45] = own[:45]
        rows.append((k, 1000 + k, 7, 3, " ".join(own).encode(), hasher.joined(" ".join(other).encode())))
    truth = [(d, e, a + 7, b + 7, x + 3, y + 3) for d, e, _, _, part, there in rows for a, b, x, y in verify(hasher.joined(part), there, 50, 0.8)]
    monkeypatch.setattr("paceline.llm.passages.verify", lambda *a: calls.append(1) or verify(*a))
    assert checked(rows, hasher, 50, 0.8) == truth
    assert len({r[0] for r in truth}) >= 40 and len(calls) < 110
