import hashlib
import random
import zlib

import numpy as np
import pytest

from emberlattice.llm import runs as R

SPACES = " \t\n\x0b\f\r"


def brute_runs(words, least=24, repeats=3):
    """Every maximal stretch of every period, by comparing all words; the smallest period of a stretch counts."""
    n, best = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in "".join("\0" if c in SPACES else c for c in text or "").split("\0") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *sha)


def mixture(rng, n, alphabet):
    out = []
    while len(out) < n:
        unit = [rng.randrange(1, alphabet + 1) for _ in range(rng.randrange(1, 60))]
        out += (unit * rng.randrange(1, 12))[:rng.randrange(1, 300)]
    return out[:n]


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for size in (2, 16, 256):
        x, y = (rng.integers(0, R.PRIME, (3, size), dtype=np.uint64) for _ in range(2))
        tf = R.Transform(size)
        assert (tf.inverse(tf.forward(x)) == x).all()
        got = tf.inverse(tf.forward(x)[:, tf.negative] * tf.forward(y) % np.uint64(R.PRIME))
        for row in range(3):
            for d in {0, 1, size // 2, size - 1}:
                assert int(got[row, d]) == sum(int(x[row, i]) * int(y[row, (i + d) % size]) for i in range(size)) % R.PRIME


@pytest.mark.parametrize("least,repeats", [(24, 3), (3, 3), (50, 4)])
def test_runs_like_brute_force(least, repeats):
    rng = random.Random(11)
    texts = [mixture(rng, rng.randrange(0, 700), a) for a in (1, 2, 2, 3, 5, 50, 50, 400) for _ in range(12)]
    texts += [[1] * k for k in (1, 2, 3, 23, 24, 25, 300)] + [[1, 2] * 12, [1, 2] * 11 + [1], [*range(1, 9)] * 3, [*range(1, 10)] * 3 + [1], []]
    texts += [[1, 1, 2] * 40 + [1, 1, 3] * 40, ([1] * 30 + [2]) * 5, [7] * 24 + [8] * 24]
    got = R.runs_in([np.array(t, dtype=np.int64) for t in texts], least, repeats)
    assert got == [brute_runs(t, least, repeats) for t in texts]


def test_every_period_and_alignment():
    rng = random.Random(5)
    texts = []
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129]:
        for lead in (0, 1, 7, 16):
            unit = [rng.randrange(1, 10**6) for _ in range(q)]
            size = max(24, 3 * q)
            texts.append([10**7 + i for i in range(lead)] + (unit * (size // q + 1))[:size] + [2 * 10**7])
    got = R.runs_in([np.array(t, dtype=np.int64) for t in texts])
    assert got == [brute_runs(t) for t in texts] and all(len(g) == 1 for g in got)


def test_false_zeros_and_lying_fingerprints_do_not_matter(monkeypatch):
    codes = np.array([1, 2, 3, 4] * 10, dtype=np.int64)
    at, distance = np.arange(0, 30), np.full(30, 4)
    rows = R.extended(codes, np.concatenate([at, at]), np.concatenate([distance, np.full(30, 3)]), 4, 24, 3)
    assert rows.tolist() == [[0, 40, 4]]
    right = R.Extender.right
    calls = []

    def lies(self, at, distance):
        calls.append(1)
        return right(self, at, distance) - (0 if len(calls) > 1 else -1)

    monkeypatch.setattr(R.Extender, "right", lies)
    assert R.extended(np.concatenate([codes, [9, 9]]), at, distance, 4, 24, 3).tolist() == [[0, 40, 4]] and len(calls) == 2


def test_long_texts_end_soon():
    rng = random.Random(2)
    unit = [rng.randrange(1, 10**6) for _ in range(70_000)]
    got = R.runs_in([np.ones(300_000, dtype=np.int64), np.array(unit * 3, dtype=np.int64)])
    assert got == [[(0, 300_000, 1)], [(0, 210_000, 70_000)]]


def test_query_like_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, mixture(rng, rng.randrange(0, 260), rng.choice([2, 9, 200]))))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "a b " * 30), (904, "é   " * 40), (None, "x y " * 20), (None, None),
             (3, rows[3][1]), (3, rows[3][1]), (905, "w " * 20_000), (906, "q" * 100_000)]
    for i in range(1000, 1200):  # rows with a planted period
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(i % 90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS n", "'x' AS best", "3 AS h")
    got = R.op12_periodic_runs(docs.repartition(5))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert R.op12_periodic_runs(docs.limit(0)).collect() == []


def test_documents_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    ids = {w[0] for w in want}
    got = [tuple(r) for r in R.op12_periodic_runs(docs).collect() if r.doc_id in ids]
    assert sorted(got) == sorted(want) and any(w[1] for w in want)
