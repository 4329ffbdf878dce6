"""Exact search against all inner products."""

import math

import numpy as np

from bytequarry.llm import topk


def brute(rows, k=20, scale=64, every=20):
    """Every row is a candidate, and a query if its id says so."""
    clean = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x * scale) for x in v):
            continue
        clean.append((i, tuple(math.floor(scale * x) for x in v)))
    out = []
    for n, (q, a) in enumerate(clean):
        if q % every == 0:
            fit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            best = sorted((-fit(sum(x * y for x, y in zip(a, b, strict=False))), i) for m, (i, b) in enumerate(clean) if m != n)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def search(spark, rows, schema="vec_id long, embedding array<double>", **kw):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in topk.search(df, **kw).collect())


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 70)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 6))
    rows = [(int(i), (base[i % 30] + 0.05 * rng.normal(size=6)).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(200)]  # one vector many times: ties by id
    rows += [(1000, None), (1020, []), (1040, [1.0, None]), (1060, [math.nan, 1.0]), (1080, [math.inf]), (None, [1.0] * 6)]
    assert search(spark, rows) == brute(rows)


def test_ties_and_lengths(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 100, 5)] + [(3, [2.0]), (4, [0.5, 0.5, 9.0]), (20, [1.0, 0.0])]
    assert search(spark, rows, k=7) == brute(rows, k=7)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [3e7, -3e7]), (20, [3e7, 1.0]), (7, [-3e6, 2.5])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [3.0, -1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (7, [0.5, 0.0])]
    for k in (2, 20):
        assert search(spark, rows, k=k) == brute(rows, k=k)


def test_any_magnitude(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 14)).tolist()) for i in range(300)] + [(400, [1e306, 1.0]), (420, [1e200, -1e200]), (421, [-1e200])]
    assert search(spark, rows, k=5) == brute(rows, k=5)


def test_blocks_are_pruned(spark, monkeypatch):
    """Far clusters: most pairs of blocks end before the second search, and nothing is lost."""
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 10)
    rng = np.random.default_rng(5)
    centers = 50 * rng.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in range(1200)]
    seen = {}
    plain = topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df, name: seen.setdefault(name, plain(df, name)))
    assert search(spark, rows) == brute(rows)
    assert seen["open-pairs"].count() < 0.5 * seen["query-blocks"].count() * seen["candidate-blocks"].count()


def test_extra_columns(spark):
    rows = [(0, [1.0], 5), (1, [2.0], 6), (2, [3.0], 7)]
    got = search(spark, rows, "vec_id long, embedding array<float>, score int")
    assert got == [(0, 1, 2, 64 * 192), (0, 2, 1, 64 * 128)]


def test_trees_cover_their_points():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(1500, 4)))
    seen = []

    def walk(node):
        gap = np.sqrt(((x[node.points] - x[node.center]) ** 2).sum(1))
        assert gap.max() <= node.radius + 1e-6
        if node.kids:
            assert sorted(np.concatenate([k.points for k in node.kids]).tolist()) == sorted(node.points.tolist())
            for k in node.kids:
                walk(k)
        else:
            seen.extend(node.points.tolist())

    walk(topk.cover_tree(x))
    assert sorted(seen) == list(range(1500))
