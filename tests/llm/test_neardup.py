"""Near-duplicate groups against all pairs of whole sets."""

import random
import re

import numpy as np

from bytequarry.llm import neardup as N


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """{id: (n_shingles of its rows, component)}"""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted(((str(i), len(s), i if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def group(spark, rows, schema="doc_id long, text string"):
    got = N.group_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got), key=str)


def _corpus(rng, groups=25):
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((3, 5, 6, 40, 120, 300)))]
        for _ in range(rng.choice((1, 2, 5, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                base = w  # chains
            rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = _corpus(random.Random(12))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE "), (5005, "a b c d"), (5006, "a b c d e"), (5007, "é É"), (None, rows[0][1]), (None, None)]
    assert group(spark, rows) == brute(rows)


def test_repeated_ids_join_their_sets(spark):
    rng = random.Random(13)
    a, b = (" ".join(f"{x}{rng.randrange(99)}" for _ in range(50)) for x in "ab")
    rows = [(9, a), (3, b), (7, a), (7, b), (7, a), (1, "else")]
    got = group(spark, rows)
    assert {r[0]: r[2] for r in got} == {"9": 3, "3": 3, "7": 3, "1": 1} and len(got) == 6


def test_members_that_only_meet_each_other(spark, monkeypatch):
    """A bucket's members may lie too far from its leader and near each other; blocks are small here."""
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "SALT", 3)
    rng = random.Random(14)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in range(rng.randrange(9)):
            w[(i * 7 + k * 23) % 200] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    assert group(spark, rows) == brute(rows)


def test_large_group_of_copies(spark):
    text = "the same words again and again until the end of it all"
    rows = [(k, text if k % 3 else text + f" number {k}") for k in range(3000)]
    got = group(spark, rows)
    assert sum(r[3] for r in got) == 1 + 1000 and {r[2] for r in got if int(r[0]) % 3} == {1}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = int(800 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 62, 400 - n).astype(np.uint64)])
        x, y = N.superminhash([a, b], 512)
        assert abs((x == y).mean() - n / (800 - n)) < 0.08
    one = N.superminhash([a[:3], a[:3], a[3:4]], 120)
    assert (one[0] == one[1]).all() and not (one[0] == one[2]).all() and np.isfinite(one).all()


def test_many_ranks():
    """More ranks than a byte counts; sets with fewer elements than ranks fill all positions."""
    a = np.random.default_rng(4).integers(0, 1 << 62, 40).astype(np.uint64)
    for m in (256, 257, 512, 1000):
        (one,) = N.superminhash([a], m)
        assert np.isfinite(one).all() and len(np.unique(one)) == m


def test_long_texts_are_cut_at_words(monkeypatch):
    text = " ".join(f"w{k % 50}é" for k in range(4000))
    whole = N.shingle_sets([text, None, "x y"])
    monkeypatch.setattr(N, "_BYTES", 100)
    again = N.shingle_sets([text, None, "x y"])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, again, strict=True))
    assert len(whole[0]) == len(shingles(text)) and not len(whole[1]) and len(whole[2]) == 1


def test_odd_frames(spark):
    assert group(spark, []) == []
    df = spark.createDataFrame([("b", "x y z", 1), ("a", "X Y Z", 2), ("a", "X Y Z", 2)], "doc_id string, text string, kept int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.group_near_duplicates(df).collect())
    assert got == [("a", "a", True), ("a", "a", True), ("b", "a", False)]
    assert [tuple(r) for r in N.keep_one(df).collect()] == [("a", "X Y Z", 2)]
    assert N.keep_one(df.limit(0)).count() == 0


def test_keep_one_with_clashing_columns_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(1, a, 0, 0, 0), (1, b, 0, 0, 0), (1, a + " more", 0, 0, 0), (2, b, 0, 0, 0), (None, a, 0, 0, 0), (None, "other words of it all", 0, 0, 0), (3, None, 0, 0, 0), (3, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, gone_ int, row_key int")
    got = N.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, b), (None, a), (None, "other words of it all"), (3, None), (3, None)], key=str)
    once = N.keep_one(df.filter("doc_id = 2 or text is null").limit(2))
    assert once.columns == df.columns and once.count() == 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r.doc: r.comp for r in N.components(edges).collect()}
    assert {got.get(k, k) for k in range(1, 201)} == {1} and got[500] == 400
