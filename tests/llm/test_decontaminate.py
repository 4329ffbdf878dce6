"""Wu-Manber search against slices."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if text else []


def brute(text, items, window=13, one_in=20):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        m = min(window, len(b))
        if not m or item is None:
            continue
        for i in range(len(b) - m + 1):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and one_in * len(hit) >= len(w)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1`{@/é\x7f\u2003 \n", max_size=40))
def test_words(text):
    assert [w.decode() for w in D.words_of(text)] == words(text)


def _make(rng):
    vocabulary = ["a", "b", "c"] if rng.random() < 0.5 else [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice((0, 1, 2, 3, 12, 13, 14, 30)))) for k in range(6)]
    docs = []
    for _ in range(12):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            t += " " + rng.choice(items)[1].upper() + ", " + text(rng.randint(0, 400))
        docs.append(t)
    return docs, items


def test_against_slices(spark):
    rng = random.Random(8)
    for turn in range(4):
        docs, items = _make(rng)
        docs += [None, "", "...", "Ä" * 10]
        items += [(None, "w1 w2 w3"), (99, None), (98, ""), (1, items[1][1])]
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(d, b).collect()}
        want = {k: brute(t, items) for k, t in enumerate(docs)}
        assert got == want, turn
        kept = {r.doc_id for r in D.clean(d, b).collect()}
        passages = [(i, x) for i, x in items if len(words(x)) >= D.PASSAGE]
        assert kept == {k for k, v in want.items() if not v[4] and not brute(docs[k], passages)[1]}


def test_shards_give_the_same(spark, monkeypatch):
    docs, items = _make(random.Random(9))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, D.decontaminate(d, b).collect()))
    monkeypatch.setattr(D, "SHARD_WORDS", 15)
    assert sorted(map(str, D.decontaminate(d, b).collect())) == whole
    monkeypatch.setattr(D, "STRETCH", 300)
    monkeypatch.setattr(D, "ROWS", 2)
    assert sorted(map(str, D.decontaminate(d, b).collect())) == whole


def test_odd_frames(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    d = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, "w5", None)], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(500, 530)), "y")], "item_id long, text string, contaminated string")
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in D.decontaminate(d, b).collect())
    assert {r.doc_id for r in D.clean(d, b).collect()} == {None}
    assert rows == [("1", 100_000, 30, False), ("1", 100_000, 30, False), ("None", 1, 0, False)]
    assert D.clean(d, b).columns == ["doc_id", "text", "n_hit"]
    assert D.decontaminate(d, b.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert D.decontaminate(d.limit(0), b).count() == 0 and D.clean(d.limit(0), b).count() == 0
