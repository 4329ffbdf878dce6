"""License scan against every window and every template."""

import math
import random
import re

import pytest

from bytequarry.llm import license_scan as S


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def sh(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, texts=S.TEMPLATES):
    """Every window of every text against every template of its class."""
    temps = [(k, name, S.CLASSES[S.class_of(len(w))], set(sh(w))) for k, (name, w) in enumerate(S.passages(texts))]
    docs = {}
    for i, t in rows:
        docs.setdefault(i, []).append(sh(words(t)))
    out = set()
    for doc, many in docs.items():
        best = {}
        for k, name, (_, size, stride), t in temps:
            matched = {}
            for own in many:
                for win in range(0, len(own), stride):
                    part = own[win : win + size - 4]
                    share = len(set(part) & t) / len(t)
                    if share >= S.LEAST:
                        at = [win + i for i, x in enumerate(part) if x in t]
                        matched[win, tuple(part)] = (share, min(at), max(at))
            if matched:
                best[k] = [name, max(m[0] for m in matched.values()), len(matched), min(m[1] for m in matched.values()), max(m[2] for m in matched.values())]
        sets = {k: (name, t) for k, name, _, t in temps}
        rival = lambda a, b: sets[a][0] != sets[b][0] and 2 * len(sets[a][1] & sets[b][1]) >= min(len(sets[a][1]), len(sets[b][1]))  # noqa: B023, E731
        kept = {k: b for k, b in best.items() if not any(rival(k, o) and x[1] > b[1] for o, x in best.items())}
        for name in {b[0] for b in kept.values()}:
            own = [b for b in kept.values() if b[0] == name]
            out.add((str(doc), name, round(max(b[1] for b in own), 9), sum(b[2] for b in own), min(b[3] for b in own), max(b[4] for b in own) + 4))
    return sorted(out)


def scan(spark, rows, schema="doc_id long, text string"):
    return sorted((str(r.doc_id), r.license, round(r.containment, 9), r.n_windows, r.first_word, r.last_word) for r in S.scan(spark.createDataFrame(rows, schema)).collect())


def test_planted_notices(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "license", "the", "software"]) for _ in range(n))
    rows = []
    for k in range(60):
        text = filler(rng.randint(0, 90))
        for _ in range(rng.randrange(3)):
            w = rng.choice(S.TEMPLATES)[1].split()
            if rng.random() < 0.5 and len(w) > 30:
                w[rng.randrange(len(w))] = "changed"
            text += "\n" + " ".join(w).upper() + "\n" + filler(rng.randint(0, 300))
        rows.append((k, text))
    rows += [(900, None), (901, ""), (902, "MIT License"), (903, S.TEMPLATES[0][1]), (903, S.TEMPLATES[0][1]), (None, S.TEMPLATES[0][1])]
    got = scan(spark, rows)
    assert got == brute(rows) and len(got) > 30


def test_every_template_finds_itself(spark):
    got = scan(spark, [(k, f"before it {t} and after") for k, (_, t) in enumerate(S.TEMPLATES)])
    found = {(int(d), name) for d, name, share, *_ in got if share == 1}
    assert {(k, name) for k, (name, _) in enumerate(S.TEMPLATES)} <= found


def test_odd_frames(spark):
    assert scan(spark, []) == []
    long = "word " * 50_000 + S.TEMPLATES[0][1] + " word" * 50_000
    got = scan(spark, [(1, long, "x", 1)], "doc_id long, text string, license string, sh int")
    assert [(r[1], r[4], r[5]) for r in got] == [("MIT", 50_000, 50_004)]
    with pytest.raises(ValueError):
        S.passages([("x", "too short")])
    assert S.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), texts=()).count() == 0


def test_anchors_are_in_every_match():
    """Without all anchors of a template too few of its shingles are left, so a window without an anchor can't match."""
    rng = random.Random(7)
    temps = [w for _, w in S.passages(S.TEMPLATES)] + [[rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(5, 64))] for _ in range(300)]
    for w in temps:
        for least in (0.5, 0.8, 1.0):
            out, all_ = S.anchors(w, least), set(sh(w))
            assert out and sum(not out & set(s) for s in all_) < least * len(all_)


def test_bands_guarantee_the_worst_window():
    """The worst window that is accepted: as few of the template's shingles as suffice, and nothing else but others."""
    temps = S.passages(S.TEMPLATES)
    for k, n in enumerate(S.bands_of(temps)):
        for _, w in temps:
            if S.class_of(len(w)) == k:
                size = len(set(sh(w)))
                need = math.ceil(S.LEAST * size - 1e-9)
                similarity = need / (S.CLASSES[k][1] - 4 + size - need)
                assert (1 - similarity) ** n <= S.MISS


def test_short_notices_among_others(spark):
    """Texts packed with short notices, where a window holds many shingles that aren't the template's."""
    rng = random.Random(8)
    short = [t for _, t in S.TEMPLATES if len(words(t)) <= 16]
    rows = [(k, " ".join(rng.choice(short) if rng.random() < 0.7 else "of the software and its license" for _ in range(rng.randint(1, 12)))) for k in range(300)]
    got = scan(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_no_python_in_the_plan(spark, capsys):
    S.scan(spark.range(1).selectExpr("id AS doc_id", "'x' AS text")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
