"""Searches of small corpora against plain re-statements of their rules."""

import random
import re

import pytest

from bytequarry.operators import proximity, search
from bytequarry.plans import rewrites as R
from bytequarry.plans.planner import Engine, by_index
from bytequarry.plans.syntax import QueryTypeError, parse

#: The short documents and the templates of expressions that searches are tested with.
FIXED = ["a", "aa", "aab", "aac", "bb", "test", "fun", "\0\0", "\0\1\0", "bannana", "seeresses", "equal", "un", "undo", "bbababcc"]
TEMPLATES = ["A.", "B.D", "AB.DE", "A+B", "(ABC)+D", "A?B", "AB?C", "AB*C", "A{2}D", "A{2,}D", "A{2,3}E", "[AB]", "[^AB]", "[A-B]", "[^A-B]", "AB|CD", "(AB|CD)+E", "AB(CD|EF)CD", "AB(CD|EF)+CD"]


def engine(spark, contents):
    rows = [(k, f"dir/{k}", bytearray(c if isinstance(c, bytes) else c.encode("latin-1"))) for k, c in enumerate(contents)]
    return Engine(spark.createDataFrame(rows, "doc long, info string, content binary"))


def pairs(df):
    return sorted((r.doc, r.offset) for r in df.collect())


def docs(df):
    return sorted(r.doc for r in df.collect())


def by_rule(data: bytes, lazy: bytes) -> list[int]:
    """Lazy match from every start; of starts in a row with one end the last."""
    out = []
    r = re.compile(lazy, re.S)
    for j in range(len(data) + 1):
        if m := r.match(data, j):
            if out and out[-1][1] == m.end():
                out.pop()
            out.append((j, m.end()))
    return [s for s, _ in out]


def test_proximity(spark):
    left = [(1, 5), (1, 12), (2, 4), (2, 14), (3, 1), (4, 4)]
    right = [(0, 0), (1, 2), (1, 6), (1, 10), (2, 1), (2, 6), (2, 10), (4, 5)]
    third = [(0, 0), (1, 2), (1, 6), (1, 10), (2, 1), (2, 3), (2, 10), (4, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "doc long, offset long")
    assert pairs(proximity.then(frame(left), frame(right), 2)) == [(1, 5), (2, 4), (4, 4)]
    assert pairs(proximity.then(frame(left), frame(third), -2)) == [(1, 10), (2, 3)]
    assert pairs(proximity.within(frame(left), frame(right), 3)) == [(1, 2), (1, 5), (1, 10), (2, 1), (2, 4), (4, 4)]
    for x, y in ((left, []), ([], right), ([], [])):
        assert pairs(proximity.then(frame(x), frame(y), 2)) == [] and pairs(proximity.within(frame(x), frame(y), 2)) == []


def test_proximity_against_two_pointers(spark):
    rng = random.Random(3)
    left = sorted({(rng.randrange(9), rng.randrange(60)) for _ in range(120)})
    right = sorted({(rng.randrange(9), rng.randrange(60)) for _ in range(120)})
    frame = lambda rows: spark.createDataFrame(rows, "doc long, offset long")
    of = lambda rows, d: [o for x, o in rows if x == d]
    for n in (1, 4, 20):
        then = [(d, x) for d in range(9) for x in of(left, d) if (y := min((o for o in of(right, d) if o >= x), default=None)) is not None and 0 < y - x <= n]
        within = {(d, x) for d in range(9) for x in of(left, d) if any(0 <= y - x <= n for y in of(right, d))} | {(d, y) for d in range(9) for y in of(right, d) if any(0 < x - y <= n for x in of(left, d))}
        assert pairs(proximity.then(frame(left), frame(right), n)) == sorted(then)
        assert pairs(proximity.within(frame(left), frame(right), n)) == sorted(within)


def test_booleans(spark):
    e = engine(spark, ["this is test one", "test document two", "test, this is a document named number three"])
    for q, want in (("one", [0]), ("test AND one", [0]), ("is AND document", [2]), ("(test AND document) AND named", [2]), ("one OR two", [0, 1]), ("test NOT one", [1, 2]), ("zzz", []), ("zzz OR one", [0]), ("one NOT zzz", [0]), ("zzz NOT one", []), ("zzz AND one", []), ("(is' 'test THEN one) AND test", [0]), ("(test WITHIN 6 doc) OR one", [0, 1])):
        assert docs(e.find_docs(q)) == want, q
    with pytest.raises(QueryTypeError):
        e.find_docs("(a AND b) WITHIN 3 c")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    out = [s.encode("latin-1") for s in FIXED] + [bytes(range(256)), b""]
    for k in range(20):
        letters = (range(256), range(40, 126), range(97, 123))[k % 3]
        out.append(bytes(rng.choice(letters) for _ in range(rng.randint(1, 300))))
    return out


def test_strings_of_all_kinds(spark, corpus):
    e = engine(spark, corpus)
    rng = random.Random(8)
    some = [rng.choice([c for c in corpus if c]) for _ in range(6)]
    for s in [*(c[:3] for c in some), *(c[1:4] for c in some if len(c) > 4), b"\t", b"\n", b"aa", bytes([255, 0])]:
        want = sorted((d, i) for d, c in enumerate(corpus) for i in range(len(c)) if c.startswith(s, i))
        q = "{x " + " ".join(f"{b:02x}" for b in s) + "}"
        assert pairs(e.find_places(q)) == want
        assert docs(e.find_docs(q)) == sorted({d for d, _ in want})
        assert e.count(q).first().n == len(want)


def test_expressions_by_the_index_rule(spark, corpus):
    e = engine(spark, corpus)
    for n, template in enumerate(TEMPLATES):
        d = corpus[17 + n % 20]
        letters = {c: d[i % len(d)] for i, c in enumerate("ABCDEFG")}
        if "-" in template and letters["A"] > letters["B"]:
            letters["A"], letters["B"] = letters["B"], letters["A"]
        query = "".join(f"\\x{letters[c]:02x}" if c in letters else c for c in template)
        lazy = re.sub(rb"([+*?]|\{[0-9,]+\})", rb"\1?", query.encode())
        trimmed = R.prepare(parse(query))
        got = pairs(e.find_places(query))
        if trimmed == parse(query):
            assert got == sorted((k, s) for k, c in enumerate(corpus) for s in by_rule(c, lazy)), template
        held = sorted(k for k, c in enumerate(corpus) if re.search(lazy, c, re.S))
        assert docs(e.find_docs(query)) == held and sorted({k for k, _ in got}) == held
        starts = sum(1 for c in corpus for j in range(len(c) + 1) if re.compile(lazy, re.S).match(c, j))
        assert e.count(query, scan=True).first().n == starts


def test_edges_that_may_be_missing(spark):
    e = engine(spark, ["abab aab"])
    assert pairs(e.find_places("a+b")) == [(0, 0), (0, 2), (0, 6)] and pairs(e.find_places("a+b", scan=True)) == [(0, 0), (0, 2), (0, 5), (0, 6)]
    assert [(bytes(r.match), r.n) for r in e.matches("a+b", scan=True).collect()] == [(b"aab", 1), (b"ab", 3)]


def test_the_end_of_a_document(spark):
    e = engine(spark, ["ab", "abc", "xab"])
    assert pairs(e.find_places("ab\\x-03")) == [(0, 0), (2, 1)] and docs(e.find_docs("ab\\x-03")) == [0, 2]


def _cost(s, t, k):
    """Least cost to turn a pattern into a string: substitutions, letters that are missing, letters too many."""
    row = [j * k.insert for j in range(len(t) + 1)]
    for i, a in enumerate(s, 1):
        new = [i * k.delete]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b) * k.substitute, row[j] + k.delete, new[j - 1] + k.insert))
        row = new
    return row[-1]


def test_errors_are_found_and_priced(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(60)) + "licence" + rng.choice(["d", "s", ""]) + "".join(rng.choice("abcd") for _ in range(20)) for _ in range(12)] + ["licnese", "lcense", "license"]
    e = engine(spark, texts)
    for q in ("APPROX license", "APPROX 2 license", "APPROX 2:1:1:2 license"):
        leaf = parse(q)
        rows = search.places(e.corpus, leaf).collect()
        assert rows
        for r in rows:
            found = texts[r.doc][r.offset : r.offset + r.length]
            assert found[-1] == "e" or leaf.approx.delete <= leaf.approx.most
            assert _cost("license", found, leaf.approx) <= r.cost <= leaf.approx.most, (q, found)
        could = {k for k, t in enumerate(texts) if any(t[j - 1] == "e" and _cost("license", t[i:j], leaf.approx) <= leaf.approx.most for i in range(len(t)) for j in range(i + 5, min(len(t), i + 9) + 1))}
        assert could <= {r.doc for r in rows}
        assert docs(e.find_docs(q)) == sorted({r.doc for r in rows})


def test_case_filters_and_limits(spark):
    e = engine(spark, ["Test", "tEST", "rest", "\xc4test"])
    assert docs(e.find_docs("test", icase=True)) == [0, 1, 3] and docs(e.find_docs("[r-t]e", icase=True)) == [0, 1, 2, 3]
    assert docs(e.find_docs("est", only="/[23]$")) == [2, 3] and docs(e.find_docs("est OR EST", limit=2)) == [0, 1]
    assert docs(e.request("find_docs 10 0 est")) == [0, 2, 3] and pairs(e.request("find_docs 10 1 est")) == [(0, 1), (2, 1), (3, 2)]
    assert [bytes(r.match) for r in e.request("find_strings [Tr]est").collect()] == [b"Test", b"rest"]
    assert e.request("string_rows 101 115").first().n == 3
    with pytest.raises(ValueError):
        e.request("nothing")


def test_views(spark):
    e = engine(spark, ["one line\nthe hit is here\nlast", "hit", "no", "x" * 2000 + "hit"])
    assert [(r.doc, r.line and bytes(r.line)) for r in sorted(e.grep("hit").collect())] == [(0, b"the hit is here"), (1, b"hit"), (3, None)]
    assert [(bytes(r.line), r.infos) for r in sorted(e.multigrep("hit").collect(), key=str)] == [(b"hit", ["dir/1"]), (b"the hit is here", ["dir/0"])]
    assert sorted((r.doc, bytes(r.context)) for r in e.context("hit", 2, 3).collect()) == [(0, b"e hit is"), (1, b"hit"), (3, b"xxhit")]
    assert sorted((r.side, r.byte if r.byte is not None else -1, r.n) for r in e.neighbours("hit").collect()) == [("left", -1, 1), ("left", 32, 1), ("left", 120, 1), ("right", -1, 2), ("right", 32, 1)]
    assert docs(e.extract(info="[12]$")) == [1, 2] and docs(e.extract(docs=[0])) == [0] and docs(e.extract(names=["dir/3"], docs=[1])) == [1, 3] and docs(e.extract()) == [0, 1, 2, 3]
    assert {r.doc: r.bytes for r in e.sizes().collect()} == {0: 29, 1: 3, 2: 2, 3: 2003}
    assert {r.pattern: r.n for r in e.counts(["hit", "x", "(h|n)."]).collect()} == {"hit": 3, "x": 2000, "(h|n).": len(re.findall("(?=[hn].)", "one line\nthe hit is here\nlast", re.S)) + 1 + 1 + 1}


def test_suggestions(spark):
    e = engine(spark, ["abcd", "abce", "abcf", "xbcd"])
    got = {bytes(r.suggestion): r.n for r in e.suggest("abcd").collect()}
    assert got[b"abc"] == 3 and got.get(b"bcd") == 2


def test_many_corpora(spark):
    a, b = engine(spark, ["x", "xx"]), engine(spark, ["y"])
    both = by_index({"a": a.corpus, "b": b.corpus})
    assert sorted((r.index_id, r.doc) for r in both.collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_nulls_and_empties(spark):
    df = spark.createDataFrame([(0, None, None), (1, "i", bytearray(b""))], "doc long, info string, content binary")
    e = Engine(df)
    for q in ("a", "a*b", "APPROX abc"):
        assert docs(e.find_docs(q)) == [] and pairs(e.find_places(q)) == []
    empty = Engine(df.limit(0))
    assert empty.count("a").first().n == 0 and docs(empty.find_docs("a OR b")) == []


def test_or_of_places(spark):
    e = engine(spark, ["abcab", "xbx", "", "ca"])
    assert pairs(e.find_places("ab OR b")) == [(0, 0), (0, 1), (0, 3), (0, 4), (1, 1)]
    assert pairs(e.find_places("(a OR x) THEN 3 (b OR c)")) == sorted({(d, i) for d, t in enumerate(["abcab", "xbx", "", "ca"]) for i, x in enumerate(t) if x in "ax" for j in range(i + 1, min(len(t), i + 4)) if t[j] in "bc"})
    assert docs(e.find_docs("ab OR ca")) == [0, 3]
    with pytest.raises(QueryTypeError):
        e.find_places("(a AND b) OR (a THEN 2 b)")
    with pytest.raises(QueryTypeError):
        e.find_places("(a AND b) THEN 2 c")


def test_approximate_expressions_by_their_pieces(spark):
    """An expression with a string that matches must nearly hold: the same places with the pieces' test and without."""
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["xxabcabcdyy", "abcbcd", "zzabxabcdzz"]
    for q in ("APPROX 1 abc[a-d]?bcd", "APPROX 1 (ab|cd)abc", "APPROX 2 [a-b]abcab"):
        (leaf,) = R.leaves(R.prepare(parse(q)))
        assert search.pieces(leaf)
        machine = search.Automaton(leaf.regex, leaf.approx)
        want = []
        for d, t in enumerate(texts):
            best = {}
            for end in range(1, len(t) + 1):
                if hit := machine.shortest(t.encode(), end):
                    if hit[0] not in best or hit[1] < best[hit[0]]:
                        best[hit[0]] = hit[1]
            want += [(d, s) for s in sorted(best)]
        assert pairs(engine(spark, texts).find_places(q)) == want


def test_pattern_files(spark, tmp_path):
    from bytequarry.plans.planner import pattern_file

    (tmp_path / "q").write_bytes(b"b AND x\n")
    (tmp_path / "raw").write_bytes(b"b AND")
    e = engine(spark, ["abx", "b AND x", "x"])
    assert docs(e.find_docs(pattern_file(str(tmp_path / "q")))) == [0, 1]
    assert docs(e.find_docs(pattern_file(str(tmp_path / "raw"), literal=True))) == [1]


def test_requests(spark, tmp_path):
    """Begun, waited for, cancelled; several side by side; a failed one tells why."""
    import time

    from bytequarry.plans.requests import Request, begin_all, wait_all

    e = engine(spark, ["abc", "bcd", "xyz"])
    first, second = Request(e.find_docs("bc")), Request(lambda: e.request("find_docs 5 1 bc"), str(tmp_path / "out"))
    with pytest.raises(RuntimeError):
        first.wait()
    assert wait_all(begin_all([first, second]), 120) == ["done", "done"]
    assert sorted(r.doc for r in first.rows()) == [0, 1] and spark.read.parquet(str(tmp_path / "out")).count() == 2
    slow = Request(spark.range(1 << 40).selectExpr("sum(hash(id))")).begin()
    assert slow.wait(0.5) == "running"
    time.sleep(1)
    slow.cancel()
    assert slow.wait(60) == "cancelled" and first.wait(1) == "done"
    with pytest.raises(RuntimeError):
        slow.rows()
    bad = Request(spark.range(3).selectExpr("raise_error('no')")).begin()
    assert bad.wait(60) == "failed"
    with pytest.raises(Exception, match="no"):
        bad.rows()
    never = Request(e.find_docs("a"))
    never.cancel()
    assert never.state == "cancelled"


def test_characters_of_several_bytes(spark):
    """SQL's dot is a character; documents with queñes were lost, as their dot took a byte."""
    texts = ["queñes", "qñes", "qabcdes", "qñéües", "qñéüxes", "q\U0001f600\U0001f600et", "ques zz", "q\nes", "qes", "", "äöü", "qe"]
    e = Engine(spark.createDataFrame([(k, str(k), bytearray(t.encode())) for k, t in enumerate(texts)], "doc long, info string, content binary"))
    for q, python in (("q.{1,3}e[st]", "q.{1,3}e[st]"), ("q[^b]{2,3}e[st]", "q[^b]{2,3}e[st]"), ("q.{2,}e", "q.{2,}e"), ("q.*t", "q.*t"), ("q.+es", "q.+es"), ("q(.e|..e)", "q(.e|..e)")):
        want = {k for k, t in enumerate(texts) if re.search(python, t, re.S)}
        assert {r.doc for r in e.find_docs(q, chars=True).collect()} == want, q
    assert {r.doc for r in e.find_docs("q.{1,3}e[st] NOT zz", chars=True).collect()} == {0, 1, 3, 5, 7}
