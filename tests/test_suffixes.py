"""Suffix arrays, mining and similarity against small brute-force versions and known answers."""

import random
from collections import Counter

import pytest

from bytequarry.operators import mining, similarity, suffixes, winnow


def corpus(spark, texts):
    rows = [(k, str(k), bytearray(t if isinstance(t, bytes) else t.encode("latin-1"))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc long, info string, content binary")


def plain_array(texts):
    texts = [t if isinstance(t, bytes) else t.encode("latin-1") for t in texts]
    return [(d, o) for _, d, o in sorted((t[o:], d, o) for d, t in enumerate(texts) for o in range(len(t)))]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def array(spark, texts):
    return [(r.doc, r.off) for r in suffixes.suffix_array(corpus(spark, texts)).orderBy("row").collect()]


def check_array(spark, texts, **kw):
    """Rows, common prefixes, bytes and documents before, and the steps from row to row, against sorted suffixes."""
    raw = [t if isinstance(t, bytes) else t.encode("latin-1") for t in texts]
    want = plain_array(texts)
    array = suffixes.build(corpus(spark, texts), **kw)
    got = array.orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(want))) and [(r.doc, r.off) for r in got] == want
    assert [r.lcp for r in got] == [0] * bool(want) + [common(raw[a][b:], raw[x][y:]) for (a, b), (x, y) in zip(want, want[1:], strict=False)]
    assert [r.byte for r in got] == [raw[d][o - 1] if o else None for d, o in want]
    assert [r.prev_doc for r in got] == [None] * bool(want) + [d for d, _ in want[:-1]]
    return array, want, raw


def test_long_prefixes_take_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "WINDOW", 2)
    monkeypatch.setattr(suffixes, "SLICE", 16)
    for small in (0, 1 << 20):
        check_array(spark, ["abcdefgh" * 30, "abcdefgh" * 30, "abcdefgh" * 10 + "x"], small=small)


def test_known_array(spark):
    """The array and common prefixes of this text are given with it."""
    got = suffixes.build(corpus(spark, ["abaababa"])).orderBy("row").collect()
    assert [r.off for r in got] == [7, 2, 5, 0, 3, 6, 1, 4] and [r.lcp for r in got] == [0, 1, 1, 3, 3, 0, 2, 2]


#: Texts that are known to be hard to sort.
TEXTS = [["seeresses"], ["a" * 70], ["".join(chr(120 - k) for k in range(20))], ["abcabc" * 9, "abcabc" * 9, "", "zz"], [bytes(range(255, 0, -3)), b"\0\0\0", b"\0" * 20, b"abcdefg", b"abcdefg\0"]]


@pytest.mark.parametrize("texts", TEXTS)
@pytest.mark.parametrize("small", [0, 1 << 20])
def test_kinds_of_texts(spark, texts, small):
    array, want, raw = check_array(spark, texts, small=small)
    row = {p: k for k, p in enumerate(want)}
    assert {(r.row, r.back, r.byte) for r in suffixes.step_back(array).collect()} == {(row[p], row[p[0], p[1] - 1], raw[p[0]][p[1] - 1]) for p in want if p[1]}
    assert {(r.row, r.forward, r.byte) for r in suffixes.step_forward(array).collect()} == {(row[d, o], row[d, o + 1], raw[d][o]) for d, o in want if (d, o + 1) in row}


def test_random_texts_both_ways(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    texts += texts[:3]
    for small in (0, 1 << 20):
        check_array(spark, texts, small=small)
    check_array(spark, [], small=0)
    check_array(spark, [])


def test_ranges(spark, tmp_path):
    texts = ["banana", "bandana", "an", "bananas"]
    c, want = corpus(spark, texts), plain_array(texts)
    array = suffixes.build(c)
    rows = lambda s: [k for k, (d, o) in enumerate(want) if texts[d][o:].startswith(s)]
    ends = lambda s: (rows(s)[0], rows(s)[-1])
    assert tuple(suffixes.row_range(array, c, b"an").first()) == ends("an") and suffixes.row_range(array, c, b"zz").first().first is None
    letters = "abdns"
    assert {r.byte: (r.first, r.last) for r in suffixes.rows_left(array, c, b"an").collect()} == {ord(x): ends(x + "an") for x in letters if rows(x + "an")}
    assert {r.byte: (r.first, r.last) for r in suffixes.rows_right(array, c, b"an").collect()} == {ord(x): ends("an" + x) for x in letters if rows("an" + x)}
    assert tuple(suffixes.backward_search(array, *ends("an"), ord("d")).first()) == ends("dan")
    assert suffixes.backward_search(array, *ends("an"), ord("z")).first().first is None
    assert {r.doc for r in suffixes.docs_for_range(array, 0, 2).collect()} == {d for d, _ in want[:3]}
    assert {(r.doc, r.off) for r in suffixes.locate(array, spark.createDataFrame([(1,), (4,)], "row long")).collect()} == {want[1], want[4]}
    suffixes.write_index(c, str(tmp_path), chunk=4, files_n=1)
    index = suffixes.open_index(spark, str(tmp_path))
    assert index.chunk == 4 and len(list((tmp_path / "array").glob("*.parquet"))) == 1
    for first, last in ((0, 2), (0, 3), (3, 9), (2, 17), (4, 11), (5, 6), (0, len(want) - 1), (9, 8)):
        assert {r.doc for r in suffixes.docs_by_chunks(index, first, last).collect()} == {d for d, _ in want[first : last + 1]}
    stored = {r.chunk: (bytes(r.bytes), r.starts) for r in spark.read.parquet(f"{tmp_path}/bwt").collect()}
    for k in range(-(-len(want) // 4)):
        own = list(enumerate(want))[4 * k : 4 * k + 4]
        assert stored[k] == (bytes(ord(texts[d][o - 1]) if o else 0 for _, (d, o) in own), [r for r, (_, o) in own if not o])


def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch):
    """Each task that writes leaves row groups of its own, also where one file is asked for."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(suffixes, "SMALL", 0)
    rng = random.Random(20)
    texts = ["".join(rng.choice("abc") for _ in range(30)) for _ in range(12)]
    want = plain_array(texts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        suffixes.write_index(corpus(spark, texts).repartition(4), str(tmp_path), chunk=16, files_n=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("corpus", "array", "chunks", "bwt"):
        (file,) = (tmp_path / name).glob("*.parquet")
        assert pq.ParquetFile(file).metadata.num_row_groups > 1
    assert {x.name for x in tmp_path.iterdir()} == {"corpus", "array", "chunks", "bwt", "parameters"}
    got = suffixes.open_index(spark, str(tmp_path)).array.orderBy("row").collect()
    assert [(r.row, r.doc, r.off) for r in got] == [(k, d, o) for k, (d, o) in enumerate(want)]
    assert [r.lcp for r in got] == [0] + [common(texts[a][b:], texts[x][y:]) for (a, b), (x, y) in zip(want, want[1:], strict=False)]


def test_numbers_of_files(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "if(id % 3 = 0, null, cast(id as string)) as s", "array(id, null) as a", "cast(id as decimal(20, 3)) as d", "timestamp_seconds(id) as t").repartition(7)
    path, want = str(tmp_path / "a b"), sorted(df.collect())
    kind = df.schema.simpleString()
    for rows, files_n, files in ((df, 1, 1), (df, 2, 2), (df, 3, 3), (df, 5, 5), (df.coalesce(1), 3, 3), (df, None, 7)):
        suffixes.write_files(rows, path, files_n)  # over the one before
        got = spark.read.parquet(path)
        assert len(list((tmp_path / "a b").glob("*.parquet"))) == files and got.schema.simpleString() == kind and sorted(got.collect()) == want
    suffixes.write_files(df.filter("id < 0"), path, 1)
    assert spark.read.parquet(path).schema.simpleString() == kind and not spark.read.parquet(path).count() and (tmp_path / "a b" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # what fails leaves what was there, and no parts
        suffixes.write_files(df.selectExpr("1 div (id - id) as x"), path, 1)
    assert spark.read.parquet(path).schema.simpleString() == kind and [x.name for x in tmp_path.iterdir()] == ["a b"]


#: Texts and the lengths of their minimal unique strings, as given.
UNIQUE = [
    (["abaababa"], [0, 0, 2, 0, 3, 0, 0, 0]),
    (["banana"], [1, 0, 3, 0, 0, 0]),
    (["aaa", "bbb"], [1, 1, 1, 1, 1, 1]),
    (["aba", "bab"], [3, 0, 0, 3, 0, 0]),
    (["aab", "bba"], [2, 2, 0, 2, 2, 0]),
    (["aaba", "abaa"], [3, 0, 0, 0, 0, 3, 0, 0]),
    (["aaaa", "aaab", "abab"], [4, 0, 0, 0, 0, 3, 0, 0, 0, 2, 0, 0]),
    (["aabbcc", "cba"], [2, 2, 2, 2, 2, 0, 2, 2, 0]),
]


@pytest.mark.parametrize("texts,want", UNIQUE)
def test_minimal_unique(spark, texts, want):
    """Documents end without a separator, so a string may reach a document's last byte and not beyond."""
    c = corpus(spark, texts)
    got = {(r.doc, r.off): r.length for r in mining.minimal_unique(suffixes.build(c), c).collect()}
    places = [(d, o) for d, t in enumerate(texts) for o in range(len(t))]
    assert [got.get(p, 0) for p in places] == want


def test_minimal_unique_against_all_others(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 16)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 40))) for _ in range(7)]
    c = corpus(spark, texts)
    got = {(r.doc, r.off): r.length for r in mining.minimal_unique(suffixes.build(c), c).collect()}
    short = {(d, o): 1 + max(common(t[o:], u[p:]) for e, u in enumerate(texts) if e != d for p in range(len(u))) for d, t in enumerate(texts) for o in range(len(t))}
    want = {(d, o): n for (d, o), n in short.items() if o + n <= len(texts[d]) and not short.get((d, o + 1), 1 << 30) < n}
    assert got == want
    uni = mining.minimal_unique(suffixes.build(c), c)
    stats = {r.doc: (r.n, r.least, r.most) for r in mining.unique_statistics(uni).collect()}
    by = {}
    for (d, _), n in want.items():
        by.setdefault(d, []).append(n)
    assert stats == {d: (len(v), min(v), max(v)) for d, v in by.items()}
    upto = {(r.doc, r.length): r.upto for r in mining.unique_histogram(uni).collect()}
    assert upto == {(d, n): sum(x <= n for x in v) for d, v in by.items() for n in v}
    stored = {r.doc: bytes(r.bytes) for r in mining.unique_bytes(uni, c).collect()}
    assert stored == {d: bytes(want.get((d, o), 0) for o in range(len(t))) for d, t in enumerate(texts)}
    for shifts in (False, True):
        kmers = {(r.doc, r.off, r.kmer) for r in mining.unique_kmers(uni, c, k=6, shifts=shifts).collect()}
        could = set()
        for (d, o), n in want.items():
            for at in range(o + n - 6, o + 1) if shifts else [o - (6 - n) // 2]:
                if n <= 6 and 0 <= at and at + 6 <= len(texts[d]):
                    could.add((d, at, texts[d][at : at + 6]))
        assert kmers == could


def _unique_counts(texts, docs):
    """Number of minimal unique strings of each document among ``docs``, by definition."""
    shared = lambda d, o: max((common(texts[d][o:], texts[e][p:]) for e in docs if e != d for p in range(len(texts[e]))), default=0)
    out = {}
    for d in docs:
        n = [1 + shared(d, o) for o in range(len(texts[d]))] + [1 << 30]
        out[d] = sum(n[o] <= 255 and o + n[o] <= len(texts[d]) and n[o + 1] >= n[o] for o in range(len(texts[d])))
    return out


def test_near_copies_leave_until_the_rest_is_unique(spark):
    """The loop as it is stated: half of the near copies, those most alike to a sound document first, else the poorest; then counted anew."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b = word(90), word(80)
    texts = [a + word(30), a, a, b, b, b + word(2), word(60), a[:70], word(50)]
    c = corpus(spark, texts)
    score = {}
    for r in similarity.blocked(suffixes.build(c), c, 20, 8).collect():
        score[r.doc_a, r.doc_b] = score[r.doc_b, r.doc_a] = r.score
    docs, want = list(range(len(texts))), []
    for step in range(1, 10):
        n = _unique_counts(texts, docs)
        near = [d for d in docs if n[d] < 4]
        if not near:
            break
        best = []
        for d in near:
            options = [(score[d, e], -e) for e in docs if n[e] >= 4 and score.get((d, e), 0) > 0]
            if options:
                best.append((max(options)[0], d))
        out = [d for _, d in sorted(best, reverse=True)[: max(1, len(near) // 2)]] or [min((n[d], d) for d in docs)[1]]
        want += [(d, step) for d in out]
        docs = [d for d in docs if d not in out]
    got = mining.drop_near_copies(c, least=4, size=20, common=8).collect()
    assert sorted((r.doc, r.step) for r in got) == sorted(want) and len(want) > 3
    assert not [d for d, k in _unique_counts(texts, docs).items() if k < 4]


def test_outputs_of_kmers(spark):
    c = corpus(spark, ["ACGTACGGTCATTGCA"])
    kmers = spark.createDataFrame([(0, 0, "ACGTACGGTCATTGCA"), (0, 4, "AAAAAAAAAAAAAAAA")], "doc long, off long, kmer string")
    kept = mining.complex_enough(kmers)
    assert [r.value for r in mining.as_fasta(kept, c).collect()] == [">0:0\nACGTACGGTCATTGCA"]
    assert [r.value for r in mining.as_tsv(kept, c).collect()] == ["ACGTACGGTCATTGCA\t0\t0"]
    bars = mining.unique_bytes(spark.createDataFrame([(0, 1, 3)], "doc long, off long, length long"), corpus(spark, [">AC>G"]), b">", slice_size=2).collect()
    assert b"".join(bytes(r.bytes) for r in sorted(bars, key=lambda r: r.slice)) == b">\x03\0>\0"


def test_complexity(spark):
    df = spark.createDataFrame([("ACGTACGGTCATTGCA",), ("AAAAAAAAAAAAAAAA",), ("ACGTA",)], "kmer string")
    a, b, c = (r[0] for r in df.select(mining.complexity(df.kmer)).collect())
    assert 0.65 < a <= 1 and b == 0 and c == 0


def test_frequent_by_percentage(spark):
    c = corpus(spark, ["abab", "abcb"])
    got = lambda **kw: {bytes(r.s).decode(): r.n for r in mining.frequent_substrings(c, 1, **kw).collect()}
    assert got(percent=37.5) == {"a": 3, "ab": 3} and got(suffix=b"b", percent=75) == {"ab": 3}
    assert set(got(percent=12.6, most_percent=25).values()) <= {2} and got(percent=60) == {}


def test_frequent(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(50)) for _ in range(6)]
    count = Counter(t[i:j] for t in texts for i in range(50) for j in range(i + 1, min(50, i + 12) + 1))
    for least, most, suffix in ((5, None, ""), (4, 9, ""), (3, None, "ab")):
        ok = {s: n for s, n in count.items() if n >= least and (most is None or n <= most) and s.endswith(suffix)}
        want = {s: n for s, n in ok.items() if not any(x + s in ok for x in "abc")}
        got = {bytes(r.s).decode(): r.n for r in mining.frequent_substrings(corpus(spark, texts), least, most, suffix.encode(), longest=12).collect()}
        assert got == want


# ------------------------------------------------------------------ similarity


def test_copies_are_alike_and_random_texts_are_not(spark):
    same = "".join(chr(97 + i % 10) for i in range(99)) + "\0"
    rng = random.Random(4)
    texts = [same] * 3 + ["".join(chr(rng.randrange(32, 126)) for _ in range(100)) for _ in range(3)]
    c = corpus(spark, texts)
    sa = suffixes.build(c)
    got = {(r.doc_a, r.doc_b): r.score for r in similarity.blocked(sa, c, size=50, least=10).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    near = {(r.doc_a, r.doc_b): r.score for r in similarity.adjacent(sa).collect()}
    assert all(0 < s <= 1 for s in near.values()) and max(near, key=near.get) in {(0, 1), (1, 2)}
    best = similarity.top(similarity.blocked(sa, c, size=50, least=10), n=2).collect()
    assert len(best) == 2 and best[0].score >= best[1].score


def test_adjacent_against_counts(spark):
    texts = ["abcabd", "abd", "xabc"]
    order = [d for d, _ in plain_array(texts)]
    terms, met = Counter(), Counter()
    for a, b in zip(order, order[1:], strict=False):
        terms[a] += 1
        terms[b] += 1
        if a != b:
            met[min(a, b), max(a, b)] += 1
    got = {(r.doc_a, r.doc_b): round(r.score, 9) for r in similarity.adjacent(suffixes.build(corpus(spark, texts))).collect()}
    assert got == {p: round((n / terms[p[0]] ** 0.5 / terms[p[1]] ** 0.5) ** 0.5, 9) for p, n in met.items()}


def test_shared_sequences(spark):
    a, b = corpus(spark, ["xxxxHELLO WORLDyyyyGOODBYE NOW"]), corpus(spark, ["...HELLO WORLD...GOODBYE NOW", "HELLO WORLD HELLO WORLD", "nothing at all"])
    got = sorted((r.doc, r.q_off, r.length) for r in similarity.shared_sequences(a, b, least=8).collect())
    assert got == [(0, 4, 11), (0, 19, 11), (1, 4, 11), (1, 4, 11)]
    scores = {r.doc: r.score for r in similarity.shared_score(a, b, least=8).collect()}
    assert scores == {0: 22 / 28, 1: 11 / 23}
    assert similarity.shared_sequences(a, b, least=8, without=corpus(spark, ["HELLO WORLD"])).filter("q_off = 4").count() == 0


# ------------------------------------------------------------------ winnowing


def test_windows(spark):
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    h = winnow.gram_hashes(data, 4).tolist()
    assert len(set(zip(h, (data[i : i + 4] for i in range(len(h))), strict=True))) == len(set(h)) == len({data[i : i + 4] for i in range(len(h))})
    for window in (1, 5, 60, 397):
        want = []
        for i in range(len(h) - window + 1):
            low = min(h[i : i + window])
            at = max(k for k in range(i, i + window) if h[k] == low)
            if not want or want[-1] != at:
                want.append(at)
        assert winnow.select(winnow.gram_hashes(data, 4), window).tolist() == want
    assert not len(winnow.select(winnow.gram_hashes(b"abc", 4), 5))


def test_a_common_run_shares_a_fingerprint(spark):
    rng = random.Random(9)
    run = bytes(rng.randrange(256) for _ in range(40))
    texts = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))) + run + bytes(rng.randrange(256) for _ in range(100)) for _ in range(5)]
    prints = winnow.fingerprints(corpus(spark, texts), k=8, guarantee=40).collect()
    by = [{r.hash for r in prints if r.doc == d} for d in range(5)]
    assert set.intersection(*by)
    with pytest.raises(ValueError):
        winnow.fingerprints(corpus(spark, texts), k=8, guarantee=4)


def test_recurring_chains_are_joined(spark):
    rng = random.Random(10)
    run = bytes(rng.randrange(256) for _ in range(300))
    texts = [bytes(rng.randrange(256) for _ in range(50)) + run + bytes(rng.randrange(256) for _ in range(50)) for _ in range(6)]
    prints = suffixes.saved(winnow.fingerprints(corpus(spark, texts), k=8, guarantee=40), "prints")
    chains = winnow.cluster(prints, k=8).collect()
    longest = {d: max(r.stop - r.offset for r in chains if r.doc == d) for d in range(6)}
    assert len(chains) < prints.count() and min(longest.values()) > 150
    top = [next(r.hash for r in chains if r.doc == d and r.stop - r.offset == longest[d]) for d in range(6)]
    assert len(set(top)) == 1


def _cluster(rows, k, passes=20, least=4, skips=1, group=8):
    """The passes on lists of (doc, offset, stop, hash, errors, score); hashes of chains are tuples."""
    state = [(d, o, o + k, (h,), 0, 0) for d, o, h in rows]
    for _ in range(passes):
        by, cands = {}, []
        for r in sorted(state, key=lambda r: (r[0], r[1], -r[2])):
            by.setdefault(r[0], []).append(r)
        for own in by.values():
            for i, r in enumerate(own):
                for step in (1, 2):
                    n = own[i + step] if i + step < len(own) else None
                    cands.append((r, n, step))
        pair, total = Counter((r[3], n and n[3]) for r, n, _ in cands), Counter(r[3] for r, _, _ in cands)
        best, joined = {}, False
        for r, n, step in cands:
            c, t = pair[r[3], n and n[3]], total[r[3]]
            wins = c - (t - c) // 2 if n and c >= least else 0
            errors = r[4] + step - 1 + (n[4] if n else 0)
            good = wins > 0 and errors <= skips
            if good or step == 1:
                joined |= good
                new = (r[0], r[1], max(r[2], n[2]), r[3] + ("|",) + n[3], errors, 2 * wins + 1) if good else (*r[:5], 2 * (t.bit_length() - 1) if t >= group else 0)
                rank = (good, new[5] - new[4], -step)
                if (r[0], r[1]) not in best or rank > best[r[0], r[1]][0]:
                    best[r[0], r[1]] = (rank, new)
        merged = [x for _, x in best.values()]
        if not joined:
            return merged
        state, reach = [], {}
        for r in sorted(merged, key=lambda r: (r[0], r[1], -r[2])):
            if r[2] > reach.get(r[0], -1):
                state.append(r)
                reach[r[0]] = r[2]
    return state


def test_chains_against_a_plain_statement(spark):
    """Copies of one run of fingerprints, some with a changed one in the middle: a chain may skip it."""
    rng = random.Random(22)
    rows = []
    for d in range(9):
        run = [100 + k for k in range(7)]
        if d % 3 == 2:
            run[3] = 900 + d
        rows += [(d, 10 * i, h) for i, h in enumerate([rng.randrange(50) for _ in range(3)] + run + [rng.randrange(50) for _ in range(3)])]
    got = winnow.cluster(spark.createDataFrame(rows, "doc long, offset long, hash long"), k=8).collect()
    want = _cluster(rows, 8)
    assert sorted((r.doc, r.offset, r.stop, r.errors, r.score) for r in got) == sorted((*r[:3], *r[4:]) for r in want)
    assert any(r.errors for r in got)
    lines = winnow.dump(spark.createDataFrame([(1, 2, 255)], "doc long, offset long, hash long")).collect()
    assert lines[0].value == "1:2 00000000000000FF"


def test_chains_over_several_sheets(spark, monkeypatch):
    """Documents in many sheets, some longer than one, against the plain statement; no pass writes fingerprints row by row."""
    rng = random.Random(31)
    line = [500 + k for k in range(9)]
    rows = [(d, 10 * i, h) for d in range(25) for i, h in enumerate([rng.randrange(60) for _ in range(rng.randint(0, 40))] + line[: rng.randint(0, 9)] * rng.randint(0, 3))]
    prints = spark.createDataFrame(rows, "doc long, offset long, hash long")
    written, put = [], suffixes.saved

    def saved(df, name, **options):
        written.append(put(df, name, **options))
        return written[-1]

    monkeypatch.setattr(winnow, "saved", saved)
    monkeypatch.setattr(winnow, "SHEET", 16)
    got = winnow.cluster(prints, k=8, passes=5).collect()
    want = _cluster(rows, 8, passes=5)
    assert sorted((r.doc, r.offset, r.stop, r.errors, r.score) for r in got) == sorted((*r[:3], *r[4:]) for r in want)
    assert 3 < max(df.count() for df in written) <= 25


def test_a_resting_row_is_waked_by_a_chain_with_its_hash(spark):
    """A hash that occurs once can't be joined, until chains get that hash: then it is, as where no row rests (``group`` 0)."""
    turned = lambda a, b: ((a << 1) | (a >> 63)) & ((1 << 64) - 1) ^ b
    a, b, c, e = 1001, 2002, 3003, 4004
    rows = [(d, 10 * i, h) for d in range(4) for i, h in enumerate((70 + d, a, b, c, e, 80 + d))] + [(9, 0, 5), (9, 10, turned(a, b)), (9, 20, turned(b, c)), (9, 30, 6)]
    prints = spark.createDataFrame(rows, "doc long, offset long, hash long")
    told = lambda **kw: sorted((r.doc, r.offset, r.stop, r.hash, r.errors, r.n) for r in winnow.cluster(prints, k=8, passes=3, **kw).collect())
    got = told()
    assert got == told(group=0) and next(r[5] for r in got if r[:2] == (9, 10)) > 1


def test_similarity_by_index(spark):
    a = corpus(spark, ["xxxxHELLO WORLDyyyyGOODBYE NOW"])
    both = {"x": corpus(spark, ["...HELLO WORLD...GOODBYE NOW", "nothing"]), "y": corpus(spark, ["HELLO WORLD HELLO WORLD"])}
    got = {(r.index_id, round(r.score, 6), r.n_bytes, r.sequences, r.shortest, r.longest) for r in similarity.index_score(a, both).collect()}
    assert got == {("x", round(22 / 30, 6), 22, 2, 11, 11), ("y", round(11 / 30, 6), 11, 1, 11, 11)}
    whole = similarity.index_score(a, both, total=True).first()
    assert (whole.n_bytes, whole.sequences, round(whole.score, 6)) == (22, 2, round(22 / 30, 6))
    inner = corpus(spark, ["HELLO WORLD and HELLO WORLDy"])
    sizes = lambda **kw: sorted(r.length for r in similarity.shared_sequences(a, inner, **kw).collect())
    assert sizes() == [12] and sizes(redundant=True) == [11, 12]


def test_copies_of_few_texts_take_no_rounds(spark, monkeypatch):
    """Only different texts are ranked: before, 40 copies were 40 times the places of every round."""
    monkeypatch.setattr(suffixes, "_large_classes", lambda texts: 1 / 0)
    check_array(spark, ["banana", "", "an", "bandana", "xan"] * 40, small=40)


def test_texts_longer_than_a_sheet(spark, monkeypatch):
    """Ranks are looked up in other sheets of the text; texts repeat over several of them."""
    for name, n in (("SHEET", 16), ("HEAD", 8), ("TIMES", 3)):
        monkeypatch.setattr(suffixes, name, n)
    check_array(spark, ["abcdefghi" * 12, "x" + "abcdefghi" * 12, "abcdefghi" * 3 + "\0", "a" * 40, "a" * 16, "a" * 17, "b"] * 2, small=0)


def test_runs_over_partitions(spark, monkeypatch):
    """Numbers, runs, lonely rows and the rows before, over more sorted partitions than there are keys."""
    rng = random.Random(9)
    keys = [(rng.randrange(6), rng.randrange(5)) for _ in range(300)] + [(7, 7)]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(keys)], "a long, b long, c long")
    want = sorted((a, b, k) for k, (a, b) in enumerate(keys))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(suffixes.positions(df, ["a", "b"], ["c"], "test", before=("c",)).collect(), key=lambda r: r["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.a, r.b, r.c) for r in got] == want and [r["at"] for r in got] == list(range(301))
    assert [r.run0 for r in got] == [next(k for k, x in enumerate(want) if x[0] == r.a) for r in got]
    assert [r.run1 for r in got] == [next(k for k, x in enumerate(want) if x[:2] == (r.a, r.b)) for r in got]
    assert [r.alone for r in got] == [keys.count((r.a, r.b)) == 1 for r in got]
    assert [r.prev_c for r in got] == [None] + [x[2] for x in want[:-1]]


def plain_blocks(texts, size, least):
    """Scores of all pairs by the blocks' definition."""
    order = plain_array(texts)
    raw = [t.encode() for t in texts]
    lcp = [0] + [common(raw[a][b:], raw[x][y:]) for (a, b), (x, y) in zip(order, order[1:], strict=False)]
    cuts = {min(range(s, min(s + size, len(order))), key=lambda r: (lcp[r], r)) for s in range(0, len(order), size)}
    starts = sorted(cuts | {0})
    sa = [len(t) * (len(t) + 1) / 2 for t in texts]
    w = Counter()
    for first, stop in zip(starts, [*starts[1:], len(order)], strict=True):
        low = min(lcp[first + 1 : stop], default=0)
        docs = Counter(d for d, _ in order[first:stop])
        if low >= least:
            for a in docs:
                for b in docs:
                    if a < b:
                        w[a, b] += low * (docs[a] * sa[b] + docs[b] * sa[a])
        for r in range(first + 1, stop):
            a, b = sorted((order[r][0], order[r - 1][0]))
            if a != b and lcp[r] > low and lcp[r] >= least:
                w[a, b] += lcp[r] * (sa[a] + sa[b])
    return {p: round((x / (2 * sa[p[0]] * sa[p[1]])) ** 0.5, 6) for p, x in w.items()}


def test_blocks_by_classes_of_copies(spark):
    """Pairs of classes give the pairs of documents, neighbours in other blocks included; the best ones need only the best classes."""
    rng = random.Random(12)
    kinds = ["large ring", "blue ring", "old ring", "cold bolt", "bolt", "abcabcabc", "q"]
    texts = [rng.choice(kinds) for _ in range(90)]
    c = corpus(spark, texts)
    sa = suffixes.build(c)
    for size, least in ((16, 3), (9, 4), (1000, 2)):
        want = plain_blocks(texts, size, least)
        got = [((r.doc_a, r.doc_b), r.score) for r in similarity.blocked(sa, c, size=size, least=least, digits=6).collect()]
        assert len(got) == len(dict(got)) and dict(got) == want
        some = similarity.blocked(sa, c, size=size, least=least, digits=6, best=20)
        assert [(r.doc_a, r.doc_b, r.score) for r in similarity.top(some, n=20).collect()] == [(*p, s) for p, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]]
