"""Language ID: held-out accuracy, spans of mixed texts, and Viterbi against all paths."""

import itertools
import random
import zlib

import numpy as np

from bytequarry.llm import langid as L

STEMS = {"en": ["the", "tion", "ing", "and", "wh", "sh"], "de": ["sch", "ung", "der", "ein", "ü", "tz"], "fr": ["eau", "que", "é", "oi", "les", "ç"], "ru": ["ого", "при", "ст", "ени", "на", "я"], "el": ["τη", "και", "ου", "ση", "να", "ω"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _rows(rng, n=600):
    langs = list(STEMS)
    return [(k, _text(rng, langs[k % 5], rng.randint(8, 60)), langs[k % 5]) for k in range(n)]


def test_held_out_accuracy(spark):
    rows = _rows(random.Random(1))
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k: r.held_out for k, r in got.items()} == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k, _, _ in rows}
    held = [(got[k].lang_pred, lang) for k, _, lang in rows if got[k].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_learned_rows_and_text_matter(spark):
    rng = random.Random(2)
    rows = _rows(rng)
    frame = lambda rows: {r.doc_id: (r.lang_pred, r.score, r.spans) for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    other = [(k, t, ("xx" if held(k) else lang)) for k, t, lang in rows]
    assert frame(rows) == frame(other)


def test_spans_of_mixed_texts(spark):
    rng = random.Random(3)
    model = L.fit(spark.createDataFrame(_rows(rng), "doc_id long, text string, lang string"))
    parts = [("en", _text(rng, "en", 30)), ("ru", _text(rng, "ru", 5)), ("de", _text(rng, "de", 12))]
    text = " ".join(t for _, t in parts)
    ((lang, score, spans),) = L.label([text], model)
    assert lang == "en" and [s.split(":")[0] for s in spans.split(",")] == ["en", "ru", "de"]
    at = 0
    for (_, t), s in zip(parts, spans.split(","), strict=True):
        _, a, b = s.split(":")
        assert (int(a), int(b)) == (at, at + len(t))
        at += len(t) + 1
    assert 0 < score < 1


def test_cuts_and_batches_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    model = L.fit(spark.createDataFrame(_rows(rng), "doc_id long, text string, lang string"))
    texts = [None, "", "123 !!", *(_text(rng, rng.choice(list(STEMS)), rng.choice((1, 3, 80, 700))) + rng.choice(["", "!", " 5"]) for _ in range(60))]
    whole = L.label(texts, model)
    monkeypatch.setattr(L, "CHARS", 500)
    monkeypatch.setattr(L, "WORDS", 40)
    assert L.label(texts, model) == whole
    assert [L.label([t], model)[0] for t in texts] == whole
    assert whole[0] == whole[1] == whole[2] == ("und", 0.0, "")


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 4, 6, 2])
    e = rng.integers(-30, 0, (sizes.sum(), 3)).astype(np.float64)
    got, at = L._viterbi(e, sizes), 0
    for n in sizes:
        own = e[at : at + n]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - L.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert value(tuple(got[at : at + n])) == max(map(value, itertools.product(range(3), repeat=int(n))))
        at += n


def test_odd_frames(spark):
    kind = "doc_id long, text string, lang string, score string"
    nothing = spark.createDataFrame([(1, "some words", None, "x"), (None, None, "en", None), (3, "", "en", None)], kind)
    assert sorted((r.lang_pred, r.score, r.spans) for r in L.identify(nothing).collect()) == [("und", 0.0, "")] * 3
    assert L.identify(nothing.limit(0)).count() == 0
    rows = [(0, "der Tag", "de", "x"), (0, "der Tag", "de", "x"), (2, "x" * 200_000 + " " + "y " * 50_000, "de", "x")]
    got = L.identify(spark.createDataFrame(rows, kind)).collect()
    assert [r.lang_pred for r in got] == ["de"] * 3
    kept = L.keep_known(spark.createDataFrame([*rows, (5, "12 34", "de", "y"), (6, None, "de", "y")], kind))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 3


def test_scripts_narrow_the_candidates(spark):
    """A word has only languages of its script, however much another is like it, and those alone are scored."""
    rows = [r for r in _rows(random.Random(3))]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names = model["langs"]
    rng = random.Random(4)
    text = " ".join(_text(rng, rng.choice(list(STEMS)), 1) for _ in range(60))
    (_, _, spans) = L.label([text], model)[0]
    for s in spans.split(","):
        lang, a, b = s.split(":")
        for w in text[int(a) : int(b)].split():
            assert (lang == "ru") == ("а" <= w[0] <= "я") and (lang == "el") == ("α" <= w[0] <= "ώ")
    _, h, first, script = L._grams("when при τη")
    e = L._scores(model, h, first, script)
    assert [{names[k] for k in np.flatnonzero(row > L.BARRED)} for row in e] == [{"en", "de", "fr"}, {"ru"}, {"el"}]


def test_combining_marks_stay_inside_words():
    word = "\u0939\u093f\u0928\u094d\u0926\u0940"  # letters with vowel signs
    at, _, first, _ = L._grams(f"{word} x\u0301y \u0301 \u0301\u0301")
    assert at[first].tolist() == [0, len(word) + 1] and len(at) == len(word) + 3


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 3)
    rows = [(k, "text of it", f"l{k}") for k in range(5)]
    try:
        L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    except ValueError:
        return
    raise AssertionError
