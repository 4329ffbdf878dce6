"""The pipeline over a planted corpus: every stage against what it should keep."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from bytequarry.llm import langid, pii
from bytequarry.llm._common import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"en": ["the", "ti", "ing", "and", "wh"], "de": ["sch", "ung", "der", "ein", "ü"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    text = lambda lang, n: " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(k, text("en", 40)) for k in range(5)]
    docs = {k: text("en" if k % 2 else "de", rng.randint(60, 200)) for k in range(80)}
    near = docs[3].split()
    near[50] = "changed"
    docs |= {100: docs[3], 101: " ".join(near), 102: docs[9].upper()}
    docs |= {110: text("en", 30) + " " + items[2][1] + " " + text("en", 20), 111: text("en", 2000) + " " + " ".join(items[1][1].split()[:14])}
    docs |= {120: "12 34 -- !!", 121: "", 122: None, 123: text("en", 60) + " mail me at a.b@example.com or +1 (243) 555-5526 or 243 555 5526 please"}
    docs |= {130: "x" * 300_000}
    folder = tmp_path_factory.mktemp("sf")
    rows = [(k, t, None if k == 5 else "en" if k % 2 else "de", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmarks", "personal_data", "pack"]


def test_each_stage(spark, corpus):
    folder, docs = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(df.filter(~langid.held_out()))
    kept = set(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.schema.simpleString() == df.schema.simpleString()
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count()
        if name == "language":
            kept -= {120, 121, 122}
            assert all((langid.label([docs[k]], model)[0][0] != "und") == (k in kept) for k in docs)
        elif name == "near_duplicates":
            kept -= {100, 101, 102}
        elif name == "benchmarks":
            kept -= {110, 111}  # a passage counts however long the text around it
        else:
            assert rows[123].text.endswith("mail me at [EMAIL] or [PHONE] or [PHONE] please") and rows[123].n_chars == len(rows[123].text)
            assert all(r.text == pii.redact(docs[k]) for k, r in rows.items())
        assert set(rows) == kept, name
        path = f"{folder}/{name}"
        out.write.parquet(path)
        df = spark.read.parquet(path)


def test_whole_run(spark, corpus):
    from tokenizers import Tokenizer

    folder, docs = corpus
    tok = Tokenizer.from_file(tokenizer_path())
    want = {k: len(tok.encode(pii.redact(t), add_special_tokens=False).ids) + 1 for k, t in docs.items() if k not in {100, 101, 102, 110, 111, 120, 121, 122}}
    got, sizes = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want and all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_every_column_and_more_columns(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (None, "der ung sch " * 9, None, None, None, 2), (4, "the ing and", "en", None, None, 3), (4, "the ing and", "en", None, None, 3)]
    spark.createDataFrame(rows, KIND + ", kept int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.offset == 0 for r in got) >= 1 and {r.doc_id for r in got} <= {None, 4}


def test_near_copies_from_four_fifths_on(spark, tmp_path):
    """One changed word of 60 leaves 51 of 61 shingles, 0.836; two far apart leave 46 of 66, 0.697."""
    text = lambda *changed: " ".join(f"x{k}" if k in changed else f"w{k}" for k in range(60))
    rows = [(1, text(), "en", "s", 1), (2, text(30), "en", "s", 1), (3, text(15, 45), "en", "s", 1)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, KIND), str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 3}
