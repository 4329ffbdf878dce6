"""Readers, writers and the stream."""

import hashlib

import pytest

from bytequarry.functions import octets
from bytequarry.operators import suffixes
from bytequarry.plans.planner import Engine
from bytequarry.sources import corpus as C
from bytequarry.streaming import ingest

KIND = "doc long, info string, content binary"


def rows(df):
    return [(r.doc, r.info, bytes(r.content)) for r in df.orderBy("doc").collect()]


def test_files_in_the_order_of_their_paths(spark, tmp_path):
    for name, data in (("b/x", b"1"), ("a/z", b"2"), ("B", b"3"), ("a/A", b"4"), ("a/empty", b"")):
        p = tmp_path / "top" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = rows(C.files(spark, str(tmp_path / "top")))
    assert [i.rsplit("/top/", 1)[1] for _, i, _ in got] == ["B", "a/A", "a/z", "b/x"] and [c for *_, c in got] == [b"3", b"4", b"2", b"1"] and [d for d, *_ in got] == [0, 1, 2, 3]
    for nul, sep in ((False, "\n"), (True, "\0")):
        names = tmp_path / f"list{nul}"
        names.write_text(sep.join([str(tmp_path / "top/a/z"), str(tmp_path / "top/B"), ""]))
        assert [c for *_, c in rows(C.from_list(spark, str(names), str(tmp_path / "top"), nul))] == [b"3", b"2"]


def test_copies(spark):
    df = spark.createDataFrame([(0, "a", bytearray(b"x")), (1, "b", bytearray(b"y")), (2, "c", bytearray(b"x"))], KIND)
    got = C.deduplicate(df).orderBy("doc").collect()
    assert [(r.doc, r.info, bytes(r.content), r.sha1) for r in got] == [(0, "a|c", b"x", hashlib.sha1(b"x").hexdigest()), (1, "b", b"y", hashlib.sha1(b"y").hexdigest())]
    with pytest.raises(Exception, match="holds"):
        C.deduplicate(spark.createDataFrame([(0, "a|b", bytearray(b"x"))], KIND)).collect()


def test_records(spark):
    nul = spark.createDataFrame([(0, "f", bytearray(b"one\0two\0")), (1, "g", bytearray(b"three")), (2, "h", bytearray(b""))], KIND)
    assert rows(C.zero_split(nul)) == [(0, "one", b"one"), (1, "two", b"two"), (2, "three", b"three")]
    text = bytearray(b"junk\n>first one\r\nacg t\nAC\n>second\nGG>T\n")
    fasta = spark.createDataFrame([(0, "d/x.FA", text), (1, "notes.txt", bytearray(b">kept"))], KIND)
    assert rows(C.fasta_records(fasta.filter("doc = 0"))) == [(0, "first one", b"ACGTAC"), (1, "second", b"GG>T")]
    both = {d: c for d, _, c in rows(C.fasta_files(fasta))}
    assert both[1] == b">kept" and both[0].startswith(b">ACGTAC>GTACGT>GG")
    assert {d: c for d, _, c in rows(C.fasta_files(fasta, both_strands=False))}[0].startswith(b">ACGTAC>GG")


def test_random_texts_repeat(spark):
    a, b, c = (rows(C.random_texts(spark, 50, 30, seed)) for seed in (1, 1, 2))
    assert a == b != c and all(len(t) == 30 and set(t) <= set(b"acgt") for *_, t in a)


def test_writing_and_opening(spark, tmp_path):
    df = spark.createDataFrame([(k, f"i{k}", bytearray(b"abc" * k)) for k in range(5)], KIND)
    C.write_index(df, f"{tmp_path}/one", files_n=1)
    C.write_index(df.withColumn("doc", df.doc + 10), f"{tmp_path}/two")
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert [d for d, *_ in rows(C.open_index(spark, f"{tmp_path}/one", f"{tmp_path}/two"))] == [*range(5), *range(10, 15)]
    out = C.extract_files(df, f"{tmp_path}/files").collect()
    assert {r.doc: open(r.path, "rb").read() for r in out} == {k: b"abc" * k for k in range(5)}


def test_lines_of_results(spark):
    e = Engine(spark.createDataFrame([(0, "p", bytearray(b"abab")), (1, "q", bytearray(b"b"))], KIND))
    assert [r.value for r in C.plain_lines(e.find_places("ab"), e.corpus).collect()] == ["p\t0 2"]
    assert sorted(r.value for r in C.json_lines(e.find_places("b"), e.corpus).collect()) == ['{"doc":0,"info":"p","offsets":[1,3]}', '{"doc":1,"info":"q","offsets":[0]}']


def test_functions(spark):
    df = spark.createDataFrame([(bytearray(bytes(range(256))), "ACGTN")], "b binary, s string")
    r = df.select(octets.latin(df.b).alias("l"), octets.reverse_complement(df.s).alias("r"), octets.sha1_of(df.b).alias("h"), octets.sha256_of(df.b).alias("g")).first()
    assert r.l == bytes(range(256)).decode("latin-1") and r.r == "NACGT" and r.h == hashlib.sha1(bytes(range(256))).hexdigest() and r.g == hashlib.sha256(bytes(range(256))).hexdigest()


def test_stream(spark, tmp_path):
    staging, index, check = f"{tmp_path}/staging", f"{tmp_path}/index", f"{tmp_path}/check"
    put = lambda ids: spark.createDataFrame([(k, f"i{k}", bytearray(b"hit" if k % 2 else b"miss")) for k in ids], KIND).write.mode("append").parquet(staging)
    put(range(4))
    ingest.start(spark, staging, index, check).awaitTermination()
    put(range(4, 7))
    assert ingest.indexed(spark, index).count() == 4
    both = ingest.everything(spark, staging, index)
    assert sorted(r.doc for r in Engine(both).find_docs("hit").collect()) == [1, 3, 5]
    ingest.start(spark, staging, index, check).awaitTermination()
    ingest.start(spark, staging, index, check).awaitTermination()
    assert sorted(r.doc for r in ingest.indexed(spark, index).collect()) == list(range(7))
    q = ingest.running_counts(spark, staging, b"hit").writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination()
    assert spark.table("hits").first().n == 3


def test_saved_tables_are_in_the_shared_folder(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    df = suffixes.saved(spark.range(3), "numbers")
    assert all(f.startswith(top) for f in df.inputFiles()) and df.count() == 3


def test_adapters_and_the_concatenation(spark):
    class Pairs(C.Adapter):
        def parts(self):
            return ["x", "y", "none"]

        def read(self, part):
            return iter([] if part == "none" else [(f"{part}{k}", bytes([k]) * k) for k in range(3)])

    got = C.from_adapter(spark, Pairs()).orderBy("doc").collect()
    assert [(r.doc, r.info, bytes(r.content)) for r in got] == [(k, f"{p}{i}", bytes([i]) * i) for k, (p, i) in enumerate((p, i) for p in "xy" for i in range(3))]
    rows = [(k, str(k), bytearray(b"a" * k)) for k in range(40)]
    out = C.prepared(spark.createDataFrame(rows, "doc long, info string, content binary").repartition(5)).orderBy("start").collect()
    text = b"".join(bytes(r.bytes) for r in out)
    assert text == b"".join(b"a" * k + b"\0" for k in range(40)) and all(text[r.start :].startswith(bytes(r.bytes)) for r in out)


def test_one_file_by_many_tasks(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(k, f"i{k}", bytearray(b"abc" * k)) for k in range(40)], KIND).repartition(4)
    C.write_index(df, str(tmp_path / "one"), files_n=1)
    (file,) = (tmp_path / "one").glob("*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups == 4 and rows(C.open_index(spark, str(tmp_path / "one"))) == rows(df)


def test_reports(spark, tmp_path):
    import json

    from bytequarry.plans.planner import Engine

    e = Engine(spark.createDataFrame([(0, "a", bytearray(b"the then")), (1, "b", bytearray(b"this"))], "doc long, info string, content binary"))
    lines = C.report_lines(e, "th(e|is)", suggest="thex")
    found = [json.loads(r.value) for r in lines.collect()]
    assert {"total": 3} in found and {"match": {"match": "the", "cost": 0, "n": 2}} in found
    assert {"result": {"doc": 0, "info": "a", "offsets": [0, 4]}} in found and any("suggestion" in x for x in found)
    C.write_lines(lines, str(tmp_path / "out"), files_n=1)
    assert spark.read.text(str(tmp_path / "out")).count() == len(found)
