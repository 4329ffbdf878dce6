"""Corpora: DataFrames of ``doc`` (long), ``info`` (string) and ``content`` (binary), and their readers and writers.

Files are read by Spark's own readers, so any file system that Spark knows will do. Numbers follow the bytewise order of
paths, given by a sort over range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytequarry.functions.octets import octets, reverse_complement
from bytequarry.operators.suffixes import saved, write_files

#: File extensions of sequence files.
FASTA = (".fasta", ".fas", ".fa", ".fna", ".ffn", ".faa", ".mpfa", ".frn")


def number(df: DataFrame, order: list[str], name: str = "doc") -> DataFrame:
    """``df`` with a number from 0 in the order of the columns: a range sort, written once so that numbers never change, and the sums of its partitions' sizes."""
    rows = saved(df.orderBy(*order).withColumn("_slot", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_slot", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return rows.join(F.broadcast(base), "_slot").withColumn(name, (F.col("_at") + F.col("_base")).cast("long")).drop("_slot", "_at", "_base")


def starts(corpus: DataFrame, extra: int = 1) -> DataFrame:
    """doc, start: where each document begins in the concatenation of all, ``extra`` bytes behind the one before; a sort and the sums of its partitions."""
    rows = saved(corpus.select("doc", (F.length("content") + extra).cast("long").alias("size")).orderBy("doc").withColumn("_slot", F.spark_partition_id()), "sizes")
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_slot").agg(F.sum("size").alias("_n")).select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_slot").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(F.broadcast(base), "_slot").select("doc", (F.col("_base") + F.col("_own")).alias("start"))


def from_table(df: DataFrame, doc: str, text: str, info=None) -> DataFrame:
    """A table's text column as a corpus."""
    return df.select(F.col(doc).cast("long").alias("doc"), (info if info is not None else F.col(doc).cast("string")).alias("info"), octets(F.col(text)).alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table; info is source/doc_id."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_table(df, "doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")))


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """Every regular file under the paths is a document; info is its path. Spark's reader passes over files without bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return number(found.select(F.col("path").alias("info"), "content"), ["info"]).select("doc", "info", "content")


def from_list(spark: SparkSession, list_path: str, root: str, nul: bool = False) -> DataFrame:
    """The files under ``root`` that a list names, one name a line or, with ``nul``, up to each NUL."""
    reader = spark.read.option("lineSep", "\0") if nul else spark.read
    names = reader.text(list_path).filter("value <> ''").select(F.concat(F.lit("/"), F.ltrim(F.col("value"), F.lit("/"))).alias("name")).distinct()
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("name", F.regexp_replace("path", "^[a-z]+:/*", "/"))
    return number(all_files.join(names, "name").select(F.col("path").alias("info"), "content"), ["info"]).select("doc", "info", "content")


def deduplicate(corpus: DataFrame) -> DataFrame:
    """Documents of equal content become the first of them; info joins all their infos by ``|``, which no info may hold.

    The groups are by SHA-1 with partial aggregation; content travels once, for the first document of each.
    """
    checked = corpus.withColumn("info", F.when(~F.contains("info", F.lit("|")), F.col("info")).otherwise(F.raise_error(F.concat(F.lit("an info holds |: "), "info"))))
    groups = checked.groupBy(F.sha1("content").alias("sha1")).agg(F.min("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("doc", "info"))).alias("all"))
    infos = groups.select("doc", F.array_join(F.transform("all", lambda x: x["info"]), "|").alias("info"), "sha1")
    return infos.join(corpus.select("doc", "content"), "doc").select("doc", "info", "content", "sha1")


def zero_split(corpus: DataFrame) -> DataFrame:
    """NUL-separated records as documents whose info is their content."""
    text = F.decode("content", "ISO-8859-1")
    whole = F.regexp_replace(text, "\\x00\\z", "")
    rows = corpus.filter("length(content) > 0").select("doc", F.posexplode(F.split(whole, "\\x00")).alias("part", "record"))
    out = rows.select(F.col("doc").alias("_file"), "part", F.encode("record", "ISO-8859-1").alias("content"))
    return number(out.withColumn("info", F.decode("content", "UTF-8")), ["_file", "part"]).select("doc", "info", "content")


def fasta_records(corpus: DataFrame) -> DataFrame:
    """Every ``>`` record is a document: info is the header, content the sequence in upper case without white space."""
    text = F.decode("content", "ISO-8859-1")
    parts = corpus.select("doc", F.posexplode(F.split(text, "(?m)^>")).alias("part", "record")).filter("part > 0")
    body = F.upper(F.regexp_replace(F.regexp_replace("record", "^[^\\n]*\\n?", ""), "\\s", ""))
    rows = parts.select(F.col("doc").alias("_file"), "part", F.regexp_replace(F.regexp_extract("record", "^[^\\n]*", 0), "\\r\\z", "").alias("info"), F.encode(body, "ISO-8859-1").alias("content"))
    return number(rows, ["_file", "part"]).select("doc", "info", "content")


def fasta_files(corpus: DataFrame, both_strands: bool = True) -> DataFrame:
    """Sequence files as one document each: every description becomes ``>``, and the reverse complement of each sequence follows it."""
    is_fasta = F.lower("info").rlike("(" + "|".join(e.replace(".", "\\.") for e in FASTA) + ")$")
    text = F.decode("content", "ISO-8859-1")
    pieces = F.slice(F.split(text, "(?m)^>[^\\n]*\\n?"), 2, 1 << 30)
    clean = F.transform(pieces, lambda x: F.upper(F.regexp_replace(x, "\\s", "")))
    both = F.transform(clean, lambda x: F.concat(F.lit(">"), x, F.lit(">"), reverse_complement(x)) if both_strands else F.concat(F.lit(">"), x))
    return corpus.withColumn("content", F.when(is_fasta, F.encode(F.array_join(both, ""), "ISO-8859-1")).otherwise(F.col("content")))


def random_texts(spark: SparkSession, n: int, length: int, seed: int = 1, letters: str = "acgt") -> DataFrame:
    """``n`` documents of ``length`` random letters, up to 256 kinds; equal seeds give equal texts. A letter comes from two hexadecimal digits of an MD5."""
    sums = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((length - 1) // 16)), lambda j: F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"), j.cast("string")))), "")
    pick = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.substring(F.lit(letters), (F.conv(F.substring(F.col("sums"), 2 * i + 1, F.lit(2)), 16, 10).cast("int") % len(letters)) + 1, F.lit(1)))
    return spark.range(n).withColumn("sums", sums).select(F.col("id").alias("doc"), F.col("id").cast("string").alias("info"), octets(F.array_join(pick, "")).alias("content"))


class Adapter:
    """What a source of documents has to offer; any class with these methods will do.

    ``parts`` names the parts of the source (any values that pickle); ``read`` gives the (info, content) pairs of a part, in order. Parts
    are read by the executors, so what ``read`` opens must be there.
    """

    def parts(self) -> list:
        raise NotImplementedError

    def read(self, part) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError


def from_adapter(spark: SparkSession, adapter: Adapter) -> DataFrame:
    """The documents of an adapter, numbered by part and place."""
    parts = adapter.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                infos, contents, at, size = [], [], 0, 0
                for info, content in adapter.read(parts[k]):
                    infos.append(info)
                    contents.append(content)
                    size += len(content)
                    if size >= 1 << 24:
                        yield _part(k, at, infos, contents)
                        infos, contents, at, size = [], [], at + len(infos), 0
                yield _part(k, at, infos, contents)

    rows = spark.range(len(parts), numPartitions=max(1, min(len(parts), 10_000))).mapInArrow(run, "part long, at long, info string, content binary")
    return number(rows, ["part", "at"]).select("doc", "info", "content")


def _part(part: int, at: int, infos: list, contents: list) -> pa.RecordBatch:
    n = len(infos)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(infos, pa.string()), pa.array(contents, pa.binary())], names=["part", "at", "info", "content"])


# ------------------------------------------------------------------ sinks


def write_index(corpus: DataFrame, path: str, files_n: int | None = None) -> None:
    """The corpus as Parquet, in ``files_n`` files if given."""
    write_files(corpus.select("doc", "info", "content"), path, files_n)


def open_index(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths).select("doc", "info", "content")


def plain_lines(places: DataFrame, corpus: DataFrame, sep: str = "\t") -> DataFrame:
    """value: a document's info and its offsets, in order."""
    by = places.groupBy("doc").agg(F.sort_array(F.collect_list("offset")).alias("at"))
    return by.join(corpus.select("doc", "info"), "doc").select(F.concat(F.col("info"), F.lit(sep), F.array_join(F.transform("at", lambda x: x.cast("string")), " ")).alias("value"))


def json_lines(places: DataFrame, corpus: DataFrame) -> DataFrame:
    """value: a JSON object for each document, with its info and offsets."""
    by = places.groupBy("doc").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return by.join(corpus.select("doc", "info"), "doc").select(F.to_json(F.struct("doc", "info", "offsets")).alias("value"))


def extract_files(corpus: DataFrame, folder: str) -> DataFrame:
    """Write every document as a file named by its number in a folder that all executors reach; gives doc, path, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            docs, paths, sizes = [], [], []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{doc}")
                with open(f"{path}.part", "wb") as f:
                    f.write(content or b"")
                os.replace(f"{path}.part", path)
                docs.append(doc)
                paths.append(path)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["doc", "path", "bytes"])

    return corpus.select("doc", "content").mapInArrow(run, "doc long, path string, bytes long")


def prepared(corpus: DataFrame, end: bytes = b"\0") -> DataFrame:
    """start, bytes: every document with an end mark, and where it begins in the concatenation of all."""
    return corpus.select("doc", F.concat("content", F.lit(end)).alias("bytes")).join(starts(corpus, len(end)), "doc").select("doc", "start", "bytes")


def report_lines(engine, q: str, suggest: str | None = None) -> DataFrame:
    """value: a JSON object for each result (document, info, offsets), each distinct match with its number, each suggestion, and the total."""
    places = json_lines(engine.find_places(q), engine.corpus).select(F.concat(F.lit('{"result":'), "value", F.lit("}")).alias("value"))
    text = lambda c: F.decode(c, "UTF-8")
    matches = engine.matches(q).select(F.to_json(F.struct(F.struct(text("match").alias("match"), "cost", "n").alias("match"))).alias("value"))
    whole = engine.count(q).select(F.to_json(F.struct(F.col("n").alias("total"))).alias("value"))
    out = places.unionByName(matches).unionByName(whole)
    if suggest:
        out = out.unionByName(engine.suggest(suggest).select(F.to_json(F.struct(F.struct(text("suggestion").alias("suggestion"), "n").alias("suggestion"))).alias("value")))
    return out


def write_lines(lines: DataFrame, path: str, sep: str = "\n", files_n: int | None = None) -> None:
    """Lines (``value``) to text files, with ``sep`` behind each: a line end, or NUL."""
    (lines.coalesce(files_n) if files_n else lines).select("value").write.mode("overwrite").option("lineSep", sep).text(path)
