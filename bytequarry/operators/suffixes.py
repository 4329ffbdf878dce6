"""Suffix arrays: built once, stored with common prefixes and preceding bytes, and read off.

A suffix ends with its document, an ended one sorts before any byte, and equal suffixes are in the order of documents.

Large corpora are ranked by prefix doubling over range-partitioned sorts, each different text once: a round sorts the suffixes that aren't
settled yet by their ranks for k bytes and those of the suffixes k, 2 k, ... 7 k bytes on, which lie in the same sheet of ranks. Ranks come from row
numbers within the sorted partitions and a list of the partitions' ends. A suffix is settled when no other has its rank, or when it and its equals have
ended; rounds end with the longest repeat. One more sort by rank and document numbers the suffixes of all copies. Texts are read in sheets and
slices, so no document, however long, is one row of a join.

Corpora of up to ``SMALL`` bytes, or of so many in different texts, are sorted by the same steps in the memory of one task, which gives the same rows without the rounds' jobs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the first ranking in memory sees.
FIRST = 7
#: Bytes that the first ranking of a large corpus sees (a multiple of 8), and by how much a round multiplies them.
HEAD, TIMES = 32, 8
#: Bytes of texts whose ranks lie side by side in one row.
SHEET = 1 << 18
#: Bytes of two suffixes that are compared first, and of a slice of a text.
WINDOW, SLICE = 64, 4096
#: Bytes of a corpus that one task may sort.
SMALL = 4 << 20
#: Rows of a chunk for which a stored array lists its documents.
CHUNK = 2048

_COLUMNS = "row long, doc long, off long, lcp long, byte int, prev_doc long"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset, a local session, whose executors are this machine, gets
    a temporary one; on a cluster a folder of one machine would be lost to the others, so there it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        top = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once in the shared folder, with the writer's options, and read again, which cuts its lineage; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytequarry/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def write_files(df: DataFrame, path: str, files_n: int | None = None) -> None:
    """``df`` as Parquet under a path, in ``files_n`` files if given and if there are as many rows.

    So few files as not to keep all cores busy are joined from parts, which as many tasks write as the rows have: the driver copies the parts' row groups,
    encoded and compressed as they are, one behind the other, so no task sees all rows. The parts lie beside the path until then.
    """
    sc = df.sparkSession.sparkContext
    if not files_n or files_n >= sc.defaultParallelism:
        (df.repartition(files_n) if files_n else df).write.mode("overwrite").parquet(path)
        return
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    hdfs, hadoop = jvm.org.apache.hadoop.fs, jvm.org.apache.parquet.hadoop
    fs, key = hdfs.Path(path).getFileSystem(conf), uuid.uuid4().hex
    top = fs.makeQualified(hdfs.Path(path))
    beside = hdfs.Path(top.getParent(), f"_{top.getName()}-{key}")
    try:
        df.write.parquet(beside.toString())
        parts = sorted((x for x in fs.listStatus(beside) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
        if len(parts) < files_n:
            df.sparkSession.read.parquet(beside.toString()).repartition(files_n).write.mode("overwrite").parquet(path)
            return
        fs.delete(top, True)
        fs.mkdirs(top)
        for k in range(files_n):
            own = [hadoop.util.HadoopInputFile.fromStatus(x, conf) for x in parts[k * len(parts) // files_n : (k + 1) * len(parts) // files_n]]
            first = hadoop.ParquetFileReader.open(own[0])
            meta = first.getFileMetaData()
            first.close()
            name = hdfs.Path(top, f"part-{k:05d}-{key}" + parts[0].getPath().getName().partition("-c000")[2])
            out = hadoop.ParquetFileWriter(hadoop.util.HadoopOutputFile.fromPath(name, conf), meta.getSchema(), getattr(hadoop, "ParquetFileWriter$Mode").CREATE, 128 << 20, 8 << 20)
            try:
                out.start()
                for part in own:
                    out.appendFile(part)
                out.end(meta.getKeyValueMetaData())
            finally:
                out.close()
        fs.create(hdfs.Path(top, "_SUCCESS")).close()
    finally:
        fs.delete(beside, True)


# ------------------------------------------------------------------ positions in a global order


def positions(df: DataFrame, keys: list[str], ties: list[str], name: str, before: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``at``, its number in the order of keys and ties; ``run0``, ``run1``, ...: the number of the first row that
    agrees in the first 1, 2, ... keys; ``alone``: no other row agrees in all of them; and ``prev_`` columns with what the row before has in
    the columns ``before``. Keys, and those columns, are longs.

    One sort; rows are numbered in their sorted partition, and where a partition begins, and with which run, follows from the ends of all
    partitions, two rows for each.
    """
    kept, last_key = df.columns, len(keys) - 1
    runs, prevs = [f"run{k}" for k in range(len(keys))], [f"prev_{c}" for c in before]
    schema = df.select(*kept).schema.add("_slot", "integer").add("at", "long").add("_ends", "boolean").add("_edge", "boolean")
    for c in (*runs, *prevs):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, done, last, starts, seen = TaskContext.get().partitionId(), 0, None, [0] * len(keys), [None] * len(before)
        held = None  # a batch whose last row waits for the next one

        def out(held, ends, final):
            columns, n, at, cols, rest = held
            edge = at == 0
            edge[-1] |= final
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, slot, np.int32)), pa.array(at), pa.array(ends), pa.array(edge), *cols, *rest], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(done, done + n)
            cols, new = [], np.zeros(n, bool)
            for k, key in enumerate(keys):
                v = batch.column(key).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
                new[0] |= last is None or last[k] != v[0]
                first = np.maximum.accumulate(np.where(new, at, -1))
                first[first < 0] = starts[k]
                starts[k] = int(first[-1])
                cols.append(pa.array(first))
            rest = []
            for k, c in enumerate(before):
                v = batch.column(c).to_numpy(zero_copy_only=False)
                rest.append(pa.array(np.concatenate([[0 if seen[k] is None else seen[k]], v[:-1]]), pa.int64(), mask=at == 0))
                seen[k] = int(v[-1])
            last = [batch.column(key)[n - 1].as_py() for key in keys]
            if held is not None:
                yield out(held[0], np.append(held[1][1:], new[0]), False)
            held = (batch.columns, n, at, cols, rest), new
            done += n
        if held is not None:
            yield out(held[0], np.append(held[1][1:], True), True)

    rows = saved(df.orderBy(*keys, *ties).mapInArrow(run, schema), name)
    # the sorted partitions' ends: as many rows as the sort has partitions, twice
    edges: dict[int, list] = {}
    for r in sorted(rows.filter("_edge").select("_slot", "at", *dict.fromkeys((*keys, *before)), *runs).collect(), key=lambda r: (r["_slot"], r["at"])):
        edges.setdefault(r["_slot"], []).append(r)
    base, facts, ahead, starts = 0, [], None, [0] * len(keys)
    for slot in sorted(edges):
        low, high = edges[slot][0], edges[slot][-1]
        first = tuple(low[k] for k in keys)
        old = ahead and tuple(ahead[k] for k in keys)
        carried = [starts[k] if old is not None and old[: k + 1] == first[: k + 1] else base for k in range(len(keys))]
        if facts:
            facts[-1][3] = old == first
        facts.append([slot, base, high["at"] + 1, False, *carried, *(ahead[c] if ahead is not None else None for c in before)])
        starts = [base + high[c] if high[c] else carried[k] for k, c in enumerate(runs)]
        ahead, base = high, base + high["at"] + 1
    table = df.sparkSession.createDataFrame([tuple(f) for f in facts], "_slot int, _base long, _n long, _same boolean" + "".join(f", _first{k} long" for k in range(len(keys))) + "".join(f", _last{k} long" for k in range(len(before))))
    numbered = rows.join(F.broadcast(table), "_slot")
    at = F.col("_base") + F.col("at")
    out = [F.when(F.col(c) > 0, F.col("_base") + F.col(c)).otherwise(F.col(f"_first{k}")).alias(c) for k, c in enumerate(runs)]
    whole = F.when(F.col(runs[last_key]) > 0, F.col("_base") + F.col(runs[last_key])).otherwise(F.col(f"_first{last_key}"))
    alone = (whole == at) & F.col("_ends") & ~(F.col("_same") & (F.col("at") == F.col("_n") - 1))
    lag = [F.when(F.col("at") == 0, F.col(f"_last{k}")).otherwise(F.col(c)).alias(c) for k, c in enumerate(prevs)]
    return numbered.select(*kept, at.alias("at"), alone.alias("alone"), *out, *lag)


# ------------------------------------------------------------------ building


def _heads(data: bytes, start: int, stop: int) -> np.ndarray:
    """For each place: its first FIRST bytes and how many of them there are, as a number in the order of the suffixes."""
    a = np.zeros(stop - start + FIRST, np.uint64)
    part = np.frombuffer(data, np.uint8)[start : stop + FIRST]
    a[: len(part)] = part
    n = stop - start
    head = np.zeros(n, np.uint64)
    for k in range(FIRST):
        head = (head << np.uint64(8)) | a[k : k + n]
    left = np.minimum(len(data) - np.arange(start, stop), FIRST + 1).astype(np.uint64)
    return ((head << np.uint64(8)) | left).view(np.int64) ^ np.int64(-(1 << 63))


def _sheets(texts: DataFrame) -> DataFrame:
    """sheet, part, parts, docs, sizes, prior, data: the texts packed into sheets of up to ``SHEET`` bytes. A longer text has ``parts`` sheets of
    its own, numbered one after the other, each but the last of exactly that size, with the byte before it (else -1) and ``HEAD`` more bytes behind."""
    sheet, head = SHEET, HEAD

    def row(number, part, parts, ids, sizes, prior, content):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, part, parts, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), prior, content)], names=["sheet", "part", "parts", "docs", "sizes", "prior", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, docs, data = TaskContext.get().partitionId() << 40, 0, [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if len(text) > sheet:
                    parts = -(-len(text) // sheet)
                    for k in range(parts):
                        yield row(at + k, k, parts, [doc], [len(text)], text[k * sheet - 1] if k else -1, text[k * sheet : (k + 1) * sheet + head])
                    at += parts
                    continue
                if held + len(text) > sheet:
                    yield row(at, 0, 1, docs, [len(x) for x in data], -1, b"".join(data))
                    at, held, docs, data = at + 1, 0, [], []
                docs.append(doc)
                data.append(text)
                held += len(text)
        if held:
            yield row(at, 0, 1, docs, [len(x) for x in data], -1, b"".join(data))

    return texts.select("doc", "content").mapInArrow(run, "sheet long, part long, parts long, docs binary, sizes binary, prior long, data binary")


def _layout(sheet: int, part: int, parts: int, docs: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and length of the text of each byte of a sheet."""
    ids, lengths = np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.int64)
    if parts > 1:
        n = min(sheet, int(lengths[0]) - part * sheet)
        return np.full(n, ids[0]), np.arange(n) + part * sheet, np.full(n, lengths[0])
    n = int(lengths.sum())
    return np.repeat(ids, lengths), np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths)


def _batches(names: list[str], columns: list) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=names)


def _first_keys(sheets: DataFrame) -> DataFrame:
    """sheet, pos, k0, k1, ...: of every place its first ``HEAD`` bytes as numbers in their order, and how many of them there are."""
    sheet, head = SHEET, HEAD
    names = ["sheet", "pos", *(f"k{w}" for w in range(head // 8 + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part, parts, docs, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, off, size = _layout(sheet, part, parts, docs, sizes)
                n, left = len(off), size - off
                a = np.zeros(n + head, np.uint64)
                seen = np.frombuffer(data, np.uint8)[: n + head]
                a[: len(seen)] = seen
                keys = []
                for w in range(0, head, 8):
                    key = np.zeros(n, np.uint64)
                    for k in range(w, w + 8):
                        key = (key << np.uint64(8)) | np.where(left > k, a[k : k + n], np.uint64(0))
                    keys.append((key ^ np.uint64(1 << 63)).view(np.int64))
                yield from _batches(names, [np.full(n, number), np.arange(n), *keys, np.minimum(left, head + 1)])

    return sheets.select("sheet", "part", "parts", "docs", "sizes", "data").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _next_keys(state: DataFrame, k: int, long_texts: bool) -> DataFrame:
    """sheet, pos, r0, r1, ...: of every place that isn't settled its rank and those of the places k, 2 k, ... bytes on, -1 behind the text's end."""
    sheet, names = SHEET, ["sheet", "pos", *(f"r{j}" for j in range(TIMES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part, parts, docs, sizes, ranks, done, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, off, size = _layout(sheet, part, parts, docs, sizes)
                own = np.frombuffer(ranks, np.int64)
                known = {x["part"]: np.frombuffer(x["ranks"], np.int64) for x in others or ()}
                pos = np.flatnonzero(np.frombuffer(done, np.uint8) == 0)
                off, size = off[pos], size[pos]
                keys = [own[pos]]
                for j in range(1, TIMES):
                    then, there = np.full(len(pos), -1, np.int64), np.flatnonzero(off + j * k < size)
                    if parts == 1:
                        then[there] = own[pos[there] + j * k]
                    else:
                        at = off[there] + j * k
                        for p in np.unique(at // sheet):
                            mine = at // sheet == p
                            then[there[mine]] = known[int(p)][at[mine] % sheet]
                    keys.append(then)
                yield from _batches(names, [np.full(len(pos), number), pos, *keys])

    columns = ["sheet", "part", "parts", "docs", "sizes", "ranks", "done"]
    none = F.lit(None).cast("array<struct<part: long, ranks: binary>>").alias("others")
    left = state.filter("open and parts = 1").select(*columns, none)
    if long_texts:
        home = state.filter("open and parts > 1")
        steps = sorted({j * k // sheet + more for j in range(1, TIMES) for more in (0, 1)})
        want = home.select(F.col("sheet").alias("home"), "parts", (F.col("sheet") - F.col("part")).alias("base"), F.explode(F.transform(F.array(*map(F.lit, steps)), lambda x: x + F.col("part"))).alias("p")).filter("p < parts")
        read = state.filter("parts > 1").select(F.col("sheet").alias("there"), "ranks")
        met = want.join(read, F.col("base") + F.col("p") == F.col("there")).groupBy("home").agg(F.collect_list(F.struct(F.col("p").cast("long").alias("part"), "ranks")).alias("others"))
        left = left.unionByName(home.join(met, F.col("home") == F.col("sheet"), "left").select(*columns, "others"))
    return left.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _ranked(state: DataFrame, placed: DataFrame) -> DataFrame:
    """``state`` with new ranks (sheet, pos, rank, done): the numbers of a sheet's places lie side by side, so places k bytes apart meet without a join of places."""

    def merge(old: pa.Table, new: pa.Table) -> pa.Table:
        if not old.num_rows:
            return old
        pos, rank, done = (new.column(c).to_numpy() for c in ("pos", "rank", "done"))
        ranks, settled = np.frombuffer(old.column("ranks")[0].as_py(), np.int64).copy(), np.frombuffer(old.column("done")[0].as_py(), np.uint8).copy()
        if not len(ranks):
            ranks, settled = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.uint8)
        ranks[pos], settled[pos] = rank, done
        put = {"ranks": pa.array([ranks.tobytes()], pa.binary()), "done": pa.array([settled.tobytes()], pa.binary()), "open": pa.array([not settled.all()])}
        return pa.table({c: put.get(c, old.column(c)) for c in old.column_names})

    return saved(state.groupBy("sheet").cogroup(placed.groupBy("sheet")).applyInArrow(merge, state.schema), "state")


def _large_classes(texts: DataFrame) -> DataFrame:
    """t, off, r, left, byte of every place of different texts: r is the number of smaller suffixes, so only equal ones share one."""
    sheet = SHEET
    sheets = saved(_sheets(texts), "sheets")
    long_texts = bool(sheets.filter("parts > 1").take(1))
    keys = [f"k{w}" for w in range(HEAD // 8 + 1)]
    placed = positions(_first_keys(sheets), keys, [], "heads").select("sheet", "pos", F.col(f"run{len(keys) - 1}").alias("rank"), (F.col("alone") | (F.col(keys[-1]) <= HEAD)).alias("done"))
    empty = F.lit(b"").alias
    state, k = _ranked(sheets.select("sheet", "part", "parts", "docs", "sizes", empty("ranks"), empty("done"), F.lit(True).alias("open")), placed), HEAD
    while state.filter("open").take(1):
        keys = [f"r{j}" for j in range(TIMES)]
        at = positions(_next_keys(state, k, long_texts), keys, [], "pairs")
        placed = at.select("sheet", "pos", (F.col("r0") + F.col(f"run{TIMES - 1}") - F.col("run0")).alias("rank"), (F.col("alone") | (F.col(keys[-1]) < 0)).alias("done"))
        state, k = _ranked(state, placed), k * TIMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, parts, docs, sizes, prior, data, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, off, size = _layout(sheet, part, parts, docs, sizes)
                byte = np.concatenate([[prior], np.frombuffer(data, np.uint8)[: len(off) - 1].astype(np.int64)])
                yield from _batches(["t", "off", "r", "left", "byte"], [doc, off, np.frombuffer(ranks, np.int64), size - off, np.where(off > 0, byte, -1).astype(np.int32)])

    return state.select("sheet", "ranks").join(sheets, "sheet").select("part", "parts", "docs", "sizes", "prior", "data", "ranks").mapInArrow(run, "t long, off long, r long, left long, byte int")


def _prefixes(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """``rows`` (row, doc, off, prev_doc, prev_off, byte) with lcp: common bytes with the row before.

    A round compares ``window`` bytes of both suffixes, taken from slices of the texts; pairs that agree in all of them go on with a window
    eight times as long. What is read in all grows with the prefixes, not with the documents' squares.
    """
    names = ["row", "doc", "off", "prev_doc", "prev_off", "byte"]
    state, done, window = rows.withColumn("lcp", F.lit(0).cast("long")), [], WINDOW
    done.append(state.filter("prev_doc is null"))
    state = state.filter("prev_doc is not null")
    # the first position that differs, found by halving
    step = F.expr("""
        aggregate(sequence(0, 30), named_struct('lo', 0, 'hi', least(length(mine), length(theirs))),
          (s, i) -> if(s.lo >= s.hi, s,
            if(substring(mine, s.lo + 1, (s.lo + s.hi + 1) div 2 - s.lo) = substring(theirs, s.lo + 1, (s.lo + s.hi + 1) div 2 - s.lo),
               named_struct('lo', int((s.lo + s.hi + 1) div 2), 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi + 1) div 2) - 1))),
          s -> s.lo)""")
    while True:
        size = max(SLICE, window)
        text = corpus.filter("length(content) > 0").select(F.col("doc").alias("d"), "content", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / size).cast("int"))).alias("slice"))
        text = text.select("d", "slice", F.expr(f"substring(content, slice * {size} + 1, {size + window})").alias("t"))

        def read(df, doc, off, name, text=text, size=size, window=window):
            at = df.withColumn("_at", F.col(off) + F.col("lcp")).withColumn("_slice", F.floor(F.col("_at") / size).cast("int"))
            met = at.join(text, (F.col(doc) == F.col("d")) & (F.col("_slice") == F.col("slice")), "left")
            return met.withColumn(name, F.coalesce(F.expr(f"substring(t, int(_at % {size}) + 1, {window})"), F.lit(b""))).drop("d", "slice", "t", "_at", "_slice")

        both = read(read(state, "doc", "off", "mine"), "prev_doc", "prev_off", "theirs")
        got = saved(both.withColumn("step", step).select(*names, (F.col("lcp") + F.col("step")).alias("lcp"), (F.col("step") == window).alias("more")), "prefixes")
        done.append(got.filter("not more").drop("more"))
        state = got.filter("more").drop("more")
        if not state.take(1):
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out
        window *= 8


def _with_heads(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``classes`` with head: the common prefix of a suffix and the next smaller one that differs, read once for each different suffix."""
    one = positions(classes.select("r", "t", "off").dropDuplicates(["r"]), ["r"], [], "different", before=("t", "off"))
    rows = one.select(F.col("r").alias("row"), F.col("t").alias("doc"), "off", F.col("prev_t").alias("prev_doc"), F.col("prev_off"), F.lit(0).alias("byte"))
    heads = _prefixes(rows, texts).select(F.col("row").alias("r"), F.col("lcp").alias("head"))
    return classes.join(heads, "r")


def _large(corpus: DataFrame, small: int, prefixes: bool) -> DataFrame:
    """Copies of a text have the same suffixes in the same order, so only different texts are ranked; all documents' suffixes are then numbered by
    rank and document in one sort."""
    full = corpus.filter("length(content) > 0").select("doc", "content")
    texts = saved(full.groupBy("content").agg(F.min("doc").alias("doc")), "texts")
    if (texts.agg(F.sum(F.length("content"))).first()[0] or 0) <= small:
        classes = saved(_small_classes(texts), "classes")
    else:
        classes = saved(_large_classes(texts), "classes")
        if prefixes:
            classes = saved(_with_heads(classes, texts), "heads")
    members = saved(full.join(texts.select(F.col("doc").alias("t"), "content"), "content").select("t", "doc"), "members")
    columns = ["r", "off", "byte", *(["left", "head"] if prefixes else [])]
    rows = positions(members.join(classes, "t").select("doc", *columns), ["r"], ["doc"], "array", before=("doc",))
    lcp = F.when(F.col("at") > F.col("run0"), F.col("left")).otherwise(F.col("head")) if prefixes else F.lit(None)
    return rows.select(F.col("at").alias("row"), "doc", "off", lcp.cast("long").alias("lcp"), F.when(F.col("byte") >= 0, F.col("byte")).alias("byte"), "prev_doc")


def sort_in_memory(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place, common prefix and preceding byte (-1: none) of all suffixes of the texts, in their order; prefix doubling in numpy."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(texts)), sizes)
    off = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    key = np.concatenate([_heads(t, 0, len(t)) for t in texts]) if n else np.zeros(0, np.int64)
    k = FIRST
    while True:
        rank = np.unique(key, return_inverse=True)[1]
        if not n or rank.max() == n - 1 or k >= sizes.max():
            break
        then = np.zeros(n, np.int64)
        then[: max(n - k, 0)] = rank[k:] + 1
        then[np.arange(n) + k >= end] = 0
        key = rank * np.int64(n + 1) + then
        k *= 2
    order = np.argsort(rank, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8)
    lcp = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    a, b = order[1:], order[:-1]
    while len(open_):  # eight bytes at a time
        x, y = order[open_] + lcp[open_], order[open_ - 1] + lcp[open_]
        room = np.minimum(np.minimum(end[order[open_]] - x, end[order[open_ - 1]] - y), 8)
        same = np.zeros(len(open_), np.int64)
        going = room > 0
        for j in range(8):
            at = np.flatnonzero(going & (room > j))
            eq = data[x[at] + j] == data[y[at] + j]
            same[at[eq]] += 1
            going[:] = False
            going[at[eq]] = True
            if not len(at):
                break
        lcp[open_] += same
        open_ = open_[same == 8]
    del a, b
    byte = np.where(off[order] > 0, data[order - 1].astype(np.int64) if n else 0, -1)
    return doc[order], off[order], lcp, byte


def _small(corpus: DataFrame) -> DataFrame:
    """The same in one task, for a corpus whose size has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, t) for batch in batches for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
        rows.sort(key=lambda r: r[0])
        docs = np.array([r[0] for r in rows], np.int64)
        which, off, lcp, byte = sort_in_memory([r[1] for r in rows])
        doc = docs[which] if len(docs) else which
        for at in range(0, len(doc), 1 << 16):
            part = slice(at, min(len(doc), at + (1 << 16)))
            prev = np.concatenate([[0], doc[:-1]])[part]
            row = np.arange(part.start, part.stop)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(doc[part]), pa.array(off[part]), pa.array(lcp[part]), pa.array(byte[part].astype(np.int32), mask=byte[part] < 0), pa.array(prev, mask=row == 0)], names=["row", "doc", "off", "lcp", "byte", "prev_doc"]
            )

    return corpus.select("doc", "content").repartition(1).mapInArrow(run, _COLUMNS)


def _small_classes(texts: DataFrame) -> DataFrame:
    """t, off, r, left, byte, head of the places of different texts in one task, for texts whose size has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, t) for batch in batches for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        which, off, lcp, byte = sort_in_memory([t for _, t in rows])
        if not len(which):
            return
        left = np.array([len(t) for _, t in rows], np.int64)[which] - off
        same = np.zeros(len(which), bool)
        same[1:] = (lcp[1:] == left[1:]) & (left[1:] == left[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(which))))
        docs = np.array([d for d, _ in rows], np.int64)
        yield from _batches(["t", "off", "r", "left", "byte", "head"], [docs[which], off, first, left, byte.astype(np.int32), lcp[first]])

    return texts.select("doc", "content").repartition(1).mapInArrow(run, "t long, off long, r long, left long, byte int, head long")


def build(corpus: DataFrame, small: int | None = None, prefixes: bool = True) -> DataFrame:
    """The stored suffix array: row, doc, off, lcp (common prefix with the row before, 0 for the first), byte (the one before the suffix, null
    at a document's start), prev_doc (the row before's document). Written once in the shared folder; all that is read off it reads the table.
    Without ``prefixes`` the common prefixes of a large corpus are left out (null)."""
    small = SMALL if small is None else small
    size = corpus.agg(F.sum(F.length("content"))).first()[0] or 0
    return saved(_small(corpus), "suffix-array") if size <= small else _large(corpus, small, prefixes)


def suffix_array(corpus: DataFrame) -> DataFrame:
    """row, doc, off: all suffixes of all documents in their order."""
    return build(corpus, prefixes=False).select("row", "doc", "off")


# ------------------------------------------------------------------ an index on disk


@dataclass
class Index:
    """A stored index: the corpus, its suffix array, the documents of each chunk of rows, and the parameters it was built with."""

    corpus: DataFrame
    array: DataFrame
    chunks: DataFrame
    chunk: int


def write_index(corpus: DataFrame, path: str, chunk: int = CHUNK, files_n: int | None = None) -> None:
    """Build and store an index: ``corpus``, ``array``, ``chunks`` and ``bwt`` as Parquet under a path, in ``files_n`` files each if given."""
    write_files(corpus.select("doc", "info", "content"), f"{path}/corpus", files_n)
    array = build(corpus)
    write_files(array.withColumn("chunk", F.floor(F.col("row") / chunk)), f"{path}/array", files_n)
    write_files(chunk_map(array, chunk), f"{path}/chunks", files_n)
    write_files(bwt_chunks(array, chunk), f"{path}/bwt", files_n)
    corpus.sparkSession.createDataFrame([(chunk,)], "chunk int").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("corpus"), read("array").drop("chunk"), read("chunks"), read("parameters").first()["chunk"])


def chunk_map(array: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, docs: the distinct documents of each ``chunk`` rows, sorted; at most ``chunk`` of them."""
    return array.groupBy(F.floor(F.col("row") / chunk).alias("chunk")).agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def bwt_chunks(array: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, bytes (the bytes before its suffixes, in order; 0 where there is none), starts (the rows that begin a document)."""
    rows = array.groupBy(F.floor(F.col("row") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("row", "byte"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(F.coalesce(r["byte"], F.lit(0))), 2, "0")), "")
    return rows.select("chunk", F.unhex(text).alias("bytes"), F.transform(F.filter("rows", lambda r: r["byte"].isNull()), lambda r: r["row"]).alias("starts"))


# ------------------------------------------------------------------ what is read off


def bwt(array: DataFrame) -> DataFrame:
    """row, byte: the byte before each suffix, null at a document's start."""
    return array.select("row", "byte")


def _hits(array: DataFrame, corpus: DataFrame, s: bytes) -> DataFrame:
    """The array's rows whose suffixes begin with a string, in no order."""
    from bytequarry.operators import search
    from bytequarry.plans.syntax import raw

    return array.join(search.places(corpus, raw(s)).select("doc", F.col("offset").alias("off")), ["doc", "off"])


def occurrences(array: DataFrame, corpus: DataFrame, s: bytes) -> DataFrame:
    """row, doc, off, byte, next: the suffixes that begin with a string, in no order, and the byte behind it (null at a document's end)."""
    rows = _hits(array, corpus, s)
    byte = F.substring("content", (F.col("off") + len(s) + 1).cast("int"), F.lit(1))
    return rows.join(corpus.select("doc", "content"), "doc").select("row", "doc", "off", "byte", F.when(F.length(byte) > 0, F.conv(F.hex(byte), 16, 10).cast("int")).alias("next"))


def row_range(array: DataFrame, corpus: DataFrame, s: bytes) -> DataFrame:
    """first, last: the rows whose suffixes begin with a string; nulls if there are none."""
    return _hits(array, corpus, s).agg(F.min("row").alias("first"), F.max("row").alias("last"))


def rows_right(array: DataFrame, corpus: DataFrame, s: bytes) -> DataFrame:
    """byte, first, last: for each byte behind a string, the rows of the string with that byte."""
    return occurrences(array, corpus, s).filter("next is not null").groupBy(F.col("next").alias("byte")).agg(F.min("row").alias("first"), F.max("row").alias("last"))


def rows_left(array: DataFrame, corpus: DataFrame, s: bytes) -> DataFrame:
    """byte, first, last: for each byte before a string, the rows of that byte with the string."""
    hits = _hits(array, corpus, s).filter("byte is not null").select("doc", (F.col("off") - 1).alias("off"), "byte")
    return hits.join(array.select("doc", "off", "row"), ["doc", "off"]).groupBy("byte").agg(F.min("row").alias("first"), F.max("row").alias("last"))


def backward_search(array: DataFrame, first: int, last: int, byte: int) -> DataFrame:
    """first, last: from the rows of a string to the rows of a byte and that string; nulls if there are none."""
    hits = array.filter(F.col("row").between(first, last) & (F.col("byte") == byte)).select("doc", (F.col("off") - 1).alias("off"))
    return hits.join(array.select("doc", "off", "row"), ["doc", "off"]).agg(F.min("row").alias("first"), F.max("row").alias("last"))


def docs_for_range(array: DataFrame, first: int, last: int) -> DataFrame:
    return array.filter(F.col("row").between(first, last)).select("doc").distinct()


def docs_by_chunks(index: Index, first: int, last: int) -> DataFrame:
    """The same from a stored index: whole chunks give their lists, and only the rows at both ends are read one by one."""
    a, b = -(-first // index.chunk), (last + 1) // index.chunk
    if a >= b:
        return docs_for_range(index.array, first, last)
    inner = index.chunks.filter(F.col("chunk").between(a, b - 1)).select(F.explode("docs").alias("doc"))
    edge = index.array.filter(F.col("row").between(first, a * index.chunk - 1) | F.col("row").between(b * index.chunk, last)).select("doc")
    return inner.unionByName(edge).distinct()


def locate(array: DataFrame, rows: DataFrame) -> DataFrame:
    """row, doc, off of given rows (column ``row``)."""
    return array.select("row", "doc", "off").join(rows, "row")


def step_back(array: DataFrame) -> DataFrame:
    """row, back, byte: the row of the suffix that is one byte longer, and that byte."""
    longer = array.select("doc", (F.col("off") + 1).alias("off"), F.col("row").alias("back"))
    return array.join(longer, ["doc", "off"]).select("row", "back", "byte")


def step_forward(array: DataFrame) -> DataFrame:
    """row, forward, byte: the row of the suffix that is one byte shorter, and the byte that it lacks; none for a document's last byte."""
    shorter = array.select("doc", (F.col("off") - 1).alias("off"), F.col("row").alias("forward"), "byte")
    return array.select("row", "doc", "off").join(shorter, ["doc", "off"]).select("row", "forward", "byte")
