"""Frequent and unique substrings, and unique k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.operators.suffixes import build, saved

#: Rows of a suffix array that a window takes at once.
BLOCK = 1 << 16


def frequent_substrings(corpus: DataFrame, least: int, most: int | None = None, suffix: bytes = b"", longest: int = 1024, percent: float = 0.0, most_percent: float | None = None) -> DataFrame:
    """s (binary), n: strings that end in ``suffix`` and occur ``least`` to ``most`` times, but for those with a longer frequent one on the left.

    Percentages are of the suffix's own occurrences (of all places without one); the larger of both least counts holds, and the smaller of both most counts.

    Breadth first: a round takes the places of strings that are frequent, adds the byte before each and counts.
    A place leaves as soon as its string isn't frequent, and no string is looked at twice.
    """
    text = corpus.select("doc", F.col("content").alias("t"))
    m = max(1, len(suffix))
    begin = text.filter(F.length("t") >= m).select("doc", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("t") - m + 1), lambda i: F.substring("t", i, F.lit(m)))).alias("off", "s"))
    state = begin.filter(F.col("s") == F.lit(suffix)) if suffix else begin
    if percent or most_percent is not None:
        everything = state.count() if suffix else begin.count() + text.filter(F.length("t") < m).agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
        least = max(least, -int(-everything * percent // 100))
        if most_percent is not None:
            most = min(everything if most is None else most, int(everything * most_percent // 100))
    inside = (F.col("n") >= least) & (F.col("n") <= most if most is not None else F.lit(True))
    found, length = None, m
    while True:
        counted = state.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        level = saved(counted.filter(F.col("n") >= least), "level")
        if not level.take(1):
            break
        good = level.filter(inside).select("s", "n")
        found = good if found is None else found.unionByName(good)
        if length >= longest:
            break
        kept = state.join(level.select("s"), "s", "left_semi")
        longer = kept.filter("off > 0").join(text, "doc").select("doc", (F.col("off") - 1).alias("off"), F.concat(F.substring("t", F.col("off").cast("int"), F.lit(1)), "s").alias("s"))
        state = saved(longer, "places")
        length += 1
    if found is None:
        return corpus.sparkSession.createDataFrame([], "s binary, n long")
    shorter = found.select(F.expr("substring(s, 2)").alias("s")).distinct()
    return found.join(shorter, "s", "left_anti").select("s", "n")


def minimal_unique(array: DataFrame, corpus: DataFrame, longest: int = 255) -> DataFrame:
    """doc, off, length: the shortest string from each place that occurs in no other document, where none shorter ends as far.

    ``array`` is a stored suffix array. A place's length is one more than the longest prefix that it shares with the
    nearest row of another document on either side; it is left out beyond ``longest``, beyond the document's end and where the next place's is shorter.
    With a single document the nearest rows of that document count.
    """
    sizes = corpus.select("doc", F.length("content").alias("size"))
    if sizes.count() <= 1:
        after = array.select((F.col("row") - 1).alias("row"), F.col("lcp").alias("next_lcp"))
        both = array.join(after, "row", "left").select("doc", "off", F.greatest("lcp", F.coalesce("next_lcp", F.lit(0))).alias("shared"))
    else:
        both = _nearest_other(array)
    state = saved(both.join(sizes, "doc").select("doc", "off", "size", (F.col("shared") + 1).alias("length")), "shortest")
    following = state.select("doc", (F.col("off") - 1).alias("off"), F.col("length").alias("next_length"))
    joined = state.join(following, ["doc", "off"], "left")
    return joined.filter((F.col("length") <= longest) & (F.col("off") + F.col("length") <= F.col("size")) & ~(F.coalesce(F.col("next_length"), F.lit(1 << 30)) < F.col("length"))).select("doc", "off", "length")


def _nearest_other(array: DataFrame) -> DataFrame:
    """doc, off, shared: the longest prefix shared with any suffix of another document.

    Rows of a document in a row form a run. A run's first row meets the run before through its own lcp, the others through the least lcp since,
    and all meet the run behind through the least lcp up to its first row. Windows see the part of a run in one block of rows; what a run
    brings from the blocks before or behind is one number a block, so a run of any length is never one task's.
    """
    edge = F.col("prev_doc").isNull() | (F.col("prev_doc") != F.col("doc"))
    rows = array.select("row", "doc", "off", "lcp", F.floor(F.col("row") / BLOCK).alias("block"), F.when(edge, F.col("row")).alias("edge"))
    # frames only grow from their start; one that shrinks to its end would be read anew for every row
    by, back = Window.partitionBy("block").orderBy("row"), Window.partitionBy("block").orderBy(F.desc("row"))
    to_here, before_here = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    placed = rows.withColumn("run", F.max("edge").over(by.rowsBetween(*to_here))).withColumn("then", F.last(F.when(F.col("edge").isNotNull(), F.col("lcp")), ignorenulls=True).over(back.rowsBetween(*before_here)))
    run, run_back = Window.partitionBy("block", "run").orderBy("row"), Window.partitionBy("block", "run").orderBy(F.desc("row"))
    inner = placed.withColumn("a", F.min("lcp").over(run.rowsBetween(*to_here))).withColumn("b", F.min("lcp").over(run_back.rowsBetween(*before_here)))
    inner = saved(inner.select("row", "doc", "off", "lcp", "block", "run", "then", "a", "b"), "runs")
    # of each block: the least lcp of its last run, or of all of it where no run begins; and up to the first edge, likewise
    last = inner.groupBy("block").agg(F.max("run").alias("last"), F.min("run").alias("first"))
    facts = inner.join(last, "block").groupBy("block").agg(
        F.max(F.col("last").isNotNull()).alias("cut"),
        F.min(F.when(F.col("run").eqNullSafe(F.col("last")), F.col("lcp"))).alias("tail"),
        F.min(F.when(F.col("first").isNull() | (F.col("row") <= F.col("first")), F.col("lcp"))).alias("head"),
    )

    def carried(value: str, order) -> DataFrame:
        # blocks without an edge pass on what they got: a running minimum that starts anew behind each block with one
        line = Window.orderBy(order)
        part = F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return facts.withColumn("part", part).withColumn("run_min", F.min(value).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("got", F.lag("run_min").over(line)).select("block", "got")

    before = carried("tail", F.col("block")).withColumnRenamed("got", "before")
    behind = carried("head", F.col("block").desc()).withColumnRenamed("got", "behind")
    least = inner.join(before, "block").join(behind, "block")
    a = F.when(F.col("run").isNotNull(), F.col("a")).otherwise(F.least("a", F.coalesce("before", F.lit(0))))
    b = F.when(F.col("then").isNotNull(), F.least("b", "then")).otherwise(F.least("b", F.coalesce("behind", F.lit(0))))
    return least.select("doc", "off", F.greatest(a, b).alias("shared"))


def unique_statistics(unique: DataFrame) -> DataFrame:
    """doc, n, least, mean, most of the lengths of a document's unique strings."""
    return unique.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least"), F.avg("length").alias("mean"), F.max("length").alias("most"))


def unique_histogram(unique: DataFrame) -> DataFrame:
    """doc, length, n, upto: how many unique strings have each length, and at most that."""
    by = unique.groupBy("doc", "length").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("upto", F.sum("n").over(Window.partitionBy("doc").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)))


def drop_near_copies(corpus: DataFrame, least: int = 10, tries: int = 10, size: int = 1000, common: int = 60) -> DataFrame:
    """doc, step, score, other: documents to leave out so that the rest have ``least`` minimal unique strings each.

    Documents short of that are near copies. A step leaves out half of them (one at least), first those that are most similar, by
    blocks of common prefixes, to a document that isn't a near copy (``other``, with its ``score``); if none is similar to any, the one
    with the fewest unique strings. Then the strings are counted anew without what has been left out. Steps end when there are no near copies or after ``tries`` counts.
    """
    spark, array = corpus.sparkSession, build(corpus)
    alike = saved(_both_ways(array, corpus, size, common), "alike")
    gone = saved(spark.createDataFrame([], "doc long, step int, score double, other long"), "gone")
    for step in range(1, tries):
        left = corpus.join(gone.select("doc"), "doc", "left_anti") if step > 1 else corpus
        unique = minimal_unique(build(left) if step > 1 else array, left)
        counts = saved(left.select("doc").join(unique.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "left").fillna(0, ["n"]), "counts")
        near = counts.filter(F.col("n") < least)
        n = near.count()
        if not n:
            break
        sound = counts.filter(F.col("n") >= least).select(F.col("doc").alias("other"))
        best = alike.join(near.select("doc"), "doc").join(sound, "other").groupBy("doc").agg(F.max(F.struct(F.col("score"), (-F.col("other")).alias("low"))).alias("b"))
        half = best.select("doc", F.lit(step).alias("step"), F.col("b.score").alias("score"), (-F.col("b.low")).alias("other")).orderBy(F.desc("score"), F.desc("doc")).limit(max(1, n // 2))
        half = saved(half, "half")
        if not half.take(1):
            half = counts.orderBy("n", "doc").limit(1).select("doc", F.lit(step).alias("step"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("other"))
        gone = saved(gone.unionByName(half), "gone")
    return gone


def _both_ways(array: DataFrame, corpus: DataFrame, size: int, common: int) -> DataFrame:
    from bytequarry.operators.similarity import blocked

    pairs = saved(blocked(array, corpus, size, common).filter("score > 0"), "pairs")
    return pairs.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other"), "score").unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("doc_a").alias("other"), "score"))


def unique_bytes(unique: DataFrame, corpus: DataFrame, bar: bytes = b"", slice_size: int = 1 << 16) -> DataFrame:
    """doc, slice, bytes: one byte for each place of a document, in slices: the length of the minimal unique string there, 0 for none.
    Where the text has ``bar``, as sequence files have between sequences, the byte is the bar itself."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    text = corpus.filter("length(content) > 0").select("doc", "content", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / slice_size).cast("int"))).alias("slice"))
    parts = text.select("doc", "slice", F.expr(f"substring(content, slice * {slice_size} + 1, {slice_size})").alias("t"))
    own = unique.groupBy("doc", F.floor(F.col("off") / slice_size).cast("int").alias("slice")).agg(F.collect_list((F.col("off") % slice_size).cast("int")).alias("at"), F.collect_list(F.col("length").cast("int")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, at, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                x = np.zeros(len(t), np.uint8)
                if at:
                    x[np.array(at)] = np.array(n)
                if bar:
                    x[np.frombuffer(t, np.uint8) == bar[0]] = bar[0]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "slice", "bytes"])

    return parts.join(own, ["doc", "slice"], "left").select("doc", "slice", "t", "at", "n").mapInArrow(run, "doc long, slice int, bytes binary")


def unique_kmers(unique: DataFrame, corpus: DataFrame, k: int | None = None, shifts: bool = False, bar: str = ">") -> DataFrame:
    """doc, off, kmer (string of one character a byte): the unique strings, or windows of ``k`` bytes centred on them, or all windows around them."""
    text = corpus.select("doc", F.decode("content", "ISO-8859-1").alias("t"))
    rows = unique.join(text, "doc")
    if k is None:
        rows = rows.withColumn("at", F.col("off")).withColumn("size", F.col("length"))
    elif shifts:
        rows = rows.filter(F.col("length") <= k).withColumn("size", F.lit(k)).withColumn("at", F.explode(F.sequence(F.col("off") + F.col("length") - k, F.col("off"))))
    else:
        rows = rows.filter(F.col("length") <= k).withColumn("size", F.lit(k)).withColumn("at", F.col("off") - F.floor((F.lit(k) - F.col("length")) / 2))
    rows = rows.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("t")))
    out = rows.select("doc", F.col("at").cast("long").alias("off"), F.expr("substring(t, int(at) + 1, int(size))").alias("kmer")).distinct()
    return out.filter(~F.contains("kmer", F.lit(bar))) if bar else out


def complexity(kmer: Column) -> Column:
    """Entropy of the 1- to 5-mers of a DNA string, as a share of the largest there could be; at most 5 letters give 0."""
    def entropy(n: int) -> Column:
        count = F.length(kmer) - n + 1
        grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(kmer, i, F.lit(n)))
        parts = F.transform(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)) / count)
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    total = entropy(1) + entropy(2) + entropy(3) + entropy(4) + entropy(5)
    most = F.lit(12.0) + F.log2((F.length(kmer) - 3).cast("double")) + F.log2((F.length(kmer) - 4).cast("double"))
    return F.when(F.length(kmer) <= 5, F.lit(0.0)).otherwise(total / most)


def complex_enough(kmers: DataFrame, least: float = 0.65) -> DataFrame:
    """The k-mers whose complexity is over ``least``; none of up to five letters is."""
    return kmers.filter((F.length("kmer") > 5) & (complexity(F.col("kmer")) > least))


def as_fasta(kmers: DataFrame, corpus: DataFrame) -> DataFrame:
    """value: a header with the document's info and the place, and the k-mer on a line of its own."""
    return kmers.join(corpus.select("doc", "info"), "doc").select(F.concat(F.lit(">"), "info", F.lit(":"), F.col("off").cast("string"), F.lit("\n"), "kmer").alias("value"))


def as_tsv(kmers: DataFrame, corpus: DataFrame) -> DataFrame:
    """value: k-mer, info and place, with tabs between them."""
    return kmers.join(corpus.select("doc", "info"), "doc").select(F.concat_ws("\t", "kmer", "info", F.col("off").cast("string")).alias("value"))
