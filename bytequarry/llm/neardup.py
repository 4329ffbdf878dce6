"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, connected components.

1. One map gives each text its set of word shingles (64-bit hashes), a SuperMinHash signature of ``BANDS * ROWS``
   ranks and a 128-bit fingerprint of the set. Ranks of an element come from one random permutation, so they are
   correlated and the signature varies less than MinHash's; the ranks are made one after the other and stop as soon
   as no later one can lower any minimum of the document.
2. Equal sets collapse to the smallest id; with partial aggregation a group of any size is a few rows.
3. Representatives that share a band meet in a bucket. Each is compared with the bucket's smallest id only, so a bucket
   of n gives n - 1 pairs; leaders with many partners are split by a salt. Pairs are verified on the full sets.
4. Components of these links; then in buckets where more than one component is left, the members outside the largest one are
   compared with all others, in tasks that hold two blocks of about ``BLOCK`` of them; pairs that their signatures don't exclude
   are verified, so that no link that joins two components is lost. Nothing is capped, and only links leave the tasks.

A link at the threshold of 0.85 is missed by all 24 bands of 5 rows with a chance below 1e-6; at 0.8 the same takes 36 bands.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm._common import free_name, materialise, mix64, tidy

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 5
#: Members of a bucket that are compared with each other in one task.
BLOCK = 256
#: A pair whose estimated similarity lies this far under the threshold isn't verified; over four standard deviations.
SLACK = 0.15
#: Partners of a leader that are verified in one group.
SALT = 64
#: Tasks to which the rows of a bucket are dealt where they meet the bucket's leader or components.
SPREAD = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; only a longer single word takes more.
_BYTES = 1 << 18


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, 2 ** bits of each."""
    out = []
    for p in (_P, _P_INV):
        a = np.ones(1, np.uint64)
        for k in range(bits):
            a = np.concatenate([a, a * np.uint64(pow(p, 1 << k, 1 << 64))])
        out.append(a)
    return out[0], out[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes but white space), and where they start."""
    a = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~_SPACE[a], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(_BYTES.bit_length(), len(a).bit_length()))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start]), start


def _hash_words(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; pieces of about _BYTES are hashed at once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    parts: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal parts, size
        if parts:
            h, start = _word_hashes(b"\n".join(p for _, p in parts))
            cut = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for _, p in parts)]))
            for (k, _), a, b in zip(parts, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[k].append(h[a:b])
        parts, size = [], 0

    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + _BYTES)
            while end < len(t) and not _SPACE[t[end]]:
                end += 1
            parts.append((k, t[at:end]))
            size += end - at
            at = end
            if size >= _BYTES:
                flush()
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text; of fewer words, the one hash of all."""
    out = []
    for w in _hash_words([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]):
        n = min(k, len(w))
        if not n:
            out.append(w)
            continue
        s = w[: len(w) - n + 1] + np.uint64(n)
        for j in range(1, n):
            s = s * _GOLD + w[j : len(w) - n + 1 + j]
        out.append(np.unique(mix64(s)))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of non-empty sets of 64-bit hashes; all sets advance rank by rank together."""
    sizes = np.array([len(s) for s in sets])
    el = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    h = np.full(len(sets) * m, np.inf)
    perm = None
    for j in range(m):
        x = mix64(el + np.uint64((2 * j + 1) * int(_GOLD) % (1 << 64)))
        y = mix64(x ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
        pos = j + ((y * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j:
            row = np.arange(len(el))
            at = pos
            pos = perm[row, at].astype(np.int64)
            perm[row, at] = perm[:, j]
        np.minimum.at(h, doc * m + pos, (x >> np.uint64(11)) * 2.0**-53 + j)
        open_ = h.reshape(-1, m).max(1) > j + 1
        keep = open_[doc]
        if not keep.any():
            break
        if j == 0:
            el, doc, pos = el[keep], doc[keep], pos[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16 if m <= 1 << 16 else np.int64), (len(el), 1))
            perm[np.arange(len(el)), pos] = 0
        elif not keep.all():
            el, doc, perm = el[keep], doc[keep], perm[keep]
    return h.reshape(-1, m)


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (sets x bands), one-byte sketches (sets x bands * rows), fingerprints (sets x 2), in groups of sets of bounded size."""
    keys, sketches, prints = [], [], []
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 100_000):
            size += len(sets[end])
            end += 1
        sig = superminhash(sets[at:end], bands * rows).view(np.uint64)
        mixed = mix64(sig * _GOLD + np.arange(bands * rows, dtype=np.uint64))
        key = np.zeros((end - at, bands), np.uint64)
        for r in range(rows):
            key = mix64(key + mixed.reshape(-1, bands, rows)[:, :, r])
        keys.append(key)
        sketches.append((mixed >> np.uint64(56)).astype(np.uint8))
        el = np.concatenate(sets[at:end])
        first = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        prints.append(np.stack([np.add.reduceat(mix64(el ^ np.uint64(c)), first) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)], 1))
        at = end
    return np.concatenate(keys), np.concatenate(sketches), np.concatenate(prints)


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc, n (set size), p1, p2 (fingerprint), bands, sketch of every row; no bands and sketch for an empty set."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, 500)
                at += 500
                sets = shingle_sets(piece.column(1).to_pylist(), shingle)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((0, bands), np.uint64)
                prints = np.zeros((len(sets), 2), np.uint64)
                sketch: list = [None] * len(sets)
                if len(full):
                    keys, sk, prints[full] = _signatures([sets[i] for i in full.tolist()], bands, rows)
                    for i, s in zip(full.tolist(), sk, strict=True):
                        sketch[i] = s.tobytes()
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                prints = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists, pa.array(sketch, pa.binary())], names=["doc", "n", "p1", "p2", "bands", "sketch"])

    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(lambda batches: tidy(run(batches)), f"doc {kind}, n long, p1 long, p2 long, bands array<long>, sketch binary")


def _verify(pairs: DataFrame, texts: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full sets reach the threshold. A leader's text goes once to about every SALT of its partners.

    ``size`` is that of the largest bucket where a pair met, so the parts of a leader are known without counting its pairs in one task.
    """
    salted = pairs.select("a", "b", F.expr(f"pmod(xxhash64(b), ceil(size / {SALT}))").alias("salt"))
    work = salted.select("a", "salt", F.col("b").alias("doc"), F.lit(1).alias("side")).unionByName(salted.select("a", "salt", F.col("a").alias("doc"), F.lit(0).alias("side")).distinct())
    joined = work.join(texts.hint("merge"), "doc").select("a", "salt", "side", "doc", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def run(batches):
        group, leaders = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                a, salt, side, doc = (piece.column(i).to_pylist() for i in range(4))
                left, right = [], []
                for x, s, who, d, own in zip(a, salt, side, doc, shingle_sets(piece.column(4).to_pylist(), shingle), strict=True):
                    if (x, s) != group:
                        group, leaders = (x, s), []
                    if who == 0:
                        leaders.append(own)
                        continue
                    for other in leaders:
                        few, more = sorted((len(own), len(other)))
                        if few and 100 * few >= percent * more:
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if 100 * both >= percent * (few + more - both):
                                left.append(x)
                                right.append(d)
                                break
                yield pa.RecordBatch.from_arrays([pa.array(left, piece.column(0).type), pa.array(right, piece.column(0).type)], names=["a", "b"])

    return joined.mapInArrow(lambda batches: tidy(run(batches)), f"a {kind}, b {kind}").distinct()


class _Unit:
    """The left side of one pair of blocks: members outside the bucket's main component, as (bucket, i, j, side, leader, doc, comp, main, n, sketch, bands)."""

    def __init__(self, key: tuple, least: float):
        self.key, self.least, self.rows, self.cols = key, least, [], None

    def add(self, row: tuple) -> None:
        self.rows.append(row)

    def partners(self, row: tuple) -> list[int]:
        """Left rows of other components that size and sketch don't exclude as links of a row of the right side, best first.

        A pair that shares several bands counts in the first of them only, one with the leader has been verified, and of two
        members that are both outside the main component the smaller is on the left.
        """
        if not self.rows:
            return []
        if self.cols is None:
            c = list(zip(*self.rows, strict=True))
            self.cols = np.array(c[6], object), np.array(c[8], float), np.frombuffer(b"".join(c[9]), np.uint8).reshape(len(c[9]), -1), np.array(c[10], np.int64)
        comp, n, sketch, bands = self.cols
        at = np.flatnonzero((comp != row[6]) & (np.minimum(n, row[8]) >= (self.least + SLACK) * np.maximum(n, row[8]) - 1e-9))
        if not len(at):
            return []
        like = (sketch[at] == np.frombuffer(row[9], np.uint8)).mean(1)
        same = bands[at] == np.array(row[10], np.int64)
        ok = (like >= self.least) & (np.array(row[10], np.int64)[same.argmax(1)] == row[0])
        at = at[ok][np.argsort(-like[ok], kind="stable")]
        both = row[6] != row[7]
        return [k for k in at.tolist() if row[4] not in (row[5], self.rows[k][5]) and (not both or self.rows[k][5] < row[5])]


def _rest(members: DataFrame, texts: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame:
    """Links between the members of a bucket that its leader left in several components. members: bucket, leader, doc, comp, main, others, size, n, sketch, bands.

    Only the ``others``, members outside the bucket's largest component, look for links: each block of them meets each block of all
    members. A first pass on sketches finds the rows that have any open pair; only their texts go to the second, which verifies the
    pairs where they meet and gives the links that join components, never the pairs.
    """
    least = percent / 100 - SLACK
    names = ["bucket", "i", "j", "side", "leader", "doc", "comp", "main", "n", "sketch", "bands"]
    schema = f"bucket long, i int, j int, side int, leader {kind}, doc {kind}, comp {kind}, main {kind}, n long, sketch binary, bands array<long>"
    parts = members.withColumn("mb", F.ceil(F.col("others") / BLOCK).cast("int")).withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    right = parts.withColumn("j", F.expr("int(pmod(xxhash64(doc), nb))")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("side", F.lit(1))
    left = parts.filter("comp <> main").withColumn("i", F.expr("int(pmod(xxhash64(doc, 1), mb))")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))

    def units(batches, step):
        """(unit, row) of every right row, and (unit, None) behind the last of a unit."""
        unit = None
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, step).columns), strict=True):
                    if unit is None or row[:3] != unit.key:
                        if unit is not None:
                            yield unit, None
                        unit = _Unit(row[:3], least)
                    if row[3] == 0:
                        unit.add(row)
                    yield unit, row
        if unit is not None:
            yield unit, None

    def open_rows(batches):
        found, needed = [], set()
        for unit, row in units(batches, 1000):
            if row is None:
                found += [unit.rows[k] for k in sorted(needed)]
                needed = set()
            elif row[3] and (at := unit.partners(row)):
                needed.update(at)
                found.append(row)
            if len(found) >= 1000 or row is None and found:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=arrow)
                found = []

    def verify(batches):
        links, sets, up, current = [], [], {}, None

        def root(c):
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for unit, row in units(batches, 64):
            if unit is not current:
                current, sets, up = unit, [], {}
            if row is None:
                if links:
                    yield pa.RecordBatch.from_pylist([{"a": min(p), "b": max(p)} for p in links], schema=pair)
                links = []
            elif row[3] == 0:
                sets.append(shingle_sets([row[11]], shingle)[0])
            else:
                own = None
                for k in unit.partners(row):
                    if (c := root(unit.rows[k][6])) != (d := root(row[6])):
                        own = shingle_sets([row[11]], shingle)[0] if own is None else own
                        both = len(np.intersect1d(sets[k], own, assume_unique=True))
                        if both and 100 * both >= percent * (len(sets[k]) + len(own) - both):
                            up[c] = d
                            links.append((unit.rows[k][5], row[5]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, pair = to_arrow_schema(StructType.fromDDL(schema)), to_arrow_schema(StructType.fromDDL(f"a {kind}, b {kind}"))
    order = ("bucket", "i", "j", "side")
    needed = left.select(*names).unionByName(right.select(*names)).repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(open_rows, schema)
    with_text = needed.join(texts.hint("merge"), "doc").select(*names, "text").repartition(*order[:3]).sortWithinPartitions(*order)
    return with_text.mapInArrow(lambda batches: tidy(verify(batches)), f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest id that each end of an edge (a, b) reaches, itself included where it isn't the smallest.

    Alternating large-star and small-star rounds; each round is written in the shared folder, and two equal rounds end it.
    """
    state = materialise(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    seen = None
    while True:
        sums = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (sums["n"], sums["s"]) or not sums["n"]:
            return state.select(F.col("v").alias("doc"), F.col("u").alias("comp"))
        seen = (sums["n"], sums["s"])
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        state = materialise(large.join(low, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v")).distinct(), "star")


def group_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Links join texts whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more. A text that is null,
    empty or only white space has no shingles, is linked with nothing and is kept. Rows that repeat an id are one
    document: they share its component and the flag. A row without an id is linked with nothing, has a null component
    and is kept. Texts are compared whole, of any length; a similarity of just ``percent`` links; an empty table gives no rows.
    Any orderable type of id serves; other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sig = materialise(signatures(df, id_col, text_col, shingle, bands, rows), "signatures")
    full = sig.filter("n > 0 and doc is not null")
    reps = materialise(full.groupBy("p1", "p2", "n").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    links = _links(reps, df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), sig, kind, shingle, percent)
    comp = components(links)
    by_set = reps.select("p1", "p2", F.col("n").alias("n_"), "rep")
    same = full.select("doc", "p1", "p2", "n").join(by_set.withColumnRenamed("p1", "q1").withColumnRenamed("p2", "q2"), F.expr("p1 = q1 and p2 = q2 and n = n_"))
    found = same.join(comp.withColumnRenamed("doc", "rep_"), F.col("rep") == F.col("rep_"), "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    alone = sig.filter("n = 0 or doc is null").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(reps: DataFrame, texts: DataFrame, sig: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that give the components of the representatives, and links between ids that repeat."""
    met = reps.select("rep", F.explode("bands").alias("bucket"))
    leads = met.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(_by_bucket(met.withColumnRenamed("rep", "doc"), leads).select("bucket", "leader", "size", "doc"), "buckets")
    pairs = materialise(members.filter("doc <> leader").groupBy(F.col("leader").alias("a"), F.col("doc").alias("b")).agg(F.max("size").alias("size")), "pairs")
    # the ids have no bound, so the texts that are needed are found by a merge join; both steps below then use these only
    texts = materialise(texts.join(members.select("doc").distinct().hint("merge"), "doc", "left_semi"), "texts")
    # an id whose rows hold different sets is one document: the smaller ids of its sets belong together
    own = sig.filter("n > 0 and doc is not null").select("doc", "p1", "p2", "n").distinct()
    twice = own.join(own.groupBy("doc").count().filter("count > 1").select("doc"), "doc").join(reps.select("p1", "p2", "n", "rep"), ["p1", "p2", "n"])
    links = materialise(_verify(pairs, texts, kind, shingle, percent).unionByName(twice.filter("rep <> doc").select(F.col("rep").alias("a"), F.col("doc").alias("b"))).distinct(), "links")
    comp = components(links)
    labelled = members.filter("size > 2").join(comp.withColumnRenamed("doc", "doc_"), F.col("doc") == F.col("doc_"), "left").select("bucket", "leader", "size", "doc", F.coalesce("comp", "doc").alias("comp"))
    counts = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).filter("top.n < all").select("bucket", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.n")).alias("others"))
    open_ = _by_bucket(labelled, several).join(reps.select(F.col("rep").alias("doc"), "n", "sketch", "bands"), "doc")
    more = materialise(_rest(open_, texts, kind, shingle, percent), "more-links")
    return links.unionByName(more)


def _by_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (bucket, doc, ...) joined with their bucket's facts; a bucket's rows are dealt to SPREAD tasks, its one row of facts to each."""
    spread = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("part", F.expr(f"int(pmod(xxhash64(doc), {SPREAD}))")).join(spread, ["bucket", "part"]).drop("part")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of ``df``, unchanged, of each group of near copies: that with the smallest id.

    Rows with a null, empty or blank text are linked with nothing and stay. Where ids repeat or are null, every row is a document of
    its own, in the order of id (nulls first) and text, so copies of a row become one and unlike texts under one id all stay.
    Texts are compared whole, of any length. An empty table gives an empty one; columns may have any names.
    """
    own = df.select(F.col(id_col).alias("id")).groupBy("id").count().filter("count > 1 or id is null")
    repeated = bool(own.take(1))
    key = free_name(df.columns, "row_key") if repeated else id_col
    if repeated:
        df = materialise(df.orderBy(id_col, text_col).withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = group_near_duplicates(df, key, text_col, percent=percent, bands=bands, rows=rows)
    gone = free_name(df.columns, "gone")
    kept = df.join(groups.filter(~F.col("kept")).select(F.col(key).alias(gone)), F.col(key) == F.col(gone), "left_anti")
    return kept.drop(key) if repeated else kept
