"""Queries on suffix arrays, mining, similarity, winnowing, sources and sinks, with DuckDB SQL by definition for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions.octets import sha256_of
from bytequarry.operators import mining, search, similarity, suffixes, winnow
from bytequarry.plans.planner import Engine
from bytequarry.plans.rewrites import leaves, prepare
from bytequarry.plans.syntax import parse
from bytequarry.sources import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Part names: a corpus of short texts."""
    return C.from_table(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return C.from_table(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{suffixes.shared_dir(spark)}/bytequarry/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ suffix arrays

_SUFFIXES = "s AS (SELECT p_partkey AS doc, CAST(i - 1 AS BIGINT) AS off, substr(p_name, i) AS suffix, p_name FROM part, unnest(range(1, length(p_name) + 1)) u(i)), sa AS (SELECT row_number() OVER (ORDER BY suffix, doc, off) - 1 AS row, * FROM s)"
_COMMON = "len(list_filter(range(1, least(length(suffix), length(prev)) + 1), lambda i: left(suffix, i) = left(prev, i)))"
_LCP = f"{_SUFFIXES}, pv AS (SELECT *, lag(suffix) OVER (ORDER BY row) AS prev, lag(doc) OVER (ORDER BY row) AS prev_doc FROM sa), l AS (SELECT row, doc, off, prev_doc, CAST(coalesce({_COMMON}, 0) AS BIGINT) AS lcp FROM pv)"


@_query(f"WITH {_SUFFIXES} SELECT row, doc, off FROM sa")
def i1_suffix_array(spark, d):
    return suffixes.suffix_array(_names(spark, d))


@_query("WITH c AS (SELECT CAST(count(*) AS BIGINT) AS n FROM documents, unnest(range(1, length(text) + 1)) u(i) WHERE substr(text, i, 3) < 'the') SELECT n AS first, n + (SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) / 3) AS BIGINT) FROM documents) - 1 AS last FROM c")
def i1_array_of_documents(spark, d):
    """The array of all documents, by the rows of a common string: as many suffixes sort before it as SQL counts."""
    docs = C.documents(spark, d)
    return suffixes.row_range(suffixes.build(docs, prefixes=False), docs, b"the")


@_query(f"WITH {_LCP} SELECT row, doc, off, lcp FROM l")
def i2_distributed_array(spark, d):
    """Part names once more, by the rounds that large corpora take."""
    return suffixes.build(_names(spark, d), small=0).select("row", "doc", "off", "lcp")


@_query(f"WITH {_LCP} SELECT row, doc, off, lcp FROM l")
def i4_common_prefixes(spark, d):
    return suffixes.build(_names(spark, d)).select("row", "doc", "off", "lcp")


@_query(f"WITH {_SUFFIXES} SELECT row, CASE WHEN off > 0 THEN ascii(substr(p_name, CAST(off AS INT), 1)) ELSE -1 END AS byte FROM sa")
def i5_bwt(spark, d):
    return suffixes.bwt(suffixes.build(_names(spark, d))).fillna(-1, ["byte"])


@_query(f"WITH {_SUFFIXES}, m AS (SELECT DISTINCT row // 500 AS chunk, doc FROM sa) SELECT chunk, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS docs FROM m GROUP BY chunk")
def i5_chunk_map(spark, d):
    got = suffixes.chunk_map(suffixes.build(_names(spark, d)), 500)
    return got.select("chunk", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@_query(f"WITH {_SUFFIXES} SELECT min(row) AS first, max(row) AS last FROM sa WHERE starts_with(suffix, 're')")
def r1_row_range(spark, d):
    names = _names(spark, d)
    return suffixes.row_range(suffixes.build(names), names, b"re")


@_query(f"WITH {_SUFFIXES} SELECT ascii(left(suffix, 1)) AS byte, min(row) AS first, max(row) AS last FROM sa WHERE substr(suffix, 2, 2) = 'ar' GROUP BY byte")
def r2_rows_left(spark, d):
    names = _names(spark, d)
    return suffixes.rows_left(suffixes.build(names), names, b"ar")


@_query(f"WITH {_SUFFIXES} SELECT ascii(substr(suffix, 3, 1)) AS byte, min(row) AS first, max(row) AS last FROM sa WHERE starts_with(suffix, 'ar') AND length(suffix) > 2 GROUP BY byte")
def r3_rows_right(spark, d):
    names = _names(spark, d)
    return suffixes.rows_right(suffixes.build(names), names, b"ar")


@_query(" UNION ALL ".join(f"SELECT '{s}' AS match, 0 AS cost, min(row) AS first, max(row) AS last FROM (WITH {_SUFFIXES} SELECT * FROM sa) x WHERE starts_with(suffix, '{s}') HAVING min(row) IS NOT NULL" for s in ("re", "ro", "ra")))
def r5_find_strings(spark, d):
    """The strings that a pattern matches, with their rows."""
    names = _names(spark, d)
    (leaf,) = leaves(prepare(parse("r(e|o|a)")))
    hits = search.places(names, leaf, matched=True).select("doc", F.col("offset").alias("off"), "match", "cost")
    by = hits.join(suffixes.build(names), ["doc", "off"]).groupBy("match").agg(F.min("cost").alias("cost"), F.min("row").alias("first"), F.max("row").alias("last"))
    return by.select(F.decode("match", "UTF-8").alias("match"), "cost", "first", "last")


@_query(f"WITH {_SUFFIXES} SELECT DISTINCT doc FROM sa WHERE row BETWEEN 100 AND 900")
def r7_docs_for_range(spark, d):
    return suffixes.docs_for_range(suffixes.build(_names(spark, d)), 100, 900)


@_query(f"WITH {_SUFFIXES} SELECT DISTINCT doc FROM sa WHERE row BETWEEN 777 AND 9001")
def s16_chunked_ranges(spark, d):
    """Documents of a range from a stored index: whole chunks by their lists, both ends row by row."""
    path = _folder(spark, "index")
    suffixes.write_index(_names(spark, d), path, chunk=512)
    return suffixes.docs_by_chunks(suffixes.open_index(spark, path), 777, 9001)


@_query(f"WITH {_SUFFIXES} SELECT row, doc, off FROM sa WHERE row % 7 = 0")
def p8_locate(spark, d):
    array = suffixes.build(_names(spark, d))
    return suffixes.locate(array, array.filter("row % 7 = 0").select("row"))


@_query(f"WITH {_SUFFIXES} SELECT min(row) AS first, max(row) AS last FROM sa WHERE starts_with(suffix, 'are')")
def r9_backward_step(spark, d):
    """From the rows of a string to those of a byte and the string."""
    names = _names(spark, d)
    array = suffixes.build(names)
    first, last = suffixes.row_range(array, names, b"re").first()
    return suffixes.backward_search(array, first, last, ord("a"))


@_query(f"WITH {_SUFFIXES} SELECT a.row, b.row AS back FROM sa a JOIN sa b ON a.doc = b.doc AND a.off = b.off + 1")
def r10_step_back(spark, d):
    return suffixes.step_back(suffixes.build(_names(spark, d))).select("row", "back")


@_query(f"WITH {_SUFFIXES} SELECT a.row, b.row AS forward, ascii(left(a.suffix, 1)) AS byte FROM sa a JOIN sa b ON a.doc = b.doc AND b.off = a.off + 1")
def r10_step_forward(spark, d):
    return suffixes.step_forward(suffixes.build(_names(spark, d)))


# ------------------------------------------------------------------ mining

# texts as hexadecimal digits, two for each byte
_UNIQUE = """b AS (SELECT item_id AS doc, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT doc, CAST(i - 1 AS BIGINT) AS off, n AS length, substr(t, 2 * i - 1, 2 * n) AS s FROM b, unnest(range(1, size + 1)) u(i), unnest(range(1, least(256, size - i + 2))) v(n)),
    u AS (SELECT s FROM p GROUP BY s HAVING count(DISTINCT doc) = 1), m AS (SELECT doc, off, min(length) AS length FROM p JOIN u USING (s) GROUP BY doc, off),
    mu AS (SELECT m.doc, m.off, m.length FROM m LEFT JOIN m n ON n.doc = m.doc AND n.off = m.off + 1 WHERE coalesce(n.length, 1000000) >= m.length)"""


@_query(
    "WITH b AS (SELECT hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM benchmark WHERE text IS NOT NULL), c AS (SELECT substr(t, 2 * i - 1, 2 * n) AS s FROM b, unnest(range(1, size + 1)) u(i), unnest(range(1, least(1024, size - i + 1) + 1)) v(n)), "
    "f AS (SELECT s, count(*) AS n FROM c GROUP BY s HAVING count(*) >= 20) SELECT s, n FROM f WHERE s NOT IN (SELECT substr(s, 3) FROM f)"
)
def m1_frequent_substrings(spark, d):
    return mining.frequent_substrings(_items(spark, d), least=20).select(F.hex("s").alias("s"), "n")


def _unique(spark, d):
    items = _items(spark, d)
    return mining.minimal_unique(suffixes.build(items), items), items


@_query(f"WITH {_UNIQUE} SELECT doc, off, length FROM mu")
def m2_minimal_unique(spark, d):
    return _unique(spark, d)[0]


@_query(f"WITH {_UNIQUE} SELECT doc, length, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY doc ORDER BY length) AS BIGINT) AS upto FROM mu GROUP BY doc, length")
def m3_unique_histogram(spark, d):
    return mining.unique_histogram(_unique(spark, d)[0])


@_query(f"WITH {_UNIQUE} SELECT doc, count(*) AS n, min(length) AS least, round(avg(length), 9) AS mean, max(length) AS most FROM mu GROUP BY doc")
def m3_unique_statistics(spark, d):
    return mining.unique_statistics(_unique(spark, d)[0]).withColumn("mean", F.round("mean", 9))


def _near_copies_sql(least: int, tries: int = 10) -> str:
    """The loop written out: similarity once, by its blocks, then for each step the counts without what has gone, and who goes next."""
    head, _, _ = _UNIQUE.partition("u AS (")
    parts = [
        head.strip().rstrip(",").replace("p AS (", "p AS MATERIALIZED ("),
        "sa AS (SELECT row_number() OVER (ORDER BY substr(t, 2 * i - 1), doc) - 1 AS row, doc, substr(t, 2 * i - 1) AS suffix FROM b, unnest(range(1, size + 1)) u(i))",
        "pv AS (SELECT *, lag(suffix) OVER (ORDER BY row) AS prev, lag(doc) OVER (ORDER BY row) AS prev_doc FROM sa)",
        "lc AS (SELECT row, doc, prev_doc, coalesce(len(list_filter(range(1, least(length(suffix), length(prev)) // 2 + 1), lambda i: left(suffix, 2 * i) = left(prev, 2 * i))), 0) AS lcp FROM pv)",
        "st AS (SELECT *, row // 1000 AS stretch FROM lc), cuts AS (SELECT stretch, arg_min(row, (lcp, row)) AS cut FROM st GROUP BY stretch)",
        "pl AS (SELECT st.*, CASE WHEN row >= cut THEN stretch + 1 ELSE stretch END AS block FROM st JOIN cuts USING (stretch)), fi AS (SELECT block, min(row) AS first FROM pl GROUP BY block)",
        "inn AS (SELECT pl.*, CASE WHEN row > first THEN lcp END AS inside FROM pl JOIN fi USING (block)), low AS (SELECT block, coalesce(min(inside), 0) AS low FROM inn GROUP BY block)",
        "sz AS (SELECT doc, size * (size + 1) / 2 AS sa FROM b), bc AS (SELECT block, low, doc, count(*) AS c FROM inn JOIN low USING (block) WHERE low >= 60 GROUP BY ALL)",
        "w AS (SELECT x.doc AS doc_a, y.doc AS doc_b, x.low * (x.c * nb.sa + y.c * na.sa) AS w FROM bc x JOIN bc y ON x.block = y.block AND x.doc < y.doc JOIN sz na ON na.doc = x.doc JOIN sz nb ON nb.doc = y.doc "
        "UNION ALL SELECT least(inn.doc, prev_doc), greatest(inn.doc, prev_doc), lcp * (na.sa + nb.sa) FROM inn JOIN low USING (block) JOIN sz na ON na.doc = inn.doc JOIN sz nb ON nb.doc = prev_doc WHERE inside IS NOT NULL AND inn.doc <> prev_doc AND lcp > low AND lcp >= 60)",
        "sc AS (SELECT doc_a, doc_b, sqrt(sum(w) / (2 * any_value(na.sa) * any_value(nb.sa))) AS score FROM w JOIN sz na ON na.doc = doc_a JOIN sz nb ON nb.doc = doc_b GROUP BY doc_a, doc_b)",
        "alike AS MATERIALIZED (SELECT doc_a AS doc, doc_b AS other, score FROM sc UNION ALL SELECT doc_b, doc_a, score FROM sc)",
        "gone0 AS (SELECT 0::BIGINT AS doc, 0 AS step, 0.0::DOUBLE AS score, 0::BIGINT AS other WHERE false)",
    ]
    for k in range(1, tries):
        parts += [
            f"l{k} AS MATERIALIZED (SELECT doc, size FROM b WHERE doc NOT IN (SELECT doc FROM gone{k - 1}))",
            f"u{k} AS (SELECT s FROM p JOIN l{k} USING (doc) GROUP BY s HAVING count(DISTINCT doc) = 1), m{k} AS MATERIALIZED (SELECT doc, off, min(length) AS length FROM p JOIN l{k} USING (doc) JOIN u{k} USING (s) GROUP BY doc, off)",
            f"n{k} AS MATERIALIZED (SELECT l.doc, count(x.off) AS n FROM l{k} l LEFT JOIN (SELECT m.doc, m.off FROM m{k} m LEFT JOIN m{k} z ON z.doc = m.doc AND z.off = m.off + 1 WHERE coalesce(z.length, 1000000) >= m.length) x ON x.doc = l.doc GROUP BY l.doc)",
            f"best{k} AS (SELECT a.doc, max(a.score) AS score, arg_min(a.other, (-a.score, a.other)) AS other FROM alike a JOIN n{k} x ON x.doc = a.doc AND x.n < {least} JOIN n{k} y ON y.doc = a.other AND y.n >= {least} WHERE a.score > 0 GROUP BY a.doc)",
            f"half{k} AS MATERIALIZED (SELECT * FROM best{k} QUALIFY row_number() OVER (ORDER BY score DESC, doc DESC) <= greatest(1, (SELECT count(*) FROM n{k} WHERE n < {least}) // 2))",
            f"gone{k} AS MATERIALIZED (SELECT * FROM gone{k - 1} UNION ALL SELECT doc, {k}, score, other FROM half{k} UNION ALL "
            f"SELECT doc, {k}, NULL, NULL FROM (SELECT doc FROM n{k} WHERE EXISTS (SELECT 1 FROM n{k} WHERE n < {least}) AND NOT EXISTS (SELECT 1 FROM half{k}) ORDER BY n, doc LIMIT 1) x)",
        ]
    return f"WITH {', '.join(parts)} SELECT doc, step, round(score, 6) AS score, other FROM gone{tries - 1}"


@_query(_near_copies_sql(60))
def m4_near_copies(spark, d):
    return mining.drop_near_copies(_items(spark, d), least=60).withColumn("score", F.round("score", 6))


@_query(f"WITH {_UNIQUE} SELECT DISTINCT doc, k AS off, substr(t, CAST(2 * k + 1 AS INT), 24) AS kmer FROM mu JOIN b USING (doc), unnest(range(off + length - 12, off + 1)) x(k) WHERE length <= 12 AND k >= 0 AND k + 12 <= size AND NOT regexp_matches(substr(t, CAST(2 * k + 1 AS INT), 24), '^(..)*3E')")
def m5_unique_kmers(spark, d):
    return mining.unique_kmers(*_unique(spark, d), k=12, shifts=True).select("doc", "off", F.hex(F.encode("kmer", "ISO-8859-1")).alias("kmer"))


_CENTRED = f"{_UNIQUE}, c AS (SELECT doc, off - (12 - length) // 2 AS k FROM mu WHERE length <= 12), k AS (SELECT DISTINCT doc, k AS off, substr(t, CAST(2 * k + 1 AS INT), 24) AS kmer FROM c JOIN b USING (doc) WHERE k >= 0 AND k + 12 <= size), k2 AS (SELECT * FROM k WHERE NOT regexp_matches(kmer, '^(..)*3E'))"


@_query(f"WITH {_CENTRED}, g AS (SELECT doc, off, n, substr(kmer, 2 * i - 1, 2 * n) AS g, count(*) / (13 - n) AS p FROM k2, unnest(range(1, 6)) a(n), unnest(range(1, 14 - n)) b2(i) GROUP BY doc, off, n, g) SELECT doc, off, round(-sum(p * log2(p)) / (12 + log2(9) + log2(8)), 6) AS complexity FROM g GROUP BY doc, off")
def m6_complexity(spark, d):
    kmers = mining.unique_kmers(*_unique(spark, d), k=12)
    return kmers.select("doc", "off", F.round(mining.complexity(F.col("kmer")), 6).alias("complexity"))


# ------------------------------------------------------------------ similarity


@_query(
    f"WITH {_SUFFIXES}, p AS (SELECT doc, lag(doc) OVER (ORDER BY row) AS prev FROM sa), q AS (SELECT * FROM p WHERE prev IS NOT NULL), t AS (SELECT doc, count(*) AS n FROM (SELECT doc FROM q UNION ALL SELECT prev FROM q) x GROUP BY doc), "
    "m AS (SELECT least(doc, prev) AS doc_a, greatest(doc, prev) AS doc_b, count(*) AS met FROM q WHERE doc <> prev GROUP BY 1, 2) "
    "SELECT doc_a, doc_b, round(sqrt(met / sqrt(a.n) / sqrt(b.n)), 6) AS score FROM m JOIN t a ON a.doc = doc_a JOIN t b ON b.doc = doc_b"
)
def e3_adjacent_similarity(spark, d):
    return similarity.adjacent(suffixes.build(_names(spark, d))).select("doc_a", "doc_b", F.round("score", 6).alias("score"))


@_query("""WITH b AS (SELECT item_id AS q, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM benchmark), d AS (SELECT doc_id AS doc, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM documents),
    bg AS (SELECT q, i, substr(t, 2 * i - 1, 64) AS g FROM b, unnest(range(1, size - 30)) u(i)),
    dg AS (SELECT doc, j, substr(t, 2 * j - 1, 64) AS g FROM d, unnest(range(1, size - 30)) u(j) WHERE substr(t, 2 * j - 1, 64) IN (SELECT g FROM bg)),
    met AS (SELECT q, doc, i, j, j - i AS diagonal FROM bg JOIN dg USING (g)), isl AS (SELECT *, i - row_number() OVER (PARTITION BY q, doc, diagonal ORDER BY i) AS island FROM met),
    runs AS (SELECT q, doc, min(i) AS i, min(j) AS j, max(i) - min(i) + 32 AS n FROM isl GROUP BY q, doc, diagonal, island),
    kept AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs w WHERE w.q = r.q AND w.doc = r.doc AND w.i <= r.i AND w.i + w.n >= r.i + r.n AND w.n > r.n)),
    times AS (SELECT q, doc, n, substr(t, 2 * i - 1, 2 * n) AS s, count(DISTINCT i) AS here, count(DISTINCT j) AS there FROM kept JOIN b USING (q) GROUP BY ALL)
    SELECT q, doc, round(sum(n * least(here, there)) / least(any_value(b.size), any_value(d.size)), 6) AS score FROM times JOIN b USING (q) JOIN d USING (doc) GROUP BY q, doc""")
def e1_shared_sequences(spark, d):
    return similarity.shared_score(_items(spark, d), C.documents(spark, d), least=32).select("q", "doc", F.round("score", 6).alias("score"))


@_query("""WITH b AS (SELECT item_id AS q, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM benchmark WHERE item_id % 10 = 0), d AS (SELECT item_id AS doc, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM benchmark WHERE item_id % 10 <> 0),
    bg AS (SELECT q, i, substr(t, 2 * i - 1, 16) AS g FROM b, unnest(range(1, size - 6)) u(i)), dg AS (SELECT doc, j, substr(t, 2 * j - 1, 16) AS g FROM d, unnest(range(1, size - 6)) u(j)),
    met AS (SELECT q, doc, i, j, j - i AS diagonal FROM bg JOIN dg USING (g)), isl AS (SELECT *, i - row_number() OVER (PARTITION BY q, doc, diagonal ORDER BY i) AS island FROM met),
    runs AS (SELECT q, doc, min(i) AS i, min(j) AS j, max(i) - min(i) + 8 AS n FROM isl GROUP BY q, doc, diagonal, island),
    kept AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs w WHERE w.q = r.q AND w.doc = r.doc AND w.i <= r.i AND w.i + w.n >= r.i + r.n AND w.n > r.n)),
    times AS (SELECT q, n, substr(t, 2 * i - 1, 2 * n) AS s, count(DISTINCT i) AS here, count(DISTINCT (doc, j)) AS there FROM kept JOIN b USING (q) GROUP BY q, n, s)
    SELECT q, 'items' AS index_id, CAST(sum(n * least(here, there)) AS BIGINT) AS n_bytes, count(*) AS sequences, min(n) AS shortest, max(n) AS longest FROM times GROUP BY q""")
def e1_index_score(spark, d):
    """A tenth of the items against all the others together."""
    items = _items(spark, d)
    got = similarity.index_score(items.filter("doc % 10 = 0"), {"items": items.filter("doc % 10 <> 0")})
    return got.select("q", "index_id", "n_bytes", "sequences", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"))


_BLOCKED = f"""WITH {_LCP}, st AS (SELECT *, row // 1000 AS stretch FROM l), cuts AS (SELECT stretch, arg_min(row, (lcp, row)) AS cut FROM st GROUP BY stretch),
    pl AS (SELECT st.*, CASE WHEN row >= cut THEN stretch + 1 ELSE stretch END AS block FROM st JOIN cuts USING (stretch)), f AS (SELECT block, min(row) AS first FROM pl GROUP BY block),
    inn AS (SELECT pl.*, CASE WHEN row > first THEN lcp END AS inside FROM pl JOIN f USING (block)), low AS (SELECT block, coalesce(min(inside), 0) AS low FROM inn GROUP BY block),
    n AS (SELECT p_partkey AS doc, length(p_name) * (length(p_name) + 1) / 2 AS sa FROM part), c AS (SELECT block, low, doc, count(*) AS c FROM inn JOIN low USING (block) WHERE low >= 6 GROUP BY ALL),
    w AS (SELECT x.doc AS doc_a, y.doc AS doc_b, x.low * (x.c * nb.sa + y.c * na.sa) AS w FROM c x JOIN c y ON x.block = y.block AND x.doc < y.doc JOIN n na ON na.doc = x.doc JOIN n nb ON nb.doc = y.doc
      UNION ALL SELECT least(inn.doc, prev_doc), greatest(inn.doc, prev_doc), lcp * (na.sa + nb.sa) FROM inn JOIN low USING (block) JOIN n na ON na.doc = inn.doc JOIN n nb ON nb.doc = prev_doc WHERE inside IS NOT NULL AND inn.doc <> prev_doc AND lcp > low AND lcp >= 6),
    sc AS (SELECT doc_a, doc_b, round(sqrt(sum(w) / (2 * any_value(na.sa) * any_value(nb.sa))), 6) AS score FROM w JOIN n na ON na.doc = doc_a JOIN n nb ON nb.doc = doc_b GROUP BY doc_a, doc_b)"""


@_query(_BLOCKED + " SELECT * FROM sc")
def e2_block_similarity(spark, d):
    names = _names(spark, d)
    return similarity.blocked(suffixes.build(names), names, least=6, digits=6)


@_query(_BLOCKED + " SELECT * FROM sc ORDER BY score DESC, doc_a, doc_b LIMIT 200")
def e5_top_similar(spark, d):
    names = _names(spark, d)
    return similarity.top(similarity.blocked(suffixes.build(names), names, least=6, digits=6, best=200))


def _winnow_sql(k: int, guarantee: int) -> str:
    """The polynomial of each run of ``k`` bytes by its definition, mixed, and the least of each window, the last of equal ones."""
    two64 = "18446744073709551616"
    terms = " + ".join(f"(lead(b, {j}) OVER w + 1)::HUGEINT * {pow(winnow._P, j, 1 << 64)}" for j in range(k))
    step = lambda x, shift, factor: f"CAST(((xor({x}, {x} >> {shift}))::UHUGEINT * {factor}::UHUGEINT) % {two64}::UHUGEINT AS UBIGINT)"
    return f"""WITH t AS (SELECT doc_id AS doc, hex(encode(text)) AS t, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc, size, i, CAST('0x' || substr(t, 2 * i - 1, 2) AS INT) AS b FROM t, unnest(range(1, size + 1)) u(i)),
    g AS (SELECT doc, i, CAST(({terms}) % {two64} AS UBIGINT) AS x, size FROM c WINDOW w AS (PARTITION BY doc ORDER BY i)),
    m AS (SELECT doc, i, {step('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM g WHERE i <= size - {k - 1}), n AS (SELECT doc, i, {step('x', 27, 0x94D049BB133111EB)} AS x FROM m), h AS (SELECT doc, i, xor(x, x >> 31) AS x FROM n),
    l AS (SELECT doc, i, min(x::HUGEINT * 1073741824 + (1073741823 - i)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN {guarantee - k} PRECEDING AND CURRENT ROW) AS low FROM h)
    SELECT DISTINCT doc, CAST(1073741823 - low % 1073741824 - 1 AS BIGINT) AS "offset", CAST(CASE WHEN low // 1073741824 >= 9223372036854775808 THEN low // 1073741824 - {two64} ELSE low // 1073741824 END AS BIGINT) AS hash FROM l WHERE i > {guarantee - k}"""


@_query(_winnow_sql(32, 128))
def w1_winnowing(spark, d):
    return winnow.fingerprints(C.documents(spark, d), k=32, guarantee=128)


def _chains_sql(k: int, guarantee: int, passes: int = 20) -> str:
    """All passes, one after the other; passes behind the last that joins anything change nothing."""
    head, _, last = _winnow_sql(k, guarantee).rpartition("SELECT DISTINCT")
    out = [f'w1 AS MATERIALIZED (SELECT DISTINCT{last}), s0 AS MATERIALIZED (SELECT doc, "offset" AS o, "offset" + {k} AS stop, hash, 0 AS errors, 1 AS n, 0::BIGINT AS score FROM w1)']
    two64 = "18446744073709551616"
    for p in range(passes):
        ahead = " UNION ALL ".join(
            f"SELECT *, {j} AS step, lead(hash, {j}) OVER w AS th, lead(stop, {j}) OVER w AS ts, errors + {j - 1} + coalesce(lead(errors, {j}) OVER w, 0) AS te, lead(n, {j}) OVER w AS tn FROM s{p} WINDOW w AS (PARTITION BY doc ORDER BY o, stop DESC)" for j in (1, 2)
        )
        unsigned = lambda x: f"(CASE WHEN {x} < 0 THEN {x}::HUGEINT + {two64} ELSE {x}::HUGEINT END)"
        turn = f"({unsigned('hash')} * (1::HUGEINT << (tn % 32)::HUGEINT)) % {two64} + {unsigned('hash')} // (1::HUGEINT << (64 - tn % 32)::HUGEINT)"
        mixed = f"xor(CAST({turn} AS UBIGINT), CAST({unsigned('th')} AS UBIGINT))::HUGEINT"
        out += [
            f"c{p} AS MATERIALIZED ({ahead})",
            f"q{p} AS MATERIALIZED (SELECT hash, th, count(*) AS c, sum(count(*)) OVER (PARTITION BY hash) AS total FROM c{p} GROUP BY hash, th)",
            f"f{p} AS (SELECT c.*, total, CASE WHEN c.th IS NOT NULL AND q.c >= 4 THEN CAST(q.c - (total - q.c) // 2 AS BIGINT) ELSE 0 END AS wins FROM c{p} c JOIN q{p} q ON q.hash = c.hash AND q.th IS NOT DISTINCT FROM c.th)",
            f"g{p} AS (SELECT *, wins > 0 AND te <= 1 AS good FROM f{p} WHERE wins > 0 AND te <= 1 OR step = 1)",
            f"m{p} AS (SELECT doc, o, CASE WHEN good THEN greatest(stop, ts) ELSE stop END AS stop, CASE WHEN good THEN {mixed} ELSE hash END AS hash, CASE WHEN good THEN te ELSE errors END AS errors, CASE WHEN good THEN n + tn ELSE n END AS n, "
            f"CASE WHEN good THEN 2 * wins + 1 WHEN total >= 8 THEN CAST(2 * floor(log2(total)) AS BIGINT) ELSE 0 END AS score, good, step FROM g{p})",
            f"b{p} AS MATERIALIZED (SELECT doc, o, stop, CAST(CASE WHEN hash >= 9223372036854775808 THEN hash - {two64} ELSE hash END AS BIGINT) AS hash, errors, n, score FROM m{p} QUALIFY row_number() OVER (PARTITION BY doc, o ORDER BY good DESC, score - errors DESC, step) = 1)",
            f"s{p + 1} AS MATERIALIZED (SELECT doc, o, stop, hash, errors, n, score FROM b{p} QUALIFY coalesce(stop > max(stop) OVER (PARTITION BY doc ORDER BY o, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))",
        ]
    return f'{head.rstrip()}, {", ".join(out)} SELECT doc, o AS "offset", stop, hash, errors, n, score FROM s{passes}'


@_query(_chains_sql(32, 128))
def w3_clustered_fingerprints(spark, d):
    return winnow.cluster(winnow.fingerprints(C.documents(spark, d), k=32, guarantee=128), k=32)


# ------------------------------------------------------------------ sources and sinks

_SHA = "SELECT octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM benchmark WHERE text <> ''"


def _sums(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.length("content").cast("long").alias("bytes"), sha256_of(F.col("content")).alias("sha256"))


def _as_files(spark, d) -> str:
    """The benchmark's items as files of the shared folder."""
    path = _folder(spark, "files").removeprefix("file:")
    while path.startswith("//"):
        path = path[1:]
    C.extract_files(_items(spark, d), path).count()
    return path


@_query(_SHA)
def src1_files(spark, d):
    """Items that were written as files, read again as documents."""
    return _sums(C.files(spark, f"file://{_as_files(spark, d)}"))


@_query(_SHA + " AND item_id % 2 = 0")
def src2_listed_files(spark, d):
    """Only the files that a list names."""
    path = _as_files(spark, d)
    names = _items(spark, d).filter("doc % 2 = 0").select(F.concat(F.lit(f"{path}/"), F.col("doc").cast("string")).alias("value"))
    C.write_lines(names, f"file://{path}-list")
    return _sums(C.from_list(spark, f"file://{path}-list", f"file://{path}"))


@_query("SELECT p_name || ' ' || p_partkey AS info, upper(replace(p_name, ' ', '')) AS sequence FROM part")
def src4_fasta_records(spark, d):
    """A sequence file of all part names, split into its records."""
    lines = spark.read.parquet(f"{d}/part.parquet").select(F.pmod("p_partkey", F.lit(8)).alias("doc"), F.concat(F.lit(">"), "p_name", F.lit(" "), "p_partkey", F.lit("\n"), "p_name", F.lit("\n")).alias("line"))
    files = lines.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("t")).select("doc", F.concat(F.col("doc").cast("string"), F.lit(".fa")).alias("info"), F.encode("t", "UTF-8").alias("content"))
    return C.fasta_records(files).select("info", F.decode("content", "UTF-8").alias("sequence"))


@_query("SELECT unnest(string_split(text, ' ')) AS info, octet_length(encode(info)) AS bytes FROM benchmark WHERE text <> ''")
def src5_nul_records(spark, d):
    """Words with NUL between them, each a document."""
    words = _items(spark, d).select("doc", "info", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit(" "), F.lit("\0")), "UTF-8").alias("content"))
    return C.zero_split(words).select("info", F.length("content").cast("long").alias("bytes"))


@_query("WITH t AS (SELECT item_id AS doc, translate(left(md5(text), 24), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM benchmark WHERE text IS NOT NULL) SELECT doc, '>' || s || '>' || reverse(translate(s, 'ACGT', 'TGCA')) AS content FROM t")
def src6_both_strands(spark, d):
    dna = F.translate(F.substring(F.md5("content"), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")
    files = _items(spark, d).select("doc", F.concat("info", F.lit(".fna")).alias("info"), F.encode(F.concat(F.lit(">one\n"), F.lower(dna), F.lit("\n")), "UTF-8").alias("content"))
    return C.fasta_files(files).select("doc", F.decode("content", "UTF-8").alias("content"))


class _Squares(C.Adapter):
    """Documents that a program makes: eight parts of ten."""

    def parts(self):
        return list(range(8))

    def read(self, part):
        for k in range(10 * part, 10 * part + 10):
            yield str(k), str(k * k).encode()


@_query("SELECT range AS doc, CAST(range AS VARCHAR) AS info, CAST(range * range AS VARCHAR) AS content FROM range(80)")
def src7_adapter(spark, d):
    return C.from_adapter(spark, _Squares()).select("doc", "info", F.decode("content", "UTF-8").alias("content"))


@_query("SELECT item_id AS doc, sha256(text) AS sha256 FROM benchmark")
def src8_open_index(spark, d):
    path = _folder(spark, "corpus")
    C.write_index(_items(spark, d), path, files_n=1)
    return C.open_index(spark, path).select("doc", sha256_of(F.col("content")).alias("sha256"))


@_query(
    "WITH h AS (SELECT id, string_agg(md5('1/' || id || '/' || j), '' ORDER BY j) AS h FROM range(2000) a(id), range(13) b(j) GROUP BY id), "
    "t AS (SELECT translate(array_to_string(list_transform(range(200), lambda i: substr(h, CAST(2 * i + 2 AS INT), 1)), ''), '0123456789abcdef', 'acgtacgtacgtacgt') AS t FROM h) "
    "SELECT CAST(sum((length(t) - length(replace(t, 'acgt', ''))) / 4) AS BIGINT) AS n FROM t"
)
def src10_random_texts(spark, d):
    return Engine(C.random_texts(spark, 2000, 200)).count("acgt")


@_query(f"WITH {_LCP} SELECT row, doc, off, lcp FROM l")
def snk1_stored_index(spark, d):
    """An index that was written, opened again."""
    path = _folder(spark, "index")
    suffixes.write_index(_names(spark, d), path, files_n=1)
    return suffixes.open_index(spark, path).array.select("row", "doc", "off", "lcp")


@_query(f"WITH {_SUFFIXES} SELECT row // 1000 AS chunk, string_agg(printf('%02X', CASE WHEN off > 0 THEN ascii(substr(p_name, CAST(off AS INT), 1)) ELSE 0 END), '' ORDER BY row) AS bytes FROM sa GROUP BY chunk")
def snk4_bwt_chunks(spark, d):
    return suffixes.bwt_chunks(suffixes.build(_names(spark, d)), 1000).select("chunk", F.hex("bytes").alias("bytes"))


@_query("SELECT 'documents' AS kind, count(*) AS n FROM documents WHERE contains(text, 'License') UNION ALL SELECT 'total', CAST(sum((length(text) - length(replace(text, 'License', ''))) / 7) AS BIGINT) FROM documents UNION ALL SELECT 'match License', CAST(sum((length(text) - length(replace(text, 'License', ''))) / 7) AS BIGINT) FROM documents")
def snk6_json_report(spark, d):
    """A report in JSON, read again: how many results, the total, and the match with its number."""
    e = Engine(C.documents(spark, d))
    lines = C.report_lines(e, "License").select(F.from_json("value", "result struct<doc: long>, match struct<match: string, n: long>, total long").alias("x"))
    kind = F.when(F.col("x.result").isNotNull(), F.lit("documents")).when(F.col("x.total").isNotNull(), F.lit("total")).otherwise(F.concat(F.lit("match "), F.col("x.match.match")))
    return lines.groupBy(kind.alias("kind")).agg(F.coalesce(F.sum("x.total"), F.sum("x.match.n"), F.count(F.lit(1))).alias("n"))


@_query("SELECT concat(source, '/', doc_id) AS value FROM documents WHERE contains(text, 'License')")
def snk7_output_file(spark, d):
    """Results that were written to a file, with NUL behind each."""
    e, path = Engine(C.documents(spark, d)), _folder(spark, "output")
    C.write_lines(e.find_docs("License").join(e.corpus, "doc").select(F.col("info").alias("value")), path, sep="\0", files_n=1)
    return spark.read.option("lineSep", "\0").text(path)


@_query(f"WITH {_UNIQUE}, z AS (SELECT doc, i AS off FROM b, unnest(range(0, size)) u(i)) SELECT doc, string_agg(printf('%02X', coalesce(length, 0)), '' ORDER BY z.off) AS bytes FROM z LEFT JOIN mu USING (doc, off) GROUP BY doc")
def snk8_unique_bytes(spark, d):
    got = mining.unique_bytes(*_unique(spark, d))
    return got.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", F.hex("bytes").alias("h")))), lambda x: x["h"]), "").alias("bytes"))


@_query("SELECT item_id AS doc, octet_length(encode(text)) AS bytes FROM benchmark")
def snk9_extract_files(spark, d):
    return C.extract_files(_items(spark, d), _folder(spark, "extract").removeprefix("file:").replace("//", "/")).select("doc", "bytes")


@_query("SELECT item_id AS doc, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sha256(encode(text) || '\\x00'::BLOB) AS sha256 FROM benchmark WHERE text IS NOT NULL")
def snk10_prepared(spark, d):
    return C.prepared(_items(spark, d)).select("doc", "start", sha256_of(F.col("bytes")).alias("sha256"))
