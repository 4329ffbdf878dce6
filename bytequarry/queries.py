"""Queries over the synthetic tables, one or more for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry import queries_arrays
from bytequarry.functions.octets import sha256_of
from bytequarry.operators import search, suffixes
from bytequarry.plans.planner import Engine, by_index
from bytequarry.plans.requests import Request
from bytequarry.plans.syntax import parse
from bytequarry.sources import corpus as C
from bytequarry.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(queries_arrays.QUERIES)
ORACLE: dict[str, str] = dict(queries_arrays.ORACLE)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> Engine:
    return Engine(C.documents(spark, d))


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return C.from_table(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")


def _text(c: str, name: str | None = None):
    return F.decode(c, "UTF-8").alias(name or c)


def _places_sql(s: str, name: str) -> str:
    """Byte offsets of a string that doesn't overlap itself, from the pieces between its occurrences."""
    n = len(s)
    return f"""{name} AS (SELECT doc, CAST(sum(size) OVER (PARTITION BY doc ORDER BY i) + (i - 1) * {n} AS BIGINT) AS "offset" FROM (
      SELECT doc_id AS doc, i, octet_length(encode(parts[i])) AS size, len(parts) AS k FROM (SELECT doc_id, string_split(text, '{s}') AS parts FROM documents) x, unnest(range(1, len(parts) + 1)) u(i)) y QUALIFY i < k)"""


def _count_sql(s: str) -> str:
    return f"CAST(coalesce(sum((length(text) - length(replace(text, '{s}', ''))) / {len(s)}), 0) AS BIGINT)"


# ------------------------------------------------------------------ strings and expressions


@_query("SELECT " + _count_sql("th") + " AS n FROM documents")
def s1_string_count(spark, d):
    return _docs(spark, d).count("th")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'License')")
def s2_string_docs(spark, d):
    return _docs(spark, d).find_docs("License")


@_query("WITH " + _places_sql("qu", "p") + ' SELECT doc, "offset" FROM p')
def s3_string_offsets(spark, d):
    return _docs(spark, d).find_places("qu")


@_query("SELECT doc_id AS doc FROM documents WHERE regexp_matches(text, 'q.{1,3}e[st]', 's') AND NOT regexp_matches(text, 'zz')")
def s4_regex_docs(spark, d):
    return _docs(spark, d).find_docs("q.{1,3}e[st] NOT zz", chars=True)


@_query("WITH " + _places_sql("and", "a") + ", " + _places_sql("ind", "b") + ' SELECT doc, "offset" FROM a UNION ALL SELECT doc, "offset" FROM b')
def s5_regex_offsets(spark, d):
    return _docs(spark, d).find_places("(an|in)+d")


@_query("SELECT CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS n FROM documents")
def s6_regex_count(spark, d):
    return _docs(spark, d).count("[0-9]+", scan=True)


@_query(
    "SELECT DISTINCT doc_id AS doc FROM (SELECT doc_id, text FROM documents WHERE contains(text, 'Lice') OR contains(text, 'nsed')) x, unnest(range(1, length(text) + 1)) u(i), (VALUES (7), (8), (9)) v(n) "
    "WHERE length(text) >= i + n - 1 AND levenshtein(substr(text, i, n), 'Licensed') <= 1"
)
def s7_approximate_docs(spark, d):
    return _docs(spark, d).find_docs("APPROX 1 Licensed")


def _approximate_sql(s: str) -> str:
    """Starts of the shortest matches at each end, at a cost of 2 at most, with insertions at 2 and all else at 1, and the last byte matched.

    So a match is the string with up to two bytes changed, or one deleted and one changed, or two deleted, or one inserted. A character of
    several bytes counts as so many that match nothing.
    """
    m = len(s)
    one = sorted({s[:i] + s[i + 1 :] for i in range(m)})
    two = sorted({x[:i] + x[i + 1 :] for x in one for i in range(m - 1)})
    rows = lambda xs: ", ".join(f"('{x}')" for x in xs)
    pieces = " OR ".join(f"contains(text, '{s[m * i // 3 : m * (i + 1) // 3]}')" for i in range(3))
    return f"""WITH d AS (SELECT doc_id AS doc, regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{80}}-\\x{{7FF}}]', '~~', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '~~~', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '~~~~', 'g') AS t FROM documents WHERE {pieces}),
    v1(x) AS (VALUES {rows(one)}), v2(x) AS (VALUES {rows(two)}), c AS (SELECT doc, t, e, n, substr(t, e - n + 1, n) AS sub FROM d, unnest(range(1, length(t) + 1)) u(e), (VALUES ({m - 2}), ({m - 1}), ({m}), ({m + 1})) w(n) WHERE e >= n),
    hit AS (SELECT doc, e, n FROM c WHERE n = {m - 2} AND sub IN (SELECT x FROM v2) OR n = {m} AND hamming(sub, '{s}') <= 2 AND right(sub, 1) = '{s[-1]}' OR n = {m + 1} AND levenshtein(sub, '{s}') = 1 AND right(sub, 1) = '{s[-1]}'
      UNION ALL SELECT doc, e, n FROM (SELECT * FROM c WHERE n = {m - 1}) c, v1 WHERE hamming(sub, x) <= 1 AND right(sub, 1) = right(x, 1))
    SELECT DISTINCT doc, CAST(e - min(n) AS BIGINT) AS "offset" FROM hit GROUP BY doc, e"""


@_query(_approximate_sql("Released under"))
def s7_approximate_offsets(spark, d):
    return _docs(spark, d).find_places("APPROX 2:1:1:2 Released' 'under")


@_query("SELECT doc, \"offset\" FROM (WITH " + _places_sql("qu", "a") + ", " + _places_sql("ch", "b") + ' SELECT doc, "offset" FROM a UNION SELECT doc, "offset" FROM b) x')
def s9_or_offsets(spark, d):
    return _docs(spark, d).find_places("qu OR ch")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'License') AND contains(text, 'the')")
def s8_and(spark, d):
    return _docs(spark, d).find_docs("License AND the")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'License') OR contains(text, 'example')")
def s9_or(spark, d):
    return _docs(spark, d).find_docs("License OR example")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'the') AND NOT contains(text, 'qu')")
def s10_not(spark, d):
    return _docs(spark, d).find_docs("the NOT qu")


@_query("SELECT doc_id AS doc FROM documents WHERE (contains(text, 'the') OR contains(text, 'que')) AND (contains(text, 'example') AND NOT contains(text, 'MIT'))")
def s19_nested(spark, d):
    return _docs(spark, d).find_docs("(the OR que) AND (example NOT MIT)")


@_query("WITH " + _places_sql("qu", "l") + ", " + _places_sql("ch", "r") + """ SELECT doc, "offset" FROM (SELECT l.doc, l."offset", (SELECT min(r."offset") FROM r WHERE r.doc = l.doc AND r."offset" >= l."offset") AS nxt FROM l) x WHERE nxt - "offset" BETWEEN 1 AND 20""")
def s11_then(spark, d):
    return _docs(spark, d).find_places("qu THEN 20 ch")


@_query(
    "WITH " + _places_sql("qu", "l") + ", " + _places_sql("ch", "r") + """ SELECT DISTINCT doc, "offset" FROM (
      SELECT l.doc, l."offset", (SELECT min(r."offset") FROM r WHERE r.doc = l.doc AND r."offset" >= l."offset") AS nxt FROM l
      UNION ALL SELECT r.doc, r."offset", (SELECT min(l."offset") FROM l WHERE l.doc = r.doc AND l."offset" > r."offset") AS nxt FROM r) x WHERE nxt - "offset" <= 20"""
)
def s12_within(spark, d):
    return _docs(spark, d).find_places("qu WITHIN 20 ch")


@_query("SELECT doc_id AS doc FROM documents WHERE regexp_matches(text, '[Ll][Ii][Cc][Ee][Nn][Ss][Ee]')")
def s13_ignore_case(spark, d):
    return _docs(spark, d).find_docs("lIcEnSe", icase=True)


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'tion') AND regexp_matches(concat(source, '/', doc_id), '^src1[0-9]?/')")
def s14_filter_results(spark, d):
    return _docs(spark, d).find_docs("tion", only="^src1[0-9]?/")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'tion') ORDER BY doc_id LIMIT 25")
def s15_max_results(spark, d):
    return _docs(spark, d).find_docs("tion", limit=25)


@_query(
    "WITH c AS (SELECT doc_id AS doc, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents), "
    "w AS (SELECT doc, c, lead(c) OVER o AS c2, CAST(coalesce(sum(octet_length(encode(c))) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c WINDOW o AS (PARTITION BY doc ORDER BY i)) "
    "SELECT doc, off AS \"offset\" FROM w WHERE c = 'e' AND c2 = 'e'"
)
def s17_scan_offsets(spark, d):
    return _docs(spark, d).find_places("e{2,}", scan=True)


@_query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, {_count_sql(p)} AS n FROM documents" for p in ("the", "que", "und", "License", "zzz")))
def s18_many_patterns(spark, d):
    return _docs(spark, d).counts(["the", "que", "und", "License", "zzz"])


# ------------------------------------------------------------------ views of results


@_query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS match, 0 AS cost, {_count_sql(p)} AS n FROM documents" for p in ("the", "this", "thou")) + ") x WHERE n > 0")
def p1_matches(spark, d):
    return _docs(spark, d).matches("th(e|is|ou)").select(_text("match"), "cost", "n")


@_query("SELECT " + _count_sql("the") + " + " + _count_sql("que") + " AS n FROM documents")
def p2_count(spark, d):
    return _docs(spark, d).count("the AND que")


_WORD = "License, Versiom"
_PARTS = {_WORD: "whole"} | {_WORD[k:]: "suffix" for k in range(1, len(_WORD))} | {_WORD[:k]: "prefix" for k in range(len(_WORD) - 8, len(_WORD))}


@_query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{p}' AS suggestion, '{kind}' AS kind, {_count_sql(p)} AS n FROM documents" for p, kind in _PARTS.items()) + "), "
    "m AS (SELECT * FROM c WHERE n > (SELECT n FROM c WHERE kind = 'whole')), b AS (SELECT kind, n, arg_max(suggestion, length(suggestion)) AS suggestion FROM m GROUP BY kind, n) "
    "SELECT suggestion, n FROM b WHERE length(suggestion) = (SELECT max(length(suggestion)) FROM b y WHERE y.kind = b.kind)"
)
def p3_suggest(spark, d):
    return _docs(spark, d).suggest(_WORD).select(_text("suggestion"), "n")


@_query("SELECT doc, line FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line FROM documents) x WHERE contains(line, 'icensed under')")
def p4_grep(spark, d):
    return _docs(spark, d).grep("icensed' 'under").select("doc", _text("line"))


@_query("SELECT line, string_agg(info, ',' ORDER BY info) AS infos FROM (SELECT DISTINCT concat(source, '/', doc_id) AS info, unnest(string_split(text, chr(10))) AS line FROM documents) x WHERE contains(line, 'icensed under') GROUP BY line")
def p5_multigrep(spark, d):
    return _docs(spark, d).multigrep("icensed' 'under").select(_text("line"), F.array_join("infos", ",").alias("infos"))


@_query("SELECT doc_id AS doc, unnest(regexp_extract_all(text, '.License.', 0, 's')) AS context FROM documents WHERE contains(text, 'License')")
def p6_context(spark, d):
    return _docs(spark, d).context("License", 1, 1).select("doc", _text("context"))


@_query("SELECT doc_id AS doc, concat(source, '/', doc_id) AS info, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE contains(text, 'License')")
def p7_result_info(spark, d):
    e = _docs(spark, d)
    return e.sizes().join(e.find_docs("License"), "doc")


@_query("SELECT doc_id AS doc, concat(source, '/', doc_id) AS info, sha256(text) AS sha256 FROM documents WHERE regexp_matches(concat(source, '/', doc_id), '^src3/') OR doc_id IN (1, 2)")
def p10_extract(spark, d):
    return _docs(spark, d).extract(info="^src3/", docs=[1, 2]).select("doc", "info", sha256_of(F.col("content")).alias("sha256"))


@_query("SELECT doc_id AS doc, concat(source, '/', doc_id) AS info, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def p11_sizes(spark, d):
    return _docs(spark, d).sizes()


@_query("SELECT 'left' AS side, ascii(s[1]) AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '.License', 0, 's')) AS s FROM documents) x GROUP BY ALL UNION ALL SELECT 'right', ascii(right(s, 1)), count(*) FROM (SELECT unnest(regexp_extract_all(text, 'License.', 0, 's')) AS s FROM documents) x GROUP BY ALL")
def r4_neighbours(spark, d):
    return _docs(spark, d).neighbours("License")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'tion') ORDER BY doc_id LIMIT 100")
def r6_request_find_docs(spark, d):
    return _docs(spark, d).request("find_docs 100 0 tion")


@_query("SELECT doc_id AS doc, sha256(text) AS sha256 FROM documents")
def c1_checksums(spark, d):
    return C.documents(spark, d).select("doc", sha256_of(F.col("content")).alias("sha256"))


# ------------------------------------------------------------------ sources and streams


@_query("SELECT min(doc_id) AS doc, string_agg(concat(source, '/', doc_id), '|' ORDER BY doc_id) AS info FROM documents GROUP BY text")
def src3_deduplicate(spark, d):
    return C.deduplicate(C.documents(spark, d)).select("doc", "info")


@_query("SELECT 'documents' AS index_id, " + _count_sql("tion") + " AS n FROM documents UNION ALL SELECT 'benchmark', " + _count_sql("tion") + " FROM benchmark")
def src9_by_index(spark, d):
    both = by_index({"documents": C.documents(spark, d), "benchmark": _benchmark(spark, d)})
    leaf = parse("tion")
    return both.groupBy("index_id").agg(F.sum(search.occurrences(leaf, F.col("content"))).cast("long").alias("n"))


@_query("SELECT concat(source, '/', doc_id) || chr(9) || string_agg(CAST(\"offset\" AS VARCHAR), ' ' ORDER BY \"offset\") AS value FROM (WITH " + _places_sql("License", "p") + " SELECT * FROM p) p JOIN documents ON doc = doc_id GROUP BY source, doc_id")
def snk5_plain_output(spark, d):
    e = _docs(spark, d)
    return C.plain_lines(e.find_places("License"), e.corpus)


@_query("SELECT to_json({'doc': doc, 'info': concat(source, '/', doc), 'offsets': list(\"offset\" ORDER BY \"offset\")}) AS value FROM (WITH " + _places_sql("License", "p") + " SELECT * FROM p) p JOIN documents ON doc = doc_id GROUP BY source, doc")
def snk6_json_output(spark, d):
    e = _docs(spark, d)
    return C.json_lines(e.find_places("License"), e.corpus)


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'License')")
def stream_ingest(spark, d):
    """Two of three parts of the corpus arrive through a stream, the third is still staged; the search sees all of it."""
    docs = C.documents(spark, d)
    top = suffixes.saved(docs.filter("doc % 3 > 0"), "staging").inputFiles()[0].rsplit("/", 1)[0]
    index = f"{top}-index"
    ingest.start(spark, top, index, f"{top}-stream").awaitTermination()
    docs.filter("doc % 3 = 0").write.mode("append").parquet(top)
    return Engine(ingest.everything(spark, top, index)).find_docs("License")


@_query("SELECT doc_id AS doc FROM documents WHERE contains(text, 'License')")
def r8_request_lifecycle(spark, d):
    """A request that is begun, waited for and read from where it wrote."""
    path = f"{suffixes.shared_dir(spark)}/bytequarry/request-{uuid.uuid4().hex}"
    request = Request(_docs(spark, d).find_docs("License"), path).begin()
    if request.wait(3600) != "done":
        raise request.error or RuntimeError(f"the request is {request.state}")
    return spark.read.parquet(path)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a licence line and common words close together, and their sizes."""
    e = _docs(spark, d)
    return e.sizes().join(e.find_docs("(License OR example) AND t[a-z]+tion"), "doc").orderBy("doc")
