"""The thin ``opN_<name>`` queries over the synthetic tables, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import chat, decontaminate, html_extract, langid, license_scan, neardup, packing, pii, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.col("n_chars").cast("long").alias("n_chars"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(packing.pack(_table(spark, sf_dir, "documents")))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces: checksums in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_html_extraction, op3_personal_data, op4_url_filter, op5_topk, op6_decontaminate, op7_language_id, op8_near_duplicates, op9_packing, op10_chat_rotation)
}


# ------------------------------------------------------------------ the same in DuckDB's SQL, by definition and not by method


def _low(x: str) -> str:
    """A-Z to lower case, and nothing else."""
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_sql() -> str:
    """Every window against every template of its class."""
    words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    k = license_scan.SHINGLE
    shingles = f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    temps = license_scan.passages(license_scan.TEMPLATES)
    rows = ", ".join(f"({n}, {_quoted(name)}, {license_scan.class_of(len(w))}, {_quoted(' '.join(w))})" for n, (name, w) in enumerate(temps))
    sizes = ", ".join(f"({n}, {w}, {s})" for n, (_, w, s) in enumerate(license_scan.CLASSES))
    return f"""WITH c(class, win_size, stride) AS (VALUES {sizes}),
    t AS (SELECT template, license, class, list_distinct({shingles}) AS sh FROM (SELECT template, license, class, string_split(txt, ' ') AS w FROM (VALUES {rows}) v(template, license, class, txt)) x),
    ts AS (SELECT template, license, class, len(sh) AS n, unnest(sh) AS s FROM t),
    d AS (SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(range(len(sh))) AS pos, unnest(sh) AS s FROM (SELECT doc_id, {shingles} AS sh FROM (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL) x WHERE len(w) >= {k}) y) z),
    hit AS (SELECT doc_id, pos, template, license, class, n, s FROM d JOIN ts USING (s)),
    win AS (SELECT hit.*, unnest(range(greatest(0, CAST(ceil((pos + {k} - win_size) / stride) AS BIGINT)), pos // stride + 1)) AS win FROM hit JOIN c USING (class)),
    score AS (SELECT doc_id, template, license, class, win, count(DISTINCT s) / any_value(n) AS containment, min(pos) AS a, max(pos) AS b FROM win GROUP BY doc_id, template, license, class, win),
    best AS (SELECT doc_id, template, license, max(containment) AS containment, count(*) AS n_windows, min(a) AS a, max(b) AS b FROM score WHERE containment >= {license_scan.LEAST} GROUP BY doc_id, template, license),
    rival AS (SELECT x.template, y.template AS rival FROM ts x JOIN ts y ON x.s = y.s AND x.license <> y.license GROUP BY x.template, y.template, x.n, y.n HAVING 2 * count(*) >= least(x.n, y.n))
    SELECT doc_id, license, max(containment) AS containment, CAST(sum(n_windows) AS BIGINT) AS n_windows, min(a) AS first_word, max(b) + {k - 1} AS last_word FROM best
    WHERE NOT EXISTS (SELECT 1 FROM rival JOIN best o ON o.template = rival.template WHERE rival.rival = best.template AND o.doc_id = best.doc_id AND o.containment > best.containment) GROUP BY doc_id, license"""


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(r.partition('/')[0])}, {_quoted('/' + r.partition('/')[2])}, {_quoted(r)}, {_quoted(v)})" for r, v in url_filter.RULES)
    strict, soft = (", ".join(map(_quoted, x)) for x in (url_filter.STRICT, url_filter.SOFT))
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, {_low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, string_split_regex({_low('url')}, '[^a-z0-9]+') AS words FROM u),
    r(rule_host, rule_path, rule, says) AS (VALUES {rules}),
    m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
    n AS (SELECT page_id, host, path, CAST(len(list_filter(words, lambda w: w IN ({strict}))) AS BIGINT) AS n_strict, CAST(len(list_distinct(list_filter(words, lambda w: w IN ({soft})))) AS BIGINT) AS n_soft FROM h)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM n LEFT JOIN m USING (page_id)"""


_TOPK_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {topk.EVERY} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= {topk.K}"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAKS_SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(_low('text'))}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS.format(_low('text'))} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    bm AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bm, unnest(range(1, len(w) - m + 2)) u(i)),
    dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM d, (SELECT DISTINCT m FROM bw) ms, unnest(range(1, len(w) - m + 2)) u(i)),
    h AS (SELECT doc_id, m, i, item FROM dw JOIN bw USING (m, k)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + m)) u(p) GROUP BY doc_id),
    f AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) x GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontaminate.ONE_IN} * n_hit >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)"""

_NEAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_low('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({neardup.SHINGLE}, len(w)) - 1], ' ') AS k FROM d, unnest(range(1, len(w) - least({neardup.SHINGLE}, len(w)) + 2)) u(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= {neardup.PERCENT} * (na.n + nb.n - both_)),
    r AS (SELECT doc_id AS doc, doc_id AS reach FROM d UNION SELECT r.doc, e.b FROM r JOIN e ON e.a = r.reach),
    c AS (SELECT doc AS doc_id, min(reach) AS component_id FROM r GROUP BY doc)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_CHAT_SQL = f"""WITH t AS (SELECT conv_id, role, replace(coalesce(text, ''), '<|', '< |') || '{chat.END}' AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM conversations),
    who AS (SELECT c.conv_id, participant FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> '{chat.SYSTEM}') p ON p.conv_id IS NOT DISTINCT FROM c.conv_id),
    v AS (SELECT t.conv_id, participant, i, body, coalesce(role = participant, false) AS own,
      '{chat.START}' || CASE WHEN role = participant THEN 'assistant' WHEN role = '{chat.SYSTEM}' THEN 'system' ELSE 'user name=' || coalesce(replace(role, '<|', '< |'), 'unknown') END || chr(10) AS head FROM t JOIN who ON who.conv_id IS NOT DISTINCT FROM t.conv_id),
    l AS (SELECT *, length(head) AS h, length(body) AS b, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM v)
    SELECT conv_id, participant, CAST(0 AS BIGINT) AS part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS rendered, coalesce(string_agg(CAST(base + h AS BIGINT) || ':' || CAST(base + h + b AS BIGINT), ',' ORDER BY i) FILTER (own), '') AS mask, CAST(coalesce(sum(b) FILTER (own), 0) AS BIGINT) AS n_loss FROM l GROUP BY conv_id, participant"""

ORACLE: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op4_url_filter": _url_sql(),
    "op5_topk": _TOPK_SQL,
    "op6_decontaminate": _LEAKS_SQL,
    "op8_near_duplicates": _NEAR_SQL,
    "op10_chat_rotation": _CHAT_SQL,
}
