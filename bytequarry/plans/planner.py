"""Queries as DataFrame plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions.octets import around, latin
from bytequarry.operators import proximity, search
from bytequarry.plans import rewrites as R
from bytequarry.plans.syntax import Bool, Leaf, Lit, Query, parse, raw, show


class Engine:
    """Searches of one corpus: ``doc`` (long), ``info`` (string), ``content`` (binary).

    Every search takes a query's text or tree. ``icase`` ignores ASCII case, ``only`` keeps documents whose info
    matches a regular expression somewhere, ``scan`` reports all starts of a regular expression rather than the index's.
    """

    def __init__(self, corpus: DataFrame):
        self.corpus = corpus.select("doc", "info", "content")

    def _query(self, q: str | bytes | Query, icase: bool = False, scan: bool = False, chars: bool = False) -> Query:
        return R.prepare(q if isinstance(q, (Leaf, Bool)) else parse(q), icase, trim=not scan, chars=chars)

    def _within(self, only: str | None) -> DataFrame:
        return self.corpus.filter(F.regexp_like("info", F.lit(only))) if only else self.corpus

    def _docs(self, q: Query, corpus: DataFrame, scan: bool) -> DataFrame:
        if isinstance(q, Leaf):
            return search.documents(corpus, q)
        if q.op in ("THEN", "WITHIN"):
            return self._places(q, corpus, scan).select("doc").distinct()
        if q.op in ("AND", "OR", "NOT") and (test := self._condition(q)) is not None:
            return corpus.filter(F.col("content").isNotNull() & test).select("doc")  # one scan, no join
        left, right = self._docs(q.left, corpus, scan), self._docs(q.right, corpus, scan)
        if q.op == "AND":
            return left.join(right, "doc", "left_semi")
        return left.unionByName(right).distinct() if q.op == "OR" else left.join(right, "doc", "left_anti")

    def _condition(self, q: Query):
        """The query as one condition on a document's content, where every part of it can be."""
        if isinstance(q, Leaf):
            return search.holds(q, F.col("content")) if q.approx is None else None
        if q.op in ("THEN", "WITHIN"):
            return None
        left, right = self._condition(q.left), self._condition(q.right)
        if left is None or right is None:
            return None
        return left & right if q.op == "AND" else left | right if q.op == "OR" else left & ~right

    def _places(self, q: Query, corpus: DataFrame, scan: bool) -> DataFrame:
        if isinstance(q, Leaf):
            return search.places(corpus, q, scan).select("doc", "offset")
        if q.op == "OR":
            return self._places(q.left, corpus, scan).unionByName(self._places(q.right, corpus, scan)).distinct()
        f = proximity.then if q.op == "THEN" else proximity.within
        if q.op == "THEN" and isinstance(q.left, Leaf) and isinstance(q.right, Leaf) and (test := self._condition(Bool("AND", q.left, q.right))) is not None:
            corpus = corpus.filter(F.col("content").isNotNull() & test)  # a document without either has no pair
        return f(self._places(q.left, corpus, scan), self._places(q.right, corpus, scan), q.distance)

    def find_docs(self, q, icase: bool = False, only: str | None = None, scan: bool = False, limit: int | None = None, chars: bool = False) -> DataFrame:
        """doc of the documents that a query gives. With ``chars``, ``.`` stands for a character of UTF-8 rather than a byte."""
        q = self._query(q, icase, scan, chars)
        R.result_type(q)
        out = self._docs(q, self._within(only), scan)
        return out if limit is None else out.orderBy("doc").limit(limit)

    def find_places(self, q, icase: bool = False, only: str | None = None, scan: bool = False, limit: int | None = None) -> DataFrame:
        """doc, offset of the places that a query gives; AND and NOT give documents, with a null offset."""
        q = self._query(q, icase, scan)
        if R.result_type(q) == R.DOCS:
            out = self._docs(q, self._within(only), scan).select("doc", F.lit(None).cast("long").alias("offset"))
        else:
            out = self._places(q, self._within(only), scan)
        return out if limit is None else out.orderBy("doc", "offset").limit(limit)

    def matches(self, q, icase: bool = False, only: str | None = None, scan: bool = False) -> DataFrame:
        """match (binary), cost (least), n: the distinct strings that the query's patterns match, longest first."""
        out = None
        for leaf in R.leaves(self._query(q, icase, scan)):
            one = search.places(self._within(only), leaf, scan, matched=True).groupBy("match").agg(F.min("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
        total = out.groupBy("match").agg(F.min("cost").alias("cost"), F.sum("n").cast("long").alias("n"))
        return total.orderBy(F.length("match").desc(), "match")

    def count(self, q, icase: bool = False, only: str | None = None, scan: bool = False) -> DataFrame:
        """One row, n: matches of all patterns of the query, each counted by itself."""
        leaves = R.leaves(self._query(q, icase, scan))
        if all(x.literal is not None or scan and x.approx is None for x in leaves):
            return search.counts(self._within(only), {str(k): x for k, x in enumerate(leaves)}).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
        out = None
        for x in leaves:
            one = search.count(self._within(only), x, scan)
            out = one if out is None else out.unionByName(one)
        return out.agg(F.sum("n").cast("long").alias("n"))

    def counts(self, patterns: list[str], icase: bool = False) -> DataFrame:
        """pattern, n of many patterns in one scan."""
        return search.counts(self.corpus, {p: R.leaves(self._query(p, icase))[0] for p in patterns})

    def suggest(self, s: str | bytes, starts: int = 8) -> DataFrame:
        """suggestion (binary), n: longest prefixes and the longest suffix of a string that occur more often than it does.

        Prefixes are cut from the right, up to ``starts`` of them; the suffix is the longest whose count differs from the string's.
        Of suggestions with equal counts the longest stays, and of all the longest are given.
        """
        s = s.encode() if isinstance(s, str) else s
        parts = {s: "whole"} | {s[:k]: "prefix" for k in range(len(s) - 1, max(0, len(s) - 1 - starts), -1)} | {s[k:]: "suffix" for k in range(1, len(s))}
        n = search.counts(self.corpus, {p.hex(): raw(p) for p in parts}).select(F.unhex("pattern").alias("suggestion"), "n")
        whole = n.filter(F.col("suggestion") == F.lit(s)).select(F.col("n").alias("whole_n"))
        rows = n.crossJoin(F.broadcast(whole)).filter((F.col("suggestion") != F.lit(s)) & (F.col("n") > F.col("whole_n")))
        is_prefix = F.startswith(F.lit(s), F.col("suggestion"))
        rows = rows.withColumn("size", F.length("suggestion")).withColumn("kind", F.when(is_prefix, 0).otherwise(1))
        best = rows.groupBy("kind", "n").agg(F.max(F.struct("size", "suggestion")).alias("b")).select("kind", "n", "b.size", "b.suggestion")
        most = best.groupBy("kind").agg(F.max("size").alias("most"))
        return best.join(F.broadcast(most), "kind").filter("size = most").select("suggestion", "n").distinct()

    def context(self, q, before: int, after: int, icase: bool = False) -> DataFrame:
        """doc, offset, context (binary) of every match of a pattern."""
        (leaf,) = R.leaves(self._query(q, icase))
        hits = search.places(self.corpus, leaf)
        return hits.join(self.corpus.select("doc", "content"), "doc").select("doc", "offset", around(F.col("content"), F.col("offset"), F.col("length"), before, after).alias("context"))

    def grep(self, q, icase: bool = False, limit: int = 1024) -> DataFrame:
        """doc, offset, line (binary, null where it is too long or holds NUL) of every match: the bytes between line ends around it."""
        hits = self.find_places(q, icase)
        text = latin(F.col("content"))
        rows = hits.join(self.corpus.select("doc", text.alias("t")), "doc")
        head = F.expr(f"substring(t, greatest(0, offset - {limit}) + 1, least(offset, {limit}))")
        tail = F.expr(f"substring(t, int(offset) + 1, {limit})")
        left, right = F.regexp_extract(head, "[^\\n\\r]*\\z", 0), F.regexp_extract(tail, "^[^\\n\\r]*", 0)
        line = F.concat(left, right)
        bad = (F.length(left) >= limit) | (F.length(right) >= limit) | F.contains(line, F.lit("\0"))
        return rows.select("doc", "offset", F.when(~bad, F.encode(line, "ISO-8859-1")).alias("line"))

    def multigrep(self, q, icase: bool = False) -> DataFrame:
        """line (binary), infos (sorted array): equal lines with the documents that hold them."""
        lines = self.grep(q, icase).filter("line is not null").select("doc", "line").distinct()
        return lines.join(self.corpus.select("doc", "info"), "doc").groupBy("line").agg(F.sort_array(F.collect_set("info")).alias("infos"))

    def neighbours(self, s: str | bytes, side: str = "both") -> DataFrame:
        """side, byte (null at a document's end), n: the bytes next to the occurrences of a string."""
        s = s.encode() if isinstance(s, str) else s
        hits = search.places(self.corpus, raw(s)).join(self.corpus.select("doc", "content"), "doc")
        out = None
        for name, at in (("left", F.col("offset")), ("right", F.col("offset") + len(s) + 1)):
            if side in (name, "both"):
                byte = F.when(at > 0, F.substring("content", at.cast("int"), F.lit(1)))
                one = hits.select(F.lit(name).alias("side"), F.when(F.length(byte) > 0, F.conv(F.hex(byte), 16, 10).cast("int")).alias("byte")).groupBy("side", "byte").agg(F.count(F.lit(1)).alias("n"))
                out = one if out is None else out.unionByName(one)
        return out

    def extract(self, info: str | None = None, names: list[str] | None = None, docs: list[int] | None = None) -> DataFrame:
        """Documents by a regular expression on their info, by info or by number; all without any of these."""
        tests = ([F.regexp_like("info", F.lit(info))] if info else []) + ([F.col("info").isin(names)] if names else []) + ([F.col("doc").isin(docs)] if docs else [])
        out = self.corpus
        if tests:
            t = tests[0]
            for x in tests[1:]:
                t = t | x
            out = out.filter(t)
        return out

    def sizes(self) -> DataFrame:
        """doc, info, bytes."""
        return self.corpus.select("doc", "info", F.length("content").cast("long").alias("bytes"))

    def request(self, text: str) -> DataFrame:
        """A request in one line: ``find_docs MAX OFFSETS? query``, ``find_strings pattern``, ``string_rows[_left|_right|_all] byte ...``."""
        name, _, rest = text.strip().partition(" ")
        if name == "find_docs":
            most, offsets, q = rest.split(None, 2)
            return self.find_places(q, limit=int(most)) if offsets != "0" else self.find_docs(q, limit=int(most))
        if name == "find_strings":
            return self.matches(rest)
        if m := re.fullmatch(r"string_rows_(left|right|all)", name):
            return self.neighbours(bytes(map(int, rest.split())), "both" if m[1] == "all" else m[1])
        if name == "string_rows":
            return search.count(self.corpus, raw(bytes(map(int, rest.split()))))
        raise ValueError(f"no such request: {name!r}")


def pattern_file(path: str, literal: bool = False) -> Query:
    """The query in a file, or with ``literal`` the file's bytes as a pattern; a line end at the file's end isn't part of it."""
    with open(path, "rb") as f:
        text = f.read().removesuffix(b"\n")
    return raw(text) if literal else parse(text)


def by_index(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora as one, with ``index_id``; documents keep their numbers."""
    out = None
    for name, df in corpora.items():
        one = df.select(F.lit(name).alias("index_id"), "doc", "info", "content")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["Engine", "Lit", "by_index", "pattern_file", "show"]
