"""Patterns against a corpus: documents, places, counts and matched strings.

A corpus has ``doc`` (long), ``info`` (string) and ``content`` (binary). Counting and choosing documents stays in the
JVM; places and strings with the index's rules need state from one start to the next, so they are Arrow maps, which see only the
documents that a JVM filter lets through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions.octets import latin
from bytequarry.plans import rewrites as R
from bytequarry.plans.syntax import Alt, Approx, Chars, Control, Leaf, Lit, Regex, Repeat, Seq

#: Documents that a worker takes at once.
ROWS = 500


def _java(leaf: Leaf) -> str:
    return R.pattern(leaf.regex).replace("\\Z", "\\z")


def _subject(content: Column) -> Column:
    """The text that Java's expressions run on: a character a byte."""
    return latin(content)


def holds(leaf: Leaf, content: Column) -> Column:
    """Does the content match? For approximate patterns a necessary condition."""
    if leaf.approx is not None:
        return _may_hold(leaf, content)
    if leaf.literal is not None:
        return F.contains(content, F.lit(leaf.literal)) if leaf.literal else F.lit(True)
    if isinstance(leaf.regex, Alt) and all(isinstance(c, Lit) for c in leaf.regex.choices):
        out = F.lit(False)
        for c in leaf.regex.choices:
            out = out | F.contains(content, F.lit(c.value))
        return out
    need = [F.contains(content, F.lit(s)) for s in required(leaf.regex)]
    test = F.regexp_like(_subject(content), F.lit(f"(?s){_java(leaf)}"))
    return need[0] & test if need else test


def required(x: Regex) -> list[bytes]:
    """The longest string that every match must hold, if there is one: a cheap test before the expression."""
    found = [y.value for y in (x.items if isinstance(x, Seq) else (x,)) if isinstance(y, Lit)]
    for y in x.items if isinstance(x, Seq) else (x,):
        if isinstance(y, Repeat) and y.low > 0:
            found += required(y.item)
    return [max(found, key=len)] if found and max(map(len, found)) > 0 else []


def pieces(leaf: Leaf) -> list[tuple[bytes, int, int]]:
    """(piece, its place in the string it is cut from, that string's length): of a match with at most k errors one of k + 1 pieces of a string that
    every exact match holds is whole. None if there is no such string, or it is too short."""
    a = leaf.approx
    k = a.most // min(a.substitute, a.delete, a.insert)
    need = [leaf.regex.value] if isinstance(leaf.regex, Lit) else required(leaf.regex)
    if not need or len(need[0]) <= k:
        return []
    s = need[0]
    cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
    return [(s[a:b], a, len(s)) for a, b in zip(cuts, cuts[1:], strict=False)]


def longest(x: Regex) -> int | None:
    """Bytes of the longest exact match, if there is one."""
    if isinstance(x, Lit):
        return len(x.value)
    if isinstance(x, Repeat):
        n = longest(x.item)
        return None if x.high is None or n is None else n * x.high
    if isinstance(x, (Seq, Alt)):
        sizes = [longest(y) for y in (x.items if isinstance(x, Seq) else x.choices)]
        return None if None in sizes else sum(sizes) if isinstance(x, Seq) else max(sizes)
    return 1


def _may_hold(leaf: Leaf, content: Column) -> Column:
    """Does the content hold a piece that an approximate match must hold?"""
    out = None
    for piece, _, _ in pieces(leaf):
        one = F.contains(content, F.lit(piece))
        out = one if out is None else out | one
    return F.lit(True) if out is None else out


def occurrences(leaf: Leaf, content: Column) -> Column:
    """At how many offsets a match begins; overlapping ones count each. Not for approximate patterns."""
    if leaf.literal == b"":
        return (F.length(content) + 1).cast("long")
    return F.regexp_count(_subject(content), F.lit(f"(?s)(?=(?:{_java(leaf)}))")).cast("long")


# ------------------------------------------------------------------ places


def literal_places(data: bytes, s: bytes) -> Iterator[tuple[int, int]]:
    at = data.find(s)
    while at >= 0:
        yield at, at + len(s)
        at = data.find(s, at + 1)


def index_places(data: bytes, expression: re.Pattern) -> list[tuple[int, int]]:
    """Lazy matches at every start, in order; of starts in a row that end at the same place the last one stays."""
    out: list[tuple[int, int]] = []
    for m in expression.finditer(data):
        end = m.end(1)
        if out and out[-1][1] == end:
            out[-1] = (m.start(), end)
        else:
            out.append((m.start(), end))
    return out


class Automaton:
    """A pattern read from its end, with edit costs, over single bytes."""

    def __init__(self, regex: Regex, costs: Approx):
        self.costs = costs
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.ends_doc: set[int] = set()
        start, final = self._new(), self._new()
        self._build(regex, start, final)
        self.start, self.final = start, final

    def _new(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def _build(self, x: Regex, a: int, b: int) -> None:
        if isinstance(x, Lit):
            for c in reversed(x.value):
                n = self._new()
                self.steps[a].append((frozenset((c,)), n))
                a = n
            self.free[a].append(b)
        elif isinstance(x, Chars):
            self.steps[a].append((x.members, b))
        elif isinstance(x, Control):
            raise ValueError("an approximate pattern can't hold control characters")
        elif isinstance(x, Seq):
            for y in reversed(x.items):
                n = self._new()
                self._build(y, a, n)
                a = n
            self.free[a].append(b)
        elif isinstance(x, Alt):
            for y in x.choices:
                self._build(y, a, b)
        else:
            for _ in range(x.low):
                n = self._new()
                self._build(x.item, a, n)
                a = n
            if x.high is None:
                n = self._new()
                self.free[a].append(n)
                self._build(x.item, n, a)
            for _ in range((x.high or x.low) - x.low):
                n = self._new()
                self.free[a].append(b)
                self._build(x.item, a, n)
                a = n
            self.free[a].append(b)

    def _spread(self, costs: dict[int, int]) -> dict[int, int]:
        """Steps that take no byte: free ones, and pattern bytes that the data lacks."""
        todo = list(costs)
        while todo:
            s = todo.pop()
            c = costs[s]
            for n in self.free[s]:
                if c < costs.get(n, 1 << 30):
                    costs[n] = c
                    todo.append(n)
            if c + self.costs.delete <= self.costs.most:
                for _, n in self.steps[s]:
                    if c + self.costs.delete < costs.get(n, 1 << 30):
                        costs[n] = c + self.costs.delete
                        todo.append(n)
        return costs

    def shortest(self, data: bytes, end: int) -> tuple[int, int] | None:
        """(start, cost) of the shortest match that ends there; its last byte isn't substituted or inserted."""
        now, at, first = self._spread({self.start: 0}), end, True
        k = self.costs
        while at > 0:
            at -= 1
            c, then = data[at], {}
            for s, cost in now.items():
                for members, n in self.steps[s]:
                    price = cost if c in members else cost + k.substitute if not first else k.most + 1
                    if price <= k.most and price < then.get(n, 1 << 30):
                        then[n] = price
                if not first and cost + k.insert <= k.most and cost + k.insert < then.get(s, 1 << 30):
                    then[s] = cost + k.insert
            if not then:
                return None
            now, first = self._spread(then), False
            if self.final in now:
                return at, now[self.final]
        return None


def approximate_places(data: bytes, leaf: Leaf, machine: Automaton) -> list[tuple[int, int, int]]:
    """(start, end, cost), one for each end and start, the cheapest of a start. Only ends near a piece that the match must hold are tried, where
    there are such pieces and the pattern's length is bounded."""
    k = leaf.approx.most // min(leaf.approx.substitute, leaf.approx.delete, leaf.approx.insert)
    found, most = pieces(leaf), longest(leaf.regex)
    if found and most is not None:
        ends: set[int] = set()
        exact = isinstance(leaf.regex, Lit)
        for piece, at, size in found:
            for start, _ in literal_places(data, piece):
                middle = start + size - at
                low, high = (middle - k, middle + k) if exact else (start + len(piece), start + most + k)
                ends.update(range(max(1, low), min(len(data), high) + 1))
        todo: Iterator[int] = iter(sorted(ends))
    else:
        todo = iter(range(1, len(data) + 1))
    best: dict[int, tuple[int, int]] = {}
    for end in todo:
        if hit := machine.shortest(data, end):
            start, cost = hit
            if start not in best or cost < best[start][1]:
                best[start] = (end, cost)
    return [(s, e, c) for s, (e, c) in sorted(best.items())]


def _finder(leaf: Leaf, scan: bool):
    """A function from bytes to (start, end, cost) triples."""
    if leaf.approx is not None:
        machine = Automaton(leaf.regex, leaf.approx)
        return lambda data: approximate_places(data, leaf, machine)
    if leaf.literal is not None:
        s = leaf.literal
        return lambda data: [(a, b, 0) for a, b in literal_places(data, s)]
    expression = re.compile(f"(?s)(?=({R.pattern(leaf.regex, lazy=True)}))".encode("latin-1"))
    if scan:
        return lambda data: [(m.start(), m.end(1), 0) for m in expression.finditer(data)]
    return lambda data: [(a, b, 0) for a, b in index_places(data, expression)]


def places(corpus: DataFrame, leaf: Leaf, scan: bool = False, matched: bool = False) -> DataFrame:
    """doc, offset, length, cost[, match] of every match: by the index's rules, or of all starts with ``scan``."""
    found: dict = {}
    schema = "doc long, offset long, length long, cost int" + (", match binary" if matched else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not found:
            found["f"] = _finder(leaf, scan)
        f = found["f"]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                piece = batch.slice(k, ROWS)
                docs, offsets, lengths, costs, strings = [], [], [], [], []
                for doc, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for a, b, c in f(data):
                        docs.append(doc)
                        offsets.append(a)
                        lengths.append(b - a)
                        costs.append(c)
                        if matched:
                            strings.append(data[a:b])
                cols = [pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(costs, pa.int32())]
                names = ["doc", "offset", "length", "cost"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(strings, pa.binary())] * matched, names=names + ["match"] * matched)

    chosen = corpus.select("doc", "content").filter(F.col("content").isNotNull() & holds(leaf, F.col("content")))
    return chosen.mapInArrow(run, schema)


def documents(corpus: DataFrame, leaf: Leaf) -> DataFrame:
    """doc of every document with a match."""
    if leaf.approx is not None:
        return places(corpus, leaf).select("doc").distinct()
    return corpus.filter(F.col("content").isNotNull() & holds(leaf, F.col("content"))).select("doc")


def count(corpus: DataFrame, leaf: Leaf, scan: bool = False) -> DataFrame:
    """One row with n, the number of matches in the corpus."""
    if leaf.literal is not None or scan and leaf.approx is None:
        chosen = corpus.filter(F.col("content").isNotNull() & holds(leaf, F.col("content")))
        return chosen.agg(F.coalesce(F.sum(occurrences(leaf, F.col("content"))), F.lit(0)).cast("long").alias("n"))
    return places(corpus, leaf, scan).agg(F.count(F.lit(1)).alias("n"))


def counts(corpus: DataFrame, patterns: dict[str, Leaf]) -> DataFrame:
    """pattern, n for many patterns: one scan of the corpus and one pass of partial sums, whatever their number."""
    exact = {k: p for k, p in patterns.items() if p.approx is None}
    one = corpus.filter(F.col("content").isNotNull())
    pairs = F.array(*(F.struct(F.lit(k).alias("pattern"), F.when(holds(p, F.col("content")), occurrences(p, F.col("content"))).otherwise(F.lit(0).cast("long")).alias("n")) for k, p in exact.items()))
    out = one.select(F.explode(pairs).alias("x")).groupBy("x.pattern").agg(F.sum("x.n").cast("long").alias("n")) if exact else None
    for k, p in patterns.items():
        if p.approx is not None:
            row = count(corpus, p).select(F.lit(k).alias("pattern"), "n")
            out = row if out is None else out.unionByName(row)
    return out
