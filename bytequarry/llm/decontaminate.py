"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of 13 consecutive words of the benchmark items (a shorter item is one window).
A shift table over blocks of two words says how far a document position can be skipped; where the shift
is zero, a bucket keyed by the block that ends the window gives the windows to compare word by word.

Documents are read once by a narrow map and never shuffled, so hot sources and copies are no matter.
The benchmark is split into shards of at most ``SHARD_WORDS`` words, each one broadcast file. A worker holds the tables of
one shard at a time: of the only one for good, of several each for ``STRETCH`` bytes of text, so a large benchmark costs time and no memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WINDOW = 13
#: Words of benchmark items in one broadcast shard.
SHARD_WORDS = 500_000
#: Rows that are read at once, and bytes of text that meet one shard after the other where there are several.
ROWS, STRETCH = 500, 32_000_000
#: A document is contaminated if its hit words are at least 1 in so many.
ONE_IN = 20
#: From so many words on, one occurrence of a window is a passage of the benchmark.
PASSAGE = 8

#: ASCII letters to lower case, digits and bytes from 0x80 kept, everything else to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of ASCII letters and digits and of all characters from U+0080; UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """All windows of equal length ``m``, searched in a list of words."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, window: tuple, item) -> None:
        m, b = self.m, self.block
        for end in range(b, m + 1):
            key = window[end - b : end]
            if self.shift.get(key, self.far) > m - end:
                self.shift[key] = m - end
        self.bucket.setdefault(window[m - b :], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(end position, items) of every occurrence."""
        m, b, far, n = self.m, self.block, self.far, len(words)
        shift, bucket = self.shift.get, self.bucket
        end = m
        if b == 2:
            while end <= n:
                key = (words[end - 2], words[end - 1])
                if s := shift(key, far):
                    end += s
                    continue
                if items := bucket[key].get(tuple(words[end - m : end])):
                    yield end, items
                end += 1
        else:
            for end in range(1, n + 1):
                if items := bucket.get((words[end - 1],)):
                    yield end, items[(words[end - 1],)]


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each window length that occurs among (item id, text) pairs."""
    by: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for at in range(len(words) - m + 1) if m else ():
            by.setdefault(m, WuManber(m)).add(tuple(words[at : at + m]), item)
    return [by[m] for m in sorted(by)]


def _shards(spark, benchmark: DataFrame, id_col: str, text_col: str):
    """Broadcasts of at most SHARD_WORDS words of items each (one item at least); items stream through the driver one at a time."""
    part: list = []
    size, out = 0, []
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        n = len(words_of(text))
        if part and size + n > SHARD_WORDS:
            out.append(spark.sparkContext.broadcast(part))
            part, size = [], 0
        if n and item is not None:
            part.append((item, text))
            size += n
    return [*out, spark.sparkContext.broadcast(part)] if part else out


_LOADED: dict = {}


def _searcher(shard, window: int) -> list[WuManber]:
    """A shard's searchers; the last ones built stay in the worker."""
    key = (shard._jbroadcast.id() if getattr(shard, "_jbroadcast", None) is not None else getattr(shard, "_path", None), window)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = build(shard.value, window)
    return _LOADED[key]


def _stretches(batches, at: int, shards: int) -> Iterator[list]:
    """Slices of batches. With one shard each comes alone; with more, slices of about STRETCH bytes of text come together, so that
    every shard's tables are built once a stretch."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            piece = batch.slice(k, ROWS)
            if shards < 2:
                yield [piece]
                continue
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column(at))).as_py() or 0
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _marked(pieces: list, at: int, shards: list, window: int) -> list[tuple]:
    """Of every row of the slices: its number of words, a byte of 1 for each hit word, the items, and the longest window."""
    rows = [[] for _ in pieces]
    if len(shards) < 2:
        texts = [[words_of(t) for t in p.column(at).to_pylist()] for p in pieces]
    else:  # words are made anew for each shard, as those of a whole stretch would take far more room than its texts
        texts = [None] * len(pieces)
    for n, p in enumerate(pieces):
        rows[n] = [None] * p.num_rows
    for shard in shards or [None]:
        searchers = _searcher(shard, window) if shard else []
        for n, p in enumerate(pieces):
            for k, words in enumerate(texts[n] or map(words_of, p.column(at).to_pylist())):
                row = rows[n][k] = rows[n][k] or [len(words), bytearray(len(words)), set(), 0]
                row[3] = max(row[3], hits_of(words, searchers, row[1], row[2]))
    return rows


def hits_of(words: list[bytes], searchers: list[WuManber], hit: bytearray, items: set) -> int:
    """Mark the words inside occurrences, and gather the items; gives the length of the longest window that occurs."""
    longest = 0
    for s in searchers:
        done = 0
        for end, found in s.search(words):
            start = max(done, end - s.m)
            hit[start:end] = b"\x01" * (end - start)
            done = end
            items |= found
            longest = max(longest, s.m)
    return longest


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items (array, sorted as strings), items_sha256, contaminated.

    Whole texts are searched, of any length. A null or empty text has no words, no hits and is not contaminated; items that are null, empty or have a
    null id have no windows; repeated items count once by id; repeated documents give repeated rows; an empty
    benchmark contaminates nothing, an empty table gives an empty one. A word in several occurrences is one hit. Other columns are ignored, whatever their names.
    """
    shards = _shards(documents.sparkSession, benchmark, item_col, item_text_col)
    kind = documents.schema[id_col].dataType.simpleString()
    schema = T.StructType.fromDDL(f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for pieces in _stretches(batches, 1, len(shards)):
            for piece, rows in zip(pieces, _marked(pieces, 1, shards, window), strict=True):
                n_words, n_hit, items = [r[0] for r in rows], [r[1].count(1) for r in rows], [sorted(r[2]) for r in rows]
                sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                bad = [h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words, strict=True)]
                cols = (piece.column(0), n_words, n_hit, [len(x) for x in items], items, sums, bad)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, passage: int = PASSAGE, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns unchanged, without passages of the benchmark: a map and no join back.

    One occurrence of a window of ``passage`` words or more is enough, however long the text around it; shorter items, down to single
    words, count only where a document is contaminated as a whole (``one_in``). Null, empty and wordless texts hold none and stay; repeated rows
    stay or go together; an empty table gives an empty one, and an empty benchmark takes nothing away. Columns may have any names.
    """
    shards = _shards(documents.sparkSession, benchmark, item_col, item_text_col)
    at = documents.columns.index(text_col)

    def run(batches):
        for pieces in _stretches(batches, at, len(shards)):
            for piece, rows in zip(pieces, _marked(pieces, at, shards, window), strict=True):
                bad = [longest >= passage or 0 < len(w) <= one_in * w.count(1) for _, w, _, longest in rows]
                yield piece.filter(pa.array([not x for x in bad], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
