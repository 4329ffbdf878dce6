"""Language identification: script ranges narrow the candidates, then Viterbi with a switching penalty labels spans.

The model counts letter trigrams (with word edges) of all training rows of each language, in ``BUCKETS`` hashed
buckets, and the scripts that each language is written in. A word's score for a language is the sum of its
trigrams' log-probabilities, clipped to ``CLIP`` below its best language. Only the languages that are written in the word's
script are candidates: the others aren't scored and the word can't have them. Combining marks belong to the letter before them. Viterbi over a document's words pays ``SWITCH`` for each change of
language. Counting is one map with per-task totals and a small aggregate; labelling is one map. Both run in numpy over whole
batches, so the cost per character is constant and no step is taken per word in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm._common import map_rows, tidy

BUCKETS = 1 << 15
#: The model is broadcast; so many languages at most (BUCKETS * 4 bytes each).
MAX_LANGS = 256
SWITCH, CLIP, BARRED = 10.0, 12.0, -1e4
UND = "und"
#: Characters that are scored at once, and words that Viterbi takes at once.
CHARS, WORDS = 1 << 18, 1 << 19
#: Rows that a worker labels at once.
ROWS = 2000

#: First code points of script ranges; a script runs to the next one's start. Number 0 is Latin and what is listed nowhere.
_SCRIPTS = ((0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 6), (0x750, 5), (0x780, 7), (0x8A0, 5), (0x900, 8), (0x980, 9), (0xA00, 10), (0xA80, 11), (0xB00, 12), (0xB80, 13), (0xC00, 14), (0xC80, 15), (0xD00, 16), (0xD80, 17), (0xE00, 18), (0xE80, 19), (0xF00, 20), (0x1000, 21), (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x13A0, 25), (0x1400, 26), (0x1780, 27), (0x1800, 28), (0x1C80, 2), (0x1C90, 22), (0x1D00, 0), (0x1F00, 1), (0x2000, 0), (0x2C00, 0), (0x2C60, 0), (0x2D00, 22), (0x2D30, 29), (0x2D80, 24), (0x2DE0, 2), (0x2E80, 30), (0x3040, 31), (0x3100, 32), (0x3130, 23), (0x3190, 30), (0x4DC0, 30), (0xA000, 33), (0xA4D0, 0), (0xA640, 2), (0xA6A0, 0), (0xAC00, 23), (0xD7B0, 23), (0xF900, 30), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0xFE70, 5), (0xFF00, 0), (0xFF66, 31), (0x10000, 34), (0x20000, 30), (0x30000, 30), (0x32000, 0))
N_SCRIPTS = 35
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower-case letter or combining mark (0: neither), its script, and whether it is a mark."""
    if not _TABLES:
        lower, mark = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                x = s.lower()
                lower[c] = ord(x) if len(x) == 1 else c
            elif unicodedata.category(s)[0] == "M":
                lower[c] = c
                mark[c] = True
        script = np.zeros(0x110000, np.uint8)
        for (a, k), (b, _) in zip(_SCRIPTS, [*_SCRIPTS[1:], (0x110000, 0)], strict=True):
            script[a:b] = k
        _TABLES["x"] = lower, script, mark
    return _TABLES["x"]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], str]]:
    """The texts joined by a newline, in pieces of about CHARS: (text numbers, their starts in the piece, text).

    A longer text is cut behind a space where there is one; a text number may so come again in the next piece.
    """
    numbers, starts, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = min(len(t), at + CHARS)
            if end < len(t) and (space := t.rfind(" ", at, end)) > at:
                end = space + 1
            if size and size + end - at > CHARS:
                yield numbers, starts, "\n".join(parts)
                numbers, starts, parts, size = [], [], [], 0
            numbers.append(k)
            starts.append(size)
            parts.append(t[at:end])
            size += end - at + 1
            at = end
    if parts:
        yield numbers, starts, "\n".join(parts)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: positions of letters, their trigrams' buckets, which letters begin words, and the words' scripts."""
    lower, script, mark = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(points) + 2, np.uint32)
    code[1:-1] = lower[points]
    if (marks := mark[points]).any():  # a mark belongs to the letter before it, and without one to no word
        inside = code[1:-1] > 0
        begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        letters = np.add.reduceat(inside & ~marks, begin) if len(begin) else np.zeros(0, int)
        word = np.cumsum(np.isin(np.arange(len(points)), begin)) - 1
        code[1:-1][inside & (letters[word] == 0)] = 0
    at = np.flatnonzero(code[1:-1])
    h = code[at] * np.uint32(0x9E3779B1) + code[at + 1] * np.uint32(0x85EBCA6B) + code[at + 2] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(code[at] == 0)
    return at, (h >> np.uint32(17)).astype(np.int64), first, script[points[at[first]]]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model of all rows with a language: names (sorted), log-probabilities (bucket x language), script penalties."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list] = {}
            for t, x in zip(texts, langs, strict=True):
                if t:
                    by.setdefault(x, []).append(t)
            for x, own in by.items():
                n = total.setdefault(x, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for _, _, text in _pieces(own):
                    _, h, _, script = _grams(text)
                    n[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(script, minlength=N_SCRIPTS)
        for x, n in total.items():
            keys = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n[keys], pa.int64())], names=["lang", "bucket", "n"])

    labelled = rows.select(F.col(text_col), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col(text_col).isNotNull())
    # no more names than the bound come to the driver, and counts only of so many languages
    langs = sorted(r.lang for r in labelled.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; the model is bounded by that")
    counts = labelled.mapInArrow(lambda batches: tidy(count(batches)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    number = {x: k for k, x in enumerate(langs)}
    n = np.zeros((BUCKETS + N_SCRIPTS, max(len(langs), 1)))
    n[counts["bucket"].to_numpy(np.int64), counts["lang"].map(number).to_numpy(np.int64)] = counts["n"].to_numpy(float)
    grams, scripts = n[:BUCKETS] + 0.5, n[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(0), 1)
    used = share >= 0.001
    # the languages that words of a script may have: those written in it, or all where none is
    allowed = used | ~used.any(1, keepdims=True)
    return {"langs": langs, "logp": np.log(grams / grams.sum(0)).astype(np.float32), "allowed": allowed}


def _scores(model: dict, h: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Words x languages: the log-probabilities of the words' trigrams, less the best language's and clipped, for the languages that the
    word's script leaves; the others are barred and aren't scored."""
    logp, allowed = model["logp"], model["allowed"]
    kinds = np.unique(script)
    out = np.full((len(first), logp.shape[1]), BARRED, np.float32)
    sizes = np.diff(np.r_[first, len(h)])
    for k in kinds.tolist():
        langs = np.flatnonzero(allowed[k])
        words, grams, begin = slice(None), h, first
        if len(kinds) > 1:
            words = np.flatnonzero(script == k)
            grams = h[np.repeat(script == k, sizes)]
            begin = np.cumsum(sizes[words]) - sizes[words]
        e = np.add.reduceat((logp if len(langs) == logp.shape[1] else np.ascontiguousarray(logp[:, langs]))[grams], begin, axis=0)
        e -= e.max(1, keepdims=True)
        np.maximum(e, -CLIP, out=e)
        if len(langs) == logp.shape[1]:
            out[words] = e
        else:
            out[np.ix_(np.arange(len(first)) if isinstance(words, slice) else words, langs)] = e
    return out


def _viterbi(e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best language of each word. e: words x languages, text after text; sizes: words of each text (none is 0)."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    length, k = sizes[order], e.shape[1]
    back = np.empty(e.shape, np.int8 if k <= 127 else np.int16)
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts with more than t words
    score = e[starts].copy()
    langs = np.arange(k)
    for t in range(1, length[0]):
        m = active[t]
        s = score[:m]
        top = s.argmax(1)
        jump = s[np.arange(m), top] - SWITCH
        stay = s >= jump[:, None]
        at = starts[:m] + t
        back[at] = np.where(stay, langs, top[:, None])
        score[:m] = np.where(stay, s, jump[:, None]) + e[at]
    label = np.empty(len(e), np.int64)
    state = score.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return label


def label(texts: list[str | None], model: dict) -> list[tuple[str, float, str]]:
    """(language, score, spans) of each text. score: the share of the letters that lie in words of that language."""
    out: list = [(UND, 0.0, "")] * len(texts)
    langs = model["langs"]
    if not langs:
        return out
    parts: list = []
    gathered = 0
    base = np.zeros(len(texts) + 1, np.int64)  # where the next piece of a text begins

    def flush():
        nonlocal parts, gathered
        if parts:
            owner, e, begin, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            _decide(owner[new], np.diff(np.r_[new, len(owner)]), e, begin, length, langs, out)
        parts, gathered = [], 0

    last = None
    for numbers, starts, text in _pieces(texts):
        if gathered >= WORDS and numbers[0] != last:
            flush()
        at, h, first, script = _grams(text)
        if len(first):
            e = _scores(model, h, first, script)
            piece = np.searchsorted(starts, at[first], "right") - 1
            owner = np.asarray(numbers)[piece]
            begin = at[first] - np.asarray(starts)[piece] + base[owner]
            parts.append((owner, e, begin, np.diff(np.r_[first, len(at)])))
            gathered += len(first)
        if len(numbers) == 1:
            base[numbers[0]] += len(text)
        else:
            base[numbers[-1]] += len(text) - starts[-1]
        last = numbers[-1]
    flush()
    return out


def _decide(owner, sizes, e, begin, length, langs, out) -> None:
    got = _viterbi(e, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    letters = np.bincount(row * len(langs) + got, weights=length, minlength=len(sizes) * len(langs)).reshape(len(sizes), -1)
    best = letters.argmax(1)
    share = letters[np.arange(len(sizes)), best] / letters.sum(1)
    change = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (got[1:] != got[:-1])])
    ends = np.r_[change[1:], len(got)] - 1
    spans: list[list[str]] = [[] for _ in sizes]
    for r, lang, a, b in zip(row[change].tolist(), got[change].tolist(), begin[change].tolist(), (begin + length)[ends].tolist(), strict=True):
        spans[r].append(f"{langs[lang]}:{a}:{b}")
    for k, (who, b, s) in enumerate(zip(owner.tolist(), best.tolist(), share.tolist(), strict=True)):
        out[who] = (langs[b], float(s), ",".join(spans[k]))


def held_out(id_col: str = "doc_id"):
    """True for rows that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, spans (``lang:start:end`` in code points, comma-joined).

    The model is learned from the rows of ``df`` that aren't held out and have a language; only the text decides a
    prediction. A text that is null, empty or without letters, and every text if nothing could be learned, is ``und``
    with score 0 and no spans. Whole texts are labelled, of any length. Ties go to the first language by name; repeated rows give
    repeated results, an empty table none. Other columns are ignored, whatever their names.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df.filter(~held_out(id_col)), text_col, lang_col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids, held, texts):
        got = label(texts, model.value)
        return {id_col: ids, "held_out": held, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "spans": [g[2] for g in got]}

    flag = "held_out" if id_col.lower() != "held_out" else "held_out_"
    return map_rows(df.select(F.col(id_col), held_out(id_col).alias(flag), F.col(text_col)), run, [id_col, flag, text_col], f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, spans string", rows=ROWS)


def keep_known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0) -> DataFrame:
    """The rows of ``df``, unchanged, whose text has a language: not ``und``, and one with at least ``min_score`` of the letters in it.

    By default a text in any mixture of languages stays. If no language could be learned, the rows whose text has letters stay. Null and
    empty texts, and those without letters, go; repeated rows stay or go together; an empty table gives an empty one; columns may have any names.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df.filter(~held_out(id_col)), text_col, lang_col))
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                piece = batch.slice(k, ROWS)
                texts = piece.column(at).to_pylist()
                if model.value["langs"]:
                    keep = [g[0] != UND and g[1] >= min_score for g in label(texts, model.value)]
                else:
                    keep = [any(map(str.isalpha, t or "")) for t in texts]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(lambda batches: tidy(run(batches)), df.schema)
