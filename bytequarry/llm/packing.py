"""Vector bin packing of tokenised examples into fixed-length training sequences.

Every sequence has limits on tokens, on segments (pieces of examples) and on loss-bearing tokens. The dot-product
heuristic fills one sequence at a time: of the waiting pieces that fit, the one whose demands have the largest dot
product with what is left of the limits comes next. Where nothing fits any more, a piece may be cut to fill the rest.

Each partition is packed on its own as a stream (a narrow map, no shuffle): at most ``POOL`` pieces wait at a time, so
memory doesn't grow with the partition. What is left at a partition's end is cut into powers of two, which need no
padding. Sequence ids hold the partition's number, so they are unique and a retried task gives the same ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bytequarry.llm._common import tidy, tokenizer_path

CAPACITY, MAX_SEGMENTS, END_ID = 4096, 64, 2
#: Pieces that wait for a place at a time.
POOL = 1024
#: Bytes that a worker's cache of tokenised pieces may hold; it is emptied when it has more.
CACHE = 50_000_000
#: Bytes of text that are tokenised at once.
SLICE = 2_000_000

#: In a chunk without white space: all of it if it goes beyond U+00FF, else what the tokenizer's own pattern cuts off from runs of letters.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_CUT = rf"[^{_SPACE}]*[^\x{{0}}-\x{{ff}}{_SPACE}][^{_SPACE}]*|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^{_SPACE}{_LETTER}0-9²³¹¼½¾]+"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The characters that stand for bytes: printable Latin-1 for itself, and the rest in order from U+0100.
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: How the tokenizer that the rules above restate cuts a text. Any other tokenizer encodes whole texts itself.
_RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS, _SUFFIX, _SPECIAL = ["NFC", "Replace", "Lowercase"], "</w>", "<|"
#: Strings of special tokens, and white space to Arrow that isn't to the tokenizer.
_ODD = r"<\||[\x1c-\x1f]"


class Tokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, the same as ``encode(text, add_special_tokens=False)``.

    The tokenizer drops white space and never joins across it, nor across the borders of runs of letters. Arrow cuts the
    texts there, numbers the distinct pieces and strings their cached ids together. Unknown words of letters go to the
    model itself, as characters that stand for their bytes; other unknown pieces are encoded one by one, and texts
    with the strings of special tokens whole. A tokenizer that cuts texts by other rules than those restated here encodes every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Tok

        self.tok = Tok.from_file(path)
        self.known = self._cuts_as_restated(path)
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _cuts_as_restated(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        steps = [n.get("type") for n in (t.get("normalizer") or {}).get("normalizers", [])]
        cuts = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split, level = (cuts[0], cuts[1]) if len(cuts) == 2 else ({}, {})
        own = split.get("type") == "Split" and split.get("pattern") == {"Regex": _RULES} and split.get("behavior") == "Removed" and split.get("invert") is True
        bytes_ = level.get("type") == "ByteLevel" and level.get("add_prefix_space") is False and level.get("use_regex") is False
        model = t.get("model") or {}
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == _SUFFIX and not model.get("dropout")
        return own and bytes_ and plain and steps == _NORMALIZERS and all(x["content"].startswith(_SPECIAL) for x in t.get("added_tokens", []))

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Put the ids of pieces in the cache."""
        cache = self.pieces
        words = [w for w in missing if w.isalpha() and (w.isascii() or _LETTERS.fullmatch(w))]
        ids, cuts, split = [], [0], self.tok.model.tokenize
        for w in words:
            ids += [t.id for t in split(w if w.isascii() else w.lower().encode().decode("latin-1").translate(_BYTES))]
            cuts.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        cache.update(zip(words, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        self.held += len(data) + sum(map(len, words)) + 190 * len(words)
        rest = [m for m in missing if m not in cache]
        for w, x in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True) if rest else ():
            cache[w] = np.array(x.ids, "<u4").tobytes()
            self.held += 4 * len(w) + len(cache[w]) + 190

    def encode_all(self, texts: pa.Array | list) -> Iterator[bytes]:
        """Ids of each text, in slices of about SLICE bytes; none for a null."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE)))
            part = texts.slice(at, end - at)
            yield from self._slice(part) if self.known else map(self._plain, part.to_pylist())
            at = end

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.ascii_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, _CUT, r" \0 "))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.held > CACHE:
            self.pieces, self.held = {"": b""}, 0
        self.pieces.setdefault("", b"")
        if missing := set(names).difference(self.pieces):
            self._learn(list(missing))
        ids = pa.array(map(self.pieces.__getitem__, names), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
        at = ends[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]].tolist()
        for k in range(len(texts)):
            yield self._plain(texts[k].as_py()) if odd[k] else data[at[k] : at[k + 1]].tobytes()


class Packer:
    """One stream's packer. Items are (key, start, ids as bytes, a byte of 1 for each loss-bearing position and 0 for others, or None if all bear loss)."""

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL):
        self.cap = np.array([capacity, max_segments, capacity if max_loss is None else max_loss], float)
        self.capacity, self.max_pool = capacity, pool
        self.items: list[tuple] = []
        self.need = np.zeros((0, 3))
        self.tokens = 0

    @staticmethod
    def _demand(item) -> tuple[int, int, int]:
        n = len(item[2]) // 4
        return n, 1, n if item[3] is None else sum(item[3])

    def add(self, key, ids: bytes, loss: bytes | None = None) -> Iterator[list[tuple]]:
        """Take an example of at least one token; gives the sequences that are complete, as lists of items."""
        n = len(ids) // 4
        at, cut = 0, self.capacity
        while n - at >= cut <= self.cap[2]:  # a whole sequence of one piece
            yield [(key, at, ids[4 * at : 4 * (at + cut)], loss and loss[at : at + cut])]
            at += cut
        if at < n:
            self._push((key, at, ids[4 * at :], loss and loss[at:]))
        if len(self.items) >= self.max_pool:
            yield from self._fill(self.max_pool // 4)

    def _push(self, item) -> None:
        d = self._demand(item)
        if len(self.items) == len(self.need):
            self.need = np.vstack([self.need, np.zeros((max(64, len(self.need)), 3))])
        self.need[len(self.items)] = d
        self.items.append(item)
        self.tokens += d[0]

    def _pop(self, k: int):
        item, last = self.items[k], len(self.items) - 1
        self.items[k] = self.items[last]
        self.need[k] = self.need[last]
        self.items.pop()
        self.tokens -= len(item[2]) // 4
        return item

    def _fill(self, leave: int) -> Iterator[list[tuple]]:
        """Fill sequences while more than ``leave`` pieces wait and they have the tokens of one at least."""
        while len(self.items) > leave and self.tokens >= self.capacity:
            yield self._one()

    def _one(self) -> list[tuple]:
        """A sequence by the dot-product heuristic; a piece is cut to fill what is left."""
        left, out = self.cap.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.items)]
            value = (need / self.cap) @ (left / self.cap)
            value[(need > left).any(1)] = -1
            k = int(value.argmax())
            if value[k] >= 0:
                left -= need[k]
                out.append(self._pop(k))
                continue
            k = int(need[:, 0].argmax())
            key, start, ids, loss = self._pop(k)
            n = int(min(left[0], len(ids) // 4))
            if loss is None:
                n = int(min(n, left[2]))
            else:
                n = min(n, int(np.searchsorted(np.cumsum(np.frombuffer(loss, np.uint8), dtype=np.int64), left[2], "right")))
            if n:
                out.append((key, start, ids[: 4 * n], loss and loss[:n]))
                left -= (n, 1, n if loss is None else sum(loss[:n]))
            if 4 * n < len(ids):
                self._push((key, start + n, ids[4 * n :], loss and loss[n:]))
            break
        size = self.capacity - int(left[0])
        return self._trim(out, 1 << (size.bit_length() - 1)) if 0 < size < self.capacity else out

    def _trim(self, out: list[tuple], size: int) -> list[tuple]:
        """Cut a sequence to ``size`` tokens; the rest waits again."""
        kept, at = [], 0
        for key, start, ids, loss in out:
            n = min(size - at, len(ids) // 4)
            if n:
                kept.append((key, start, ids[: 4 * n], loss and loss[:n]))
            if 4 * n < len(ids):
                self._push((key, start + n, ids[4 * n :], loss and loss[n:]))
            at += n
        return kept

    def finish(self) -> Iterator[list[tuple]]:
        """The last sequences: full ones, then powers of two."""
        while self.items:
            yield self._one()


_TOKENIZERS: dict[str, Tokenizer] = {}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), loss_tokens, doc_tokens, sequence_id, offset.

    An example is the ids of its prompt (``prompt_col``, if given; no loss), then those of its text and ``end_id``
    (all with loss). A null or empty text is just ``end_id``. A piece's loss-bearing tokens, with those of the other
    pieces of its sequence, stay within ``max_loss`` (default: no limit beside ``capacity``). Sequences are full or have
    a power of two of tokens. Whole texts are packed, of any length; of pieces with equal dot products the one that has waited
    in the first place comes first. Repeated rows are packed each, a null id is an id; an empty table gives no rows; other columns are
    ignored, whatever their names. The tokenizer may be any file that the tokenizers library reads.
    """
    path = tokenizer or tokenizer_path()
    if capacity < 1 or capacity & (capacity - 1) or max_segments < 1 or (max_loss is not None and max_loss < 1):
        raise ValueError("capacity must be a power of two, and the limits at least 1")
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Tokenizer(path)
        tok, packer = _TOKENIZERS[path], Packer(capacity, max_segments, max_loss)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        lengths: dict[int, int] = {}
        id_type = None

        def emit():
            nonlocal rows
            cols = list(zip(*rows, strict=True)) or [()] * 8
            rows = []
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"])

        def place(seq):
            nonlocal number
            at = 0
            for (key, total), start, ids, loss in seq:
                n = len(ids) // 4
                rows.append((key, start, n, ids, n if loss is None else sum(loss), total, number, at))
                at += n
            number += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 10_000):
                piece = batch.slice(k, 10_000)
                keys = piece.column(0).to_pylist()
                texts = tok.encode_all(piece.column(1))
                prompts = tok.encode_all(piece.column(2)) if prompt_col else None
                for key, ids in zip(keys, texts, strict=True):
                    head = next(prompts) if prompts else b""
                    whole = head + ids + end
                    loss = bytes(len(head) // 4) + b"\x01" * (len(ids) // 4 + 1) if head else None
                    for seq in packer.add((key, len(whole) // 4), whole, loss):
                        place(seq)
                    if len(rows) >= 2000:
                        yield emit()
        for seq in packer.finish():
            place(seq)
            if len(rows) >= 2000:
                yield emit()
        if id_type is not None:
            yield emit()

    cols = [id_col, text_col, *([prompt_col] if prompt_col else [])]
    return df.select(*cols).mapInArrow(lambda batches: tidy(run(batches)), f"`{id_col}` {kind}, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long")
