"""Helpers shared by the operators: shared storage, Arrow maps and a stable 64-bit mixer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bytequarry.operators.suffixes import saved

#: Rows of a batch that Python workers see at once; with whole texts this bounds a worker's memory.
ARROW_ROWS = 1000


materialise = saved


def map_rows(df: DataFrame, fn: Callable[[list], dict], columns: list[str], schema: T.StructType | str, rows: int = ARROW_ROWS) -> DataFrame:
    """``df`` with only ``columns``, mapped by ``fn`` (column lists in, dict of output columns out) in slices of ``rows`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(lambda batches: tidy(run(batches)), out)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores added until it clashes with no column, case aside."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they are over, Arrow's free memory goes back to the system, as workers live on between tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an unsigned 64-bit array (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is; ``BYTEQUARRY_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("BYTEQUARRY_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
