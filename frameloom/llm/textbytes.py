"""Words of Arrow string columns as arrays: where they stand and a 64-bit hash of each, computed over whole columns.

Words are the runs of bytes outside space and U+0009 to U+000D, which are single bytes in UTF-8. A hash is a polynomial of
the bytes modulo 2**64, so the hash of any span of bytes comes from two prefix sums; ``mix`` scatters it afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts are handled in groups of about so many bytes, one text at least.
SLICE_BYTES = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        for base, name in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            globals()[name] = np.cumprod(factors, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the usual three shift and two multiply steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of consecutive texts: ``starts`` and ``ends`` in bytes, ``bounds[i]`` the first word of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < n]
        first[heads] = inside[heads]
        tails = heads[heads > 0] - 1
        last[tails] = inside[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets
        _grow(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from a to b, wherever they stand."""
        return mix((self.sums[b] - self.sums[a]) * _inverses[a])

    def hashes(self) -> np.ndarray:
        return self.span(self.starts, self.ends)


def parts(column: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """The texts of a string column in order, as groups of bounded size; null counts as empty."""
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, place, body = column.buffers()
    offsets = np.frombuffer(place, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slice_bytes, side="right")) - 1)
        j = min(j, len(column))
        part = data[offsets[i]: offsets[j]]
        yield Words(_LOWER[part] if lower else part, offsets[i: j + 1] - offsets[i])
        i = j


def sums_per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for a text without any."""
    upto = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def annotate(docs: DataFrame, measure: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str, text: str = "text") -> DataFrame:
    """``row`` with all input columns, and the columns of ``schema`` that ``measure()`` derives from the texts of a batch.

    ``measure`` is called once per task and returns the function that is applied to each batch.
    """
    place = docs.columns.index(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = measure()
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *derive(row.field(place))], names=out.names)

    return rows.mapInArrow(run, out)
