"""Vectorised handling of text batches in Python workers: slices of bounded size, segments, dictionaries."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000


class Recent(dict):
    """What was worked out for keys seen lately, in two generations of at most `limit` keys and those of one call.

    Keys that come again move to the young generation; the old one is dropped when the young is full. So common
    keys stay and rare ones go, within a bound on memory.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def recall(self, keys: list) -> list:
        """Bring the known ones of `keys` (distinct) up to this generation; return the unknown ones, for the caller to set."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        unknown, old = [], self.old
        for k in keys:
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    unknown.append(k)
        return unknown


def trimmed(run: Callable) -> Callable:
    """`run`, giving back what its batches took when a task ends: workers are kept, and what they hold adds up over stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about `limit` bytes of text each (one row at least), every row once."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `limit` bytes each: what is worked out once for each distinct word pays more in larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with null as the empty text, with 64-bit offsets."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def _encoded(split: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def segments(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split at every single space: distinct segments, the code of each segment in order, offsets by text."""
    return _encoded(pc.split_pattern(values, " "))


def words(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split at runs of ASCII white space, no empty words: distinct words, codes in order, offsets by text."""
    distinct, codes, offsets = _encoded(pc.ascii_split_whitespace(values))
    blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if blank >= 0:
        real = codes != blank
        kept = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], kept[offsets]
    return distinct, codes, offsets


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate pool[starts[i] : starts[i] + lengths[i]] for all i."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(lengths)
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each range of offsets; an empty range has 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
