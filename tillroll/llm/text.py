"""Texts of Arrow batches as flat byte arrays: slices of bounded size, words, hashes and shingles without a Python loop.

Hashes are 64 bits wide and fixed, so every task of every run gets the same value for the same bytes. A null text
counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that are worked on at once; the arrays made from them take some fifty times as much.
SLICE_BYTES = 1 << 19

_U = np.uint64
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def tidy(run: Callable) -> Callable:
    """``run`` over batches; at its end the task's freed memory goes back to the system.

    Python workers live on between tasks and stages, so what their allocators keep would add up.
    """

    @functools.wraps(run)
    def call(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return call


def slices(batches, column: int = 0, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about ``most`` text bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at, before = end, size[end - 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins (one more entry for the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (an invertible finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A random value for each byte; those of A-Z are those of a-z in the folded table.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(ODD)) | _U(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def rolling(data: np.ndarray, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(ODD, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``starts`` to ``ends``; equal bytes give equal values wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(ODD_INVERSE, len(sums))[starts])


#: White space as the contracts name it: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_first:_last] = False


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = WHITE):
    """Start, end and text number of each word, a longest run of bytes that are not ``between``."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles of ``k`` words (A-Z folded), and where each text's begin.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    data, bounds = utf8(column)
    rows = len(bounds) - 1
    starts, ends, row = words(data, bounds)
    word = span_hash(rolling(data, FOLDED_VALUES), starts, ends)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    shingle = np.empty(0, np.uint64)
    owner = np.empty(0, np.int64)
    if len(word) >= k:
        m = len(word) - k + 1
        whole = np.flatnonzero(row[:m] == row[k - 1 :])
        shingle = np.zeros(len(whole), np.uint64)
        for j in range(k):
            shingle = shingle * _U(ODD) + word[whole + j]
        shingle, owner = mixed(shingle), row[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = count[short] > j
            value[there] = value[there] * _U(ODD) + word[first[short[there]] + j]
        value = mixed(value + count[short].astype(np.uint64))
        shingle, owner = np.concatenate([shingle, value]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    at = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        shingle[a:b].sort()
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each stretch of ``values`` as one binary value."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer(np.ascontiguousarray(bounds * width, np.int32))
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))]
    )


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` made: all values, and where each stretch begins."""
    column = column.cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    if not len(column):
        return np.empty(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return np.frombuffer(held[bounds[0] : bounds[-1]].tobytes(), kind), (bounds - bounds[0]) // width


def added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns at its end."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def wider(df, **kinds: str) -> T.StructType:
    """The schema of ``df`` with further columns; a name that ``df`` has already is an error."""
    clash = set(kinds) & set(df.columns)
    if clash:
        raise ValueError(f"the table has columns named {sorted(clash)} already")
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items()]
    return T.StructType([*df.schema.fields, *more])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
