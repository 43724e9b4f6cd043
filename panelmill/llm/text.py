"""Text columns as byte arrays: words, segments and 64-bit hashes of byte ranges, all vectorised over one Arrow batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
GRAPH = np.zeros(256, bool)
GRAPH[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Marks that may be cut from the letter before them; those of added-token strings (<, |, >) are left out.
MARK = np.zeros(256, bool)
MARK[list(b'.,;:!?*%#&$")(-')] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 19)) << 19
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hashes`` takes the hash of any range of ``data`` (bytes or code points)."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    value = _BYTE[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    np.cumsum(value * up[: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end); equal content has equal hashes wherever it stands."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def release() -> None:
    """Give memory that a finished task has freed back to the system; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each (one row at least); empty batches are skipped."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        release()


#: Slices after which freed memory goes back to the system.
RELEASE = 8


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    given = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
            given += 1
            if given % RELEASE == 0:
                release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets from 0 on; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.string()), "")
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each range of ``offsets``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and for each text where its words begin among them."""
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def owner(bounds: np.ndarray) -> np.ndarray:
    """Row number of each element, from the bounds of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut texts at their starts, before each space that follows a printing character, and before each mark that follows an ASCII letter.

    The tokenizers used here never join a character that is no white space with the white space behind it, nor a letter with a mark
    behind it, so that the tokens of a text are those of its segments. Doubtful places are not cut. Returns the segments and the bounds
    per text.
    """
    safe = GRAPH[data]
    safe[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = (SPACE[data[1:]] & safe[:-1]) | (MARK[data[1:]] & LETTER[data[:-1]])
    begin[offsets] = True
    start = np.flatnonzero(begin[:-1])
    ends = np.append(start, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(start, offsets)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a "name type, ..." text."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def tables(batches: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of ``schema`` from dicts of columns."""
    for columns in batches:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
