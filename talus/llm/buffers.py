"""Numpy views of Arrow text columns and hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_IDS = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64)
#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), base, U64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows holding about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of the words of all rows; a word never spans two rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z lower-cased, from one running sum over the bytes."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_IDS[LOWER[data]] * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, n + 1)[starts])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingles of ``size`` words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    data, offsets = text_view(column)
    starts, ends, row = words(data, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, U64)] * rows
    hashes = word_hashes(data, starts, ends)
    weights = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    if len(hashes) >= size:
        full = hashes[: len(hashes) - size + 1] * weights[0]
        for j in range(1, size):
            full += hashes[j : len(hashes) - size + 1 + j] * weights[j]
        full = mix(full)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = hi - lo
        if n >= size:
            out.append(np.unique(full[lo : hi - size + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(hashes[lo:hi] * weights[:n]).sum(dtype=U64) + U64(n) * MIX_2], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def row_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(row, texts) of runs of rows whose struct ``row`` holds a string text, each of about ``size`` bytes of it."""
    for batch in batches:
        row = batch.column("row")
        held = pa.RecordBatch.from_arrays([row, pc.struct_field(row, "text")], ["row", "text"])
        for part in slices(iter([held]), "text", size):
            yield part.column("row"), [t or "" for t in part.column("text").to_pylist()]
