"""Vectorised text primitives shared by the operators: Arrow strings as byte buffers, words, rolling hashes.

All functions treat a null text as empty and take whole texts. Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D, which never occur inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)])
        return self.up, self.down


POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (UTF-8) or binary column and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks, several of them beside each executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    offsets = text_buffer(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    release()


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """starts, ends of words in the buffer, and for each text the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    up, down = POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    part = total[1:]  # one array of eight bytes a byte of text, not three
    np.take(_BYTE, buf, out=part, mode="clip")
    part *= up[: len(buf)]
    np.cumsum(part, out=part)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, k: int, seed: int = 0, light: bool = False) -> np.ndarray:
    """Hashes of each run of k consecutive values (as many as len(values) - k + 1, none if fewer).

    light: a shorter finaliser, whose upper half is well mixed.
    """
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    if light and not seed:
        return _light_hashes(values, k)
    up, down = POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    given = mix(values + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))) if seed else values
    np.cumsum(given * up[:n], out=total[1:])
    if light:
        h = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))


def _light_hashes(values: np.ndarray, k: int, step: int = 1 << 14) -> np.ndarray:
    """window_hashes(values, k, light=True), some `step` runs at a time: what is made on the way stays in the processor's cache."""
    out = np.empty(len(values) - k + 1, np.uint64)
    step = max(step, 8 * k)
    up, down = POWERS.get(step + k)
    total, upper = np.zeros(step + k, np.uint64), np.empty(step, np.uint64)
    for at in range(0, len(out), step):
        h = out[at : at + step]
        part = total[1 : len(h) + k]
        np.multiply(values[at : at + len(part)], up[: len(part)], out=part)
        np.cumsum(part, out=part)
        np.subtract(total[k : k + len(h)], total[: len(h)], out=h)
        h *= down[: len(h)]
        h ^= np.right_shift(h, np.uint64(32), out=upper[: len(h)])
        h *= np.uint64(0xD6E8FEB86659FD93)
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs values[start:end], equal to those of window_hashes for the same length."""
    n = len(values)
    up, down = POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Distinct byte strings among spans (binary array) and each span's index among them.

    Spans must be adjacent or apart, in order, as those of word_spans or of a split of a buffer.
    """
    lengths = ends - starts
    data = buf if len(starts) and starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(buf) else buf[spread(starts, lengths)]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = raw.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def whole_groups(batches, keys: list[str]):
    """Batches of rows in order of the keys, cut anew so that no group of equal keys is in two of them."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        turn = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        goes_on = bool(held) and all(held[-1].column(k)[-1].as_py() == x[0] for k, x in zip(keys, columns, strict=True))
        if not goes_on and held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if not len(turn):
            held.append(batch)
            continue
        held.append(batch.slice(0, turn[-1]))
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = [batch.slice(turn[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()


class Seen:
    """Keys that a task has met before, with the id of an earlier place: a table of bounded size, so a key may be
    forgotten and is then taken for a new one."""

    def __init__(self, bits: int = 18):
        self.key, self.id, self.mask = ~np.arange(1 << bits), np.zeros(1 << bits, np.int64), (1 << bits) - 1

    def new(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of distinct keys were not met before at a smaller id; one of each slot of the table is remembered."""
        at = keys & self.mask
        fresh = (self.key[at] != keys) | (self.id[at] >= ids)
        slot, row = np.unique(at[fresh], return_index=True)
        self.key[slot], self.id[slot] = keys[fresh][row], ids[fresh][row]
        return fresh


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray):
    """Concatenated values[offsets[i]:offsets[i+1]] for i in index, and the offsets of the result."""
    lengths = offsets[index + 1] - offsets[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return values[spread(offsets[index], lengths)], out
