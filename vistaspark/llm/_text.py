"""Vectorised word and shingle hashing over Arrow string columns (numpy, no per-word Python).

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes have
64 bits and are the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18  # the tables of powers, which a worker keeps, have 16 bytes for each of its bytes
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]: off[-1]]


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word), in reading order."""
    starts_all, hashes_all = [], []
    begin, total = 0, len(raw)
    while begin < total:
        end = min(begin + _BLOCK, total)
        while end < total:  # a block ends at a separator or at a row's end
            stop = np.flatnonzero(_SEP[raw[end: end + _BLOCK]])
            row_end = offsets[np.searchsorted(offsets, end)]
            end = min(row_end, end + int(stop[0]) if len(stop) else min(end + _BLOCK, total))
            if len(stop) or end == row_end:
                break
        part = raw[begin:end]
        word = ~_SEP[part]
        cuts = offsets[np.searchsorted(offsets, begin): np.searchsorted(offsets, end)] - begin
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = cuts[(cuts > 0) & (cuts < len(part))]
        first[at] = word[at]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[at - 1] = word[at - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((_LOWER[part] + np.uint64(1)) * up[: len(part)], out=sums[1:])
            h = (sums[e] - sums[s]) * down[s]
            hashes_all.append(mix(h ^ ((e - s).astype(np.uint64) << np.uint64(40))))
            starts_all.append(s + begin)
        begin = end
    if not starts_all:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.concatenate(starts_all)
    return np.searchsorted(offsets, starts, side="right") - 1, np.concatenate(hashes_all)


def shingle_hashes(rows: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of ``size`` words; a row with fewer words gives one of them all."""
    n = len(words)
    out_rows, out = [], []
    factor = np.uint64(0xD6E8FEB86659FD93)

    def fold(first: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(first), length, np.uint64)
        for k in range(length):
            h = mix(h * factor + words[first + k])
        return h

    if n >= size:
        first = np.flatnonzero(rows[size - 1:] == rows[: n - size + 1])
        out_rows.append(rows[first])
        out.append(fold(first, size))
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if n else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, n])
    for length in range(1, size):
        first = heads[counts == length]
        if len(first):
            out_rows.append(rows[first])
            out.append(fold(first, length))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(out_rows), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    return r[order], h[order]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``most`` bytes of text each (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    begin, held = 0, 0
    for i, size in enumerate(lengths):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(lengths):
        yield batch.slice(begin)


def row_sets(batch: pa.RecordBatch, text: str, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    offsets, raw = string_buffers(batch.column(batch.schema.get_field_index(text)))
    r, h = shingle_hashes(*word_hashes(offsets, raw), size)
    bounds = np.searchsorted(r, np.arange(batch.num_rows + 1))
    return [np.unique(h[bounds[i]: bounds[i + 1]]) for i in range(batch.num_rows)]
