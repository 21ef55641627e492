"""Word spans and rolling hashes over whole Arrow string columns, without a Python loop per word.

A column arrives as one byte buffer plus row offsets; every function below works on that
buffer at once.  Words never cross rows.  A null row counts as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that form words: all but the six ASCII white-space bytes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that form words once A-Z is lower-cased: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (or one row): first row, last row + 1, bytes, row offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(int(base), -1, 1 << 64)
        out = []
        for b in (int(base), inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p)
        have = _POWERS[int(base)] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the buffer, and for each row (and one past the last) its first word's number."""
    inside = table[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _powers(_BYTE_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes (len(words) - k + 1 of them, over row ends too)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k])[:n] * inverse[:n])


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k-grams that lie within one row: the number of the first word, and the row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return np.arange(int(counts.sum())) - base[row] + first[:-1][row], row


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of word hashes; that of k words differs from gram_hashes' of k."""
    power, inverse = _powers(_WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each range, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (kept) words' bytes with one space after each, and where each word (kept or not) starts in them."""
    sizes = ends - starts + 1
    if keep is not None:
        sizes = np.where(keep, sizes, 0)
    to = np.concatenate([[0], np.cumsum(sizes)])
    full = sizes > 0
    source = ranges(starts[full], sizes[full])
    flat = raw[np.minimum(source, len(raw) - 1)] if len(source) else np.zeros(0, np.uint8)
    flat[to[1:][full] - 1] = 32
    return flat, to
