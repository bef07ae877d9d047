"""Vectorised work on the UTF-8 bytes of Arrow text columns: words, hashes and slices without a Python loop per word."""

import ctypes

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_M = 0xFFFFFFFFFFFFFFFF
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def release():
    """What Arrow, numpy and Python have freed goes back to the system: idle workers stay, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table_of(chars) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Bytes of words. White space is [\x20\x09-\x0D]; alphanumeric words also end at ASCII punctuation and control bytes.
NOT_SPACE = table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})
ALNUM = table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x):
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed=0) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def _powers(base, n):
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, n):
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n + n // 4), _powers(BASE_INVERSE, n + n // 4)
        return self.up[:n], self.down[:n]


def buffers(column):
    """Bytes and offsets of an Arrow text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column, limit=CHUNK_BYTES, rows=None):
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes, and at most ``rows`` rows.

    A longer text stands alone.
    """
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, at + rows) if rows else end
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end
    release()


class Words:
    """Words of a chunk: ``starts`` and ``ends`` in bytes, ``first[d]`` the first word of text d (one more at the end)."""

    def __init__(self, data, offsets, is_word):
        mask = is_word[data]
        before = np.empty_like(mask)
        before[:1] = False
        before[1:] = mask[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = False
        after = np.empty_like(mask)
        after[-1:] = False
        after[:-1] = mask[1:]
        after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self):
        return len(self.starts)

    def counts(self):
        return np.diff(self.first)

    def text_of_word(self):
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def span_hashes(data, starts, ends, powers, values):
    """64-bit hash of every span data[start:end], by differences of one running polynomial hash."""
    up, down = powers.upto(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=running[1:])
    h = (running[ends] - running[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(word_hashes, k):
    """Hash of every run of k consecutive words (k - 1 fewer rows than words)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, factor = np.zeros(n, dtype=np.uint64), 1
    for j in range(k):
        h += word_hashes[j:j + n] * np.uint64(factor)
        factor = factor * BASE & _M
    return mix(h + np.uint64(k))


def windows_inside(words, k):
    """First words of the runs of k words that stay inside one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    text = words.text_of_word()
    return np.flatnonzero(text[:n] == text[k - 1:])
