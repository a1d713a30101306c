"""Vectorised word segmentation and hashing over the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes other than the ASCII separators 0x20 and
0x09-0x0D.  Separators are single bytes in UTF-8, so segmentation on bytes and on
code points agree.  Hashes are 64 bits and depend on nothing but the bytes of the
word, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
#: Longer spans are hashed by a digest.
_BLOCKS = 8


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8_views(column: pa.Array) -> list[np.ndarray]:
    """One read-only uint8 view for each row; null rows are empty.  No copies."""
    if pa.types.is_null(column.type):
        return [np.zeros(0, dtype=np.uint8)] * len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    if not column.null_count:
        return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; every other byte, also of longer characters, is kept."""
    return _LOWER[data]


class Chunk:
    """Some consecutive texts in one byte array, a line feed after each."""

    def __init__(self, first: int, views: list[np.ndarray]) -> None:
        self.first, self.rows = first, len(views)
        sizes = np.array([len(v) for v in views], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"\n".join([*views, b""]), dtype=np.uint8)

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end (exclusive) byte offsets of the words, and their rows within the chunk."""
        inside = ~IS_SEP[self.data if data is None else data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.starts, starts, side="right") - 1


def chunks(column: pa.Array, limit: int = 1 << 18):
    """The rows of a string column as Chunks of about `limit` bytes; a longer text is one by itself."""
    views, held, first = [], 0, 0
    for row, view in enumerate(utf8_views(column)):
        if views and held + len(view) > limit:
            yield Chunk(first, views)
            views, held, first = [], 0, row
        views.append(view)
        held += len(view) + 1
    if views:
        yield Chunk(first, views)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: blocks of eight bytes mixed in one after the other, a digest beyond 64 bytes.

    Each step is a bijection of the state and is not linear in it, so spans of up to
    eight bytes never collide and longer ones only by chance.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = (ends - starts).astype(np.int64)
    out = mix64(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    active, at = np.flatnonzero((sizes > 0) & (sizes <= 8 * _BLOCKS)), 0
    while len(active):
        left = sizes[active] - at
        block = blocks[starts[active] + at].view(np.uint64).ravel()
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        state = (out[active] ^ block) * np.uint64(_ODD)
        state ^= state >> np.uint64(32)
        state *= np.uint64(0xFF51AFD7ED558CCD)
        out[active] = state ^ (state >> np.uint64(29))
        active, at = active[left > 8], at + 8
    out = mix64(out)
    for i in np.flatnonzero(sizes > 8 * _BLOCKS):
        out[i] = digest128(data[starts[i] : ends[i]])[0]
    return out


def digest128(data: bytes | np.ndarray) -> np.ndarray:
    """A 128-bit digest, as two 64-bit words."""
    return np.frombuffer(blake2b(data, digest_size=16).digest(), dtype=np.uint64)


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` consecutive items; empty if there are fewer."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = (out ^ items[k : k + n]) * np.uint64(_ODD)
        out ^= out >> np.uint64(29)
    return mix64(out)


def row_shingles(items: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of `width` items of each row: (hashes, bounds), sorted within a row.

    `rows` says, without decreasing, which row an item belongs to.  A row with fewer
    items than `width` has all of them as its only window; one without items has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.cumsum(counts) - counts
    full = window_hashes(items, width)
    keep = rows[: len(full)] == rows[width - 1 :] if len(full) else np.zeros(0, dtype=bool)
    hashes, owner = [full[keep]], [rows[: len(full)][keep]]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            hashes.append(window_hashes(items, size)[firsts[short]])
            owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[first], o[first]
    return h, np.searchsorted(o, np.arange(n_rows + 1))
