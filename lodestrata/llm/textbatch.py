"""Vectorised work on the text column of an Arrow batch: bytes, words, word hashes.

All functions take one flat byte array and the offsets of its documents, so that numpy runs over
whole batches and Python never loops over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of two rolling hashes, 3 modulo 8, and their inverses modulo 2**64.
_BASE = (0x9E3779B97F4A7C13, 0xD1B54A32D192ED03)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_BYTE = [np.random.default_rng(20240131 + i).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for i in (0, 1)]

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no white space: words are runs of them.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False

#: Bytes of a long text that are worked on at once.
PIECE = 1_000_000
#: Bytes of words that ``distinct`` hashes at once: what it holds for each of them stays in a core's cache.
BLOCK = 1 << 17

_powers: dict[str, np.ndarray] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    return data[start : int(offsets[-1]) if len(offsets) else 0], offsets - start


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Document ranges whose bytes sum to about ``most``; a longer document is a range of its own."""
    found, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        found.append((first, last))
        first = last
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """H with H[j] - H[i] = sum of byte values times the base's powers over [i, j), by one of two independent hashes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[kind][data] * _power(f"up{kind}", _BASE[kind], len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes anywhere."""
    down = _power(f"down{kind}", _INVERSE[kind], len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, and each document's first word (n + 1 values)."""
    kind = np.zeros(len(data) + 1, dtype=bool)
    kind[:-1] = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = kind[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts = kind & ~before
    starts[cut] = kind[cut]
    ends = before & ~kind
    ends[cut] = before[cut]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends), np.searchsorted(first, offsets)


def _joined(data: np.ndarray, inside: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of one text's runs, ``piece`` bytes at a time; runs that go on in the next piece are put together."""
    found = []
    for lo in range(0, len(data), piece):
        part = data[lo : lo + piece]
        prefix = prefix_hash(part)
        starts, ends, _ = words(part, np.array([0, len(part)]), inside)
        found.append((starts + lo, ends + lo, (prefix[ends] - prefix[starts]) * _power("down0", _INVERSE[0], len(prefix))[starts]))
    starts, ends, raw = map(np.concatenate, zip(*found, strict=True))
    del found
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = starts[1:] != ends[:-1]  # runs of one piece never touch
    head = np.flatnonzero(opens)
    for i in np.flatnonzero(~opens):  # at most one a piece
        first = head[np.searchsorted(head, i) - 1]
        raw[i : i + 1] *= U64(pow(_BASE[0], int(starts[i] - starts[first]), 1 << 64))
    if not len(head):
        return starts, ends, raw
    starts, ends = starts[head], ends[np.append(head[1:], len(ends)) - 1]
    return starts, ends, mix(np.add.reduceat(raw, head) + (ends - starts).astype(np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of ``inside`` bytes, and each document's first run.

    A text longer than ``piece`` bytes that comes alone is gone through in pieces, so that memory beside the runs does not grow with it.
    """
    if len(offsets) == 2 and len(data) > piece:
        starts, ends, h = _joined(data, inside, piece)
        return starts, ends, h, np.array([0, len(starts)])
    starts, ends, first = words(data, offsets, inside)
    return starts, ends, span_hash(prefix_hash(data), starts, ends), first


def per_doc(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """``ufunc.reduceat`` over the ranges of ``bounds``; empty ranges give ``empty``."""
    n = len(bounds) - 1
    out = np.full((n, *values.shape[1:]), empty, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full], axis=0)
    return out


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of spans that follow one another, ``BLOCK`` bytes at a time; a longer span is hashed alone."""
    out, at = tuple(np.empty(len(start), dtype=np.uint64) for _ in _BASE), 0
    while at < len(start):
        last = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        low, part = start[at], data[start[at] : end[last - 1]]
        for kind, name in enumerate(out):
            name[at:last] = span_hash(prefix_hash(part, kind), start[at:last] - low, end[at:last] - low, kind)
        at = last
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the byte spans [start, end), one after another: the index of one of each kind, and each span's kind. Spans of different ``salt`` differ.

    Kinds go by one hash of 64 bits; where a second one tells spans of a kind apart, by both.
    """
    names = _names(data, start, end)
    if salt is not None:
        names = tuple(mix(x ^ (salt.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)) for x in names)
    _, where, kind = np.unique(names[0], return_index=True, return_inverse=True)
    if (names[1] != names[1][where][kind]).any():
        _, where, kind = np.unique(np.stack(names, axis=1), axis=0, return_index=True, return_inverse=True)
    return where, kind.reshape(-1)
