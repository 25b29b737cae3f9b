"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller doc_id.

Ranks are given to positions, at growing lengths, and only positions whose rank is shared go on:

1. Positions are sampled: of every SPAN-byte string the leftmost least-hashed 16-byte substring is its anchor, which
   depends on the string alone, so equal strings have equal anchors at equal offsets. An anchor's first rank names
   its 16 bytes. Ranks that no other document has are dropped.
2. The second rank of an anchor names the context of all strings it stands for (50 to 84 bytes). The least document
   of each context is its leader; in all others every string of the context is repeated. Length doubles on the way:
   a string reaches 17 bytes beyond its anchor on one side at least, so leaders go on only if another context of
   their first rank agrees with them in the 33 bytes to the right or to the left.
3. The strings of the remaining leaders get ranks of SPAN bytes each: those with a smaller document are repeated.

Texts are packed once into chunks in the shared folder; a text longer than a chunk is cut into pieces that overlap by
SPAN - 1 bytes, so every string lies in one piece, and the last step runs over its pieces in order. Each round is a
sort of (rank, document) pairs by Spark: a chunk sends its distinct ranks, dealt by rank into buckets of bounded size,
and gets back which of them are shared. Contexts, their sides and strings are dealt by names of their own, not by the
16 bytes they grew from, so whatever a third of all documents hold is one entry per chunk, and what differs around it
spreads over all buckets.

Contexts and strings go by names of 128 bits, from two independent hashes, and names that are equal are taken as equal
bytes: among 10**14 names (more than 100 TB of text have) any two that are unlike are equal with a chance under 1e-10.
The 16-byte ranks and the sides only spare work: equal ones are looked at further.

Defined results: null and empty texts are zero bytes; rows with equal doc_ids do not repeat each other; a null doc_id
counts as greater than any other; an empty table gives an empty result; extra columns are ignored; a text may be of any
length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textbatch as tb
from lodestrata.llm.near_dedup import groups
from lodestrata.llm.storage import materialise, shared_dir

#: Length of the strings that count, and of an anchor.
SPAN, GRAM = 50, 16
#: Of the bytes of a string that are not its anchor's, at least this many lie on one side.
REACH = (SPAN - GRAM) // 2
#: Bytes of text in a chunk or piece; ranks that a bucket gets on average.
CHUNK_BYTES, BUCKET_RANKS = 2_000_000, 1_500_000
#: Anchors for each byte of random text: two for SPAN - GRAM + 2 places.
DENSITY = 2 / (SPAN - GRAM + 2)
#: Places of anchors have 28 bits, which is more than a chunk has bytes.
_PLACE = tb.U64((1 << 28) - 1)
_LAST = np.iinfo(np.int64).max
PAIRS = "bucket long, chunk long, piece int, body binary"
#: First byte of a body: what it tells of.
CONTEXTS, SIDES = b"c", b"s"


@dataclass
class Chunk:
    """Documents of a chunk: ids (null as the greatest), byte offsets, bytes. ``own`` bytes belong to it, those after them to
    the next piece of the same text."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    own: int

    def save(self, fs: pafs.FileSystem, path: str) -> None:
        body = zstandard.ZstdCompressor(level=3).compress(self.data.tobytes())
        with fs.open_output_stream(path) as out:
            out.write(np.array([len(self.ids), self.own], "<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.offsets.astype("<i8").tobytes() + body)

    @staticmethod
    def load(fs: pafs.FileSystem, path: str) -> Chunk:
        with fs.open_input_stream(path) as stream:
            raw = stream.read()
        n, own = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        ids, offsets = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n + 1, 16 + 8 * n)
        return Chunk(ids, offsets, np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[24 + 16 * n :]), np.uint8), own)


@dataclass
class Anchors:
    """By anchor: document id, place, first and last string start, first rank, both halves of the context's name.

    ``prefix`` and ``second`` hash the chunk."""

    doc: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rank: np.ndarray
    context: np.ndarray
    check: np.ndarray
    prefix: np.ndarray
    second: np.ndarray


def anchors(chunk: Chunk) -> Anchors:
    size, prefix = len(chunk.data), tb.prefix_hash(chunk.data)
    start = np.arange(max(0, size - SPAN + 1))
    doc = np.repeat(np.arange(len(chunk.ids)), np.diff(chunk.offsets))[: len(start)]
    inside = start + SPAN <= chunk.offsets[1:][doc]
    places = np.arange(max(0, size - GRAM + 1))
    least = tb.span_hash(prefix, places, places + GRAM) & ~_PLACE | places.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 3):  # least of 2, 4, 8, 16, 32 and then 35 places
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
    start, doc = start[inside], doc[inside]
    at = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
    low, high, at = start[first], start[last], at[first]
    rank = tb.span_hash(prefix, at, at + GRAM)
    context = tb.mix(tb.span_hash(prefix, low, high + SPAN) ^ rank * tb.U64(3))
    second = tb.prefix_hash(chunk.data, 1)
    check = tb.span_hash(second, low, high + SPAN, 1)
    return Anchors(chunk.ids[doc[first]], at, low, high, rank, context, check, prefix, second)


def sides(a: Anchors, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ranks of the anchor with the REACH bytes after it and before it; 0 where no string of it reaches so far."""
    at, low, end = a.at[some], a.low[some], a.high[some] + SPAN
    right, left = at + GRAM + REACH <= end, at - REACH >= low
    after = tb.span_hash(a.prefix, np.where(right, at, 0), np.where(right, at + GRAM + REACH, 0)) >> tb.U64(32) | tb.U64(1)
    before = tb.span_hash(a.prefix, np.where(left, at - REACH, 0), np.where(left, at + GRAM, 0)) >> tb.U64(32) | tb.U64(1)
    return np.where(right, after, 0).astype("<u4"), np.where(left, before, 0).astype("<u4")


def side_ranks(a: Anchors, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of (first rank, side) of some anchors, after and before, and which of them exist."""
    both = np.stack(sides(a, some))
    which = np.array([[1], [2]], dtype=np.uint64)
    return tb.mix(a.rank[some] ^ tb.mix(both.astype(np.uint64) << tb.U64(2) | which)), both > 0


def _extremes(keys: np.ndarray, low: np.ndarray, many: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their least value, whether they have several, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], low[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(cut):
        return k, v, many, weight
    least = np.minimum.reduceat(v, cut)
    several = (least < np.maximum.reduceat(v, cut)) | (np.add.reduceat(many[order].astype(np.int64), cut) > 0)
    return k[cut], least, several, np.add.reduceat(weight[order], cut)


def _held(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which names are among the others."""
    if not len(among):
        return np.zeros(names.shape, dtype=bool)
    among = np.sort(among)
    return among[np.minimum(np.searchsorted(among, names), len(among) - 1)] == names


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their least and greatest document."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(cut):
        return k, d, d
    return k[cut], np.minimum.reduceat(d, cut), np.maximum.reduceat(d, cut)


def _runs(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names of both halves lie together, and where each of them begins."""
    order = np.argsort(name, kind="stable")
    n, c = name[order], check[order]
    if ((n[1:] == n[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort([check, name])
        n, c = name[order], check[order]
    return order, np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (c[1:] != c[:-1])])) if len(n) else np.zeros(0, np.int64)


def _by_name(name: np.ndarray, check: np.ndarray, values: np.ndarray, ufunc: np.ufunc = np.minimum) -> np.ndarray:
    """For each entry, the least value (or another reduction) among the entries of its name."""
    order, cut = _runs(name, check)
    out = np.empty_like(values)
    if len(cut):
        out[order] = np.repeat(ufunc.reduceat(values[order], cut), np.diff(np.append(cut, len(order))))
    return out


def _distinct(name: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry of each name, the least document of each, and for each entry the number of its name."""
    order, cut = _runs(name, check)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
    return order[cut], np.minimum.reduceat(doc[order], cut) if len(cut) else doc[:0], number


def _pack(**columns: np.ndarray) -> bytes:
    n = len(next(iter(columns.values())))
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _short(rank: np.ndarray) -> np.ndarray:
    """The upper five bytes of a rank; the bucket comes from its lower bits."""
    return np.ascontiguousarray(rank.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 3:]


def _long(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(body, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class _Out:
    """Rows of PAIRS to be."""

    def __init__(self) -> None:
        self.bucket: list[int] = []
        self.chunk: list[int] = []
        self.piece: list[int] = []
        self.body: list[bytes] = []

    def add(self, bucket: int, key: tuple[int, int], body: bytes) -> None:
        self.bucket.append(bucket)
        self.chunk.append(key[0])
        self.piece.append(key[1])
        self.body.append(body)

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(self.bucket, pa.int64()), pa.array(self.chunk, pa.int64()), pa.array(self.piece, pa.int32()), pa.array(self.body, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "piece", "body"])


def _parts(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    for table, first in groups(batches, list(keys)):
        for lo, hi in zip(first, [*first[1:], table.num_rows], strict=True):
            yield tuple(table[k][int(lo)].as_py() for k in keys), table.slice(int(lo), int(hi - lo))


def _senders(part: pa.Table) -> list[tuple[int, int]]:
    return list(zip(part["chunk"].to_pylist(), part["piece"].to_pylist(), strict=True))


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[part[0]]), part


class _Job:
    """What the tasks of all rounds share; small, and sent with them."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets

    def load(self, key: tuple[int, int]) -> Chunk:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        return Chunk.load(fs, f"{base}/{key[0]:016x}-{key[1]}.chunk")

    def bucket(self, rank: np.ndarray) -> np.ndarray:
        return ((rank & tb.U64(0xFFFFFF)) % tb.U64(self.buckets)).astype(np.int64)

    # Round 1: which ranks of 16 bytes are shared.
    def first_ranks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, out = anchors(self.load(key)), _Out()
                rank, low, high = _least(a.rank, a.doc)
                for bucket, part in _split(self.bucket(rank)):
                    many = low[part] < high[part]
                    out.add(bucket, key, np.packbits(many).tobytes() + _short(rank[part]).tobytes() + len(part).to_bytes(8, "little"))
                yield out.batch()

    def share_first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), part in _parts(batches, "bucket"):
            names, flags, out = [], [], _Out()
            for body in part["body"].to_pylist():
                n = int.from_bytes(body[-8:], "little")
                flags.append(np.unpackbits(np.frombuffer(body, np.uint8, -(-n // 8)))[:n].astype(bool))
                names.append(_long(body[-(-n // 8) : -8]))
            sizes = [len(x) for x in names]
            name, many = np.concatenate(names), np.concatenate(flags)
            _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
            many = many | (np.bincount(inverse, many)[inverse] > 0) | (count[inverse] > 1)
            cuts = np.cumsum(sizes)[:-1]
            for key, x, m in zip(_senders(part), np.split(name, cuts), np.split(many, cuts), strict=True):
                out.add(bucket, key, _short(x[m] << tb.U64(24)).tobytes())
            yield out.batch()

    # Round 2: leaders of contexts.
    def contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in _parts(batches, "chunk", "piece"):
            a, out = anchors(self.load(key)), _Out()
            shared = np.sort(np.concatenate([_long(x) | tb.U64(k) << tb.U64(40) for k, x in zip(part["bucket"].to_pylist(), part["body"].to_pylist(), strict=True)]))
            mine = (a.rank >> tb.U64(24)) | self.bucket(a.rank).astype(np.uint64) << tb.U64(40)
            at = np.searchsorted(shared, mine)
            hit = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == mine)) if len(shared) else np.zeros(0, np.int64)
            where, doc, _ = _distinct(a.context[hit], a.check[hit], a.doc[hit])
            context, check = a.context[hit[where]], a.check[hit[where]]
            name, real = side_ranks(a, hit[where])
            weight = (a.high - a.low + 1)[hit[where]].astype(np.int64)
            both = np.concatenate([np.flatnonzero(r) for r in real])
            name, low, many, weight = _extremes(name[real], context[both], np.zeros(len(both), bool), weight[both])
            for bucket, some in _split(self.bucket(context)):
                some = some[np.argsort(doc[some], kind="stable")]
                out.add(bucket, key, CONTEXTS + _pack(context=context[some], check=check[some], doc=doc[some]))
            for bucket, some in _split(self.bucket(name)):
                out.add(bucket, key, SIDES + _pack(name=name[some], low=low[some], many=many[some], weight=weight[some].astype("<u4")))
            yield out.batch()

    def share_contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of a chunk that follow another document's, and its sides that several contexts have.

        ``weight`` is at least the number of strings that the sides open.
        """
        for (bucket,), part in _parts(batches, "bucket"):
            told, out, opened = list(zip(_senders(part), part["body"].to_pylist(), strict=True)), _Out(), []
            got = [(key, *_unpack(x[1:], "<u8", "<u8", "<i8")) for key, x in told if x[:1] == CONTEXTS]
            if got:
                name, check, doc = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3))
                later = np.split(doc > _by_name(name, check, doc), np.cumsum([len(x[1]) for x in got])[:-1])
                for (key, name, check, _), hit in zip(got, later, strict=True):
                    if hit.any():
                        opened.append(0)
                        out.add(bucket, key, CONTEXTS + _pack(name=name[hit], check=check[hit]))
            got = [(key, *_unpack(x[1:], "<u8", "<u8", "?", "<u4")) for key, x in told if x[:1] == SIDES]
            if got:
                keys, _, several, _ = _extremes(*(np.concatenate(x) for x in list(zip(*got, strict=True))[1:]))
            for key, name, _, _, weight in got:
                shared = several[np.searchsorted(keys, name)]
                if shared.any():
                    opened.append(int(weight[shared].sum(dtype=np.int64)))
                    out.add(bucket, key, SIDES + name[shared].tobytes())
            yield out.batch().append_column("weight", pa.array(opened, pa.int64()))

    def _status(self, a: Anchors, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By anchor: all its strings are repeated; its strings need ranks of their own."""
        followed = [_unpack(x[1:], "<u8", "<u8") for x in bodies if x[:1] == CONTEXTS]
        name, check = (np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in followed), own]) for i, own in enumerate((a.context, a.check)))
        told = np.arange(len(name)) < len(name) - len(a.doc)
        repeated = _by_name(name, check, told, np.logical_or)[len(name) - len(a.doc) :] | (a.doc > _by_name(a.context, a.check, a.doc))
        some = np.flatnonzero(~repeated)
        name, real = side_ranks(a, some)
        open_ = np.zeros(len(a.doc), dtype=bool)
        shared = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8", offset=1) for x in bodies if x[:1] == SIDES)])
        open_[some] = (_held(name, shared) & real).any(axis=0)
        return repeated, open_

    def _strings(self, a: Anchors, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, start and both halves of the name of all strings of open anchors."""
        some = np.flatnonzero(open_)
        count = a.high[some] - a.low[some] + 1
        of = np.repeat(some, count)
        start = a.low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, start, tb.span_hash(a.prefix, start, start + SPAN), tb.span_hash(a.second, start, start + SPAN, 1)

    def _sent(self, name: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Distinct strings by bucket, in the order in which they are sent and told of."""
        for bucket, some in _split(self.bucket(name)):
            yield bucket, some[np.argsort(doc[some], kind="stable")]

    # Round 3: strings of leaders.
    def strings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in _parts(batches, "chunk", "piece"):
            a, out = anchors(self.load(key)), _Out()
            _, open_ = self._status(a, part["body"].to_pylist())
            of, _, name, check = self._strings(a, open_)
            where, doc, _ = _distinct(name, check, a.doc[of])
            name, check = name[where], check[where]
            for bucket, some in self._sent(name, doc):
                out.add(bucket, key, _pack(name=name[some], check=check[some], doc=doc[some]))
            yield out.batch()

    def share_strings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bit for each string of a chunk: another document with a smaller id has it."""
        for (bucket,), part in _parts(batches, "bucket"):
            got, out = [_unpack(x, "<u8", "<u8", "<i8") for x in part["body"].to_pylist()], _Out()
            name, check, doc = (np.concatenate(x) for x in zip(*got, strict=True))
            later = np.split(doc > _by_name(name, check, doc), np.cumsum([len(x[0]) for x in got])[:-1])
            for key, hit in zip(_senders(part), later, strict=True):
                if hit.any():
                    out.add(bucket, key, np.packbits(hit).tobytes())
            yield out.batch()

    # Result: what is removed.
    def _gone(self, c: Chunk, part: pa.Table) -> np.ndarray:
        """By byte of a chunk: whether a repeated string of it covers the byte."""
        a = anchors(c)
        rows = list(zip(part["kind"].to_pylist(), part["bucket"].to_pylist(), part["body"].to_pylist(), strict=True))
        repeated, open_ = self._status(a, [x for kind, _, x in rows if kind == 2])
        of, start, name, check = self._strings(a, open_)
        where, doc, number = _distinct(name, check, a.doc[of])
        told, later = {bucket: x for kind, bucket, x in rows if kind == 3}, np.zeros(len(where), dtype=bool)
        for bucket, some in self._sent(name[where], doc):
            if bucket in told:
                later[some] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=len(some))
        hit = later[number] | (a.doc[of] > doc[number])
        low = np.concatenate([a.low[repeated], start[hit]])
        high = np.concatenate([a.high[repeated], start[hit]]) + SPAN
        size = len(c.data)
        return np.cumsum(np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1))[:size] > 0

    def removed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document, whole; of a text in pieces the running counts, digest and overlap are carried from piece to piece."""
        carried = None
        for key, part in _parts(batches, "chunk", "piece"):
            c = self.load(key)
            gone = self._gone(c, part)
            if key[1] == 0:
                carried = None
            if carried is not None:
                gone[: len(carried[0])] |= carried[0]
            over, gone = gone[c.own :], gone[: c.own]
            offsets = np.minimum(c.offsets, c.own)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(gone)]
            begins[heads] = gone[heads]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(np.int64)
            counts = np.stack([np.diff(offsets), total(gone), total(begins)])
            digests = [hashlib.sha256() for _ in c.ids] if carried is None else [carried[2]]
            for digest, i, j in zip(digests, offsets[:-1], offsets[1:], strict=True):
                digest.update(c.data[i:j][~gone[i:j]].tobytes())
            if carried is not None:
                counts = counts + carried[1]
                counts[2] -= bool(len(gone) and gone[0] and carried[3])
            if len(c.data) > c.own:
                carried = (over, counts, digests[0], bool(gone[-1]))
                continue
            carried = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.ids, pa.int64(), mask=c.ids == _LAST), *map(pa.array, counts), pa.array([d.hexdigest() for d in digests], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _store(docs: DataFrame, folder: str) -> DataFrame:
    """Pack the texts into chunk files; returns the manifest that Spark commits: chunk, piece, size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            ids = b.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = tb.flat(b.column(1))
            found = []
            for lo, hi in tb.slices(offsets, CHUNK_BYTES):
                name = uuid.uuid4().int >> 65
                text = data[offsets[lo] : offsets[hi]]
                for piece, begin in enumerate(range(0, max(1, len(text)), CHUNK_BYTES)):
                    own = min(CHUNK_BYTES, len(text) - begin)
                    body = text[begin : begin + CHUNK_BYTES + SPAN - 1]
                    cuts = offsets[lo : hi + 1] - offsets[lo] if len(text) <= CHUNK_BYTES else np.array([0, len(body)])
                    Chunk(ids[lo:hi], cuts, body, own).save(fs, f"{base}/{name:016x}-{piece}.chunk")
                    found.append((name, piece, own))
            chunk, piece, size = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(piece, pa.int32()), pa.array(size, pa.int64())], ["chunk", "piece", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(pack, "chunk long, piece int, size long"), "chunks")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "suffix")
    chunks = _store(docs, folder)
    size, count = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    job = _Job(folder, max(1, -(-int(size * DENSITY) // BUCKET_RANKS)))
    tasks = max(1, min(count, 2 * spark.sparkContext.defaultParallelism), -(-count // 16))
    keys = {"bucket": ["bucket"], "chunk": ["chunk", "piece"]}

    def dealt(rows: DataFrame, key: str, step: Callable, schema: str = PAIRS) -> DataFrame:
        n = step.__self__.buckets if key == "bucket" else tasks
        return rows.repartition(n, *keys[key]).sortWithinPartitions(*keys[key]).mapInArrow(step, schema)

    # A row without ranks for every chunk, so that each is seen in every round.
    row = lambda body: chunks.select(F.lit(0).cast("long").alias("bucket"), "chunk", "piece", F.unhex(F.lit(body)).alias("body"))
    every, none = row(""), row("00" * 8)
    first = chunks.select("chunk", "piece").repartition(tasks, "chunk", "piece").mapInArrow(job.first_ranks, PAIRS)
    shared = dealt(first, "bucket", job.share_first)
    context = dealt(shared.unionByName(every), "chunk", job.contexts)
    status = materialise(dealt(context, "bucket", job.share_contexts, PAIRS + ", weight long"), "contexts")
    weight = status.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    status = status.drop("weight").unionByName(none)
    last = _Job(folder, max(job.buckets, -(-int(weight) // BUCKET_RANKS)))
    strings = dealt(dealt(status, "chunk", last.strings), "bucket", last.share_strings)
    facts = status.withColumn("kind", F.lit(2)).unionByName(strings.withColumn("kind", F.lit(3)))
    facts = facts.select("chunk", "piece", "kind", "bucket", "body").repartition(tasks, "chunk").sortWithinPartitions("chunk", "piece")
    return facts.mapInArrow(last.removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
