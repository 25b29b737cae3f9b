"""Token-ID output in training order.

Texts are tokenised and cut into sequences of at most ``LENGTH`` tokens (each document ends with an end mark). The
number of a sequence has two parts of up to 64 bits: doc_id - least id, and occurrence * most pieces of a text + piece.
A keyed Feistel permutation with cycle-walking sends it to a place of the same two parts, in a space known before any
text is tokenised, so one pass over the texts and one shuffle are enough. It permutes all numbers of the space
whatever the ids are, so no two sequences share a place. Ranges of places are the shards: a task sorts its shard by
place and writes it as fixed-stride records of LENGTH little-endian 16-bit ids, padded. A sequence's slot is its
shard's first slot (a running sum over the shard table) plus its position, so a reader can seek to any slot and go on
from there.

The rows of one doc_id are numbered by occurrence, so repeated documents are spread like any others. Spark counts
the rows of each id by partition; running sums over the partitions give the first occurrence of a partition, and its
task counts on from there. Only ids with several rows are looked up, in the task's own part of that table. Both
passes must see the same partitions: an input that comes out of a shuffle is written down first.

Shard files get names of their own under the shared folder; only those in the manifest that Spark commits count.
Defined results: null and empty texts are one sequence with the end mark only; rows that
repeat a doc_id get places of their own (equal rows the same ones however they are stored; rows of one id with unlike
texts are numbered as they are stored); a null doc_id counts as the least id; an empty table gives no sequences;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.near_dedup import groups
from lodestrata.llm.storage import materialise, shared_dir, stable
from lodestrata.llm.textbatch import slices

#: Rank file of the tokenizer and, as fixed values, its split pattern and the two ids that it leaves free.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, PAD = 50256, 50257
#: Tokens of a sequence; bytes of a shard that are aimed at; tokens that a byte of text is taken to give.
LENGTH, SHARD_BYTES, DENSITY = 512, 32_000_000, 0.5
ROUNDS = 6
MANIFEST = "shard long, pos long, doc_id long, piece int, n_tokens int, place_high long, place_low long, sha256 string, file string"
#: Bytes of text that are tokenised at once; records that are put in order at once.
SLICE_BYTES, ROWS_WRITTEN = 4_000_000, 4_096
#: Tasks that write shards at most; beyond it a task writes several, one after another.
MOST_TASKS = 100_000


def feistel(high: np.ndarray, low: np.ndarray, highs: int, lows: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A keyed permutation of the pairs (high, low) below (highs, lows): a balanced Feistel network over the bits of both
    parts, walked along its cycles until both are inside. highs <= 2**64, lows <= 2**62."""
    top = max(1, (highs - 1).bit_length())
    bits = max(1, (lows - 1).bit_length())
    bits += (top + bits) % 2
    half = (top + bits) // 2
    u, word = np.uint64, (1 << 64) - 1
    mask, low_mask = u((1 << half) - 1 & word), u((1 << bits) - 1 & word)
    keys = [u(int.from_bytes(hashlib.blake2b(bytes([r]), key=key, digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if bits <= half:
            left, right = a >> u(half - bits), (a << u(bits) | b) & mask
        else:
            left, right = a << u(bits - half) | b >> u(half), b & mask
        for k in keys:
            f = (right ^ k) * u(0x9E3779B97F4A7C15)
            f = (f ^ (f >> u(29))) * u(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> u(64 - half))
        if bits <= half:
            return left << u(half - bits) | right >> u(bits) if bits < 64 else left, right & low_mask
        return left >> u(bits - half), (left << u(half) | right) & low_mask

    high, low = once(high.astype(u), low.astype(u))
    beyond = lambda a, b: (a > u(highs - 1)) | (b > u(lows - 1))
    outside = np.flatnonzero(beyond(high, low))
    while len(outside):
        high[outside], low[outside] = once(high[outside], low[outside])
        outside = outside[beyond(high[outside], low[outside])]
    return high, low


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_held: dict = {}


def _at_hand(ranks: dict[bytes, int]):
    """The encoder of these ranks, made once in a worker: its tasks follow one another."""
    key = hash(frozenset(ranks.items()))
    if key not in _held:
        _held.clear()
        _held[key] = _encoder(ranks)
    return _held[key]


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The rank file's tokens; read on the driver and sent along, so executors need no copy of it."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Occurrences:
    """Occurrence numbers for the rows of one partition, given in order: from a table's part, (doc_id, first, n)."""

    def __init__(self, table: str, partition: int):
        fs, path = pafs.FileSystem.from_uri(f"{table}/part={partition}")
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        parts = []
        for name in found:
            with fs.open_input_file(name) as file:
                parts.append(pq.ParquetFile(file).read(columns=["doc_id", "first", "n"]))
        ids, first, n = (np.concatenate([np.zeros(0, np.int64), *(x[c].to_numpy() for x in parts)]) for c in ("doc_id", "first", "n"))
        order = np.argsort(ids)
        self.ids, self.next, self.end = ids[order], first[order], (first + n)[order]

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        if not len(self.ids):
            return out
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = np.flatnonzero(self.ids[at] == ids)
        hit = hit[np.argsort(at[hit], kind="stable")]
        kind, start, count = np.unique(at[hit], return_index=True, return_counts=True)
        out[hit] = self.next[at[hit]] + np.arange(len(hit)) - np.repeat(start, count)
        self.next[kind] += count
        return out

    def finish(self) -> None:
        if (self.next != self.end).any():
            raise RuntimeError("the input gave other partitions on its second reading; write it as a table first")


def occurrences(rows: DataFrame) -> tuple[str, int]:
    """Where the table of first occurrences by partition is, ids with several rows only; and the most rows of an id."""
    counts = rows.groupBy(F.spark_partition_id().alias("part"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("doc_id")  # a row per partition at most
    counts = counts.withColumn("total", F.sum("n").over(one)).where("total > 1").withColumn("first", F.sum("n").over(one.orderBy("part")) - F.col("n"))
    path = shared_dir(rows.sparkSession, "occurrences")
    counts.repartition("part").write.partitionBy("part").parquet(path)
    schema = "doc_id long, n long, total long, first long, part int"
    return path, rows.sparkSession.read.schema(schema).parquet(path).agg(F.max("total")).first()[0] or 1


def write_training_order(docs: DataFrame, folder: str, ranks: dict[bytes, int], key: bytes = b"order", length: int = LENGTH) -> DataFrame:
    """Write shards under ``folder``; returns the manifest: MANIFEST's columns and slot."""
    rows = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    facts = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    low, high, longest, total, n = (x or 0 for x in facts)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(low)))
    firsts, most = occurrences(rows)
    pieces = (longest + 1 + length - 1) // length  # a token has a byte at least
    highs, lows = high - low + 1, most * pieces
    shards = max(1, min(-(-int(2 * (DENSITY * total + n * length / 2)) // SHARD_BYTES), highs * lows))

    def place(ids: np.ndarray, occurrence: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both parts of the places, and their shards: the share of the space below a place, which never falls as places grow."""
        at = feistel(ids.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64)), occurrence * pieces + piece, highs, lows, key)
        share = (at[0].astype(float) + at[1].astype(float) / lows) / highs
        return *at, np.minimum((share * shards).astype(np.int64), shards - 1)

    def part(ids: pa.Array, texts: pa.Array, encode: Callable, pack: Callable, seen: Occurrences) -> pa.RecordBatch:
        """Sequences of some texts, packed by shard."""
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        occurrence = seen.of(ids)
        lists = [np.array([*encode(x), END], dtype="<u2") for x in texts.to_pylist()]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        count = -(-size // length)
        doc = np.repeat(np.arange(len(lists)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        held = np.minimum(size[doc] - piece * length, length)
        above, below, shard = place(ids[doc], occurrence[doc], piece)
        order = np.argsort(shard, kind="stable")
        found = {"shard": [], "head": [], "body": []}
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            head = np.stack([above[some].view(np.int64), below[some].view(np.int64), ids[doc[some]], piece[some], held[some]])
            body = np.concatenate([lists[doc[i]][piece[i] * length : piece[i] * length + held[i]] for i in some])
            found["shard"].append(int(shard[some[0]]))
            found["head"].append(pack(head.astype("<i8").tobytes()))
            found["body"].append(pack(body.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(found["shard"], pa.int64()), pa.array(found["head"], pa.binary()), pa.array(found["body"], pa.binary())], ["shard", "head", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = _at_hand(ranks).encode_ordinary, zstandard.ZstdCompressor(level=3).compress
        seen = Occurrences(firsts, TaskContext.get().partitionId())
        for b in batches:
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)])
            for lo, hi in slices(bounds, SLICE_BYTES):
                yield part(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), encode, pack, seen)
        seen.finish()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for table, bounds in groups(batches, ["shard"]):
            for lo, hi in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
                part = table.slice(int(lo), int(hi - lo))
                head = np.concatenate([np.frombuffer(unpack(x), "<i8").reshape(5, -1) for x in part["head"].to_pylist()], axis=1)
                body = np.concatenate([np.frombuffer(unpack(x), "<u2") for x in part["body"].to_pylist()])
                held = head[4]
                fixed = np.full((len(held), length), PAD, dtype="<u2")
                fixed[np.arange(length) < held[:, None]] = body  # by rows
                digest = np.array([hashlib.sha256(fixed[i, : held[i]].tobytes()).hexdigest() for i in range(len(held))])
                order = np.lexsort([head[1].view(np.uint64), head[0].view(np.uint64)])
                name = f"shard-{part['shard'][0].as_py():08d}-{uuid.uuid4().hex}.bin"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    for some in np.array_split(order, max(1, len(order) // ROWS_WRITTEN)):
                        out.write(memoryview(np.ascontiguousarray(fixed[some])).cast("B"))
                many = len(order)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(many, part["shard"][0].as_py())), pa.array(np.arange(many)), pa.array(head[2][order]), pa.array(head[3][order].astype(np.int32)),
                    pa.array(held[order].astype(np.int32)), pa.array(head[0][order]), pa.array(head[1][order]), pa.array(digest[order].tolist(), pa.string()), pa.array([f"{folder}/{name}"] * many, pa.string()),
                ], names=["shard", "pos", "doc_id", "piece", "n_tokens", "place_high", "place_low", "sha256", "file"])

    blobs = rows.mapInArrow(cut, "shard long, head binary, body binary")
    tasks = min(shards, MOST_TASKS)
    dealt = blobs.repartitionById(tasks, F.expr(f"CAST(shard DIV {-(-shards // tasks)} AS INT)"))  # a range of shards each
    manifest = materialise(dealt.sortWithinPartitions("shard").mapInArrow(write, MANIFEST), "training-order")
    starts = manifest.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # one row per shard: a small table
    starts = starts.select(F.col("shard").alias("__shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("__first"))
    return manifest.join(starts, F.col("shard") == F.col("__shard")).withColumn("slot", F.col("__first") + F.col("pos")).drop("__shard", "__first")


def read_sequence(file: str, pos: int, count: int = 1, length: int = LENGTH) -> np.ndarray:
    """``count`` records of a shard from position ``pos``: one seek, one sequential read."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        f.seek(pos * length * 2)
        return np.frombuffer(f.read(count * length * 2), "<u2").reshape(-1, length)


def training_order(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Write ``docs`` in training order in the shared folder: slot, shard, pos, doc_id, piece, n_tokens, sha256, file."""
    return write_training_order(docs, shared_dir(docs.sparkSession, "shards"), load_ranks(ranks_path)).drop("place_high", "place_low")
