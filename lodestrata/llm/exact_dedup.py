"""Exact dedup over a minimal perfect hash of historical digests.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Documents are split into a history
and new arrivals. The history's distinct digests are dealt by their own bits into shards of bounded size; each
shard gets a minimal perfect hash whose slots hold the full 32-byte digest, the winner's doc_id and the group's
size. Arrivals are pre-aggregated by digest, looked up (a slot always answers, so all 32 bytes are compared) and
merged into the slot they repeat; arrivals that are no members form groups of their own.

Defined results: a repeated row counts as a further copy; of equal doc_ids all stay; a null doc_id loses to any
other and stays if its group has none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.storage import materialise
from lodestrata.llm.textbatch import U64, mix

#: Digests per shard that a task builds or probes at once.
SHARD_KEYS = 50_000
#: Bits per key of each level of the hash.
GAMMA = 2.0


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text (``bytes.lower`` changes A-Z only)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256((x or b"").lower()).digest() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hashed, "doc_id long, digest binary")


def _words(keys: np.ndarray) -> np.ndarray:
    return keys.reshape(-1, 32).view(np.uint64).reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, level % 4] + mix(words[:, (level + 1) % 4] + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (mix(x ^ words[:, 2] ^ (words[:, 3] << U64(1))) % U64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of a minimal perfect hash of distinct 32-byte keys (n x 32 bytes), and each key's slot.

    At every level a key that is alone in its place sets that place's bit; the others go on to the next level.
    A key's slot is the number of bits set before its own.
    """
    words, left = _words(keys), np.arange(len(keys))
    levels, home = [], np.zeros(len(keys), dtype=np.int64)
    base = 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _place(words[left], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        home[left[alone]] = base + at[alone]
        levels.append(bits)
        base += size
        left = left[~alone]
    rank = np.cumsum(np.concatenate(levels)) - 1 if levels else np.zeros(0, np.int64)
    return levels, rank[home] if len(home) else home


def probe(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot each key would have; -1 where no level claims it. Only a comparison of digests tells membership."""
    words, slot = _words(keys), np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    rank = np.cumsum(np.concatenate(levels)) - 1 if levels else np.zeros(0, np.int64)
    for n, bits in enumerate(levels):
        at = _place(words[left], n, len(bits))
        hit = bits[at]
        slot[left[hit]] = rank[base + at[hit]]
        left, base = left[~hit], base + len(bits)
    return slot


def _key_array(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


INDEX = "shard long, n long, levels array<binary>, digests binary, winners binary, sizes binary"
GROUPS = "digest binary, keep_id long, group_size long, origin string"


def _build_shard(table: pa.Table) -> pa.Table:
    keys = _key_array(table["digest"])
    levels, slot = build(keys)
    order = np.argsort(slot)
    row = {
        "shard": [table["shard"][0].as_py()], "n": [len(keys)],
        "levels": [[np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in levels]],
        "digests": [keys[order].tobytes()], "winners": [_ids(table["winner"])[order].tobytes()],
        "sizes": [table["size"].to_numpy()[order].astype(np.int64).tobytes()],
    }
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _merge_shard(index: pa.Table, fresh: pa.Table) -> pa.Table:
    lost = np.iinfo(np.int64).min
    old, winners, sizes = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels: list[np.ndarray] = []
    if index.num_rows:
        r = index.to_pylist()[0]
        old = np.frombuffer(r["digests"], np.uint8).reshape(-1, 32)
        winners, sizes = np.frombuffer(r["winners"], np.int64).copy(), np.frombuffer(r["sizes"], np.int64).copy()
        levels = [np.unpackbits(np.frombuffer(x[:-8], np.uint8))[: int.from_bytes(x[-8:], "little")].astype(bool) for x in r["levels"]]
    keys = _key_array(fresh["digest"]) if fresh.num_rows else np.zeros((0, 32), np.uint8)
    ids = _ids(fresh["winner"]) if fresh.num_rows else np.zeros(0, np.int64)
    counts = fresh["size"].to_numpy().astype(np.int64) if fresh.num_rows else ids
    slot = probe(levels, keys)
    member = slot >= 0
    member[member] = (old[slot[member]] == keys[member]).all(axis=1)
    at = slot[member]
    winners[at] = np.maximum(winners[at], ids[member])
    sizes[at] += counts[member]
    origin = np.full(len(old), "history", dtype=object)
    origin[at] = "both"
    keep = np.concatenate([winners, ids[~member]])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in old] + [x.tobytes() for x in keys[~member]], pa.binary()),
        "keep_id": pa.array(keep, pa.int64(), mask=keep == lost),
        "group_size": pa.array(np.concatenate([sizes, counts[~member]]), pa.int64()),
        "origin": pa.array([*origin, *["new"] * int((~member).sum())], pa.string()),
    })


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash, and by slot the full digest, the winner and the size."""
    return _sharded(_distinct(history), shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def merge(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """Groups of history and arrivals: digest, keep_id, group_size, origin."""
    return index.groupBy("shard").cogroup(_sharded(_distinct(arrivals), shards).groupBy("shard")).applyInArrow(_merge_shard, GROUPS)


def exact_dedup(docs: DataFrame, history=None) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256, origin.

    ``history`` is a condition on doc_id that marks what is indexed; by default the lower half of the id range.
    """
    rows = materialise(digests(docs), "digests")
    if history is None:
        low, high, _ = span = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
        history = F.col("doc_id") <= F.lit(0 if low is None else (low + high) // 2)
        total = span[2]
    else:
        total = rows.count()
    shards = max(1, -(-total // SHARD_KEYS))
    old = F.coalesce(history, F.lit(False))
    groups = merge(build_index(rows.where(old), shards), rows.where(~old), shards)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "origin",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(F.col("keep_id").alias("__keep"), "text_sha256").dropDuplicates(["text_sha256"])
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__keep"]), "left_semi")
