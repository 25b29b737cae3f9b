"""Phrase collocations by counting quotient filters.

Counts of words and of phrases of two to four words within pieces of text, by language. A phrase counts as frequent from
``LEAST`` occurrences on, and so do all its parts, so every length is counted among what the length below left over:

1. Tasks cut texts into words, number each chunk's distinct (lang, word) pairs and write the chunk as numbers. Spark adds
   up the counts by word; frequent words get dense ids, and each chunk gets the ids of its own words back.
2. A chunk packs the ids of a phrase into n times as many bits as an id has, permutes that number invertibly (a Feistel
   network), sorts, and counts. The leading bits are the shard, the next ones the quotient, all others the remainder; a
   shard's entries become a counting quotient filter: which quotients occur, where the run of each ends, the remainders
   in whole bytes, and counters of a byte (or eight, if it is full). Nothing is lost: quotient and remainder give the
   phrase back. The permutation spreads the phrases evenly, however common their words are, and a phrase that makes a
   third of the corpus is one entry per chunk.
3. A shard merges the sorted filters of all chunks, keeps frequent phrases, and tells each chunk with a bit per entry
   which of its own they are. Only places where both parts of length n - 1 are frequent are counted at length n.

Scores, containment and ranks are joins and windows over the frequent phrases. Ranking first finds the score that so many
of each language reach (from counts by score, of which there are a million at most), then ranks within dealt groups, then
the best of all groups.

Defined results: null texts are empty; a null lang is ``und``; a text of any length is read in chunks, cut at the ends of
pieces (a single piece is never cut); rows that repeat count again; an empty table gives an empty result; extra columns
are ignored. There may be 2**32 - 1 frequent words; more raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textbatch as tb
from lodestrata.llm.storage import materialise, shared_dir

#: Occurrences of a candidate; longest phrase; phrases returned per language; share in percent of a longer phrase that drops its parts.
LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Bytes of text in a chunk; words of text per shard, which bounds its entries; groups among which ranks are dealt.
CHUNK_BYTES, SHARD_WORDS, RANK_GROUPS = 8_000_000, 1_000_000, 64
#: Shards at most: beyond 65 billion words a shard's distinct phrases grow with the corpus.
MOST_SHARDS = 1 << 16
_U = np.uint64
#: Bytes of no piece, and of no word.
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
INSIDE = ~STOPS
INSIDE[[32, 9]] = False
_ROUNDS = [_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7), _U(0xAEF17502108EF2D9)]


# Packed phrases


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def half_bits(n: int, bits: int) -> int:
    """Bits of each half of a phrase of ``n`` ids of ``bits`` bits."""
    return (n * bits + 1) // 2


def pack(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right halves of phrases (one per row), first word highest."""
    n = ids.shape[1]
    h = half_bits(n, bits)
    left, right = np.zeros(len(ids), _U), np.zeros(len(ids), _U)
    for j in range(n):
        w, low = ids[:, j].astype(_U), (n - 1 - j) * bits
        if low >= h:
            left |= w << _U(low - h)
        else:
            right |= w << _U(low) & _mask(h)
            if low + bits > h:
                left |= w >> _U(h - low)
    return left, right


def unpack(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = half_bits(n, bits)
    out = np.zeros((len(left), n), dtype=np.int64)
    for j in range(n):
        low = (n - 1 - j) * bits
        if low >= h:
            w = left >> _U(low - h)
        else:
            w = right >> _U(low)
            if low + bits > h:
                w |= left << _U(h - low)
        out[:, j] = w & _mask(bits)
    return out


def _scrambled(x: np.ndarray, k: np.uint64, h: int) -> np.ndarray:
    x = (x + k) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x >> _U(64 - h)


def permute(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for k in _ROUNDS:
        left, right = right, left ^ _scrambled(right, k, h)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for k in reversed(_ROUNDS):
        left, right = right ^ _scrambled(left, k, h), left
    return left, right


def grouped(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (left, right), the places in it where a value begins, and each row's value number."""
    order = np.argsort(left << _U(h) | right, kind="stable") if 2 * h <= 64 else np.lexsort((right, left))
    new = np.ones(len(order), dtype=bool)
    a, b = left[order], right[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


# Counting quotient filters


def _bits(n: int) -> int:
    return int(n).bit_length()


def layout(entries: int, h: int, shard_bits: int) -> tuple[int, int]:
    """Bits of quotient and remainder: about as many quotients as entries, the remainder in whole bytes."""
    rest = 2 * h - shard_bits
    remainder = min(-(-max(0, rest - _bits(entries)) // 8), rest // 8) * 8
    return rest - remainder, remainder


def to_filter(left: np.ndarray, right: np.ndarray, counts: np.ndarray, h: int, shard_bits: int) -> bytes:
    """A filter of distinct sorted values of one shard and their counts."""
    n = len(left)
    q, r = layout(n, h, shard_bits)
    quotient, remainder = _split(left, right, h, r)
    quotient = (quotient & _mask(q)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    ends = np.ones(n, dtype=bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    wide = counts > 254
    body = [np.array([n, q], "<u4").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes()]
    body += [part.tobytes() for part in remainder]
    body += [np.where(wide, 255, counts).astype(np.uint8).tobytes(), counts[wide].astype("<u8").tobytes()]
    return b"".join(body)


def _split(left: np.ndarray, right: np.ndarray, h: int, r: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bits above the lowest ``r`` (64 at most), and the lowest in bytes, least first."""
    parts = []
    for at in range(0, r, 8):
        if at + 8 <= h:
            parts.append((right >> _U(at) & _U(255)).astype(np.uint8))
        elif at >= h:
            parts.append((left >> _U(at - h) & _U(255)).astype(np.uint8))
        else:
            parts.append(((right >> _U(at) | left << _U(h - at)) & _U(255)).astype(np.uint8))
    top = left >> _U(r - h) if r >= h else (left << _U(h - r) | right >> _U(r) if h > r else left)
    return top, parts


def from_filter(body: bytes, shard: int, h: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values, in order, and their counts."""
    n, q = (int(x) for x in np.frombuffer(body, "<u4", 2))
    r, at = 2 * h - shard_bits - q, 8

    def take(size: int, kind=np.uint8) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, size, at)
        at += out.nbytes
        return out

    quotients = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q])
    ends = np.unpackbits(take(-(-n // 8)))[:n].astype(bool)
    run = np.cumsum(ends) - ends
    top = quotients[run].astype(_U) | _U(shard << q)
    low, high = np.zeros(n, _U), np.zeros(n, _U)  # of the remainder: bits below and from h on
    for bit in range(0, r, 8):
        part = take(n).astype(_U)
        if bit < h:
            low |= part << _U(bit)
        if bit >= h:
            high |= part << _U(bit - h)
        elif bit + 8 > h:
            high |= part >> _U(h - bit)
    right = (low | (top << _U(r) if r < h else _U(0))) & _mask(h)
    left = high | (top << _U(r - h) if r >= h else top >> _U(h - r))
    counts = take(n).astype(np.int64)
    wide = counts == 255
    counts[wide] = take(int(wide.sum()), "<u8")
    return left, right, counts


# Chunks


class Chunk:
    """A chunk as numbers: a word per place, 0 where a piece ends or a word is rare; places where a frequent phrase of some length starts."""

    def __init__(self, ids: np.ndarray, flags: np.ndarray):
        self.ids, self.flags = ids, flags

    def save(self, folder: str) -> str:
        name = uuid.uuid4().hex
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(np.array([len(self.ids)], "<i8").tobytes() + zstandard.compress(self.ids.astype("<u4").tobytes() + np.packbits(self.flags).tobytes(), 1))
        return name

    @staticmethod
    def load(folder: str, name: str) -> Chunk:
        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/{name}") as stream:
            raw = stream.read()
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        body = zstandard.decompress(raw[8:])
        return Chunk(np.frombuffer(body, "<u4", n), np.unpackbits(np.frombuffer(body, np.uint8, offset=4 * n))[:n].astype(bool))

    def phrases(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where both parts of n - 1 words are frequent, and the permuted halves of the phrases there."""
        start = np.flatnonzero(self.flags[:-1] & self.flags[1:])
        ids = np.stack([self.ids[start + j] for j in range(n)], axis=1) if len(start) else np.zeros((0, n), np.uint32)
        return start, *permute(*pack(ids, bits), half_bits(n, bits))


WORDS = "part string, word_no int, lang string, word string, n long"
FILTERS = "shard int, part string, body binary"
MERGED = "shard int, part string, bits binary, w1 long, w2 long, w3 long, w4 long, f long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes, offsets and languages of about a chunk of text; long texts are cut at ends of pieces."""
    held, langs, size = [], [], 0
    pack_up = lambda: (np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]), list(langs))
    for b in batches:
        data, offsets = tb.flat(b.column(1))
        for k, lang in enumerate(b.column(0).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            stops = np.flatnonzero(STOPS[text]) if len(text) > CHUNK_BYTES else None
            at = 0
            while at < len(text):
                end = len(text)
                if stops is not None and end - at > CHUNK_BYTES:
                    cut = np.searchsorted(stops, at + CHUNK_BYTES)
                    end = int(stops[cut]) + 1 if cut < len(stops) else end
                held.append(text[at:end])
                langs.append(lang)
                size += end - at
                at = end
                if size >= CHUNK_BYTES:
                    yield pack_up()
                    held, langs, size = [], [], 0
    if held:
        yield pack_up()


class _Job:
    """The steps of one run; all state is the folder and numbers."""

    def __init__(self, folder: str):
        self.folder, self.bits, self.shard_bits, self.n = folder, 0, 0, 0

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write chunks with words numbered from 1; their distinct words and counts."""
        for data, offsets, langs in _pieces(batches):
            data = tb.LOWER[data]
            names = sorted(set(langs))
            part, starts, ends, code, count = self._write(data, offsets, np.array([names.index(x) for x in langs], dtype=np.int32))
            for lo in range(0, len(starts), 50_000):
                some = slice(lo, min(len(starts), lo + 50_000))
                many = some.stop - lo
                words = [data[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * many, pa.string()), pa.array(np.arange(lo, some.stop, dtype=np.int32) + 1), pa.array([names[c] for c in code[some].tolist()], pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()), pa.array(count[some].astype(np.int64)),
                ], names=[x.split()[0] for x in WORDS.split(", ")])

    def _write(self, data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Write one chunk; its name, and of its distinct words start and end, language and count. What is as long as the text goes before any of them leave."""
        starts, ends, first = tb.words(data, offsets, INSIDE)
        if not len(starts):
            return "", starts, ends, code[:0], starts
        doc = np.repeat(np.arange(len(code), dtype=np.int32), np.diff(first))
        where, kind = tb.distinct(data, starts, ends, code[doc])
        found = starts[where], ends[where], code[doc[where]], np.bincount(kind, minlength=len(where))
        piece = np.searchsorted(np.flatnonzero(STOPS[data]), starts) + doc
        gap = piece[1:] != piece[:-1]
        del starts, ends, doc, piece
        place = np.arange(len(kind))
        place[1:] += np.cumsum(gap)
        ids = np.zeros(place[-1] + 2, dtype=np.uint32)
        ids[place] = kind + 1
        del place, kind
        return Chunk(ids, ids > 0).save(self.folder), *found

    def _send(self, chunk: Chunk) -> pa.Table:
        """Write a chunk and filters of its phrases of the job's length, one for each shard."""
        h, s = half_bits(self.n, self.bits), self.shard_bits
        _, left, right = chunk.phrases(self.n, self.bits)
        order, first, _ = grouped(left, right, h)
        left, right = left[order[first]], right[order[first]]
        counts = np.diff(np.append(first, len(order)))
        shard = (left >> _U(h - s)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        bounds = [0, *cuts.tolist(), len(shard)] if len(shard) else [0]
        part = chunk.save(self.folder) if len(shard) else ""
        spans = list(zip(bounds, bounds[1:], strict=False))
        bodies = [to_filter(left[a:b], right[a:b], counts[a:b], h, s) for a, b in spans]
        return pa.table([pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array([part] * len(spans), pa.string()), pa.array(bodies, pa.binary())], names=["shard", "part", "body"])

    def pairs(self, table: pa.Table) -> pa.Table:
        """A chunk's pairs of words, from the ids of its frequent words."""
        old = Chunk.load(self.folder, table["part"][0].as_py())
        ids = np.zeros(int(old.ids.max()) + 1, dtype=np.uint32)
        ids[table["word_no"].to_numpy()] = table["id"].to_numpy()
        ids = ids[old.ids]
        return self._send(Chunk(ids, ids > 0))

    def longer(self, table: pa.Table) -> pa.Table:
        """A chunk's phrases of one more word, from the bits of its phrases."""
        old = Chunk.load(self.folder, table["part"][0].as_py())
        start, left, right = old.phrases(self.n - 1, self.bits)
        order = np.argsort(table["shard"].to_numpy())
        replies = table["bits"].take(pa.array(order)).to_pylist()
        _, first, number = grouped(left, right, half_bits(self.n - 1, self.bits))
        frequent = np.concatenate([np.unpackbits(np.frombuffer(x[4:], np.uint8))[: int.from_bytes(x[:4], "little")] for x in replies]).astype(bool)
        flags = np.zeros(len(old.ids), dtype=bool)
        flags[start] = frequent[number]
        return self._send(Chunk(old.ids, flags))

    def merge(self, table: pa.Table) -> pa.Table:
        """Of one shard: its frequent phrases, and for each chunk which of its own they are."""
        h, shard = half_bits(self.n, self.bits), int(table["shard"][0].as_py())
        parts, bodies = table["part"].to_pylist(), table["body"].to_pylist()
        lefts, rights, counts = zip(*(from_filter(x, shard, h, self.shard_bits) for x in bodies), strict=True)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        order, first, number = grouped(left, right, h)
        total = np.add.reduceat(np.concatenate(counts)[order], first)
        frequent = total >= LEAST
        ends = np.cumsum([len(x) for x in lefts])[:-1]
        bits = [len(x).to_bytes(4, "little") + np.packbits(x).tobytes() for x in np.split(frequent[number], ends)]
        at = order[first[frequent]]
        ids = np.zeros((len(at), 4), dtype=np.int64)
        ids[:, : self.n] = unpack(*restore(left[at], right[at], h), self.n, self.bits)
        k, m = len(parts), len(at)
        return pa.table({
            "shard": pa.array([shard] * (k + m), pa.int32()), "part": pa.array(parts + [None] * m, pa.string()), "bits": pa.array(bits + [None] * m, pa.binary()),
            **{f"w{j + 1}": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids[:, j])]) for j in range(4)},
            "f": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(total[frequent].astype(np.int64))]),
        })


def _on_table(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A method as a function of one argument, which Spark counts."""
    return lambda table: step(table)


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """The frequent words with dense ids from 1, and the greatest id."""
    row = F.monotonically_increasing_id()
    found = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)
    found = materialise(found.select("lang", "word", "f", F.shiftright(row, 33).alias("task"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "vocabulary")
    sizes = found.groupBy("task").agg(F.count(F.lit(1)).alias("size"))  # a row for each task
    base = sizes.select("task", (F.sum("size").over(Window.orderBy("task")) - F.col("size")).alias("base"))
    most = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if most >= 1 << 32:
        raise ValueError(f"{most} frequent words are more than ids of 32 bits can tell apart")
    return found.join(base, "task").select("lang", "word", "f", (F.col("base") + F.col("nth") + 1).alias("id")), most


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases as (w1, w2, w3, w4, f), with 0 for no word; frequent words as (lang, word, f, id); n by lang."""
    spark = docs.sparkSession
    job = _Job(shared_dir(spark, "phrases"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    words = materialise(rows.mapInArrow(job.encode, WORDS), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, most = _numbered(words)
    vocabulary = materialise(vocabulary, "ids")
    job.bits = max(4, _bits(most))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    job.shard_bits = min(_bits(min(MOST_SHARDS, max(64, size // SHARD_WORDS)) - 1), job.bits)
    sent = words.join(vocabulary, ["lang", "word"]).select("part", "word_no", "id").groupBy("part")
    found = vocabulary.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(f"w{j}") for j in (2, 3, 4)), "f")
    for n in range(2, LONGEST + 1):
        step = _Job(job.folder)
        step.bits, step.shard_bits, step.n = job.bits, job.shard_bits, n
        filters = sent.applyInArrow(_on_table(step.pairs if n == 2 else step.longer), FILTERS)
        merged = materialise(filters.groupBy("shard").applyInArrow(_on_table(step.merge), MERGED), f"phrases{n}")
        found = found.union(merged.where("part IS NULL").select("w1", "w2", "w3", "w4", "f"))
        sent = merged.where("part IS NOT NULL").select("part", "shard", "bits").groupBy("part")
    return found, vocabulary, totals


def collocations(docs: DataFrame) -> DataFrame:
    """Per language its first TOP phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, vocabulary, totals = frequent_phrases(docs)
    counts = materialise(counts, "counts")
    w = F.array("w1", "w2", "w3", "w4")
    key = lambda a, lo, n: F.struct(*(F.when(F.lit(j) < n, F.get(a, lo + j)).otherwise(F.lit(0).cast("long")).alias(f"w{j + 1}") for j in range(4)))
    cand = counts.where("w2 > 0").select(F.struct("w1", "w2", "w3", "w4").alias("k"), w.alias("w"), F.col("f").alias("a"), F.size(F.filter(w, lambda x: x > 0)).alias("size"))
    parts = counts.select(F.struct("w1", "w2", "w3", "w4").alias("part"), "f")

    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("one", key(F.col("w"), F.lit(0), F.col("cut"))).withColumn("two", key(F.col("w"), F.col("cut"), F.col("size") - F.col("cut")))
    cuts = cuts.join(parts.select(F.col("part").alias("one"), F.col("f").alias("l")), "one").join(parts.select(F.col("part").alias("two"), F.col("f").alias("r")), "two")
    score = F.expr("CAST(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("k").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("w").alias("w"), F.first("size").alias("size"))

    spans = [(lo, n) for n in (2, 3) for lo in range(LONGEST - n + 1)]
    inner = cand.where("size > 2").select("a", F.explode(F.filter(F.array(*(F.when(F.lit(lo + n) <= F.col("size"), F.when(F.lit(n) < F.col("size"), key(F.col("w"), F.lit(lo), F.lit(n)))) for lo, n in spans)), lambda x: x.isNotNull())).alias("k"))
    inner = inner.groupBy("k").agg(F.max("a").alias("longer"))
    longer, own = F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(19,0)"), F.col("a").cast("decimal(19,0)")
    stay = scored.join(inner, "k", "left").where(longer * 100 < own * SHARE)
    first = vocabulary.select(F.col("id").alias("w1"), "lang")
    stay = stay.withColumn("w1", F.col("k.w1")).join(first, "w1").select("lang", "k", "w", "size", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    stay = materialise(stay, "scored")

    by_score = stay.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("m"))  # 1,000,001 scores at most
    above = by_score.withColumn("above", F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("score"))) - F.col("m")).where(F.col("above") < TOP)
    reached = above.groupBy("lang").agg(F.min("score").alias("least"))
    kept = stay.join(reached, "lang").where("score >= least")
    spelled = kept.select("k", F.posexplode(F.slice("w", F.lit(1), F.col("size"))).alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    kept = kept.join(spelled, "k").withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "group"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TOP)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
