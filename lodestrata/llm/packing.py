"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its tokens and an end mark; one that is longer than a sequence is cut into pieces of a whole sequence,
of which the last may be shorter. Lengths are whole numbers up to the capacity, so how all pieces of all documents are
packed depends on how many there are of each length, and that table has at most ``capacity`` rows whatever the corpus
holds. The plan is made over it:

* Lengths above a third of the capacity share a sequence with one more of their kind at most. From the longest down,
  each is matched with the longest that still fits (any number of equal pairs in one step).
* The others go, from the longest down, where they leave the least room (best fit), into new sequences when nothing fits.

The plan is a list of runs: pieces ``rank`` to ``rank + n`` of a length go into sequences from ``bin`` on, ``each`` of
them side by side from ``offset``. Ranks within a length come from the written pieces: a task numbers its own pieces of
each length, and running sums over the tasks' counts give the first rank of each task. No text or token moves for it.

A text is tokenised by its words (runs without ASCII white space), each distinct one once while it is remembered: no
normalisation, split or merge of the tokenizer reaches across white space, which it drops. Short texts are read together,
long ones some megabytes at a time, between words.

Defined results: null and empty texts are the end mark alone; a null doc_id and repeated rows are documents like any
other; ties of equal lengths go in the order of the ranks; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.storage import materialise

#: Tokens of a sequence; the end mark.
CAPACITY, END = 2048, 0
#: Bytes of text that are tokenised at once; words of a generation of those remembered.
SLICE_BYTES, WORDS = 1_000_000, 300_000
#: Bytes of ids that a task holds before it hands them on.
HELD_BYTES = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, number long"
PLACES = "sequence_id long, offset long"


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver and sent along; by default the public word BPE of 49 K ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


_BLANK = re.compile(rb"[\t-\r ]")  # places to cut a text
#: How the tokenizer cuts words, and how its model ends a part of one.
_CUTS, _LAST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: Kinds of bytes of the words whose normalisation is known: visible ASCII without capitals, Latin letters (0xC3 and a second byte,
#: capitals 32 before small ones); 0 is between words, other bytes are of other words.
_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[32] = _MARK, _DIGIT, _OTHER, _LETTER, 0
_SECOND = np.zeros(256, dtype=bool)
_SECOND[128:192], _SECOND[[151, 183]] = True, False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[128:159] += 32
#: The bytes of those that a byte-level model writes as other letters than Latin-1 does.
_WRITTEN = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}


def _parts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a blank behind each: their bytes in small letters, where a part begins, where a word ends, and whether the tokenizer's own cuts are known."""
    data = np.frombuffer(bytearray(b" ".join([*words, b""])), dtype=np.uint8)
    kind, blank = _KIND[data], np.flatnonzero(data == 32)
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[_SECOND[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    data[lead + 1] = _SMALL[data[lead + 1]]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    begins = ((kind != before) | (kind == _DIGIT)) & (kind > 0)
    quote = np.flatnonzero((data == 39) & (before != _MARK))
    one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    short = np.isin(one, list(b"stmd"))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    for ending, n in ((quote[short], 2), (quote[long], 3)):
        begins[ending + 1] = False
        begins[ending + n] = kind[ending + n] > 0
    odd = np.zeros(len(words), dtype=bool)
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    odd[np.searchsorted(blank, np.append(np.flatnonzero(kind == _OTHER), special))] = True
    return data, begins, blank, odd


class WordTokens:
    """Token ids of texts, word by word, as little-endian unsigned 32-bit numbers.

    Distinct words are remembered in two generations of ``WORDS`` words: what is met again moves to the newer one. Simple new words
    are cut here as the tokenizer cuts them, and go to its model together: the last token of a part ends with a mark, so their ids
    are told apart. All others go through the whole tokenizer one by one, and so do all words of a tokenizer of another make.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(model)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(_LAST)]] = True
        made = json.loads(model)
        cuts = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cuts = made["model"].get("end_of_word_suffix") == _LAST and cuts == [_CUTS, None]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _learn(self, words: list[bytes]) -> None:
        odd = words
        if self.cuts:
            data, begins, blank, other = _parts_of(words)
            odd = [words[i] for i in np.flatnonzero(other).tolist()]
            if odd:
                words = [words[i] for i in np.flatnonzero(~other).tolist()]
                data, begins, blank, other = _parts_of(words)
            self._learn_simple(words, data, begins, blank)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)
        for w, e in zip(odd, found, strict=True):
            self.known[w] = array("I", e.ids).tobytes()

    def _learn_simple(self, words: list[bytes], data: np.ndarray, begins: np.ndarray, blank: np.ndarray) -> None:
        place = np.arange(len(data)) + np.cumsum(begins)
        spread = np.full(len(data) + int(begins.sum()), 32, dtype=np.uint8)
        spread[place] = data
        text = spread.tobytes().decode("latin-1")
        for byte, letter in _WRITTEN.items():
            text = text.replace(byte, letter)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        parts = np.flatnonzero(self.last[ids]) + 1  # ends of the parts
        upto = np.cumsum(begins)[blank]  # parts before each word's end
        if len(words) and upto[-1] != len(parts):
            raise ValueError(f"{upto[-1]} parts of words gave the ids of {len(parts)}")
        raw, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * parts[upto - 1]).tolist(), strict=True):
            self.known[w] = raw[at:end]
            at = end

    def of_all(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]  # names of special tokens keep their case
        new = []
        for w in set().union(*split).difference(self.known):
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                new.append(w)
        for lo in range(0, len(new), 1_000):
            self._learn(new[lo : lo + 1_000])
        ids = self.known.__getitem__
        out = [b"".join(map(ids, words)) for words in split]
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        return out

    def of(self, text: bytes) -> bytes:
        return self.of_all([text])[0]


_AT_HAND: dict[str, WordTokens] = {}


def at_hand(model: str) -> WordTokens:
    """The words that this process has met so far: its tasks follow one another."""
    if model not in _AT_HAND:
        _AT_HAND.clear()
        _AT_HAND[model] = WordTokens(model)
    return _AT_HAND[model]


def document(words: WordTokens, text: bytes, end: int = END) -> bytes:
    """The ids of a whole text and the end mark; a long text is read some megabytes at a time, a word is never cut."""
    parts, at = [], 0
    while len(text) - at > SLICE_BYTES:
        cut = _BLANK.search(text, at + SLICE_BYTES)
        if cut is None:
            break
        parts.append(words.of(text[at : cut.start()]))
        at = cut.end()
    return b"".join([*parts, words.of(text[at:] if at else text), end.to_bytes(4, "little")])


def documents(words: WordTokens, texts: Iterable[bytes], end: int = END) -> Iterator[bytes]:
    """The ids of whole texts, each with the end mark; short texts are read together."""
    some, size, mark = [], 0, end.to_bytes(4, "little")
    for text in texts:
        if some and size + len(text) > SLICE_BYTES:
            yield from (ids + mark for ids in words.of_all(some))
            some, size = [], 0
        if len(text) > SLICE_BYTES:
            yield document(words, text, end)
        else:
            some.append(text)
            size += len(text)
    yield from (ids + mark for ids in words.of_all(some))


def cut(docs: DataFrame, model: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with the writing task (``part``) and their number in it among those of their length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = at_hand(model), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        names = [x.split()[0] for x in PIECES.split(",")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        found: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names)
            for x in found:
                x.clear()
            return out

        for b in batches:
            held = 0
            texts = (text.as_py() or b"" for text in b.column(1).cast(pa.binary()))
            for doc_id, ids in zip(b.column(0).to_pylist(), documents(words, texts), strict=True):
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    body = ids[4 * start : 4 * (start + capacity)]
                    length = len(body) // 4
                    for x, v in zip(found, (doc_id, piece, start, length, zlib.crc32(body), body, part, int(seen[length])), strict=True):
                        x.append(v)
                    seen[length] += 1
                    held += len(body)
                    if held > HELD_BYTES:
                        yield flush()
                        held = 0
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs of the packing, by length and rank: (length, rank, bin, each, offset).

    ``counts`` has the number of pieces of each length. The piece of rank r of a run goes to sequence bin + i // each, at
    offset + (i % each) * length, where i = r - rank.
    """
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins, gaps = 0, []
    room: dict[int, list[tuple[int, int]]] = {}  # by gap: ranges of sequences

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], first, each, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, end: int) -> None:
        if end > first and gap:
            if gap not in room:
                insort(gaps, gap)
                room[gap] = []
            room[gap].append((first, end))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        for partner in large:
            if not left[length] or partner > length or partner + length > capacity:
                continue
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            if n and partner == length:
                put(length, 2 * n, bins, 2, 0)
            elif n:
                put(length, n, bins, 1, 0)
                put(partner, n, bins, 1, length)
            leave(capacity - length - partner, bins, bins + n)
            bins += n
        if left[length]:
            n = left[length]
            put(length, n, bins, 1, 0)
            leave(capacity - length, bins, bins + n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, each = capacity, capacity // length
                first, end = bins, bins + -(-left[length] // each)
                bins = end
            else:
                gap = gaps[at]
                first, end = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
                each = gap // length
            full = min(end - first, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                leave(gap - each * length, first, first + full)
            if full < end - first and left[length]:
                some = left[length]
                put(length, some, first + full, some, capacity - gap)
                leave(gap - some * length, first + full, first + full + 1)
                full += 1
            leave(gap, first + full, end)
    return sorted(runs)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32 bits, if asked for), sequence_id, offset."""
    pieces = materialise(cut(docs, tokenizer_json(path), capacity), "pieces")
    tasks = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = dict(map(tuple, tasks.groupBy("length").agg(F.sum("n")).collect()))  # a row for each length
    runs = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    one = Window.partitionBy("length").orderBy("part")  # a row for each task
    firsts = tasks.select("length", "part", (F.sum("n").over(one) - F.col("n")).alias("first"))
    shift = 44
    starts = runs[:, 0] << shift | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            run = runs[np.searchsorted(starts, length << shift | rank, side="right") - 1]
            nth = rank - run[:, 1]
            places = [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            kept = [i for i, x in enumerate(b.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *places], [*(b.schema.names[i] for i in kept), "sequence_id", "offset"])

    names = [x for x in PIECES.split(", ") if x.split()[0] not in ("part", "number") and (ids or x != "ids binary")]
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("number"))
    return ranked.select(*(x.split()[0] for x in names), "rank").mapInArrow(place, ", ".join([*names, PLACES]))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32 bits), and the documents in them in order."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("x"))
    return rows.select(
        "sequence_id", F.aggregate("x", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("x", F.unhex(F.lit("")), lambda s, p: F.concat(s, p["ids"])).alias("ids"), F.transform("x", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("pieces"),
    )
