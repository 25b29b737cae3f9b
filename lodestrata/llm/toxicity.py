"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of learned vectors of hash buckets: the word's own and those of its beginnings, so that
words never seen still resemble their kin; filters of one, two and three words slide over the whole
text, each keeps its maximum, a logistic layer reads the maxima. Max pooling lets one bad word in 20,000 count in
full. Every labelled row that is not held out is learned from, with its whole text: rows are dealt to shards, a task
learns from a shard for an epoch, then what the shards changed is put together: filters are averaged, a bucket's vector
moves by the sum over up to ``GAIN`` shards that moved it, beyond that by as many times their mean. Scoring is one pass over Arrow batches. One component of the embeddings starts from how far a
bucket's document counts in the two classes lie apart, the others at random. A decision threshold per language is
calibrated on scores that each half of the labelled rows gets from a net that learned from the other half; the net that
scores learns from both. The score itself never sees the language.

Defined results: null and empty texts get the score of a text without words; each repeated row is scored alike;
a text of any length is scored in pieces of about a megabyte;
without labels of both kinds every score is the share of ones (0.1 without any); an unknown or null language has
the threshold of all languages; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textbatch as tb
from lodestrata.llm.labelled import remainder, sample
from lodestrata.llm.storage import materialise

#: Folds of doc_id, and the one that is held out.
FOLDS, HELD_OUT = 4, 2
#: Labelled rows of a shard, about; the words that a task holds, where one shard is all there is, to learn every epoch at once.
SHARD_ROWS, HELD_WORDS = 20_000, 8_000_000
#: A bucket moves by the sum of what up to so many shards moved it, beyond that by so many times their mean.
GAIN = 4
#: The nets: one is checked on either half and learns from the other, the last learns from both.
HALVES, BOTH = (0, 1), 2
#: Beginnings of a word, in bytes, that have a bucket besides the whole word.
STARTS = (4, 5, 6, 7)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-3
#: A language needs this many calibration rows of each class for a threshold of its own.
CALIBRATION = 10
THRESHOLD = 0.3
SLICE = 1_000_000
#: Words of labelled texts that are scored at once, places that are convolved at once, buckets that are averaged at once.
SCORED, PLACES, SPAN = 100_000, 16_384, 256

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (one row each; ``BUCKETS`` where it has no such beginning), and each document's first word."""
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets, _WORD)
    prefix = tb.prefix_hash(data)
    out = np.empty((len(starts), 1 + len(STARTS)), np.int32)
    out[:, 0] = tb.span_hash(prefix, starts, ends) % tb.U64(BUCKETS)
    for i, n in enumerate(STARTS, 1):
        cut = np.minimum(starts + n, ends)
        out[:, i] = np.where(cut < ends, (tb.span_hash(prefix, starts, cut) % tb.U64(BUCKETS)).astype(np.int32), BUCKETS)
    return out, first


def _padded(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with blanks after each document, so that every window stays within one."""
    extra, n = max(WIDTHS), len(first) - 1
    out = np.full((len(tok) + extra * n, 1 + len(STARTS)), BUCKETS, dtype=np.int32)
    out[np.arange(len(tok)) + extra * np.repeat(np.arange(n), np.diff(first))] = tok
    return out, first + extra * np.arange(n + 1)


def _long_tokens(data: np.ndarray) -> np.ndarray:
    """Buckets of every word of one text of any length, some ``SLICE`` bytes at a time."""
    found, at = [np.zeros((0, 1 + len(STARTS)), np.uint16)], 0
    while at < len(data):
        end = _next_gap(data, at + SLICE)
        found.append(tokens(data[at:end], np.array([0, end - at]))[0].astype(np.uint16))
        at = end
    return np.concatenate(found)


def _next(data: np.ndarray, at: int, inside: bool) -> int:
    """The first place from ``at`` on whose byte is part of a word, or is not; the end if there is none."""
    while at < len(data):
        found = np.flatnonzero(_WORD[tb.LOWER[data[at : at + 65_536]]] == inside)
        if len(found):
            return at + int(found[0])
        at += 65_536
    return len(data)


def _next_gap(data: np.ndarray, at: int) -> int:
    return _next(data, at, False)


def _next_word(data: np.ndarray, at: int) -> int:
    return _next(data, at, True)


@dataclass
class Net:
    """Parameters; ``conv[w]`` is width x dim x filters."""

    embed: np.ndarray
    conv: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def vectors(self, tok: np.ndarray) -> np.ndarray:
        total = np.take(self.embed, tok[:, 0], axis=0)
        for i in range(1, tok.shape[1]):
            total += np.take(self.embed, tok[:, i], axis=0)
        return total

    def convolved(self, tok: np.ndarray) -> np.ndarray:
        """Every filter's value (a row each) at every place (windows that reach beyond the last token are cut)."""
        weights = np.concatenate([self.conv[w][j] for w in WIDTHS for j in range(w)], axis=1).T
        out = np.empty((FILTERS * len(WIDTHS), len(tok)), np.float32)
        for lo in range(0, len(tok), PLACES):
            at = weights @ self.vectors(tok[lo : lo + PLACES + max(WIDTHS) - 1]).T
            rows = out[:, lo : lo + PLACES]
            n, k = rows.shape[1], 0
            for i, w in enumerate(WIDTHS):
                own = rows[i * FILTERS : (i + 1) * FILTERS]
                own[:] = at[k : k + FILTERS, :n]
                for j in range(1, w):
                    beyond = at[k + j * FILTERS : k + (j + 1) * FILTERS, j : j + n]
                    own[:, : beyond.shape[1]] += beyond
                k += w * FILTERS
        return out

    def pooled(self, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maxima of the filters by document, before the rectifier."""
        tok, bounds = _padded(tok, first)
        if len(first) < 2:
            return np.zeros((0, len(self.bias)), np.float32)
        stop = bounds[1:] - max(WIDTHS) + 1  # the last start of a document is its first blank
        cells = np.column_stack([bounds[:-1], stop]).ravel()
        return np.maximum.reduceat(self.convolved(tok), cells, axis=1)[:, ::2].T + self.bias

    def winners(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """By document and filter: the maximum, and the buckets of the words in the window that has it."""
        extra, units = max(WIDTHS) - 1, np.arange(len(self.bias))
        top = np.empty((len(docs), len(units)), np.float32)
        won = np.empty((*top.shape, max(WIDTHS), 1 + len(STARTS)), np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        for lo, hi in tb.slices(bounds, SCORED):
            if bounds[hi] - bounds[lo] > SCORED:
                top[lo], won[lo] = self._winners_long(docs[lo])
                continue
            tok, at = _padded(np.concatenate(docs[lo:hi]), bounds[lo : hi + 1] - bounds[lo])
            value = self.convolved(tok)
            best = np.stack([at[d] + value[:, at[d] : at[d + 1] - extra].argmax(axis=1) for d in range(hi - lo)])
            top[lo:hi] = value[units, best]
            for j in range(max(WIDTHS)):
                won[lo:hi, :, j] = tok[best + j]
        return top, won

    def _winners_long(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``winners`` of one text, ``SCORED`` places at a time."""
        extra, units = max(WIDTHS) - 1, np.arange(len(self.bias))
        top = np.full(len(units), -np.inf, np.float32)
        won = np.empty((len(units), max(WIDTHS), doc.shape[1]), np.int32)
        for begin in range(0, len(doc) + 1, SCORED):  # the last place is the first blank
            piece = doc[begin : begin + SCORED + extra]
            stop = min(len(doc) + 1 - begin, SCORED)
            tok = np.full((stop + extra, doc.shape[1]), BUCKETS, np.int32)
            tok[: len(piece)] = piece
            value = self.convolved(tok)[:, :stop]
            best = value.argmax(axis=1)
            new = np.flatnonzero(value[units, best] > top)
            top[new] = value[new, best[new]]
            for j in range(max(WIDTHS)):
                won[new, j] = tok[best[new] + j]
        return top, won

    def score(self, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._probability(self.pooled(tok, first))

    def score_long(self, data: np.ndarray) -> np.ndarray:
        """The score of one text of any length, some ``SLICE`` bytes at a time: each piece's windows see the words behind it."""
        extra, at, top = max(WIDTHS) - 1, 0, np.zeros((1, len(self.bias)), np.float32)  # zeros: the blank behind the last word
        while at < len(data):
            end = _next_gap(data, at + SLICE)
            beyond = end
            for _ in range(extra):  # up to the end of the next words
                beyond = _next_gap(data, _next_word(data, beyond))
            tok, _ = tokens(data[at:beyond], np.array([0, beyond - at]))
            own = len(tb.words(tb.LOWER[data[at:end]], np.array([0, end - at]), _WORD)[0])
            if own:
                padded = np.vstack([tok, np.full((extra, tok.shape[1]), BUCKETS, np.int32)])
                top = np.maximum(top, self.convolved(padded)[:, :own].max(axis=1))
            at = end
        return self._probability(top + self.bias)

    def _probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -30, 30).astype(np.float64)))


def _counts(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: documents with label 1, and all documents."""
    ones, all_ = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    seen = np.zeros(BUCKETS + 1, dtype=bool)
    for t, label in zip(docs, y, strict=True):
        seen[t.ravel()] = True
        u = np.flatnonzero(seen[:BUCKETS])
        seen[:] = False
        all_[u] += 1
        ones[u] += int(label)
    return ones, all_


def _initial(ones: np.ndarray, all_: np.ndarray, p: float, rng: np.random.Generator) -> Net:
    embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    apart = (ones - all_ * p) / np.sqrt(all_ * p * (1 - p) + 1)
    embed[:, 0] = np.where(ones >= 3, np.clip(apart, -3, 6), np.minimum(apart, 0).clip(-1)) / 3
    embed[BUCKETS] = 0
    conv = {w: rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        conv[w][0, 0, : FILTERS // 2] = 1.0
    return Net(embed, conv, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.1, np.float32), float(np.log(p / (1 - p)) - 1))


def _start(docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Net:
    return _initial(*_counts(docs, y), y.mean(), rng)


def _constant(ones: int, rows: int) -> Net:
    """The share of ones whatever the text."""
    share = float(np.clip(ones / rows, 1e-3, 1 - 1e-3)) if rows else 0.1
    width = FILTERS * len(WIDTHS)
    conv = {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
    return Net(np.zeros((BUCKETS + 1, DIM), np.float32), conv, np.zeros(width, np.float32), np.zeros(width, np.float32), float(np.log(share / (1 - share))))


class _Learner:
    """A net that learns: the embeddings by plain steps, what is dense by Adam's."""

    def __init__(self, net: Net) -> None:
        self.net, self.steps = net, 0.0
        self.dense = {**{f"conv{w}": net.conv[w] for w in WIDTHS}, "out": net.out, "bias": net.bias, "base": np.array([net.base])}
        self.m = {k: np.zeros_like(x) for k, x in self.dense.items()}
        self.v = {k: np.zeros_like(x) for k, x in self.dense.items()}
        self.moved = np.zeros(BUCKETS + 1, dtype=bool)

    def _step(self, name: str, g: np.ndarray, rate: float) -> None:
        x, m, v = self.dense[name], self.m[name], self.v[name]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        x -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def learn(self, docs: list[np.ndarray], y: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
        """One epoch over lists of buckets and 0/1 labels."""
        net, base, rate = self.net, self.dense["base"], RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            self.steps += 1
            top, won = net.winners([docs[i] for i in some])
            z = top + net.bias
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + base[0], -30, 30)))
            err = ((p - y[some]) / len(some)).astype(np.float32)
            dz = (err[:, None] * net.out) * (z > 0)
            at, pulls = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                doc, unit = np.nonzero(dz[:, cols])
                slope = dz[:, cols][doc, unit][:, None]
                by_unit = np.eye(FILTERS, dtype=np.float32)[unit] * slope
                g = np.zeros_like(net.conv[w])
                for j in range(w):
                    ids = won[:, cols, j][doc, unit]  # buckets of the word, by filter that passes something on
                    g[j] = net.vectors(ids).T @ by_unit
                    at.append(ids)
                    pulls.append(slope * net.conv[w][j].T[unit])
                self._step(f"conv{w}", g + DECAY * net.conv[w] / len(some), rate)
            self._pull(np.concatenate(at), np.concatenate(pulls), rate * 5)
            self._step("out", hidden.T @ err + DECAY * net.out, rate)
            self._step("bias", dz.sum(axis=0), rate)
            self._step("base", np.array([err.sum()], dtype=float), rate)
        net.base = float(base[0])

    def _pull(self, ids: np.ndarray, by: np.ndarray, rate: float) -> None:
        """Moves the vectors of the buckets ``ids`` (several to a row of ``by``) against ``by``."""
        flat = ids.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")[: int((flat < BUCKETS).sum())]
        if len(order):
            flat = flat[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            self.net.embed[flat[first]] -= rate * np.add.reduceat(by[order // ids.shape[1]], first, axis=0)
            self.moved[flat[first]] = True

    def state(self) -> np.ndarray:
        """What is dense, as one vector."""
        return np.concatenate([x.ravel().astype(float) for of in (self.dense, self.m, self.v) for x in of.values()] + [[self.steps]])

    def set_state(self, state: np.ndarray) -> None:
        at = 0
        for of in (self.dense, self.m, self.v):
            for x in of.values():
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size
        self.steps, self.net.base = float(state[at]), float(self.dense["base"][0])


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Net:
    """Train on lists of buckets and 0/1 labels."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return _constant(y.sum(), len(y))
    learner = _Learner(_start(docs, y, rng))
    for epoch in range(EPOCHS):
        learner.learn(docs, y, epoch, rng)
    return learner.net


def best_threshold(score: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The score from which on predicting 1 gives the best F1; each entry stands for one row or for ``rows``."""
    order = np.argsort(-score, kind="stable")
    rows = np.ones(len(y)) if rows is None else rows
    hits = np.cumsum((y * rows)[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + (y * rows).sum())
    f1[:-1][score[order][1:] == score[order][:-1]] = -1  # rows of one score go together
    return float(score[order][int(np.argmax(f1))])


def _lists(docs: DataFrame, chosen: DataFrame, shards: int) -> DataFrame:
    """Shard, doc_id, label, lang, half, n_words and buckets of the chosen documents, a task per shard; of rows that share a doc_id one counts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen, "doc_id").repartition(shards, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct("text", "lang")).alias("one"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tb.flat(b.column(5))
            for lo, hi in tb.slices(offsets, SLICE):
                if hi - lo == 1:
                    lists = [_long_tokens(data[offsets[lo] : offsets[hi]])]
                else:
                    tok, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    tok = tok.astype(np.uint16)
                    lists = [tok[first[i] : first[i + 1]] for i in range(hi - lo)]
                size, found = pa.array([len(x) for x in lists], pa.int64()), pa.array([x.tobytes() for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:5]), size, found], ["shard", "doc_id", "label", "lang", "half", "n_words", "tok"])

    schema = "shard int, doc_id long, label int, lang string, half int, n_words long, tok binary"
    lists = texts.select(F.spark_partition_id().alias("shard"), "doc_id", "label", "one.lang", half.alias("half"), "one.text").mapInArrow(cut, schema)
    return _shuffled(lists)


def _shuffled(lists: DataFrame) -> DataFrame:
    """Written down, each shard in an order that has nothing to do with the texts."""
    return materialise(lists.sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(1)), "doc_id"), "labelled")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    data, offsets = tb.flat(column)
    tok = data.view(np.uint16).reshape(-1, 1 + len(STARTS))
    at = offsets // (2 * (1 + len(STARTS)))
    return [tok[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def _scores(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    """Scores of lists of buckets."""
    return net._probability(net.winners(docs)[0] + net.bias) if docs else np.zeros(0)


def _starts(lists: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int, int]]:
    """By half: documents with label 1 and all documents by bucket, rows with label 1 and all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            docs, y, half = _unpacked(b.column(2)), b.column(1).to_numpy(), b.column(0).to_numpy()
            for k in np.unique(half).tolist():
                of = np.flatnonzero(half == k)
                ones, all_ = _counts([docs[i] for i in of], y[of])
                ones[BUCKETS], all_[BUCKETS] = y[of].sum(), len(of)  # the blank's places hold the rows
                found[k] = found.get(k, 0) + np.stack([ones, all_])
        for k, n in found.items():
            spans = [n[:, lo : lo + SPAN] for lo in range(0, BUCKETS + 1, SPAN)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(spans), pa.int32()), pa.array(range(len(spans)), pa.int32()), pa.array([x.tobytes() for x in spans], pa.binary())], ["half", "span", "n"])

    def summed(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in t.column("n").to_pylist())
        return pa.table([t.column("half").slice(0, 1), t.column("span").slice(0, 1), pa.array([n.tobytes()], pa.binary())], names=["half", "span", "n"])

    schema, out = "half int, span int, n binary", {}
    for r in lists.select("half", "label", "tok").mapInArrow(counted, schema).groupBy("half", "span").applyInArrow(summed, schema).collect():
        n = out.setdefault(r["half"], np.zeros((2, BUCKETS + 1), np.int64))
        part = np.frombuffer(r["n"], np.int64).reshape(2, -1)
        n[:, r["span"] * SPAN : r["span"] * SPAN + part.shape[1]] = part
    blank = lambda n: (np.append(n[0, :-1], 0), np.append(n[1, :-1], 0), int(n[0, -1]), int(n[1, -1]))
    return {k: blank(out.get(k, np.zeros((2, BUCKETS + 1), np.int64))) for k in HALVES}


def _round(lists: DataFrame, learners: dict[int, _Learner], epochs: range) -> None:
    """Every learner goes through its rows for some epochs, each shard by itself, and takes together what the shards learned.

    More than one epoch at a time is for a single shard only, whose rows are held.
    """

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, rows, held = None, None, 0, []
        for b in batches:
            net, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(net) != 0) | (np.diff(shard) != 0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(net)], strict=True):
                if hi == lo:
                    continue
                if key != (net[lo], shard[lo]):
                    if key is not None:
                        yield from closed(key, one, rows, held)
                    key, rows, held = (net[lo], shard[lo]), 0, []
                    one = _Learner(Net(learners[key[0]].net.embed.copy(), {w: x.copy() for w, x in learners[key[0]].net.conv.items()}, learners[key[0]].net.bias.copy(), learners[key[0]].net.out.copy(), 0.0))
                    one.set_state(learners[key[0]].state())
                docs, y = _unpacked(b.column(3).slice(lo, hi - lo)), b.column(2).slice(lo, hi - lo).to_numpy().astype(float)
                rows += len(y)
                if len(epochs) > 1:
                    held.append((docs, y))
                else:
                    one.learn(docs, y, epochs[0], np.random.default_rng([3, *map(int, key), epochs[0], rows]))
        if key is not None:
            yield from closed(key, one, rows, held)

    def closed(key, one: _Learner, rows: int, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            docs, y = [d for some, _ in held for d in some], np.concatenate([y for _, y in held])
            for epoch in epochs:
                one.learn(docs, y, epoch, np.random.default_rng([3, *map(int, key), epoch, rows]))
        moved = np.flatnonzero(one.moved)
        cuts = np.searchsorted(moved, np.arange(0, BUCKETS + SPAN, SPAN))
        spans = [(i, moved[lo:hi]) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        by = [(one.net.embed[u] - learners[key[0]].net.embed[u]).tobytes() for _, u in spans]
        n = 1 + len(spans)
        columns = [
            pa.array([key[0]] * n, pa.int32()), pa.array([-1, *(i for i, _ in spans)], pa.int32()), pa.array([float(rows)] * n, pa.float64()),
            pa.array([b"", *(u.astype(np.int32).tobytes() for _, u in spans)], pa.binary()), pa.array([one.state().tobytes(), *by], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["net", "span", "weight", "at", "by"])

    def mean(t: pa.Table) -> pa.Table:
        span, weight, at, by = t.column("span")[0].as_py(), t.column("weight").to_pylist(), t.column("at").to_pylist(), t.column("by").to_pylist()
        order = sorted(range(len(by)), key=lambda i: (weight[i], by[i]))  # sums do not depend on the order of arrival
        if span < 0:
            u, got = b"", sum(np.frombuffer(by[i], float) * weight[i] for i in order) / sum(weight)
        else:
            total, of = np.zeros((SPAN, DIM)), np.zeros(SPAN)
            for i in order:
                ids = np.frombuffer(at[i], np.int32) - span * SPAN
                total[ids] += np.frombuffer(by[i], np.float32).reshape(-1, DIM).astype(float) * weight[i]
                of[ids] += weight[i]
            ids = np.flatnonzero(of)
            share = np.maximum(max(weight), of[ids] / GAIN)
            u, got = (ids + span * SPAN).astype(np.int32).tobytes(), (total[ids] / share[:, None]).astype(np.float32)
        return pa.table([t.column("net").slice(0, 1), t.column("span").slice(0, 1), pa.array([sum(weight)], pa.float64()), pa.array([u], pa.binary()), pa.array([got.tobytes()], pa.binary())], names=["net", "span", "weight", "at", "by"])

    schema = "net int, span int, weight double, at binary, by binary"
    of = lambda k: (lists if k == BOTH else lists.where(F.col("half") != k)).select(F.lit(k).alias("net"), "shard", "label", "tok")
    every = reduce(DataFrame.union, [of(k) for k in sorted(learners, reverse=True)])  # the longest tasks first
    for r in every.mapInArrow(learned, schema).groupBy("net", "span").applyInArrow(mean, schema).collect():
        one = learners[r["net"]]
        if r["span"] < 0:
            one.set_state(np.frombuffer(r["by"], float))
        else:
            one.net.embed[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["by"], np.float32).reshape(-1, DIM)


def _calibrated(lists: DataFrame, nets: dict[int, Net]) -> dict[str | None, float]:
    """Thresholds by language and of all of them (null), on scores to six digits from nets that did not learn from the rows."""
    checked = [nets[k] for k in HALVES]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, half, s = _unpacked(b.column(3)), b.column(2).to_numpy(), np.zeros(b.num_rows)
            for k, net in enumerate(checked):
                of = np.flatnonzero(half == k)
                s[of] = _scores(net, [docs[i] for i in of])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, 6))], ["lang", "label", "score"])

    found = lists.select("lang", "label", "half", "tok").mapInArrow(scored, "lang string, label int, score double")
    cells = materialise(found.groupBy("lang", "score", "label").agg(F.count(F.lit(1)).alias("n")), "calibration")
    ones = F.sum(F.col("label") * F.col("n"))
    both = ones.between(CALIBRATION, F.sum("n") - CALIBRATION)
    enough = cells.where("lang IS NOT NULL").groupBy("lang").agg(both.alias("both")).where("both").select("lang")
    by_lang = cells.join(enough, "lang", "left_semi").toPandas().sort_values(["lang", "score", "label"], kind="stable")
    of_all = cells.groupBy("score", "label").agg(F.sum("n").alias("n")).toPandas().sort_values(["score", "label"], kind="stable")

    def threshold(of) -> float:
        s, y, n = of["score"].to_numpy(), of["label"].to_numpy().astype(float), of["n"].to_numpy()
        return best_threshold(s, y) if (n == 1).all() else best_threshold(s, y, n)

    ones, rows = int((of_all["label"] * of_all["n"]).sum()), int(of_all["n"].sum())
    out: dict[str | None, float] = {None: threshold(of_all) if rows and CALIBRATION <= ones <= rows - CALIBRATION else THRESHOLD}
    return out | {name: threshold(of) for name, of in by_lang.groupby("lang")}


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None, words: int | None = None) -> Net:
    """Fit on every labelled document that is not held out; thresholds by language.

    A caller may ask for ``rows`` documents or ``words`` words at most; the query does not.
    """
    chosen = materialise(sample(labels, "toxic", FOLDS, HELD_OUT, rows), "chosen")
    shards = max(1, -(-chosen.count() // SHARD_ROWS))
    lists = _lists(docs, chosen, shards)
    if words is not None:
        order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # two numbers a row
        fits = lists.select("doc_id", F.sum("n_words").over(order).alias("total")).where(F.col("total") <= words)
        lists = _shuffled(lists.join(fits, "doc_id", "left_semi").repartition(shards, "doc_id"))
    starts = _starts(lists)
    starts = {0: starts[1], 1: starts[0], BOTH: tuple(a + b for a, b in zip(*starts.values(), strict=True))}
    nets, learners = {}, {}
    for k, (ones, all_, positive, n) in starts.items():
        if 0 < positive < n:
            nets[k] = _initial(ones, all_, positive / n, np.random.default_rng(3))
            learners[k] = _Learner(nets[k])
        else:
            nets[k] = _constant(positive, n)
    if learners:
        held = shards == 1 and lists.agg(F.sum("n_words")).first()[0] <= HELD_WORDS
        for epochs in [range(EPOCHS)] if held else [range(e, e + 1) for e in range(EPOCHS)]:
            _round(lists, learners, epochs)
    nets[BOTH].thresholds = _calibrated(lists, nets)
    return nets[BOTH]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, lang_threshold, flagged (score reaches its language's threshold)."""
    net = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tb.flat(b.column(2))
            whole = lambda lo, hi: net.score(*tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            long = lambda lo, hi: hi - lo == 1 and offsets[hi] - offsets[lo] > SLICE
            parts = [net.score_long(data[offsets[lo] : offsets[hi]]) if long(lo, hi) else whole(lo, hi) for lo, hi in tb.slices(offsets, SLICE)]
            p = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            limit = [net.thresholds.get(x, net.thresholds[None]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(limit, pa.float64())], ["doc_id", "score", "lang_threshold"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, score double, lang_threshold double")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
