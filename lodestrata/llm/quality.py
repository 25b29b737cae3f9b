"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed for whole Arrow batches with numpy. Trees are grown level by level from histograms of
binned statistics on a bounded sample of labelled rows (``TRAIN_ROWS``), then flattened into arrays: node i of a
tree has the children 2i + 1 and 2i + 2, so scoring is one vectorised step per level for all rows and trees.

Defined results: null and empty texts are scored from all-zero statistics; each repeated row is scored alike;
without labels of both kinds every score is the share of ones (0.5 without any); an empty table gives an empty
result; extra columns pass or are ignored, whatever they are called; a long text goes through in pieces, with only its
words and lines as numbers held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textbatch as tb
from lodestrata.llm.frames import unused
from lodestrata.llm.labelled import remainder, sample

#: Labelled rows that a model learns from at most; folds of doc_id, and the one that is held out.
TRAIN_ROWS, FOLDS, HELD_OUT = 20_000, 5, 0
#: Trees, their depth, bins of a statistic, step, L2 penalty of leaves, least hessian of a child.
TREES, DEPTH, BINS, STEP, PENALTY, LEAST = 80, 4, 32, 0.15, 1.0, 2.0
#: Scores of at least this are predicted as 1.
THRESHOLD = 0.3
SLICE = 1_000_000

# Byte classes; a byte belongs to the last that names it.
_KINDS = ["other", "lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "bar", "symbol", "bracket", "slash", "high"]
_KIND = np.zeros(256, dtype=np.int64)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t", "newline": b"\r\n", "stop": b".?", "comma": b",;:",
    "bang": b"!", "bar": b"|", "symbol": b"#$%&*+=~^_`", "bracket": b"()[]{}<>", "slash": b"/\\@", "high": range(128, 256),
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and share of the most frequent one, by document."""
    n = len(bounds) - 1
    share, top = np.zeros(n), np.zeros(n)
    for d in range(n):
        part = np.sort(values[bounds[d] : bounds[d + 1]])
        if len(part):
            cuts = np.flatnonzero(part[1:] != part[:-1])
            share[d] = (len(cuts) + 1) / len(part)
            top[d] = np.diff(np.concatenate([[-1], cuts, [len(part) - 1]])).max() / len(part)
    return share, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per document (float32)."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    doc, step = (np.repeat(np.arange(n), np.diff(offsets)) * len(_KINDS), max(len(data), 1)) if n > 1 else (0, tb.PIECE)
    kinds = np.zeros((n, len(_KINDS)), dtype=np.int64)
    for lo in range(0, len(data), step):
        kinds += np.bincount(doc + _KIND[data[lo : lo + step]], minlength=n * len(_KINDS)).reshape(n, -1)
    some = np.maximum(size, 1)
    starts, ends, h, first = tb.runs(data, offsets, tb.NOT_SPACE)
    count = np.diff(first).astype(float)
    long = (ends - starts).astype(float)
    word_share, word_top = _distinct(h, first)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][count > 0]] = 0  # the word before is another document's
    odd = ((_KIND[data[ends - 1]] == _KINDS.index("symbol")) | (_KIND[data[ends - 1]] == _KINDS.index("bang"))).astype(float) if len(ends) else long
    not_newline = np.ones(256, dtype=bool)
    not_newline[[10, 13]] = False
    _, _, lh, lf = tb.runs(data, offsets, not_newline)
    lines = np.diff(lf).astype(float)
    line_share, line_top = _distinct(lh, lf)
    total = lambda x, b: tb.per_doc(x, b, np.add, 0)
    words = np.maximum(count, 1)
    columns = [
        np.log1p(size), np.log1p(count), total(long, first) / words, tb.per_doc(long, first, np.maximum, 0), word_share, word_share * np.log1p(count), word_top,
        total(again, first) / words, total(odd, first) / words, np.log1p(lines), size / np.maximum(lines, 1), line_share, line_top,
        kinds[:, _KINDS.index("stop")] / words, kinds[:, _KINDS.index("upper")] / words,
    ]
    return np.column_stack([*columns, kinds / some[:, None]]).astype(np.float32)


@dataclass
class Trees:
    """Flattened trees: split statistic and threshold by tree and inner node, value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        trees = np.arange(len(self.leaf))[None, :]
        rows, node = np.arange(len(x))[:, None], np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + self.leaf[trees, node - (1 << DEPTH) + 1].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss. The result depends on the rows' order only through rounding."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), base)
    features = x.shape[1]
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)])
    margin, found = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, feature, threshold = np.zeros(len(y), dtype=np.int64), np.zeros(inner, int), np.full(inner, np.inf, np.float32)
        split_bin = np.full(inner, BINS)
        for depth in range(DEPTH):
            low, width = (1 << depth) - 1, 1 << depth
            best = np.full(width, 1e-9)
            for f in range(features):
                at = (node - low) * BINS + binned[:, f]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt**2 / (ht + PENALTY)
                gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                for i in np.flatnonzero(top > best):
                    if b[i] < BINS - 1:
                        best[i], feature[low + i], split_bin[low + i], threshold[low + i] = top[i], f, b[i], cuts[f][b[i]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[node])
        at = node - inner
        leaf = -STEP * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + PENALTY)
        margin += leaf[at]
        found.append((feature, threshold, leaf))
    return Trees(*(np.array(z) for z in zip(*found, strict=True)), base)


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = tb.flat(b.column(column))
    for lo, hi in tb.slices(offsets, SLICE):
        yield lo, hi, statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents that are not held out; of rows that share a doc_id one counts."""
    chosen = sample(labels, "quality", FOLDS, HELD_OUT, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in _batches(b, 2):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), flat], ["doc_id", "label", "x"])

    one = texts.mapInArrow(measured, "doc_id long, label int, x array<float>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    got = one.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float32) if len(got) else np.zeros((0, 1), np.float32)
    return fit(x, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Trees, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` after its own; all rows and columns stay. ``docs`` must not have that column yet."""
    if unused(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    text = unused(docs, "__text")
    rows = docs.withColumn(text, F.col("text").cast("string"))
    rows = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # names with dots do not reach Python workers otherwise
    schema = rows.withColumn(rows.columns[-1], F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.score(x) for _, _, x in _batches(b, b.num_columns - 1)]
            p = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], schema.names)

    return rows.mapInArrow(scored, schema).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), "score")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality, with all their columns and no other."""
    name = unused(docs, "quality_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
