"""Ordered folds: state runs along each key's rows in order, one Arrow batch at a time.

Rows of a key lie together in one sorted partition and stream through; memory is one batch and one state, however
many rows a key has. Long stretches of a key within a batch go through numpy (prefix sums, jumps found by binary
search); short ones, and values that numpy would round, row by row. Both give the same values.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: step(state, values) -> (state, value); the state starts as None.
Step = Callable[[tuple | None, tuple], tuple[tuple | None, object]]
#: stretch(state, columns) -> (state, values), as ``step`` row by row, or None where it cannot tell exactly.
Stretch = Callable[[tuple | None, list[pa.Array]], tuple[tuple | None, pa.Array] | None]
#: Rows of a key in a batch from which on they are a stretch.
LONG = 64


def _key_changes(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Where a row's key differs from the one before; null equals null and NaN equals NaN."""
    out = np.zeros(max(0, rows - 1), dtype=bool)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out |= code[1:] != code[:-1]
    return np.flatnonzero(out) + 1


def fold_batches(batches: Iterator[pa.RecordBatch], by: list[str], inputs: list[str], arrow: pa.DataType, step: Step, stretch: Stretch | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Each batch of sorted rows and the values of its rows."""

    def key(values: tuple) -> tuple:
        return tuple("NaN" if isinstance(v, float) and v != v else v for v in values)

    now, state = None, None
    for b in batches:
        names = b.schema.names
        keys, columns = ([b.column(names.index(c)) for c in some] for some in (by, inputs))
        cuts = [0, *_key_changes(keys, b.num_rows).tolist(), b.num_rows]
        parts = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            own = key(tuple(k[lo].as_py() for k in keys))
            if own != now:
                now, state = own, None
            held = [c.slice(lo, hi - lo) for c in columns]
            found = stretch(state, held) if stretch is not None and hi - lo >= LONG else None
            if found is None:
                out = []
                for values in zip(*(c.to_pylist() for c in held), strict=True):
                    state, value = step(state, values)
                    out.append(value)
                found = state, pa.array(out, arrow)
            state = found[0]
            parts.append(found[1].cast(arrow))
        yield b, pa.concat_arrays(parts) if parts else pa.nulls(0, arrow)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], name: str, kind: str, step: Step, columns: list[str], stretch: Stretch | None = None) -> DataFrame:
    """``df`` with a column ``name``: the values of ``step`` on ``columns`` along each key's rows in order.

    Null is a key like any other, and so is NaN; values reach ``step`` as they are, null as None.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # any name reaches Python workers
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    schema = StructType([*plain.schema.fields, StructType.fromDDL(f"v {kind}")[0]])
    by, inputs = [at[k] for k in keys], [at[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values in fold_batches(batches, by, inputs, arrow, step, stretch):
            yield pa.RecordBatch.from_arrays([*b.columns, values], schema.names)

    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    sorted_rows = plain.repartition(*by).sortWithinPartitions(*by, *(at[c] for c in order))
    return sorted_rows.mapInArrow(run, schema).toDF(*df.columns, name)


def packing(budget: float) -> Step:
    """Next-fit: the group goes up when a row would take a group that is not empty over ``budget``. A null weight is 0."""

    def step(state: tuple | None, values: tuple) -> tuple:
        w = values[0] or 0
        if state is None:
            return (0, w), 0
        group, total = state
        return ((group + 1, w), group + 1) if total + w > budget else ((group, total + w), group)

    return step


def limiting(limit: int, window: float) -> Step:
    """(now) -> whether a hit passes. The window starts at the key's first hit and moves by whole windows; the one before it
    counts as far as the sliding window still covers it. Refused hits are not counted; a hit without a time is refused."""

    def step(state: tuple | None, values: tuple) -> tuple:
        now = values[0]
        if now is None:
            return state, False
        begin, count, before = state or (now, 0, 0)
        past = int((now - begin) // window)
        if past > 0:
            begin, count, before = begin + past * window, 0, count * (past == 1)
        used = before * max(0.0, 1.0 - (now - begin) / window) + count
        return (begin, count + (used + 1 <= limit), before), used + 1 <= limit

    return step


def repeating(seconds: float) -> Step:
    """(now, own) -> the first report of the current window, None for that first one. Repeats do not extend it. A report
    without a time repeats none and opens no window."""

    def step(state: tuple | None, values: tuple) -> tuple:
        now, own = values
        if now is None:
            return state, None
        if state is None or now - state[0] >= seconds:
            return (now, own), None
        return state, state[1]

    return step


#: Whole numbers up to here add up without rounding as doubles.
_EXACT = float(1 << 53)


def _floats(column: pa.Array) -> np.ndarray | None:
    """The column as doubles without rounding; None if it has nulls or values that doubles do not hold or compare."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return None
    v = column.to_numpy(zero_copy_only=False)
    out = v.astype(np.float64)
    return out if len(out) and np.isfinite(out).all() and np.abs(out).max() <= _EXACT else None


def packing_stretch(budget: float) -> Stretch:
    """``packing`` of whole weights from 0 on: prefix sums, and from each row the first that does not fit any more."""

    def stretch(state: tuple | None, columns: list[pa.Array]) -> tuple | None:
        w = _floats(columns[0].fill_null(0) if columns[0].null_count else columns[0])
        if w is None or (w < 0).any() or (w != np.floor(w)).any() or (sums := np.cumsum(w))[-1] > _EXACT / 2 or state is not None and state[1] != int(state[1]):
            return None
        group, total = state or (0, 0)
        before = sums - w
        after = np.maximum(np.searchsorted(sums, before + budget, side="right"), np.arange(1, len(w) + 1))
        starts, at = [], int(np.searchsorted(sums, budget - total, side="right")) if state else int(after[0])
        while at < len(w):
            starts.append(at)
            at = int(after[at])
        new = np.zeros(len(w), dtype=np.int64)
        new[starts] = 1
        groups = group + np.cumsum(new)
        kept = float(sums[-1] - before[starts[-1]]) if starts else total + float(sums[-1])
        return (int(groups[-1]), int(kept)), pa.array(groups)

    return stretch


def limiting_stretch(limit: int, window: float) -> Stretch:
    """``limiting`` of times in order: within a window the count may rise by one with each hit up to a bound that never falls."""
    step = limiting(limit, window)

    def stretch(state: tuple | None, columns: list[pa.Array]) -> tuple | None:
        t = _floats(columns[0])
        if t is None or (np.diff(t) < 0).any():
            return None
        times, out, at = t.tolist(), np.zeros(len(t), dtype=bool), 0
        own = columns[0].to_pylist() if pa.types.is_integer(columns[0].type) else times
        while at < len(t):
            state, out[at] = step(state, (own[at],))
            begin, count, before = state
            at += 1
            end = bisect_left(times, begin + window, at)
            while end > at and (own[end - 1] - begin) // window > 0:
                end -= 1
            while end < len(t) and (own[end] - begin) // window <= 0:
                end += 1
            if end - at < LONG:
                for i in range(at, end):
                    state, out[i] = step(state, (own[i],))
            else:
                used = before * np.maximum(0.0, 1.0 - (t[at:end] - begin) / window)
                most = np.floor(limit - 1 - used)  # a hit passes while the count is at most this
                most -= used + most + 1 > limit
                most += used + most + 2 <= limit
                nth = np.arange(1, end - at + 1)
                counts = np.minimum(count + nth, np.maximum(np.minimum.accumulate(most + 1 - nth) + nth, count)).astype(np.int64)
                out[at:end] = np.diff(counts, prepend=count) > 0
                state = (begin, int(counts[-1]), before)
            at = end
        return state, pa.array(out)

    return stretch


def repeating_stretch(seconds: float) -> Stretch:
    """``repeating`` of times in order: from each first report the next one is found by binary search."""

    def stretch(state: tuple | None, columns: list[pa.Array]) -> tuple | None:
        t = _floats(columns[0])
        if t is None or (np.diff(t) < 0).any() or state is not None and not isinstance(state[0], (int, float)):
            return None
        times = t.tolist()

        def ends(begin: float, at: int) -> int:
            end = bisect_left(times, begin + seconds, at)
            while end > at and times[end - 1] - begin >= seconds:
                end -= 1
            while end < len(times) and times[end] - begin < seconds:
                end += 1
            return end

        at, starts = ends(state[0], 0) if state is not None else 0, []
        lead = at
        while at < len(times):
            starts.append(at)
            at = ends(times[at], at + 1)
        first = np.zeros(len(times), dtype=np.int64)
        own, kind = columns[1], columns[1].type
        if starts:
            sizes = np.diff([*starts, len(times)])
            first[lead:] = np.repeat(starts, sizes)
            named = own.take(pa.array(first[lead:], mask=np.isin(np.arange(lead, len(times)), starts)))
            state_now = (columns[0][starts[-1]].as_py(), own[starts[-1]].as_py())
        else:
            named, state_now = pa.nulls(0, kind), state
        return state_now, pa.concat_arrays([pa.array([state[1] if state else None] * lead, kind), named])

    return stretch


def pack_groups(df: DataFrame, keys: list[str], order: list[str], weight: str, budget: float) -> DataFrame:
    """``group_no`` by key: see ``packing``."""
    return ordered_fold(df, keys, order, "group_no", "long", packing(budget), [weight], packing_stretch(budget))


def rate_limit(hits: DataFrame, keys: list[str], limit: int, window: float, time: str = "at", order: tuple[str, ...] = ()) -> DataFrame:
    """``allowed`` by key: see ``limiting``."""
    return ordered_fold(hits, keys, [time, *order], "allowed", "boolean", limiting(limit, window), [time], limiting_stretch(limit, window))


def rate_limits(hits: DataFrame, client: str, limit: int, everyone: int, window: float, time: str = "at", order: tuple[str, ...] = ()) -> DataFrame:
    """``allowed`` where a hit passes its client's limit and then that of all clients together; the first is used up by hits
    that the second refuses, and hits that the first refuses do not reach the second.

    The second limit is one state for all clients by definition: one sorted stream of constant memory, over the hits that
    the first lets through only.
    """
    first = rate_limit(hits, [client], limit, window, time, order).withColumnRenamed("allowed", "__own")
    passed = first.where("__own").withColumn("__all", F.lit(0))
    second = rate_limit(passed, ["__all"], everyone, window, time, order).drop("__all")
    return second.unionByName(first.where(~F.col("__own")).withColumn("allowed", F.lit(False))).drop("__own")


def dedup_window(reports: DataFrame, keys: list[str], seconds: float, time: str = "at", name: str = "id") -> DataFrame:
    """``repeat_of`` by key: see ``repeating``."""
    return ordered_fold(reports, keys, [time, name], "repeat_of", dict(reports.dtypes)[name], repeating(seconds), [time, name], repeating_stretch(seconds))
