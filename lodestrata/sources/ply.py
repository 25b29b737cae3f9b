"""Binary splat PLY: header facts, triage of many files, a Spark data source that reads ranges and writes committed sets."""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from lodestrata.sources.files import located, matching

# Fixed values of the format.
SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
REQUIRED = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "rot_0", "rot_1", "rot_2", "rot_3"]
ORDER = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
REST_COUNTS = {0: 0, 9: 1, 24: 2, 45: 3}
HEADER_BYTES = 256 * 1024


class Rejected(ValueError):
    """An input that is no splat PLY; ``code`` is stable."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Header:
    count: int
    dtype: np.dtype
    body: int
    bands: int
    flat: bool
    extras: list[str]
    comments: list[str] = field(default_factory=list)


def parse_header(head: bytes) -> Header:
    """Facts from the first bytes of a file; raises Rejected, also where words or numbers are not as they should be."""
    try:
        return _header(head)
    except Rejected:
        raise
    except (ValueError, IndexError, TypeError) as e:
        raise Rejected("bad-header") from e


def _header(head: bytes) -> Header:
    if head[:3] != b"ply":
        raise Rejected("not-ply")
    end = re.search(rb"end_header", head)
    if not end:
        raise Rejected("header-too-long")
    line_end = re.compile(rb"\r?\n").match(head, end.end())
    if not line_end:
        raise Rejected("bad-header")
    order, elements, comments = None, [], []
    for line in head[: end.start()].decode("latin-1").splitlines()[1:]:
        key, *words = line.split() or [""]
        if key == "format":
            name = words[0] if words else ""
            if name == "ascii":
                raise Rejected("ascii-ply")
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(name)
            if order is None:
                raise Rejected("bad-format")
        elif key == "comment":
            comments.append(line.strip()[7:].strip())
        elif key == "element":
            elements.append((words[0], int(words[1]), [], []))
        elif key == "property":
            if not elements:
                raise Rejected("bad-header")
            if words[0] == "list":
                elements[-1][3].append(words[-1])
            elif words[0] not in SCALARS:
                raise Rejected("bad-header")
            else:
                elements[-1][2].append((words[1], SCALARS[words[0]]))
    if order is None:
        raise Rejected("bad-header")
    names = [e[0] for e in elements]
    if "vertex" not in names:
        raise Rejected("compressed-ply" if "chunk" in names else "no-vertex")
    at = names.index("vertex")
    if any(e[3] for e in elements[: at + 1]):
        raise Rejected("unsupported-layout")
    skipped = sum(e[1] * np.dtype([(f"{i}", t) for i, (_, t) in enumerate(e[2])]).itemsize for e in elements[:at])
    _, count, props, _ = elements[at]
    if count <= 0:
        raise Rejected("empty")
    have = [p for p, _ in props]
    if not set(REQUIRED) <= set(have):
        raise Rejected("not-splat")
    rest = sum(bool(re.fullmatch(r"f_rest_\d+", p)) for p in have)
    if rest not in REST_COUNTS:
        raise Rejected("bad-sh")
    known = set(REQUIRED) | {"scale_2"}
    extras = [p for p in have if p not in known and not re.fullmatch(r"f_rest_\d+", p)]
    return Header(count, np.dtype([(p, order + t) for p, t in props]), line_end.end() + skipped, REST_COUNTS[rest], "scale_2" not in have, extras, comments)


def _facts(path: str) -> dict:
    row = {"path": path, "ok": False, "code": None, "n": None, "stride": None, "body_offset": None, "sh_bands": None, "is2dgs": None, "extras": None}
    try:
        fs, inside = located(path)
        with fs.open_input_file(inside) as f:
            h = parse_header(f.read(HEADER_BYTES))
            size = f.size()
        row |= {"n": h.count, "stride": h.dtype.itemsize, "body_offset": h.body, "sh_bands": h.bands, "is2dgs": h.flat, "extras": h.extras}
        if size < h.body + h.count * h.dtype.itemsize:
            return row | {"code": "truncated"}
        return row | {"ok": True}
    except Rejected as e:
        return row | {"code": e.code}
    except FileNotFoundError:
        return row | {"code": "missing"}
    except OSError:
        return row | {"code": "unreadable"}


def triage_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per file: its facts, or a reject code ('missing' and 'unreadable' where it cannot be opened). Reads 256 KB of
    each, on the executors; no file stops the others."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_facts(p) for p in f["path"]], columns=["path", "ok", "code", "n", "stride", "body_offset", "sh_bands", "is2dgs", "extras"]).astype({c: "Int64" for c in ("n", "stride", "body_offset", "sh_bands")})

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 64)))
    return table.mapInPandas(look, "path string, ok boolean, code string, n long, stride long, body_offset long, sh_bands int, is2dgs boolean, extras array<string>")


#: The list of a committed set of files; readers of a folder follow it alone.
MANIFEST = "_files.json"
#: Bytes of a header that are read at first; twice as many each time until it ends.
FIRST_BYTES = 4096
#: Records of a batch.
BATCH = 65_536


def _opened(path: str) -> Header:
    """The header, without reading more of the file than about twice its length."""
    fs, inside = located(path)
    with fs.open_input_file(inside) as f:
        head, want = b"", FIRST_BYTES
        while True:
            head += f.read(want - len(head))
            if b"end_header" in head[:-2] or len(head) < want or want >= HEADER_BYTES:
                return parse_header(head)
            want *= 2


@dataclass
class SplatFile:
    """A file of a scene: its records are numbered from ``first``."""

    path: str
    scene_id: str
    first: int
    header: Header


def committed(path: str) -> list[dict] | None:
    """The committed files of a folder (name, scene_id, first, rows), or None if nothing was committed there."""
    fs, inside = located(path)
    name = f"{inside}/{MANIFEST}"
    if not fs.get_file_info(name).is_file:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())["files"]


@dataclass
class Spans(InputPartition):
    """Record ranges of one file: (first, last, block), counted within the file."""

    file: SplatFile
    spans: list[tuple[int, int, int]]


class SplatPly(DataSource):
    """``spark.read.format("splat_ply").option("path", glob or folder).option("records_per_split", n)``.

    A folder that ``SplatPlyWriter`` has committed gives its files' scenes and record numbers; any other file is a scene. With
    the options ``blocks`` and ``block_records`` only that many evenly spread blocks of a scene are opened, and a column
    ``block`` tells them apart. With ``push_filters`` (and ``spark.sql.python.filterPushdown.enabled``) comparisons of scene_id
    and record_no with values leave out files and ranges; ``read_splats`` sets both.
    """

    @classmethod
    def name(cls) -> str:
        return "splat_ply"

    def _named(self) -> list[tuple[str, str, int]]:
        """Path, scene and first record of each file."""
        path = self.options["path"].rstrip("/")
        files = committed(path)
        if files is not None:
            return [(f"{path}/{f['name']}", f["scene_id"], f["first"]) for f in files]
        return [(p, os.path.splitext(os.path.basename(p))[0], 0) for p in matching(path)]

    def schema(self) -> str:
        h = _opened(self._named()[0][0])
        names = [c for c in ORDER if (c != "f_rest" or h.bands) and (c != "scale_2" or not h.flat)]
        block = ", block long" if "blocks" in self.options else ""
        return "scene_id string, record_no long, " + ", ".join(f"{c} {'array<float>' if c == 'f_rest' else 'float'}" for c in names) + block

    def reader(self, schema: StructType) -> DataSourceReader:
        blocks = (int(self.options["blocks"]), int(self.options.get("block_records", "1024"))) if "blocks" in self.options else None
        kind = PruningReader if self.options.get("push_filters", "false").lower() == "true" else SplatPlyReader
        return kind(self._named(), schema.names, int(self.options.get("records_per_split", "1000000")), blocks)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SplatPlyWriter(self.options["path"].rstrip("/"), schema.names, self.options.get("big_endian", "false").lower() == "true", overwrite)


def block_spans(n: int, blocks: int, block_records: int) -> list[tuple[int, int, int]]:
    """First, last and number of evenly spread blocks of ``n`` records, as ``block_sample`` spreads them."""
    count, size = max(1, min(blocks, math.ceil(n / block_records))), min(block_records, n)
    begins = [math.floor(k / count * max(0, n - size)) for k in range(count)]
    return [(begin, begin + size, k) for k, begin in enumerate(begins)]


class SplatPlyReader(DataSourceReader):
    """Reads record ranges; a partition has ranges of one file with about ``per_split`` records."""

    def __init__(self, named: list[tuple[str, str, int]], names: list[str], per_split: int, blocks: tuple[int, int] | None):
        self.named, self.names, self.per_split, self.blocks = named, names, per_split, blocks
        self.scenes: set[str] | None = None
        self.low, self.high, self.numbers = 0, 1 << 62, None

    def _wanted(self, files: list[SplatFile]) -> list[tuple[int, int, int]]:
        """Ranges of a scene's records that the options and filters leave."""
        n = files[-1].first + files[-1].header.count
        found = block_spans(n, *self.blocks) if self.blocks else [(0, n, 0)]
        if self.numbers is not None:
            some = sorted(self.numbers)
            found = [(r, r + 1, k) for a, b, k in found for r in some[bisect_left(some, a) : bisect_left(some, b)]]
        cut = [(max(a, self.low), min(b, self.high), k) for a, b, k in found]
        return [(a, b, k) for a, b, k in cut if a < b]

    def partitions(self) -> list[Spans]:
        scenes: dict[str, list[tuple[str, str, int]]] = {}
        for path, scene, first in self.named:
            if self.scenes is None or scene in self.scenes:
                scenes.setdefault(scene, []).append((path, scene, first))
        out = []
        for named in scenes.values():
            files = [SplatFile(*x, _opened(x[0])) for x in sorted(named, key=lambda x: x[2])]
            wanted = self._wanted(files)
            for file in files:
                end, spans, held = file.first + file.header.count, [], 0
                for a, b, k in wanted:
                    a, b = max(a, file.first) - file.first, min(b, end) - file.first
                    while a < b:
                        take = min(b - a, self.per_split - held)
                        spans.append((a, a + take, k))
                        a, held = a + take, held + take
                        if held == self.per_split:
                            out.append(Spans(file, spans))
                            spans, held = [], 0
                if spans:
                    out.append(Spans(file, spans))
        return out or [Spans(SplatFile("", "", 0, None), [])]

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        if not part.spans:
            return
        fs, inside = located(part.file.path)
        h = part.file.header
        with fs.open_input_file(inside) as f:
            raws, numbers, blocks, held = [], [], [], 0
            for first, last, block in part.spans:
                for at in range(first, last, BATCH):
                    n = min(BATCH, last - at)
                    f.seek(h.body + at * h.dtype.itemsize)
                    raw = np.frombuffer(f.read(n * h.dtype.itemsize), h.dtype)
                    if len(raw) < n:
                        raise Rejected("truncated")
                    raws.append(raw)
                    numbers.append(np.arange(at, at + n, dtype=np.int64) + part.file.first)
                    blocks.append(np.full(n, block, dtype=np.int64))
                    held += n
                    if held >= BATCH:
                        yield self._batch(part.file.scene_id, np.concatenate(numbers), np.concatenate(blocks), np.concatenate(raws))
                        raws, numbers, blocks, held = [], [], [], 0
            if raws:
                yield self._batch(part.file.scene_id, np.concatenate(numbers), np.concatenate(blocks), np.concatenate(raws))

    def _batch(self, scene: str, numbers: np.ndarray, blocks: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        cols = []
        for name in self.names:
            if name == "scene_id":
                cols.append(pa.array([scene] * len(raw)))
            elif name == "record_no":
                cols.append(pa.array(numbers))
            elif name == "block":
                cols.append(pa.array(blocks))
            elif name == "f_rest":
                rest = sorted((p for p in raw.dtype.names if p.startswith("f_rest_")), key=lambda p: int(p[7:]))
                flat = np.column_stack([raw[p].astype("<f4") for p in rest]).ravel()
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(rest)), pa.int32()), pa.array(flat)))
            else:
                cols.append(pa.array(raw[name].astype("<f4")))
        return pa.RecordBatch.from_arrays(cols, self.names)


class PruningReader(SplatPlyReader):
    """The same, told of filters before it plans its ranges. Spark still checks them on the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self._narrow(f)
            yield f

    def _narrow(self, f: Filter) -> None:
        several = isinstance(f, In)
        if f.attribute == ("scene_id",) and (several or isinstance(f, (EqualTo, EqualNullSafe))):
            values = set(f.value) if several else {f.value}
            self.scenes = values if self.scenes is None else self.scenes & values
        elif f.attribute == ("record_no",):
            if several or isinstance(f, (EqualTo, EqualNullSafe)):
                values = {v for v in (f.value if several else [f.value]) if v is not None}
                self.numbers = values if self.numbers is None else self.numbers & values
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            else:
                self.high = min(self.high, f.value + 1)


def read_splats(spark: SparkSession, path: str, records_per_split: int = 1_000_000, blocks: int | None = None, block_records: int = 1024) -> DataFrame:
    """Rows of splat files; filters on scene_id and record_no leave out files and ranges. See ``SplatPly`` for the options."""
    spark.dataSource.register(SplatPly)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("splat_ply").option("path", path).option("records_per_split", records_per_split).option("push_filters", "true")
    return (reader if blocks is None else reader.option("blocks", blocks).option("block_records", block_records)).load()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: name, scene, rows; in order of the partitions."""

    part: int
    files: list[tuple[str, str, int]]


class SplatPlyWriter(DataSourceArrowWriter):
    """Writes a set of files that readers see as a whole or not at all.

    A task streams its rows to one file after another (a new one where the scene changes); the body waits in the task's own
    scratch file until its number of rows, which the header tells, is known. Files get names of their own in the folder of
    this job, so tasks that fail or run twice leave nothing that counts. Commit replaces the folder's list in one move and
    then removes the files of the set before; abort removes this job's folder.
    """

    def __init__(self, path: str, names: list[str], big_endian: bool, overwrite: bool):
        self.path, self.overwrite, self.order = path, overwrite, ">" if big_endian else "<"
        self.names, self.keyed = [c for c in ORDER if c in names], "scene_id" in names
        self.folder = f"set-{uuid.uuid4().hex}"

    def _records(self, b: pa.RecordBatch) -> np.ndarray:
        columns: list[tuple[str, np.ndarray]] = []
        for c in self.names:
            values = b.column(b.schema.get_field_index(c))
            if c == "f_rest":
                if values.null_count or len(set(values.value_lengths().to_pylist())) > 1:
                    raise ValueError("rows of a file must have f_rest of one length")
                rest = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
                columns += [(f"f_rest_{i}", rest[:, i]) for i in range(rest.shape[1])]
            else:
                columns.append((c, values.cast(pa.float32(), safe=False).to_numpy(zero_copy_only=False)))
        body = np.empty(b.num_rows, dtype=[(c, self.order + "f4") for c, _ in columns])
        for c, v in columns:
            body[c] = v
        return body

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, files = TaskContext.get().partitionId(), []
        scene, rows, dtype, scratch = None, 0, None, None

        def close() -> None:
            if not rows:
                return
            name = f"{self.folder}/part-{part:05d}-{len(files):05d}-{uuid.uuid4().hex}.ply"
            fs, inside = located(f"{self.path}/{name}")
            fs.create_dir(os.path.dirname(inside), recursive=True)
            kind = "big" if self.order == ">" else "little"
            head = ["ply", f"format binary_{kind}_endian 1.0", f"element vertex {rows}", *(f"property float {c}" for c in dtype.names), "end_header", ""]
            scratch.seek(0)
            with fs.open_output_stream(inside) as out:
                out.write("\n".join(head).encode())
                while chunk := scratch.read(8 << 20):
                    out.write(chunk)
            files.append((name, scene, rows))

        try:
            for b in iterator:
                own = b.column(b.schema.get_field_index("scene_id")).cast(pa.string()).to_pylist() if self.keyed else [""] * b.num_rows
                cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
                body = self._records(b)
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        if scratch is None or own[lo] != scene or body.dtype != dtype:
                            if scratch is not None:
                                close()
                                scratch.close()
                            scene, rows, dtype, scratch = own[lo], 0, body.dtype, tempfile.TemporaryFile()
                        scratch.write(memoryview(body[lo:hi]).cast("B"))
                        rows += hi - lo
            close()
        finally:
            if scratch is not None:
                scratch.close()
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inside = located(self.path)
        fs.create_dir(inside, recursive=True)
        files = [] if self.overwrite else committed(self.path) or []
        first: dict[str, int] = {}
        for f in files:
            first[f["scene_id"]] = max(first.get(f["scene_id"], 0), f["first"] + f["rows"])
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for name, scene, rows in m.files:
                files.append({"name": name, "scene_id": scene, "first": first.get(scene, 0), "rows": rows})
                first[scene] = first.get(scene, 0) + rows
        own = f"{inside}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(json.dumps({"files": files}).encode())
        fs.move(own, f"{inside}/{MANIFEST}")
        kept = {f["name"].split("/")[0] for f in files}
        for info in fs.get_file_info(pafs.FileSelector(inside)):
            if info.type == pafs.FileType.Directory and info.base_name.startswith("set-") and info.base_name not in kept:
                fs.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, inside = located(f"{self.path}/{self.folder}")
        if fs.get_file_info(inside).type == pafs.FileType.Directory:
            fs.delete_dir(inside)


def write_splats(df: DataFrame, path: str, big_endian: bool = False, mode: str = "overwrite") -> None:
    """Write a committed set of splat files; rows of a scene keep their order within a partition. See ``SplatPlyWriter``."""
    df.sparkSession.dataSource.register(SplatPly)
    df.write.format("splat_ply").option("path", path).option("big_endian", str(big_endian).lower()).mode(mode).save()


def write_levels(levels: DataFrame, path: str) -> None:
    """Levels as Parquet with 32-bit floats, a folder per scene, level and unit (or tile, where units are not packed yet), sorted
    along the Z-order curve where there is a rank."""
    floats = {c: F.col(c).cast("float") for c, t in levels.dtypes if t == "double"} | {c: F.col(c).cast("array<float>") for c, t in levels.dtypes if t == "array<double>"}
    keys = ["scene_id", "lod", "unit_no" if "unit_no" in levels.columns else "tile"]
    order = [c for c in ("rank", "record_no") if c in levels.columns][:1]
    levels.withColumns(floats).repartition(*keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).parquet(path)
