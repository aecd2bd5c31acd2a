"""FCS files as a Spark data source: ``spark.read.format("fcs")`` and ``df.write.format("fcs")``.

Rows are file_id, event_idx and a float column a channel. A file's id is its path below the folder that is read, without
the suffix, so that equal names in two folders stay apart. Rows have a fixed width on disk, so a large file splits into
partitions by ranges of events, and a partition reads only its bytes; small files share a partition. The session lists
paths and opens one file (for the channels); all other headers are read in tasks. Paths may be any that this Python can
open; on a store only Spark reads, ``events_from_binary`` decodes ``binaryFile`` rows instead, a file a row.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import FloatType, LongType, StringType, StructField, StructType

from ..errors import FormatError
from ..session import ship
from . import keywords as K

HEADER = 58
#: Bytes of events in a partition.
SPLIT = 64 << 20
_ORDERS = {"1,2,3,4": "<", "4,3,2,1": ">", "1,2": "<", "2,1": ">"}


@dataclass
class Layout:
    """Where a file's events are and how a row is stored."""

    version: str
    keywords: dict[str, str]
    names: list[str]
    row: np.dtype
    start: int
    events: int


def files(path: str) -> list[str]:
    """The file itself, or all .fcs files below a folder in any case."""
    p = Path(path.removeprefix("file://") if not path.startswith("file:///") else path[7:])
    if p.is_dir():
        return sorted(str(f) for f in p.rglob("*") if f.is_file() and f.suffix.lower() == ".fcs")
    if p.suffix.lower() != ".fcs":
        raise FormatError(f"not an .fcs file: {path}")
    return [str(p)]


def file_ids(path: str) -> list[tuple[str, str]]:
    """(path, file_id) of the file, or of all files below a folder."""
    found = files(path)
    root = found[0] if found and not Path(path.removeprefix("file://")).is_dir() else path.removeprefix("file://")
    return [(f, identity(f, root)) for f in found]


def identity(path: str, root: str | None) -> str:
    """The path below root without its suffix; of the root itself its name; the whole path where no root is given."""
    p = PurePosixPath(path.split("://", 1)[-1].removeprefix("file:"))
    if root is None:
        return str(p.with_suffix(""))
    r = PurePosixPath(root.split("://", 1)[-1].removeprefix("file:"))
    return p.stem if p == r else str(p.relative_to(r).with_suffix(""))


def header(b: bytes) -> tuple[str, list[int]]:
    """Version and the six offsets."""
    if len(b) < HEADER:
        raise FormatError("shorter than a header")
    version = b[:6].decode("latin-1")
    if version not in K.REQUIRED:
        raise FormatError(f"unknown version {version!r}")
    if b[6:10] != b"    ":
        raise FormatError("no four spaces after the version")
    try:
        return version, [int(b[i : i + 8].decode().strip() or 0) for i in range(10, HEADER, 8)]
    except ValueError as e:
        raise FormatError(f"offsets are not numbers: {e}") from e


def row_type(kw: dict[str, str]) -> np.dtype:
    order = _ORDERS.get(kw["$BYTEORD"].replace(" ", ""))
    if order is None:
        raise FormatError(f"byte order {kw['$BYTEORD']!r}")
    fields = []
    for i in range(1, int(kw["$PAR"]) + 1):
        code = kw.get(f"$P{i}DATATYPE", kw["$DATATYPE"]).strip().upper()
        width = -(-int(kw.get(f"$P{i}B", "32")) // 8)
        kind = {("I", 2): "u2", ("I", 4): "u4", ("F", 4): "f4", ("D", 8): "f8"}.get((code, width))
        if kind is None:
            raise FormatError(f"parameter {i}: type {code} of {width} bytes")
        fields.append((f"p{i}", order + kind))
    return np.dtype(fields)


def layout(read, size: int) -> Layout:
    """read(start, length) gives bytes."""
    version, at = header(read(0, HEADER))
    kw = K.tokenize(read(at[0], at[1] - at[0] + 1).decode("utf-8", "replace"))
    if lacking := K.missing(version, kw):
        raise FormatError(f"missing keywords: {lacking}")
    start, end = at[2], at[3]
    if not start:
        start, end = int(kw["$BEGINDATA"]), int(kw["$ENDDATA"])
    row, events = row_type(kw), int(kw.get("$TOT") or 0)
    if not 0 < start <= end + 1 <= size or (end - start + 1) < events * row.itemsize:
        raise FormatError(f"{events} events of {row.itemsize} bytes do not fit {start}..{end} of {size}")
    return Layout(version, kw, [p["name"] for p in K.parameters(kw)], row, start, events)


def open_layout(path: str) -> Layout:
    with open(path, "rb") as f:
        return layout(lambda s, n: (f.seek(s), f.read(n))[1], os.path.getsize(path))


def decode(raw: bytes, row: np.dtype) -> list[np.ndarray]:
    """Float32 columns of whole rows."""
    kinds = {row[i] for i in range(len(row.names))}
    if len(kinds) == 1:
        return list(np.frombuffer(raw, next(iter(kinds))).reshape(-1, len(row.names)).T.astype(np.float32))
    x = np.frombuffer(raw, row)
    return [x[n].astype(np.float32) for n in row.names]


def schema(names: list[str]) -> StructType:
    return StructType([StructField("file_id", StringType()), StructField("event_idx", LongType()), *(StructField(n, FloatType()) for n in names)])


@dataclass
class Part(InputPartition):
    """Whole files (path, file_id), or one piece of a large one."""

    files: list[tuple[str, str]]
    piece: int = 0
    pieces: int = 1


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        out, small, held = [], [], 0
        for f, ident in file_ids(self.path):
            size = os.path.getsize(f)
            if size > SPLIT:
                pieces = -(-size // SPLIT)
                out += [Part([(f, ident)], k, pieces) for k in range(pieces)]
                continue
            if small and held + size > SPLIT:
                out.append(Part(small))
                small, held = [], 0
            small, held = [*small, (f, ident)], held + size
        return out + ([Part(small)] if small else [])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for path, ident in part.files:
            at = open_layout(path)
            if at.names != self.names:
                raise FormatError(f"{path} has other channels: {at.names}")
            first, last = (at.events * k // part.pieces for k in (part.piece, part.piece + 1))
            step = max(1, (4 << 20) // at.row.itemsize)
            with open(path, "rb") as f:
                for k in range(first, last, step):
                    n = min(step, last - k)
                    f.seek(at.start + k * at.row.itemsize)
                    cols = decode(f.read(n * at.row.itemsize), at.row)
                    yield pa.record_batch([pa.array([ident] * n), pa.array(np.arange(k, k + n)), *map(pa.array, cols)], names=["file_id", "event_idx", *at.names])


def encode(names: list[str], columns: list[np.ndarray], extra: dict[str, str] | None = None, version: str = "FCS3.1", order: str = "<") -> bytes:
    """A whole file: header, TEXT, float32 DATA in the byte order (little-endian by default)."""
    n = len(columns[0]) if columns else 0
    if not n:
        raise FormatError("a file needs events and parameters")
    kw = {k: v for k, v in (extra or {}).items() if not k.startswith("$P") or not k[2:3].isdigit()}
    kw |= {"$BYTEORD": "1,2,3,4" if order == "<" else "4,3,2,1", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(len(names)), "$TOT": str(n)}
    kw |= {k: "0" for k in ("$BEGINANALYSIS", "$ENDANALYSIS", "$BEGINSTEXT", "$ENDSTEXT")}
    for i, name in enumerate(names, 1):
        own = {k: v for k, v in (extra or {}).items() if k.startswith(f"$P{i}") and not k[len(f"$P{i}") :][:1].isdigit()}
        kw |= {f"$P{i}R": "262144", f"$P{i}E": "0,0"} | own | {f"$P{i}N": name, f"$P{i}B": "32"}
    data = np.stack(columns, 1).astype(order + "f4").tobytes()
    mark = "|"
    body = lambda a, b: mark + "".join(f"{k}{mark}{str(v).replace(mark, mark * 2)}{mark}" for k, v in [("$BEGINDATA", f"{a:>10}"), ("$ENDDATA", f"{b:>10}"), *sorted((k, v) for k, v in kw.items() if k not in ("$BEGINDATA", "$ENDDATA"))])
    size = len(body(0, 0).encode())
    start = HEADER + size
    text = body(start, start + len(data) - 1).encode()
    fits = start + len(data) - 1 < 10**8
    offsets = [HEADER, HEADER + size - 1, start if fits else 0, start + len(data) - 1 if fits else 0, 0, 0]
    return f"{version}    ".encode() + b"".join(f"{o:>8}".encode() for o in offsets) + text + data


class Writer(DataSourceArrowWriter):
    """One file a file_id; write after ``by_file`` so that each file's events are in one task, in order.

    Tasks write under a folder of their own; files take their names when all tasks are over, so a failed or repeated task
    leaves nothing.
    """

    def __init__(self, path: str, names: list[str]):
        self.root, self.names = Path(path.removeprefix("file://")), names
        self.tmp = self.root / f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches) -> WriterCommitMessage:
        done: list[tuple[str, str]] = []
        current, held = None, []
        place = self.tmp / uuid.uuid4().hex

        def flush():
            if not held:
                return
            t = pa.Table.from_batches(held)
            t = t.take(pa.compute.sort_indices(t, [("event_idx", "ascending")]))
            place.mkdir(parents=True, exist_ok=True)
            part = place / f"{len(done)}.fcs"
            part.write_bytes(encode(self.names, [t.column(n).to_numpy().astype(np.float32) for n in self.names]))
            done.append((str(part), current))

        for b in batches:
            ids = b.column(b.schema.names.index("file_id"))
            runs = pa.compute.run_end_encode(ids)
            at = 0
            for end, ident in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if ident != current:
                    flush()
                    current, held = ident, []
                held.append(b.slice(at, end - at))
                at = end
        flush()
        return Written(done)

    def commit(self, messages) -> None:
        done = [x for m in messages if m is not None for x in m.files]
        names = [ident for _, ident in done]
        if twice := {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else None:
            self.abort(messages)
            raise FormatError(f"events of a file in several tasks (write by_file): {sorted(twice)[:5]}")
        for part, ident in done:
            p = PurePosixPath(ident)
            if p.is_absolute() or ".." in p.parts:
                raise FormatError(f"a file_id that leaves the folder: {ident}")
            to = self.root / f"{ident}.fcs"
            to.parent.mkdir(parents=True, exist_ok=True)
            os.replace(part, to)
        shutil.rmtree(self.tmp, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.tmp, ignore_errors=True)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FcsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs"

    def _names(self) -> list[str]:
        found = files(self.options["path"])
        if not found:
            raise FormatError(f"no .fcs files below {self.options['path']}")
        return open_layout(found[0]).names

    def schema(self) -> StructType:
        return schema(self._names())

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._names())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], [f.name for f in schema.fields if f.name not in ("file_id", "event_idx")])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FcsSource)


def by_file(df: DataFrame) -> DataFrame:
    """Rows dealt so that each file is whole and in order in one task."""
    return df.repartition("file_id").sortWithinPartitions("file_id", "event_idx")


def events_from_binary(binary: DataFrame, names: list[str], root: str | None = None) -> DataFrame:
    """Events of ``spark.read.format("binaryFile")`` rows (path, content); ids are paths below root, whole paths without it."""
    ship(binary.sparkSession)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = layout(lambda s, n, c=content: c[s : s + n], len(content))
                if at.names != names:
                    raise FormatError(f"{path} has other channels: {at.names}")
                cols = decode(content[at.start : at.start + at.events * at.row.itemsize], at.row)
                yield pa.record_batch([pa.array([identity(path, root)] * at.events), pa.array(np.arange(at.events)), *map(pa.array, cols)], names=["file_id", "event_idx", *names])

    return binary.select("path", "content").mapInArrow(run, schema(names))


def catalogue(spark: SparkSession, path: str, a_task: int = 64) -> tuple[DataFrame, DataFrame]:
    """(keywords, parameters) tables of all files; headers and TEXT segments are read in tasks, ``a_task`` files each."""
    ship(spark)
    found = file_ids(path)
    paths = spark.createDataFrame(found, "path string, file_id string").repartition(max(1, -(-len(found) // a_task)))

    def rows(of, kind: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for f, ident in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got = of(ident, open_layout(f))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)

        names, types = zip(*((n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split() for x in kind.split(", "))), strict=True)
        return paths.mapInArrow(run, kind)

    kw = lambda ident, at: [(ident, k, K.typed(k, v)[0], v) for k, v in sorted(at.keywords.items())]
    par = lambda ident, at: [(ident, p["number"], p["name"], p["label"], p["transform"], p["range"], p["wavelength"]) for p in K.parameters(at.keywords)]
    return rows(kw, "file_id string, key string, kind string, value string"), rows(par, "file_id string, number int, name string, label string, transform string, range double, wavelength int")


def copy(path: str, out: str) -> None:
    """The file as it is, byte by byte; it must be a readable one."""
    open_layout(path)
    shutil.copyfile(path, out)


def add_column(path: str, out: str, name: str, values: np.ndarray, label: str | None = None) -> None:
    """A new file with one more parameter: its values, $PAR and $Pn keywords."""
    at = open_layout(path)
    if len(values) != at.events:
        raise FormatError(f"{len(values)} values for {at.events} events")
    with open(path, "rb") as f:
        f.seek(at.start)
        cols = decode(f.read(at.events * at.row.itemsize), at.row)
    kw = K.with_parameter(at.keywords, name, label)
    Path(out).write_bytes(encode([*at.names, name], [*cols, np.asarray(values, np.float32)], kw, at.version))


def edit_keywords(path: str, change, out: str | None = None) -> None:
    """Rewrite a file with changed keywords; counts and offsets are made anew."""
    at = open_layout(path)
    with open(path, "rb") as f:
        f.seek(at.start)
        cols = decode(f.read(at.events * at.row.itemsize), at.row)
    Path(out or path).write_bytes(encode(at.names, cols, change(dict(at.keywords)), at.version))


__all__ = ["FcsSource", "add_column", "by_file", "catalogue", "copy", "decode", "edit_keywords", "encode", "events_from_binary", "file_ids", "files", "header", "layout", "open_layout", "register", "schema"]
