"""Array files (.npy) of images as a Python data source.

    arrays.read(spark, path, filters=[("width", "=", 224), ("channels", "in", [1, 3])])
    arrays.read(spark, path, columns=["path", "width", "height"])
    arrays.write(images, path)

A file holds an image, (h, w) or (h, w, c), or a stack of them, (n, h, w, c); with
layout="chw" (c, h, w) or (n, c, h, w).  A row is an image: path, item (its place
in the stack), width, height, channels, dtype, data (little-endian samples,
channels last) and, where the writer stored one, image_id.

Reading: files are cut at byte ranges and dealt into partitions of about PART_BYTES
from a listing alone, so a long stack is read by many tasks and many small files
by one.  Filters on the path drop files before they are planned; those on the
other columns are decided from the header, before any sample is read.  A schema
without data reads headers alone.  Filters are options of a read, not taken from
`where`: in PySpark 4.1 what one query pushes into a Python source stays with the
DataFrame, so a second query over it, or a union of two, would see the first's.

Writing: every task makes stacks of images of one shape, at most STACK_BYTES each,
in a folder of the job's own; they get their places when the job commits, so lost
executors and failed jobs leave nothing.  Ids go to a file beside the stack.
"""

from __future__ import annotations

import ast
import json
import operator
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "image_id long, path string, item int, width int, height int, channels int, dtype string, data binary"
TYPES = {"image_id": pa.int64(), "path": pa.string(), "item": pa.int32(), "width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "dtype": pa.string(), "data": pa.binary()}
#: Bytes of files that a task reads; of rows that leave it at once; of stacks that a task holds, and of the longest stack.
PART_BYTES, OUT_BYTES, HELD_BYTES, STACK_BYTES = 128 << 20, 16 << 20, 128 << 20, 64 << 20
MAGIC = b"\x93NUMPY"

#: What a filter (column, one of these, value) asks; glob is for paths.
ASKS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda v, x: v in x, "not in": lambda v, x: v not in x, "glob": fnmatchcase}
FILTERED = {"path", "item", "width", "height", "channels", "dtype"}


@dataclass(frozen=True)
class Head:
    """What a file's header says; samples begin at byte `at`."""

    shape: tuple[int, ...]
    kind: np.dtype
    fortran: bool
    at: int

    def size(self, layout: str) -> tuple[int, int, int, int]:
        """(images, height, width, channels)."""
        n, image = (self.shape[0], self.shape[1:]) if len(self.shape) == 4 else (1, self.shape)
        if len(image) == 2:
            image = (*image, 1) if layout == "hwc" else (1, *image)
        if len(image) != 3:
            raise ValueError(f"an image has two or three dimensions, a stack of images four: {self.shape}")
        h, w, c = image if layout == "hwc" else (image[1], image[2], image[0])
        if not 1 <= c <= 4:
            raise ValueError(f"an image has one to four channels: {self.shape}")
        return n, h, w, c


def head(source) -> Head:
    """The header of an open file, versions 1 to 3."""
    fixed = source.read(10)
    if fixed[:6] != MAGIC or len(fixed) < 10:
        raise ValueError("not a .npy file")
    if fixed[6] > 1:
        fixed += source.read(2)
    (size,) = struct.unpack("<H" if fixed[6] == 1 else "<I", fixed[8:])
    said = ast.literal_eval(source.read(size).decode("utf-8" if fixed[6] > 2 else "latin1"))
    kind = np.dtype(said["descr"])
    if kind.kind not in "uif":
        raise TypeError(f"samples are numbers: {said['descr']}")
    return Head(tuple(said["shape"]), kind, bool(said["fortran_order"]), len(fixed) + size)


def samples(raw: bytes, shape: tuple[int, ...], h: Head, layout: str) -> bytes:
    """An image's bytes as little-endian samples, channels last."""
    if layout == "hwc" and not h.fortran and (h.kind.itemsize == 1 or h.kind.str[0] == "<"):
        return raw
    a = np.frombuffer(raw, h.kind).reshape(shape, order="F" if h.fortran else "C")
    if layout == "chw" and a.ndim == 3:
        a = a.transpose(1, 2, 0)
    return np.ascontiguousarray(a, h.kind.newbyteorder("<")).tobytes()


@dataclass
class Cut:
    """The images of a file whose samples begin in a range of bytes."""

    path: str
    low: int
    high: int
    ids: bool


@dataclass
class Part(InputPartition):
    cuts: list[Cut]


def filesystem(uri: str):
    """(file system, path in it, what a path in it takes to be a URI)."""
    system, root = fs.FileSystem.from_uri(uri)
    return system, root, "file:" if uri.startswith(("file:", "/")) else uri[: uri.index(root)] if root in uri else ""


def listed(uri: str) -> tuple[list[tuple[str, int, bool]], str]:
    """(path, bytes, whether ids lie beside it) of every array file, by path; a missing folder has none."""
    system, root, scheme = filesystem(uri)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return [], scheme
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    files = {x.path: x.size for x in found if x.type == fs.FileType.File and "/_" not in x.path.removeprefix(root)}
    if info.type == fs.FileType.File:
        beside = system.get_file_info(f"{root}.ids")
        files |= {f"{root}.ids": beside.size} if beside.type == fs.FileType.File else {}
    return [(p, n, f"{p}.ids" in files) for p, n in sorted(files.items()) if p.endswith(".npy")], scheme


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.uri, self.layout, self.dtype = options["path"], options.get("layout", "hwc"), options.get("dtype")
        if self.layout not in ("hwc", "chw"):
            raise ValueError("layout must be hwc or chw")
        self.columns, self.filters = columns, json.loads(options.get("filters", "[]"))
        for column, ask, _ in self.filters:
            if column not in FILTERED or ask not in ASKS:
                raise ValueError(f"no filter on {column} by {ask}")

    def holds(self, **known) -> bool:
        """Whether the filters on what is known hold."""
        return all(ASKS[ask](known[column], value) for column, ask, value in self.filters if column in known)

    def partitions(self) -> list[Part]:
        files, scheme = listed(self.uri)
        parts, room = [], 0
        for path, size, ids in files:
            if not self.holds(path=scheme + path):
                continue
            for low in range(0, max(1, size), PART_BYTES):
                cut = Cut(path, low, min(low + PART_BYTES, max(1, size)), ids)
                if not parts or cut.high - cut.low > room:
                    parts.append(Part([]))
                    room = PART_BYTES
                parts[-1].cuts.append(cut)
                room -= cut.high - cut.low
        return parts

    def read(self, partition: Part):
        if partition is None:
            return
        system, _, scheme = filesystem(self.uri)
        schema = pa.schema([(c, TYPES[c]) for c in self.columns])
        rows, held = [], 0
        for cut in partition.cuts:
            for row in self.rows(system, scheme, cut):
                rows.append(row)
                held += len(row.get("data") or b"")
                if held >= OUT_BYTES or len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def rows(self, system, scheme: str, cut: Cut) -> Iterator[dict]:
        with system.open_input_file(cut.path) as source:
            try:
                h = head(source)
                n, height, width, channels = h.size(self.layout)
            except (ValueError, TypeError, SyntaxError, KeyError) as e:
                raise type(e)(f"{scheme}{cut.path}: {e}") from e
            if self.dtype and h.kind.name != self.dtype:
                raise TypeError(f"{scheme}{cut.path}: samples are {h.kind.name}, not {self.dtype}")
            known = {"path": scheme + cut.path, "width": width, "height": height, "channels": channels, "dtype": h.kind.name}
            if not self.holds(**known):
                return
            each = height * width * channels * h.kind.itemsize
            mixed = h.fortran and len(h.shape) == 4  # samples of a stack's images alternate: its first cut takes all, as it does of images without samples
            if mixed or not each:
                first, last = (0, n if cut.low == 0 else 0)
            else:
                first, last = (min(n, max(0, -(-(x - h.at) // each))) for x in (cut.low, cut.high))
            items = [k for k in range(first, last) if self.holds(item=k)]
            shape = h.shape[1:] if len(h.shape) == 4 else h.shape
            ids = self.ids(system, cut, first, last) if items and "image_id" in self.columns and cut.ids else None
            whole = None
            if mixed and items and "data" in self.columns:
                source.seek(h.at)
                whole = np.frombuffer(source.read(each * n), h.kind).reshape(h.shape, order="F")
            for k in items:
                row = {"item": k, **known, "image_id": int(ids[k - first]) if ids is not None else None}
                if "data" in self.columns:
                    if whole is not None:
                        row["data"] = samples(np.ascontiguousarray(whole[k]).tobytes(), shape, Head(shape, h.kind, False, 0), self.layout)
                    else:
                        source.seek(h.at + k * each)
                        raw = source.read(each)
                        if len(raw) < each:
                            raise ValueError(f"{scheme}{cut.path}: the file ends within image {k}")
                        row["data"] = samples(raw, shape, h, self.layout)
                yield {c: row[c] for c in self.columns}

    def ids(self, system, cut: Cut, first: int, last: int) -> np.ndarray:
        with system.open_input_file(f"{cut.path}.ids") as source:
            source.seek(8 * first)
            return np.frombuffer(source.read(8 * (last - first)), "<i8")


@dataclass
class Stacks(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Stacks:
        system, root, _ = filesystem(self.uri)
        self.names: list[str] = []
        stacks: dict[tuple, tuple[list, list]] = {}
        bytes_of: dict[tuple, int] = {}
        for batch in iterator:
            rows = batch.to_pydict()
            n = batch.num_rows
            for w, h, c, data, kind, k in zip(rows["width"], rows["height"], rows["channels"], rows["data"], rows.get("dtype") or [None] * n, rows.get("image_id") or [None] * n, strict=True):
                key = *self.shaped(w, h, c, data, kind), k is not None
                held = stacks.setdefault(key, ([], []))
                held[0].append(data)
                held[1].append(k)
                bytes_of[key] = bytes_of.get(key, 0) + len(data)
                if bytes_of[key] >= STACK_BYTES or sum(bytes_of.values()) >= HELD_BYTES:
                    most = max(bytes_of, key=bytes_of.get)
                    self.stored(system, root, most, *stacks.pop(most))
                    del bytes_of[most]
        for key, held in stacks.items():
            self.stored(system, root, key, *held)
        return Stacks(self.names)

    @staticmethod
    def shaped(w, h, c, data, kind) -> tuple[int, int, int, str]:
        """(height, width, channels, dtype); without a dtype the length of data tells uint8 from float32."""
        if data is None or None in (w, h, c):
            raise ValueError("an array file can't hold an image that is null")
        kind = kind or ("uint8" if len(data) == w * h * c else "float32")
        if len(data) != w * h * c * np.dtype(kind).itemsize:
            raise ValueError(f"{len(data)} bytes are no {kind} image of {w} x {h} x {c}")
        return h, w, c, kind

    def stored(self, system, root: str, key: tuple, data: list[bytes], ids: list) -> None:
        *shape, kind, known = key
        system.create_dir(f"{root}/_{self.job}", recursive=True)
        name = f"{uuid.uuid4().hex}.npy"
        top = BytesIO()
        np.lib.format.write_array_header_1_0(top, {"descr": np.dtype(kind).newbyteorder("<").str, "fortran_order": False, "shape": (len(data), *shape)})
        with system.open_output_stream(f"{root}/_{self.job}/{name}", compression=None) as out:
            out.write(top.getvalue())
            for x in data:
                out.write(x)
        if known:
            with system.open_output_stream(f"{root}/_{self.job}/{name}.ids", compression=None) as out:
                out.write(np.array(ids, "<i8").tobytes())
        self.names += [f"{name}.ids"] * known + [name]  # ids first: no reader sees a stack before them

    def commit(self, messages) -> None:
        system, root, _ = filesystem(self.uri)
        system.create_dir(root, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.path.endswith((".npy", ".npy.ids"))] if self.overwrite else []
        for path in old:
            system.delete_file(path)
        for name in (x for m in messages if m for x in m.names):
            system.move(f"{root}/_{self.job}/{name}", f"{root}/{name}")
        self.cleared(system, root)

    def abort(self, messages) -> None:
        self.cleared(*filesystem(self.uri)[:2])

    def cleared(self, system, root: str) -> None:
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


class ArrayFiles(DataSource):
    @classmethod
    def name(cls):
        return "arrays"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArrayReader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema, overwrite):
        return ArrayWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, layout: str = "hwc", columns: list[str] | None = None, filters: list[tuple] = (), dtype: str | None = None) -> DataFrame:
    """SCHEMA rows of the array files under path, or those of its columns, for which all filters hold; with dtype, other samples raise."""
    spark.dataSource.register(ArrayFiles)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    options = {"layout": layout, "filters": json.dumps(list(filters))} | ({"dtype": dtype} if dtype else {})
    ArrayReader({"path": path, **options}, [])  # checks them here, not in a task
    return spark.read.format("arrays").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).options(**options).load(path)


def write(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Images (width, height, channels, data and, if there, image_id and dtype) as stacks; other columns aren't kept.  A null image raises."""
    images.sparkSession.dataSource.register(ArrayFiles)
    keep = [c for c in ("image_id", "width", "height", "channels", "dtype", "data") if c in images.columns]
    images.select(*keep).write.format("arrays").mode(mode).save(path)
