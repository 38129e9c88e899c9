"""Pipelines over packed images: one Arrow pass, planned once where the pipeline is fixed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..plans.pipeline import Compose
from ..plans.planner import plan
from ..plans.program import Program
from ..schema import PACKED
from . import grouped, kernels, tiling


def image(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def small_arrow_batches(spark) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 256:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)  # images are large rows


def planned(program: Program, optimize: bool, channels: int, moves: bool = False) -> list:
    return plan(program.moves() if moves else program, optimize, channels).stages


@lru_cache(256)
def _parsed(text: str) -> Program:
    return Program.from_json(text)


@lru_cache(256)
def _prepared(text: str, optimize: bool, channels: int, moves: bool):
    """A fixed program's stages, tables built."""
    return [kernels.prepared(op) for op in planned(Program.from_json(text), optimize, channels, moves)]


def _samples(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each row's end) of a binary column without nulls, as views."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.binary()), np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows (n, ...), as a view."""
    n = len(rows)
    rows = np.ascontiguousarray(rows)
    each = rows.nbytes // max(1, n)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * each, each, dtype=np.int32) if each else np.zeros(n + 1, np.int32)), pa.py_buffer(rows.reshape(-1).view(np.uint8))])


def _ragged(rows: list[np.ndarray | None]) -> pa.Array:
    """A binary column of rows of any sizes, copied once; None is null."""
    sizes = np.array([0 if x is None else x.nbytes for x in rows], np.int64)
    if sizes.sum() >= 1 << 31:
        raise ValueError("images of a batch take 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.empty(ends[-1], np.uint8)
    for k, x in enumerate(rows):
        if x is not None:
            data[ends[k] : ends[k + 1]].view(x.dtype).reshape(x.shape)[...] = x
    made = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    lost = np.array([x is None for x in rows], bool)
    return pc.if_else(pa.array(~lost), made, pa.scalar(None, pa.binary())) if lost.any() else made


#: Bytes of a batch that is worked on at once.
AT_ONCE = 64 << 20


def _step(column: pa.Array) -> int:
    """How many rows of a binary column are worked on at once."""
    return max(1, AT_ONCE * len(column) // max(1, column.nbytes))


def transform(images: DataFrame, pipeline: Compose | Program, seed: int = 0, key: str = "image_id", optimize: bool = True, floats: bool = False, masks: bool = False) -> DataFrame:
    """images (PACKED and any other columns) after the pipeline, other columns untouched.

    Every row samples its own program by (seed, key); rows with an equal key,
    such as the frames of a clip, go through the same one.  With masks only what
    moves pixels applies.  With floats the last operation may be normalize and
    data holds little-endian float32.  Null data stays null.  A fixed program is
    planned once, and images of equal size go through it together, as views of
    the Arrow buffers.  Sampled programs of one sequence of operations share its
    plan, with their parameters as arrays (operators.grouped).
    """
    small_arrow_batches(images.sparkSession)
    columns, kinds = images.columns, images.schema
    at = {c: columns.index(c) for c in ("width", "height", "channels", "data", key)}
    fixed = isinstance(pipeline, Program) or pipeline.fixed()
    once = (pipeline if isinstance(pipeline, Program) else pipeline.program(seed)).to_json() if fixed else None
    types = {"width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "data": pa.binary()}

    def checked(out: np.ndarray) -> np.ndarray:
        if out.dtype != np.uint8 and not floats:
            raise ValueError("normalize makes float32: ask for floats=True")
        return out

    def alike(b):
        """The images as one array, if all have one size and none is null."""
        if not once or not b.num_rows or any(b.column(at[n]).null_count for n in types):
            return None
        w, h, c = (b.column(at[n]).to_numpy() for n in ("width", "height", "channels"))
        if (w != w[0]).any() or (h != h[0]).any() or (c != c[0]).any() or not int(w[0]) * int(h[0]) * int(c[0]):
            return None
        data, ends = _samples(b.column(at["data"]))
        return data[ends[0] : ends[-1]].reshape(len(w), int(h[0]), int(w[0]), int(c[0]))

    def drawn(b):
        """A batch whose rows sample their programs."""
        sizes = [b.column(at[n]).to_pylist() for n in ("width", "height", "channels")]
        data, ends = _samples(b.column(at["data"]))
        rows = [image(data[ends[k] : ends[k + 1]], w, h, c) if d else None for k, (w, h, c, d) in enumerate(zip(*sizes, b.column(at["data"]).is_valid().to_pylist(), strict=True))]
        programs, of = {}, b.column(at[key]).to_pylist()
        for k in of:
            if k not in programs:
                programs[k] = pipeline.program(seed, k)
        done = grouped.through(rows, [programs[k] for k in of], optimize, masks)
        for x in done:
            if x is not None:
                checked(x)
        new = {n: pa.array([old if x is None else x.shape[k] for x, old in zip(done, sizes[j], strict=True)], pa.int32()) for j, (n, k) in enumerate((("width", 1), ("height", 0), ("channels", 2)))}
        new["data"] = _ragged(done)
        return pa.RecordBatch.from_arrays([new[n] if n in new else b.column(k) for k, n in enumerate(columns)], names=columns)

    def run(batches):
        for b in batches:
            if not once:
                step = _step(b.column(at["data"]))
                for lo in range(0, b.num_rows, step):
                    yield drawn(b.slice(lo, step))
                continue
            whole = alike(b)
            step = max(1, AT_ONCE // max(1, whole[0].size)) if whole is not None else 0
            for lo in range(0, b.num_rows, step) if step else ():
                part = whole[lo : lo + step]
                _parsed(once).validate(part.shape[2], part.shape[1])
                out = checked(kernels.run_batch(part, _prepared(once, optimize, part.shape[3], masks)))
                size = {n: pa.array(np.full(len(out), v, np.int32)) for n, v in zip(("height", "width", "channels"), out.shape[1:], strict=True)}
                new = size | {"data": _binary(out)}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(k).slice(lo, step) for k, n in enumerate(columns)], names=columns)
            if step:
                continue
            rows = []
            for w, h, c, data in zip(*(b.column(at[n]).to_pylist() for n in ("width", "height", "channels", "data")), strict=True):
                if data is None:
                    rows.append((w, h, c, None))
                    continue
                _parsed(once).validate(w, h)
                stages = _prepared(once, optimize, c, masks)
                out = image(data, w, h, c)
                for f, _ in stages:
                    out = f(out)
                rows.append((out.shape[1], out.shape[0], out.shape[2], np.ascontiguousarray(checked(out)).tobytes()))
            new = dict(zip(types, zip(*rows, strict=True) if rows else [()] * 4, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[n], types[n]) if n in new else b.column(k) for k, n in enumerate(columns)], names=columns)

    return images.mapInArrow(run, kinds)


def transform_video(frames: DataFrame, pipeline: Compose | Program, seed: int = 0, clip: str = "clip_id", **more) -> DataFrame:
    """Frames with one program a clip."""
    return transform(frames, pipeline, seed, key=clip, **more)


def programs(images: DataFrame, pipeline: Compose, seed: int = 0, key: str = "image_id") -> DataFrame:
    """(key, program): the JSON text of every row's sampled program."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            text = [pipeline.program(seed, k).to_json() for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[key, "program"])

    return images.select(key).mapInArrow(run, f"`{key}` {kind}, program string")


def replay(images: DataFrame, key: str = "image_id") -> DataFrame:
    """images with a program column (JSON) after that program."""
    small_arrow_batches(images.sparkSession)
    columns = [c for c in images.columns if c != "program"]

    def run(batches):
        for b in batches:
            at = {c: k for k, c in enumerate(b.schema.names)}
            step = _step(b.column(at["data"]))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                w, h, c, data, text = (part.column(at[n]).to_pylist() for n in ("width", "height", "channels", "data", "program"))
                done = grouped.through([None if d is None else image(d, *s) for d, *s in zip(data, w, h, c, strict=True)], [_parsed(t) for t in text])
                new = {n: pa.array([old if x is None else x.shape[k] for x, old in zip(done, olds, strict=True)], pa.int32()) for n, k, olds in (("width", 1, w), ("height", 0, h), ("channels", 2, c))}
                new["data"] = _ragged(done)
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(at[n])) for n in columns], names=columns)

    return images.mapInArrow(run, images.select(columns).schema)


def any_res(images: DataFrame, tile_size: int = 448, max_tiles: int = 6, include_thumbnail: bool = True, interpolation: str = "bilinear") -> DataFrame:
    """(image_id, tile, width, height, channels, data): tiles in reading order, the thumbnail last."""
    small_arrow_batches(images.sparkSession)

    def run(batches):
        for b in batches:
            for i, w, h, c, data in zip(*(b.column(n).to_pylist() for n in ("image_id", "width", "height", "channels", "data")), strict=True):
                tiles = tiling.tiles(image(data, w, h, c), tile_size, max_tiles, include_thumbnail, interpolation)
                n = len(tiles)
                arrays = [pa.array([i] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array([v] * n, pa.int32()) for v in (tile_size, tile_size, c)), pa.array([t.tobytes() for t in tiles], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "tile", "width", "height", "channels", "data"])

    return images.mapInArrow(run, PACKED.replace("image_id long", "image_id long, tile int"))
