"""Images with boxes, keypoints and masks, each row through one program.

A row holds an image (PACKED), and, in columns of its own, boxes and keypoints
as arrays of arrays of numbers (extra numbers ride along) and masks of the
image's size as bytes.  The row's program is sampled by (seed, key) or read from
a column of JSON texts; the image, its masks and its labels all follow it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import tables as T
from ..plans.pipeline import Compose
from ..plans.program import MOVES, Op, Program, size_after, square, window
from . import kernels
from .labels import KNOWN_BOXES, KNOWN_POINTS, known_format
from .packed import image, planned, small_arrow_batches


def read_boxes(rows: np.ndarray, fmt: str, w: int, h: int) -> np.ndarray:
    """Rows in a format -> x, y, width, height in pixels, and the extra numbers."""
    fmt, rel = known_format(fmt, KNOWN_BOXES)
    out = rows.copy()
    if rel:
        out[:, :4] *= (w, h, w, h)
    if fmt == "xyxy":
        out[:, 2:4] -= out[:, :2]
    elif fmt == "cxcywh":
        out[:, :2] -= out[:, 2:4] / 2
    return out


def write_boxes(rows: np.ndarray, fmt: str, w: int, h: int) -> np.ndarray:
    fmt, rel = known_format(fmt, KNOWN_BOXES)
    out = rows.copy()
    if fmt == "xyxy":
        out[:, 2:4] += out[:, :2]
    elif fmt == "cxcywh":
        out[:, :2] += out[:, 2:4] / 2
    if rel:
        out[:, :4] /= (w, h, w, h)
    return out


def _forward(op: Op, w: int, h: int, off: float):
    """The forward map of points, the inverse of the image's source map; off is half a pixel for points at pixel edges."""
    a, b, _, d, e, _ = T.inverse_affine(1, 1, op["scale"], op["rotate"], op["translate"], op["shear"])
    shift = np.array((op["translate"],) * 2 if np.isscalar(op["translate"]) else op["translate"], float)
    centre, m = np.array([w / 2 - off, h / 2 - off]), np.linalg.inv(np.array([[a, b], [d, e]]))
    return lambda points: (points - centre) @ m.T + centre + shift


def move_boxes(rows: np.ndarray, op: Op, w: int, h: int) -> np.ndarray:
    """Boxes (x, y, width, height, more) after one operation on an image of w x h; what nothing is left of goes."""
    if op.name not in MOVES or not len(rows):
        return rows
    out = rows.copy()
    if e := square(op):
        swap, fx, fy = T.SQUARE[e]
        if swap:
            out[:, :4], w, h = rows[:, [1, 0, 3, 2]], h, w
        if fx:
            out[:, 0] = w - (out[:, 0] + out[:, 2])
        if fy:
            out[:, 1] = h - (out[:, 1] + out[:, 3])
        return out
    if op.name == "pad":
        out[:, :2] += (op["left"], op["top"])
        return out
    if op.name == "resize":
        out[:, :4] *= (op["width"] / w, op["height"] / h) * 2
        return out
    if op.name == "affine":
        ends = np.stack([rows[:, :2], rows[:, :2] + rows[:, 2:4]])
        corners = np.stack([_forward(op, w, h, 0.0)(np.stack([ends[i, :, 0], ends[j, :, 1]], axis=1)) for i in (0, 1) for j in (0, 1)])
        low, high = np.maximum(corners.min(axis=0), 0), np.minimum(corners.max(axis=0), (w, h))
    else:
        x, y, w, h = window(op, w, h)
        low = np.maximum(rows[:, :2] - (x, y), 0)
        high = np.minimum(rows[:, :2] + rows[:, 2:4] - (x, y), (w, h))
    out[:, :2], out[:, 2:4] = low, high - low
    return out[(high > low).all(axis=1)]


def move_points(rows: np.ndarray, op: Op, w: int, h: int) -> np.ndarray:
    """Points (x, y, more) after one operation; points outside a window or off an affine image go."""
    if op.name not in MOVES or not len(rows):
        return rows
    out = rows.copy()
    if e := square(op):
        swap, fx, fy = T.SQUARE[e]
        if swap:
            out[:, :2], w, h = rows[:, [1, 0]], h, w
        if fx:
            out[:, 0] = w - out[:, 0]
        if fy:
            out[:, 1] = h - out[:, 1]
        return out
    if op.name == "pad":
        out[:, :2] += (op["left"], op["top"])
        return out
    if op.name == "resize":
        out[:, :2] *= (op["width"] / w, op["height"] / h)
        return out
    if op.name == "affine":
        out[:, :2] = _forward(op, w, h, 0.5)(rows[:, :2])
    else:
        x, y, w, h = window(op, w, h)
        out[:, :2] -= (x, y)
    return out[((out[:, :2] >= 0) & (out[:, :2] < (w, h))).all(axis=1)]


def through(program: Program, w: int, h: int, boxes: np.ndarray | None, points: np.ndarray | None):
    """(boxes, points, width, height) after the program as it was sampled."""
    for op in program:
        if boxes is not None:
            boxes = move_boxes(boxes, op, w, h)
        if points is not None:
            points = move_points(points, op, w, h)
        w, h = size_after(op, w, h)
    return boxes, points, w, h


def annotated(
    images: DataFrame, pipeline: Compose | Program | None, seed: int = 0, key: str = "image_id", boxes: str | None = None, points: str | None = None, masks: tuple[str, ...] | str = (), labels: str | None = None,
    bbox_format: str | None = None, keypoint_format: str | None = None, program: str | None = None, optimize: bool = True,
) -> DataFrame:
    """images with image, boxes, points and masks after each row's program; all other columns as they are.

    Formats are the pipeline's where none are given.  With `program`, that
    column's JSON texts are replayed instead of sampling.  labels name a column
    of class labels of whole images, which no program changes; labels of boxes
    are the boxes' extra numbers, so both together are an error.  Null targets
    stay null; of a null image its targets stay as they are.
    """
    if boxes and labels:
        raise TypeError("labels of boxes ride as extra numbers of each box; a labels column is for images without boxes")
    if (pipeline is None) == (program is None):
        raise TypeError("give a pipeline or a column of programs")
    small_arrow_batches(images.sparkSession)
    masks = (masks,) if isinstance(masks, str) else tuple(masks)
    box_format = bbox_format or getattr(pipeline, "bbox_format", "xywh")
    point_format = keypoint_format or getattr(pipeline, "keypoint_format", "xy")
    known_format(box_format, KNOWN_BOXES)
    _, rel_points = known_format(point_format, KNOWN_POINTS)
    columns, schema = images.columns, images.schema
    new = ["width", "height", "channels", "data", *(c for c in (boxes, points) if c), *masks]

    def numbers(value, least: int) -> np.ndarray | None:
        return None if value is None else np.array(value, float).reshape(len(value), -1) if value else np.zeros((0, least))

    def masked(data, w: int, h: int, moves: Program):
        if data is None or isinstance(data, list):
            return data and [masked(x, w, h, moves) for x in data]
        return np.ascontiguousarray(kernels.run(image(data, w, h, len(data) // max(1, w * h)), moves)).tobytes()

    def one(row: dict) -> dict:
        if row["data"] is None:
            return row
        w, h = row["width"], row["height"]
        sampled = Program.from_json(row[program]) if program else pipeline if isinstance(pipeline, Program) else pipeline.program(seed, row[key])
        sampled.validate(w, h)
        out = kernels.run(image(row["data"], w, h, row["channels"]), planned(sampled, optimize, row["channels"]))
        b = numbers(row[boxes], 4) if boxes else None
        p = numbers(row[points], 2) if points else None
        scale = np.array([w, h], float)
        if p is not None and rel_points:
            p[:, :2] *= scale
        b, p, nw, nh = through(sampled, w, h, None if b is None else read_boxes(b, box_format, w, h), p)
        if p is not None and rel_points:
            p[:, :2] /= (nw, nh)
        row |= {"width": out.shape[1], "height": out.shape[0], "channels": out.shape[2], "data": np.ascontiguousarray(out).tobytes()}
        if b is not None:
            row[boxes] = write_boxes(b, box_format, nw, nh).tolist()
        if p is not None:
            row[points] = p.tolist()
        moves = sampled.moves()
        return row | {m: masked(row[m], w, h, moves) for m in masks}

    def run(batches):
        used = [*dict.fromkeys([*new, key, *([program] if program else [])])]
        for b in batches:
            at = {c: columns.index(c) for c in used}
            rows = [one(dict(zip(used, values, strict=True))) for values in zip(*(b.column(at[c]).to_pylist() for c in used), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], b.schema.field(k).type) if c in new else b.column(k) for k, c in enumerate(columns)], names=columns)

    return images.mapInArrow(run, schema)
