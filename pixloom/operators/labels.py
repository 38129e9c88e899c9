"""Boxes, keypoints and masks that follow the images' operations.

Labels are flat tables: (image_id, w, h, x, y, bw, bh, ...) for boxes, with x and y
the upper left corner in pixels, and (image_id, w, h, x, y, v, ...) for keypoints.
w and h are the image's size at that point of the program.  Every operation is a
projection and at most a filter; further columns ride along with their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..plans.program import MOVES, Op, Program, square
from .catalyst import inverse, number

#: Other names of formats.
ALIASES = {"pascal_voc": "xyxy", "coco": "xywh", "center_xywh": "cxcywh", "albumentations": "rel_xyxy", "yolo": "rel_cxcywh", "xy_visibility": "xyv", "normalized_xy": "rel_xy"}
#: Four numbers a, b, c, d of a format as x, y, width, height; and back.
READ = {"xywh": ("a", "b", "c", "d"), "xyxy": ("a", "b", "c - a", "d - b"), "cxcywh": ("a - c / 2", "b - d / 2", "c", "d")}
WRITE = {"xywh": ("x", "y", "bw", "bh"), "xyxy": ("x", "y", "x + bw", "y + bh"), "cxcywh": ("x + bw / 2", "y + bh / 2", "bw", "bh")}


KNOWN_BOXES, KNOWN_POINTS = frozenset(READ), frozenset(["xy", "xyv"])


def known_format(name: str, known) -> tuple[str, bool]:
    name = ALIASES.get(name, name)
    rel = name.startswith("rel_")
    if name.removeprefix("rel_") not in known:
        raise ValueError(f"unknown format {name}")
    return name.removeprefix("rel_"), rel


def read_boxes(df: DataFrame, fmt: str = "xywh", columns=("a", "b", "c", "d")) -> DataFrame:
    """Four columns in a format -> x, y, bw, bh in pixels; relative formats are shares of w and h."""
    fmt, rel = known_format(fmt, KNOWN_BOXES)
    four = dict(zip("abcd", (f"({c} * {n})" if rel else c for c, n in zip(columns, ("w", "h", "w", "h"), strict=True)), strict=True))
    sql = ["".join(four.get(ch, ch) for ch in e) for e in READ[fmt]]
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in columns], *(f"cast({e} as double) as {n}" for e, n in zip(sql, ("x", "y", "bw", "bh"), strict=True)))


def write_boxes(df: DataFrame, fmt: str = "xywh", columns=("a", "b", "c", "d")) -> DataFrame:
    """x, y, bw, bh -> four columns in a format; relative formats use the final size."""
    fmt, rel = known_format(fmt, KNOWN_BOXES)
    rest = [f"`{c}`" for c in df.columns if c not in ("x", "y", "bw", "bh")]
    return df.selectExpr(*rest, *(f"({e}){f' / {n}' if rel else ''} as {c}" for e, n, c in zip(WRITE[fmt], ("w", "h", "w", "h"), columns, strict=True)))


def read_points(df: DataFrame, fmt: str = "xy", columns=("a", "b")) -> DataFrame:
    """Columns in a format -> x, y in pixels, and v: 2 (visible) where the format has none."""
    fmt, rel = known_format(fmt, KNOWN_POINTS)
    a, b = (f"{c} * {n}" if rel else c for c, n in zip(columns, ("w", "h"), strict=False))
    v = columns[2] if fmt == "xyv" else "2"
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in columns], f"cast({a} as double) as x", f"cast({b} as double) as y", f"cast({v} as int) as v")


def write_points(df: DataFrame, fmt: str = "xy", columns=("a", "b")) -> DataFrame:
    fmt, rel = known_format(fmt, KNOWN_POINTS)
    rest = [f"`{c}`" for c in df.columns if c not in ("x", "y", "v")]
    a, b = ("x / w", "y / h") if rel else ("x", "y")
    return df.selectExpr(*rest, f"{a} as {columns[0]}", f"{b} as {columns[1]}", *([f"v as {columns[2]}"] if fmt == "xyv" else []))


def _set(df: DataFrame, on: str | None, **new: str) -> DataFrame:
    """New values from the old ones, all at once, in rows where `on` holds (in all, for None)."""
    value = lambda c: f"if({on}, {new[c]}, {c})" if on else new[c]
    return df.selectExpr(*(f"cast({value(c)} as {df.schema[c].dataType.simpleString()}) as {c}" if c in new else f"`{c}`" for c in df.columns))


def _left(df: DataFrame, on: str | None, rule: str) -> DataFrame:
    """Rows that meet the rule, and those where `on` doesn't hold."""
    return df.where(f"not ({on}) or ({rule})" if on else rule)


def _affine(op: Op):
    """SQL of the forward map of a point, the inverse of the image's source map, about the centre of pixels."""
    (a, b, d, e), (tx, ty) = inverse(op["scale"], op["rotate"], op["translate"], op["shear"])
    det = f"({a} * {e} - {b} * {d})"
    # pixel centres lie at whole coordinates for images, edges of boxes half a pixel before
    return lambda x, y, off=0.0: (
        f"(({e} / {det}) * ({x} - w / 2 + {off}) + (-({b}) / {det}) * ({y} - h / 2 + {off}) + w / 2 - {off} + {tx})",
        f"((-({d}) / {det}) * ({x} - w / 2 + {off}) + ({a} / {det}) * ({y} - h / 2 + {off}) + h / 2 - {off} + {ty})",
    )


def _window(op: Op) -> tuple[str, str]:
    if op.name == "crop":
        return str(op["x"]), str(op["y"])
    return tuple(f"least(cast({number(op[f])} * ({n} - {op[m]} + 1) as int), {n} - {op[m]})" for f, n, m in (("fx", "w", "width"), ("fy", "h", "height")))


def move_boxes(df: DataFrame, op: Op, on: str | None = None) -> DataFrame:
    """Boxes after one operation (of rows where the SQL `on` holds); boxes that a window or an affine map leaves nothing of go."""
    if op.name not in MOVES:
        return df
    if e := square(op):
        swap, fx, fy = T.SQUARE[e]
        x, y, bw, bh, w, h = ("y", "x", "bh", "bw", "h", "w") if swap else ("x", "y", "bw", "bh", "w", "h")
        return _set(df, on, x=f"{w} - ({x} + {bw})" if fx else x, y=f"{h} - ({y} + {bh})" if fy else y, bw=bw, bh=bh, w=w, h=h)
    match op.name:
        case "crop" | "random_crop":
            cx, cy = _window(op)
            w, h = op["width"], op["height"]
            cut = {"x": f"greatest(x - {cx}, 0)", "y": f"greatest(y - {cy}, 0)"}
            cut |= {"bw": f"least(x + bw - {cx}, {w}) - {cut['x']}", "bh": f"least(y + bh - {cy}, {h}) - {cut['y']}"}
            return _left(_set(df, on, **cut, w=str(w), h=str(h)), on, "bw > 0 and bh > 0")
        case "pad":
            return _set(df, on, x=f"x + {op['left']}", y=f"y + {op['top']}", w=f"w + {op['left']} + {op['right']}", h=f"h + {op['top']} + {op['bottom']}")
        case "resize":
            sx, sy = f"(cast({op['width']} as double) / w)", f"(cast({op['height']} as double) / h)"
            return _set(df, on, x=f"x * {sx}", y=f"y * {sy}", bw=f"bw * {sx}", bh=f"bh * {sy}", w=str(op["width"]), h=str(op["height"]))
    corner = [_affine(op)(x, y) for x in ("x", "x + bw") for y in ("y", "y + bh")]
    ends = {k: f"{f}({', '.join(c[i] for c in corner)})" for k, f, i in (("x0", "least", 0), ("y0", "least", 1), ("x1", "greatest", 0), ("y1", "greatest", 1))}
    lo, hi = {c: f"greatest({ends[c + '0']}, 0)" for c in "xy"}, {c: f"least({ends[c + '1']}, {n})" for c, n in (("x", "w"), ("y", "h"))}
    return _left(_set(df, on, x=lo["x"], y=lo["y"], bw=f"{hi['x']} - {lo['x']}", bh=f"{hi['y']} - {lo['y']}"), on, "bw > 0 and bh > 0")


def move_points(df: DataFrame, op: Op, on: str | None = None) -> DataFrame:
    """Points after one operation (of rows where the SQL `on` holds); points outside a window or off an affine image go."""
    if op.name not in MOVES:
        return df
    if e := square(op):
        swap, fx, fy = T.SQUARE[e]
        x, y, w, h = ("y", "x", "h", "w") if swap else ("x", "y", "w", "h")
        return _set(df, on, x=f"{w} - {x}" if fx else x, y=f"{h} - {y}" if fy else y, w=w, h=h)
    match op.name:
        case "crop" | "random_crop":
            cx, cy = _window(op)
            return _left(_set(df, on, x=f"x - {cx}", y=f"y - {cy}", w=str(op["width"]), h=str(op["height"])), on, "x >= 0 and y >= 0 and x < w and y < h")
        case "pad":
            return _set(df, on, x=f"x + {op['left']}", y=f"y + {op['top']}", w=f"w + {op['left']} + {op['right']}", h=f"h + {op['top']} + {op['bottom']}")
        case "resize":
            return _set(df, on, x=f"x * cast({op['width']} as double) / w", y=f"y * cast({op['height']} as double) / h", w=str(op["width"]), h=str(op["height"]))
    x, y = _affine(op)("x", "y", 0.5)
    return _left(_set(df, on, x=x, y=y), on, "x >= 0 and y >= 0 and x < w and y < h")


def apply_to_boxes(df: DataFrame, program: Program) -> DataFrame:
    """Boxes through the whole program, as it was sampled."""
    for op in program:
        df = move_boxes(df, op)
    return df


def apply_to_points(df: DataFrame, program: Program) -> DataFrame:
    for op in program:
        df = move_points(df, op)
    return df


def one_hot(column: str, classes: int):
    """A soft label of a class number."""
    return F.expr(f"transform(sequence(0, {classes} - 1), k -> if(k = {column}, 1D, 0D))")


def mix_labels(a: str, b: str, share: str):
    """share * a + (1 - share) * b."""
    return F.expr(f"zip_with({a}, {b}, (p, q) -> p * {share} + q * (1 - {share}))")


def top_class(label: str):
    return F.expr(f"cast(array_position({label}, array_max({label})) - 1 as int)")


def normalized(label: str):
    return F.expr(f"if(aggregate({label}, 0D, (a, v) -> a + v) = 0, {label}, transform({label}, v -> v / aggregate({label}, 0D, (a, v) -> a + v)))")


