"""Random programs over a batch: images whose programs are one sequence of operations share its plan, parameters as arrays.

What differs between programs of a sequence are numbers.  So the order of the
stages is found once a sequence, lookup tables are built and composed for all its
programs at once, (programs, channels, 256), and an image costs a byte map, a
turn or a copy of a window.  Results are those of planner.plan, image by image.
"""

from __future__ import annotations

import numpy as np

from ..functions import tables as T
from ..plans.planner import order
from ..plans.program import POINTWISE_TABLE, Op, Program, square, window
from . import kernels


def sequence(program: Program) -> tuple:
    """What programs must share to share a plan."""
    return tuple((o.name, square(o)) for o in program)


def table_rows(column: list[Op], channels: int) -> np.ndarray:
    """(n, 1 or channels, 256) tables of n table operations of one name, for images of so many channels."""
    n, name = len(column), column[0].name
    of = lambda k, kind=np.float64: np.array([o[k] for o in column], kind)
    match name:
        case "brightness":
            return T.brighter(of("delta"))[:, None]
        case "contrast":
            return T.contrasted(of("factor"))[:, None]
        case "gamma":
            return T.powered(of("gamma"))[:, None]
        case "invert":
            return np.repeat(np.array(T.invert(), np.uint8)[None, None], n, 0)
        case "posterize":
            return T.posterized(of("bits", np.int64))[:, None]
        case "solarize":
            return T.solarized(of("threshold"))[:, None]
        case "rgb_shift" if channels in (3, 4):
            return _widened(T.shifted(np.stack([of("r_shift"), of("g_shift"), of("b_shift")], 1)), channels)
        case "rgb_shift":
            return np.array([T.mean_shift(**o.params) for o in column], np.uint8)[:, None]
        case "lut":
            each = [np.array(o["table"], np.uint8) for o in column]
            wide = channels in (3, 4) and any(len(t) > 1 for t in each)
            return np.stack([_widened(t[None], channels)[0] if wide else t[:1] for t in each])
    raise ValueError(f"{name} is no table operation")


def _widened(tables: np.ndarray, channels: int) -> np.ndarray:
    """One table a channel: one for all is repeated, a fourth channel stays beside three."""
    n, k = tables.shape[:2]
    if k == channels:
        return tables
    if k == 1:
        return np.repeat(tables, channels, 1)
    same = np.broadcast_to(np.arange(256, dtype=np.uint8), (n, channels - k, 256))
    return np.concatenate([tables, same], 1)


def composed(first: np.ndarray, then: np.ndarray, channels: int) -> np.ndarray:
    if first.shape[1] != then.shape[1]:
        first, then = _widened(first, channels), _widened(then, channels)
    return np.take_along_axis(then, first.astype(np.intp), axis=2)


def _mapped(tables: np.ndarray):
    """The stage of n programs' tables."""
    if tables.shape[1] == 1:
        maps = [t.tobytes() for t in tables[:, 0]]
        return lambda img, k: kernels.looked_up(img, maps[k])

    def run(img, k):
        out = np.empty(img.shape, np.uint8)
        for c in range(tables.shape[1]):
            np.take(tables[k, c], img[..., c], out=out[..., c], mode="clip")
        return out

    return run


def _cut(column: list[Op]):
    def run(img, k):
        x, y, w, h = window(column[k], img.shape[1], img.shape[0])
        return np.ascontiguousarray(img[y : y + h, x : x + w])

    return run


def stages(programs: list[Program], channels: int, optimize: bool = True) -> list:
    """Functions (image, number of its program) for programs of one sequence."""
    first = list(programs[0])
    columns = [[p.ops[k] for p in programs] for k in (order(first)[0] if optimize else range(len(first)))]
    out, pending, turned = [], None, "identity"

    def settle():
        nonlocal pending, turned
        if pending is not None:
            out.append(_mapped(pending))
        if turned != "identity":
            out.append(lambda img, k, e=turned: kernels.turn(img, e))
        pending, turned = None, "identity"

    for column in columns:
        name, element = column[0].name, square(column[0])
        if name in POINTWISE_TABLE:
            if turned != "identity" or not optimize:
                settle()
            t = table_rows(column, channels)
            pending = t if pending is None else composed(pending, t, channels)
        elif element:
            if pending is not None or not optimize:
                settle()
            turned = T.then(turned, element)
        elif name == "to_gray" and channels == 3 and pending is not None and optimize:
            out.append(lambda img, k, t=T.luma(_widened(pending, 3)): kernels.summed(img, t[k]))
            pending, channels = None, 1
        else:
            settle()
            out.append(_cut(column) if name in ("crop", "random_crop") else lambda img, k, ops=column: kernels.apply(img, ops[k]))
            channels = {"to_gray": 1 if channels == 3 else channels, "to_rgb": 3 if channels == 1 else channels}.get(name, channels)
    settle()
    return out


def through(images: list[np.ndarray | None], programs: list[Program | None], optimize: bool = True, moves: bool = False) -> list[np.ndarray | None]:
    """images[k] after programs[k]; None stays.  With moves only what moves pixels applies."""
    kinds: dict[int, tuple] = {}
    groups: dict[tuple, tuple[dict[int, int], list[Program], list[tuple[int, int]]]] = {}
    for k, (img, whole) in enumerate(zip(images, programs, strict=True)):
        if img is None:
            continue
        whole.validate(img.shape[1], img.shape[0])
        if id(whole) not in kinds:
            p = whole.moves() if moves else whole
            kinds[id(whole)] = p, sequence(p)
        p, said = kinds[id(whole)]
        numbers, distinct, rows = groups.setdefault((img.shape[2], said), ({}, [], []))
        if id(whole) not in numbers:
            numbers[id(whole)] = len(distinct)
            distinct.append(p)
        rows.append((k, numbers[id(whole)]))
    out: list[np.ndarray | None] = [None] * len(images)
    for (channels, _), (_, distinct, rows) in groups.items():
        run = stages(distinct, channels, optimize)
        for k, j in rows:
            x = images[k]
            for f in run:
                x = f(x, j)
            out[k] = x
    return out
