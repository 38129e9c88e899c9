"""Rules that make fewer, cheaper stages of a program, with the same result.

Catalyst merges projections by itself, but does not compose lookup tables, 3x3
matrices or coordinate maps and does not crop before pixels are unpacked; these
are rewritten here, before a stage becomes one projection or one Arrow kernel.

1. Crops move left over operations on single pixels.
2. Flips, transposes and rotations move left over operations on single pixels.
3. Neighbouring lookup tables become one, symmetries one, identities none.
4. Tables after equalize or auto_contrast join the table that these build.
5. Tables before to_gray become a sum of one table a channel.
6. Matrices become one if asked for: one final clip differs from several.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import tables as T
from .program import MATRIX, MOVES, POINTWISE, POINTWISE_TABLE, Op, Program, matrix, square, tables

SINGLE = POINTWISE_TABLE.keys() | MATRIX.keys() | POINTWISE.keys()
CROPS = {"crop", "random_crop"}


@dataclass
class Plan:
    stages: list[Op]
    before: int
    notes: list[str]
    optimized: bool = True

    def explain(self) -> str:
        head = f"{len(self.stages)} {'stage' if len(self.stages) == 1 else 'stages'} for {self.before} operations"
        return "\n".join([head, *(f"  [{k}] {o}" for k, o in enumerate(self.stages, 1)), *(f"  ({n})" for n in self.notes)])

    def mermaid(self) -> str:
        nodes = ["in([image])", *(f'n{k}["{o}"]' for k, o in enumerate(self.stages)), "out([image])"]
        names = ["in", *(f"n{k}" for k in range(len(self.stages))), "out"]
        return "\n".join(["flowchart LR", *(f"  {n}" for n in nodes), *(f"  {a} --> {b}" for a, b in zip(names, names[1:], strict=False))])

    def stats(self) -> dict:
        return {"before": self.before, "after": len(self.stages), "optimized": self.optimized}


def _hoist(ops: list[int], which, over) -> tuple[list[int], int]:
    out, moved = [], 0
    for o in ops:
        k = len(out)
        if which(o):
            while k and over(out[k - 1]):
                k -= 1
                moved += 1
        out.insert(k, o)
    return out, moved


def order(ops: list[Op]) -> tuple[list[int], int, int]:
    """(places of ops in the order they run in, moves of crops, moves of symmetries); only names and symmetries decide."""
    where, crops, moved = list(range(len(ops))), 0, 0
    single = lambda k: ops[k].name in SINGLE
    while True:  # a symmetry that has moved may let a crop move
        where, a = _hoist(where, lambda k: ops[k].name in CROPS, single)
        where, b = _hoist(where, lambda k: square(ops[k]) is not None, single)
        crops, moved = crops + a, moved + b
        if not a and not b:
            return where, crops, moved


def _three(t: list[list[int]]) -> list[list[int]]:
    return t if len(t) == 3 else t * 3


def _joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    if len(a) == len(b) == 1:
        return [T.compose(a[0], b[0])]
    return [T.compose(x, y) for x, y in zip(_three(a), _three(b), strict=True)]


def _fuse(ops: list[Op], channels: int | None, matrices: bool) -> list[Op]:
    out: list[Op] = []
    for o in ops:
        last = out[-1] if out else None
        t, m, s = tables(o), matrix(o), square(o)
        plain = t is not None and (len(t) == 1 or channels == 3)
        if o.name == "to_gray" and channels == 3 and last is not None and tables(last) is not None:
            out[-1] = Op("sums", {"tables": T.luma(_three(tables(last))).tolist()})
        elif plain and last is not None and (tables(last) is not None) and (len(tables(last)) == 1 or channels == 3):
            out[-1] = Op("lut", {"table": _joined(tables(last), t)})
        elif t is not None and len(t) == 1 and last is not None and last.name in ("equalize", "auto_contrast"):
            out[-1] = Op(last.name, {**last.params, "then": T.compose(last["then"] or list(range(256)), t[0])})
        elif s and last is not None and square(last):
            out[-1] = Op("square", {"element": T.then(square(last), s)})
        elif m is not None and matrices and last is not None and matrix(last) is not None:
            out[-1] = Op("matrix", {"matrix": (np.array(m, float) @ np.array(matrix(last), float)).tolist()})
        else:
            out.append(o)
        if o.name == "to_gray" and channels == 3:
            channels = 1
        elif o.name == "to_rgb" and channels == 1:
            channels = 3
        if out and _nothing(out[-1]):
            out.pop()
    return out


def _nothing(o: Op) -> bool:
    t, m = tables(o), matrix(o)
    if t is not None:
        return all(x == list(range(256)) for x in t)
    if m is not None:
        return np.array_equal(np.array(m, float), np.eye(3))
    return square(o) == "identity" or o.name == "pad" and not any(o[k] for k in ("top", "right", "bottom", "left"))


def plan(program: Program, optimize: bool = True, channels: int | None = None, fuse_matrices: bool = False) -> Plan:
    """Stages for a program; channels, where known, lets per-channel tables fuse."""
    ops = list(program)
    notes = [f"{o.name}: {o['interpolation']} is done as bilinear" for o in ops if o.params.get("interpolation") in ("bicubic", "lanczos4")]
    notes += [f"edge_detection: {o['method']} is done as {'laplacian' if o['method'] == 'prewitt' else 'sobel'}" for o in ops if o.name == "edge_detection" and o["method"] in ("prewitt", "canny")]
    if not optimize:
        return Plan(ops, len(ops), notes, False)
    where, crops, moved = order(ops)
    ops = [ops[k] for k in where]
    if crops or moved:
        notes.append(f"crops moved over {crops} operations, symmetries over {moved}")
    return Plan(_fuse(ops, channels, fuse_matrices), len(program), notes)


def moves_only(program: Program) -> list[Op]:
    return [o for o in program if o.name in MOVES]
