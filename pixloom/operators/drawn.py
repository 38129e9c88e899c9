"""Random pipelines as projections: draws, branches and parameters are columns.

`packed` samples a program for each row in Python.  Here the pipeline's tree is
compiled once: every draw is a hash of (seed, stream, key) in SQL, kept in one
struct column; what a row takes is a condition over it, and an operation's
parameters are its fields.  So a random pipeline on planes, on boxes and on
keypoints is a chain of projections and filters in the JVM, without Python and
without a shuffle, and draws what the packed path draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Constant, Distribution, Uniform, UniformInt, distribution, unit_column
from ..plans.pipeline import Choice, Compose, Identity, Maybe, Node, SomeOf, Transform, _always
from ..plans.program import INTEGERS, MOVES, OPS, Op
from . import catalyst as C
from .catalyst import DRAWN, Sql
from .labels import move_boxes, move_points

#: Parameters that change which samples an operation looks at: one branch for each value that can be drawn.
BRANCHED = {("gaussian_blur", "kernel_size"), ("median_blur", "kernel_size"), ("rotate", "angle")}


class Compiled:
    """draws: columns by name.  steps: (SQL condition or None, operation), in order."""

    def __init__(self, pipeline: Node, seed: int = 0, key: str = "image_id"):
        self.seed, self.key = seed, key
        self.draws: dict[str, Column] = {}
        self.steps: list[tuple[str | None, Op]] = []
        self._node(pipeline, "0", None)

    def _unit(self, stream: str) -> Column:
        return unit_column(self.seed, stream, self.key)

    def _field(self, column: Column) -> Sql:
        name = f"d{len(self.draws)}"
        self.draws[name] = column
        return Sql(f"{DRAWN}.{name}")

    def _taken(self, p: Distribution, path: str, on: str | None) -> str | None:
        return on if _always(p) else _and(on, self._field(self._unit(f"{path}/p") < p.p))

    def _node(self, node: Node, path: str, on: str | None) -> None:
        if isinstance(node, Identity):
            return
        on = self._taken(node.p, path, on)
        match node:
            case Transform():
                self._transform(node, path, on)
            case Maybe():
                self._node(node.child, f"{path}/m", on)
            case Choice():
                roll, total, branch = self._unit(f"{path}/c") * float(sum(node.weights)), 0.0, None
                some = [k for k, w in enumerate(node.weights) if w > 0]
                for k in some:
                    total += node.weights[k]
                    branch = F.when(roll <= total, k) if branch is None else branch.when(roll <= total, k)
                field = self._field(branch.otherwise(some[-1]))
                for k, child in enumerate(node.transforms):
                    self._node(child, f"{path}/{k}", _and(on, f"{field} = {k}"))
            case SomeOf():
                n = len(node.transforms)
                ranks = F.array_sort(F.array(*(F.struct(self._unit(f"{path}/s/{k}").alias("u"), F.lit(k).alias("k")) for k in range(n))))
                order = self._field(F.transform(ranks, lambda e: e.k))
                for place in range(max(1, min(node.k, n))):
                    for k, child in enumerate(node.transforms):
                        self._node(child, f"{path}/{k}", _and(on, f"{order}[{place}] = {k}"))
            case Compose():
                for k, child in enumerate(node.transforms):
                    self._node(child, f"{path}/{k}", on)
            case _:
                raise TypeError(f"{type(node).__name__} can't be compiled")

    def _transform(self, node: Transform, path: str, on: str | None) -> None:
        out, branched = {}, []
        for k, v in node.params.items():
            whole = isinstance(OPS[node.name][k], tuple)
            if isinstance(v, Distribution) or (isinstance(v, tuple | list) and len(v) == 2 and not whole):
                d = distribution(v)
                column = d.column(self._unit(f"{path}/{k}"), self._unit(f"{path}/{k}/2"))
                if k in INTEGERS:
                    column = (F.floor(column) if isinstance(d, Constant) and d.value >= 0 else F.signum(column) * F.floor(F.abs(column) + 0.5)).cast("int")
                out[k] = self._field(column)
                if (node.name, k) in BRANCHED:
                    branched.append((k, out[k], _values(d, node.name, k)))
            else:
                out[k] = int(v) if k in INTEGERS and isinstance(v, float) else v
        if node.name == "random_crop":
            out |= {a: self._field(self._unit(f"{path}/{a}")) for a in ("fx", "fy") if a not in out}
        if node.name == "crop":
            out |= {k: Sql(f"greatest({low}, {out[k]})") if isinstance(out[k], Sql) else max(low, out[k]) for k, low in (("x", 0), ("y", 0), ("width", 1), ("height", 1)) if k in out}
        if "seed" in OPS[node.name] and "seed" not in out:
            out["seed"] = self._field(F.floor(self._unit(f"{path}/seed") * 2.0**31))
        if not branched:
            self.steps.append((on, Op(node.name, out)))
        for k, field, values in branched:
            self.steps += [(_and(on, f"{field} = {v}"), Op(node.name, out | {k: v})) for v in values]

    def with_draws(self, df: DataFrame) -> DataFrame:
        return df.withColumn(DRAWN, F.struct(*(c.alias(n) for n, c in self.draws.items()))) if self.draws else df


def _and(on: str | None, more: str) -> str:
    return f"{on} and {more}" if on else more


def _values(d: Distribution, name: str, k: str) -> list[int]:
    if isinstance(d, UniformInt):
        return list(range(d.min, d.max + 1))
    if isinstance(d, Uniform):
        return list(range(round(d.min), round(d.max) + 1))
    if isinstance(d, Constant):
        return [int(d.value)]
    raise ValueError(f"{k} of {name} must come from a range")


def images(df: DataFrame, pipeline: Node, seed: int = 0, key: str = "image_id") -> DataFrame:
    """planes after each row's draws; other columns ride along.  A window that leaves its image is an error."""
    made = Compiled(pipeline, seed, key)
    df = made.with_draws(df)
    for on, op in made.steps:
        df = C.chosen(df, on, lambda d, o=op, w=on: C.apply(d, o, w)) if on else C.apply(df, op)
    return df.drop(DRAWN)


def _moved(df: DataFrame, pipeline: Node, seed: int, key: str, move) -> DataFrame:
    made = Compiled(pipeline, seed, key)
    df = made.with_draws(df)
    for on, op in made.steps:
        if op.name in MOVES:
            df = move(df, op, on)
    return df.drop(DRAWN)


def boxes(df: DataFrame, pipeline: Node, seed: int = 0, key: str = "image_id") -> DataFrame:
    """Flat boxes (key, w, h, x, y, bw, bh, more) after what each image's key draws; w and h become the image's size."""
    return _moved(df, pipeline, seed, key, move_boxes)


def points(df: DataFrame, pipeline: Node, seed: int = 0, key: str = "image_id") -> DataFrame:
    """Flat keypoints (key, w, h, x, y, more) after what each image's key draws."""
    return _moved(df, pipeline, seed, key, move_points)
