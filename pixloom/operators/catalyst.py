"""Operators as Catalyst expressions over planes (image_id, w, h, planes).

An image is one row, so a coordinate map, a convolution or a colour matrix is a
projection: no join and no shuffle, whatever the number of images.  Sizes are
columns, so images of different sizes pass through the same expression.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.draws import unit_column
from ..plans.program import POINTWISE_TABLE, Op, matrix, square, tables

OTHERS = ("planes", "w", "h")
#: A struct column of what a random pipeline draws for the row.
DRAWN = "_drawn"


class Sql(str):
    """A parameter that is a column: SQL over the row's draws."""


def number(x) -> str:
    """A parameter as a double in SQL."""
    return f"cast({x} as double)" if isinstance(x, Sql) else f"{float(x)!r}D"


def _with(df: DataFrame, planes: str, w: str = "w", h: str = "h") -> DataFrame:
    if DRAWN in planes:  # bound once a row, else each draw would be hashed again for every sample
        planes = f"transform(array({DRAWN}), {DRAWN} -> {planes})[0]"
    rest = [f"`{c}`" for c in df.columns if c not in OTHERS]
    return df.selectExpr(*rest, f"cast({w} as int) as w", f"cast({h} as int) as h", f"{planes} as planes")


def _literal(values) -> str:
    if values and isinstance(values[0], list | tuple):
        return f"array({', '.join(map(_literal, values))})"
    return f"array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})"


def lookup(df: DataFrame, table: list[list[int]]) -> DataFrame:
    """One table for all channels, or three; a fourth channel then stays."""
    if len(table) == 1:
        return _with(df, f"transform(planes, p -> transform(p, v -> element_at({_literal(table[0])}, v + 1)))")
    pick = f"element_at({_literal([*table, list(range(256))])}, least(c, 3) + 1)"
    return _with(df, f"transform(planes, (p, c) -> transform(p, v -> element_at({pick}, v + 1)))")


def _from(df: DataFrame, source: str, w: str = "w", h: str = "h") -> DataFrame:
    """New planes of size w x h; source is SQL for a sample, with x, y and a plane p."""
    grid = f"sequence(0, cast(({w}) * ({h}) as int) - 1)"
    source = source.replace("{x}", f"(i % cast({w} as int))").replace("{y}", f"cast(i div ({w}) as int)")
    return _with(df, f"transform(planes, p -> transform({grid}, i -> {source}))", w, h)


def _at(x: str, y: str) -> str:
    return f"get(p, cast(({y}) * w + ({x}) as int))"


def turn(df: DataFrame, element: str) -> DataFrame:
    swap, fx, fy = T.SQUARE[element]
    w, h = ("h", "w") if swap else ("w", "h")
    x, y = ("({w} - 1 - {{x}})" if fx else "{{x}}").format(w=w), ("({h} - 1 - {{y}})" if fy else "{{y}}").format(h=h)
    return _from(df, _at(y, x) if swap else _at(x, y), w, h)


def crop(df: DataFrame, x, y, width: int, height: int, on: str = "true") -> DataFrame:
    """A window; numbers may be SQL.  A window that leaves the image is an error in rows where `on` holds."""
    fine = f"if(({on}) and (({x}) < 0 or ({y}) < 0 or ({x}) + {width} > w or ({y}) + {height} > h), raise_error('the window leaves the image'), true)"
    return _from(df.where(fine), _at(f"{{x}} + ({x})", f"{{y}} + ({y})"), str(width), str(height))


def random_crop(df: DataFrame, width: int, height: int, seed: int = 0, key: str = "image_id") -> DataFrame:
    fx, fy = (unit_column(seed, s, key) for s in ("crop/x", "crop/y"))
    placed = df.withColumns({"_x": F.least(F.floor(fx * (F.col("w") - width + 1)), F.col("w") - width), "_y": F.least(F.floor(fy * (F.col("h") - height + 1)), F.col("h") - height)})
    return crop(placed, "_x", "_y", width, height).drop("_x", "_y")


def _border(at: str, n: str, mode: str) -> str:
    match mode:
        case "wrap":
            return f"pmod({at}, {n})"
        case "replicate":
            return f"least(greatest({at}, 0), {n} - 1)"
        case "reflect":
            return f"least(greatest(if({at} < 0, -({at}) - 1, if({at} >= {n}, 2 * {n} - ({at}) - 1, {at})), 0), {n} - 1)"
    raise ValueError(f"unknown border {mode}")


def pad(df: DataFrame, top=0, right=0, bottom=0, left=0, mode="reflect", value=0) -> DataFrame:
    x, y, w, h = f"({{x}} - {left})", f"({{y}} - {top})", f"(w + {left} + {right})", f"(h + {top} + {bottom})"
    if mode == "constant" or value:
        return _from(df, f"if({x} between 0 and w - 1 and {y} between 0 and h - 1, {_at(x, y)}, {value if isinstance(value, Sql) else int(value)})", w, h)
    return _from(df, _at(_border(x, "w", mode), _border(y, "h", mode)), w, h)


def _axis(n: str, size: str, new: str, first: str = "0") -> str:
    """Bilinear taps of n positions from `first` of an axis of `new` over one of `size`: the lower sample, the upper one and the upper's share."""
    at = f"((k + {first} + 0.5D) * ({size} / {new}) - 0.5D)"
    low = f"cast(least(greatest(floor({at}), 0), {size} - 1) as int)"
    return f"transform(sequence(0, cast({n} as int) - 1), k -> named_struct('a', {low}, 'b', cast(least({low} + 1, {size} - 1) as int), 'f', if({at} < 0 or {at} >= {size} - 1, 0D, {at} - floor({at}))))"


def _blended(df: DataFrame, xs: str, ys: str, w: str, h: str) -> DataFrame:
    """New planes of size w x h from taps of both axes: rows of two samples each are mixed as the taps say."""
    taps = df.withColumns({"_xs": F.expr(xs), "_ys": F.expr(ys)})
    row = "transform(_xs, x -> {})"
    mixed = "get(p, y.a * w + x.a) * (1 - x.f) * (1 - y.f) + get(p, y.a * w + x.b) * x.f * (1 - y.f) + get(p, y.b * w + x.a) * (1 - x.f) * y.f + get(p, y.b * w + x.b) * x.f * y.f"
    new = f"flatten(transform(_ys, y -> {row.format(f'cast(floor({mixed} + 0.5D) as int)')}))"
    return _with(taps, f"transform(planes, p -> {new})", w, h).drop("_xs", "_ys")


def resize(df: DataFrame, width: int, height: int, interpolation="bilinear") -> DataFrame:
    if interpolation == "nearest":
        return _from(df, _at(f"least({{x}} * w div {width}, w - 1)", f"least({{y}} * h div {height}, h - 1)"), str(width), str(height))
    return _blended(df, _axis(str(width), "w", str(width)), _axis(str(height), "h", str(height)), str(width), str(height))


def inverse(scale, rotate, translate, shear) -> tuple[tuple[str, ...], tuple]:
    """((a, b, d, e), (x, y)): SQL of the source map's matrix, and the translation."""
    tx, ty = (translate,) * 2 if isinstance(translate, int | float | Sql) else translate
    if not any(isinstance(v, Sql) for v in (scale, rotate, shear)):
        a, b, _, d, e, _ = T.inverse_affine(1, 1, scale, rotate, (0, 0), shear)
        return tuple(f"{v!r}D" for v in (a, b, d, e)), (tx, ty)
    kx, ky = (shear, 0) if isinstance(shear, int | float | Sql) else shear
    kx, ky, angle = f"tan(radians({number(kx)}))", f"tan(radians({number(ky)}))", f"radians({number(rotate)})"
    scales = [f"if(abs({number(v)}) > 1e-6D, 1 / {number(v)}, 1D)" for v in ((scale,) * 2 if isinstance(scale, int | float | Sql) else scale)]
    det = f"if(abs(1 - {kx} * {ky}) > 1e-6D, 1 - {kx} * {ky}, 1D)"
    first, second = (f"{scales[0]} * cos({angle})", f"-{scales[0]} * sin({angle})"), (f"{scales[1]} * sin({angle})", f"{scales[1]} * cos({angle})")
    return tuple(f"(({x} * {m} + {y} * {n}) / {det})" for x, y in (first, second) for m, n in (("1", f"-{ky}"), (f"-{kx}", "1"))), (tx, ty)


def affine(df: DataFrame, scale=1.0, rotate=0.0, translate=(0, 0), shear=(0, 0), interpolation="bilinear", border_mode="constant", value=0) -> DataFrame:
    """About each image's centre, in 16.16 fixed point."""
    (a, b, d, e), (tx, ty) = inverse(scale, rotate, translate, shear)
    fixed = lambda v: f"cast(floor({v} * 65536 + 0.5D) as bigint)"
    cx, cy = "((w - 1) / 2D)", "((h - 1) / 2D)"
    c = f"({cx} - ({a} * ({cx} + {tx}) + {b} * ({cy} + {ty})))"
    f = f"({cy} - ({d} * ({cx} + {tx}) + {e} * ({cy} + {ty})))"
    sx = f"(floor(({b} * {{y}} + {c}) * 65536 + 0.5D) + {{x}} * {fixed(a)})"
    sy = f"(floor(({e} * {{y}} + {f}) * 65536 + 0.5D) + {{x}} * {fixed(d)})"

    def at(x, y):
        if border_mode == "constant":
            return f"if({x} between 0 and w - 1 and {y} between 0 and h - 1, {_at(x, y)}, {int(value)})"
        if border_mode == "reflect":
            x, y = (f"if(pmod({p}, 2 * {n}) >= {n}, 2 * {n} - 1 - pmod({p}, 2 * {n}), pmod({p}, 2 * {n}))" for p, n in ((x, "w"), (y, "h")))
        return _at(_border(x, "w", border_mode), _border(y, "h", border_mode))

    if interpolation == "nearest":
        return _from(df, f"cast({at(f'shiftright({sx} + 32768, 16)', f'shiftright({sy} + 32768, 16)')} as int)")
    x, y, fx, fy = f"shiftright({sx}, 16)", f"shiftright({sy}, 16)", f"(shiftright({sx}, 8) & 255)", f"(shiftright({sy}, 8) & 255)"
    total = f"{at(x, y)} * (256 - {fx}) * (256 - {fy}) + {at(f'{x} + 1', y)} * {fx} * (256 - {fy}) + {at(x, f'{y} + 1')} * (256 - {fx}) * {fy} + {at(f'{x} + 1', f'{y} + 1')} * {fx} * {fy}"
    return _from(df, f"cast(shiftright({total} + 32768, 16) as int)")


def _mixed(df: DataFrame, rows: list[str]) -> DataFrame:
    """Three new planes; rows are SQL over r, g and b."""
    made = []
    for row in rows:
        for name, k in (("r", 0), ("g", 1), ("b", 2)):
            row = row.replace(f"{{{name}}}", f"get(planes[{k}], i)")
        made.append(f"transform(sequence(0, w * h - 1), i -> cast({row} as int))")
    return _with(df, f"if(size(planes) = 3, array({', '.join(made)}), planes)")


def mix(df: DataFrame, m) -> DataFrame:
    return _mixed(df, [f"floor(least(greatest({number(a)} * {{r}} + {number(b)} * {{g}} + {number(c)} * {{b}}, 0), 255))" for a, b, c in m])


def shuffle_channels(df: DataFrame, order) -> DataFrame:
    return _with(df, f"if(size(planes) = 3, array({', '.join(f'planes[{k}]' for k in T.order(order))}), planes)")


def scale_channels(df: DataFrame, r: float, g: float, b: float) -> DataFrame:
    """A diagonal matrix needs no look at other channels."""
    return _with(df, f"if(size(planes) = 3, transform(planes, (p, c) -> transform(p, v -> cast(floor(least(greatest(v * element_at(array({number(r)}, {number(g)}, {number(b)}), c + 1), 0), 255)) as int))), planes)")


def sums(df: DataFrame, tables) -> DataFrame:
    """One plane: tables by channel, added, in 256ths."""
    total = " + ".join(f"element_at({_literal(t)}, get(planes[{k}], i) + 1)" for k, t in enumerate(tables))
    return _with(df, f"array(transform(sequence(0, w * h - 1), i -> cast(shiftright({total}, 8) as int)))")


def to_gray(df: DataFrame) -> DataFrame:
    return _with(df, "if(size(planes) = 3, array(transform(sequence(0, w * h - 1), i -> shiftright(77 * get(planes[0], i) + 150 * get(planes[1], i) + 29 * get(planes[2], i) + 128, 8))), planes)")


def to_rgb(df: DataFrame) -> DataFrame:
    return _with(df, "if(size(planes) = 1, array_repeat(planes[0], 3), planes)")


def hue_saturation_value(df: DataFrame, hue_shift=0, saturation_scale=1.0, value_scale=1.0) -> DataFrame:
    """Hue, saturation and value in integers of eight bits, pixel by pixel; a formula that must match.

    Each step is an array of structs that the next one reads, so nothing is computed twice.
    """
    if not hue_shift:
        return saturation_value(df, saturation_scale, value_scale)
    s, v = (f"cast({x} * 256 as int)" if isinstance(x, Sql) else math.trunc(x * 256) for x in (saturation_scale, value_scale))
    hue_shift = hue_shift if isinstance(hue_shift, Sql) else int(hue_shift)
    whole = "transform(sequence(0, w * h - 1), i -> named_struct('r', get(planes[0], i), 'g', get(planes[1], i), 'b', get(planes[2], i)))"
    steps = [
        f"if(size(planes) = 3, {whole}, array())",
        "transform(_q, e -> named_struct('r', e.r, 'g', e.g, 'b', e.b, 't', greatest(e.r, e.g, e.b), 'd', greatest(e.r, e.g, e.b) - least(e.r, e.g, e.b)))",
        "transform(_q, e -> named_struct('t', e.t, 'd', e.d, 'hue', pmod(60D * case when e.d = 0 then 0D when e.t = e.r then (e.g - e.b) / cast(e.d as double) "
        f"when e.t = e.g then (e.b - e.r) / cast(e.d as double) + 2 else (e.r - e.g) / cast(e.d as double) + 4 end + {hue_shift}, 360D)))",
        f"transform(_q, e -> named_struct('hue', e.hue, 'val', least(shiftright(e.t * {v} + 128, 8), 255), 'sat', least(shiftright(if(e.t > 0, least(255, e.d * 256 div e.t), 0) * {s} + 128, 8), 255)))",
        "transform(_q, e -> named_struct('val', e.val, 'c', e.val * e.sat, 'k', cast(least(floor(e.hue / 60), 5) as int), 'm', cast(shiftright(e.val * e.sat * (255 - cast(floor(abs(e.hue / 60 % 2 - 1) * 255) as bigint)) + 128, 8) as bigint)))",
    ]
    for k, step in enumerate(steps):
        df = df.withColumn("_q", F.expr(step))
    part = "element_at(array({}), e.k + 1)"
    rgb = [part.format(x) for x in ("e.c, e.m, 0, 0, e.m, e.c", "e.m, e.c, e.c, e.m, 0, 0", "0, 0, e.m, e.c, e.c, e.m")]
    made = [f"transform(_q, e -> cast(if(e.c = 0, e.val, least(greatest(shiftright({x} + e.val * 256 - e.c, 8), 0), 255)) as int))" for x in rgb]
    gray = f"transform(planes, p -> transform(p, x -> cast(least(shiftright(x * {v} + 128, 8), 255) as int)))"
    return _with(df, f"case size(planes) when 3 then array({', '.join(made)}) when 1 then {gray} else planes end").drop("_q")


def saturation_value(df: DataFrame, saturation_scale=1.0, value_scale=1.0) -> DataFrame:
    """Saturation and value scaled; hue stays."""
    if isinstance(saturation_scale, Sql) or isinstance(value_scale, Sql):
        s, v = number(saturation_scale), number(value_scale)
        soft = (f"{s} * {v}", f"{v} * (1 - {s})")
        return chosen(df, f"{s} <= 1 and {v} <= 1", lambda d: _softened(d, *soft), lambda d: _hexcone(d, s, v))
    s, v = float(saturation_scale), float(value_scale)
    if s <= 1 and v <= 1:
        return _softened(df, number(s * v), number(v * (1 - s)))
    return _hexcone(df, number(s), number(v))


def _softened(df: DataFrame, own: str, rest: str) -> DataFrame:
    return _mixed(df, [f"floor({own} * {{{c}}} + {rest} * greatest({{r}}, {{g}}, {{b}}) + 0.5D)" for c in "rgb"])


def _hexcone(df: DataFrame, s: str, v: str) -> DataFrame:
    top, low = "greatest({r}, {g}, {b})", "least({r}, {g}, {b})"
    value = f"least({top} * {v}, 255)"
    chroma = f"if({top} > 0, least({value} * ({top} - {low}) * {s} / {top}, {value}), 0D)"
    return _mixed(df, [f"floor(least(greatest({value} - {chroma} + if({top} > {low}, {chroma} * ({{{c}}} - {low}) / ({top} - {low}), 0D), 0), 255) + 0.5D)" for c in "rgb"])


def normalize(df: DataFrame, mean=0.0, std=1.0) -> DataFrame:
    """planes of float; the last operation."""
    three = isinstance(mean, list | tuple) or isinstance(std, list | tuple)
    m, s = (list(map(float, x)) if isinstance(x, list | tuple) else [float(x)] * 3 for x in (mean, std))
    pick = lambda x: f"element_at({_literal(x)}, c + 1)" if three else f"{x[0]!r}D"
    return _with(df, f"transform(planes, (p, c) -> transform(p, v -> cast((v / 255D - {pick(m)}) / {pick(s)} as float)))")


def auto_contrast(df: DataFrame, cutoff: float = 0.0, then=None) -> DataFrame:
    """One range for all channels; both ends come from the row's own samples."""
    if cutoff:
        flat = df.withColumn("_s", F.expr("sort_array(flatten(planes))"))
        cut = f"cast(floor(size(_s) * {number(cutoff)} + 0.5D) as int)"
        ends = flat.withColumns({"_lo": F.expr(f"coalesce(get(_s, {cut}), 255)"), "_hi": F.expr(f"coalesce(get(_s, size(_s) - 1 - {cut}), 0)")}).drop("_s")
    else:
        ends = df.withColumns({"_lo": F.expr("array_min(flatten(planes))"), "_hi": F.expr("array_max(flatten(planes))")})
    new = "if(_lo >= _hi, 0, cast(least(255, greatest(v - _lo, 0) * 255 div (_hi - _lo)) as int))"
    if then:
        new = f"element_at({_literal(then)}, {new} + 1)"
    return _with(ends, f"transform(planes, p -> transform(p, v -> {new}))").drop("_lo", "_hi")


def equalize(df: DataFrame, then=None) -> DataFrame:
    """Tables inside the row: a plane's sorted samples give its levels and how many samples lie at or below each; no shuffle."""
    ends = "filter(sequence(0, size(s) - 1), i -> i = size(s) - 1 or get(s, i + 1) <> get(s, i))"
    level = "if(e[0] + 1 = size(s), get(s, i), cast(floor(255D * (i - e[0]) / (size(s) - 1 - e[0]) + 0.5D) as int))"
    if then:
        level = f"element_at({_literal(then)}, {level} + 1)"
    table = f"transform(array({ends}), e -> named_struct('v', transform(e, i -> get(s, i)), 't', transform(e, i -> {level})))[0]"
    new = f"transform(array(transform(array(array_sort(p)), s -> {table})[0]), q -> transform(p, v -> element_at(q.t, cast(array_position(q.v, v) as int))))[0]"
    rest = f"transform(p, v -> element_at({_literal(then)}, v + 1))" if then else "p"
    return _with(df, f"transform(planes, (p, c) -> if(c < 3 and size(p) > 0, {new}, {rest}))")


def mixed_unit(at: str, seed: int) -> str:
    """A bounded congruential hash of positions to [0, 1); no step leaves 64 bits."""
    k = f"((cast({at} as bigint) * 7919 + {f'{seed} % 1000003' if isinstance(seed, Sql) else seed % 1000003}) % 2147483648)"
    step = "aggregate(sequence(1, 4), {k}, (a, _) -> (a * 1103515245 + 12345) % 65536 * 32768 + (a * 1103515245 + 12345) % 2147483648 div 65536)"
    return f"({step.format(k=k)} / 2147483648D)"


def salt_and_pepper(df: DataFrame, amount=0.05, salt_vs_pepper=0.5, seed=0) -> DataFrame:
    at = "(cast(i as bigint) * size(planes) + c)"
    new = f"if({mixed_unit(at, seed)} < {number(amount)}, if({mixed_unit(f'{at} + w * h * size(planes)', seed)} < {number(salt_vs_pepper)}, 255, 0), v)"
    return _with(df, f"transform(planes, (p, c) -> transform(p, (v, i) -> {new}))")


def coarse_dropout(df: DataFrame, holes=8, hole_size=(0.08, 0.08), fill=0, seed=0) -> DataFrame:
    """Rectangles by the same rule as the packed kernel, as an array column that samples look into."""
    u = lambda j: mixed_unit(f"(k * 4 + {j})", seed)
    hw, hh = (f"(cast({u(j)} * (greatest(1, ceil(round({float(s)!r}D * {n}, 9))) - 1) as int) + 1)" for j, s, n in ((0, hole_size[1], "w"), (1, hole_size[0], "h")))
    hole = f"named_struct('x', cast({u(2)} * greatest(0, w - {hw}) as int), 'y', cast({u(3)} * greatest(0, h - {hh}) as int), 'w', {hw}, 'h', {hh})"
    cut = df.withColumn("_holes", F.expr(f"transform(sequence(0, {holes} - 1), k -> {hole})"))
    inside = "exists(_holes, r -> i % w between r.x and r.x + r.w - 1 and i div w between r.y and r.y + r.h - 1)"
    return _with(cut, f"transform(planes, p -> transform(p, (v, i) -> if({inside}, {fill}, v)))").drop("_holes")


def mixed_normal(at: str, seed: int) -> str:
    """Standard normal numbers by position, as the packed kernels draw them."""
    return f"(sqrt(-2D * ln(1D - {mixed_unit(f'({at}) * 2', seed)})) * cos({2 * math.pi!r}D * {mixed_unit(f'({at}) * 2 + 1', seed)}))"


def gauss_noise(df: DataFrame, mean=0, std=10, seed=0) -> DataFrame:
    z = mixed_normal("cast(i as bigint) * size(planes) + c", seed)
    return _with(df, f"transform(planes, (p, c) -> transform(p, (v, i) -> cast(floor(least(greatest(v + {number(mean)} + {number(std)} * {z}, 0D), 255D) + 0.5D) as int)))")


def multiplicative_noise(df: DataFrame, multiplier=1, std=0.1, granularity="vector", block=8, seed=0) -> DataFrame:
    sample = "cast(i as bigint) * size(planes) + c"
    at = {"pixel": sample, "block": f"(i div w) div {block} * cast(ceil(w / {block}) as int) + (i % w) div {block}", "vector": f"({sample}) div 8"}[granularity if granularity in ("pixel", "block") else "vector"]
    factor = f"({number(multiplier)} + {number(std)} * {mixed_normal(at, seed)})"
    return _with(df, f"transform(planes, (p, c) -> transform(p, (v, i) -> cast(floor(least(greatest(v * {factor}, 0D), 255D) + 0.5D) as int)))")


def grid_dropout(df: DataFrame, ratio=0.5, unit_size=16, fill=0, seed=0) -> DataFrame:
    """The share of cells that come first in the order of their hashes, by each image's own size."""
    u = int(unit_size)
    cols = f"cast(ceil(w / {u}) as int)"
    cells = f"({cols} * cast(ceil(h / {u}) as int))"
    ranked = f"array_sort(transform(sequence(0, {cells} - 1), k -> named_struct('u', {mixed_unit('k', seed)}, 'k', k)))"
    gone = f"transform(slice({ranked}, 1, cast(ceil(round({cells} * {number(ratio)}, 9)) as int)), e -> e.k)"
    cut = df.withColumn("_gone", F.expr(gone))
    return _with(cut, f"transform(planes, p -> transform(p, (v, i) -> if(array_contains(_gone, cast((i div w) div {u} * {cols} + (i % w) div {u} as int)), {fill}, v)))").drop("_gone")


def _near(dx: int, dy: int) -> str:
    return _at(f"least(greatest({{x}} + {dx}, 0), w - 1)" if dx else "{x}", f"least(greatest({{y}} + {dy}, 0), h - 1)" if dy else "{y}")


def separable(df: DataFrame, taps: list[int], scale: int) -> DataFrame:
    """Rows, then columns, each pass truncated."""
    r = len(taps) // 2
    for step in ((1, 0), (0, 1)):
        total = " + ".join(f"{t} * {_near(step[0] * (k - r), step[1] * (k - r))}" for k, t in enumerate(taps) if t)
        df = _from(df, f"cast(least(({total}) div {scale}, 255) as int)")
    return df


def convolve(df: DataFrame, taps, scale: int = 1) -> DataFrame:
    """Integer sums truncate towards zero before the clip."""
    ry, rx = len(taps) // 2, len(taps[0]) // 2
    total = " + ".join(f"{number(t) if isinstance(t, float | Sql) else t} * {_near(i - rx, j - ry)}" for j, row in enumerate(taps) for i, t in enumerate(row) if t)
    part = f"({total}) div {scale}" if scale != 1 else f"floor({total})"
    return _from(df, f"cast(least(greatest({part}, 0), 255) as int)")


def box_blur(df: DataFrame, radius: int = 1) -> DataFrame:
    """Means over what the window holds of the image, by rows and then columns: two look-ups in running sums, whatever the radius.

    Sums along an axis double their reach step by step, so an axis of n takes as many passes as n - 1 has bits.
    """
    for n, at, step in (("w", "i % w", "1"), ("h", "(i div w)", "w")):
        back = "shiftleft(1, k - 1)"
        sums = f"aggregate(sequence(1, length(bin({n} - 1))), p, (s, k) -> transform(s, (v, i) -> if({at} >= {back}, v + get(s, i - {step} * {back}), v)))"
        size = f"(least({at} + {radius}, {n} - 1) - greatest({at} - {radius}, 0) + 1)"
        total = f"(get(s, cast(i + {step} * (least({at} + {radius}, {n} - 1) - {at}) as int)) - if({at} > {radius}, get(s, cast(i - {step} * ({radius} + 1) as int)), 0))"
        mean = f"cast(({total} + {size} div 2) div {size} as int)"
        df = _with(df, f"transform(planes, p -> transform(array({sums}), s -> transform(s, (v, i) -> {mean}))[0])")
    return df


def _triple(x: str, y: str, z: str, made: str) -> str:
    """SQL `made` over t, a struct of the least (l), middle (m) and greatest (g) of three."""
    ends = "least(e.x, e.y, e.z)", "greatest(e.x, e.y, e.z)"
    three = f"transform(array(named_struct('x', {x}, 'y', {y}, 'z', {z})), e -> named_struct('l', {ends[0]}, 'm', e.x + e.y + e.z - {ends[0]} - {ends[1]}, 'g', {ends[1]}))"
    return f"transform({three}, t -> {made})[0]"


def median_blur(df: DataFrame, kernel_size: int = 3) -> DataFrame:
    """3x3: columns of three are ordered once and shared by three windows; the median is the middle of the greatest least, the middle middle and the least greatest."""
    if kernel_size == 3:
        columns = f"transform(sequence(0, w * h - 1), i -> {_triple('get(p, i - if(i < w, 0, w))', 'get(p, i)', 'get(p, i + if(i >= w * h - w, 0, w))', 't')})"
        sides = "get(q, i - if(i % w = 0, 0, 1))", "get(q, i)", "get(q, i + if(i % w = w - 1, 0, 1))"
        low, high = (f"{f}({', '.join(f'{s}.{c}' for s in sides)})" for f, c in (("greatest", "l"), ("least", "g")))
        middle = _triple(*(f"{s}.m" for s in sides), "t.m")
        return _with(df, f"transform(planes, p -> transform(array({columns}), q -> transform(sequence(0, w * h - 1), i -> {_triple(low, middle, high, 't.m')}))[0])")
    r = kernel_size // 2
    taps = ", ".join(_near(i, j) for j in range(-r, r + 1) for i in range(-r, r + 1))
    return _from(df, f"element_at(sort_array(array({taps})), {kernel_size**2 // 2 + 1})")


def sobel(df: DataFrame) -> DataFrame:
    gx, gy = (" + ".join(f"{t} * {_near(i - 1, j - 1)}" for j, row in enumerate(k) for i, t in enumerate(row) if t) for k in (T.SOBEL_X, T.SOBEL_Y))
    edge = f"cast(least(floor(sqrt(cast(({gx}) * ({gx}) + ({gy}) * ({gy}) as double)) + 0.5D), 255) as int)"
    return _from(df, f"if(least(w, h) < 3, {_at('{x}', '{y}')}, {edge})")


def best_grid(max_tiles: int = 6):
    """A struct with the columns c and rows r that tables.select_grid takes for w and h."""
    rows = ", ".join(f"named_struct('c', {c}, 'r', {r})" for c, r in T.grids(max_tiles))
    error = "round(abs(ln(w / h) - ln(g.c / g.r)), 5)"
    return F.expr(f"array_min(transform(array({rows}), g -> named_struct('e', {error}, 'm', -g.c * g.r, 'c', g.c, 'r', g.r)))")


def any_res(df: DataFrame, tile_size: int = 448, max_tiles: int = 6, include_thumbnail: bool = True) -> DataFrame:
    """(image_id, tile, w, h, planes): grid choice is a minimum over a small literal array, tiles are an explode."""
    g = df.withColumn("_g", best_grid(max_tiles)).withColumn("tile", F.expr(f"explode(sequence(0, _g.c * _g.r - {0 if include_thumbnail else 1}))"))
    s = str(tile_size)
    place = {k: f"if(tile < _g.c * _g.r, {at}, 0) * {s}" for k, at in (("x", "tile % _g.c"), ("y", "tile div _g.c"))}
    new = {k: f"if(tile < _g.c * _g.r, _g.{n} * {s}, {s})" for k, n in (("x", "c"), ("y", "r"))}
    return _blended(g, _axis(s, "w", new["x"], place["x"]), _axis(s, "h", new["y"], place["y"]), s, s).drop("_g")


def chosen(df: DataFrame, on: str, then, otherwise=lambda df: df) -> DataFrame:
    """then(df) in rows where `on` holds, otherwise(df) in the others; rows stay rows, and only what a row takes is computed for it."""
    columns, k = [c for c in df.columns if c not in OTHERS], len(df.columns)  # k tells choices within choices apart
    old, new = {c: f"_{c}{k}" for c in ("w", "h", "planes")}, {c: f"_{c}{k}_" for c in ("w", "h", "planes")}
    one = then(df.withColumns({o: F.col(c) for c, o in old.items()})).withColumnsRenamed(new)
    two = otherwise(one.withColumnsRenamed({o: c for c, o in old.items()}))
    return two.selectExpr(*(f"`{c}`" for c in columns), *(f"if({on}, {new[c]}, {c}) as {c}" for c in ("w", "h", "planes")))


def drawn_table(df: DataFrame, op: Op) -> DataFrame:
    """A table operation whose parameters are columns: its formula, in the 32-bit steps of the tables."""
    p, f = op.params, lambda x: f"cast({x} as float)"
    clip = "cast(floor(least(greatest({}, 0), 255)) as int)"
    formula = {
        "brightness": lambda: clip.format(f"{f('v')} + {f(p['delta'])}"),
        "contrast": lambda: clip.format(f"({f('v')} - {f(128)}) * {f(p['factor'])} + {f(128)}"),
        "gamma": lambda: clip.format(f"{f(255)} * {f(f'pow({f("v / 255D")}, {f(p["gamma"])})')}"),
        "posterize": lambda: f"shiftleft(shiftright(v, 8 - {p['bits']}), 8 - {p['bits']})",
        "solarize": lambda: f"if(v >= {p['threshold']}, 255 - v, v)",
        "rgb_shift": lambda: clip.format(f"{f('v')} + element_at(array({', '.join(f(p[k]) for k in ('r_shift', 'g_shift', 'b_shift'))}, {f(0)}), least(c, 3) + 1)"),
    }[op.name]()
    return _with(df, f"transform(planes, (p, c) -> transform(p, v -> {formula}))")


def drawn_matrix(df: DataFrame, op: Op) -> DataFrame:
    """A diagonal matrix whose parameters are columns."""
    if op.name == "color_balance":
        return scale_channels(df, op["r_scale"], op["g_scale"], op["b_scale"])
    t = f"({number(op['temperature'])} / 100)"
    warm, cold = Sql(f"1 + if({t} >= 0, 0.1D, 0.15D) * {t}"), Sql(f"1 - 0.2D * {t}")
    return scale_channels(df, warm, warm, cold)


def drawn_emboss(df: DataFrame, direction, alpha, strength) -> DataFrame:
    """Taps as T.emboss builds them, from columns."""
    a, b = number(alpha), number(strength)
    signs = T.emboss(direction, 1.0, 1.0)  # 256 for each step along the rise

    def tap(x: int, y: int) -> str | int:
        if x == y == 1:
            return f"cast(({a} + (1 - {a})) * 256 as int)"
        along = signs[y][x] // 256
        return f"cast({a} * ({abs(along)} - 1 + {b}) * {1 if along > 0 else -1} * 256 as int)" if along else 0

    return convolve(df, [[tap(x, y) for x in range(3)] for y in range(3)], 256)


def apply_drawn(df: DataFrame, op: Op, on: str = "true") -> DataFrame:
    """One operation with parameters that are columns (Sql)."""
    p = op.params
    if op.name in POINTWISE_TABLE:
        return drawn_table(df, op)
    match op.name:
        case "color_temperature" | "color_balance":
            return drawn_matrix(df, op)
        case "hue_saturation_value" if isinstance(p["hue_shift"], Sql):
            return chosen(df, f"{p['hue_shift']} = 0", lambda d: saturation_value(d, p["saturation_scale"], p["value_scale"]), lambda d: hue_saturation_value(d, **p))
        case "random_crop":
            slack = {k: f"({n} - {p[m]})" for k, n, m in (("x", "w", "width"), ("y", "h", "height"))}
            return crop(df, *(f"least(cast({number(p['f' + k])} * ({slack[k]} + 1) as int), {slack[k]})" for k in "xy"), p["width"], p["height"], on)
        case "crop":
            return crop(df, p["x"], p["y"], p["width"], p["height"], on)
        case "sharpen":
            k = p["strength"]
            return convolve(df, [[0, Sql(f"-{k}"), 0], [Sql(f"-{k}"), Sql(f"1 + 4 * {k}"), Sql(f"-{k}")], [0, Sql(f"-{k}"), 0]])
        case "emboss":
            return drawn_emboss(df, **p)
        case "grid_dropout":
            return grid_dropout(df, p["ratio"], p["unit_size"], p["fill"], p["seed"])
        case "hue_saturation_value" | "auto_contrast" | "pad" | "resize" | "affine" | "box_blur" | "gauss_noise" | "multiplicative_noise" | "salt_and_pepper" | "coarse_dropout":
            return globals()[op.name](df, **p)
    raise ValueError(f"{op.name} takes no drawn parameters on planes; run it on packed images")


def apply(df: DataFrame, op: Op, on: str = "true") -> DataFrame:
    """One operation; random crops take the operation's own anchors."""
    p = op.params
    if op.name in ("crop", "random_crop") or any(isinstance(v, Sql) for v in p.values()):
        return apply_drawn(df, op, on)
    if (t := tables(op)) is not None:
        return lookup(df, t)
    if op.name == "channel_shuffle":
        return shuffle_channels(df, p["order"])
    if (m := matrix(op)) is not None:
        plain = all(not m[i][j] for i in range(3) for j in range(3) if i != j)
        return scale_channels(df, m[0][0], m[1][1], m[2][2]) if plain else mix(df, m)
    if e := square(op):
        return turn(df, e)
    match op.name:
        case "gaussian_blur":
            return separable(df, *T.gauss_taps(p["kernel_size"]))
        case "gaussian_blur_sigma":
            if p["quality"] == "fast" and p["sigma"] > 4:
                for _ in range(3):
                    df = box_blur(df, max(1, round(p["sigma"] * 0.94)))
                return df
            return separable(df, *T.sigma_taps(p["sigma"]))
        case "sharpen":
            return convolve(df, [[float(v) for v in row] for row in T.sharpen(p["strength"])])
        case "emboss":
            return convolve(df, T.emboss(**p), 256)
        case "edge_detection":
            return convolve(df, T.LAPLACIAN) if p["method"] in ("laplacian", "prewitt") else sobel(df)
        case "grid_dropout":
            return grid_dropout(df, p["ratio"], p["unit_size"], p["fill"], p["seed"])
        case _:
            return globals()[op.name](df, **p)


def run(df: DataFrame, stages) -> DataFrame:
    for op in stages:
        df = apply(df, op)
    return df
