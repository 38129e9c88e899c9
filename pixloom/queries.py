"""Queries that apply each operator to images of the given tables, with DuckDB SQL.

The Spark side works on planes (one image a row); the SQL side joins and groups
single samples, so that the two share no formulation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import draws as D
from .functions import tables as T
from .functions.permute import permuted_sql
from .operators import catalyst as C
from .operators import drawn as R
from .operators import labels as L
from .operators import mixing as M
from .operators import packed as P
from .operators.targets import annotated
from .plans.pipeline import Choice, Compose, Identity, Maybe, SomeOf, Transform, color_jitter
from .plans.planner import plan
from .plans.program import Op, Program
from .schema import packed_to_planes, pixels, planes_to_packed
from .sources import arrays
from .sources import images as S
from .sources import stored
from .streaming.streams import LABELLED as LABELLED_IMAGES
from .streaming.streams import mosaic_stream, write_stream

SEED = 7
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_E = "e as (select vec_id, unnest(embedding) as e, unnest(range(64)) as p from embeddings), g as (select vec_id, (p // 8)::int as y, (p % 8)::int as x, floor(least(greatest((e::double + 1) * 127.5, 0), 255))::int as v from e)"
GRAY = f"with {_E}, px as materialized (select vec_id as image_id, 0 as c, y, x, v from g)"
RGB = f"with {_E}, whole as (select vec_id // 3 as image_id from embeddings group by 1 having count(*) = 3), px as materialized (select vec_id // 3 as image_id, (vec_id % 3)::int as c, y, x, v from g where vec_id // 3 in (select image_id from whole))"
WIDE = ", wide as materialized (select image_id, y, x, max(case when c = 0 then v end) as r, max(case when c = 1 then v end) as g, max(case when c = 2 then v end) as b from px group by all)"
CLIP = "floor(least(greatest({}, 0), 255))::int"
OUT = "image_id, c, y, x, v"


def _add(name: str, make, sql: str | None = None) -> None:
    _Q[name] = make
    if sql:
        _SQL[name] = sql


def _image(name: str, op, sql: str | None, source=S.rgb) -> None:
    """op: planes -> planes, or an Op."""
    f = (lambda df: C.apply(df, op)) if isinstance(op, Op) else op
    _add(name, lambda spark, d: pixels(f(source(spark, d))), sql)


def _values(v: str, source: str = RGB) -> str:
    return f"{source} select image_id, c, y, x, ({v})::int as v from px"


def _lookup(table: list[int]) -> str:
    return f"([{', '.join(map(str, table))}])[v + 1]"


# --- tables -----------------------------------------------------------------
_image("brightness", Op("brightness", {"delta": 30}), _values("least(255, v + 30)"))
_image("contrast", Op("contrast", {"factor": 1.5}), _values(CLIP.format("(v - 128) * 1.5 + 128")))
_image("gamma", Op("gamma", {"gamma": 0.7}), _values(_lookup(T.gamma(0.7))))
_image("invert", Op("invert"), _values("255 - v"))
_image("posterize", Op("posterize", {"bits": 3}), _values("(v // 32) * 32"))
_image("solarize", Op("solarize", {"threshold": 120}), _values("case when v >= 120 then 255 - v else v end"))
_image("rgb_shift", Op("rgb_shift", {"r_shift": 20, "g_shift": -15, "b_shift": 5}), _values("greatest(0, least(255, v + ([20, -15, 5])[c + 1]))"))
CHAIN = Program([Op("brightness", {"delta": 30}), Op("contrast", {"factor": 1.2}), Op("invert"), Op("solarize", {"threshold": 100})])
_chain = CLIP.format("(least(255, v + 30) - 128) * 1.2 + 128")
_image("lut_chain", lambda df: C.run(df, plan(CHAIN).stages), f"{RGB}, a as (select image_id, c, y, x, 255 - {_chain} as v from px) select image_id, c, y, x, case when v >= 100 then 255 - v else v end as v from a")

# --- histograms -------------------------------------------------------------
_hist = ", hist as (select image_id, c, v, count(*) as n from px group by all), cum as (select image_id, c, v, sum(n) over (partition by image_id, c order by v) as s, first_value(n) over (partition by image_id, c order by v) as n0, sum(n) over (partition by image_id, c) as total from hist)"
_eq = "case when total = n0 then v else floor(255.0::double * (s - n0) / (total - n0) + 0.5)::int end"
_image("equalize", Op("equalize"), f"{RGB}{_hist} select px.image_id, px.c, y, x, {_eq.replace(' v ', ' cum.v ')} as v from px join cum on px.image_id = cum.image_id and px.c = cum.c and px.v = cum.v")
_image("equalize_lut", lambda df: C.run(df, plan(Program([Op("equalize"), Op("invert")])).stages), f"{RGB}{_hist} select px.image_id, px.c, y, x, 255 - {_eq.replace(' v ', ' cum.v ')} as v from px join cum on px.image_id = cum.image_id and px.c = cum.c and px.v = cum.v")
_ends = ", ends as (select image_id, min(v) as lo, max(v) as hi from px group by image_id)"
_stretch = "case when lo >= hi then 0 else least(255, greatest(v - lo, 0) * 255 // (hi - lo)) end"
_image("auto_contrast", Op("auto_contrast"), f"{RGB}{_ends} select px.image_id, c, y, x, ({_stretch})::int as v from px join ends using (image_id)")
_image("auto_contrast_cutoff", Op("auto_contrast", {"cutoff": 0.1}), f"{RGB}, s as (select image_id, list_sort(list(v)) as s from px group by image_id), ends as (select image_id, s[20] as lo, s[173] as hi from s) select px.image_id, c, y, x, ({_stretch})::int as v from px join ends using (image_id)")

# --- colour -----------------------------------------------------------------


def _matrix_sql(m) -> str:
    rows = " union all ".join(f"select image_id, {k} as c, y, x, {CLIP.format(' + '.join(f'{float(w)!r}::double * {ch}' for w, ch in zip(row, 'rgb', strict=True)))} as v from wide" for k, row in enumerate(m))
    return f"{RGB}{WIDE} {rows}"


for _n, _op in {
    "to_sepia": Op("to_sepia"), "color_temperature": Op("color_temperature", {"temperature": 40}), "color_temperature_cool": Op("color_temperature", {"temperature": -40}), "color_balance": Op("color_balance", dict(zip(("r_scale", "g_scale", "b_scale"), T.BALANCES["warm"], strict=True))),
    "color_tint": Op("color_tint", {"tint": T.TINTS["vintage"]}), "channel_mix": Op("channel_mix", {"matrix": "vintage"}),
}.items():
    from .plans.program import matrix as _matrix

    _image(_n, _op, _matrix_sql(_matrix(_op)))
_image("channel_shuffle", Op("channel_shuffle", {"order": "BRG"}), f"{RGB} select image_id, ([1, 2, 0])[c + 1] as c, y, x, v from px")
_image("to_gray", Op("to_gray"), f"{RGB}{WIDE} select image_id, 0 as c, y, x, ((77 * r + 150 * g + 29 * b + 128) // 256)::int as v from wide")
_image("to_rgb", Op("to_rgb"), f"{GRAY} select image_id, k as c, y, x, v from px cross join (select unnest([0, 1, 2]) as k)", S.gray)
_image("hsv_satval", Op("hue_saturation_value", {"saturation_scale": 0.6, "value_scale": 0.9}), f"{RGB}{WIDE} " + " union all ".join(f"select image_id, {k} as c, y, x, floor({0.6 * 0.9!r}::double * {ch} + {0.9 * (1 - 0.6)!r}::double * greatest(r, g, b) + 0.5)::int as v from wide" for k, ch in enumerate("rgb")))
_hexcone = "select *, mp + case when top > low then cp * ({ch} - low) / (top - low) else 0 end as o from (select *, vp - cp as mp from (select *, case when top > 0 then least(vp * (top - low) * 1.4::double / top, vp) else 0 end as cp from (select *, greatest(r, g, b) as top, least(r, g, b) as low, least(greatest(r, g, b) * 1.1::double, 255) as vp from wide)))"
_image("hsv_satval_exact", Op("hue_saturation_value", {"saturation_scale": 1.4, "value_scale": 1.1}), f"{RGB}{WIDE} " + " union all ".join(f"select image_id, {k} as c, y, x, floor(least(greatest(o, 0), 255) + 0.5)::int as v from ({_hexcone.format(ch=ch)})" for k, ch in enumerate("rgb")))
_add("normalize", lambda spark, d: pixels(C.normalize(S.rgb(spark, d), 0.45, 0.25)).withColumn("v", F.round(F.col("v").cast("double"), 5)), f"{RGB} select image_id, c, y, x, round((((v / 255.0::double) - 0.45::double) / 0.25::double)::float::double, 5) as v from px")
_image("matrix_chain", lambda df: C.run(df, plan(Program([Op("to_sepia"), Op("color_tint", {"tint": T.TINTS["warm"]})]), fuse_matrices=True).stages), _matrix_sql(__import__("numpy").array(T.tint(T.TINTS["warm"])).dot(__import__("numpy").array(T.SEPIA)).tolist()))

# --- noise and dropout --------------------------------------------------------
_step = "(({k} * 1103515245 + 12345) % 65536 * 32768 + ({k} * 1103515245 + 12345) % 2147483648 // 65536)"


def _mixed_sql(at: str, seed: int) -> str:
    k = f"((({at})::bigint * 7919 + {seed}) % 2147483648)"
    for _ in range(4):
        k = f"({_step.format(k=k)})"
    return f"({k} / 2147483648.0::double)"


_pos = "((y * 8 + x) * 3 + c)"
_image("salt_and_pepper", Op("salt_and_pepper", {"amount": 0.2, "seed": SEED}), _values(f"case when {_mixed_sql(_pos, SEED)} < 0.2::double then case when {_mixed_sql(_pos + ' + 192', SEED)} < 0.5::double then 255 else 0 end else v end"))
_u = {j: _mixed_sql(f"k * 4 + {j}", SEED) for j in range(4)}
_holes = f", ends as (select k, ({_u[0]} * 2)::double as a, ({_u[1]} * 1)::double as b from (select unnest(range(3)) as k)), sized as (select k, floor(a)::int + 1 as hw, floor(b)::int + 1 as hh from ends), holes as (select hw, hh, floor({_u[2]} * (8 - hw))::int as hx, floor({_u[3]} * (8 - hh))::int as hy from sized)"
_image("coarse_dropout", Op("coarse_dropout", {"holes": 3, "hole_size": (0.25, 0.375), "seed": SEED}), f"{RGB}{_holes} select image_id, c, y, x, case when exists (select 1 from holes where px.x between hx and hx + hw - 1 and px.y between hy and hy + hh - 1) then 0 else v end as v from px")
_cells = f", cells as (select k, row_number() over (order by {_mixed_sql('k', SEED)}, k) as n from (select unnest(range(16)) as k)), gone as (select k from cells where n <= ceil(16 * 0.4))"
_image("grid_dropout", Op("grid_dropout", {"ratio": 0.4, "unit_size": 2, "seed": SEED}), f"{RGB}{_cells} select image_id, c, y, x, case when (y // 2) * 4 + x // 2 in (select k from gone) then 0 else v end as v from px")


def _normal_sql(at: str, seed: int) -> str:
    return f"(sqrt(-2 * ln(1 - {_mixed_sql(f'({at}) * 2', seed)})) * cos(2 * pi() * {_mixed_sql(f'({at}) * 2 + 1', seed)}))"


def _noised(value: str) -> str:
    return _values(f"floor(least(greatest({value}, 0), 255) + 0.5)")


_image("gauss_noise", Op("gauss_noise", {"std": 12, "seed": SEED}), _noised(f"v + 12 * {_normal_sql(_pos, SEED)}"))
for _n, _at in {"pixel": _pos, "block": "(y // 4) * 2 + x // 4", "vector": f"{_pos} // 8"}.items():
    _image(f"multiplicative_noise_{_n}", Op("multiplicative_noise", {"multiplier": 1.1, "granularity": _n, "block": 4, "seed": SEED}), _noised(f"v * (1.1::double + 0.1::double * {_normal_sql(_at, SEED)})"))
_add("gauss_noise_packed", lambda spark, d: pixels(S.unpacked(P.transform(S.packed(S.rgb(spark, d)), Program([Op("gauss_noise", {"std": 12, "seed": SEED})])))), _SQL["gauss_noise"])
_hsv = (
    ", q1 as (select *, greatest(r, g, b) as t, greatest(r, g, b) - least(r, g, b) as d from wide), "
    "q2 as (select *, 60 * (case when d = 0 then 0 when t = r then (g - b) / d::double when t = g then (b - r) / d::double + 2 else (r - g) / d::double + 4 end) + 60 as raw from q1), "
    f"q3 as (select *, raw - 360 * floor(raw / 360) as hue, least((t * 256 + 128) // 256, 255) as val, least(((case when t > 0 then least(255, d * 256 // t) else 0 end) * {int(1.2 * 256)} + 128) // 256, 255) as sat from q2), "
    "q4 as (select *, val * sat as ch, least(floor(hue / 60), 5)::int as k, (val * sat * (255 - floor(abs(hue / 60 - 2 * floor(hue / 120) - 1) * 255)::int) + 128) // 256 as m from q3) "
)
_sector = {0: "[ch, m, 0, 0, m, ch]", 1: "[m, ch, ch, m, 0, 0]", 2: "[0, 0, m, ch, ch, m]"}
_hue_sql = f"{RGB}{WIDE}{_hsv}" + " union all ".join(f"select image_id, {c} as c, y, x, (case when ch = 0 then val else least(greatest((({parts})[k + 1] + val * 256 - ch) // 256, 0), 255) end)::int as v from q4" for c, parts in _sector.items())
HUE = Op("hue_saturation_value", {"hue_shift": 60, "saturation_scale": 1.2})
_image("hue_shift", HUE, _hue_sql)
_add("hue_shift_packed", lambda spark, d: pixels(S.unpacked(P.transform(S.packed(S.rgb(spark, d)), Program([HUE])))), _hue_sql)

# --- geometry -----------------------------------------------------------------


def _map(x: str, y: str, source: str = RGB) -> str:
    return f"{source} select image_id, c, ({y})::int as y, ({x})::int as x, v from px"


def _gather(w: int, h: int, x: str, y: str, fill: str | None = None) -> str:
    """An output grid joined to the samples that it comes from."""
    grid = f", grid as (select i, k, ({x})::int as sx, ({y})::int as sy from (select unnest(range({w})) as i) cross join (select unnest(range({h})) as k)), o as (select distinct image_id, c from px)"
    value = "px.v" if fill is None else f"coalesce(px.v, {fill})"
    return f"{RGB}{grid} select o.image_id, o.c, k::int as y, i::int as x, {value} as v from o cross join grid {'left ' if fill else ''}join px on px.image_id = o.image_id and px.c = o.c and px.x = sx and px.y = sy"


_image("hflip", Op("horizontal_flip"), _map("7 - x", "y"))
_image("vflip", Op("vertical_flip"), _map("x", "7 - y"))
_image("transpose", Op("transpose"), _map("y", "x"))
_image("rotate90", Op("rotate", {"angle": 90}), _map("7 - y", "x"))
_image("rotate180", Op("rotate", {"angle": 180}), _map("7 - x", "7 - y"))
_image("rotate270", Op("rotate", {"angle": "270"}), _map("y", "7 - x"))
D4 = Program([Op("horizontal_flip"), Op("rotate", {"angle": 90}), Op("vertical_flip"), Op("transpose")])
_image("d4_chain", lambda df: C.run(df, plan(D4).stages), f"{RGB}, a as (select image_id, c, y, 7 - x as x, v from px), b as (select image_id, c, x as y, 7 - y as x, v from a), d as (select image_id, c, 7 - y as y, x, v from b) select image_id, c, x::int as y, y::int as x, v from d")
_image("crop", Op("crop", {"x": 1, "y": 2, "width": 5, "height": 4}), f"{RGB} select image_id, c, y - 2 as y, x - 1 as x, v from px where x between 1 and 5 and y between 2 and 5")
HOIST = Program([Op("brightness", {"delta": 30}), Op("contrast", {"factor": 1.2}), Op("horizontal_flip"), Op("crop", {"x": 1, "y": 1, "width": 6, "height": 5})])
_image("crop_hoist", lambda df: C.run(df, plan(HOIST).stages), f"{RGB}, a as (select image_id, c, y, 7 - x as x, {_chain} as v from px) select image_id, c, y - 1 as y, x - 1 as x, v from a where x between 1 and 6 and y between 1 and 5")
_ux, _uy = (D.unit_sql(SEED, f"crop/{k}") for k in "xy")
_image("random_crop", lambda df: C.random_crop(df, 5, 4, SEED), f"{RGB}, o as (select image_id, least(floor({_ux} * 4), 3)::int as ox, least(floor({_uy} * 5), 4)::int as oy from whole) select image_id, c, y - oy as y, x - ox as x, v from px join o using (image_id) where x >= ox and x < ox + 5 and y >= oy and y < oy + 4")
_mirror = "case when {0} < 0 then -({0}) - 1 when {0} > 7 then 15 - ({0}) else {0} end"
for _mode, _x, _y in (("reflect", _mirror.format("(i - 2)"), _mirror.format("(k - 1)")), ("replicate", "least(7, greatest(0, i - 2))", "least(7, greatest(0, k - 1))"), ("wrap", "(i + 6) % 8", "(k + 7) % 8")):
    _image(f"pad_{_mode}", Op("pad", {"top": 1, "right": 3, "bottom": 2, "left": 2, "mode": _mode}), _gather(13, 11, _x, _y))
_image("pad_constant", Op("pad", {"top": 1, "right": 3, "bottom": 2, "left": 2, "mode": "constant", "value": 9}), _gather(13, 11, "i - 2", "k - 1", "9"))
_image("resize_nearest", Op("resize", {"width": 5, "height": 13, "interpolation": "nearest"}), _gather(5, 13, "i * 8 // 5", "k * 8 // 13"))


def _bilinear(w: int, h: int, source: str = RGB, x0="0", y0="0", gw=None, gh=None, extra="") -> str:
    gw, gh = gw or w, gh or h
    axis = lambda n, g, at: f"select {at} as i, greatest(0, least(7, floor(s)))::int as a, least(7, greatest(0, least(7, floor(s)))::int + 1) as b, case when s < 0 or s >= 7 then 0 else s - floor(s) end as f from (select i, ({at} + 0.5::double) * (8 / {g}::double) - 0.5 as s from (select unnest(range({n})) as i))"
    corners = ", ".join(f"max(case when px.x = {x} and px.y = {y} then v end) as v{k}" for k, (x, y) in enumerate((("ax.a", "ay.a"), ("ax.b", "ay.a"), ("ax.a", "ay.b"), ("ax.b", "ay.b"))))
    blend = "v0 * (1 - fx) * (1 - fy) + v1 * fx * (1 - fy) + v2 * (1 - fx) * fy + v3 * fx * fy"
    return f"{source}, ax as ({axis(w, gw, 'i')}), ay as ({axis(h, gh, 'i')}), t as (select image_id, c, ay.i as y, ax.i as x, any_value(ax.f) as fx, any_value(ay.f) as fy, {corners} from ax, ay, px where px.x in (ax.a, ax.b) and px.y in (ay.a, ay.b) group by image_id, c, ay.i, ax.i) select image_id, c, y::int as y, x::int as x, floor({blend} + 0.5)::int as v from t"


_image("resize_bilinear", Op("resize", {"width": 12, "height": 5}), _bilinear(12, 5))
_a, _b, _c, _d, _e, _f = T.inverse_affine(8, 8, 1.25, 30.0, (1, -1), (5, 0))
_fx = "floor((floor(({b!r}::double * k + {c!r}::double) * 65536 + 0.5) + i * {a} + 32768) / 65536)"
_image("affine_nearest", Op("affine", {"scale": 1.25, "rotate": 30.0, "translate": (1, -1), "shear": (5, 0), "interpolation": "nearest", "value": 3}), _gather(8, 8, _fx.format(a=int(__import__("math").floor(_a * 65536 + 0.5)), b=_b, c=_c), _fx.format(a=int(__import__("math").floor(_d * 65536 + 0.5)), b=_e, c=_f), "3"))
_a, _b, _c, _d, _e, _f = T.inverse_affine(8, 8, 1.0, 20.0, (0, 0), (0, 0))
_fixed = lambda b, c, a: f"floor(({b!r}::double * k + {c!r}::double) * 65536 + 0.5)::bigint + i * {__import__('math').floor(a * 65536 + 0.5)}"
_fold = lambda x: f"(case when (({x}) % 16 + 16) % 16 >= 8 then 15 - (({x}) % 16 + 16) % 16 else (({x}) % 16 + 16) % 16 end)"
_corner = " union all ".join(f"select i, k, {_fold(f'(sx >> 16) + {p}')} as px, {_fold(f'(sy >> 16) + {q}')} as py, {'fx' if p else '(256 - fx)'} * {'fy' if q else '(256 - fy)'} as share from spot" for p in (0, 1) for q in (0, 1))
_affine_sql = (
    f"{RGB}, raw as (select i, k, {_fixed(_b, _c, _a)} as sx, {_fixed(_e, _f, _d)} as sy from (select unnest(range(8)) as i) cross join (select unnest(range(8)) as k)), "
    f"spot as (select *, (sx >> 8) & 255 as fx, (sy >> 8) & 255 as fy from raw), taps as ({_corner}) "
    "select image_id, c, k::int as y, i::int as x, ((sum(v * share) + 32768)::bigint >> 16)::int as v from taps join px on px.x = taps.px and px.y = taps.py group by image_id, c, k, i"
)
_image("affine_bilinear", Op("affine", {"rotate": 20.0, "border_mode": "reflect"}), _affine_sql)
_add("anyres_grid", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40 + 200).alias("w"), (F.col("p_partkey") % 900 + 100).cast("int").alias("h")).withColumn("g", C.best_grid(6)).selectExpr("image_id", "w", "h", "g.c as cols", "g.r as rows"),
     "with i as (select p_partkey as image_id, (p_size * 40 + 200)::int as w, (p_partkey % 900 + 100)::int as h from part), g as (select c::int as c, r::int as r from (select unnest(range(1, 7)) as c) cross join (select unnest(range(1, 7)) as r) where c * r <= 6), s as (select image_id, w, h, c, r, row_number() over (partition by image_id order by round(abs(ln(w / h::double) - ln(c / r::double)), 5), c * r desc, c) as n from i cross join g) select image_id, w, h, c as cols, r as rows from s where n = 1")
_tile = " union all ".join(f"select image_id, {2 * r + q} as tile, c, y - {4 * r} as y, x - {4 * q} as x, v from big where y between {4 * r} and {4 * r + 3} and x between {4 * q} and {4 * q + 3}" for r in (0, 1) for q in (0, 1))
_small = _bilinear(4, 4).split("px as materialized", 1)[1].split("), ax as", 1)[1]
_add("anyres_tiles", lambda spark, d: _tiled_pixels(C.any_res(S.rgb(spark, d), 4, 4)), f"{RGB}, big as (select * from px), small as (with ax as{_small}) {_tile} union all select image_id, 4 as tile, c, y, x, v from small")


def _tiled_pixels(df: DataFrame) -> DataFrame:
    flat = df.select("image_id", "tile", "w", F.posexplode("planes").alias("c", "p")).select("image_id", "tile", "w", "c", F.posexplode("p").alias("i", "v"))
    return flat.selectExpr("image_id", "tile", "c", "cast(i div w as int) as y", "cast(i % w as int) as x", "v")


# --- neighbourhoods -----------------------------------------------------------


def _sums(taps, name: str = "px", out: str = "s") -> str:
    """Sums of taps (dx, dy, weight) over neighbours, edges repeated."""
    rows = ", ".join(f"({x}, {y}, {k})" for x, y, k in taps)
    return f"select p.image_id, p.c, p.y, p.x, sum(t.k * n.v) as {out} from {name} p cross join (values {rows}) t(dx, dy, k) join {name} n on n.image_id = p.image_id and n.c = p.c and n.y = greatest(0, least(7, p.y + t.dy)) and n.x = greatest(0, least(7, p.x + t.dx)) group by all"


def _grid(rows) -> list:
    return [(i - len(row) // 2, j - len(rows) // 2, k) for j, row in enumerate(rows) for i, k in enumerate(row) if k]


def _separable_sql(taps, scale: int) -> str:
    r = len(taps) // 2
    across, down = [(k - r, 0, t) for k, t in enumerate(taps)], [(0, k - r, t) for k, t in enumerate(taps)]
    return f"{RGB}, s1 as ({_sums(across)}), a as materialized (select image_id, c, y, x, (s // {scale})::int as v from s1), s2 as ({_sums(down, 'a')}) select image_id, c, y, x, (s // {scale})::int as v from s2"


for _k in (3, 5, 7):
    _image(f"gaussian{_k}", Op("gaussian_blur", {"kernel_size": _k}), _separable_sql(*T.GAUSS[_k]))
_image("gaussian_sigma", Op("gaussian_blur_sigma", {"sigma": 1.8}), _separable_sql(*T.sigma_taps(1.8)))
_box = "select p.image_id, p.c, p.y, p.x, ((sum(n.v) + count(*) // 2) // count(*))::int as v from {0} p join {0} n on n.image_id = p.image_id and n.c = p.c and n.{1} = p.{1} and n.{2} between p.{2} - 2 and p.{2} + 2 group by all"
_image("box_blur", Op("box_blur", {"radius": 2}), f"{RGB}, a as materialized ({_box.format('px', 'y', 'x')}) {_box.format('a', 'x', 'y')}")
_three, _wide = [], _box.replace("- 2", "- 4").replace("+ 2", "+ 4")  # three boxes of radius round(0.94 * 4.5)
for _k in range(6):
    _three.append(f"b{_k} as materialized ({_wide.format(f'b{_k - 1}' if _k else 'px', *(('y', 'x'), ('x', 'y'))[_k % 2])})")
_image("gaussian_sigma_fast", Op("gaussian_blur_sigma", {"sigma": 4.5, "quality": "fast"}), f"{RGB}, {', '.join(_three)} select image_id, c, y, x, v from b5")
for _k in (3, 5):
    _taps = ", ".join(f"({i}, {j})" for j in range(-(_k // 2), _k // 2 + 1) for i in range(-(_k // 2), _k // 2 + 1))
    _image(f"median{_k}", Op("median_blur", {"kernel_size": _k}), f"{RGB} select p.image_id, p.c, p.y, p.x, (list_sort(list(n.v)))[{_k * _k // 2 + 1}]::int as v from px p cross join (values {_taps}) t(dx, dy) join px n on n.image_id = p.image_id and n.c = p.c and n.y = greatest(0, least(7, p.y + dy)) and n.x = greatest(0, least(7, p.x + dx)) group by p.image_id, p.c, p.y, p.x")
_image("sharpen", Op("sharpen", {"strength": 0.5}), f"{RGB}, s as ({_sums(_grid(T.sharpen(0.5)))}) select image_id, c, y, x, {CLIP.format('s')} as v from s")
_image("emboss", Op("emboss", {"direction": "bottom_left", "alpha": 0.6}), f"{RGB}, s as ({_sums(_grid(T.emboss('bottom_left', 0.6, 0.5)))}) select image_id, c, y, x, greatest(0, least(255, trunc(s / 256.0)))::int as v from s")
_image("laplacian", Op("edge_detection", {"method": "laplacian"}), f"{RGB}, s as ({_sums(_grid(T.LAPLACIAN))}) select image_id, c, y, x, greatest(0, least(255, s))::int as v from s")
_image("sobel", Op("edge_detection"), f"{RGB}, a as ({_sums(_grid(T.SOBEL_X), out='gx')}), b as ({_sums(_grid(T.SOBEL_Y), out='gy')}) select image_id, c, y, x, least(255, floor(sqrt((gx * gx + gy * gy)::double) + 0.5))::int as v from a join b using (image_id, c, y, x)")

# --- labels -------------------------------------------------------------------
W, H = 120, 100
_BOX = f"select l_orderkey as image_id, l_linenumber as box_no, {W} as w, {H} as h, (l_partkey % 90)::double as a, (l_suppkey % 70)::double as b, (l_partkey % 25 + 5)::double as c, (l_linenumber * 4)::double as d, l_returnflag as tag from lineitem"
_POINT = f"select l_orderkey as image_id, l_linenumber as point_no, {W} as w, {H} as h, (l_partkey % {W})::double as x, (l_suppkey % {H})::double as y, (l_linenumber % 3)::int as v, l_returnflag as tag from lineitem"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as image_id", "l_linenumber as box_no", f"{W} as w", f"{H} as h", "cast(l_partkey % 90 as double) as a", "cast(l_suppkey % 70 as double) as b", "cast(l_partkey % 25 + 5 as double) as c", "cast(l_linenumber * 4 as double) as d", "l_returnflag as tag")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as image_id", "l_linenumber as point_no", f"{W} as w", f"{H} as h", f"cast(l_partkey % {W} as double) as x", f"cast(l_suppkey % {H} as double) as y", "cast(l_linenumber % 3 as int) as v", "l_returnflag as tag")


_BSQL = f"with b as ({_BOX}), q as (select image_id, box_no, w, h, a as x, b as y, c as bw, d as bh, tag from b)"


def _box(name: str, op: Op, new: dict, where: str = "true") -> None:
    cols = {"x": "x", "y": "y", "bw": "bw", "bh": "bh", "w": "w", "h": "h"} | new
    said = ", ".join(f"({e})::{'int' if k in 'wh' else 'double'} as {k}" for k, e in cols.items())
    _add(name, lambda spark, d: _round6(L.move_boxes(L.read_boxes(_boxes(spark, d)), op), "x", "y", "bw", "bh"), f"{_BSQL}, m as (select image_id, box_no, tag, {said} from q) select image_id, box_no, tag, w, h, {', '.join(f'round({k}, 6) as {k}' for k in ('x', 'y', 'bw', 'bh'))} from m where {where}")


def _round6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _point(name: str, op: Op, new: dict, where: str = "true") -> None:
    cols = {"x": "x", "y": "y", "w": "w", "h": "h"} | new
    said = ", ".join(f"({e})::{'int' if k in 'wh' else 'double'} as {k}" for k, e in cols.items())
    _add(name, lambda spark, d: _round6(L.move_points(_points(spark, d), op), "x", "y"), f"with p as ({_POINT}), m as (select image_id, point_no, v, tag, {said} from p) select image_id, point_no, v, tag, w, h, round(x, 6) as x, round(y, 6) as y from m where {where}")


_add("bbox_formats", lambda spark, d: _round6(L.write_boxes(L.read_boxes(_boxes(spark, d), "pascal_voc"), "yolo"), *"abcd"), f"with b as ({_BOX}) select image_id, box_no, w, h, tag, round((a + (c - a) / 2) / w, 6) as a, round((b + (d - b) / 2) / h, 6) as b, round((c - a) / w, 6) as c, round((d - b) / h, 6) as d from b")
_add("bbox_formats_center", lambda spark, d: _round6(L.write_boxes(L.read_boxes(_boxes(spark, d), "cxcywh"), "albumentations"), *"abcd"), f"with b as ({_BOX}) select image_id, box_no, w, h, tag, round((a - c / 2) / w, 6) as a, round((b - d / 2) / h, 6) as b, round((a + c / 2) / w, 6) as c, round((b + d / 2) / h, 6) as d from b")
_add("keypoint_formats", lambda spark, d: _round6(L.write_points(L.read_points(_points(spark, d).withColumnsRenamed({"x": "a", "y": "b", "v": "s"}), "xyv", ("a", "b", "s")), "rel_xyv", ("a", "b", "s")), "a", "b"), f"with p as ({_POINT}) select image_id, point_no, w, h, tag, round(x / w, 6) as a, round(y / h, 6) as b, v as s from p")
_box("bbox_hflip", Op("horizontal_flip"), {"x": "w - (x + bw)"})
_box("bbox_vflip", Op("vertical_flip"), {"y": "h - (y + bh)"})
_box("bbox_transpose", Op("transpose"), {"x": "y", "y": "x", "bw": "bh", "bh": "bw", "w": "h", "h": "w"})
_box("bbox_rotate90", Op("rotate", {"angle": 90}), {"x": "h - (y + bh)", "y": "x", "bw": "bh", "bh": "bw", "w": "h", "h": "w"})
_box("bbox_rotate180", Op("rotate", {"angle": 180}), {"x": "w - (x + bw)", "y": "h - (y + bh)"})
_box("bbox_rotate270", Op("rotate", {"angle": 270}), {"x": "y", "y": "w - (x + bw)", "bw": "bh", "bh": "bw", "w": "h", "h": "w"})
_box("bbox_crop", Op("crop", {"x": 20, "y": 15, "width": 60, "height": 50}), {"x": "greatest(x - 20, 0)", "y": "greatest(y - 15, 0)", "bw": "least(x + bw - 20, 60) - greatest(x - 20, 0)", "bh": "least(y + bh - 15, 50) - greatest(y - 15, 0)", "w": "60", "h": "50"}, "bw > 0 and bh > 0")
_box("bbox_random_crop", Op("random_crop", {"width": 60, "height": 50, "fx": 0.4, "fy": 0.7}), {"x": "greatest(x - 24, 0)", "y": "greatest(y - 35, 0)", "bw": "least(x + bw - 24, 60) - greatest(x - 24, 0)", "bh": "least(y + bh - 35, 50) - greatest(y - 35, 0)", "w": "60", "h": "50"}, "bw > 0 and bh > 0")
_box("bbox_pad", Op("pad", {"top": 3, "left": 5, "right": 7, "bottom": 1}), {"x": "x + 5", "y": "y + 3", "w": "w + 12", "h": "h + 4"})
_box("bbox_resize", Op("resize", {"width": 60, "height": 150}), {"x": "x / 2", "y": "y * 1.5", "bw": "bw / 2", "bh": "bh * 1.5", "w": "60", "h": "150"})
_cos, _sin = 0.8, 0.6
_rot = __import__("math").degrees(__import__("math").atan2(0.6, 0.8))
_px = "(0.8 * ({0} - 60) + 0.6 * ({1} - 50) + 60)"
_py = "(-0.6 * ({0} - 60) + 0.8 * ({1} - 50) + 50)"
_cx, _cy = ([f.format(x, y) for x in ("x", "(x + bw)") for y in ("y", "(y + bh)")] for f in (_px, _py))
_box("bbox_affine", Op("affine", {"rotate": _rot}), {"x": f"greatest(least({', '.join(_cx)}), 0)", "y": f"greatest(least({', '.join(_cy)}), 0)", "bw": f"least(greatest({', '.join(_cx)}), w) - greatest(least({', '.join(_cx)}), 0)", "bh": f"least(greatest({', '.join(_cy)}), h) - greatest(least({', '.join(_cy)}), 0)"}, "bw > 0 and bh > 0")
_point("keypoint_hflip", Op("horizontal_flip"), {"x": "w - x"})
_point("keypoint_vflip", Op("vertical_flip"), {"y": "h - y"})
_point("keypoint_rotate90", Op("rotate", {"angle": 90}), {"x": "h - y", "y": "x", "w": "h", "h": "w"})
_point("keypoint_crop", Op("crop", {"x": 20, "y": 15, "width": 60, "height": 50}), {"x": "x - 20", "y": "y - 15", "w": "60", "h": "50"}, "x >= 0 and y >= 0 and x < 60 and y < 50")
_point("keypoint_pad", Op("pad", {"top": 3, "left": 5}), {"x": "x + 5", "y": "y + 3", "w": "w + 5", "h": "h + 3"})
_point("keypoint_resize", Op("resize", {"width": 60, "height": 150}), {"x": "x / 2", "y": "y * 1.5", "w": "60", "h": "150"})
_half = lambda f: f.format("(x + 0.5)", "(y + 0.5)")  # noqa: E731  (pixel centres)
_point("keypoint_affine", Op("affine", {"rotate": _rot}), {"x": f"{_half(_px)} - 0.5", "y": f"{_half(_py)} - 0.5"}, "x >= 0 and y >= 0 and x < w and y < h")
_point("keypoint_transpose", Op("transpose"), {"x": "y", "y": "x", "w": "h", "h": "w"})
LABELLED = Program([Op("brightness", {"delta": 9}), Op("horizontal_flip"), Op("rotate", {"angle": 90}), Op("pad", {"left": 4}), Op("resize", {"width": 52, "height": 60})])
_add("bbox_program", lambda spark, d: _round6(L.write_boxes(L.apply_to_boxes(L.read_boxes(_boxes(spark, d)), LABELLED), "xyxy"), *"abcd"), f"{_BSQL}, m as (select image_id, box_no, tag, (h - (y + bh) + 4) / 2 as x, (w - (x + bw)) / 2 as y, bh / 2 as bw, bw / 2 as bh from q) select image_id, box_no, tag, 52 as w, 60 as h, round(x, 6) as a, round(y, 6) as b, round(x + bw, 6) as c, round(y + bh, 6) as d from m")
MASKED = Program([Op("brightness", {"delta": 9}), Op("horizontal_flip"), Op("gaussian_blur"), Op("resize", {"width": 5, "height": 13})])
_add("mask_program", lambda spark, d: pixels(C.run(S.rgb(spark, d), MASKED.moves())), _gather(5, 13, "7 - i * 8 // 5", "k * 8 // 13"))

# --- draws, choices, clips ------------------------------------------------------
_dist = {"uniform": D.Uniform(-20, 30), "integer": D.UniformInt(1, 6), "bernoulli": D.Bernoulli(0.3), "normal": D.Normal(5, 2)}
_units = {k: (D.unit_sql(SEED, k, "vec_id"), D.unit_sql(SEED, k + "/2", "vec_id")) for k in _dist}
_add("draws", lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *(F.round(x.drawn(SEED, k, "vec_id").cast("double"), 6).alias(k) for k, x in _dist.items())),
     f"select vec_id, round(-20 + 50 * {_units['uniform'][0]}, 6) as uniform, round(1 + floor({_units['integer'][0]} * 6), 6) as integer, ({_units['bernoulli'][0]} < 0.3::double)::int::double as bernoulli, round(5 + 2 * sqrt(-2 * ln(1 - {_units['normal'][0]})) * cos(2 * pi() * {_units['normal'][1]}), 6) as normal from embeddings")


def _through(pipe: Compose, source=S.rgb):
    """The images after a random pipeline, on packed rows."""
    return lambda spark, d: pixels(S.unpacked(P.transform(S.packed(source(spark, d)), pipe, SEED)))


def _drawn(pipe: Compose, source=S.rgb):
    """The images after a random pipeline, on planes: draws and branches are columns."""
    return lambda spark, d: pixels(R.images(source(spark, d), pipe, SEED))


_roll = f"(4 * {D.unit_sql(SEED, '0/0/c')})"
_add("choice", _drawn(Compose([Choice([Transform("invert"), Transform("brightness", delta=40), Transform("solarize", threshold=100)], weights=[2, 1, 1])])), _values(f"case when {_roll} <= 2 then 255 - v when {_roll} <= 3 then least(255, v + 40) when v >= 100 then 255 - v else v end"))
_add("maybe", _drawn(Compose([Maybe(Transform("invert"), 0.5)]), S.gray), _values(f"case when {D.unit_sql(SEED, '0/0/p')} < 0.5::double then 255 - v else v end", GRAY))
_ranks = " + ".join(f"(case when u{j} < u{{k}} or (u{j} = u{{k}} and {j} < {{k}}) then 1 else 0 end)" for j in range(3))
_some = f", us as (select image_id, {', '.join(f'{D.unit_sql(SEED, f"0/0/s/{j}")} as u{j}' for j in range(3))} from whole), rk as (select image_id, {', '.join(f'{_ranks.format(k=k)} as r{k}' for k in range(3))} from us)"
_each = lambda v, at: f"(case when r0 = {at} then 255 - {v} when r1 = {at} then least(255, {v} + 40) else {v} // 32 * 32 end)"
_add("some_of", _drawn(Compose([SomeOf([Transform("invert"), Transform("brightness", delta=40), Transform("posterize", bits=3)], 2)])), f"{RGB}{_some}, one as (select px.*, r0, r1, r2, {_each('v', 0)} as v1 from px join rk using (image_id)) select image_id, c, y, x, {_each('v1', 1)}::int as v from one")
_add("identity", _drawn(Compose([Identity()])), _values("v"))
_jb, _jc = (f"(-{h!r}::double + {2 * h!r}::double * {D.unit_sql(SEED, f'0/0/{k}/{n}')})" for k, n, h in ((0, "delta", 51.0), (1, "factor", 0.2)))
_add("color_jitter", _drawn(Compose([color_jitter(brightness=0.2, contrast=0.2)])), f"{RGB}, a as (select image_id, c, y, x, floor(least(greatest(v::float + ({_jb})::float, 0), 255)) as v from px) select image_id, c, y, x, floor(least(greatest((v::float - 128::float) * (0.8::double + {_jc} + 0.2::double)::float + 128::float, 0), 255))::int as v from a")
PIPE = Compose([Maybe(Transform("horizontal_flip"), 0.5), Choice([Transform("brightness", delta=(-30, 30)), Transform("solarize", threshold=(60, 200))]), Transform("random_crop", width=6, height=6), Transform("gauss_noise", std=(2, 8), p=0.5)])
_pu = {k: D.unit_sql(SEED, f"0/{k}") for k in ("0/p", "1/c", "1/0/delta", "1/1/threshold", "2/fx", "2/fy", "3/p", "3/std", "3/seed")}
_seeded = f"(({_pos} * 2 + {{j}})::bigint * 7919 + sd) % 2147483648"


def _seeded_mix(j: int) -> str:
    k = f"({_seeded.format(j=j).replace('y', 'ny').replace(' x', ' nx').replace('* 8', '* 6')})"
    for _ in range(4):
        k = f"({_step.format(k=k)})"
    return f"({k} / 2147483648.0::double)"


_pipe_sql = (
    f"{RGB}, dr as materialized (select image_id, {_pu['0/p']} < 0.5::double as flip, {_pu['1/c']} * 2 <= 1 as bright, (-30 + 60 * {_pu['1/0/delta']})::float as delta, floor(60 + 140 * {_pu['1/1/threshold']} + 0.5)::int as th, "
    f"least(floor({_pu['2/fx']} * 3), 2)::int as ox, least(floor({_pu['2/fy']} * 3), 2)::int as oy, {_pu['3/p']} < 0.5::double as noisy, 2 + 6 * {_pu['3/std']} as std, floor({_pu['3/seed']} * 2147483648)::bigint % 1000003 as sd from whole), "
    "a as (select px.image_id, c, y, case when flip then 7 - x else x end as x, case when bright then floor(least(greatest(v::float + delta, 0), 255))::int when v >= th then 255 - v else v end as v from px join dr using (image_id)), "
    "b as materialized (select a.image_id, c, (y - oy)::int as ny, (x - ox)::int as nx, v, noisy, std, sd from a join dr using (image_id) where y >= oy and y < oy + 6 and x >= ox and x < ox + 6) "
    f"select image_id, c, ny as y, nx as x, case when noisy then floor(least(greatest(v + std * sqrt(-2 * ln(1 - {_seeded_mix(0)})) * cos(2 * pi() * {_seeded_mix(1)}), 0), 255) + 0.5)::int else v end as v from b"
)
_add("pipeline_packed", _through(PIPE), _pipe_sql)
_add("pipeline_planes", _drawn(PIPE), _pipe_sql)
_add("pipeline_programs", lambda spark, d: P.programs(S.packed(S.rgb(spark, d)), PIPE, SEED).selectExpr("image_id", "array_join(from_json(program, 'ops array<struct<op:string>>').ops.op, ',') as ops", "get_json_object(program, '$.version') as version"),
     f"{RGB} select image_id, concat_ws(',', case when {_pu['0/p']} < 0.5::double then 'horizontal_flip' end, case when {_pu['1/c']} * 2 <= 1 then 'brightness' else 'solarize' end, 'random_crop', case when {_pu['3/p']} < 0.5::double then 'gauss_noise' end) as ops, '2' as version from whole")
JOINT = Compose([Transform("brightness", delta=25), Maybe(Transform("horizontal_flip"), 0.5), Choice([Transform("rotate", angle=90), Transform("vertical_flip")]), Transform("random_crop", width=6, height=5)], bbox_format="pascal_voc", keypoint_format="rel_xyv")
_ju = {k: D.unit_sql(SEED, f"0/{k}") for k in ("1/p", "2/c", "3/fx", "3/fy")}
_joint = f", jd as materialized (select image_id, {_ju['1/p']} < 0.5::double as flip, {_ju['2/c']} * 2 <= 1 as turned, least(floor({_ju['3/fx']} * 3), 2)::int as ox, least(floor({_ju['3/fy']} * 4), 3)::int as oy from whole)"
_boxes_of = "array(array(cast(image_id % 4 as double), cast(image_id % 3 as double), cast(image_id % 4 + 3 as double), cast(image_id % 3 + 2 as double), 1D), array(2D, cast(image_id % 5 as double), cast(image_id % 4 + 4 as double), cast(image_id % 5 + 3 as double), 2D))"
_points_of = "array(array((image_id % 8) / 8D, (image_id % 7) / 8D, 2D, 1D), array(0.25D, (image_id % 6) / 8D, 1D, 2D))"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Images with boxes, points and a mask (the image's first bytes), all through one random program; packed in the JVM, so that a task has one Python process, not one a step."""
    images = planes_to_packed(S.rgb(spark, d)).selectExpr("*", f"{_boxes_of} as boxes", f"{_points_of} as points", "substring(data, 1, 64) as mask")
    return JOINT(images, SEED, boxes="boxes", points="points", masks="mask")


_bx = "select image_id, 1 as tag, (image_id % 4)::double as x, (image_id % 3)::double as y, 3::double as bw, 2::double as bh from whole union all select image_id, 2, 2, image_id % 5, image_id % 4 + 2, 3 from whole"
_boxed_sql = (
    f"{RGB}{_joint}, b0 as ({_bx}), b1 as (select b0.* exclude (x), case when flip then 8 - (x + bw) else x end as x, turned, ox, oy from b0 join jd using (image_id)), "
    "b2 as (select image_id, tag, ox, oy, case when turned then 8 - (y + bh) else x end as x, case when turned then x else 8 - (y + bh) end as y, case when turned then bh else bw end as bw, case when turned then bw else bh end as bh from b1), "
    "b3 as (select image_id, tag, greatest(x - ox, 0) as a, greatest(y - oy, 0) as b, least(x + bw - ox, 6) as c, least(y + bh - oy, 5) as d from b2) select image_id, tag, 6 as w, 5 as h, a, b, c, d from b3 where c > a and d > b"
)


def _flat(spark: SparkSession, d: str, of: str) -> DataFrame:
    """A row for each box or point of the images that `_joined` has."""
    return S.rgb(spark, d).select("image_id", "w", "h", F.explode(F.expr(of)).alias("e"))


_add("compose_labels", lambda spark, d: L.write_boxes(R.boxes(L.read_boxes(_flat(spark, d, _boxes_of).selectExpr("image_id", "w", "h", "cast(e[4] as int) as tag", "e[0] as a", "e[1] as b", "e[2] as c", "e[3] as d"), JOINT.bbox_format), JOINT, SEED), JOINT.bbox_format), _boxed_sql)
_add("compose_labels_packed", lambda spark, d: _joined(spark, d).select("image_id", "width", "height", F.explode("boxes").alias("e")).selectExpr("image_id", "cast(e[4] as int) as tag", "width as w", "height as h", "e[0] as a", "e[1] as b", "e[2] as c", "e[3] as d"), _boxed_sql)
_pt = "select image_id, 1 as tag, 2 as s, (image_id % 8)::double as x, (image_id % 7)::double as y from whole union all select image_id, 2, 1, 2, image_id % 6 from whole"
_points_sql = (
    f"{RGB}{_joint}, p0 as ({_pt}), p1 as (select p0.* exclude (x), case when flip then 8 - x else x end as x, turned, ox, oy from p0 join jd using (image_id)), "
    "p2 as (select image_id, tag, s, case when turned then 8 - y else x end - ox as x, case when turned then x else 8 - y end - oy as y from p1) select image_id, tag, s, round(x / 6, 6) as x, round(y / 5, 6) as y from p2 where x >= 0 and y >= 0 and x < 6 and y < 5"
)
_add("compose_keypoints", lambda spark, d: L.write_points(R.points(L.read_points(_flat(spark, d, _points_of).selectExpr("image_id", "w", "h", "cast(e[3] as int) as tag", "e[0] as a", "e[1] as b", "cast(e[2] as int) as s"), JOINT.keypoint_format, ("a", "b", "s")), JOINT, SEED), JOINT.keypoint_format, ("x", "y", "s")).selectExpr("image_id", "tag", "s", "round(x, 6) as x", "round(y, 6) as y"), _points_sql)
_add("compose_keypoints_packed", lambda spark, d: _joined(spark, d).select("image_id", F.explode("points").alias("e")).selectExpr("image_id", "cast(e[3] as int) as tag", "cast(e[2] as int) as s", "round(e[0], 6) as x", "round(e[1], 6) as y"), _points_sql)
_moved = "m1 as (select image_id, c, y, case when flip then 7 - x else x end as x, v, turned, ox, oy from m0 join jd using (image_id)), m2 as (select image_id, c, v, case when turned then 7 - y else x end - ox as x, case when turned then x else 7 - y end - oy as y from m1) select image_id, c, y::int as y, x::int as x, v from m2 where x between 0 and 5 and y between 0 and 4"
_add("compose_masks", lambda spark, d: pixels(packed_to_planes(_joined(spark, d).selectExpr("image_id", "width", "height", "1 as channels", "mask as data"))),
     f"{RGB}{_joint}, m0 as (select image_id, 0 as c, ((y * 8 + x) * 3 + c) // 8 as y, ((y * 8 + x) * 3 + c) % 8 as x, v from px where (y * 8 + x) * 3 + c < 64), {_moved}")
_add("compose_images", lambda spark, d: pixels(packed_to_planes(_joined(spark, d))), f"{RGB}{_joint}, m0 as (select image_id, c, y, x, least(255, v + 25) as v from px), {_moved}")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """The same programs, stored as JSON texts and replayed on images and boxes."""
    images = planes_to_packed(S.rgb(spark, d)).withColumn("boxes", F.expr(_boxes_of))
    stored = images.join(P.programs(images, JOINT, SEED), "image_id")
    done = annotated(stored, None, boxes="boxes", program="program", bbox_format="pascal_voc")
    return done.select("image_id", "width", "height", F.explode("boxes").alias("e")).selectExpr("image_id", "cast(e[4] as int) as tag", "width as w", "height as h", "e[0] as a", "e[1] as b", "e[2] as c", "e[3] as d")


_add("replayed_labels", _replayed, _boxed_sql)
CLIP_PIPE = Compose([Transform("brightness", delta=(-40, 40)), Maybe(Transform("horizontal_flip"), 0.5)])
_us, _uf = D.unit_sql(SEED, "0/0/delta", "(image_id // 8)"), D.unit_sql(SEED, "0/1/p", "(image_id // 8)")
_add("video_consistent", lambda spark, d: pixels(S.unpacked(P.transform_video(S.packed(S.clips(spark, d)).withColumn("clip_id", F.expr("image_id div 8")), CLIP_PIPE, SEED))),
     f"{GRAY} select image_id, c, y, (case when {_uf} < 0.5::double then 7 - x else x end)::int as x, floor(least(greatest(v::float + (-40 + 80 * {_us})::float, 0), 255))::int as v from px")

GRAYED = Program([Op("brightness", {"delta": 30}), Op("rgb_shift", {"r_shift": -40, "g_shift": 5, "b_shift": 60}), Op("to_gray")])
_shift = "greatest(0, least(255, least(255, {} + 30) + {}))"
_image("lut_gray", lambda df: C.run(df, plan(GRAYED, channels=3).stages), f"{RGB}{WIDE} select image_id, 0 as c, y, x, ((77 * {_shift.format('r', -40)} + 150 * {_shift.format('g', 5)} + 29 * {_shift.format('b', 60)} + 128) // 256)::int as v from wide")


def _array_files(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two sizes, by the id, to array files and back; one size is read."""
    images, path = S.packed(S.rgb(spark, d)), stored.folder(spark)
    cut = lambda k: P.transform(images.where(F.col("image_id") % 2 == k), Program([Op("crop", {"x": 1, "y": 2, "width": 5 - k, "height": 3 + k})]))
    arrays.write(cut(0).union(cut(1)), path)
    return pixels(S.unpacked(arrays.read(spark, path, filters=[("width", "=", 5), ("height", "<", 4)])))


_add("array_files", _array_files, f"{RGB} select image_id, c, (y - 2)::int as y, (x - 1)::int as x, v from px where image_id % 2 = 0 and x between 1 and 5 and y between 2 and 4")

# --- across images ----------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), L.one_hot("label", 10).alias("label"))
    return S.gray(spark, d).join(e, "image_id")


_BETA = ", ".join(map(str, T.beta_table(1.0)))
_circle = permuted_sql("(select r.k, n.n from r cross join n)", "k", "n", SEED, "partner")
_MIX = f", n as (select count(*) as n from embeddings), r as (select vec_id as image_id, label, row_number() over (order by vec_id) - 1 as k from embeddings), circle as materialized ({_circle}), placed as (select image_id, label, place from r join circle using (k)), plan as materialized (select r.image_id, r.label, o.image_id as partner, o.label as other, ([{_BETA}])[floor({D.unit_sql(SEED, 'share', 'r.image_id')} * 1024)::int + 1]::double as share from placed r cross join n join placed o on o.place = (r.place + 1) % n)"
_add("mixup", lambda spark, d: pixels(M.mix_up(_labelled(spark, d), 1.0, SEED)), f"{GRAY}{_MIX} select p.image_id, p.c, p.y, p.x, floor(share * p.v + (1 - share) * o.v + 0.5)::int as v from plan join px p using (image_id) join px o on o.image_id = partner and o.y = p.y and o.x = p.x")


def _soft(df: DataFrame) -> DataFrame:
    return df.select("image_id", F.posexplode("label").alias("class", "share")).withColumn("share", F.round("share", 6))


_class = "cross join (select unnest(range(10))::int as class)"
_add("mixup_labels", lambda spark, d: _soft(M.mix_up(_labelled(spark, d), 1.0, SEED)), f"{GRAY}{_MIX} select image_id, class, round(share * (label = class)::int + (1 - share) * (other = class)::int, 6) as share from plan {_class}")
_cut = f", cut as (select *, floor(sqrt(share) * 8)::int as side, floor({D.unit_sql(SEED, 'cut/x')} * 8)::int as mx, floor({D.unit_sql(SEED, 'cut/y')} * 8)::int as my from plan), rect as (select *, greatest(mx - side // 2, 0) as x0, least(mx - side // 2 + side, 8) as x1, greatest(my - side // 2, 0) as y0, least(my - side // 2 + side, 8) as y1 from cut)"
_add("cutmix", lambda spark, d: pixels(M.cut_mix(_labelled(spark, d), 1.0, SEED)), f"{GRAY}{_MIX}{_cut} select p.image_id, p.c, p.y, p.x, case when p.x >= x0 and p.x < x1 and p.y >= y0 and p.y < y1 then o.v else p.v end as v from rect join px p using (image_id) join px o on o.image_id = partner and o.y = p.y and o.x = p.x")
_own = "(1 - (x1 - x0) * (y1 - y0) / 64.0::double)"
_add("cutmix_labels", lambda spark, d: _soft(M.cut_mix(_labelled(spark, d), 1.0, SEED)), f"{GRAY}{_MIX}{_cut} select image_id, class, round({_own} * (label = class)::int + (1 - {_own}) * (other = class)::int, 6) as share from rect {_class}")
_add("mosaic", lambda spark, d: pixels(M.mosaic(_labelled(spark, d))), f"{GRAY}, r as (select vec_id as image_id, row_number() over (order by vec_id) - 1 as k, count(*) over () as n from embeddings), q as (select min(image_id) over (partition by k // 4) as first, image_id, (k % 4)::int as part from r where k // 4 < n // 4) select first as image_id, c, (y // 2 + (part // 2) * 4)::int as y, (x // 2 + (part % 2) * 4)::int as x, v from q join px using (image_id) where x % 2 = 0 and y % 2 = 0")


def _stored_mix(spark: SparkSession, d: str) -> DataFrame:
    """MixUp, then Mosaic, by a plan that was stored as files before."""
    images, path = _labelled(spark, d), stored.folder(spark)
    stored.write_plan(M.mix_plan(images, ["mix_up", "mosaic"], SEED), path)
    return pixels(M.replayed(images, stored.read_plan(spark, path)))


_mixed_px = "mixed as (select p.image_id, p.c, p.y, p.x, floor(share * p.v + (1 - share) * o.v + 0.5)::int as v from plan join px p using (image_id) join px o on o.image_id = partner and o.y = p.y and o.x = p.x)"
_fours = "q as (select min(image_id) over (partition by k // 4) as first, image_id, (k % 4)::int as part from r cross join n where k // 4 < n // 4)"
_add("mix_plan_replayed", _stored_mix, f"{GRAY}{_MIX}, {_mixed_px}, {_fours} select first as image_id, c, (y // 2 + (part // 2) * 4)::int as y, (x // 2 + (part % 2) * 4)::int as x, v from q join mixed using (image_id) where x % 2 = 0 and y % 2 = 0")
_add("mix_plan", lambda spark, d: M.cut_mix_plan(_labelled(spark, d), SEED).selectExpr("image_id", "members[0] as partner", "round(share, 6) as share", "x0", "y0", "x1", "y1"),
     f"{GRAY}{_MIX}{_cut} select image_id, partner, round(share, 6) as share, x0::int as x0, y0::int as y0, x1::int as x1, y1::int as y1 from rect")


def _streamed_mosaics(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream through lanes with state, to files."""
    path = f"{d}/embeddings.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's path can't be one file
    images = S.packed(S.gray_of(source)).withColumn("label", F.lit(None).cast("array<double>"))
    out = stored.folder(spark)
    write_stream(mosaic_stream(images, 8), f"{out}/images", f"{out}/state").awaitTermination()
    return pixels(S.unpacked(spark.read.schema(LABELLED_IMAGES).parquet(f"{out}/images")))


_lane = D.unit_sql(0, "lane", "vec_id")
_add("mosaic_stateful", _streamed_mosaics,
     f"{GRAY}, r as (select vec_id as image_id, floor({_lane} * 8)::int as lane, row_number() over (partition by floor({_lane} * 8)::int order by vec_id) - 1 as k, count(*) over (partition by floor({_lane} * 8)::int) as n from embeddings), q as (select min(image_id) over (partition by lane, k // 4) as first, image_id, (k % 4)::int as part from r where k // 4 < n // 4) select first as image_id, c, (y // 2 + (part // 2) * 4)::int as y, (x // 2 + (part % 2) * 4)::int as x, v from q join px using (image_id) where x % 2 = 0 and y % 2 = 0")
_add("soft_labels", lambda spark, d: _labelled(spark, d).select("image_id", L.top_class("label").alias("class")), "select vec_id as image_id, label as class from embeddings")


FLAGSHIP = Program([Op("brightness", {"delta": 30}), Op("contrast", {"factor": 1.2}), Op("horizontal_flip"), Op("crop", {"x": 1, "y": 1, "width": 6, "height": 5}), Op("invert")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planned chain over all images, and a checksum of each."""
    out = pixels(C.run(S.rgb(spark, sf_dir), plan(FLAGSHIP, channels=3).stages))
    return out.groupBy("image_id").agg(F.sum(F.expr("v * (c * 64 + y * 8 + x + 1)")).alias("checksum"), F.count("*").alias("samples"))


_add("flagship", flagship, f"{RGB}, a as (select image_id, c, y - 1 as y, 6 - x as x, 255 - {_chain} as v from px where y between 1 and 5 and x between 1 and 6) select image_id, sum(v * (c * 64 + y * 8 + x + 1))::bigint as checksum, count(*) as samples from a group by image_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
