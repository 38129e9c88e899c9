"""Operators across images: MixUp, CutMix, Mosaic, over planes with a label column.

What is mixed with what is a table of its own, the mix plan (PLAN), made from
ids and sizes alone: it can be stored, read again and run on the images by joins,
also as a sequence of steps.  Partners come from a rank of the ids and a keyed
permutation of the ranks.  The rank is distributed: ids fall into ranges by
fixed bounds, every range counts, and a row's rank is what its range starts at
plus its place in it, so no task sorts more than one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import unit_column
from ..functions.permute import permuted_column
from ..functions.tables import beta_table
from .labels import mix_labels

#: Rows of a range, about.
RANGE = 1_000_000
#: A row for each image that a step makes: the others that go into it (for mosaic all four, in order), its share of the mixture, the rectangle pasted over it.
PLAN = "step int, op string, image_id long, members array<long>, share double, x0 int, y0 int, x1 int, y1 int"


def ranked(df: DataFrame, key: str = "image_id") -> tuple[DataFrame, int]:
    """((key, rank from 0), number of rows); keys are unique."""
    ids = df.select(key)
    n = ids.count()
    ranges = max(1, -(-n // RANGE))
    cuts = ids.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first().c if ranges > 1 else []
    part = sum(((F.col(key) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    dealt = ids.withColumn("_part", part)
    starts, at = [], 0
    sizes = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    for k in range(ranges):
        starts.append(at)
        at += sizes.get(k, 0)
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("_part") + 1)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.select(key, (start + place - 1).cast("long").alias("rank")), n


def partners(df: DataFrame, seed: int, alpha: float = 1.0, key: str = "image_id") -> DataFrame:
    """(key, rank, partner, share) of every row; share is drawn from Beta(alpha, alpha).

    A keyed permutation puts the ranks in a circle, and a row's partner is the
    next on it: everyone is partner of one row, nobody of itself (one image
    alone is, with a share of 1).
    """
    order, n = ranked(df, key)
    if n < 2:
        return order.withColumns({"partner": F.col(key), "share": F.lit(1.0)})
    share = F.element_at(F.lit(beta_table(alpha)), (F.floor(unit_column(seed, "share", key) * 1024) + 1).cast("int"))
    placed = order.withColumn("_place", F.expr(permuted_column("rank", n, seed, "partner")))
    other = placed.select(F.col(key).alias("partner"), ((F.col("_place") + n - 1) % n).alias("_place"))
    return placed.join(other, "_place").select(key, "rank", "partner", share.alias("share"))


def _rows(df: DataFrame, op: str, key: str, **given) -> DataFrame:
    """df as rows of a plan; columns that are not given are null."""
    named = [x.split(" ") for x in PLAN.split(", ")]
    value = {"step": F.lit(0), "op": F.lit(op), "image_id": F.col(key)} | given
    return df.select(*(value.get(n, F.lit(None)).cast(t).alias(n) for n, t in named))


def mix_up_plan(images: DataFrame, seed: int = 0, alpha: float = 1.0, key: str = "image_id") -> DataFrame:
    return _rows(partners(images, seed, alpha, key), "mix_up", key, members=F.array("partner"), share=F.col("share"))


def cut_mix_plan(images: DataFrame, seed: int = 0, alpha: float = 1.0, key: str = "image_id") -> DataFrame:
    """Rectangles of a share of the image's sides about a drawn middle, cut at its edges; images has w and h."""
    drawn = images.select(key, "w", "h").join(partners(images, seed, alpha, key), key)
    side = {k: F.floor(F.sqrt(F.col("share")) * F.col(n)) for k, n in (("x", "w"), ("y", "h"))}
    low = {k: F.floor(unit_column(seed, f"cut/{k}", key) * F.col(n)) - F.floor(side[k] / 2) for k, n in (("x", "w"), ("y", "h"))}
    ends = {f"{k}0": F.greatest(low[k], F.lit(0)) for k in "xy"} | {f"{k}1": F.least(low[k] + side[k], F.col(n)) for k, n in (("x", "w"), ("y", "h"))}
    return _rows(drawn, "cut_mix", key, members=F.array("partner"), share=F.col("share"), **ends)


def mosaic_plan(images: DataFrame, seed: int = 0, alpha: float = 1.0, key: str = "image_id") -> DataFrame:
    """Groups of four by rank; the last incomplete one makes nothing."""
    order, _ = ranked(images, key)
    groups = order.groupBy(F.floor(F.col("rank") / 4).alias("_group")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("id")))).alias("g")).where("size(g) = 4")
    return _rows(groups.withColumn(key, F.expr("g[0].id")), "mosaic", key, members=F.expr("transform(g, e -> e.id)"))


PLANNERS = {"mix_up": mix_up_plan, "cut_mix": cut_mix_plan, "mosaic": mosaic_plan}


def mix_plan(images: DataFrame, stages: list[str], seed: int = 0, alpha: float = 1.0, key: str = "image_id") -> DataFrame:
    """The plan of a sequence of mixing operators over images (key, w, h, ...): step k draws by seed + k over what step k - 1 makes.  No pixel is read."""
    ids, steps = images.select(key, "w", "h"), []
    for k, name in enumerate(stages):
        steps.append(PLANNERS[name](ids, seed + k, alpha, key).withColumn("step", F.lit(k)))
        if name == "mosaic":
            ids = ids.join(steps[-1].select(F.col("image_id").alias(key)), key, "left_semi")
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def _paired(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Each image beside its partner: two joins on ids."""
    b = df.select(F.col(key).alias("_partner"), *(F.col(c).alias(f"_{c}") for c in ("w", "h", "planes", "label")))
    step = plan.select(F.col("image_id").alias(key), F.expr("members[0]").alias("_partner"), *(F.col(c).alias(f"_{c}") for c in ("share", "x0", "y0", "x1", "y1")))
    return df.join(step, key).join(b, "_partner")


def _run_mix_up(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    planes = "zip_with(planes, _planes, (p, q) -> zip_with(p, q, (a, b) -> cast(floor(_share * a + (1 - _share) * b + 0.5D) as int)))"
    return _paired(df, plan, key).select(*(c for c in df.columns if c not in ("planes", "label")), F.expr(planes).alias("planes"), mix_labels("label", "_label", "_share").alias("label"))


def _run_cut_mix(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    both = _paired(df, plan, key).withColumn("_own", F.expr("1 - cast((_x1 - _x0) * (_y1 - _y0) as double) / (w * h)"))
    planes = "zip_with(planes, _planes, (p, q) -> transform(p, (v, i) -> if(i % w >= _x0 and i % w < _x1 and i div w >= _y0 and i div w < _y1, get(q, i), v)))"
    return both.select(*(c for c in df.columns if c not in ("planes", "label")), F.expr(planes).alias("planes"), mix_labels("label", "_label", "_own").alias("label"))


def _run_mosaic(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    places = plan.select(F.col("image_id").alias("_first"), F.posexplode("members").alias("_at", key))
    four = df.join(places, key).groupBy("_first").agg(F.sort_array(F.collect_list(F.struct(F.col("_at"), F.col(key).alias("id"), "w", "h", "planes", "label"))).alias("g")).where("size(g) = 4")
    return tiles(four, key)


def tiles(four: DataFrame, key: str = "image_id") -> DataFrame:
    """One image from each row's g, four structs (id, w, h, planes, label): each at half size in a quadrant; labels concatenated."""
    w, h = "g[0].w", "g[0].h"
    hw, hh = f"({w} div 2)", f"({h} div 2)"
    x, y = f"(i % {w})", f"(i div {w})"
    quarter = f"if({y} >= {hh}, 2, 0) + if({x} >= {hw}, 1, 0)"
    inside = f"{x} < 2 * {hw} and {y} < 2 * {hh}"
    value = f"if({inside}, get(get(element_at(g, cast({quarter} as int) + 1).planes, c), cast(({y} % {hh}) * 2 * {w} + ({x} % {hw}) * 2 as int)), 0)"
    planes = f"transform(g[0].planes, (p, c) -> transform(p, (v, i) -> {value}))"
    return four.selectExpr(f"g[0].id as {key}", f"{w} as w", f"{h} as h", f"{planes} as planes", "flatten(transform(g, e -> e.label)) as label")


RUNS = {"mix_up": _run_mix_up, "cut_mix": _run_cut_mix, "mosaic": _run_mosaic}


def replayed(df: DataFrame, plan: DataFrame, key: str = "image_id") -> DataFrame:
    """df after the steps of a plan, each by joins on ids; images that a step's plan doesn't name go."""
    steps = sorted((r.step, r.op) for r in plan.select("step", "op").distinct().collect())  # a row a step
    for k, op in steps:
        df = RUNS[op](df, plan.where(F.col("step") == k), key)
    return df


def mix_up(df: DataFrame, alpha: float = 1.0, seed: int = 0, key: str = "image_id") -> DataFrame:
    """share of an image and the rest of its partner; labels alike.  Images have one size; one image alone stays."""
    return _run_mix_up(df, mix_up_plan(df, seed, alpha, key), key)


def cut_mix(df: DataFrame, alpha: float = 1.0, seed: int = 0, key: str = "image_id") -> DataFrame:
    """A rectangle of the partner pasted at the same place; labels by the area that it really has."""
    return _run_cut_mix(df, cut_mix_plan(df, seed, alpha, key), key)


def mosaic(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Four neighbours by rank, each at half size in a quadrant; labels concatenated; the last incomplete group is dropped."""
    return _run_mosaic(df, mosaic_plan(df, key=key), key)


class BatchPipeline:
    """Mixing operators one after another; a stage is a function (df, seed) -> df or one of "mix_up", "cut_mix", "mosaic"."""

    def __init__(self, stages, seed: int | None = None):
        self.stages, self.seed = list(stages), seed

    def set_seed(self, seed: int) -> None:
        self.seed = seed

    def clear_seed(self) -> None:
        self.seed = None

    def apply(self, df: DataFrame) -> DataFrame:
        from random import randrange

        seed = randrange(2**31) if self.seed is None else self.seed
        for k, s in enumerate(self.stages):
            f = {"mix_up": lambda d, n: mix_up(d, seed=n), "cut_mix": lambda d, n: cut_mix(d, seed=n), "mosaic": lambda d, n: mosaic(d)}.get(s, s)
            df = f(df, seed + k)
        return df
