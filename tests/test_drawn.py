"""Random pipelines compiled to columns draw and do what the packed path draws and does."""

import pytest

from pixloom.functions.draws import Bernoulli, Normal, UniformInt
from pixloom.operators import drawn, packed
from pixloom.plans.pipeline import Choice, Compose, Identity, Maybe, SomeOf, Transform, color_jitter
from pixloom.queries import queries
from pixloom.sources import images as S

SF = "/root/testdata/sf0.001"
T = Transform
PIPES = {
    "tables": [T("brightness", delta=(-90, 90)), T("contrast", factor=(0.2, 2.5)), T("gamma", gamma=(0.4, 2.2)), T("posterize", bits=(2, 7)), T("solarize", threshold=(40, 220), p=0.5), T("rgb_shift", r_shift=(-30, 30), g_shift=5, b_shift=(-60, 0))],
    "colours": [T("color_temperature", temperature=(-80, 80)), T("color_balance", r_scale=(0.5, 1.5), b_scale=(0.5, 1.5)), T("to_sepia", p=0.4), T("channel_shuffle", order="BRG", p=0.5), color_jitter(0.2, 0.3, 0.4, 0, p=0.7)],
    "hue": [T("hue_saturation_value", hue_shift=(-2, 2), saturation_scale=(0.5, 1.5), value_scale=(0.6, 1.4))],
    "histograms": [Choice([T("equalize"), T("auto_contrast", cutoff=(0.0, 0.2)), T("auto_contrast")])],
    "nested": [Maybe(Compose([T("invert"), SomeOf([T("horizontal_flip"), Choice([T("vertical_flip"), T("transpose"), Identity()], weights=[2, 0, 1]), T("brightness", delta=UniformInt(-9, 9))], 2)], p=0.8), 0.7), SomeOf([T("invert"), T("solarize")], 5, p=0.5)],
    "turns": [T("rotate", angle=(90, 90.2)), Maybe(T("rotate", angle=180), Bernoulli(0.5)), T("transpose", p=0.5)],
    "geometry": [T("pad", top=(0, 3), left=(1, 4), mode="wrap"), T("pad", right=(0, 2), mode="constant", value=7, p=0.5), T("random_crop", width=(4, 6), height=5), T("resize", width=(3, 9), height=(3, 9)), T("crop", x=(0, 1), y=0, width=2, height=3, p=0.5)],
    "affine": [T("affine", scale=(0.7, 1.4), rotate=(-40, 40), shear=(0, 15), interpolation="nearest")],
    "kernels": [T("gaussian_blur", kernel_size=UniformInt(3, 3)), T("box_blur", radius=(1, 3), p=0.5), T("sharpen", strength=(0.1, 1.5), p=0.5), T("emboss", alpha=(0.2, 0.8), strength=(0.2, 0.9)), T("median_blur", kernel_size=3, p=0.3)],
    "noise": [T("gauss_noise", mean=Normal(0, 2), std=(1, 20), p=0.6), T("multiplicative_noise", multiplier=(0.8, 1.2), std=(0.0, 0.2), granularity="pixel"), T("salt_and_pepper", amount=(0.0, 0.3)), T("coarse_dropout", holes=(1, 4), hole_size=(0.2, 0.4)), T("grid_dropout", ratio=(0.1, 0.9), unit_size=2)],
}


def rows(df):
    return {r.image_id: (r.w, r.h, [list(p) for p in r.planes]) for r in df.collect()}


def python_free(df):
    return "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PIPES)
def test_planes_equal_packed(spark, name):
    pipe, source = Compose(PIPES[name]), S.rgb(spark, SF)
    compiled = drawn.images(source, pipe, 11)
    assert python_free(compiled)
    got, want = rows(compiled), rows(S.unpacked(packed.transform(S.packed(source), pipe, 11)))
    assert got.keys() == want.keys() and len(got) > 100
    assert [k for k in got if got[k][:2] != want[k][:2]] == []
    off = [abs(a - b) for k in got for p, q in zip(got[k][2], want[k][2], strict=True) for a, b in zip(p, q, strict=True)]
    assert max(off) <= (0 if name != "affine" else 255) and sum(x > 0 for x in off) <= (0 if name != "affine" else len(off) // 1000)
    assert len({str(v) for v in got.values()}) > 100


def test_labels_follow_the_same_draws(spark):
    """Corners of a mask's box, by the compiled pipeline on images and on flat tables."""
    pipe = Compose([Maybe(T("horizontal_flip"), 0.5), Choice([T("rotate", angle=90), T("vertical_flip"), T("transpose")]), T("pad", top=(0, 3), left=(0, 5), mode="constant", value=0)])
    spots = spark.range(200).selectExpr("id as image_id", "13 as w", "12 as h", "cast(id % 13 as int) as px", "cast(id % 12 as int) as py")
    marked = spots.selectExpr("image_id", "w", "h", "array(transform(sequence(0, w * h - 1), i -> if(i = py * w + px, 255, 0))) as planes")
    images = {r.image_id: r for r in drawn.images(marked, pipe, 3).collect()}
    flat = drawn.boxes(spots.selectExpr("image_id", "w", "h", "cast(px as double) as x", "cast(py as double) as y", "1D as bw", "1D as bh"), pipe, 3)
    dots = drawn.points(spots.selectExpr("image_id", "w", "h", "px + 0.5D as x", "py + 0.5D as y", "2 as v"), pipe, 3)
    assert python_free(flat) and python_free(dots)
    for b, p in zip(sorted(flat.collect()), sorted(dots.collect()), strict=True):
        im = images[b.image_id]
        lit = [(i % im.w, i // im.w) for i, v in enumerate(im.planes[0]) if v]
        assert (im.w, im.h) == (b.w, b.h) == (p.w, p.h)
        assert (min(x for x, _ in lit), min(y for _, y in lit), max(x for x, _ in lit) + 1, max(y for _, y in lit) + 1) == (b.x, b.y, b.x + b.bw, b.y + b.bh)
        assert (p.x, p.y) == (b.x + b.bw / 2, b.y + b.bh / 2)


def test_boxes_that_a_drawn_window_leaves_nothing_of_go(spark):
    pipe = Compose([Maybe(T("random_crop", width=4, height=4), 0.5)])
    got = drawn.boxes(spark.range(300).selectExpr("id as image_id", "8 as w", "8 as h", "6D as x", "6D as y", "2D as bw", "2D as bh", "'t' as tag"), pipe, 1).collect()
    programs = {k: pipe.program(1, k) for k in range(300)}
    kept = {r.image_id for r in got}
    assert all(k in kept for k, p in programs.items() if not len(p)) and 0 < len(kept) < 300
    assert all((r.w, r.h) == (4, 4) for r in got if len(programs[r.image_id]))


def test_windows_that_leave_the_image(spark):
    large = Compose([Choice([Identity(), T("random_crop", width=9, height=9)], weights=[1, 0])])
    assert drawn.images(S.rgb(spark, SF), large, 1).count() > 100  # never taken, so no error
    with pytest.raises(Exception, match="leaves the image"):
        drawn.images(S.rgb(spark, SF), Compose([Maybe(T("random_crop", width=9, height=9), 0.5)]), 1).count()


def test_what_can_not_be_compiled(spark):
    with pytest.raises(ValueError, match="packed"):
        drawn.images(S.rgb(spark, SF), Compose([T("gaussian_blur_sigma", sigma=(1.0, 2.0))]), 1)
    with pytest.raises(ValueError, match="range"):
        drawn.Compiled(Compose([T("rotate", angle=Normal(90, 1))]))


@pytest.mark.parametrize("name", ["compose_masks", "compose_images", "compose_labels_packed", "compose_keypoints_packed"])
def test_one_python_process_a_task(spark, name):
    """Steps in Python one after another each take a process in every task: an executor's memory goes with their number."""
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
