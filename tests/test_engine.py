"""Kernels against the Catalyst expressions, the planner, pipelines, labels, sources and streams."""

import io
import math
import random

import numpy as np
import pytest

from pixloom import schema
from pixloom.functions import draws as D
from pixloom.functions import tables as T
from pixloom.operators import catalyst as C
from pixloom.operators import kernels as K
from pixloom.operators import labels as L
from pixloom.operators import mixing as M
from pixloom.operators import packed as P
from pixloom.operators import tiling
from pixloom.plans.pipeline import Choice, Compose, Identity, Maybe, SomeOf, Transform, color_jitter
from pixloom.plans.planner import plan
from pixloom.plans.program import Op, Program
from pixloom.sources import images as S
from pixloom.streaming import streams

RNG = np.random.default_rng(12345)
BOTH = [
    Op("brightness", {"delta": -40}), Op("contrast", {"factor": 1.7}), Op("gamma", {"gamma": 2.2}), Op("invert"), Op("posterize", {"bits": 2}), Op("solarize"), Op("rgb_shift", {"r_shift": 50, "b_shift": -70}),
    Op("to_sepia"), Op("color_temperature", {"temperature": 70}), Op("color_balance", {"r_scale": 1.5}), Op("color_tint", {"tint": T.TINTS["cool"]}), Op("channel_shuffle", {"order": "GBR"}), Op("channel_mix", {"matrix": "cool"}),
    Op("to_gray"), Op("hue_saturation_value", {"saturation_scale": 0.4}), Op("hue_saturation_value", {"saturation_scale": 1.8, "value_scale": 1.3}), Op("hue_saturation_value", {"hue_shift": -50, "saturation_scale": 0.7, "value_scale": 1.2}), Op("equalize"), Op("equalize", {"then": list(range(255, -1, -1))}), Op("auto_contrast"), Op("auto_contrast", {"cutoff": 0.2}),
    Op("salt_and_pepper", {"amount": 0.3, "seed": 5}), Op("coarse_dropout", {"holes": 4, "hole_size": (0.4, 0.3), "seed": 9}), Op("grid_dropout", {"unit_size": 3, "seed": 4}), Op("gauss_noise", {"mean": 3, "seed": 8}),
    *(Op("multiplicative_noise", {"std": 0.3, "granularity": g, "block": 4, "seed": 6}) for g in ("pixel", "block", "vector")), Op("gaussian_blur_sigma", {"sigma": 4.5, "quality": "fast"}),
    Op("horizontal_flip"), Op("vertical_flip"), Op("transpose"), Op("rotate"), Op("rotate", {"angle": 180}), Op("rotate", {"angle": 270}), Op("crop", {"x": 2, "y": 1, "width": 4, "height": 5}), Op("random_crop", {"width": 5, "height": 3, "fx": 0.7, "fy": 0.99}),
    *(Op("pad", {"top": 2, "right": 1, "bottom": 3, "left": 4, "mode": m, "value": 0}) for m in ("reflect", "replicate", "wrap", "constant")),
    *(Op("resize", {"width": 17, "height": 5, "interpolation": i}) for i in ("nearest", "bilinear")),
    *(Op("affine", {"rotate": 33.0, "scale": 1.3, "translate": (1, -2), "shear": (8, 3), "interpolation": i, "border_mode": b, "value": 7}) for i in ("nearest", "bilinear") for b in ("constant", "replicate", "reflect", "wrap")),
    *(Op("gaussian_blur", {"kernel_size": k}) for k in (3, 5, 7, 13)), Op("gaussian_blur_sigma", {"sigma": 2.2}), Op("box_blur", {"radius": 2}), Op("median_blur"), Op("median_blur", {"kernel_size": 5}), Op("sharpen", {"strength": 1.25}),
    *(Op("emboss", {"direction": d}) for d in T.RISES), Op("edge_detection"), Op("edge_detection", {"method": "laplacian"}),
]


def images(n=3, h=9, w=7, c=3):
    return [RNG.integers(0, 256, (h, w, c), dtype=np.uint8) for _ in range(n)]


def packed(spark, imgs):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes())) for k, a in enumerate(imgs)], schema.PACKED)


def arrays(df):
    return {r.image_id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.channels) for r in df.collect()}


def planes_of(df):
    return {r.image_id: np.array(r.planes, np.uint8).reshape(len(r.planes), r.h, r.w).transpose(1, 2, 0) for r in df.collect()}


@pytest.fixture(scope="module")
def three(spark):
    imgs = images()
    df = S.unpacked(packed(spark, imgs)).cache()
    df.count()
    return imgs, df


@pytest.mark.parametrize("op", BOTH, ids=str)
def test_kernel_equals_expression(three, op):
    imgs, df = three
    got = planes_of(C.apply(df, op))
    for k, a in enumerate(imgs):
        np.testing.assert_array_equal(got[k], K.apply(a, op))


def test_layouts_round_trip(spark, three):
    imgs, df = three
    assert all((arrays(S.packed(df))[k] == a).all() for k, a in enumerate(imgs))
    assert all((arrays(schema.planes_to_packed(df))[k] == a).all() for k, a in enumerate(imgs))
    assert all((planes_of(schema.packed_to_planes(packed(spark, imgs)))[k] == a).all() for k, a in enumerate(imgs))
    assert all((planes_of(schema.planes(schema.pixels(df)))[k] == a).all() for k, a in enumerate(imgs))


CHAIN = [Op("brightness", {"delta": 25}), Op("contrast", {"factor": 0.8}), Op("gamma", {"gamma": 1.4}), Op("invert"), Op("posterize", {"bits": 5}), Op("solarize"), Op("rgb_shift", {"g_shift": 33}), Op("equalize"), Op("auto_contrast"), Op("to_gray"), Op("channel_shuffle", {"order": 4}), Op("horizontal_flip"), Op("vertical_flip"), Op("transpose"), Op("rotate"), Op("gaussian_blur"), Op("sharpen"), Op("to_sepia"), Op("hue_saturation_value", {"hue_shift": 20})]


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_plans_change_nothing(channels):
    r = random.Random(12345)
    for _ in range(100):
        program = Program([r.choice(CHAIN) for _ in range(r.randint(2, 8))] + [Op("crop", {"x": 1, "y": 2, "width": 10, "height": 9})])
        img = RNG.integers(0, 256, (16, 16, channels), dtype=np.uint8)
        fused = plan(program, True, channels)
        np.testing.assert_array_equal(K.run(img, fused.stages), K.run(img, plan(program, False).stages), str(program))
        assert len(fused.stages) <= len(program)


def test_plan_shapes():
    fused = plan(Program([Op("brightness", {"delta": 10}), Op("invert"), Op("horizontal_flip"), Op("crop", {"width": 4, "height": 4}), Op("rotate"), Op("vertical_flip")]), channels=3)
    assert [o.name for o in fused.stages] == ["horizontal_flip", "crop", "square", "lut"]
    assert "operations" in fused.explain() and fused.mermaid().startswith("flowchart")
    assert not plan(Program([Op("horizontal_flip"), Op("horizontal_flip")])).stages
    assert not plan(Program([Op("invert"), Op("invert"), Op("brightness")])).stages
    assert plan(Program([Op("equalize"), Op("invert")])).stages[0].name == "equalize" and len(plan(Program([Op("equalize"), Op("invert")])).stages) == 1
    assert len(plan(Program([Op("to_sepia"), Op("color_balance", {"r_scale": 2})]), fuse_matrices=True).stages) == 1
    assert plan(Program([Op("resize", {"interpolation": "lanczos4"})])).notes


def test_symmetries_compose():
    img = RNG.integers(0, 256, (5, 8, 1), dtype=np.uint8)
    for a in T.SQUARE:
        for b in T.SQUARE:
            np.testing.assert_array_equal(K.turn(K.turn(img, a), b), K.turn(img, T.then(a, b)))
    np.testing.assert_array_equal(K.turn(img, "rotate90"), np.rot90(img, -1))
    np.testing.assert_array_equal(K.turn(img, "rotate270"), np.rot90(img))


def test_kernel_properties():
    flat = np.full((12, 12, 3), 77, np.uint8)
    for op in (Op("gaussian_blur", {"kernel_size": 7}), Op("gaussian_blur_sigma", {"sigma": 3.0}), Op("box_blur", {"radius": 3}), Op("median_blur"), Op("sharpen", {"strength": 2}), Op("affine", {"border_mode": "replicate", "rotate": 17.0})):
        assert abs(K.apply(flat, op).astype(int) - 77).max() <= 2  # each pass truncates
    assert not K.apply(flat, Op("edge_detection")).any() and not K.apply(flat, Op("auto_contrast")).any()
    spot = np.zeros((15, 15, 1), np.uint8)
    spot[7, 7] = 255
    out = K.apply(spot, Op("gaussian_blur_sigma", {"sigma": 2.0}))
    assert (out == out[::-1]).all() and (out == out[:, ::-1]).all()
    four = RNG.integers(0, 256, (4, 4, 4), dtype=np.uint8)
    assert (K.apply(four, Op("rgb_shift", {"r_shift": 9}))[..., 3] == four[..., 3]).all()
    assert K.apply(flat, Op("normalize", {"mean": 0.5, "std": 0.5})).dtype == np.float32
    x = RNG.integers(0, 256, (9, 9, 3), dtype=np.uint8)
    assert abs(K.apply(x, Op("hue_saturation_value", {"hue_shift": 360})).astype(int) - x).max() <= 4
    np.testing.assert_array_equal(K.apply(x, Op("gauss_noise", {"seed": 3})), K.apply(x, Op("gauss_noise", {"seed": 3})))
    big = np.full((200, 200, 1), 128, np.uint8)
    assert abs(K.apply(big, Op("gauss_noise", {"std": 10})).std() - 10) < 0.5
    assert abs((K.apply(big, Op("salt_and_pepper", {"amount": 0.1})) != 128).mean() - 0.1) < 0.01
    assert abs((K.apply(big, Op("grid_dropout", {"ratio": 0.5, "unit_size": 10})) == 0).mean() - 0.5) < 1e-9
    for g in ("pixel", "block", "vector"):
        assert K.apply(big, Op("multiplicative_noise", {"granularity": g})).std() > 5


@pytest.mark.parametrize("bad", [("brightness", {"delta": 300}), ("posterize", {"bits": 9}), ("gamma", {"gamma": 0}), ("contrast", {"factor": -1}), ("gaussian_blur", {"kernel_size": 4}), ("median_blur", {"kernel_size": 7}), ("rotate", {"angle": 45}), ("crop", {"x": 5, "width": 9}), ("random_crop", {"width": 99})])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        K.apply(images(1)[0], Op(*bad))


def test_programs_round_trip(tmp_path):
    p = Program([Op("affine", {"scale": (1.0, 2.0)}), Op("crop", {"width": 3, "height": 2}), Op("lut", {"table": [list(range(256))]}), Op("normalize")])
    assert Program.from_json(p.to_json()) == p == Program.from_bytes(p.to_bytes())
    p.save(str(tmp_path / "p.json"))
    assert Program.load(str(tmp_path / "p.json")) == p
    assert len(p[1:]) == 3 and p[0].name == "affine" and len(p + p) == 8 and "crop" in p.summary()
    assert p.moves()[0]["interpolation"] == "nearest" and len(p.moves()) == 2
    with pytest.raises(ValueError):
        Program.from_json('{"version": 1, "ops": []}')
    with pytest.raises(ValueError):
        Program([Op("normalize"), Op("invert")]).validate(9, 9)
    assert Program([Op("resize", {"width": 200, "height": 200}), Op("crop", {"x": 50, "y": 50})]).validate(10, 10) == (100, 100)
    with pytest.raises(TypeError):
        Op("invert", {"delta": 1})


def test_draws():
    n = 4000
    for d, mean, dev in ((D.Uniform(-1, 3), 1, 4 / math.sqrt(12)), (D.Normal(2, 0.5), 2, 0.5), (D.UniformInt(1, 6), 3.5, 1.708), (D.Bernoulli(0.3), 0.3, 0.458)):
        x = np.array([d.draw(1, "s", k) for k in range(n)])
        assert abs(x.mean() - mean) < 4 * dev / math.sqrt(n) and abs(x.std() - dev) < 0.05 * max(1, dev)
    assert D.Constant(2.9).integer(0, "s", 0) == 2 and D.distribution((1, 2)) == D.Uniform(1, 2)
    with pytest.raises(ValueError):
        D.Uniform(2, 1)
    with pytest.raises(ValueError):
        D.pick(0.5, [0, 0])
    counts = np.bincount([D.pick(D.unit(0, "c", k), [2, 1, 1]) for k in range(n)], minlength=3) / n
    assert abs(counts - [0.5, 0.25, 0.25]).max() < 0.03
    assert all(len(set(D.some(0, "s", k, 5, 3))) == 3 for k in range(50)) and len(D.some(0, "s", 1, 3, 9)) == 3


def test_draws_in_spark(spark):
    df = spark.range(50).select("id", *(d.drawn(3, "k", "id").cast("double").alias(n) for n, d in (("u", D.Uniform(0, 5)), ("i", D.UniformInt(0, 9)), ("n", D.Normal(0, 1)), ("b", D.Bernoulli(0.5)))))
    for r in df.collect():
        for n, d in (("u", D.Uniform(0, 5)), ("i", D.UniformInt(0, 9)), ("n", D.Normal(0, 1)), ("b", D.Bernoulli(0.5))):
            assert r[n] == pytest.approx(d.draw(3, "k", r.id))


def test_pipelines():
    pipe = Compose([Transform("brightness", delta=(-20, 20)), Maybe(Transform("invert"), 0.5), Identity(), SomeOf([Transform("horizontal_flip"), Transform("transpose"), Transform("equalize")], 2), Choice([Transform("gamma", gamma=2.0), Transform("solarize")], [1, 0])])
    assert pipe.program(1, 5) == pipe.program(1, 5) and pipe.program(1, 5) != pipe.program(1, 6)
    assert abs(np.mean([any(o.name == "invert" for o in pipe.program(0, k)) for k in range(600)]) - 0.5) < 0.07
    assert all(len(pipe.program(0, k)) in (4, 5) and pipe.program(0, k)[-1].name == "gamma" for k in range(30))
    assert len(pipe[1:3]) == 2 and len(pipe + Transform("invert")) == 6 and isinstance(pipe[0], Transform) and "brightness" in repr(pipe)
    assert not pipe.fixed() and Compose([Transform("invert"), Transform("crop", x=1, y=1, width=2, height=2)]).fixed()
    assert np.mean([len(Compose([Transform("invert")], p=0.25).program(0, k)) for k in range(800)]) == pytest.approx(0.25, abs=0.05)
    assert Transform("crop", x_min=1, y_min=2, x_max=5, y_max=8).sample(0, 0)[0].params == {"x": 1, "y": 2, "width": 4, "height": 6}
    assert Transform("rgb_shift", r=(3, 4)).sample(0, 0)[0]["r_shift"] >= 3
    assert [o.name for o in color_jitter(0.2, 0.2, 0.2, 10).sample(0, 0)] == ["brightness", "contrast", "hue_saturation_value"]
    for wrong in (lambda: Choice([]), lambda: Choice([Identity()], [1, 2]), lambda: Transform("nothing")):
        with pytest.raises(ValueError):
            wrong()


def test_packed_pipeline(spark):
    imgs = images(6, 16, 12)
    pipe = Compose([Transform("brightness", delta=(-50, 50)), Transform("random_crop", width=8, height=8), Transform("gauss_noise", std=5)])
    df = packed(spark, imgs).selectExpr("*", "image_id * 2 as note")
    one, two = arrays(P.transform(df, pipe, 3)), arrays(P.transform(df.repartition(3), pipe, 3))
    assert all((one[k] == two[k]).all() and one[k].shape == (8, 8, 3) for k in one)
    assert all((one[k] == K.run(a, pipe.program(3, k))).all() for k, a in enumerate(imgs))
    replayed = arrays(P.replay(df.join(P.programs(df, pipe, 3), "image_id").select(*df.columns, "program")))
    assert all((replayed[k] == one[k]).all() for k in one)
    assert P.transform(df, pipe, 3).columns == df.columns
    plain = arrays(P.transform(df, Program([Op("normalize")]), floats=True).selectExpr("image_id", "width", "height", "channels * 4 as channels", "data"))
    assert np.allclose(plain[0].view(np.float32).reshape(16, 12, 3), imgs[0] / np.float32(255))
    with pytest.raises(Exception, match="float32"):
        P.transform(df, Program([Op("normalize")])).collect()
    masks = arrays(P.transform(df, Program([Op("invert"), Op("horizontal_flip"), Op("gaussian_blur")]), masks=True))
    assert (masks[0] == imgs[0][:, ::-1]).all()


def test_nulls_and_no_rows(spark):
    none = spark.createDataFrame([(1, 2, 2, 1, None)], schema.PACKED)
    assert P.transform(none, Program([Op("invert")])).first().data is None
    assert P.transform(none.limit(0), Program([Op("invert")])).count() == 0
    empty = spark.createDataFrame([], schema.PLANES)
    for op in BOTH:
        assert C.apply(empty, op).count() == 0


def test_clips_share_a_program(spark):
    a = images(1, 10, 10)[0]
    df = packed(spark, [a] * 8).selectExpr("*", "image_id div 4 as clip_id")
    out = arrays(P.transform_video(df, Compose([Transform("random_crop", width=4, height=4), Transform("brightness", delta=(-90, 90))]), 1))
    assert all((out[k] == out[0]).all() for k in range(4)) and all((out[k] == out[4]).all() for k in range(4, 8)) and not (out[0] == out[4]).all()


def test_any_res(spark):
    assert [T.select_grid(*n) for n in ((1920, 1080), (1080, 1920), (1000, 1000), (2000, 500))] == [(2, 1), (1, 2), (2, 2), (4, 1)]
    img = images(1, 30, 30)[0]
    got = P.any_res(packed(spark, [img]), 12, 4).orderBy("tile").collect()
    assert len(got) == 5 and all((np.frombuffer(bytes(r.data), np.uint8).reshape(12, 12, 3) == t).all() for r, t in zip(got, tiling.tiles(img, 12, 4), strict=True))


def test_boxes_follow_pixels(spark):
    h, w = 40, 50
    r = random.Random(3)
    steps = [Op("horizontal_flip"), Op("vertical_flip"), Op("transpose"), Op("rotate"), Op("rotate", {"angle": 270}), Op("pad", {"left": 3, "top": 2, "mode": "constant"}), Op("crop", {"x": 2, "y": 3, "width": 33, "height": 34})]
    for _ in range(12):
        program, x, y, bw, bh = Program([r.choice(steps) for _ in range(3)]), r.randint(5, 30), r.randint(5, 20), r.randint(4, 12), r.randint(4, 12)
        try:
            program.validate(w, h)
        except ValueError:
            continue
        img = np.zeros((h, w, 1), np.uint8)
        img[y : y + bh, x : x + bw] = 1
        out = np.argwhere(K.run(img, program)[..., 0])
        df = spark.createDataFrame([(0, w, h, float(x), float(y), float(bw), float(bh), "tag")], "image_id long, w int, h int, x double, y double, bw double, bh double, tag string")
        got = L.apply_to_boxes(df, program).first()
        if not len(out):
            assert got is None
            continue
        (y0, x0), (y1, x1) = out.min(axis=0), out.max(axis=0) + 1
        assert (got.x, got.y, got.bw, got.bh, got.tag) == (x0, y0, x1 - x0, y1 - y0, "tag")


def test_points_follow_affine_pixels(spark):
    op = Op("affine", {"rotate": 30.0, "scale": 1.2, "translate": (3, -2), "interpolation": "nearest"})
    img = np.zeros((101, 101, 1), np.uint8)
    img[38:43, 58:63] = 255
    out = np.argwhere(K.apply(img, op)[..., 0]).mean(axis=0)
    df = spark.createDataFrame([(0, 101, 101, 60.0, 40.0, 2)], "image_id long, w int, h int, x double, y double, v int")
    got = L.move_points(df, op).first()
    assert abs(got.x - out[1]) < 1 and abs(got.y - out[0]) < 1
    assert L.move_points(df, Op("affine", {"translate": (200, 0)})).count() == 0


def test_format_names(spark):
    df = spark.createDataFrame([(0, 100, 50, 10.0, 20.0, 30.0, 10.0)], "image_id long, w int, h int, a double, b double, c double, d double")
    for fmt in ("xywh", "xyxy", "cxcywh", "rel_xywh", "rel_xyxy", "rel_cxcywh", "pascal_voc", "coco", "albumentations", "yolo", "center_xywh"):
        back = L.write_boxes(L.read_boxes(df, fmt), fmt).first()
        assert [back[c] for c in "abcd"] == pytest.approx([10, 20, 30, 10])
    with pytest.raises(ValueError):
        L.read_boxes(df, "polar")


def labelled(spark, imgs):
    df = S.unpacked(packed(spark, imgs))
    return df.withColumn("label", L.one_hot("cast(image_id as int)", len(imgs)))


def test_mixing(spark):
    imgs = [np.full((8, 8, 3), 40 * k, np.uint8) for k in range(6)]
    df = labelled(spark, imgs)
    plan_ = {r.image_id: r for r in M.partners(df, 5).collect()}
    assert all(r.partner != r.image_id and 0.01 <= r.share <= 0.99 for r in plan_.values())
    for r in M.mix_up(df, 1.0, 5).collect():
        s, o = plan_[r.image_id].share, plan_[r.image_id].partner
        assert r.planes[0][0] == math.floor(s * 40 * r.image_id + (1 - s) * 40 * o + 0.5)
        assert r.label[r.image_id] == pytest.approx(s) and sum(r.label) == pytest.approx(1)
    for r in M.cut_mix(df, 1.0, 5).collect():
        own = sum(v == 40 * r.image_id for v in r.planes[0]) / 64
        assert r.label[r.image_id] == pytest.approx(own)
    tiles = M.mosaic(df).collect()
    assert len(tiles) == 1 and len(tiles[0].label) == 24 and [tiles[0].planes[0][k] for k in (0, 7, 56, 63)] == [0, 40, 80, 120]
    assert M.mix_up(df.limit(1), 1.0, 5).count() == 1
    batch = M.BatchPipeline(["mix_up", "cut_mix"], seed=0)
    assert sorted(map(str, batch.apply(df).collect())) == sorted(map(str, batch.apply(df).collect()))
    two = df.withColumn("image_id", df.image_id * 10)
    assert [r["rank"] for r in M.ranked(two)[0].orderBy("image_id").collect()] == list(range(6))


def test_array_files(spark, tmp_path):
    a, b = images(2, 5, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(b))
    got = {r.path.rsplit("/", 1)[1]: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.channels) for r in S.read_arrays(spark, str(tmp_path)).collect()}
    assert (got["a.npy"] == a).all() and (got["b.npy"] == b).all()
    assert S.channels_last(a[..., 0]).shape == (5, 4, 1) and (S.channels_last(a.transpose(2, 0, 1), "chw") == a).all()
    f = io.BytesIO()
    np.save(f, a.astype(float))
    with pytest.raises(TypeError):
        S.parse_npy(f.getvalue())


def test_streams(spark, tmp_path):
    imgs = images(4, 8, 8)
    packed(spark, imgs).repartition(2).write.parquet(str(tmp_path / "in"))
    pipe = Compose([Transform("brightness", delta=(-50, 50)), Transform("horizontal_flip", p=0.5)])
    source = streams.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    streams.write_stream(streams.transform_stream(source, pipe, 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got, want = arrays(S.read_packed(spark, str(tmp_path / "out"))), arrays(P.transform(packed(spark, imgs), pipe, 2))
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in got)
    streams.mix_stream(source, lambda df, seed: M.mosaic(S.unpacked(df).withColumn("label", L.one_hot("0", 2))), str(tmp_path / "mix"), str(tmp_path / "ck2")).awaitTermination()
