"""Random programs by sequence: the same images as the planner's, one by one."""

import numpy as np
import pyarrow as pa
import pytest

from pixloom.functions import tables as T
from pixloom.operators import grouped, kernels, packed
from pixloom.plans.pipeline import Choice, Compose, Maybe, SomeOf, Transform
from pixloom.plans.planner import order, plan
from pixloom.plans.program import Op, Program

LUTS = [Transform("brightness", delta=(-200, 200)), Transform("contrast", factor=(0, 3)), Transform("gamma", gamma=(0.3, 3)), Transform("posterize", bits=(1, 8)), Transform("solarize", threshold=(0, 255)), Transform("rgb_shift", r_shift=(-90, 90), g_shift=(-90, 90), b_shift=(-90, 90)), Transform("invert")]
TREES = {
    "tables": Compose(LUTS),
    "some": Compose([SomeOf(LUTS, 3), Maybe(Transform("horizontal_flip"), 0.5), Maybe(Transform("transpose"), 0.5), Choice([Transform("rotate", angle=90), Transform("rotate", angle=180)])]),
    "windows": Compose([*LUTS[:2], Maybe(Transform("vertical_flip")), Transform("random_crop", width=9, height=7), LUTS[4], Transform("crop", x=(0, 3), y=(0, 2), width=5, height=4)]),
    "channels": Compose([LUTS[5], Maybe(Transform("to_gray")), LUTS[5], LUTS[0], Transform("to_rgb"), LUTS[5], Maybe(Transform("to_sepia")), LUTS[1]]),
    "kernels": Compose([LUTS[0], Maybe(Transform("equalize")), LUTS[3], Transform("gauss_noise", std=(1, 20)), Maybe(Transform("gaussian_blur")), Maybe(Transform("resize", width=(4, 20), height=(4, 20))), Transform("salt_and_pepper"), LUTS[6]]),
    "nothing": Compose([]),
}


def pictures(n: int) -> list[np.ndarray]:
    r = np.random.default_rng(5)
    return [r.integers(0, 256, (int(r.integers(10, 14)), int(r.integers(10, 14)), (1, 3, 4)[k % 3]), np.uint8) for k in range(n)]


@pytest.mark.parametrize("tree", sorted(TREES))
@pytest.mark.parametrize("optimize", [True, False])
def test_same_as_one_by_one(tree, optimize):
    images, programs = pictures(90), [TREES[tree].program(3, k // 2) for k in range(90)]
    for got, img, p in zip(grouped.through(images, programs, optimize), images, programs, strict=True):
        want = kernels.run(img, plan(p, optimize, img.shape[2]).stages)
        assert got.shape == want.shape and (got == want).all()
    for got, img, p in zip(grouped.through(images, programs, optimize, moves=True), images, programs, strict=True):
        assert (got == kernels.run(img, plan(p.moves(), optimize, img.shape[2]).stages)).all()


def test_tables_of_many_are_tables_of_each():
    r = np.random.default_rng(1)
    for name, param, values in (("brightness", "delta", r.uniform(-255, 255, 300)), ("contrast", "factor", r.uniform(0, 4, 300)), ("gamma", "gamma", r.uniform(0.05, 6, 300)), ("posterize", "bits", r.integers(1, 9, 300)), ("solarize", "threshold", r.integers(0, 256, 300))):
        rows = grouped.table_rows([Op(name, {param: v.item()}) for v in values], 3)
        assert rows.shape == (300, 1, 256)
        assert rows[:, 0].tolist() == [getattr(T, name)(v.item()) for v in values]
    level = np.arange(256, dtype=np.float32)  # by definition, one number at a time
    for g in (0.31, 1.0, 2.7):
        assert T.gamma(g) == [int(np.float32(255) * np.float32(float(v / np.float32(255)) ** float(np.float32(g)))) for v in level]
    with pytest.raises(ValueError):
        grouped.table_rows([Op("posterize", {"bits": 3}), Op("posterize", {"bits": 9})], 3)


def test_tables_with_and_without_channels_join():
    one, three = Op("lut", {"table": [T.invert()]}), Op("lut", {"table": [T.invert(), T.brightness(9), T.gamma(2)]})
    for channels in (1, 3, 4):
        rows = grouped.table_rows([one, three], channels)
        assert rows.shape == (2, 1 if channels == 1 else channels, 256)
        for img, p in zip(pictures(6), [Program([one]), Program([three])] * 3, strict=True):
            assert (grouped.through([img], [p])[0] == kernels.run(img, p)).all()


def test_order_is_by_names_alone():
    a = [Op("brightness", {"delta": 0}), Op("rotate", {"angle": 90}), Op("crop", {"width": 4, "height": 4})]
    assert order(a)[0] == [1, 2, 0]
    assert order([a[0], a[2]])[0] == [1, 0]
    assert order([a[0]] * 3)[0] == [0, 1, 2]  # the same operation thrice


def test_windows_that_leave_an_image_are_refused():
    with pytest.raises(ValueError):
        grouped.through(pictures(1), [Program([Op("crop", {"x": 9, "width": 9, "height": 9})])])


def test_ragged_column():
    rows = [np.arange(6, dtype=np.uint8).reshape(1, 2, 3), None, np.zeros((0, 3, 1), np.uint8), np.ones((1, 1, 1), np.float32)]
    got = packed._ragged(rows)
    assert got.type == pa.binary() and got.to_pylist() == [bytes(range(6)), None, b"", np.float32(1).tobytes()]
    assert packed._ragged([]).to_pylist() == []


def test_rows_keep_their_columns_nulls_and_keys(spark):
    images = pictures(40)
    rows = [(k, x.shape[1], x.shape[0], x.shape[2], None if k == 7 else x.tobytes(), f"tag{k}", k // 3) for k, x in enumerate(images)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, data binary, tag string, clip_id long")
    for key, n in (("image_id", 1), ("clip_id", 3)):
        got = {r["image_id"]: r for r in packed.transform(df, TREES["windows"], 11, key).collect()}
        assert len(got) == 40 and got[7]["data"] is None and got[7]["width"] == images[7].shape[1]
        for k, x in enumerate(images):
            want = kernels.run(x, TREES["windows"].program(11, k // n))
            assert got[k]["tag"] == f"tag{k}"
            if k != 7:
                assert (got[k]["width"], got[k]["height"], got[k]["data"]) == (want.shape[1], want.shape[0], want.tobytes())


def test_replay_is_the_direct_call(spark):
    df = spark.createDataFrame([(k, x.shape[1], x.shape[0], x.shape[2], x.tobytes()) for k, x in enumerate(pictures(30))] + [(99, 1, 1, 1, None)], packed.PACKED)
    stored = packed.programs(df, TREES["kernels"], 5)
    direct = {r["image_id"]: r["data"] for r in packed.transform(df, TREES["kernels"], 5).collect()}
    again = {r["image_id"]: r["data"] for r in packed.replay(df.join(stored, "image_id")).collect()}
    assert again == direct and again[99] is None


def test_tables_and_gray_become_one_sum():
    shift, bright, gray = Op("rgb_shift", {"r_shift": -40, "g_shift": 5, "b_shift": 60}), Op("brightness", {"delta": 30}), Op("to_gray")
    program = Program([bright, shift, gray, Op("invert")])
    stages = plan(program, channels=3).stages
    assert [o.name for o in stages] == ["sums", "lut"] or [o.name for o in stages] == ["sums", "invert"]
    assert [o.name for o in plan(program, channels=4).stages][-1] != "sums" and "sums" not in str(plan(program, channels=1).stages)
    every = np.stack(np.meshgrid(*[np.arange(0, 256, 5, dtype=np.uint8)] * 3), -1).reshape(52, -1, 3)  # the lightest and darkest colours too
    for p in (program, Program([bright, gray]), Program([Op("invert"), gray, bright])):
        want = kernels.run(every, p)
        assert (kernels.run(every, plan(p, channels=3).stages) == want).all()
        assert (grouped.through([every], [p])[0] == want).all()
        ready = [kernels.prepared(o) for o in plan(p, channels=3).stages]
        assert all(whole for _, whole in ready) and (kernels.run_batch(np.stack([every, every]), ready)[1] == want).all()
        assert Program.from_json(Program(plan(p, channels=3).stages).to_json()) == Program(plan(p, channels=3).stages)
    with pytest.raises(ValueError):
        kernels.run(every[..., :1], stages)
