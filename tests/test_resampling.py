"""Compiled resampling, the median's network and running sums against what defines them."""

import math
import re

import numpy as np
import pytest

from pixloom.operators import catalyst as C
from pixloom.operators import kernels as K
from pixloom.operators import packed as P
from pixloom.operators import resampling as R
from pixloom.plans.program import Op, Program
from pixloom.sources import images as S
from test_engine import arrays, packed, planes_of

RNG = np.random.default_rng(77)


def bilinear(img, width, height):
    """One sample at a time."""
    h, w, c = img.shape
    out = np.zeros((height, width, c), np.uint8)
    for y in range(height):
        for x in range(width):
            sy, sx = (y + 0.5) * (h / height) - 0.5, (x + 0.5) * (w / width) - 0.5
            y0, x0 = min(max(math.floor(sy), 0), h - 1), min(max(math.floor(sx), 0), w - 1)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            fy, fx = (0.0 if s < 0 or s >= n - 1 else s - math.floor(s) for s, n in ((sy, h), (sx, w)))
            for k in range(c):
                p = [float(img[j, i, k]) for j in (y0, y1) for i in (x0, x1)]
                out[y, x, k] = math.floor(p[0] * (1 - fx) * (1 - fy) + p[1] * fx * (1 - fy) + p[2] * (1 - fx) * fy + p[3] * fx * fy + 0.5)
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 9, 3), (30, 4, 4)])
@pytest.mark.parametrize("size", [(1, 1), (3, 17), (40, 2)])
def test_resize_is_the_bilinear_mean(shape, size):
    img = RNG.integers(0, 256, shape, dtype=np.uint8)
    np.testing.assert_array_equal(R.resize(img, *size), bilinear(img, *size))


def test_a_batch_is_its_images():
    batch = RNG.integers(0, 256, (4, 11, 7, 3), dtype=np.uint8)
    for op in (Op("resize", {"width": 5, "height": 19}), Op("resize", {"width": 6, "height": 3, "interpolation": "nearest"}), *(Op("affine", {"rotate": 41.0, "translate": [2, -1], "interpolation": i, "border_mode": b, "value": 9}) for i in ("nearest", "bilinear") for b in ("constant", "replicate", "reflect", "wrap"))):
        f, whole = K.prepared(op)
        assert whole
        np.testing.assert_array_equal(f(batch), np.stack([K.apply(img, op) for img in batch]))
        np.testing.assert_array_equal(f(batch[:, ::-1])[2], K.apply(np.ascontiguousarray(batch[2, ::-1]), op))  # views with gaps
        assert f(batch[:0]).shape[0] == 0


def test_still_affine_map_moves_nothing():
    img = RNG.integers(0, 256, (9, 6, 3), dtype=np.uint8)
    np.testing.assert_array_equal(R.affine(img), img)
    moved = R.affine(img, translate=(2, 1), value=7)
    np.testing.assert_array_equal(moved[1:, 2:], img[:-1, :-2])
    assert (moved[0] == 7).all() and (moved[:, :2] == 7).all()


def test_plans_are_made_once_a_shape():
    R._kept_affine.cache_clear()
    f, _ = K.prepared(Op("affine", {"rotate": 10.0}))
    for n in (3, 5):
        f(RNG.integers(0, 256, (n, 8, 8, 3), dtype=np.uint8))
    assert R._kept_affine.cache_info().misses == 1
    K.apply(RNG.integers(0, 256, (8, 8, 3), dtype=np.uint8), Op("affine", {"rotate": 11.0}))  # a drawn angle takes no place
    assert R._kept_affine.cache_info().misses == 1


def test_packed_resampling(spark):
    imgs = [RNG.integers(0, 256, (12, 10, 3), dtype=np.uint8) for _ in range(5)]
    program = Program([Op("affine", {"rotate": 20.0, "border_mode": "reflect"}), Op("resize", {"width": 8, "height": 6}), Op("brightness", {"delta": 20})])
    got = arrays(P.transform(packed(spark, imgs), program))
    for k, img in enumerate(imgs):
        np.testing.assert_array_equal(got[k], K.run(img, program.ops))


@pytest.mark.parametrize("shape", [(1, 1, 1), (2, 9, 4), (5, 3, 3), (33, 18, 1)])
@pytest.mark.parametrize("kernel", [3, 5])
def test_median_network(shape, kernel):
    for high in (2, 256):  # many ties, few ties
        img = RNG.integers(0, high, shape, dtype=np.uint8)
        r = kernel // 2
        x = np.pad(img, ((r, r), (r, r), (0, 0)), mode="edge")
        taps = np.stack([x[j : j + shape[0], i : i + shape[1]] for j in range(kernel) for i in range(kernel)])
        np.testing.assert_array_equal(K.median_blur(img, kernel), np.sort(taps, axis=0)[len(taps) // 2])


def test_middle_of_any_odd_number():
    for n in range(1, 20, 2):
        rows = [RNG.integers(0, 30, 50, dtype=np.uint8) for _ in range(n)]
        np.testing.assert_array_equal(K._middle(rows), np.sort(np.stack(rows), axis=0)[n // 2])


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 17, 1), (16, 5, 3), (9, 8, 3)])
def test_box_blur_of_any_radius(spark, shape):
    imgs = [RNG.integers(0, 256, shape, dtype=np.uint8) for _ in range(2)]
    df = S.unpacked(packed(spark, imgs))
    for radius in (0, 1, 4, 40):
        got = planes_of(C.box_blur(df, radius))
        for k, img in enumerate(imgs):
            across = np.array([[[(img[y, max(0, x - radius) : x + radius + 1, c].astype(int).sum() + (n := len(img[y, max(0, x - radius) : x + radius + 1])) // 2) // n for c in range(shape[2])] for x in range(shape[1])] for y in range(shape[0])])
            down = np.array([[[(across[max(0, y - radius) : y + radius + 1, x, c].sum() + (n := len(across[max(0, y - radius) : y + radius + 1])) // 2) // n for c in range(shape[2])] for x in range(shape[1])] for y in range(shape[0])])
            np.testing.assert_array_equal(got[k], down)


def test_box_blur_looks_up_two_sums_whatever_the_radius(spark):
    df = S.unpacked(packed(spark, [RNG.integers(0, 256, (4, 4, 1), dtype=np.uint8)]))
    plans = [re.sub(r"#\d+L?|\b(3|300|4|301)\b", "", C.box_blur(df, r)._jdf.queryExecution().optimizedPlan().toString()) for r in (3, 300)]
    assert len(plans[0]) == len(plans[1]) and "sequence(0" not in plans[0]
