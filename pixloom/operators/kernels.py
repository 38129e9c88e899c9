"""Vectorised kernels over (height, width, channels) uint8 arrays: the throughput path."""

from __future__ import annotations

import math

import numpy as np

from ..functions import tables as T
from ..plans.program import POINTWISE_TABLE, Op, matrix, square, tables, window
from .resampling import affine, border, resize


def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0, 255) + 0.5).astype(np.uint8)


def _cut(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def looked_up(img: np.ndarray, table: bytes) -> np.ndarray:
    """One table for all samples, by the interpreter's own byte map."""
    return np.frombuffer(np.ascontiguousarray(img).tobytes().translate(table), np.uint8).reshape(img.shape)


def lookup(img: np.ndarray, op: Op) -> np.ndarray:
    return table_stage(op)(img)


def table_stage(op: Op):
    """The function of a table operation, its tables built once."""
    t = tables(op)
    first, three = bytes(t[0]), [np.array(x, np.uint8) for x in t]
    other = bytes(T.mean_shift(**op.params)) if op.name == "rgb_shift" else first

    def run(img):
        if len(three) == 1 or img.shape[-1] not in (3, 4):
            return looked_up(img, first if len(three) == 1 else other)
        out = img.copy()
        for k in range(3):  # a fourth channel stays
            out[..., k] = three[k][img[..., k]]
        return out

    return run


def mix(img: np.ndarray, op: Op) -> np.ndarray:
    if img.shape[2] != 3:
        return img
    if op.name == "channel_shuffle":
        return img[..., list(T.order(op["order"]))]
    m, x = np.array(matrix(op), np.float64), img.astype(np.float64)
    return _cut(np.stack([m[k, 0] * x[..., 0] + m[k, 1] * x[..., 1] + m[k, 2] * x[..., 2] for k in range(3)], axis=2))


def to_gray(img: np.ndarray) -> np.ndarray:
    if img.shape[2] != 3:
        return img
    x = img.astype(np.uint16)
    return ((77 * x[..., :1] + 150 * x[..., 1:2] + 29 * x[..., 2:] + 128) >> 8).astype(np.uint8)


def summed(img: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """One channel: sixteen-bit tables by channel, added, in 256ths."""
    if img.shape[-1] != len(tables):
        raise ValueError(f"{len(tables)} tables for {img.shape[-1]} channels")
    total = tables[0][img[..., 0]]
    for k in range(1, len(tables)):
        total += tables[k][img[..., k]]
    return (total >> np.uint16(8)).astype(np.uint8)[..., None]


def sums(img: np.ndarray, tables) -> np.ndarray:
    return summed(img, np.array(tables, np.uint16))


def to_rgb(img: np.ndarray) -> np.ndarray:
    return np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img


def hue_saturation_value(img: np.ndarray, hue_shift=0, saturation_scale=1, value_scale=1) -> np.ndarray:
    s, v = saturation_scale, value_scale
    if img.shape[2] == 1:
        return _cut(np.floor((img.astype(np.int64) * math.trunc(v * 256) + 128) / 256))
    if img.shape[2] != 3 or (hue_shift == 0 and s == 1 and v == 1):
        return img
    if hue_shift:
        return _hue(img, hue_shift, s, v)
    x = img.astype(np.float64)
    top, low = x.max(axis=2, keepdims=True), x.min(axis=2, keepdims=True)
    if s <= 1 and v <= 1:
        return _round(s * v * x + v * (1 - s) * top)
    spread, value = top - low, np.clip(top * v, 0, 255)
    chroma = np.minimum(np.divide(value * spread * s, top, out=np.zeros_like(top), where=top > 0), value)
    part = np.divide(x - low, spread, out=np.zeros_like(x), where=spread > 0)
    return _round(value - chroma + chroma * part)


#: By sector of the hue: which channels hold the largest value (0), the one between (1) and the smallest (2).
SECTORS = np.array([[0, 1, 2, 2, 1, 0], [1, 0, 0, 1, 2, 2], [2, 2, 1, 0, 0, 1]], np.uint8)


def _hue(img: np.ndarray, hue_shift, s, v) -> np.ndarray:
    """A formula that must match: integer saturation and value of eight bits; channel by channel, in 32-bit integers."""
    r, g, b = (img[..., k].astype(np.int32) for k in range(3))
    t = np.maximum(np.maximum(r, g), b)
    d = t - np.minimum(np.minimum(r, g), b)
    red, green = t == r, t == g
    hue = 60 * (np.where(red, g - b, np.where(green, b - r, r - g)) / np.maximum(d, 1) + np.where(red, 0, np.where(green, 2, 4))) + hue_shift
    if -300 <= hue_shift <= 360:  # one turn at most: the same as the remainder
        hue = np.where(hue < 0, hue + 360, np.where(hue >= 360, hue - 360, hue))
    else:
        hue = np.mod(hue, 360)
    sat = np.minimum(255, (d << 8) // np.maximum(t, 1))
    sat = np.clip((sat * math.trunc(s * 256) + 128) >> 8, 0, 255)
    val = np.clip((t * math.trunc(v * 256) + 128) >> 8, 0, 255)
    # in 256ths: the largest channel is val, the smallest val less the chroma, one lies between
    chroma, turns = val * sat, hue / 60
    between = (chroma * (255 - (np.abs(turns - 2 * np.floor(turns / 2) - 1) * 255).astype(np.int32)) + 128) >> 8
    sector = sum((hue >= k).view(np.uint8) for k in (60, 120, 180, 240, 300))
    low, out = (val << 8) - chroma, np.empty(img.shape, np.uint8)
    for k in range(3):
        part = SECTORS[k][sector]
        out[..., k] = (low + chroma * (part == 0) + between * (part == 1)) >> 8
    return out


def equalize(img: np.ndarray, then=None) -> np.ndarray:
    out = img.copy()
    for k in range(3 if img.shape[2] == 4 else img.shape[2]):
        t = T.equalize_table(np.bincount(img[..., k].ravel(), minlength=256))
        out[..., k] = np.array(T.compose(t, then) if then else t, np.uint8)[img[..., k]]
    if then and img.shape[2] == 4:
        out[..., 3] = np.array(then, np.uint8)[img[..., 3]]
    return out


def auto_contrast(img: np.ndarray, cutoff=0.0, then=None) -> np.ndarray:
    if not 0 <= cutoff <= 0.5:
        raise ValueError("cutoff must be in [0, 0.5]")
    if not img.size:
        return img
    t = T.stretch_table(*T.trimmed(np.bincount(img.ravel(), minlength=256), cutoff))
    return np.array(T.compose(t, then) if then else t, np.uint8)[img]


def turn(img: np.ndarray, element: str) -> np.ndarray:
    """A symmetry of the last axes but one; pixels move as whole items."""
    swap, fx, fy = T.SQUARE[element]
    c = img.shape[-1]
    x = np.ascontiguousarray(img).view(np.dtype((np.void, c)))[..., 0]
    x = x.swapaxes(-1, -2) if swap else x
    x = np.ascontiguousarray(x[..., :: -1 if fy else 1, :: -1 if fx else 1])
    return x.view(np.uint8).reshape(*x.shape, c)


def pad(img: np.ndarray, top, right, bottom, left, mode, value) -> np.ndarray:
    h, w = img.shape[:2]
    if mode == "constant" or value:
        return np.pad(img, ((top, bottom), (left, right), (0, 0)), constant_values=int(value))
    y, x = (border(np.arange(-a, n + z), n, mode) for a, n, z in ((top, h, bottom), (left, w, right)))
    return img[y][:, x]


def _around(img: np.ndarray, ry: int, rx: int) -> np.ndarray:
    return np.pad(img, ((ry, ry), (rx, rx), (0, 0)), mode="edge")


def separable(img: np.ndarray, taps: list[int], scale: int) -> np.ndarray:
    """Rows, then columns, each pass truncated to eight bits; in the narrowest integers that hold the sums."""
    r, kind = len(taps) // 2, np.uint16 if 255 * sum(taps) < 1 << 16 else np.int32
    bits = scale.bit_length() - 1
    for axis in (1, 0):
        x, n = _around(img, r * (axis == 0), r * (axis == 1)).astype(kind), img.shape[axis]
        part = (lambda k: x[:, k : k + n]) if axis else (lambda k: x[k : k + n])  # noqa: B023
        total = np.zeros(img.shape, kind)
        for k, t in enumerate(taps):
            if t:
                total += part(k) if t == 1 else part(k) * kind(t)
        img = np.minimum(total >> kind(bits) if scale == 1 << bits else total // kind(scale), 255).astype(np.uint8)
    return img


def convolve(img: np.ndarray, taps, scale=1) -> np.ndarray:
    """Integer taps truncate towards zero before the clip."""
    taps = np.asarray(taps)
    ry, rx = taps.shape[0] // 2, taps.shape[1] // 2
    x, (h, w) = _around(img, ry, rx).astype(taps.dtype if taps.dtype.kind == "f" else np.int32), img.shape[:2]
    taps = taps.astype(x.dtype)
    total = sum(taps[j, i] * x[j : j + h, i : i + w] for j in range(taps.shape[0]) for i in range(taps.shape[1]) if taps[j, i])
    return _cut(np.trunc(total / scale) if scale != 1 else total)


def box_blur(img: np.ndarray, radius: int) -> np.ndarray:
    """The mean of what the window holds of the image, rounded, by rows and then columns."""
    for axis in (1, 0):
        n = img.shape[axis]
        total = np.concatenate([np.zeros_like(img.take([0], axis), np.int32), img.cumsum(axis=axis, dtype=np.int32)], axis=axis)
        lo, hi = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        size = (hi - lo).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        img = ((total.take(hi, axis) - total.take(lo, axis) + size // 2) // size).astype(np.uint8)
    return img


def _ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, middle and greatest of three arrays, place by place."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)


def median_blur(img: np.ndarray, kernel_size=3) -> np.ndarray:
    if kernel_size not in (3, 5):
        raise ValueError("kernel_size must be 3 or 5")
    r, (h, w) = kernel_size // 2, img.shape[:2]
    x = _around(img, r, r)
    if kernel_size == 3:  # columns of three are ordered once and shared by three windows
        low, mid, high = _ordered(x[:h], x[1 : h + 1], x[2:])
        side = lambda v: (v[:, :w], v[:, 1 : w + 1], v[:, 2:])
        return _ordered(np.maximum.reduce(side(low)), _ordered(*side(mid))[1], np.minimum.reduce(side(high)))[1]
    columns = _sorted([x[j : j + h] for j in range(5)])  # shared by five windows
    across = [_sorted([c[:, i : i + w] for i in range(5)]) for c in columns]
    # rows and columns are in order now: (i, j) has (i + 1)(j + 1) - 1 samples not above it and (5 - i)(5 - j) - 1 not below it, of 24
    return _middle([across[i][j] for i in range(5) for j in range(5) if max((i + 1) * (j + 1), (5 - i) * (5 - j)) <= 13])


def _sorted(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays put in order place by place, by merging neighbours in turns."""
    rows = list(rows)
    for turn_ in range(len(rows)):
        for k in range(turn_ % 2, len(rows) - 1, 2):
            rows[k], rows[k + 1] = np.minimum(rows[k], rows[k + 1]), np.maximum(rows[k], rows[k + 1])
    return rows


def _middle(rows: list[np.ndarray]) -> np.ndarray:
    """The median of an odd number of arrays: of so many that neither end can be it, the least and greatest go, and the next comes in."""
    held, rest = rows[: len(rows) // 2 + 2], rows[len(rows) // 2 + 2 :]
    while len(held) > 1:
        n = len(held)
        pairs = [(np.minimum(held[k], held[k + 1]), np.maximum(held[k], held[k + 1])) for k in range(0, n - 1, 2)]
        odd = held[n - n % 2 :]
        low, high, kept = pairs[0][0], pairs[0][1], []
        for a, b in pairs[1:] + [(x, x) for x in odd]:
            alone = a is b
            low, more = np.minimum(low, a), np.maximum(low, a)
            if alone:  # one sample: what isn't the least may be the greatest
                high, more = np.maximum(high, more), np.minimum(high, more)
                kept.append(more)
                continue
            high, less = np.maximum(high, b), np.minimum(high, b)
            kept += [more, less]
        held = kept + rest[:1]
        rest = rest[1:]
    return held[0]


def sobel(img: np.ndarray) -> np.ndarray:
    if min(img.shape[:2]) < 3:
        return img
    x, (h, w) = _around(img, 1, 1).astype(np.int32), img.shape[:2]
    gx, gy = (sum(t[j][i] * x[j : j + h, i : i + w] for j in range(3) for i in range(3)) for t in (T.SOBEL_X, T.SOBEL_Y))
    return _round(np.sqrt((gx * gx + gy * gy).astype(np.float64)))


def mixed_unit(at: np.ndarray, seed: int) -> np.ndarray:
    """A bounded congruential hash of positions to [0, 1); catalyst.mixed_unit is the same in SQL."""
    low = np.int64(2147483647)
    k = (np.asarray(at, np.int64) * 7919 + seed % 1000003) & low
    for _ in range(4):
        k = (k * 1103515245 + 12345) & low
        k = ((k & 65535) << 15) + (k >> 16)  # low bits of the product are poor: turn them up
    return k / 2147483648.0


def mixed_normal(at: np.ndarray, seed: int) -> np.ndarray:
    """Standard normal numbers by position."""
    at = np.asarray(at, np.int64) * 2
    return np.sqrt(-2 * np.log(1 - mixed_unit(at, seed))) * np.cos(2 * np.pi * mixed_unit(at + 1, seed))


def gauss_noise(img: np.ndarray, mean=0, std=10, seed=0) -> np.ndarray:
    return _round(img.astype(np.float64) + mean + std * mixed_normal(np.arange(img.size), seed).reshape(img.shape))


def multiplicative_noise(img: np.ndarray, multiplier=1, std=0.1, granularity="vector", block=8, seed=0) -> np.ndarray:
    """A factor for each sample (pixel), each square of block pixels, or each run of eight samples (vector)."""
    h, w, c = img.shape
    if granularity == "pixel":
        f = mixed_normal(np.arange(img.size), seed).reshape(img.shape)
    elif granularity == "block":
        rows, cols = -(-h // block), -(-w // block)
        f = mixed_normal(np.arange(rows * cols), seed).reshape(rows, cols, 1).repeat(block, 0)[:h].repeat(block, 1)[:, :w]
    else:
        f = mixed_normal(np.arange(-(-h * w * c // 8)), seed).repeat(8)[: h * w * c].reshape(img.shape)
    return _round(img * (multiplier + std * f))


def salt_and_pepper(img: np.ndarray, amount=0.05, salt_vs_pepper=0.5, seed=0) -> np.ndarray:
    at = np.arange(img.size).reshape(img.shape)
    return np.where(mixed_unit(at, seed) < amount, np.where(mixed_unit(at + img.size, seed) < salt_vs_pepper, 255, 0), img).astype(np.uint8)


def holes(w: int, h: int, count: int, size, seed: int) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of rectangles; size is (height, width) as shares of the image."""
    most = [max(1, math.ceil(round(a * b, 9))) for a, b in ((size[1], w), (size[0], h))]
    out = []
    for k in range(count):
        u = [float(mixed_unit(np.int64(k * 4 + j), seed)) for j in range(4)]
        hw, hh = (int(u[j] * (most[j] - 1)) + 1 for j in range(2))
        out.append((int(u[2] * max(0, w - hw)), int(u[3] * max(0, h - hh)), hw, hh))
    return out


def coarse_dropout(img: np.ndarray, count, size, fill, seed) -> np.ndarray:
    img = img.copy()
    for x, y, w, h in holes(img.shape[1], img.shape[0], count, size, seed):
        img[y : y + h, x : x + w] = fill
    return img


def dropped(cells: int, ratio: float, seed: int) -> list[int]:
    """The share of cells that come first in the order of their hashes."""
    return np.argsort(mixed_unit(np.arange(cells), seed), kind="stable")[: math.ceil(round(cells * ratio, 9))].tolist()


def grid_dropout(img: np.ndarray, ratio=0.5, unit_size=16, fill=0, seed=0) -> np.ndarray:
    img, (h, w) = img.copy(), img.shape[:2]
    cols = -(-w // unit_size)
    for k in dropped(cols * -(-h // unit_size), ratio, seed):
        y, x = k // cols * unit_size, k % cols * unit_size
        img[y : y + unit_size, x : x + unit_size] = fill
    return img


def mosaic(images: list[np.ndarray]) -> np.ndarray:
    """Every second pixel of four images, in the quadrants of one as large as the first; an odd size leaves a black edge."""
    (h, w), c = images[0].shape[:2], images[0].shape[2]
    out = np.zeros((h, w, c), np.uint8)
    for k, img in enumerate(images):
        y, x = k // 2 * (h // 2), k % 2 * (w // 2)
        out[y : y + h // 2, x : x + w // 2] = img[: h // 2 * 2 : 2, : w // 2 * 2 : 2]
    return out


def normalize(img: np.ndarray, mean=0, std=1) -> np.ndarray:
    """float32; one mean and deviation, or one a channel."""
    return ((img.astype(np.float32) / np.float32(255) - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).astype(np.float32)


def apply(img: np.ndarray, op: Op) -> np.ndarray:
    """One operation on one image; the result may share memory with img."""
    p = op.params
    if op.name in POINTWISE_TABLE:
        return lookup(img, op)
    if matrix(op) is not None:
        return mix(img, op)
    if square(op):
        return turn(img, square(op))
    match op.name:
        case "crop" | "random_crop":
            x, y, w, h = window(op, img.shape[1], img.shape[0])
            return img[y : y + h, x : x + w]
        case "gaussian_blur":
            return separable(img, *T.gauss_taps(p["kernel_size"]))
        case "gaussian_blur_sigma":
            if p["quality"] == "fast" and p["sigma"] > 4:
                for _ in range(3):
                    img = box_blur(img, max(1, round(p["sigma"] * 0.94)))
                return img
            return separable(img, *T.sigma_taps(p["sigma"]))
        case "sharpen":
            return convolve(img, np.array(T.sharpen(p["strength"]), np.float64))
        case "emboss":
            return convolve(img, T.emboss(**p), 256)
        case "edge_detection":
            return convolve(img, T.LAPLACIAN) if p["method"] in ("laplacian", "prewitt") else sobel(img)
        case "affine":
            return affine(img, **p, once=True)
        case "coarse_dropout":
            return coarse_dropout(img, p["holes"], p["hole_size"], p["fill"], p["seed"])
        case "grid_dropout":
            return grid_dropout(img, p["ratio"], p["unit_size"], p["fill"], p["seed"])
        case _:
            return globals()[op.name](img, **p)


def prepared(op: Op):
    """(function of an image, whether it also takes a batch of equal sizes)."""
    if op.name in POINTWISE_TABLE:
        return table_stage(op), True
    if element := square(op):
        return (lambda img: turn(img, element)), True
    if op.name == "crop":
        def cut(img):
            x, y, w, h = window(op, img.shape[-2], img.shape[-3])
            return np.ascontiguousarray(img[..., y : y + h, x : x + w, :])  # once here, else every later stage reads with gaps

        return cut, True
    if op.name in ("resize", "affine"):
        f = resize if op.name == "resize" else affine
        return (lambda img: f(img, **op.params)), True
    if op.name == "sums":
        tables = np.array(op["tables"], np.uint16)
        return (lambda img: summed(img, tables)), True
    if op.name in ("to_gray", "to_rgb") or op.name == "channel_shuffle":
        return (lambda img: _last_axis(img, op)), True
    return (lambda img: apply(img, op)), False


def _last_axis(img: np.ndarray, op: Op) -> np.ndarray:
    """Operations on the channels alone, on an image or a batch seen as one tall image."""
    flat = apply(img.reshape(-1, *img.shape[-2:]), op)
    return flat.reshape(*img.shape[:-1], flat.shape[-1])


def run(img: np.ndarray, stages) -> np.ndarray:
    for op in stages:
        img = apply(img, op)
    return img


def run_batch(batch: np.ndarray, stages) -> np.ndarray:
    """Prepared stages over (n, height, width, channels): at once where all can, else image by image (which stays in cache)."""
    if all(whole for _, whole in stages):
        for f, _ in stages:
            batch = f(batch)
        return batch
    out = None
    for k, img in enumerate(batch):
        for f, _ in stages:
            img = f(img)
        if out is None:
            out = np.empty((len(batch), *img.shape), img.dtype)
        out[k] = img
    return out
