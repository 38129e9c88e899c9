"""Lookup tables, colour matrices, taps and coordinate rules, built on the driver.

Tables are built in 32-bit floats, so that both engines and the oracle see the
same integers.
"""

from __future__ import annotations

import math

import numpy as np

f32 = np.float32
LEVELS = np.arange(256, dtype=np.float32)


def _bytes(x) -> list[int]:
    return levels(x).tolist()


def levels(x) -> np.ndarray:
    return np.floor(np.clip(x, 0, 255)).astype(np.uint8)


def _each(x, kind=np.float32) -> np.ndarray:
    """A parameter, or an array of one a row, against the 256 levels."""
    return np.asarray(x, kind)[..., None]


def brighter(delta) -> np.ndarray:
    if not np.all((np.asarray(delta) >= -255) & (np.asarray(delta) <= 255)):
        raise ValueError("delta must be in [-255, 255]")
    return levels(LEVELS + _each(delta))


def contrasted(factor) -> np.ndarray:
    if not np.all(np.asarray(factor) >= 0):
        raise ValueError("factor must not be negative")
    return levels((LEVELS - f32(128)) * _each(factor) + f32(128))


def powered(gamma) -> np.ndarray:
    if not np.all(np.asarray(gamma) > 0):
        raise ValueError("gamma must be positive")
    return levels(f32(255) * np.power((LEVELS / f32(255)).astype(float), _each(gamma).astype(float)).astype(f32))


def posterized(bits) -> np.ndarray:
    if not np.all((np.asarray(bits) >= 1) & (np.asarray(bits) <= 8)):
        raise ValueError("bits must be in [1, 8]")
    gone = 8 - _each(bits, np.int64)
    return (np.arange(256) >> gone << gone).astype(np.uint8)


def solarized(threshold) -> np.ndarray:
    v = np.arange(256)
    return np.where(v >= _each(threshold, np.float64), 255 - v, v).astype(np.uint8)


def shifted(shift) -> np.ndarray:
    return levels(LEVELS + _each(shift))


def brightness(delta: float = 0) -> list[int]:
    return brighter(delta).tolist()


def contrast(factor: float = 1) -> list[int]:
    return contrasted(factor).tolist()


def gamma(gamma: float = 1) -> list[int]:
    return powered(gamma).tolist()


def invert() -> list[int]:
    return list(range(255, -1, -1))


def posterize(bits: int = 4) -> list[int]:
    return posterized(bits).tolist()


def solarize(threshold: int = 128) -> list[int]:
    return solarized(threshold).tolist()


def rgb_shift(r_shift: float = 0, g_shift: float = 0, b_shift: float = 0) -> list[list[int]]:
    return [shifted(s).tolist() for s in (r_shift, g_shift, b_shift)]


def mean_shift(r_shift: float = 0, g_shift: float = 0, b_shift: float = 0) -> list[int]:
    """What images without three or four channels get."""
    return _bytes(LEVELS + f32(round((r_shift + g_shift + b_shift) / 3)))


def compose(first: list[int], then: list[int]) -> list[int]:
    return [then[v] for v in first]


def equalize_table(histogram) -> list[int]:
    """From 256 counts; identity where one level holds all."""
    h = np.asarray(histogram, dtype=np.int64)
    total, some = int(h.sum()), np.nonzero(h)[0]
    if not len(some) or h[some[0]] == total:
        return list(range(256))
    n0 = int(h[some[0]])
    return np.clip(np.floor(255 * (np.cumsum(h) - n0) / (total - n0) + 0.5), 0, 255).astype(int).tolist()


def stretch_table(lo: int, hi: int) -> list[int]:
    return [0] * 256 if lo >= hi else [min(255, max(0, v - lo) * 255 // (hi - lo)) for v in range(256)]


def trimmed(histogram, cutoff: float) -> tuple[int, int]:
    """The levels left after a share `cutoff` of all samples is cut off at either end."""
    h = np.asarray(histogram, dtype=np.int64)
    cut = math.floor(float(f32(h.sum()) * f32(cutoff)) + 0.5)
    lo = int(np.searchsorted(np.cumsum(h), cut, side="right"))
    hi = 255 - int(np.searchsorted(np.cumsum(h[::-1]), cut, side="right"))
    return min(lo, 255), max(hi, 0)


# What red, green and blue weigh in a gray level, in 256ths.
LUMA = (77, 150, 29)


def luma(tables) -> np.ndarray:
    """(..., 3, 256) sixteen-bit tables, by channel, whose sums in 256ths are the rounded gray levels of pixels after three tables."""
    out = np.asarray(tables, np.uint16) * np.array(LUMA, np.uint16)[:, None]
    out[..., 0, :] += 128
    return out


# 3x3 colour matrices and presets.
SEPIA = [[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]]
MIXES = {
    "bgr": [[0, 0, 1], [0, 1, 0], [1, 0, 0]], "swap_gb": [[1, 0, 0], [0, 0, 1], [0, 1, 0]], "swap_rg": [[0, 1, 0], [1, 0, 0], [0, 0, 1]],
    "vintage": [[1.2, 0.1, 0], [0, 1, 0.1], [0, 0, 0.9]], "cool": [[0.9, 0, 0], [0, 1, 0], [0.1, 0.1, 1.2]],
}
BALANCES = {"warm": (1.2, 1.05, 0.8), "cool": (0.8, 1.0, 1.2), "red_boost": (1.5, 0.9, 0.7), "green_boost": (0.9, 1.5, 0.9), "blue_boost": (0.7, 0.9, 1.5)}
TINTS = {"sepia": (112, 66, 41, 1.0), "warm": (255, 200, 100, 0.5), "cool": (100, 150, 255, 0.5), "muted": (128, 128, 128, 0.5), "vintage": (180, 160, 120, 0.4)}
#: Source channel of each output channel.
ORDERS = {"RGB": (0, 1, 2), "RBG": (0, 2, 1), "GRB": (1, 0, 2), "GBR": (1, 2, 0), "BRG": (2, 0, 1), "BGR": (2, 1, 0)}


def diagonal(r: float, g: float, b: float) -> list[list[float]]:
    return [[r, 0, 0], [0, g, 0], [0, 0, b]]


def temperature(temperature: float = 0) -> list[list[float]]:
    t = temperature / 100
    return diagonal(1 + 0.1 * t, 1 + 0.1 * t, 1 - 0.2 * t) if t >= 0 else diagonal(1 + 0.15 * t, 1 + 0.15 * t, 1 - 0.2 * t)


def tint(tint=(0, 0, 0, 0)) -> list[list[float]]:
    r, g, b, i = tint
    row = [x * i / 765 for x in (r, g, b)]
    return [[row[k] + (1 - i) * (k == j) for k in range(3)] for j in range(3)]


def order(order) -> tuple[int, int, int]:
    return list(ORDERS.values())[order] if isinstance(order, int) else ORDERS[order.upper()]


def permutation(order_) -> list[list[float]]:
    return [[float(k == c) for k in range(3)] for c in order(order_)]


# Integer taps and their sums.
GAUSS = {3: ([1, 2, 1], 4), 5: ([1, 4, 6, 4, 1], 16), 7: ([2, 7, 14, 18, 14, 7, 2], 64)}
PASCAL = {3: ([1, 2, 1], 4), 5: ([1, 4, 6, 4, 1], 16), 7: ([1, 6, 15, 20, 15, 6, 1], 64)}
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def sigma_taps(sigma: float) -> tuple[list[int], int]:
    """Taps of a blur by sigma: Q14 by the bell curve; small kernels use binomial rows."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    size = max(3, math.floor(6 * sigma + 0.5) | 1)
    radius = min(31, size // 2)
    if sigma <= 1.5 and 2 * radius + 1 in PASCAL:
        return PASCAL[2 * radius + 1]
    x = np.arange(-radius, radius + 1, dtype=np.float32)
    raw = np.exp(-x * x / f32(2 * sigma * sigma), dtype=np.float32)
    return np.floor(raw * f32(16384) / raw.sum(dtype=np.float32) + f32(0.5)).astype(int).tolist(), 16384


def gauss_taps(kernel_size: int) -> tuple[list[int], int]:
    """3, 5 and 7 have their own rows; larger odd sizes use the sigma that such a size stands for."""
    if kernel_size in GAUSS:
        return GAUSS[kernel_size]
    if kernel_size % 2 == 0 or not 3 <= kernel_size <= 63:
        raise ValueError("kernel_size must be odd and in [3, 63]")
    return sigma_taps(kernel_size / 6)


def sharpen(strength: float = 0.5) -> list[list[float]]:
    if not -5 <= strength <= 5:
        raise ValueError("strength must be in [-5, 5]")
    return [[0, -strength, 0], [-strength, 1 + 4 * strength, -strength], [0, -strength, 0]]


#: Directions in which brightness rises across an embossed edge, as steps to the right and down.
RISES = {"top_left": (-1, 1), "top_right": (1, 1), "bottom_right": (-1, -1), "bottom_left": (1, -1)}
#: The other four names fall to the one beside them.
EMBOSS_NAMES = {"top": "top_left", "right": "top_right", "bottom": "bottom_right", "left": "bottom_left"}


def emboss(direction: str = "top_left", alpha: float = 0.5, strength: float = 0.5) -> list[list[int]]:
    """Taps of 256ths: a neighbour counts by how far it lies along the rise, strength for one step and 1 more for two."""
    right, down = RISES[EMBOSS_NAMES.get(direction, direction)]

    def tap(x: int, y: int) -> int:
        along = x * right + y * down
        effect = 1.0 if x == y == 0 else math.copysign(abs(along) - 1 + strength, along) if along else 0.0
        return math.trunc((alpha * effect + (1 - alpha) * (x == y == 0)) * 256)

    return [[tap(x, y) for x in (-1, 0, 1)] for y in (-1, 0, 1)]


# A formula that must match: the inverse of scale, rotation and shear about the centre.
def inverse_affine(w: int, h: int, scale=1.0, rotate=0.0, translate=(0, 0), shear=(0, 0)) -> tuple[float, ...]:
    """(a, b, c, d, e, f): source x = a x + b y + c, y = d x + e y + f, about the image's centre."""
    sx, sy = (scale, scale) if np.isscalar(scale) else scale
    tx, ty = (translate, translate) if np.isscalar(translate) else translate
    kx, ky = ((shear, 0) if np.isscalar(shear) else shear)
    kx, ky = math.tan(math.radians(kx)), math.tan(math.radians(ky))
    cos, sin = math.cos(math.radians(rotate)), math.sin(math.radians(rotate))
    unshear = np.array([[1, -kx], [-ky, 1]]) / (1 - kx * ky if abs(1 - kx * ky) > 1e-6 else 1.0)
    m = np.diag([1 / s if abs(s) > 1e-6 else 1.0 for s in (sx, sy)]) @ np.array([[cos, -sin], [sin, cos]]) @ unshear
    cx, cy = (w - 1) / 2, (h - 1) / 2
    c, f = np.array([cx, cy]) - m @ np.array([cx + tx, cy + ty])
    return float(m[0, 0]), float(m[0, 1]), float(c), float(m[1, 0]), float(m[1, 1]), float(f)


def grids(max_tiles: int) -> list[tuple[int, int]]:
    """All (columns, rows) of at most max_tiles tiles."""
    return [(n // rows, rows) for n in range(1, max_tiles + 1) for rows in range(1, n + 1) if n % rows == 0]


def select_grid(w: int, h: int, max_tiles: int = 6) -> tuple[int, int]:
    """The grid whose shape is nearest the image's, by the error to five places; then the one of most tiles, then of fewest columns."""
    return min(grids(max_tiles), key=lambda g: (round(abs(math.log(w / h) - math.log(g[0] / g[1])), 5), -g[0] * g[1], g))


def beta_table(alpha: float, size: int = 1024) -> list[float]:
    """Quantiles of Beta(alpha, alpha) at the middles of `size` equal steps, within [0.01, 0.99]."""
    x = (np.arange(1 << 16) + 0.5) / (1 << 16)
    mass = np.cumsum(np.exp((alpha - 1) * (np.log(x) + np.log1p(-x))))
    return [round(float(v), 9) for v in np.clip(np.interp((np.arange(size) + 0.5) / size, mass / mass[-1], x), 0.01, 0.99)]


#: The eight symmetries of a square as (transpose, flip x, flip y), applied in this order.
SQUARE = {"identity": (0, 0, 0), "hflip": (0, 1, 0), "vflip": (0, 0, 1), "rotate180": (0, 1, 1), "transpose": (1, 0, 0), "rotate90": (1, 1, 0), "rotate270": (1, 0, 1), "antitranspose": (1, 1, 1)}
SQUARE_NAMES = {v: k for k, v in SQUARE.items()}


def then(a: str, b: str) -> str:
    """The symmetry that does a and then b: b's transpose swaps a's flips."""
    ta, xa, ya = SQUARE[a]
    tb, xb, yb = SQUARE[b]
    if tb:
        xa, ya = ya, xa
    return SQUARE_NAMES[(ta ^ tb, xa ^ xb, ya ^ yb)]
