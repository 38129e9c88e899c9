"""Resizing and affine maps, compiled: places and weights are worked out once a shape and serve every image of it.

A plan depends on sizes and parameters alone.  It is kept for the shapes in use, so
an image, or a batch of equally large ones, costs gathers and sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions import tables as T

#: Pixels of a result up to which an affine plan is kept (32 bytes a pixel), and plans kept.
KEPT_PIXELS, KEPT = 1 << 20, 4


def border(at: np.ndarray, n: int, mode: str) -> np.ndarray:
    if mode == "wrap":
        return at % n
    if mode == "reflect":
        at = np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - at - 1, at))
    elif mode != "replicate":
        raise ValueError(f"unknown border {mode}")
    return np.clip(at, 0, n - 1)


def _taps(size: int, new: int):
    at = (np.arange(new) + 0.5) * (size / new) - 0.5
    low = np.clip(np.floor(at).astype(int), 0, size - 1)
    return low, np.minimum(low + 1, size - 1), np.where((at < 0) | (at >= size - 1), 0.0, at - np.floor(at))


def _samples(pixels: np.ndarray, c: int) -> np.ndarray:
    return (pixels[:, None] * c + np.arange(c)).ravel()


@lru_cache(64)
def resize_plan(h: int, w: int, c: int, width: int, height: int):
    """(rows read, samples left and right in a row, the right one's share, rows above and below among those read, the lower one's share)."""
    (y0, y1, fy), (x0, x1, fx) = _taps(h, height), _taps(w, width)
    rows = np.unique(np.concatenate([y0, y1]))
    return rows, _samples(x0, c), _samples(x1, c), fx.repeat(c), np.searchsorted(rows, y0), np.searchsorted(rows, y1), fy[:, None]


@lru_cache(64)
def nearest_plan(h: int, w: int, c: int, width: int, height: int):
    return np.minimum(np.arange(height) * h // height, h - 1), _samples(np.minimum(np.arange(width) * w // width, w - 1), c)


def resize(images: np.ndarray, width: int, height: int, interpolation: str = "bilinear") -> np.ndarray:
    """(..., h, w, c) at a new size; rows are mixed across once, then down."""
    *lead, h, w, c = images.shape
    if (w, h) == (width, height):
        return images
    flat = images.reshape(-1, h, w * c)
    out = np.empty((len(flat), height, width * c), np.uint8)
    if interpolation == "nearest":
        rows, cols = nearest_plan(h, w, c, width, height)
        for k, img in enumerate(flat):
            np.take(img[rows], cols, axis=1, out=out[k], mode="clip")
        return out.reshape(*lead, height, width, c)
    rows, x0, x1, fx, y0, y1, fy = resize_plan(h, w, c, width, height)
    total, part = np.empty((height, width * c)), np.empty((height, width * c))
    left, right, got = np.empty((len(rows), width * c)), np.empty((len(rows), width * c)), np.empty((len(rows), width * c), np.uint8)
    for k, img in enumerate(flat):  # one by one, so that the sums stay in cache
        read = img if len(rows) == h else img[rows]
        np.multiply(np.take(read, x0, axis=1, out=got, mode="clip"), 1 - fx, out=left)
        np.multiply(np.take(read, x1, axis=1, out=got, mode="clip"), fx, out=right)
        np.multiply(np.take(left, y0, axis=0, out=part, mode="clip"), 1 - fy, out=total)
        for side, at, share in ((right, y0, 1 - fy), (left, y1, fy), (right, y1, fy)):
            np.take(side, at, axis=0, out=part, mode="clip")
            part *= share
            total += part
        total += 0.5  # no mean of bytes leaves their range
        out[k] = total
    return out.reshape(*lead, height, width, c)


def _affine(h: int, w: int, scale, rotate, translate, shear, interpolation: str, border_mode: str):
    """(places, weights): the flat place of each tap of each pixel, h * w for one outside, and its weight in 65536ths."""
    a, b, c, d, e, f = T.inverse_affine(w, h, scale, rotate, translate, shear)
    fixed = lambda v: np.floor(np.asarray(v, np.float64) * 65536 + 0.5).astype(np.int64)
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    sx, sy = fixed(b * y + c) + x * fixed(a), fixed(e * y + f) + x * fixed(d)

    def at(px, py):
        if border_mode == "constant":
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            return np.where(inside, py * w + px, h * w).ravel().astype(np.int64)
        if border_mode == "reflect":  # repeats beyond one image's width
            px, py = (np.where(p % (2 * n) >= n, 2 * n - 1 - p % (2 * n), p % (2 * n)) for p, n in ((px, w), (py, h)))
        return (border(py, h, border_mode) * w + border(px, w, border_mode)).ravel().astype(np.int64)

    if interpolation == "nearest":
        return [at((sx + 32768) >> 16, (sy + 32768) >> 16)], []
    px, py, fx, fy = sx >> 16, sy >> 16, (sx >> 8) & 255, (sy >> 8) & 255
    places = [at(px + i, py + j) for j in (0, 1) for i in (0, 1)]
    return places, [(u * v).ravel().astype(np.int32) for v in (256 - fy, fy) for u in (256 - fx, fx)]


_kept_affine = lru_cache(KEPT)(_affine)


def _settled(v):
    return tuple(v) if isinstance(v, list | tuple) else v


def affine(images: np.ndarray, scale=1.0, rotate=0.0, translate=(0, 0), shear=(0, 0), interpolation="bilinear", border_mode="constant", value=0, once: bool = False) -> np.ndarray:
    """(..., h, w, c) about the centre, in 16.16 fixed point; `once` keeps no plan, for parameters that don't come again."""
    *lead, h, w, c = images.shape
    plan = _affine if once or h * w > KEPT_PIXELS else _kept_affine
    places, weights = plan(h, w, _settled(scale), rotate, _settled(translate), _settled(shear), interpolation, border_mode)
    flat, n = images.reshape(-1, h * w, c), h * w
    out = np.empty(flat.shape, np.uint8)
    plane, got = np.full(n + 1, int(value), np.uint8), np.empty(n, np.uint8)
    total, part = np.empty(n, np.int32), np.empty(n, np.int32)
    for k, img in enumerate(flat):
        for j in range(c):
            plane[:n] = img[:, j]
            if not weights:
                out[k, :, j] = np.take(plane, places[0], out=got, mode="clip")
                continue
            total.fill(32768)
            for at, weight in zip(places, weights, strict=True):
                np.multiply(np.take(plane, at, out=got, mode="clip"), weight, out=part)
                total += part
            total >>= 16
            out[k, :, j] = total
    return out.reshape(images.shape)
