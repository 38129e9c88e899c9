"""AnyRes tiling of one image."""

from __future__ import annotations

import numpy as np

from ..functions.tables import select_grid
from .kernels import resize


def tiles(img: np.ndarray, tile_size: int = 448, max_tiles: int = 6, include_thumbnail: bool = True, interpolation: str = "bilinear") -> list[np.ndarray]:
    """The image resized to its best grid and cut into square tiles; a thumbnail of the whole comes last."""
    cols, rows = select_grid(img.shape[1], img.shape[0], max_tiles)
    big = resize(img, cols * tile_size, rows * tile_size, interpolation)
    out = [np.ascontiguousarray(big[r * tile_size : (r + 1) * tile_size, c * tile_size : (c + 1) * tile_size]) for r in range(rows) for c in range(cols)]
    return [*out, np.ascontiguousarray(resize(img, tile_size, tile_size, interpolation))] if include_thumbnail else out
