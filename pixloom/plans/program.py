"""Sampled programs: flat lists of deterministic operations, with JSON forms."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions import tables as T

VERSION = 2
#: Operations by what the planner may do with them, with their parameters' defaults.
POINTWISE_TABLE = {
    "brightness": {"delta": 0}, "contrast": {"factor": 1}, "gamma": {"gamma": 1}, "invert": {}, "posterize": {"bits": 4}, "solarize": {"threshold": 128},
    "rgb_shift": {"r_shift": 0, "g_shift": 0, "b_shift": 0}, "lut": {"table": None},
}
MATRIX = {
    "to_sepia": {}, "color_temperature": {"temperature": 0}, "color_balance": {"r_scale": 1, "g_scale": 1, "b_scale": 1}, "color_tint": {"tint": (0, 0, 0, 0)},
    "channel_shuffle": {"order": "RGB"}, "channel_mix": {"matrix": None}, "matrix": {"matrix": None},
}
POINTWISE = {"hue_saturation_value": {"hue_shift": 0, "saturation_scale": 1, "value_scale": 1}, "to_gray": {}, "to_rgb": {}, "sums": {"tables": None}}
HISTOGRAM = {"equalize": {"then": None}, "auto_contrast": {"cutoff": 0.0, "then": None}}
SQUARE = {"horizontal_flip": {}, "vertical_flip": {}, "transpose": {}, "rotate": {"angle": 90}, "square": {"element": "identity"}}
GEOMETRY = {
    "crop": {"x": 0, "y": 0, "width": 100, "height": 100}, "random_crop": {"width": 100, "height": 100, "fx": 0.0, "fy": 0.0}, "pad": {"top": 0, "right": 0, "bottom": 0, "left": 0, "mode": "reflect", "value": 0},
    "resize": {"width": 100, "height": 100, "interpolation": "bilinear"}, "affine": {"scale": 1.0, "rotate": 0.0, "translate": (0, 0), "shear": (0, 0), "interpolation": "bilinear", "border_mode": "constant", "value": 0},
}
KERNEL = {
    "gaussian_blur": {"kernel_size": 3}, "gaussian_blur_sigma": {"sigma": 1.0, "quality": "exact"}, "box_blur": {"radius": 1}, "median_blur": {"kernel_size": 3}, "sharpen": {"strength": 0.5},
    "emboss": {"direction": "top_left", "alpha": 0.5, "strength": 0.5}, "edge_detection": {"method": "sobel"}, "convolve": {"taps": None, "scale": 1},
}
NOISE = {
    "gauss_noise": {"mean": 0, "std": 10, "seed": 0}, "multiplicative_noise": {"multiplier": 1, "std": 0.1, "granularity": "vector", "block": 8, "seed": 0}, "salt_and_pepper": {"amount": 0.05, "salt_vs_pepper": 0.5, "seed": 0},
    "coarse_dropout": {"holes": 8, "hole_size": (0.08, 0.08), "fill": 0, "seed": 0}, "grid_dropout": {"ratio": 0.5, "unit_size": 16, "holes": 4, "fill": 0, "seed": 0},
}
TERMINAL = {"normalize": {"mean": 0, "std": 1}}
OPS = POINTWISE_TABLE | MATRIX | POINTWISE | HISTOGRAM | SQUARE | GEOMETRY | KERNEL | NOISE | TERMINAL
#: Operations that move pixels and labels.
MOVES = SQUARE.keys() | GEOMETRY.keys()
#: Parameters that are drawn as integers.
INTEGERS = {"bits", "threshold", "x", "y", "width", "height", "top", "right", "bottom", "left", "kernel_size", "hue_shift", "holes", "unit_size", "angle", "radius"}


@dataclass(frozen=True)
class Op:
    name: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in OPS:
            raise ValueError(f"unknown operation {self.name}")
        if odd := self.params.keys() - OPS[self.name].keys():
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(odd))}")
        object.__setattr__(self, "params", {**OPS[self.name], **self.params})

    def __getitem__(self, name):
        return self.params[name]

    def __str__(self):
        said = ", ".join(f"{k}={v}" for k, v in self.params.items() if v != OPS[self.name][k] and k not in ("table", "tables", "then"))
        return f"{self.name}({said})"


def tables(op: Op) -> list[list[int]] | None:
    """The lookup table of a table operation, or its three tables; None for other operations."""
    if op.name == "rgb_shift":
        return T.rgb_shift(**op.params)
    if op.name == "lut":
        return op["table"]
    if op.name in POINTWISE_TABLE:
        return [getattr(T, op.name)(**op.params)]
    return None


def matrix(op: Op) -> list[list[float]] | None:
    """The 3x3 matrix of a matrix operation."""
    match op.name:
        case "to_sepia":
            return T.SEPIA
        case "color_temperature":
            return T.temperature(op["temperature"])
        case "color_balance":
            return T.diagonal(op["r_scale"], op["g_scale"], op["b_scale"])
        case "color_tint":
            return T.tint(op["tint"])
        case "channel_shuffle":
            return T.permutation(op["order"])
        case "channel_mix":
            return T.MIXES.get(op["matrix"], op["matrix"]) if isinstance(op["matrix"], str) else op["matrix"]
        case "matrix":
            return op["matrix"]
    return None


def square(op: Op) -> str | None:
    """The symmetry of a flip, transpose or rotation."""
    names = {"horizontal_flip": "hflip", "vertical_flip": "vflip", "transpose": "transpose"}
    if op.name == "rotate":
        angle = str(op["angle"]).lower().removeprefix("rotate")
        if angle not in ("90", "180", "270"):
            raise ValueError("angle must be 90, 180 or 270")
        return f"rotate{angle}"
    return op["element"] if op.name == "square" else names.get(op.name)


class Program:
    """A flat list of operations; what one image (or clip) goes through."""

    def __init__(self, ops=(), version: int = VERSION):
        self.ops, self.version = [o if isinstance(o, Op) else Op(*o) for o in ops], version

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[Op]:
        return iter(self.ops)

    def __getitem__(self, k):
        return Program(self.ops[k]) if isinstance(k, slice) else self.ops[k]

    def __add__(self, other: Program) -> Program:
        return Program([*self.ops, *other.ops])

    def __eq__(self, other) -> bool:
        return isinstance(other, Program) and self.to_json() == other.to_json()

    def __repr__(self) -> str:
        return f"Program([{', '.join(map(str, self.ops))}])"

    def to_dict(self) -> dict:
        return {"version": self.version, "ops": [{"op": o.name, **o.params} for o in self.ops]}

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=lambda x: x.tolist() if isinstance(x, np.ndarray | np.generic) else list(x))

    @classmethod
    def from_json(cls, text: str) -> Program:
        data = json.loads(text)
        if data.get("version") != VERSION:
            raise ValueError(f"program version {data.get('version')} is not {VERSION}")
        return cls([Op(o["op"], {k: tuple(v) if isinstance(v, list) and k not in ("table", "tables", "matrix", "taps", "then") else v for k, v in o.items() if k != "op"}) for o in data["ops"]])

    def to_bytes(self) -> bytes:
        return self.to_json().encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Program:
        return cls.from_json(data.decode())

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str) -> Program:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    def summary(self) -> str:
        return "\n".join(f"{k}: {o}" for k, o in enumerate(self.ops)) or "(nothing)"

    def moves(self) -> Program:
        """What masks go through: only operations that move pixels, without blending neighbours."""
        out = []
        for o in self.ops:
            if o.name in MOVES:
                out.append(Op(o.name, {**o.params, "interpolation": "nearest"}) if "interpolation" in o.params else o)
        return Program(out)

    def validate(self, width: int, height: int) -> tuple[int, int]:
        """The size after the last operation; raises where a window leaves the image or normalize isn't last."""
        for k, o in enumerate(self.ops):
            if o.name in TERMINAL and k < len(self.ops) - 1:
                raise ValueError("normalize must be the last operation: its result is float32")
            width, height = size_after(o, width, height)
        return width, height


def window(op: Op, width: int, height: int) -> tuple[int, int, int, int]:
    """(x, y, width, height) that a crop takes."""
    w, h = op["width"], op["height"]
    if op.name == "random_crop":
        if w > width or h > height:
            raise ValueError(f"a window of {w}x{h} is larger than the image of {width}x{height}")
        x, y = (min(int(f * (slack + 1)), slack) for f, slack in ((op["fx"], width - w), (op["fy"], height - h)))
        return x, y, w, h
    if op["x"] < 0 or op["y"] < 0 or w < 1 or h < 1 or op["x"] + w > width or op["y"] + h > height:
        raise ValueError(f"the window {op['x']},{op['y']} {w}x{h} leaves the image of {width}x{height}")
    return op["x"], op["y"], w, h


def size_after(op: Op, width: int, height: int) -> tuple[int, int]:
    if op.name in ("crop", "random_crop"):
        return window(op, width, height)[2:]
    if op.name == "resize":
        return op["width"], op["height"]
    if op.name == "pad":
        return width + op["left"] + op["right"], height + op["top"] + op["bottom"]
    element = square(op)
    return (height, width) if element and T.SQUARE[element][0] else (width, height)
