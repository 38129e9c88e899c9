"""Random pipelines: a tree of transforms that a seed and a key sample to a program."""

from __future__ import annotations

from ..functions.draws import Bernoulli, Distribution, chance, distribution, pick, some, unit
from .planner import Plan, plan
from .program import INTEGERS, OPS, Op, Program

#: Other names of parameters.
ALIASES = {
    "rgb_shift": {"r": "r_shift", "g": "g_shift", "b": "b_shift", "r_shift_limit": "r_shift", "g_shift_limit": "g_shift", "b_shift_limit": "b_shift"},
    "gauss_noise": {"mu": "mean", "sigma": "std"}, "hue_saturation_value": {"hue": "hue_shift", "hue_shift_limit": "hue_shift", "sat": "saturation_scale", "val": "value_scale"}, "crop": {"x_min": "x", "y_min": "y", "w": "width", "h": "height"},
}


class Node:
    """Anything that samples to operations."""

    def sample(self, seed: int, key, path: str = "0") -> list[Op]:
        raise NotImplementedError


class Transform(Node):
    """One operation whose parameters are numbers or distributions, applied with probability p."""

    def __init__(self, name: str, p=None, **params):
        names = ALIASES.get(name, {})
        params = {names.get(k, k): v for k, v in params.items()}
        if name == "crop" and {"x_max", "y_max"} & params.keys():
            params |= {"width": params.pop("x_max") - params.get("x", 0), "height": params.pop("y_max") - params.get("y", 0)}
        if name == "gauss_noise" and "var_limit" in params:
            params["std"] = tuple(v**0.5 for v in params.pop("var_limit"))
        if name == "hue_saturation_value":  # shifts are parts of 255
            for shift, scale in (("sat_shift", "saturation_scale"), ("val_shift", "value_scale")):
                if shift in params or f"{shift}_limit" in params:
                    v = params.pop(shift, None) if shift in params else params.pop(f"{shift}_limit")
                    params[scale] = tuple(1 + x / 255 for x in v) if isinstance(v, tuple | list) else 1 + v / 255
        Op(name, {k: v for k, v in params.items()})  # checks the names
        self.name, self.params, self.p = name, params, chance(p)

    def sample(self, seed, key, path="0"):
        if self.p.draw(seed, f"{path}/p", key) < 1:
            return []
        out = {}
        for k, v in self.params.items():
            whole = isinstance(OPS[self.name][k], tuple)
            if isinstance(v, Distribution) or (isinstance(v, tuple | list) and len(v) == 2 and not whole):
                d = distribution(v)
                v = d.integer(seed, f"{path}/{k}", key) if k in INTEGERS else d.draw(seed, f"{path}/{k}", key)
            elif k in INTEGERS and isinstance(v, float):
                v = int(v)
            out[k] = v
        if self.name == "random_crop":
            out |= {a: unit(seed, f"{path}/{a}", key) for a in ("fx", "fy") if a not in out}
        if self.name == "crop":
            out |= {k: max(low, out[k]) for k, low in (("x", 0), ("y", 0), ("width", 1), ("height", 1)) if k in out}
        if "seed" in OPS[self.name] and "seed" not in out:
            out["seed"] = int(unit(seed, f"{path}/seed", key) * 2**31)
        return [Op(self.name, out)]

    def __repr__(self):
        return f"{self.name}({', '.join(f'{k}={v}' for k, v in self.params.items())})"


class Identity(Node):
    def __init__(self, p=None):
        self.p = p

    def sample(self, seed, key, path="0"):
        return []


class Maybe(Node):
    def __init__(self, child: Node, p=0.5):
        self.child, self.p = child, chance(p)

    def sample(self, seed, key, path="0"):
        return self.child.sample(seed, key, f"{path}/m") if self.p.draw(seed, f"{path}/p", key) >= 1 else []


class Choice(Node):
    """Exactly one child, by weights."""

    def __init__(self, transforms: list[Node], weights: list[float] | None = None, p=None):
        if not transforms:
            raise ValueError("Choice needs a transform")
        weights = [1.0] * len(transforms) if weights is None else list(weights)
        if len(weights) != len(transforms):
            raise ValueError("as many weights as transforms are needed")
        pick(0.0, weights)
        self.transforms, self.weights, self.p = list(transforms), weights, chance(p)

    def branch(self, seed, key, path="0") -> int:
        return pick(unit(seed, f"{path}/c", key), self.weights)

    def sample(self, seed, key, path="0"):
        if self.p.draw(seed, f"{path}/p", key) < 1:
            return []
        k = self.branch(seed, key, path)
        return self.transforms[k].sample(seed, key, f"{path}/{k}")


OneOf = Choice


class SomeOf(Node):
    """k different children, in their own random order."""

    def __init__(self, transforms: list[Node], k: int, p=None):
        self.transforms, self.k, self.p = list(transforms), k, chance(p)

    def sample(self, seed, key, path="0"):
        if self.p.draw(seed, f"{path}/p", key) < 1:
            return []
        return [o for i in some(seed, f"{path}/s", key, len(self.transforms), self.k) for o in self.transforms[i].sample(seed, key, f"{path}/{i}")]


def color_jitter(brightness=0.0, contrast=0.0, saturation=0.0, hue=0.0, p=None) -> SomeOf:
    """Brightness, contrast, then hue and saturation, each within its limit of no change."""
    steps = []
    for name, limit, build in (
        ("brightness", brightness, lambda v: {"delta": (-255 * v, 255 * v)}), ("contrast", contrast, lambda v: {"factor": (max(0, 1 - v), 1 + v)}),
        ("hue_saturation_value", saturation or hue, lambda v: {"saturation_scale": (max(0, 1 - saturation), 1 + saturation) if saturation else 1, "hue_shift": (-hue, hue) if hue else 0}),
    ):
        if limit:
            steps.append(Transform(name, **build(limit)))
    return Compose(steps, p=p)


class Compose(Node):
    """An ordered list of transforms; behaves as a sequence."""

    def __init__(self, transforms: list[Node], bbox_format: str = "xywh", keypoint_format: str = "xy", p=None):
        self.transforms, self.bbox_format, self.keypoint_format, self.p = list(transforms), bbox_format, keypoint_format, chance(p)

    def __len__(self):
        return len(self.transforms)

    def __iter__(self):
        return iter(self.transforms)

    def __getitem__(self, k):
        return Compose(self.transforms[k], self.bbox_format, self.keypoint_format) if isinstance(k, slice) else self.transforms[k]

    def __add__(self, other):
        return Compose([*self.transforms, *(other.transforms if isinstance(other, Compose) else [other])], self.bbox_format, self.keypoint_format)

    def __repr__(self):
        return f"Compose([{', '.join(map(repr, self.transforms))}])"

    def sample(self, seed, key, path="0"):
        if self.p.draw(seed, f"{path}/p", key) < 1:
            return []
        return [o for k, t in enumerate(self.transforms) for o in t.sample(seed, key, f"{path}/{k}")]

    def __call__(self, images, seed: int = 0, **targets):
        """images with image, boxes, points and masks after each row's program; see operators.targets.annotated."""
        from ..operators.targets import annotated

        return annotated(images, self, seed, **targets)

    def program(self, seed: int = 0, key=0) -> Program:
        return Program(self.sample(seed, key))

    def plan(self, seed: int = 0, key=0, optimize: bool = True) -> Plan:
        return plan(self.program(seed, key), optimize)

    def fixed(self) -> bool:
        """Whether every key samples the same program, which is then planned once."""
        def same(n: Node) -> bool:
            if isinstance(n, Transform):
                plain = all(not isinstance(v, Distribution) and not (isinstance(v, tuple | list) and not isinstance(OPS[n.name][k], tuple)) for k, v in n.params.items())
                return plain and n.name != "random_crop" and "seed" not in OPS[n.name] and _always(n.p)
            return isinstance(n, Identity) or isinstance(n, Compose) and _always(n.p) and all(map(same, n.transforms))

        return same(self)


def _always(p: Distribution) -> bool:
    return p == chance(None) or isinstance(p, Bernoulli) and p.p >= 1
