"""The thirteen scoring terms of a palette, each written once for columns and for arrays.

`evaluate(palette, o)` returns the raw penalty and its components.  `palette` is a
list of decoded slots with l, a, b, c, h, luminance and gate; o is the backend,
which also holds the samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..config import finite, require
from ..errors import InvalidGroupTerm, InvalidProblem
from ..functions.backends import EPS
from ..functions.color import contrast_ratio
from ..functions.numeric import circular_distance, clamp01, distance2, distance_to_arc, project_to_arc, pseudo_huber, relu, softmin, softmin_samples, wrap_float


@dataclass(frozen=True)
class AtLeast:
    value: float


@dataclass(frozen=True)
class AtMost:
    value: float


@dataclass(frozen=True)
class Within:
    min: float
    max: float


@dataclass(frozen=True)
class Near:
    value: float
    delta: float


Target = AtLeast | AtMost | Within | Near


def target_penalty(v, target: Target, hinge: float, o, least_delta: float = 1e-6):
    """Hinges on the sides of a bound or range, or a penalty around a value."""
    if isinstance(target, Near):
        return pseudo_huber(v - target.value, max(target.delta, least_delta), o)
    low, high = {AtLeast: ("value", None), AtMost: (None, "value"), Within: ("min", "max")}[type(target)]
    total = 0.0
    if low:
        total = total + pseudo_huber(relu(getattr(target, low) - v, o), hinge, o)
    if high:
        total = total + pseudo_huber(relu(v - getattr(target, high), o), hinge, o)
    return total


def check_target(target: Target, name: str) -> None:
    if isinstance(target, Within):
        require(finite(target.min, target.max) and target.min <= target.max, f"{name} range must be finite and satisfy min <= max", InvalidProblem)
    else:
        require(finite(target.value), f"{name} bound must be finite", InvalidProblem)
    if isinstance(target, Near):
        require(finite(target.delta) and target.delta > 0, f"{name}.delta must be finite and > 0", InvalidProblem)


@dataclass(frozen=True)
class Term:
    """Base: index and hinge checks, and names."""

    default_name = "term"
    hinge_default = 0.03

    def slot_indices(self) -> tuple[int, ...]:
        return tuple(getattr(self, n) for n in ("slot", "a", "b", "fg", "bg") if hasattr(self, n))

    def hinge(self) -> float:
        given = getattr(self, "hinge_delta", None)
        return self.hinge_default if given is None else given

    def validate(self, n_slots: int) -> None:
        for i in self.slot_indices():
            require(0 <= i < n_slots, f"{self.default_name} index {i} out of range 0..{max(n_slots - 1, 0)}", InvalidProblem)
        given = getattr(self, "hinge_delta", None)
        require(given is None or finite(given) and given > 0, f"{self.default_name}.hinge_delta must be finite and > 0", InvalidProblem)


def _lab(slot):
    return slot.l, slot.a, slot.b


def _sample_lab(s):
    return s["l"], s["a"], s["b"]


@dataclass(frozen=True)
class Cover(Term):
    """Every sample should have a slot nearby."""

    slots: tuple[int, ...]
    tau: float
    delta: float
    default_name = "cover"

    def slot_indices(self):
        return self.slots

    def validate(self, n_slots):
        require(len(self.slots) > 0, "cover slots cannot be empty", InvalidProblem)
        super().validate(n_slots)

    def evaluate(self, palette, o):
        if not self.slots:
            return o.const(0.0), []
        soft = lambda s: softmin([distance2(_lab(palette[i]), _sample_lab(s)) for i in self.slots], self.tau, o)
        return o.sum_samples(lambda s: o.maximum(s["weight"], 0.0) * pseudo_huber(soft(s), self.delta, o)), [o.sum_samples(soft) / o.n_samples()]


@dataclass(frozen=True)
class Support(Term):
    """Every slot should have a weighty sample nearby."""

    slots: tuple[int, ...]
    tau: float
    beta: float
    epsilon: float
    default_name = "support"

    def slot_indices(self):
        return self.slots

    def validate(self, n_slots):
        require(len(self.slots) > 0, "support slots cannot be empty", InvalidProblem)
        super().validate(n_slots)

    def evaluate(self, palette, o):
        if not self.slots:
            return o.const(0.0), []
        cost = lambda i: lambda s: distance2(_lab(palette[i]), _sample_lab(s)) - self.beta * o.log(o.maximum(s["weight"], 0.0) + self.epsilon)
        total = sum(softmin_samples(cost(i), self.tau, o) for i in self.slots)
        return total, [total / float(len(self.slots))]


def estimate_saliency(slot, sigma: float, o):
    """Kernel-weighted mean saliency of the samples around a colour; weights of samples don't count."""
    k = lambda s: o.exp(distance2(_lab(slot), _sample_lab(s)) * (-1.0 / (2.0 * max(sigma, 1e-6) ** 2)))
    mass = o.sum_samples(k)
    return o.where(mass <= EPS, o.const(0.0), o.sum_samples(lambda s: clamp01(s["saliency"], o) * k(s)) / o.maximum(mass, EPS))


@dataclass(frozen=True)
class SaliencyTerm(Term):
    slot: int
    sigma: float
    target: Target
    hinge_delta: float | None = None
    default_name = "saliency"
    hinge_default = 0.05

    def validate(self, n_slots):
        super().validate(n_slots)
        require(finite(self.sigma) and self.sigma > 0, "saliency sigma must be finite and > 0", InvalidProblem)

    def evaluate(self, palette, o):
        v = estimate_saliency(palette[self.slot], self.sigma, o)
        return target_penalty(v, self.target, max(self.hinge(), EPS), o, 1e-4), [v]


@dataclass(frozen=True)
class LightnessTarget(Term):
    slot: int
    target: Target
    hinge_delta: float | None = None
    default_name = "lightness_target"
    axis = "l"

    def validate(self, n_slots):
        super().validate(n_slots)
        check_target(self.target, f"{self.default_name}.target")

    def evaluate(self, palette, o):
        v = getattr(palette[self.slot], self.axis)
        return target_penalty(v, self.target, self.hinge(), o), [v]


@dataclass(frozen=True)
class ChromaTarget(LightnessTarget):
    default_name = "chroma_target"
    hinge_default = 0.02
    axis = "c"


@dataclass(frozen=True)
class HueCentre:
    center: float
    delta: float


@dataclass(frozen=True)
class HueWithin:
    start: float
    end: float
    delta: float


@dataclass(frozen=True)
class HueTarget(Term):
    slot: int
    target: HueCentre | HueWithin
    use_hue_gate: bool = True
    default_name = "hue_target"

    def validate(self, n_slots):
        super().validate(n_slots)
        ends = (self.target.center,) if isinstance(self.target, HueCentre) else (self.target.start, self.target.end)
        require(finite(*ends), "hue target must be finite", InvalidProblem)
        require(finite(self.target.delta) and self.target.delta > 0, "hue target delta must be finite and > 0", InvalidProblem)

    def evaluate(self, palette, o):
        slot, t = palette[self.slot], self.target
        d = circular_distance(slot.h, o.const(t.center), o) if isinstance(t, HueCentre) else distance_to_arc(slot.h, t.start, t.end, o)
        raw = pseudo_huber(d, max(t.delta, 1e-6), o)
        return raw * slot.gate if self.use_hue_gate else raw, [slot.h, d, slot.gate]


@dataclass(frozen=True)
class DeltaL(Term):
    a: int
    b: int
    target: Target
    hinge_delta: float | None = None
    default_name = "delta_l"
    axis = "l"

    def evaluate(self, palette, o):
        v = o.absolute(getattr(palette[self.a], self.axis) - getattr(palette[self.b], self.axis))
        return target_penalty(v, self.target, self.hinge(), o), [v]


@dataclass(frozen=True)
class DeltaC(DeltaL):
    default_name = "delta_c"
    axis = "c"


@dataclass(frozen=True)
class DeltaH(DeltaL):
    default_name = "delta_h"
    hinge_default = 0.08

    def evaluate(self, palette, o):
        v = circular_distance(palette[self.a].h, palette[self.b].h, o)
        gate = palette[self.a].gate * palette[self.b].gate
        return target_penalty(v, self.target, self.hinge(), o) * gate, [v, gate]


@dataclass(frozen=True)
class Distance(Term):
    a: int
    b: int
    target: Target
    squared: bool = False
    hinge_delta: float | None = None
    default_name = "distance"

    def validate(self, n_slots):
        super().validate(n_slots)
        check_target(self.target, "distance.target")

    def evaluate(self, palette, o):
        d2 = distance2(_lab(palette[self.a]), _lab(palette[self.b]))
        v = d2 if self.squared else o.sqrt(d2)
        hinge = self.hinge_delta if self.hinge_delta is not None else 0.002 if self.squared else 0.03
        return target_penalty(v, self.target, hinge, o), [v, d2]


@dataclass(frozen=True)
class Order(Term):
    """`a` brighter (or darker) than `b` by `delta`."""

    a: int
    b: int
    delta: float
    brighter: bool = True
    hinge_delta: float | None = None
    default_name = "order"

    def evaluate(self, palette, o):
        gap = palette[self.a].l - palette[self.b].l
        return pseudo_huber(relu(self.delta - (gap if self.brighter else -gap), o), self.hinge(), o), [gap]


@dataclass(frozen=True)
class Contrast(Term):
    fg: int
    bg: int
    min_ratio: float
    hinge_delta: float | None = None
    default_name = "contrast"
    hinge_default = 0.25

    def validate(self, n_slots):
        super().validate(n_slots)
        require(finite(self.min_ratio) and self.min_ratio > 0, "contrast min_ratio must be finite and > 0", InvalidProblem)

    def evaluate(self, palette, o):
        ratio = contrast_ratio(palette[self.fg].luminance, palette[self.bg].luminance, o)
        return pseudo_huber(relu(self.min_ratio - ratio, o), self.hinge(), o), [ratio]


@dataclass(frozen=True)
class UniformRange:
    min: float
    max: float


@dataclass(frozen=True)
class ExplicitValues:
    values: tuple[float, ...]


@dataclass(frozen=True)
class ExplicitQuantiles:
    """(quantile, value) knots."""

    knots: tuple[tuple[float, float], ...]


def quantile_centres(masses) -> list[float]:
    """Middles of the members' shares of the total mass."""
    require(len(masses) > 0, "masses must be non-empty", InvalidGroupTerm)
    require(all(finite(m) and m > 0 for m in masses), "all masses must be finite and > 0", InvalidGroupTerm)
    total = math.fsum(masses)
    require(total > EPS, "sum of masses must be > 0", InvalidGroupTerm)
    out, before = [], 0.0
    for m in masses:
        out.append((before + 0.5 * m) / total)
        before += m
    return out


def interpolate_quantile(q: float, knots) -> float:
    """Piecewise linear, flat beyond the ends; a knot without width gives its first value."""
    if q <= knots[0][0]:
        return knots[0][1]
    for (q0, v0), (q1, v1) in zip(knots[:-1], knots[1:]):
        if q0 <= q <= q1 and q < knots[-1][0]:
            t = 0.0 if abs(q1 - q0) <= EPS else (q - q0) / (q1 - q0)
            return v0 * (1.0 - t) + v1 * t
    return knots[-1][1]


def group_targets(centres, target) -> list[float]:
    if isinstance(target, UniformRange):
        return [target.min + q * (target.max - target.min) for q in centres]
    if isinstance(target, ExplicitValues):
        require(len(target.values) == len(centres), "ExplicitValues length must match slots", InvalidGroupTerm)
        return list(target.values)
    require(len(target.knots) >= 2, "ExplicitQuantiles requires at least 2 knots", InvalidGroupTerm)
    require(all(x[0] <= y[0] for x, y in zip(target.knots[:-1], target.knots[1:])), "quantiles must be non-decreasing", InvalidGroupTerm)
    return [interpolate_quantile(q, target.knots) for q in centres]


@dataclass(frozen=True)
class GroupQuantile(Term):
    """Members (slot, mass) spread along an axis: lightness, chroma or an arc of hues (start, end).

    min_gap asks for monotone values: above 0 rising, with `falling` falling.
    """

    members: tuple[tuple[int, float], ...]
    axis: str | tuple[float, float]
    target: UniformRange | ExplicitValues | ExplicitQuantiles
    huber_delta: float
    min_gap: float | None = None
    falling: bool = False
    default_name = "group_quantile"

    def slot_indices(self):
        return tuple(s for s, _ in self.members)

    def validate(self, n_slots):
        require(len(self.members) > 0, "group members cannot be empty", InvalidGroupTerm)
        super().validate(n_slots)
        if not isinstance(self.axis, str):
            require(wrap_float(self.axis[1] - self.axis[0]) > 0, "hue arc must have positive arc length", InvalidGroupTerm)
        group_targets(quantile_centres([m for _, m in self.members]), self.target)
        require(self.min_gap is None or finite(self.min_gap) and self.min_gap >= 0, "min_gap must be finite and >= 0", InvalidGroupTerm)

    def values(self, palette, o):
        if self.axis == "lightness":
            return [palette[s].l for s, _ in self.members]
        if self.axis == "chroma":
            return [palette[s].c for s, _ in self.members]
        return [project_to_arc(palette[s].h, *self.axis, o) for s, _ in self.members]

    def evaluate(self, palette, o):
        if not self.members:
            return o.const(0.0), []
        try:
            targets = group_targets(quantile_centres([m for _, m in self.members]), self.target)
        except InvalidGroupTerm:
            return o.const(1e12), []
        delta, values = max(self.huber_delta, 1e-6), self.values(palette, o)
        raw = sum(pseudo_huber(v - t, delta, o) for v, t in zip(values, targets))
        if self.min_gap is not None:
            for x, y in zip(values[:-1], values[1:]):
                gap = x - y if self.falling else y - x
                raw = raw + pseudo_huber(relu(self.min_gap - gap, o), delta, o)
        return raw, [sum(o.absolute(v - t) for v, t in zip(values, targets)) / float(len(values))]
