"""Scalar functions on hue angles, penalties and soft minima.  `o` is a backend; hues are radians."""

from __future__ import annotations

import math
from collections.abc import Sequence

from .backends import COLUMNS, EPS, TAU


def wrap_hue(h, o=COLUMNS):
    """To [0, 2 pi) by the truncated remainder; 0 where not finite."""
    r = o.remainder(o.where(o.finite(h), h, o.const(0.0)), TAU)
    return o.where(r < 0.0, r + TAU, r)


def arc_length(start, end, o=COLUMNS):
    """Counter-clockwise from start to end; a full circle is 0."""
    return wrap_hue(end - start, o)


def circular_distance(x, y, o=COLUMNS):
    d = o.absolute(wrap_hue(x, o) - wrap_hue(y, o))
    return o.minimum(d, TAU - d)


def distance_to_arc(h, start: float, end: float, o=COLUMNS):
    """0 on the arc, else the distance to its nearer end."""
    start, end = wrap_float(start), wrap_float(end)
    h = wrap_hue(h, o)
    return o.where(wrap_hue(h - start, o) <= wrap_float(end - start) + EPS, o.const(0.0), o.minimum(circular_distance(h, o.const(start), o), circular_distance(h, o.const(end), o)))


def wrap_float(h: float) -> float:
    r = math.fmod(h, TAU) if math.isfinite(h) else 0.0
    return r + TAU if r < 0 else r


def project_to_arc(h, start: float, end: float, o=COLUMNS):
    """The offset of a hue along an arc; beyond it, the nearer end (its end on a tie)."""
    length = wrap_float(end - start)
    if length <= EPS:
        return h * 0.0
    d = wrap_hue(wrap_hue(h, o) - wrap_float(start), o)
    return o.where(d <= length, d, o.where(o.absolute(d - length) <= TAU - d, o.const(length), o.const(0.0)))


def sigmoid(x, o=COLUMNS):
    """Logistic function; the exponential never overflows."""
    z = o.exp(-o.absolute(x))
    return o.where(x >= 0.0, o.const(1.0) / (1.0 + z), z / (1.0 + z))


def inv_sigmoid(y, o=COLUMNS):
    y = o.minimum(o.maximum(y, EPS), 1.0 - EPS)
    return o.log(y / (1.0 - y))


def relu(x, o=COLUMNS):
    return o.maximum(x, 0.0)


def clamp01(x, o=COLUMNS):
    return o.maximum(o.minimum(x, 1.0), 0.0)


def pseudo_huber(z, delta: float, o=COLUMNS):
    d = max(delta, EPS)
    t = z / d
    return d * d * (o.sqrt(1.0 + t * t) - 1.0)


def smoothstep(x, o=COLUMNS):
    t = clamp01(x, o)
    return t * t * (3.0 - 2.0 * t)


def softmin(values: Sequence, tau: float, o=COLUMNS):
    """Of a fixed, small number of values; the hard minimum where tau is next to 0, 0 where there is none."""
    if not values:
        return o.const(0.0)
    least = values[0]
    for v in values[1:]:
        least = o.minimum(least, v)
    if tau <= EPS:
        return least
    # relative to the least value, so that no exponential overflows
    total = sum(o.exp((least - v) / tau) for v in values)
    return least - tau * o.log(total)


def softmin_samples(f, tau: float, o):
    """Of f(sample) over all samples."""
    least = o.min_samples(f)
    if tau <= EPS:
        return least
    return least - tau * o.log(o.sum_samples(lambda s: o.exp((least - f(s)) / tau)))


def distance2(p, q):
    """Squared Oklab distance of two (l, a, b)."""
    return sum((x - y) * (x - y) for x, y in zip(p, q))
