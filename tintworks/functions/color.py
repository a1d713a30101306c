"""Colour conversions: sRGB, linear RGB, Oklab, OkLCh, luminance and contrast."""

from __future__ import annotations

from .backends import COLUMNS
from .numeric import wrap_hue

# Linear sRGB to cone responses, their roots to Oklab, and the inverses of both.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
ROOTS_TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
LAB_TO_ROOTS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
LUMINANCE = (0.2126, 0.7152, 0.0722)


def _times(matrix, v):
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)


def srgb_to_linear(v, o=COLUMNS):
    """Of a gamma-encoded value in 0 to 1."""
    return o.where(v <= 0.04045, v / 12.92, o.power((v + 0.055) / 1.055, 2.4))


def cone_roots(rgb, o=COLUMNS):
    return tuple(o.cbrt(x) for x in _times(RGB_TO_LMS, rgb))


def roots_to_oklab(roots):
    return _times(ROOTS_TO_LAB, roots)


def linear_to_oklab(rgb, o=COLUMNS):
    return roots_to_oklab(cone_roots(rgb, o))


def oklab_to_linear(lab):
    """Not clipped: outside the gamut, channels are below 0 or above 1."""
    return _times(LMS_TO_RGB, tuple(x * x * x for x in _times(LAB_TO_ROOTS, lab)))


def relative_luminance(rgb, o=COLUMNS):
    return o.maximum(sum(k * o.maximum(x, 0.0) for k, x in zip(LUMINANCE, rgb)), 0.0)


def contrast_ratio(y1, y2, o=COLUMNS):
    return (o.maximum(y1, y2) + 0.05) / (o.minimum(y1, y2) + 0.05)


def oklab_to_oklch(lab, o=COLUMNS):
    l, a, b = lab
    return l, o.sqrt(a * a + b * b), wrap_hue(o.atan2(b, a), o)


def oklch_to_oklab(lch, o=COLUMNS):
    l, c, h = lch
    h = wrap_hue(h, o)
    return l, c * o.cos(h), c * o.sin(h)
