"""Values worked out once on the driver."""

from __future__ import annotations


def linear_background(color: tuple[int, int, int]) -> tuple[float, float, float]:
    scaled = [c / 255.0 for c in color]
    return tuple(v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in scaled)
