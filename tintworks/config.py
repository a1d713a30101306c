"""Configuration of the image stages, with the checks that each stage makes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from .errors import InvalidConfig, InvalidProblem

RESIZE_FILTERS = ("nearest", "triangle", "catmull_rom", "gaussian", "lanczos3")


def require(ok: bool, text: str, kind: type[Exception] = InvalidConfig) -> None:
    if not ok:
        raise kind(text)


def finite(*values: float) -> bool:
    return all(math.isfinite(v) for v in values)


@dataclass(frozen=True)
class PreprocessConfig:
    max_working_dim: int | None = None
    resize_filter: str = "lanczos3"
    background: tuple[int, int, int] = (255, 255, 255)
    min_alpha: float = 1.0 / 255.0
    alpha_into_weight: bool = False

    def validate(self) -> None:
        require(finite(self.min_alpha) and 0 <= self.min_alpha <= 1, "min_alpha must be finite and in [0, 1]")
        require(self.max_working_dim is None or self.max_working_dim > 0, "max_working_dim must be above 0")
        require(self.resize_filter in RESIZE_FILTERS, f"unknown resize filter {self.resize_filter}")
        require(len(self.background) == 3 and all(0 <= c <= 255 for c in self.background), "background must be three bytes")


@dataclass(frozen=True)
class NoSaliency:
    pass


@dataclass(frozen=True)
class GlobalContrast:
    robust: bool = True


@dataclass(frozen=True)
class LocalContrast:
    radius: int = 3
    color_weight: float = 1.0
    lightness_weight: float = 1.0
    global_mix: float = 0.2
    robust: bool = True

    def validate(self) -> None:
        require(self.radius >= 0, "radius must be 0 or more")
        require(finite(self.color_weight) and self.color_weight >= 0, "color_weight must be finite and >= 0")
        require(finite(self.lightness_weight) and self.lightness_weight >= 0, "lightness_weight must be finite and >= 0")
        require(finite(self.global_mix) and 0 <= self.global_mix <= 1, "global_mix must be in [0, 1]")


@dataclass(frozen=True)
class UniformGrid:
    step: int = 8

    def validate(self) -> None:
        require(self.step > 0, "step must be above 0")


@dataclass(frozen=True)
class Stratified:
    tiles_x: int
    tiles_y: int
    per_tile: int
    seed: int | None = None

    def validate(self) -> None:
        require(min(self.tiles_x, self.tiles_y, self.per_tile) > 0, "tiles and per_tile must be above 0")


@dataclass(frozen=True)
class RandomUniform:
    count: int
    seed: int | None = None

    def validate(self) -> None:
        require(self.count > 0, "count must be above 0")


@dataclass(frozen=True)
class FarthestPoint:
    count: int
    candidate_stride: int = 1
    saliency_bias: float = 0.0
    seed: int | None = None

    def validate(self) -> None:
        require(self.count > 0 and self.candidate_stride > 0, "count and candidate_stride must be above 0")
        require(finite(self.saliency_bias) and self.saliency_bias >= 0, "saliency_bias must be finite and >= 0")


@dataclass(frozen=True)
class ExportConfig:
    medoid: bool = False
    normalize_weights: bool = True
    saliency_to_weight_mix: float = 0.0
    saliency_weight_gamma: float = 1.0
    frequency_gamma: float = 1.0
    min_cluster_weight: float = 0.0

    def validate(self) -> None:
        for name in ("frequency_gamma", "saliency_weight_gamma", "min_cluster_weight"):
            require(finite(getattr(self, name)) and getattr(self, name) >= 0, f"{name} must be finite and >= 0")
        require(finite(self.saliency_to_weight_mix) and 0 <= self.saliency_to_weight_mix <= 1, "saliency_to_weight_mix must be in [0, 1]")


@dataclass(frozen=True)
class CapBuilder:
    n_l: int = 24
    n_h: int = 72
    smooth_l_radius: int = 1
    smooth_h_radius: int = 2
    relax: float = 1.0
    from_samples: bool = False

    def validate(self) -> None:
        require(self.n_l >= 2 and self.n_h >= 2, "image cap grid must be at least 2x2", InvalidProblem)
        require(finite(self.relax) and self.relax > 0, "image cap relax must be finite and > 0", InvalidProblem)
        require(self.smooth_l_radius >= 0 and self.smooth_h_radius >= 0, "radii must be 0 or more", InvalidProblem)


@dataclass(frozen=True)
class CapLookup:
    """mode: nearest, bilinear or biased; a curve of biased is linear, smoothstep or a pair of Bezier controls."""

    mode: str = "bilinear"
    alpha: float = 0.0
    curve: str | tuple[float, float] = "smoothstep"

    def validate(self) -> None:
        require(self.mode in ("nearest", "bilinear", "biased"), f"unknown cap lookup {self.mode}", InvalidProblem)
        if self.mode == "biased":
            require(finite(self.alpha) and abs(self.alpha) <= 1, "cap interpolation alpha must be in [-1, 1]", InvalidProblem)
            if isinstance(self.curve, tuple):
                require(len(self.curve) == 2 and all(finite(c) and 0 <= c <= 1 for c in self.curve), "Bezier controls must be in [0, 1]", InvalidProblem)
            else:
                require(self.curve in ("linear", "smoothstep"), f"unknown curve {self.curve}", InvalidProblem)

    def amount(self) -> float:
        """How far a biased lookup moves toward the local extreme."""
        t = min(abs(self.alpha), 1.0)
        if self.curve == "linear":
            return t
        if self.curve == "smoothstep":
            return t * t * (3.0 - 2.0 * t)
        c1, c2 = self.curve
        u = 1.0 - t
        return min(max(3.0 * u * u * t * c1 + 3.0 * u * t * t * c2 + t * t * t, 0.0), 1.0)


@dataclass(frozen=True)
class PipelineConfig:
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    saliency: NoSaliency | GlobalContrast | LocalContrast = field(default_factory=NoSaliency)
    sampling: UniformGrid | Stratified | RandomUniform | FarthestPoint = field(default_factory=UniformGrid)
    export: ExportConfig = field(default_factory=ExportConfig)
    cap: CapBuilder | None = None
