"""Starting points of the search: random, aimed at group targets, and near ranked samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.backends import ARRAYS, EPS, TAU
from ..functions.color import oklab_to_oklch, oklch_to_oklab
from ..functions.numeric import distance2, inv_sigmoid, wrap_float, wrap_hue
from ..problem import Problem, Slot
from .terms import GroupQuantile, group_targets, quantile_centres


def seed_mix(n: int) -> tuple[int, int, int]:
    """How many seeds are random, targeted and near samples: 50 %, 30 % and the rest, one of each from three on."""
    if n < 3:
        return ((0, 0, 0), (1, 0, 0), (1, 1, 0))[n]
    drawn, aimed = max(1, n * 5 // 10), max(1, n * 3 // 10)
    return drawn, aimed, n - drawn - aimed


def interval_latent(v: float, low: float, high: float) -> float:
    if abs(high - low) < EPS:
        return 0.0
    return float(inv_sigmoid(min(max((v - low) / (high - low), 1e-6), 1.0 - 1e-6), ARRAYS))


def hue_latent(h: float, slot: Slot) -> float:
    if slot.hue is None:
        return wrap_float(h)
    offset = wrap_float(wrap_float(h) - wrap_float(slot.hue.start))
    return interval_latent(offset, 0.0, max(slot.hue.length, 1e-9))


def domain_centre(slot: Slot) -> tuple[float, float, float]:
    h = 0.0 if slot.hue is None else wrap_float(slot.hue.start + 0.5 * slot.hue.length)
    return slot.lightness.midpoint, slot.chroma.midpoint, h


def random_seed(problem: Problem, rng: np.random.Generator) -> np.ndarray:
    u = []
    for slot in problem.slots:
        u.append(rng.uniform(-2.0, 2.0))
        u.append(rng.uniform(-5.0, -2.5) if slot.neutralish else rng.uniform(-2.0, 2.0))
        u.append(rng.uniform(0.0, TAU) if slot.hue is None else rng.uniform(-2.0, 2.0))
    return np.array(u)


def aim_at_groups(problem: Problem, u: np.ndarray, variant: int) -> np.ndarray:
    """`u` with the axes of grouped slots set to their targets, slightly off by a fixed jitter."""
    u = u.copy()
    for weighted in problem.terms:
        group = weighted.term
        if not isinstance(group, GroupQuantile) or not group.members:
            continue
        targets = group_targets(quantile_centres([m for _, m in group.members]), group.target)
        for k, (at, _) in enumerate(group.members):
            slot, t = problem.slots[at], targets[k] + 0.02 * math.sin(0.017 * variant + 0.011 * k)
            if group.axis == "lightness":
                u[3 * at] = interval_latent(t, slot.lightness.min, slot.lightness.max)
            elif group.axis == "chroma":
                u[3 * at + 1] = interval_latent(t, slot.chroma.min, slot.chroma.max)
            else:
                length = max(wrap_float(group.axis[1] - group.axis[0]), 1e-9)
                u[3 * at + 2] = hue_latent(wrap_float(group.axis[0] + min(max(t, 0.0), length)), slot)
            if slot.neutralish:
                u[3 * at + 1] = -4.0
    return u


def _score(slot: Slot, l, c, h, lab, weight, o):
    """The rank score of a sample for a slot: weight less its chroma outside the domain and its distance from the centre."""
    outside = o.maximum(slot.chroma.min - c, 0.0) + o.maximum(c - slot.chroma.max, 0.0)
    centre = tuple(float(x) for x in oklch_to_oklab(domain_centre(slot), ARRAYS))
    return weight - 2.5 * outside - 6.0 * distance2(centre, lab)


def _fits(slot: Slot, l, h, o):
    inside = (l >= slot.lightness.min) & (l <= slot.lightness.max)
    if slot.hue is not None:
        inside = inside & (wrap_hue(h - wrap_float(slot.hue.start), o) <= slot.hue.length + 1e-10)
    return inside


def ranked_samples(problem: Problem, at: int) -> np.ndarray:
    """Positions of the samples within a slot's lightness and hue, best first; ties keep sample order."""
    slot, s = problem.slots[at], problem.samples
    l, c, h = oklab_to_oklch((s[:, 0], s[:, 1], s[:, 2]), ARRAYS)
    fit = np.flatnonzero(_fits(slot, l, h, ARRAYS))
    score = _score(slot, l, c, h, (s[:, 0], s[:, 1], s[:, 2]), s[:, 3], ARRAYS)
    return fit[np.argsort(-score[fit], kind="stable")]


def rank_samples(samples: DataFrame, slots: tuple[Slot, ...], *, key: str = "sample_ord", most: int | None = None) -> DataFrame:
    """(slot, rank, key, score) of the samples that fit each slot, as a window over a table of samples.

    With `most`, the best of each slot only: tasks then cut their part before the shuffle.
    """
    from ..functions.backends import COLUMNS

    lab = tuple(F.col(c) for c in "lab")
    polar = samples.select(key, *"lab", "weight", *[x.alias(n) for n, x in zip(("lch_l", "lch_c", "lch_h"), oklab_to_oklch(lab))])
    rows = [F.struct(F.lit(i).alias("slot"), _fits(s, F.col("l"), F.col("lch_h"), COLUMNS).alias("fits"), _score(s, F.col("l"), F.col("lch_c"), F.col("lch_h"), lab, F.col("weight"), COLUMNS).alias("score")) for i, s in enumerate(slots)]
    scored = polar.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*").where("fits")
    ranked = scored.select("slot", F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), key)).alias("rank"), key, "score")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def near_samples(problem: Problem, u: np.ndarray, variant: int) -> np.ndarray:
    u = u.copy()
    for at, slot in enumerate(problem.slots):
        ranked = ranked_samples(problem, at)
        if len(ranked):
            s = problem.samples[ranked[(variant + at) % len(ranked)]]
            l, c, h = (float(x) for x in oklab_to_oklch((s[0], s[1], s[2]), ARRAYS))
            u[3 * at] = interval_latent(l, slot.lightness.min, slot.lightness.max)
            u[3 * at + 1] = -4.0 if slot.neutralish else interval_latent(c, slot.chroma.min, slot.chroma.max)
            u[3 * at + 2] = hue_latent(h, slot)
    return u


def generate_seeds(problem: Problem, rng: np.random.Generator) -> list[np.ndarray]:
    drawn, aimed, near = seed_mix(problem.config.seed_count)
    out = [random_seed(problem, rng) for _ in range(drawn)]
    out += [aim_at_groups(problem, random_seed(problem, rng), v) for v in range(aimed)]
    return out + [near_samples(problem, random_seed(problem, rng), v) for v in range(near)]
