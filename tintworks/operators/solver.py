"""Multi-start search: limited-memory quasi-Newton runs from every seed, in parallel tasks.

Seeds are rows of a table and a run is a map over rows, so runs spread over the
cluster; what returns is one row for each run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SolverFailure
from ..problem import Problem
from .objective import ArrayObjective, decoded_slots, evaluate_terms
from .seeds import generate_seeds

MEMORY = 8
RUN_SCHEMA = "seed_index int, latent array<double>, objective double, converged boolean, iterations int, gradient_norm double"


def _direction(g: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Two-loop recursion: the quasi-Newton descent direction."""
    q, kept = -g, []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ q) / (y @ s)
        kept.append(a)
        q = q - a * y
    if steps:
        q = q * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(kept)):
        q = q + s * (a - (y @ q) / (y @ s))
    return q


def _line_search(f, grad, x, fx, gx, d, most: int = 24):
    """A step with sufficient decrease and strong curvature, by bracketing and bisection with secants."""
    slope, lo, hi, t = gx @ d, 0.0, np.inf, 1.0
    best = None
    for _ in range(most):
        at = x + t * d
        ft = f(at)
        if ft > fx + 1e-4 * t * slope:
            hi = t
        else:
            gt = grad(at)
            if best is None or ft < best[1]:
                best = (at, ft, gt)
            if abs(gt @ d) <= -0.9 * slope:
                return at, ft, gt
            if gt @ d > 0:
                hi = t
            else:
                lo = t
        t = 2.0 * t if np.isinf(hi) else 0.5 * (lo + hi)
    return best


def minimise(objective: ArrayObjective, start: np.ndarray) -> tuple[np.ndarray, float, bool, int, float]:
    """(best latent, its objective, converged, iterations, last gradient norm)."""
    config = objective.problem.config
    x = np.asarray(start, dtype=np.float64)
    fx, gx = objective.total(x), objective.gradient(x)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    for n in range(config.max_iters):
        if np.linalg.norm(gx) < config.gtol:
            return x, fx, True, n, float(np.linalg.norm(gx))
        d = _direction(gx, steps, changes)
        if d @ gx >= 0:
            steps, changes, d = [], [], -gx
        if not steps:
            d = d / max(1.0, np.linalg.norm(d))
        found = _line_search(objective.total, objective.gradient, x, fx, gx, d)
        if found is None:
            if not steps:
                return x, fx, False, n, float(np.linalg.norm(gx))
            steps, changes = [], []
            continue
        to, ft, gt = found
        s, y = to - x, gt - gx
        if s @ y > 1e-12 * (y @ y):
            steps, changes = [*steps, s][-MEMORY:], [*changes, y][-MEMORY:]
        done = abs(fx - ft) < config.ftol
        x, fx, gx = to, ft, gt
        if done:
            return x, fx, True, n + 1, float(np.linalg.norm(gx))
    return x, fx, False, config.max_iters, float(np.linalg.norm(gx))


def run_seeds(spark: SparkSession, problem: Problem, seeds: list[np.ndarray]) -> DataFrame:
    """seed_runs: one row for each seed; a run that fails counts with its start as it is."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        objective = ArrayObjective(problem)
        for batch in batches:
            rows = []
            for index, latent in zip(batch["seed_index"], batch["latent"]):
                start = np.array(latent, dtype=np.float64)
                try:
                    x, value, converged, n, norm = minimise(objective, start)
                except (ArithmeticError, ValueError):
                    try:
                        x, value, converged, n, norm = start, objective.total(start), False, 0, None
                    except ValueError:
                        continue
                rows.append((index, x.tolist(), value, converged, n, norm))
            yield pd.DataFrame(rows, columns=["seed_index", "latent", "objective", "converged", "iterations", "gradient_norm"])

    table = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(seeds)], "seed_index int, latent array<double>")
    return table.repartition(max(1, len(seeds)), "seed_index").mapInPandas(search, RUN_SCHEMA)


@dataclass(frozen=True)
class Solution:
    """The best palette as tables, and the numbers of its search."""

    latent: tuple[float, ...]
    objective: float
    seed_index: int
    converged: bool
    iterations: int
    gradient_norm: float | None
    slots: DataFrame
    terms: DataFrame
    seed_runs: DataFrame


def solve(spark: SparkSession, problem: Problem, seed: int | None = None) -> Solution:
    """Validate, search from all seeds, and score the best palette again with column expressions.

    The runs come to the driver, seed_count rows of them; the first of equal minima wins.
    """
    problem.validate()
    seeds = generate_seeds(problem, np.random.default_rng(seed))
    runs = run_seeds(spark, problem, seeds).collect()
    if not runs:
        raise SolverFailure("all seed runs failed")
    best = min(runs, key=lambda r: (r["objective"], r["seed_index"]))
    winner = spark.createDataFrame([(0, list(best["latent"]))], "cand_id bigint, latent array<double>")
    slots = decoded_slots(winner, problem).drop("cand_id").withColumn("cap_margin", F.col("cap_at_lh") - F.col("lch_c")).withColumn("near_chroma_cap", F.coalesce(F.col("cap_margin") <= 0.01, F.lit(False)))
    return Solution(tuple(best["latent"]), best["objective"], best["seed_index"], best["converged"], best["iterations"], best["gradient_norm"], slots, evaluate_terms(winner, problem).drop("cand_id"), spark.createDataFrame([tuple(r) for r in runs], RUN_SCHEMA))
