"""Palette scores of candidate latent vectors, as projections over a candidates table.

A problem is small (slots, terms, hundreds of samples, a cap of some thousand
cells) and candidates may be many, so the problem's numbers travel with the plan
and every candidate is scored within its row: no join on candidates, no shuffle.

Sums over samples would be higher-order functions in Catalyst, which are interpreted
for every element; so scores come from the same formulas over arrays, a batch of
candidates at a time.  `native` asks for the column expressions instead.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NumericInstability
from ..functions.backends import ArrayOps, ColumnOps
from ..functions.numeric import pseudo_huber, relu
from ..problem import Problem
from .decode import cap_at, chroma, colour_of, decode_palette, latent_dim, lightness_hue
from .terms import SaliencyTerm, estimate_saliency

_FIELDS = ("l", "a", "b", "c", "h", "luminance", "gate", "cap_at", "limit")


def saliency_sigmas(problem: Problem) -> list[float]:
    """The kernel width of each slot: of its last saliency term, else 0.08."""
    out = [0.08] * len(problem.slots)
    for weighted in problem.terms:
        if isinstance(weighted.term, SaliencyTerm):
            out[weighted.term.slot] = weighted.term.sigma
    return out


def _with_problem(candidates: DataFrame, problem: Problem) -> DataFrame:
    """Candidates with the samples and the cap's nodes as two constant arrays: one row, broadcast."""
    row = ([tuple(map(float, s)) for s in problem.samples], list(problem.cap.grid) if problem.cap else [])
    held = candidates.sparkSession.createDataFrame([row], "_samples array<struct<l:double,a:double,b:double,weight:double,saliency:double>>, _grid array<double>")
    return candidates.join(F.broadcast(held))


def decode_candidates(candidates: DataFrame, problem: Problem, *, latent: str = "latent") -> DataFrame:
    """`candidates` with columns s<i>_<field> for each slot.

    Four steps of plain columns, each of which reads those before it: an expression
    used more than once then stays a column of its own in the plan.
    """
    mode, o = problem.config.cap_lookup, ColumnOps("_samples", "_grid")
    out = candidates if "_samples" in candidates.columns else _with_problem(candidates, problem)
    u = [F.element_at(latent, j + 1) for j in range(latent_dim(len(problem.slots)))]
    slots = list(enumerate(problem.slots))
    at = lambda i, k: F.col(f"s{i}_{k}")
    value = lambda v: F.lit(None).cast("double") if v is None else v if isinstance(v, Column) else F.lit(v)
    out = out.withColumns({f"s{i}_{k}": v for i, s in slots for k, v in zip("lh", lightness_hue(s, u[3 * i], u[3 * i + 2], o))})
    out = out.withColumns({f"s{i}_cap_at": value(cap_at(problem.cap, at(i, "l"), at(i, "h"), mode, o)) for i, s in slots})
    known = [None if problem.cap is None else at(i, "cap_at") for i, _ in slots]
    out = out.withColumns({f"s{i}_{k}": value(v) for i, s in slots for k, v in zip(("c", "limit"), chroma(s, u[3 * i + 1], known[i], o))})
    full = {}
    for i, s in slots:
        c = colour_of(s, SimpleNamespace(l=at(i, "l"), c=at(i, "c"), h=at(i, "h")), o)
        full |= {f"s{i}_{k}": getattr(c, k) for k in ("a", "b", "luminance", "gate")}
    return out.withColumns(full)


def _palette(problem: Problem) -> list[SimpleNamespace]:
    return [SimpleNamespace(**{k: F.col(f"s{i}_{k}") for k in _FIELDS}) for i in range(len(problem.slots))]


def decoded_slots(candidates: DataFrame, problem: Problem, *, key: str = "cand_id") -> DataFrame:
    """One row for each candidate and slot, with the saliency estimate."""
    o = ColumnOps("_samples", "_grid")
    wide = decode_candidates(candidates, problem)
    sigmas = saliency_sigmas(problem)
    rows = [F.struct(F.lit(i).alias("slot"), F.lit(s.name).alias("name"), F.struct(*[getattr(p, k).alias(k) for k in _FIELDS]).alias("v"), estimate_saliency(p, sigmas[i], o).alias("saliency")) for i, (s, p) in enumerate(zip(problem.slots, _palette(problem)))]
    long = wide.select(key, F.explode(F.array(*rows)).alias("r"))
    return long.select(key, "r.slot", "r.name", *[F.col(f"r.v.{k}").alias({"c": "lch_c", "h": "lch_h", "gate": "hue_gate", "cap_at": "cap_at_lh", "limit": "effective_cap_limit"}.get(k, k)) for k in _FIELDS], F.col("r.saliency").alias("est_saliency"))


def _soft_caps(problem: Problem, palette, o):
    """(name, contribution, overflow, relaxed cap) of each slot under a soft cap."""
    for slot, p in zip(problem.slots, palette):
        if slot.cap_policy == "soft":
            relaxed = p.cap_at * slot.cap_relax
            over = relu(p.c - relaxed, o)
            yield f"soft_cap/{slot.name}", slot.cap_weight, pseudo_huber(over, 0.02, o), over, relaxed


#: Numbers (candidates x samples) that one step of array scoring holds for each operation.
SCORED_AT_ONCE = 1 << 20


def _per_latent(problem: Problem, width: int, measure) -> Column:
    """A column function of a latent array: `width` numbers of each candidate, null for a null latent.

    `measure` takes the objective and a matrix of latents and gives a matrix with a row for each.
    """
    dims, step = latent_dim(len(problem.slots)), max(1, SCORED_AT_ONCE // max(1, len(problem.samples)))

    @F.arrow_udf("array<double>")
    def kernel(latents: pa.Array) -> pa.Array:
        objective, known = ArrayObjective(problem), latents.is_valid().to_numpy(zero_copy_only=False)
        given = latents.drop_null()
        sizes = given.value_lengths().to_numpy()
        if (sizes < dims).any():
            raise NumericInstability(f"a latent vector needs {dims} numbers")
        flat = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        table = flat[starts[:, None] + np.arange(dims)] if len(starts) else np.zeros((0, dims))
        parts = [np.asarray(measure(objective, table[at : at + step]), dtype=np.float64).reshape(-1, width) for at in range(0, len(table), step)]
        values = np.concatenate([np.zeros((0, width)), *parts])
        offsets = np.concatenate([[0], np.cumsum(known * width)]).astype(np.int32)
        mask = pa.array(~known) if not known.all() else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=mask)

    return kernel


def evaluate_terms(candidates: DataFrame, problem: Problem, *, key: str = "cand_id", native: bool = False) -> DataFrame:
    """term_eval(key, term_ord, name, raw, weighted, components)."""
    if native:
        o, palette = ColumnOps("_samples", "_grid"), _palette(problem)
        scores = [(*t.term.evaluate(palette, o), t.weight, t.label) for t in problem.terms]
        scores += [(raw, [over, relaxed], weight, name) for name, weight, raw, over, relaxed in _soft_caps(problem, palette, o)]
        wide = decode_candidates(candidates, problem)
    else:
        widths = [w for _, w in ArrayObjective(problem).parts(np.zeros((1, latent_dim(len(problem.slots)))))]
        labels = [(t.label, t.weight) for t in problem.terms] + [(f"soft_cap/{s.name}", s.cap_weight) for s in problem.slots if s.cap_policy == "soft"]
        measured = _per_latent(problem, sum(widths), lambda objective, u: np.concatenate([m for m, _ in objective.parts(u)], axis=1))
        wide = candidates.select(key, measured("latent").alias("_m")) if widths else candidates
        firsts = np.cumsum([1, *widths])
        scores = [(F.element_at("_m", int(f)), F.slice("_m", int(f) + 1, int(w) - 1), weight, label) for f, w, (label, weight) in zip(firsts, widths, labels)]
    if not scores:
        return wide.select(key, F.lit(0).alias("term_ord"), F.lit("").alias("name"), F.lit(0.0).alias("raw"), F.lit(0.0).alias("weighted"), F.array().cast("array<double>").alias("components")).limit(0)
    as_array = lambda parts: parts if isinstance(parts, Column) else F.array(*parts)
    made = [F.struct(F.lit(n).alias("term_ord"), F.lit(name).alias("name"), raw.alias("raw"), (raw * weight).alias("weighted"), as_array(parts).cast("array<double>").alias("components")) for n, (raw, parts, weight, name) in enumerate(scores)]
    return wide.select(key, F.explode(F.array(*made)).alias("t")).select(key, "t.*")


def evaluate_totals(candidates: DataFrame, problem: Problem, *, key: str = "cand_id", native: bool = False) -> DataFrame:
    """(key, objective): the weighted sum of all terms and soft caps, within the candidate's row.

    A sum that isn't finite fails the job with NumericInstability; `native` leaves
    that to `check_finite`.
    """
    if not native:
        totals = _per_latent(problem, 1, lambda objective, u: objective.totals(u)[:, None])
        return candidates.select(key, F.element_at(totals("latent"), 1).alias("objective"))
    o, palette = ColumnOps("_samples", "_grid"), _palette(problem)
    total = F.lit(0.0)
    for t in problem.terms:
        total = total + t.term.evaluate(palette, o)[0] * t.weight
    for _, weight, raw, _, _ in _soft_caps(problem, palette, o):
        total = total + raw * weight
    return decode_candidates(candidates, problem).select(key, total.alias("objective"))


def check_finite(scores: DataFrame) -> None:
    if not scores.where(F.isnan("objective") | (F.abs("objective") == float("inf")) | F.col("objective").isNull()).isEmpty():
        raise NumericInstability("objective is not finite")


def finite_difference_gradient(candidates: DataFrame, problem: Problem, *, key: str = "cand_id") -> DataFrame:
    """(key, dim, gradient) by central differences with steps epsilon * max(1, abs(u)).

    Both sides of a dimension are scored as rows of one table and met by one small aggregation.
    """
    dims, eps = latent_dim(len(problem.slots)), problem.config.fd_epsilon
    moved = candidates.select(key, "latent", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")).withColumn("step", eps * F.greatest(F.lit(1.0), F.abs(F.element_at("latent", F.col("dim") + 1))))
    sided = moved.withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    sided = sided.withColumn("latent", F.transform("latent", lambda u, i: F.when(i == F.col("dim"), u + F.col("side") * F.col("step")).otherwise(u))).withColumn("_key", F.struct(key, "dim", "step", "side"))
    scores = evaluate_totals(sided, problem, key="_key")
    signed = F.sum(F.col("_key.side") * F.col("objective")) / F.max(2.0 * F.col("_key.step"))
    return scores.groupBy(F.col(f"_key.{key}").alias(key), F.col("_key.dim").alias("dim")).agg(signed.alias("gradient"))


def gradient_norm(gradient: DataFrame, *, key: str = "cand_id") -> DataFrame:
    return gradient.groupBy(key).agg(F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("gradient_norm"))


class ArrayObjective:
    """The same objective on numpy arrays, for the solver: many latent vectors at once."""

    def __init__(self, problem: Problem) -> None:
        self.problem = problem
        self.o = ArrayOps(problem.samples, problem.cap.array() if problem.cap else None)

    def palette(self, latents: np.ndarray) -> list[SimpleNamespace]:
        return decode_palette(self.problem.slots, list(np.atleast_2d(latents).T), self.problem.cap, self.problem.config.cap_lookup, self.o)

    def parts(self, latents: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each term and soft cap a matrix of raw score and components, and its width."""
        palette, n = self.palette(latents), len(np.atleast_2d(latents))
        scores = [(raw, *more) for raw, more in (t.term.evaluate(palette, self.o) for t in self.problem.terms)]
        scores += [(raw, over, relaxed) for _, _, raw, over, relaxed in _soft_caps(self.problem, palette, self.o)]
        return [(np.stack([np.broadcast_to(np.asarray(v, dtype=np.float64), n) for v in score], axis=1), len(score)) for score in scores]

    def totals(self, latents: np.ndarray) -> np.ndarray:
        palette = self.palette(latents)
        total = np.zeros(len(np.atleast_2d(latents)))
        for t in self.problem.terms:
            total = total + t.weight * t.term.evaluate(palette, self.o)[0]
        for _, weight, raw, _, _ in _soft_caps(self.problem, palette, self.o):
            total = total + weight * raw
        if not np.isfinite(total).all():
            raise NumericInstability("objective is not finite")
        return total

    def total(self, latent: np.ndarray) -> float:
        return float(self.totals(latent)[0])

    def gradient(self, latent: np.ndarray) -> np.ndarray:
        """Central differences; all perturbed vectors are scored in one call."""
        step = np.diag(self.problem.config.fd_epsilon * np.maximum(1.0, np.abs(latent)))
        scores = self.totals(np.concatenate([latent + step, latent - step]))
        return (scores[: len(latent)] - scores[len(latent) :]) / (2.0 * step.diagonal())
