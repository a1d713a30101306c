"""The engine's queries over the driver's tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CapBuilder, CapLookup, ExportConfig, FarthestPoint, GlobalContrast, LocalContrast, NoSaliency, PipelineConfig, PreprocessConfig, RandomUniform, Stratified, UniformGrid
from .functions.backends import COLUMNS as _COLUMNS
from .functions.color import contrast_ratio, oklab_to_linear, oklab_to_oklch, oklch_to_oklab, relative_luminance, srgb_to_linear
from .functions.numeric import arc_length, circular_distance, distance_to_arc, inv_sigmoid, project_to_arc, pseudo_huber, relu, sigmoid, smoothstep, softmin, wrap_hue
from .operators import terms as T
from .operators.assignment import assign_nearest, clusters, export_samples, medoids
from .operators.cap import Cap, build_cap, cap_bins, dense_grid, fill_hue, fill_lightness, lightness_range, query_cap
from .operators.objective import decoded_slots, evaluate_terms, evaluate_totals, finite_difference_gradient, gradient_norm
from .operators.preprocess import prepare
from .operators.saliency import box_blur, compute_saliency, luma, saliency_stats
from .operators.sampling import farthest_point, keep_first, random_uniform, stratified, stride_candidates, uniform_grid
from .operators.seeds import rank_samples
from .operators.solver import solve
from .plans.pipeline import support_from_rgba
from .problem import HueArc, Interval, Problem, Slot, SolveConfig, WeightedTerm, lch_sample, weighted_samples
from .sources.tables import lab_from_embeddings, rgba_from_events

LAB = ("l", "a", "b")
CAP = CapBuilder(n_l=8, n_h=18, smooth_l_radius=1, smooth_h_radius=2, relax=0.9)


def r6(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns rounded to 6 places, with no negative zero."""
    return frame.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def lab_of(frame: DataFrame | None = None) -> tuple:
    return tuple(F.col(c) for c in LAB)


def pixels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(rgba_from_events(spark, sf_dir))


def salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_saliency(pixels_of(spark, sf_dir), GlobalContrast(robust=False))


# ---- pixels and scalar functions


def srgb_linear(spark, sf_dir):
    rgba = rgba_from_events(spark, sf_dir)
    return r6(rgba.select("image_id", "idx", *[srgb_to_linear(F.col(c) / 255.0).alias(f"lin_{c}") for c in "rgb"]), "lin_r", "lin_g", "lin_b")


def composite_oklab(spark, sf_dir):
    out = prepare(rgba_from_events(spark, sf_dir), PreprocessConfig(background=(30, 60, 90), alpha_into_weight=True))
    return r6(out.select("image_id", "idx", "luminance", *LAB, "alpha", "valid"), "luminance", *LAB, "alpha")


def oklab_oklch(spark, sf_dir):
    _, c, h = oklab_to_oklch(lab_of())
    return r6(pixels_of(spark, sf_dir).where("valid").select("image_id", "idx", c.alias("c"), h.alias("h")), "c", "h")


def oklch_roundtrip(spark, sf_dir):
    l, a, b = oklch_to_oklab(oklab_to_oklch(lab_of()))
    lin = oklab_to_linear(lab_of())
    return r6(pixels_of(spark, sf_dir).where("valid").select("image_id", "idx", l.alias("l"), a.alias("a"), b.alias("b"), *[v.alias(f"lin_{n}") for n, v in zip("rgb", lin)]), *LAB, "lin_r", "lin_g", "lin_b")


def contrast_pairs(spark, sf_dir):
    pixels = pixels_of(spark, sf_dir)
    other = pixels.select("image_id", (F.col("idx") - 1).alias("idx"), F.col("luminance").alias("other"))
    own = relative_luminance(oklab_to_linear(lab_of()))
    return r6(pixels.join(other, ["image_id", "idx"]).select("image_id", "idx", contrast_ratio(own, F.col("other")).alias("ratio")), "ratio")


def _angles(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 0.37 - F.col("l_linenumber") * 11.3).alias("x"), (F.col("l_quantity") * 0.9 - 7.0).alias("y"))


def hue_math(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    out = {"wrapped": wrap_hue(x), "arc": arc_length(y, x), "apart": circular_distance(x, y), "off_arc": distance_to_arc(x, 5.8, 0.9), "on_arc": project_to_arc(x, 5.8, 0.9)}
    return r6(_angles(spark, sf_dir).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in out.items()]), *out)


def huber_targets(spark, sf_dir):
    v = F.col("y") / 40.0
    out = {"huber": pseudo_huber(v - 0.4, 0.03)} | {f"t{i}": T.target_penalty(v, t, 0.05, _COLUMNS) for i, t in enumerate((T.AtLeast(0.5), T.AtMost(0.3), T.Within(0.2, 0.6), T.Near(0.4, 0.1)))}
    out |= {"smooth": smoothstep(v), "positive": relu(v - 0.2), "squash": sigmoid(F.col("x") / 50.0), "logit": inv_sigmoid(smoothstep(v))}
    return r6(_angles(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in out.items()]), *out)


def softmin_rows(spark, sf_dir):
    lab = lab_from_embeddings(spark, sf_dir)
    values = [F.abs(F.col(c)) for c in LAB]
    return r6(lab.select("vec_id", softmin(values, 0.02).alias("soft"), softmin(values, 0.0).alias("hard")), "soft", "hard")


# ---- saliency


def saliency_none(spark, sf_dir):
    return compute_saliency(pixels_of(spark, sf_dir), NoSaliency()).select("image_id", "idx", "saliency")


def saliency_global_minmax(spark, sf_dir):
    return r6(salient(spark, sf_dir).select("image_id", "idx", "saliency"), "saliency")


def saliency_global_robust(spark, sf_dir):
    return r6(compute_saliency(pixels_of(spark, sf_dir), GlobalContrast()).select("image_id", "idx", "saliency"), "saliency")


def blur(spark, sf_dir):
    return r6(box_blur(pixels_of(spark, sf_dir), {"l": "bl", "luminance": "blur_y"}, 2).select("image_id", "idx", "bl", "blur_y"), "bl", "blur_y")


def saliency_local(spark, sf_dir):
    return r6(compute_saliency(pixels_of(spark, sf_dir), LocalContrast(radius=2)).select("image_id", "idx", "saliency"), "saliency")


def saliency_summary(spark, sf_dir):
    return r6(saliency_stats(salient(spark, sf_dir)), "saliency_min", "saliency_max", "saliency_mean")


def luma_sink(spark, sf_dir):
    shown = luma(r6(salient(spark, sf_dir), "saliency"))
    return shown.select("image_id", "idx", "luma")


# ---- sampling and assignment


def sample_grid(spark, sf_dir):
    return uniform_grid(pixels_of(spark, sf_dir), UniformGrid(5))


def sample_stratified(spark, sf_dir):
    return stratified(pixels_of(spark, sf_dir), Stratified(5, 3, 4, seed=3))


def sample_random(spark, sf_dir):
    return random_uniform(pixels_of(spark, sf_dir), RandomUniform(40, seed=9))


def candidates_by_stride(spark, sf_dir):
    return stride_candidates(pixels_of(spark, sf_dir), 7).select("image_id", "idx")


def reps_keep_first(spark, sf_dir):
    reps = sample_grid(spark, sf_dir)
    again = reps.unionByName(reps.withColumn("rep_ord", (F.col("rep_ord") + 1000).cast("int")))
    return keep_first(again)


def sample_farthest(spark, sf_dir):
    return farthest_point(salient(spark, sf_dir), FarthestPoint(12, 2, 0.4))


def _assigned(spark, sf_dir):
    pixels = salient(spark, sf_dir)
    return assign_nearest(pixels, uniform_grid(pixels, UniformGrid(9)))


def nearest_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("image_id", "idx", "rep_ord")


def clusters_centroid(spark, sf_dir):
    return r6(clusters(_assigned(spark, sf_dir)), "mass", "mean_saliency", *LAB)


def clusters_medoid(spark, sf_dir):
    assigned = _assigned(spark, sf_dir)
    return r6(medoids(assigned, clusters(assigned)).select("image_id", "rep_ord", *LAB), *LAB)


def export_weights(spark, sf_dir):
    pixels = salient(spark, sf_dir)
    config = ExportConfig(saliency_to_weight_mix=0.5, saliency_weight_gamma=1.5, frequency_gamma=0.8, min_cluster_weight=0.02)
    return r6(export_samples(pixels, uniform_grid(pixels, UniformGrid(9)), config), *LAB, "weight", "saliency")


def pipeline_support(spark, sf_dir):
    return r6(support_from_rgba(rgba_from_events(spark, sf_dir), PipelineConfig(saliency=GlobalContrast(robust=False), sampling=UniformGrid(9))).samples, *LAB, "weight", "saliency")


def image_diagnostics(spark, sf_dir):
    support = support_from_rgba(rgba_from_events(spark, sf_dir), PipelineConfig(saliency=GlobalContrast(robust=False), sampling=UniformGrid(9)))
    return r6(support.diagnostics, "saliency_min", "saliency_max", "saliency_mean", "total_weight")


def resized_pixels(spark, sf_dir):
    """Down-scaled images: sizes and the mean of each channel."""
    out = prepare(rgba_from_events(spark, sf_dir), PreprocessConfig(max_working_dim=16, resize_filter="triangle"))
    return out.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("n"), F.round(F.avg("l"), 3).alias("mean_l"))


# ---- chroma caps


def _points(spark, sf_dir):
    return pixels_of(spark, sf_dir).where("valid")


def cap_cells(spark, sf_dir):
    points = _points(spark, sf_dir)
    return r6(cap_bins(points, lightness_range(points), CAP), "cap")


def cap_hue_fill(spark, sf_dir):
    points = _points(spark, sf_dir)
    ranges = lightness_range(points)
    return r6(fill_hue(dense_grid(cap_bins(points, ranges, CAP), ranges, CAP), CAP), "cap")


def cap_lightness_fill(spark, sf_dir):
    points = _points(spark, sf_dir)
    ranges = lightness_range(points)
    return r6(fill_lightness(fill_hue(dense_grid(cap_bins(points, ranges, CAP), ranges, CAP), CAP)), "cap")


def cap_smooth(spark, sf_dir):
    return r6(build_cap(_points(spark, sf_dir), CAP)[0], "cap")


def cap_summary(spark, sf_dir):
    return r6(build_cap(_points(spark, sf_dir), CAP)[1], "l_min", "l_max", "mean_before", "max_before", "mean_after", "max_after")


def _cap_query(mode: CapLookup):
    def query(spark, sf_dir):
        grid, meta = build_cap(_points(spark, sf_dir), CAP)
        at = rgba_from_events(spark, sf_dir).select("image_id", "idx", (0.15 + F.col("r") / 300.0).alias("l"), (F.col("g") / 30.0 - 2.0).alias("h"))
        return r6(query_cap(at, grid, meta, mode, shape=(CAP.n_l, CAP.n_h)).select("image_id", "idx", "cap"), "cap")

    return query


CAP_MODES = {"nearest": CapLookup("nearest"), "bilinear": CapLookup(), "biased": CapLookup("biased", 0.6, (0.2, 0.9)), "biased_low": CapLookup("biased", -0.5, "smoothstep")}

# ---- candidate palettes


def fixed_cap() -> Cap:
    return Cap(4, 6, 0.1, 0.9, tuple(round(0.06 + 0.015 * li + 0.02 * ((hi * 5) % 6), 6) for li in range(4) for hi in range(6)))


def fixed_samples() -> list[tuple[float, ...]]:
    rows = []
    for i in range(12):
        t = i / 11
        rows.append(lch_sample(0.18 + 0.7 * t, 0.02 + 0.12 * (1 - abs(2 * t - 1)), 0.3 + 3.8 * t, 0.5 + t, t))
    return [tuple(round(x, 6) for x in r) for r in rows]


SLOTS = (
    Slot("background", Interval(0.05, 0.35), Interval(0.0, 0.05)),
    Slot("surface", Interval(0.3, 0.6), Interval(0.02, 0.2), HueArc(5.9, 1.4), "hard"),
    Slot("accent", Interval(0.45, 0.85), Interval(0.03, 0.25), HueArc(1.2, 2.4), "soft", 2.0, 0.8),
    Slot("text", Interval(0.7, 0.98), Interval(0.0, 0.12), chroma_epsilon=0.08),
)
TERMS = {
    "cover": T.Cover((0, 1, 2, 3), 0.01, 0.03),
    "support": T.Support((1, 2), 0.02, 0.1, 1e-3),
    "saliency": T.SaliencyTerm(2, 0.12, T.AtLeast(0.7)),
    "lightness_target": T.LightnessTarget(0, T.Near(0.2, 0.05)),
    "chroma_target": T.ChromaTarget(2, T.Within(0.08, 0.1)),
    "hue_target": T.HueTarget(3, T.HueCentre(2.0, 0.3)),
    "hue_arc_target": T.HueTarget(1, T.HueWithin(6.0, 0.4, 0.2), use_hue_gate=False),
    "delta_l": T.DeltaL(0, 3, T.AtLeast(0.65)),
    "delta_c": T.DeltaC(1, 2, T.AtMost(0.02)),
    "delta_h": T.DeltaH(2, 3, T.AtMost(0.5)),
    "distance": T.Distance(1, 2, T.AtLeast(0.3)),
    "distance_squared": T.Distance(0, 1, T.AtMost(0.02), squared=True),
    "order": T.Order(3, 0, 0.6),
    "contrast": T.Contrast(3, 0, 9.0),
    "group_quantile": T.GroupQuantile(((0, 1.0), (1, 2.0), (2, 1.5), (3, 1.0)), "lightness", T.ExplicitQuantiles(((0.0, 0.1), (0.4, 0.45), (1.0, 0.9))), 0.02, 0.2),
    "group_hue": T.GroupQuantile(((1, 1.0), (2, 1.0)), (5.5, 3.5), T.UniformRange(0.2, 3.0), 0.05, 0.3),
}


def problem(*names: str, lookup: CapLookup | None = None) -> Problem:
    terms = tuple(WeightedTerm(1.0 + 0.25 * i, TERMS[n], n) for i, n in enumerate(names or TERMS))
    return Problem(SLOTS, weighted_samples(fixed_samples()), terms, fixed_cap(), SolveConfig(cap_lookup=lookup or CapLookup()))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette for every customer, from fixed waves of its key."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("cand_id"))
    return keys.select("cand_id", F.array(*[(F.sin(F.col("cand_id") * (0.7 + 0.13 * j) + 1.1 * j) * 3.0) for j in range(3 * len(SLOTS))]).alias("latent"))


def decode_slots(spark, sf_dir):
    out = decoded_slots(candidates(spark, sf_dir), problem())
    return r6(out, *[c for c, t in out.dtypes if t == "double"])


def _term(name: str):
    def query(spark, sf_dir):
        out = evaluate_terms(candidates(spark, sf_dir), problem(name)).where("term_ord = 0")
        return r6(out.select("cand_id", "name", "raw", "weighted", F.col("components")[0].alias("component")), "raw", "weighted", "component")

    return query


def soft_cap(spark, sf_dir):
    out = evaluate_terms(candidates(spark, sf_dir), problem("order")).where("term_ord = 1")
    return r6(out.select("cand_id", "name", "raw", "weighted", F.col("components")[0].alias("overflow"), F.col("components")[1].alias("relaxed_cap")), "raw", "weighted", "overflow", "relaxed_cap")


def objective_breakdown(spark, sf_dir):
    out = evaluate_terms(candidates(spark, sf_dir), problem())
    return r6(out.groupBy("name").agg(F.sum("raw").alias("raw"), F.sum("weighted").alias("weighted"), F.count("*").alias("n")).withColumns({"raw": F.round("raw", 4), "weighted": F.round("weighted", 4)}), "raw", "weighted")


def objective_totals(spark, sf_dir):
    return r6(evaluate_totals(candidates(spark, sf_dir), problem()), "objective")


def objective_best(spark, sf_dir):
    """The ten best palettes."""
    return objective_totals(spark, sf_dir).orderBy("objective", "cand_id").limit(10)


def fd_gradient(spark, sf_dir):
    out = finite_difference_gradient(candidates(spark, sf_dir), problem("lightness_target", "contrast"))
    return out.select("cand_id", "dim", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"))


def fd_gradient_norm(spark, sf_dir):
    out = gradient_norm(finite_difference_gradient(candidates(spark, sf_dir), problem("lightness_target", "contrast")))
    return out.select("cand_id", (F.round("gradient_norm", 4) + F.lit(0.0)).alias("gradient_norm"))


def seed_ranking(spark, sf_dir):
    """The ranking of samples for each slot, over all embeddings as samples."""
    lab = lab_from_embeddings(spark, sf_dir).select(F.col("vec_id").alias("sample_ord"), *LAB, (1.0 + F.col("vec_id") % 7).cast("double").alias("weight"))
    rounded = r6(lab, *LAB)
    return r6(rank_samples(rounded, SLOTS).select("slot", "rank", "sample_ord", "score"), "score")


def two_peak_problem() -> Problem:
    rows = []
    for (l, c, h, w, s), (dl, da, db) in (((0.42, 0.14, 0.3, 2.0, 0.4), (0.04, 0.02, -0.02)), ((0.76, 0.11, 2.6, 2.0, 0.6), (0.04, -0.02, 0.02))):
        for i in range(16):
            t = i / 16 - 0.5
            rows.append((l + t * dl, c * math.cos(h) + t * da, c * math.sin(h) + t * db, w, s))
    slot = lambda n: Slot(n, Interval(0.2, 0.9), Interval(0.0, 0.25))
    return Problem((slot("first"), slot("second")), weighted_samples(rows), (WeightedTerm(4.0, T.Cover((0, 1), 0.01, 0.03)),), None, SolveConfig(seed_count=14, max_iters=100))


def ladder_problem() -> Problem:
    rows = [lch_sample(0.1 + 0.8 * i / 23, 0.01, 0.0) for i in range(24)]
    slots = tuple(Slot(f"step{i}", Interval(0.05, 0.95), Interval(0.0, 0.03), chroma_epsilon=0.01) for i in range(8))
    ladder = T.GroupQuantile(tuple((i, 1.0) for i in range(8)), "lightness", T.UniformRange(0.12, 0.88), 0.02, 0.04)
    return Problem(slots, weighted_samples(rows), (WeightedTerm(8.0, ladder),), None, SolveConfig(seed_count=12, max_iters=120))


def _solved(make, seed: int):
    def query(spark, sf_dir):
        out = solve(spark, make(), seed)
        return r6(out.slots.select("slot", "name", *LAB, "lch_c", "lch_h", "luminance"), *LAB, "lch_c", "lch_h", "luminance")

    return query


QUERIES = {
    "srgb_linear": srgb_linear, "composite_oklab": composite_oklab, "oklab_oklch": oklab_oklch, "oklch_roundtrip": oklch_roundtrip, "contrast_pairs": contrast_pairs,
    "hue_math": hue_math, "huber_targets": huber_targets, "softmin_rows": softmin_rows,
    "saliency_none": saliency_none, "saliency_global_minmax": saliency_global_minmax, "saliency_global_robust": saliency_global_robust, "box_blur": blur,
    "saliency_local": saliency_local, "saliency_stats": saliency_summary, "luma_sink": luma_sink,
    "uniform_grid": sample_grid, "stratified": sample_stratified, "random_uniform": sample_random, "stride_candidates": candidates_by_stride, "reps_keep_first": reps_keep_first, "farthest_point": sample_farthest,
    "assign_nearest": nearest_assignment, "clusters_centroid": clusters_centroid, "clusters_medoid": clusters_medoid, "export_weights": export_weights,
    "pipeline_support": pipeline_support, "image_diagnostics": image_diagnostics, "resized_pixels": resized_pixels,
    "cap_bins": cap_cells, "cap_hue_fill": cap_hue_fill, "cap_lightness_fill": cap_lightness_fill, "cap_smooth": cap_smooth, "cap_meta": cap_summary,
    **{f"cap_query_{k}": _cap_query(v) for k, v in CAP_MODES.items()},
    "decode_slots": decode_slots, **{f"term_{n}": _term(n) for n in TERMS}, "soft_cap": soft_cap,
    "objective_breakdown": objective_breakdown, "objective_totals": objective_totals, "objective_best": objective_best, "fd_gradient": fd_gradient, "fd_gradient_norm": fd_gradient_norm,
    "seed_ranking": seed_ranking, "solve_two_peak": _solved(two_peak_problem, 123), "solve_ladder": _solved(ladder_problem, 11),
}
