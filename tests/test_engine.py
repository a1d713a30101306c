"""Properties of the engine on small images, sample sets and problems, with numpy as the second opinion."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintworks import errors as E
from tintworks.config import CapBuilder, CapLookup, ExportConfig, FarthestPoint, GlobalContrast, LocalContrast, NoSaliency, PipelineConfig, PreprocessConfig, RandomUniform, Stratified, UniformGrid
from tintworks.functions import numeric as N
from tintworks.functions.backends import ARRAYS, COLUMNS, ArrayOps
from tintworks.functions.color import contrast_ratio, linear_to_oklab, oklab_to_linear, oklab_to_oklch, oklch_to_oklab
from tintworks.operators import terms as T
from tintworks.operators.cap import Cap, build_cap, lookup, query_cap
from tintworks.operators.decode import decode_palette
from tintworks.operators.objective import ArrayObjective, decoded_slots, evaluate_terms, evaluate_totals, finite_difference_gradient
from tintworks.operators.preprocess import check_images, prepare, resample, resample_weights, working_size
from tintworks.operators.saliency import box_blur, compute_saliency
from tintworks.operators.sampling import farthest_point, farthest_points, keep_first, random_uniform, stratified, uniform_grid
from tintworks.operators.assignment import export_samples
from tintworks.operators.seeds import generate_seeds, ranked_samples, seed_mix
from tintworks.operators.solver import minimise, solve
from tintworks.plans.pipeline import support_from_path, support_from_rgba
from tintworks.problem import HueArc, Interval, Problem, Slot, SolveConfig, WeightedTerm, lch_sample, weighted_samples
from tintworks.queries import candidates, ladder_problem, problem, two_peak_problem
from tintworks.sources.images import pgm_images, rgba_from_pixels, samples_from_rows


def image(spark, width, height, pixel, image_id=1):
    return rgba_from_pixels(spark, [(image_id, width, height, [pixel(i % width, i // width) for i in range(width * height)])])


def png(width, height):
    """A small RGB file."""
    rows = b"".join(b"\0" + b"".join(bytes([40 * x, 30 * y, 200]) for x in range(width)) for y in range(height))
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def halves(x, y):
    return (220, 30, 30) if x < 10 else (30, 60, 220)


# ---- scalars


def test_lab_lch_roundtrip():
    for lab in ((0.2, 0.03, -0.02), (0.55, -0.1, 0.18), (0.91, 0.24, -0.11), (0.42, 0.0, 0.0)):
        back = oklch_to_oklab(oklab_to_oklch(lab, ARRAYS), ARRAYS)
        assert np.allclose(back, lab, atol=1e-12)


def test_oklab_linear_roundtrip():
    rgb = (0.2, 0.5, 0.7)
    assert np.allclose(oklab_to_linear(linear_to_oklab(rgb, ARRAYS)), rgb, atol=1e-6)


def test_backends_agree(spark):
    values = np.concatenate([np.linspace(-20, 20, 101), [0.0, -1e-20]])
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    x = F.col("x")
    makers = [
        lambda v, o: N.wrap_hue(v, o), lambda v, o: N.circular_distance(v, v * 0.3 + 1.0, o), lambda v, o: N.distance_to_arc(v, 5.9, 0.6, o), lambda v, o: N.project_to_arc(v, 5.9, 0.6, o),
        lambda v, o: N.sigmoid(v, o), lambda v, o: N.inv_sigmoid(N.sigmoid(v, o), o), lambda v, o: N.pseudo_huber(v, 0.3, o), lambda v, o: N.smoothstep(v, o), lambda v, o: N.softmin([v, v * v, 0.2 - v], 0.1, o),
    ]
    got = frame.select(*[m(x, COLUMNS).alias(f"c{i}") for i, m in enumerate(makers)]).toPandas().to_numpy()
    want = np.stack([m(values, ARRAYS) for m in makers], axis=1)
    assert np.allclose(got, want, atol=1e-9)


def test_non_finite_hue_is_zero(spark):
    got = spark.sql("select double('NaN') x union all select double('Infinity')").select(N.wrap_hue(F.col("x")).alias("h")).collect()
    assert [r["h"] for r in got] == [0.0, 0.0]


def test_softmin_limits():
    assert float(N.softmin([3.0, 1.0, 2.0], 0.0, ARRAYS)) == 1.0
    assert N.softmin([], 0.1, ARRAYS) == 0.0


# ---- images


def test_alpha_composite_exact(spark):
    out = prepare(rgba_from_pixels(spark, [(1, 1, 1, [(255, 0, 0, 128)])]), PreprocessConfig(background=(0, 0, 255), min_alpha=0.0, alpha_into_weight=True)).first()
    assert abs(out["lin_r"] - 128 / 255) < 1e-12 and abs(out["lin_b"] - 127 / 255) < 1e-12 and out["lin_g"] == 0
    assert abs(out["alpha"] - 128 / 255) < 1e-12


@pytest.mark.parametrize("method", ["nearest", "triangle", "catmull_rom", "gaussian", "lanczos3"])
def test_resize(spark, method):
    assert working_size(400, 200, 100) == (100, 50) and working_size(3, 1, 2) == (2, 1) and working_size(5, 5, 9) == (5, 5)
    w = resample_weights(40, 10, method)
    assert np.allclose(w.sum(axis=1), 1)
    flat = resample(np.full((20, 40, 4), 77, np.uint8), 10, 5, method)
    assert flat.shape == (5, 10, 4) and (flat == 77).all()


def test_resize_flat_image(spark):
    out = prepare(image(spark, 40, 20, lambda x, y: (64, 128, 192)), PreprocessConfig(max_working_dim=10, resize_filter="triangle"))
    assert out.count() == 50 and out.where("valid").count() == 50
    assert out.select("width", "height").distinct().collect()[0] == (10, 5)


def test_saliency_hotspots(spark):
    red = lambda x, y: (220, 20, 20) if 8 <= x < 12 and 8 <= y < 12 else (128, 128, 128)
    bright = lambda x, y: (245,) * 3 if 18 <= x < 22 and 12 <= y < 16 else (90,) * 3
    for rgba, method, spot in ((image(spark, 20, 20, red), GlobalContrast(robust=False), "x between 8 and 11 and y between 8 and 11"), (image(spark, 40, 30, bright), LocalContrast(3, 0.0, 1.0, 0.0), "x between 18 and 21 and y between 12 and 15")):
        out = compute_saliency(prepare(rgba), method)
        hot, rest = (out.where(f"{c}({spot})").agg(F.avg("saliency")).first()[0] for c in ("", "not "))
        assert hot > rest + 0.25


def test_saliency_of_invalid_pixels(spark):
    rgba = rgba_from_pixels(spark, [(1, 2, 1, [(10, 20, 30, 0), (200, 20, 30, 255)])])
    assert [r["saliency"] for r in compute_saliency(prepare(rgba), NoSaliency()).collect()] == [1.0, 1.0]
    assert {r["idx"]: r["saliency"] for r in compute_saliency(prepare(rgba), GlobalContrast()).collect()} == {0: 0.0, 1: 1.0}


def test_box_blur_against_loops(spark):
    rng = np.random.default_rng(5)
    w, h, r = 7, 5, 4
    rgba = rgba_from_pixels(spark, [(1, w, h, [(*map(int, rng.integers(0, 256, 3)), 255 * int(rng.random() > 0.3)) for _ in range(w * h)])])
    out = box_blur(prepare(rgba), {"l": "bl"}, r).orderBy("idx").collect()
    value, valid = np.array([p["l"] for p in out]).reshape(h, w), np.array([p["valid"] for p in out]).reshape(h, w)
    for y in range(h):
        for x in range(w):
            total = n = 0.0
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    yy, xx = min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)
                    total, n = total + value[yy, xx] * valid[yy, xx], n + valid[yy, xx]
            assert abs(out[y * w + x]["bl"] - (total / n if n else value[y, x])) < 1e-9


def test_sampling(spark):
    flat = prepare(image(spark, 16, 16, lambda x, y: (120, 160, 40)))
    grid = uniform_grid(flat, UniformGrid(4)).collect()
    assert len(grid) == 16 and len({r["pixel_index"] for r in grid}) == 16
    random = lambda s: [r["pixel_index"] for r in random_uniform(flat, RandomUniform(20, s)).orderBy("rep_ord").collect()]
    assert len(set(random(1))) == 20 and random(1) == random(1) and random(1) != random(2)
    assert random_uniform(flat, RandomUniform(999)).count() == 256
    tiles = lambda: [r["pixel_index"] for r in stratified(flat, Stratified(4, 3, 2, 5)).orderBy("rep_ord").collect()]
    assert len(set(tiles())) == 24 and tiles() == tiles()


def test_farthest_points(spark):
    pixels = compute_saliency(prepare(image(spark, 20, 10, halves)), NoSaliency())
    picked = [r["pixel_index"] % 20 for r in farthest_point(pixels, FarthestPoint(2)).collect()]
    assert sorted(x < 10 for x in picked) == [False, True]
    lab = np.random.default_rng(0).random((30, 3))
    chosen = farthest_points(lab, np.linspace(0, 1, 30), np.arange(30), FarthestPoint(5, 1, 0.5))
    assert chosen[0] == 29 and len(set(chosen)) == 5


def test_keep_first(spark):
    reps = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (1, 2, 7)], "image_id bigint, rep_ord int, pixel_index bigint")
    assert [(r["rep_ord"], r["pixel_index"]) for r in keep_first(reps).orderBy("rep_ord").collect()] == [(0, 7), (1, 8)]


def test_export_weights_and_medoid(spark):
    pixels = compute_saliency(prepare(image(spark, 8, 8, lambda x, y: (220, 40, 40) if x < 4 else (30, 70, 220))), NoSaliency())
    reps = spark.createDataFrame([(1, 0, 1), (1, 1, 6)], "image_id bigint, rep_ord int, pixel_index bigint")
    for medoid in (False, True):
        out = export_samples(pixels, reps, ExportConfig(medoid=medoid)).collect()
        assert len(out) == 2 and abs(sum(r["weight"] for r in out) - 1) < 1e-9
    assert export_samples(pixels, reps, ExportConfig(min_cluster_weight=0.9)).count() == 0


def test_pipeline_end_to_end(spark):
    patch = lambda x, y: (245, 40, 40) if 26 <= x < 38 and 18 <= y < 28 else (min(4 * x, 255), min(5 * y, 255), 70)
    config = PipelineConfig(PreprocessConfig(32, "triangle"), LocalContrast(3, 1.0, 0.7, 0.3), FarthestPoint(14, 2, 0.5), ExportConfig(), CapBuilder())
    support = support_from_rgba(image(spark, 64, 48, patch), config)
    d = support.diagnostics.first()
    assert max(d["working_width"], d["working_height"]) <= 32 and d["original_width"] == 64
    assert d["valid_pixels"] + d["invalid_pixels"] == d["working_width"] * d["working_height"]
    assert abs(d["total_weight"] - 1) < 1e-9 and d["n_samples"] <= d["n_representatives"] <= 14
    assert 0 <= d["saliency_min"] <= d["saliency_mean"] <= d["saliency_max"] <= 1
    assert support.cap_grid.count() == 24 * 72 and support.cap_meta.first()["max_after"] > 0


def test_files_and_pgm(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2))
    rgba = support_from_path(spark, str(tmp_path / "a.png"), PipelineConfig(sampling=UniformGrid(1))).pixels
    assert np.allclose(rgba.orderBy("idx").toPandas()["lin_r"], prepare(image(spark, 3, 2, lambda x, y: (40 * x, 30 * y, 200))).orderBy("idx").toPandas()["lin_r"])
    support = support_from_path(spark, str(tmp_path / "a.png"), PipelineConfig(sampling=UniformGrid(1)))
    assert support.pixels.count() == 6 and support.samples.count() == 6
    luma = spark.createDataFrame([(1, 2, 1, 0, 7), (1, 2, 1, 1, 255)], "image_id bigint, width int, height int, idx bigint, luma int")
    assert bytes(pgm_images(luma).first()["pgm"]) == b"P5\n2 1\n255\n\x07\xff"
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(E.ImageDecode):
        support_from_path(spark, str(tmp_path / "bad.png"))


# ---- caps


def test_cap_lookup_exact(spark):
    pts = [(0.2, 0.10, 0.10), (0.2, 0.50, 3.40), (0.8, 0.20, 0.10), (0.8, 0.80, 3.40)]
    samples = samples_from_rows(spark, [(1, i, *lch_sample(*p)) for i, p in enumerate(pts)])
    grid, meta = build_cap(samples, CapBuilder(2, 2, 0, 0))
    cap = Cap.collect(grid, meta, 1)
    o = ArrayOps(grid=cap.array())
    at = lambda l, h, m: float(lookup(np.array([l]), np.array([h]), 2, 2, cap.l_min, cap.l_max, m, o)[0])
    assert abs(at(0.5, math.pi / 2, CapLookup()) - 0.40) < 1e-12
    assert min(abs(at(0.3, 0.2, CapLookup("nearest")) - v) for v in cap.grid) < 1e-12
    low, mid, high = (at(0.5, 1.0, CapLookup("biased", a, "linear")) for a in (-1.0, 0.0, 1.0))
    assert min(cap.grid) - 1e-12 <= low <= mid <= high <= max(cap.grid) + 1e-12
    points = spark.createDataFrame([(1, 0.5, math.pi / 2), (1, 0.3, 0.2)], "image_id bigint, l double, h double")
    assert abs(query_cap(points, grid, meta, shape=(2, 2)).where("h > 1").first()["cap"] - 0.40) < 1e-12


def test_cap_fill_against_loops(spark):
    rng = np.random.default_rng(3)
    pts = [(float(rng.random()), float(rng.random() * 0.3), float(rng.random() * 6.28)) for _ in range(9)]
    samples = samples_from_rows(spark, [(1, i, *lch_sample(*p)) for i, p in enumerate(pts)])
    n_l, n_h, rl, rh = 5, 7, 2, 4
    grid, meta = build_cap(samples, CapBuilder(n_l, n_h, rl, rh, 0.9))
    cap = Cap.collect(grid, meta, 1)
    lo, hi = min(p[0] for p in pts), max(p[0] for p in pts)
    g = np.full((n_l, n_h), np.nan)
    for l, c, h in pts:
        i, j = int((l - lo) / (hi - lo) * (n_l - 1)), int(h / (2 * math.pi) * n_h) % n_h
        g[i, j] = np.nanmax([g[i, j], c])
    f = g.copy()
    for i in range(n_l):
        filled = np.flatnonzero(~np.isnan(g[i]))
        for j in range(n_h):
            if len(filled) and np.isnan(g[i, j]):
                gap = np.minimum((j - filled) % n_h, (filled - j) % n_h)
                f[i, j] = g[i, filled[gap == gap.min()]].mean()
    rows = np.flatnonzero(~np.isnan(f[:, 0]))
    f = np.stack([f[rows[np.abs(rows - i).argmin()]] for i in range(n_l)])
    s = np.stack([f[:, np.arange(j - rh, j + rh + 1) % n_h].mean(axis=1) for j in range(n_h)], axis=1)
    s = np.stack([s[np.clip(np.arange(i - rl, i + rl + 1), 0, n_l - 1)].mean(axis=0) for i in range(n_l)]) * 0.9
    assert np.allclose(cap.array().reshape(n_l, n_h), s, atol=1e-9)


# ---- problems


def test_decode_stays_inside():
    slot = Slot("s", Interval(0.2, 0.8), Interval(0.01, 0.18), HueArc(5.9, 1.0))
    for u in np.linspace(-20, 20, 41):
        p = decode_palette([slot], [0.7 * u, -0.4 * u, 1.3 * u], None, CapLookup(), ARRAYS)[0]
        assert 0.2 - 1e-12 <= p.l <= 0.8 + 1e-12 and 0.01 - 1e-12 <= p.c <= 0.18 + 1e-12
        assert N.wrap_float(float(p.h) - 5.9) <= 1.0 + 1e-9
    with pytest.raises(E.InvalidProblem):
        decode_palette([slot], [0.0], None, CapLookup(), ARRAYS)


def test_hard_cap_is_respected(spark):
    samples = samples_from_rows(spark, [(1, i, *lch_sample(0.4 + 0.2 * i / 15, 0.03, 1.4)) for i in range(16)])
    cap = Cap.collect(*build_cap(samples, CapBuilder(12, 48, 1, 1)), 1)
    rows = weighted_samples(lch_sample(0.4 + 0.2 * i / 15, 0.03, 1.4) for i in range(16))
    p = Problem((Slot("s", Interval(0.2, 0.8), Interval(0.0, 0.2), HueArc(1.2, 0.4), "hard"),), rows, (), cap, SolveConfig(seed_count=6, max_iters=40))
    slot = solve(spark, p, 99).slots.first()
    assert slot["lch_c"] <= slot["cap_at_lh"] + 1e-9


def test_quantiles_and_terms():
    assert np.allclose(T.quantile_centres([1, 2, 1]), [0.125, 0.5, 0.875])
    assert np.allclose(T.group_targets([0.125, 0.5, 0.875], T.UniformRange(0, 10)), [1.25, 5, 8.75])
    assert T.interpolate_quantile(0.5, ((0.0, 1.0), (0.5, 2.0), (0.5, 9.0), (1.0, 3.0))) == 2.0
    from types import SimpleNamespace as S

    grey = lambda l: S(l=l, a=0.0, b=0.0, c=0.0, h=0.0, gate=1.0, luminance=l**3)
    o = ArrayOps(np.zeros((1, 5)))
    raw = lambda t, *p: float(t.evaluate(list(p), o)[0])
    assert raw(T.Contrast(0, 1, 4.5), grey(0.0), grey(1.0)) < 1e-6 < raw(T.Contrast(0, 1, 4.5), grey(0.55), grey(0.58))
    assert raw(T.Contrast(0, 1, 4.5), grey(0.55), grey(0.58)) == raw(T.Contrast(0, 1, 4.5, 0.25), grey(0.55), grey(0.58)) != raw(T.Contrast(0, 1, 4.5, 1.0), grey(0.55), grey(0.58))
    for target in (T.Near(0.55, 0.05), T.AtLeast(0.4), T.AtMost(0.7), T.Within(0.4, 0.7)):
        assert raw(T.LightnessTarget(0, target), grey(0.55)) < 1e-9
        assert raw(T.LightnessTarget(0, target), grey(0.2)) + raw(T.LightnessTarget(0, target), grey(0.85)) > 0
    hue = lambda h, gate=1.0: S(l=0.5, a=0.0, b=0.0, c=0.1, h=h, gate=gate, luminance=0.1)
    assert raw(T.HueTarget(0, T.HueCentre(math.radians(1), 0.1)), hue(math.radians(359))) < raw(T.HueTarget(0, T.HueCentre(math.radians(1), 0.1)), hue(math.pi))
    assert raw(T.HueTarget(0, T.HueWithin(math.radians(350), math.radians(20), 0.1)), hue(0.1)) < 1e-9
    full = raw(T.DeltaH(0, 1, T.Near(math.pi / 2, 0.1)), hue(0.0), hue(math.pi))
    assert raw(T.DeltaH(0, 1, T.Near(math.pi / 2, 0.1)), hue(0.0), hue(math.pi, 0.01)) < 0.02 * full
    assert raw(T.Distance(0, 1, T.AtLeast(0.05)), grey(0.5), grey(0.52)) > 0
    assert abs(raw(T.Distance(0, 1, T.AtLeast(0.03), squared=True), grey(0.5), grey(0.7))) < 1e-6
    ladder = lambda gap: T.GroupQuantile(((0, 1.0), (1, 1.0), (2, 1.0)), "lightness", T.ExplicitValues((0.2, 0.4, 0.6)), 0.02, gap)
    assert raw(ladder(0.05), grey(0.2), grey(0.45), grey(0.3)) > raw(ladder(None), grey(0.2), grey(0.45), grey(0.3))
    assert raw(T.GroupQuantile(((0, 1.0),), "lightness", T.ExplicitValues((0.2, 0.4)), 0.02), grey(0.1)) == 1e12


def test_columns_and_arrays_score_alike(spark, sf):
    p = problem(lookup=CapLookup("biased", 0.4, (0.1, 0.8)))
    few = candidates(spark, sf).limit(40)
    latents = {r["cand_id"]: np.array(r["latent"]) for r in few.collect()}
    objective = ArrayObjective(p)
    for native in (False, True):
        for r in evaluate_totals(few, p, native=native).collect():
            assert abs(r["objective"] - objective.total(latents[r["cand_id"]])) < 1e-9
    ours, theirs = (evaluate_terms(few, p, native=native).orderBy("cand_id", "term_ord").collect() for native in (False, True))
    assert len(ours) == len(theirs) == 40 * (len(p.terms) + 1)
    for x, y in zip(ours, theirs):
        assert x[:3] == y[:3] and len(x["components"]) == len(y["components"])
        assert np.allclose([x["raw"], x["weighted"], *x["components"]], [y["raw"], y["weighted"], *y["components"]], atol=1e-9)
    one = few.limit(1)
    g = {r["dim"]: r["gradient"] for r in finite_difference_gradient(one, p).collect()}
    want = objective.gradient(latents[one.first()["cand_id"]])
    assert np.allclose([g[i] for i in range(len(want))], want, atol=1e-7)
    names = [r["name"] for r in evaluate_terms(one, p).orderBy("term_ord").collect()]
    assert names[-1] == "soft_cap/accent" and len(names) == len(p.terms) + 1
    assert decoded_slots(one, p).count() == 4


def test_seeds():
    assert [seed_mix(n) for n in range(4)] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)]
    assert seed_mix(16) == (8, 4, 4) and all(sum(seed_mix(n)) == n for n in range(32))
    p = two_peak_problem()
    seeds = generate_seeds(p, np.random.default_rng(1))
    assert len(seeds) == 14 and all(len(s) == 6 for s in seeds)
    assert all(np.array_equal(a, b) for a, b in zip(seeds, generate_seeds(p, np.random.default_rng(1))))
    ranked = ranked_samples(problem(), 2)
    assert len(ranked) and all(0.45 <= problem().samples[i, 0] <= 0.85 for i in ranked)


def test_solve_two_peaks(spark):
    out = solve(spark, two_peak_problem(), 123)
    found = np.array([(r["l"], r["a"], r["b"]) for r in out.slots.orderBy("slot").collect()])
    peaks = np.array([oklch_to_oklab(p, ARRAYS) for p in ((0.42, 0.14, 0.3), (0.76, 0.11, 2.6))])
    d = np.linalg.norm(found[:, None] - peaks[None], axis=2)
    assert min(d[0, 0] + d[1, 1], d[0, 1] + d[1, 0]) < 0.18
    assert out.seed_runs.count() == 14 and abs(out.terms.agg(F.sum("weighted")).first()[0] - out.objective) < 1e-9


def test_solve_ladder(spark):
    light = [r["l"] for r in solve(spark, ladder_problem(), 11).slots.orderBy("slot").collect()]
    assert all(y >= x - 0.02 for x, y in zip(light, light[1:]))


def test_solve_saliency_pick():
    near = lambda l, c, h, n, w, s, d: [(l + t * d[0], c * math.cos(h) + t * d[1], c * math.sin(h) + t * d[2], w, s) for t in (i / n - 0.5 for i in range(n))]
    rows = near(0.55, 0.06, 1.2, 28, 4.0, 0.2, (0.03, 0.01, -0.01)) + near(0.72, 0.15, 5.5, 6, 1.0, 1.0, (0.02, -0.01, 0.01))
    slot = lambda n: Slot(n, Interval(0.25, 0.9), Interval(0.0, 0.24))
    p = Problem((slot("a"), slot("b")), weighted_samples(rows), (WeightedTerm(3, T.Cover((0, 1), 0.02, 0.03)), WeightedTerm(2, T.SaliencyTerm(1, 0.08, T.AtLeast(0.8)))), None, SolveConfig(seed_count=14, max_iters=120))
    objective = ArrayObjective(p)
    runs = [minimise(objective, s) for s in generate_seeds(p, np.random.default_rng(777))]
    best = objective.palette(min(runs, key=lambda r: r[1])[0])
    peak = oklch_to_oklab((0.72, 0.15, 5.5), ARRAYS)
    assert min(math.dist((float(s.l[0]), float(s.a[0]), float(s.b[0])), peak) for s in best) < 0.16


@pytest.mark.parametrize("broken, error", [
    (dict(slots=()), E.EmptySlots), (dict(samples=np.zeros((0, 5))), E.EmptySamples), (dict(samples=np.array([[0.5, 0, 0, 0.0, 0.5]])), E.InvalidProblem),
    (dict(config=SolveConfig(fd_epsilon=0.0)), E.InvalidProblem), (dict(config=SolveConfig(cap_lookup=CapLookup("biased", 2.0))), E.InvalidProblem), (dict(cap=None), E.InvalidProblem),
    (dict(cap=Cap(2, 2, 0.0, 1.0, (0.0,) * 4)), E.EmptyFeasibleCap), (dict(terms=(WeightedTerm(-1.0, T.Order(0, 1, 0.1)),)), E.InvalidProblem), (dict(terms=(WeightedTerm(1.0, T.Order(0, 9, 0.1)),)), E.InvalidProblem),
    (dict(terms=(WeightedTerm(1.0, T.Cover((), 0.1, 0.1)),)), E.InvalidProblem), (dict(terms=(WeightedTerm(1.0, T.GroupQuantile(((0, -1.0),), "chroma", T.UniformRange(0, 1), 0.1)),)), E.InvalidGroupTerm),
    (dict(terms=(WeightedTerm(1.0, T.GroupQuantile(((0, 1.0),), (0.0, 2 * math.pi), T.UniformRange(0, 1), 0.1)),)), E.InvalidGroupTerm), (dict(slots=(Slot("s", Interval(0.9, 0.1), Interval(0, 0.1)),)), E.InvalidDomain),
    (dict(slots=(Slot("s", Interval(0.1, 0.9), Interval(0, 0.1), HueArc(0.0, 0.0)),)), E.InvalidDomain),
])
def test_validation(broken, error):
    good = problem()
    with pytest.raises(error):
        Problem(**{**dict(slots=good.slots, samples=good.samples, terms=good.terms, cap=good.cap, config=good.config), **broken}).validate()
    good.validate()


def test_image_checks(spark):
    with pytest.raises(E.NoValidPixels):
        check_images(prepare(rgba_from_pixels(spark, [(1, 1, 1, [(1, 2, 3, 0)])])))
    with pytest.raises(E.EmptyImage):
        rgba_from_pixels(spark, [(1, 0, 0, [])])
    for bad in (PreprocessConfig(min_alpha=2.0), LocalContrast(color_weight=-1.0), ExportConfig(frequency_gamma=-1.0), UniformGrid(0), FarthestPoint(1, 1, -1.0)):
        with pytest.raises(E.InvalidConfig):
            bad.validate()
    with pytest.raises(E.InvalidProblem):
        CapBuilder(1, 5).validate()


def test_stream_of_pixels(spark, tmp_path):
    from tintworks.sources.tables import rgba_from_events
    from tintworks.streaming.images import stream_rgba

    rgba = rgba_from_events(spark, "/root/testdata/sf0.001")
    rgba.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = stream_rgba(spark.readStream.schema(rgba.schema).parquet(str(tmp_path / "in")), lambda s, e: seen.append(s.samples.count())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen and sum(seen) > 0


def test_stream_of_files(spark, tmp_path):
    from tintworks.streaming.images import stream_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(3, 2))
    seen = []
    query = stream_files(spark, str(tmp_path / "in"), lambda s, e: seen.append(s.samples.count()), PipelineConfig(sampling=UniformGrid(1))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == [6]


# ---- what the review of round 1 asked for


def test_pipeline_raises(spark):
    rgba = rgba_from_pixels(spark, [(1, 2, 1, [(9, 9, 9), (200, 0, 0)]), (2, 1, 1, [(1, 2, 3, 0)])])
    with pytest.raises(E.NoValidPixels):
        support_from_rgba(rgba)
    loose = support_from_rgba(rgba, strict=False)
    assert [r["image_id"] for r in loose.samples.select("image_id").distinct().collect()] == [1] and loose.diagnostics.count() == 2
    loose.close()
    assert not loose.pixels.is_cached and not loose.samples.is_cached
    with pytest.raises(E.InvalidConfig):
        support_from_rgba(image(spark, 4, 4, halves), PipelineConfig(export=ExportConfig(min_cluster_weight=2.0)))


def test_given_representatives(spark):
    rgba = rgba_from_pixels(spark, [(1, 3, 1, [(9, 9, 9), (200, 0, 0), (1, 1, 1, 0)])])
    table = lambda *idx: spark.createDataFrame([(1, n, i) for n, i in enumerate(idx)], "image_id bigint, rep_ord int, pixel_index bigint")
    with support_from_rgba(rgba, PipelineConfig(sampling=table(1, 0, 1))) as support:
        assert support.samples.count() == 2
    for idx in (2, 7):
        with pytest.raises(E.InvalidRepresentative):
            support_from_rgba(rgba, PipelineConfig(sampling=table(0, idx)))


def test_non_finite_saliency_raises(spark):
    pixels = prepare(image(spark, 3, 1, halves)).withColumn("l", F.when(F.col("idx") == 1, F.lit(float("nan"))).otherwise(F.col("l")))
    with pytest.raises(E.NumericInstability), E.translated():
        compute_saliency(pixels, GlobalContrast(robust=False)).collect()


def test_random_keys(spark):
    flat = prepare(image(spark, 16, 16, halves).unionByName(image(spark, 16, 16, halves, 2)))
    for seed in (90000, 99999, None):
        rows = random_uniform(flat, RandomUniform(20, seed)).collect()
        chosen = [{r["pixel_index"] for r in rows if r["image_id"] == i} for i in (1, 2)]
        assert len(chosen[0]) == len(chosen[1]) == 20 and chosen[0] != chosen[1]
    assert stratified(flat, Stratified(2, 2, 64, 1)).groupBy("image_id").count().where("count = 256").count() == 2


def test_events_are_read_whole(spark, tmp_path):
    from tintworks.sources.tables import rgba_from_events

    spark.range(1100).selectExpr("id as event_id", "cast(id as double) as value", "'click' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    rows = rgba_from_events(spark, str(tmp_path)).toPandas()
    assert len(rows) == 1024 + 96 and (rows["a"] == 255).sum() == 1100
    last = rows[rows.image_id == 1].sort_values("idx")
    assert list(last["idx"]) == list(range(96)) and set(last["height"]) == {3}


def test_cap_from_samples(spark):
    config = PipelineConfig(sampling=UniformGrid(2), cap=CapBuilder(4, 6, from_samples=True))
    with support_from_rgba(image(spark, 12, 4, halves), config) as support:
        grid, meta = build_cap(support.samples, config.cap)
        key = lambda g: sorted(map(tuple, g.collect()))
        assert key(grid) == key(support.cap_grid) and key(meta) == key(support.cap_meta)


def test_texts_of_problems(tmp_path, spark):
    from tintworks.serial import dumps, loads

    p = problem()
    q = loads(dumps(p))
    assert np.array_equal(p.samples, q.samples) and (p.slots, p.terms, p.cap, p.config) == (q.slots, q.terms, q.cap, q.config)
    u = np.linspace(-1, 1, 3 * len(p.slots))
    assert ArrayObjective(p).total(u) == ArrayObjective(q).total(u)
    for config in (PipelineConfig(sampling=FarthestPoint(3, 2, 0.5), saliency=LocalContrast(), cap=CapBuilder()), CapLookup("biased", 0.3, (0.1, 0.9))):
        assert loads(dumps(config)) == config
    table = spark.createDataFrame([(1, 0.5, [1.5, 2.0])], "k int, v double, parts array<double>")
    again = loads(dumps({"t": table}), spark)["t"]
    assert again.schema == table.schema and again.collect() == table.collect()
    for bad in ('{"kind": "os.system"}', '{"kind": "Slot", "fields": {"name": "x"}}', "[1"):
        with pytest.raises(E.InvalidConfig):
            loads(bad)


def test_hue_contains():
    from tintworks.problem import hue_contains

    arc = HueArc(6.0, 1.0)
    assert hue_contains(None, 9.0) and hue_contains(arc, 0.5) and hue_contains(arc, 6.1 - 2 * math.pi) and not hue_contains(arc, 3.0) and not hue_contains(HueArc(1.0, 0.0), 1.0)


def test_best_ranks(spark, sf):
    from tintworks.operators.seeds import rank_samples
    from tintworks.queries import SLOTS, lab_from_embeddings

    lab = lab_from_embeddings(spark, sf).select(F.col("vec_id").alias("sample_ord"), "l", "a", "b", F.lit(1.0).alias("weight"))
    rows = lambda f: sorted((r["slot"], r["rank"], r["sample_ord"]) for r in f.collect())
    assert rows(rank_samples(lab, SLOTS, most=3)) == [r for r in rows(rank_samples(lab, SLOTS)) if r[1] <= 3]


def test_scores_of_odd_candidates(spark):
    p = problem("cover", "contrast")
    u = [0.1 * i for i in range(3 * len(p.slots))]
    made = lambda *rows: spark.createDataFrame(list(rows), "cand_id bigint, latent array<double>")
    got = {r["cand_id"]: r["objective"] for r in evaluate_totals(made((1, u), (2, None), (3, [*u, 9.0])), p).collect()}
    assert got[2] is None and got[1] == got[3] == ArrayObjective(p).total(np.array(u))
    assert evaluate_totals(made((1, u)).limit(0), p).count() == 0 and evaluate_terms(made((1, u)).limit(0), p).collect() == []
    for bad in ([1.0], [float("nan"), *u[1:]]):
        with pytest.raises(E.NumericInstability), E.translated():
            evaluate_totals(made((1, bad)), p).collect()
