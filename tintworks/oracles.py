"""DuckDB SQL for the engine's queries, written apart from the column expressions."""

from __future__ import annotations

from .queries import CAP, CAP_MODES, SLOTS, TERMS, fixed_cap, fixed_samples

TAU = "6.283185307179586::DOUBLE"


def d(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def wrap(h: str) -> str:
    return f"(CASE WHEN ({h}) % {TAU} < 0 THEN ({h}) % {TAU} + {TAU} ELSE ({h}) % {TAU} END)"


def circular(x: str, y: str) -> str:
    return f"least(abs({wrap(x)} - {wrap(y)}), {TAU} - abs({wrap(x)} - {wrap(y)}))"


def clamp(x: str) -> str:
    return f"greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE)"


def huber(z: str, delta: float) -> str:
    return f"({d(delta)} * {d(delta)} * (sqrt(1 + ({z}) / {d(delta)} * (({z}) / {d(delta)})) - 1))"


def relu(x: str) -> str:
    return f"greatest({x}, 0.0::DOUBLE)"


def sigmoid(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def smooth(x: str) -> str:
    return f"({clamp(x)} * {clamp(x)} * (3 - 2 * {clamp(x)}))"


LINEAR = "(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"

RGBA = """sizes AS (SELECT event_id // 1024 AS image_id, max(event_id % 1024) + 1 AS filled FROM events GROUP BY 1),
heights AS (SELECT image_id, filled, ((filled + 31) // 32)::INTEGER AS height FROM sizes),
rgba AS (SELECT event_id // 1024 AS image_id, 32 AS width, height, event_id % 1024 AS idx, (event_id % 1024) % 32 AS x, (event_id % 1024) // 32 AS y,
  round(value * 100)::BIGINT % 256 AS r, (event_id * 91 + 7) % 256 AS g, (event_id * 13 + 101) % 256 AS b,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 128 ELSE 255 END AS a
  FROM events JOIN heights ON event_id // 1024 = image_id
  UNION ALL SELECT image_id, 32, height, i, i % 32, i // 32, 0, 0, 0, 0 FROM (SELECT image_id, height, unnest(range(filled, height * 32)) AS i FROM heights))"""


def pixels(background: tuple[int, int, int] = (255, 255, 255), weighted: bool = False) -> str:
    lin = {c: LINEAR.format(v=c) for c in "rgb"}
    back = [LINEAR.format(v=f"{v}::DOUBLE") for v in background]
    mix = ", ".join(f"a / 255.0::DOUBLE * {lin[c]} + (1 - a / 255.0::DOUBLE) * {back[k]} AS lin_{c}" for k, c in enumerate("rgb"))
    cone = lambda x, y, z: f"cbrt({x}::DOUBLE * lin_r + {y}::DOUBLE * lin_g + {z}::DOUBLE * lin_b)"
    return f"""{RGBA},
lit AS (SELECT *, a / 255.0::DOUBLE AS raw_alpha, {mix} FROM rgba),
cones AS (SELECT *, {cone(0.4122214708, 0.5363325363, 0.0514459929)} AS c1, {cone(0.2119034982, 0.6806995451, 0.1073969566)} AS c2, {cone(0.0883024619, 0.2817188376, 0.6299787005)} AS c3 FROM lit),
pixels AS (SELECT image_id, width, height, idx, x, y, lin_r, lin_g, lin_b, r AS red, g AS green,
  0.2126::DOUBLE * greatest(lin_r, 0) + 0.7152::DOUBLE * greatest(lin_g, 0) + 0.0722::DOUBLE * greatest(lin_b, 0) AS luminance,
  0.2104542553::DOUBLE * c1 + 0.793617785::DOUBLE * c2 - 0.0040720468::DOUBLE * c3 AS l,
  1.9779984951::DOUBLE * c1 - 2.428592205::DOUBLE * c2 + 0.4505937099::DOUBLE * c3 AS a,
  0.0259040371::DOUBLE * c1 + 0.7827717662::DOUBLE * c2 - 0.808675766::DOUBLE * c3 AS b,
  raw_alpha >= {d(1 / 255)} AS valid, CASE WHEN raw_alpha >= {d(1 / 255)} THEN {"raw_alpha" if weighted else "1.0::DOUBLE"} ELSE 0.0::DOUBLE END AS alpha FROM cones)"""


PIXELS = pixels()
SALIENT = f"""{PIXELS},
means AS (SELECT image_id, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM pixels WHERE valid GROUP BY 1),
contrast AS (SELECT p.*, CASE WHEN valid THEN sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb)) ELSE 0 END AS raw FROM pixels p JOIN means USING (image_id))"""


def normalised(raw: str, robust: bool) -> str:
    lo, hi = (f"quantile_cont({raw}, 0.01)", f"quantile_cont({raw}, 0.99)") if robust else (f"min({raw})", f"max({raw})")
    return f"""ends AS (SELECT image_id, {lo} AS lo, {hi} AS hi FROM contrast WHERE valid GROUP BY 1),
salient AS (SELECT c.*, CASE WHEN NOT valid THEN 0.0::DOUBLE WHEN abs(hi - lo) <= 1e-12 THEN 1.0::DOUBLE ELSE {clamp(f"({raw} - lo) / (hi - lo)")} END AS saliency FROM contrast c JOIN ends USING (image_id))"""


GLOBAL = f"{SALIENT},\n{normalised('raw', False)}"


def blurred(columns: dict[str, str], r: int) -> str:
    """Neighbourhoods listed pixel by pixel: offsets clamped to the image, rows first."""
    sums = ", ".join(f"sum(q.{c}) FILTER (q.valid) AS s_{c}" for c in columns)
    again = ", ".join(f"sum(q.s_{c}) AS t_{c}" for c in columns)
    out = ", ".join(f"CASE WHEN t_n > 0 THEN t_{c} / t_n ELSE p.{c} END AS {to}" for c, to in columns.items())
    return f"""offsets AS (SELECT unnest(range({-r}, {r + 1})) AS o),
across AS (SELECT p.image_id, p.idx, p.x, p.y, any_value(p.height) AS height, {sums}, count(*) FILTER (q.valid) AS s_n
  FROM pixels p, offsets JOIN pixels q ON q.image_id = p.image_id AND q.y = p.y AND q.x = least(greatest(p.x + o, 0), p.width - 1) GROUP BY 1, 2, 3, 4),
down AS (SELECT p.image_id, p.idx, {again}, sum(q.s_n) AS t_n
  FROM across p, offsets JOIN across q ON q.image_id = p.image_id AND q.x = p.x AND q.y = least(greatest(p.y + o, 0), p.height - 1) GROUP BY 1, 2),
blurred AS (SELECT p.*, {out} FROM pixels p JOIN down USING (image_id, idx))"""


KEY = "('0x' || substr(md5('{seed}:' || image_id || ':' || idx), 1, 15))::BIGINT"


def grid_cells(step: int) -> str:
    return f"""nearest AS (SELECT image_id, y // {step} AS cy, x // {step} AS cx, idx,
  row_number() OVER (PARTITION BY image_id, y // {step}, x // {step} ORDER BY
    pow(x - 0.5 * (x // {step} * {step} + least(x // {step} * {step} + {step}, width) - 1), 2) + pow(y - 0.5 * (y // {step} * {step} + least(y // {step} * {step} + {step}, height) - 1), 2), idx) AS n
  FROM pixels WHERE valid),
reps AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY cy, cx) - 1)::INTEGER AS rep_ord, idx AS pixel_index FROM nearest WHERE n = 1)"""


ASSIGNED = f"""{GLOBAL},
{grid_cells(9)},
sites AS (SELECT image_id, rep_ord, l AS rl, a AS ra, b AS rb FROM reps JOIN pixels ON pixels.image_id = reps.image_id AND idx = pixel_index),
ranked AS (SELECT s.*, rep_ord, row_number() OVER (PARTITION BY s.image_id, idx ORDER BY (l - rl) * (l - rl) + (a - ra) * (a - ra) + (b - rb) * (b - rb), rep_ord) AS n
  FROM salient s JOIN sites USING (image_id) WHERE valid),
assigned AS (SELECT * FROM ranked WHERE n = 1),
clusters AS (SELECT image_id, rep_ord, sum(alpha) AS mass, count(*) AS pixel_count, {clamp("sum(saliency) / count(*)")} AS mean_saliency,
  sum(alpha * l) / sum(alpha) AS l, sum(alpha * a) / sum(alpha) AS a, sum(alpha * b) / sum(alpha) AS b FROM assigned GROUP BY 1, 2 HAVING sum(alpha) > 0)"""
ASSIGNED = ASSIGNED.replace("SELECT image_id, rep_ord, l AS rl", "SELECT reps.image_id, rep_ord, l AS rl")


def exported(weight: str, least: float) -> str:
    return f"""{ASSIGNED},
weighed AS (SELECT *, {weight} AS w FROM clusters),
shared AS (SELECT *, w / sum(w) OVER (PARTITION BY image_id) AS weight FROM weighed),
samples AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY rep_ord) - 1)::INTEGER AS sample_ord, l, a, b, weight, mean_saliency AS saliency FROM shared WHERE weight >= {d(least)})"""


SAMPLES = f"SELECT image_id, sample_ord, {r6('l')} AS l, {r6('a')} AS a, {r6('b')} AS b, {r6('weight')} AS weight, {r6('saliency')} AS saliency FROM samples"

N_L, N_H = CAP.n_l, CAP.n_h
BINS = f"""{PIXELS},
ranges AS (SELECT image_id, CASE WHEN abs(max(l) - min(l)) < 1e-6 THEN greatest(min(l) - 0.001, 0) ELSE min(l) END AS l_min, CASE WHEN abs(max(l) - min(l)) < 1e-6 THEN least(max(l) + 0.001, 1) ELSE max(l) END AS l_max FROM pixels WHERE valid GROUP BY 1),
bins AS (SELECT p.image_id, floor({clamp("(l - l_min) / greatest(l_max - l_min, 1e-12)")} * {N_L - 1})::INTEGER AS li, (floor({wrap("atan2(b, a)")} / {TAU} * {N_H})::BIGINT % {N_H})::INTEGER AS hi,
  max(sqrt(a * a + b * b)) AS cap FROM pixels p JOIN ranges USING (image_id) WHERE valid GROUP BY 1, 2, 3),
cells AS (SELECT image_id, li::INTEGER AS li, hi::INTEGER AS hi FROM ranges, unnest(range({N_L})) AS x(li), unnest(range({N_H})) AS y(hi)),
dense AS (SELECT c.*, cap FROM cells c LEFT JOIN bins USING (image_id, li, hi))"""
FILLED = f"""{BINS},
steps AS (SELECT d.image_id, d.li, d.hi, e.cap, least((d.hi - e.hi + {N_H}) % {N_H}, (e.hi - d.hi + {N_H}) % {N_H}) AS apart FROM dense d JOIN bins e ON e.image_id = d.image_id AND e.li = d.li WHERE d.cap IS NULL),
nearest AS (SELECT image_id, li, hi, avg(cap) AS near FROM (SELECT *, min(apart) OVER (PARTITION BY image_id, li, hi) AS best FROM steps) WHERE apart = best GROUP BY 1, 2, 3),
hued AS (SELECT image_id, li, hi, coalesce(cap, near) AS cap FROM dense LEFT JOIN nearest USING (image_id, li, hi))"""
LIT = f"""{FILLED},
rise AS (SELECT h.image_id, h.li, h.hi, e.cap AS found, row_number() OVER (PARTITION BY h.image_id, h.li, h.hi ORDER BY abs(e.li - h.li), e.li) AS n FROM hued h JOIN hued e ON e.image_id = h.image_id AND e.hi = h.hi AND e.cap IS NOT NULL),
full_grid AS (SELECT image_id, h.li, h.hi, coalesce(h.cap, found, 0) AS cap FROM hued h LEFT JOIN (SELECT * FROM rise WHERE n = 1) USING (image_id, li, hi))"""
LIT = LIT.replace("SELECT image_id, h.li, h.hi, coalesce", "SELECT h.image_id, h.li, h.hi, coalesce").replace("LEFT JOIN (SELECT * FROM rise WHERE n = 1) USING (image_id, li, hi))", "LEFT JOIN (SELECT * FROM rise WHERE n = 1) r ON r.image_id = h.image_id AND r.li = h.li AND r.hi = h.hi)")
_R = CAP.smooth_h_radius
_Q = CAP.smooth_l_radius
SMOOTH = f"""{LIT},
turned AS (SELECT g.image_id, g.li, g.hi, sum(e.cap) / {2 * _R + 1} AS cap FROM full_grid g, unnest(range({-_R}, {_R + 1})) AS t(o) JOIN full_grid e ON e.image_id = g.image_id AND e.li = g.li AND e.hi = (g.hi + o + {N_H}) % {N_H} GROUP BY 1, 2, 3),
lifted AS (SELECT g.image_id, g.li, g.hi, sum(e.cap) / {2 * _Q + 1} AS cap FROM turned g, unnest(range({-_Q}, {_Q + 1})) AS t(o) JOIN turned e ON e.image_id = g.image_id AND e.hi = g.hi AND e.li = least(greatest(g.li + o, 0), {N_L - 1}) GROUP BY 1, 2, 3),
cap_grid AS (SELECT image_id, li, hi, greatest(cap * {d(CAP.relax)}, 0) AS cap FROM lifted)"""


def looked_up(n_l: int, n_h: int, node, mode) -> str:
    """The cap from lf and hf, with node(l, h) the SQL of a node's value."""
    l0, h0 = "floor(lf)::BIGINT", f"(floor(hf)::BIGINT % {n_h})"
    l1, h1 = f"least(floor(lf)::BIGINT + 1, {n_l - 1})", f"((floor(hf)::BIGINT + 1) % {n_h})"
    tl, th = "(lf - floor(lf))", "(hf - floor(hf))"
    if mode.mode == "nearest":
        return f"greatest({node(f'(CASE WHEN {tl} < 0.5 THEN {l0} ELSE {l1} END)', f'(CASE WHEN {th} < 0.5 THEN {h0} ELSE {h1} END)')}, 0)"
    v = [node(x, y) for x in (l0, l1) for y in (h0, h1)]
    flat = f"(({v[0]} * (1 - {th}) + {v[1]} * {th}) * (1 - {tl}) + ({v[2]} * (1 - {th}) + {v[3]} * {th}) * {tl})"
    if mode.mode == "biased":
        end = f"{'greatest' if mode.alpha >= 0 else 'least'}({', '.join(v)})"
        t, amount = abs(mode.alpha), 0.0
        if mode.curve == "smoothstep":
            amount = t * t * (3 - 2 * t)
        elif isinstance(mode.curve, tuple):
            amount = 3 * (1 - t) ** 2 * t * mode.curve[0] + 3 * (1 - t) * t * t * mode.curve[1] + t**3
        flat = f"({flat} + {d(amount)} * ({end} - {flat}))"
    return f"greatest({flat}, 0)"


def cap_query(mode) -> str:
    node = lambda x, y: f"g[({x}) * {N_H} + ({y}) + 1]"
    return f"""WITH {SMOOTH},
arrays AS (SELECT image_id, list(cap ORDER BY li, hi) AS g FROM cap_grid GROUP BY 1),
spots AS (SELECT q.image_id, idx, a.g, {clamp("(0.15 + r / 300.0::DOUBLE - l_min) / greatest(l_max - l_min, 1e-12)")} * {N_L - 1} AS lf, {wrap("b0")} / {TAU} * {N_H} AS hf
  FROM (SELECT *, g / 30.0::DOUBLE - 2.0 AS b0 FROM rgba) q JOIN ranges n ON n.image_id = q.image_id JOIN arrays a ON a.image_id = q.image_id)
SELECT image_id, idx, {r6(looked_up(N_L, N_H, node, mode))} AS cap FROM spots"""


# ---- candidate palettes

_CAP = fixed_cap()
_GRID = "[" + ", ".join(d(v) for v in _CAP.grid) + "]"


def _slot_sql(i: int) -> str:
    """CTEs that decode slot i, from u<j> columns."""
    s = SLOTS[i]
    u = [f"u{3 * i + k}" for k in range(3)]
    l = f"{d(s.lightness.min)} + {sigmoid(u[0])} * {d(s.lightness.max - s.lightness.min)}"
    h = wrap(u[2]) if s.hue is None else wrap(f"{d(s.hue.start % 6.283185307179586)} + {sigmoid(u[2])} * {d(s.hue.length)}")
    return f"{l} AS l{i}, {h} AS h{i}"


def palettes() -> str:
    """cands, and p with one row for each candidate and l0, c0, h0, a0, b0, y0, g0, cap0 and limit0 to those of slot 3."""
    n = range(len(SLOTS))
    us = ", ".join(f"sin(c_custkey * {d(0.7 + 0.13 * j)} + {d(1.1 * j)}) * 3.0::DOUBLE AS u{j}" for j in range(3 * len(SLOTS)))
    node = lambda x, y: f"{_GRID}[({x}) * {_CAP.n_h} + ({y}) + 1]"
    caps = []
    for i in n:
        at = looked_up(_CAP.n_l, _CAP.n_h, node, CAP_MODES["bilinear"])
        lf = f"({clamp(f'(l{i} - {d(_CAP.l_min)}) / {d(_CAP.l_max - _CAP.l_min)}')} * {_CAP.n_l - 1})"
        caps.append(at.replace("lf", lf).replace("hf", f"({wrap(f'h{i}')} / {TAU} * {_CAP.n_h})") + f" AS cap{i}")
    chroma = []
    for i in n:
        s = SLOTS[i]
        high = f"least({d(s.chroma.max)}, cap{i})" if s.cap_policy == "hard" else d(s.chroma.max)
        low = f"least({d(s.chroma.min)}, {high})"
        limit = {"hard": high, "soft": f"cap{i}", "ignore": "NULL::DOUBLE"}[s.cap_policy]
        chroma.append(f"{low} + {sigmoid(f'u{3 * i + 1}')} * greatest({high} - {low}, 0) AS c{i}, {limit} AS limit{i}")
    lab = ", ".join(f"c{i} * cos({wrap(f'h{i}')}) AS a{i}, c{i} * sin({wrap(f'h{i}')}) AS b{i}" for i in n)
    cube = lambda i, x, y: f"pow(l{i} + {d(x)} * a{i} + {d(y)} * b{i}, 3)"
    light = []
    for i in n:
        k = (cube(i, 0.3963377774, 0.2158037573), cube(i, -0.1055613458, -0.0638541728), cube(i, -0.0894841775, -1.291485548))
        row = lambda x, y, z, k=k: f"greatest({d(x)} * {k[0]} + {d(y)} * {k[1]} + {d(z)} * {k[2]}, 0)"
        light.append(f"greatest(0.2126::DOUBLE * {row(4.0767416621, -3.3077115913, 0.2309699292)} + 0.7152::DOUBLE * {row(-1.2684380046, 2.6097574011, -0.3413193965)} + 0.0722::DOUBLE * {row(-0.0041960863, -0.7034186147, 1.707614701)}, 0) AS y{i}, {smooth(f'c{i} / {d(SLOTS[i].chroma_epsilon)}')} AS g{i}")
    return f"""cands AS (SELECT c_custkey AS cand_id, {us} FROM customer),
p1 AS (SELECT *, {", ".join(_slot_sql(i) for i in n)} FROM cands),
p2 AS (SELECT *, {", ".join(caps)} FROM p1),
p3 AS (SELECT *, {", ".join(chroma)} FROM p2),
p4 AS (SELECT *, {lab} FROM p3),
p AS (SELECT *, {", ".join(light)} FROM p4)"""


PALETTES = palettes()
_VALUES = ", ".join("(" + ", ".join(d(x) for x in row) + ")" for row in fixed_samples())
WITH_SAMPLES = f"{PALETTES},\ns(sl, sa, sb, sw, ss) AS (VALUES {_VALUES})"


def apart(i: int, other: str = "s") -> str:
    """Squared distance of slot i to a sample, or to another slot."""
    x = ("sl", "sa", "sb") if other == "s" else (f"l{other}", f"a{other}", f"b{other}")
    return "(" + " + ".join(f"({n}{i} - {v}) * ({n}{i} - {v})" for n, v in zip("lab", x)) + ")"


def _sample_term(name: str) -> str:
    t = TERMS[name]
    if name == "cover":
        each = [apart(i) for i in t.slots]
        least = f"least({', '.join(each)})"
        soft = f"({least} - {d(t.tau)} * ln({' + '.join(f'exp(({least} - {e}) / {d(t.tau)})' for e in each)}))"
        return f"SELECT cand_id, sum(sw * {huber(soft, t.delta)}) AS raw, avg({soft}) AS component FROM p, s GROUP BY 1"
    if name == "support":
        cost = " UNION ALL ".join(f"SELECT cand_id, {i} AS slot, {apart(i)} - {d(t.beta)} * ln(sw + {d(t.epsilon)}) AS v FROM p, s" for i in t.slots)
        return f"""SELECT cand_id, sum(x) AS raw, avg(x) AS component FROM (SELECT cand_id, slot, any_value(m) - {d(t.tau)} * ln(sum(exp((m - v) / {d(t.tau)}))) AS x
          FROM (SELECT *, min(v) OVER (PARTITION BY cand_id, slot) AS m FROM ({cost})) GROUP BY 1, 2) GROUP BY 1"""
    k = f"exp(-{apart(t.slot)} / {d(2 * t.sigma**2)})"
    return f"SELECT cand_id, {huber(relu(f'{d(t.target.value)} - v'), 0.05)} AS raw, v AS component FROM (SELECT cand_id, sum(ss * {k}) / sum({k}) AS v FROM p, s GROUP BY 1)"


def _plain_terms() -> dict[str, tuple[str, str]]:
    """raw and first component of the terms that read slots only."""
    gate = lambda i: f"g{i}"
    centres = [0.5 / 5.5, 2.0 / 5.5, 3.75 / 5.5, 5.0 / 5.5]
    knots = [(0.0, 0.1), (0.4, 0.45), (1.0, 0.9)]
    goal = []
    for q in centres:
        (q0, v0), (q1, v1) = (knots[0], knots[1]) if q <= 0.4 else (knots[1], knots[2])
        goal.append(v0 + (v1 - v0) * (q - q0) / (q1 - q0))
    group = " + ".join(huber(f"l{i} - {d(t)}", 0.02) for i, t in enumerate(goal)) + " + " + " + ".join(huber(relu(f"0.2 - (l{i + 1} - l{i})"), 0.02) for i in range(3))
    mean = "(" + " + ".join(f"abs(l{i} - {d(t)})" for i, t in enumerate(goal)) + ") / 4"
    start, length = 5.5, (3.5 - 5.5) % 6.283185307179586
    offset = lambda i: f"(CASE WHEN {wrap(f'h{i} - {d(start)}')} <= {d(length)} THEN {wrap(f'h{i} - {d(start)}')} WHEN {wrap(f'h{i} - {d(start)}')} - {d(length)} <= {TAU} - {wrap(f'h{i} - {d(start)}')} THEN {d(length)} ELSE 0.0::DOUBLE END)"
    aims = [0.2 + 0.25 * 2.8, 0.2 + 0.75 * 2.8]
    hues = " + ".join(huber(f"{offset(i)} - {d(t)}", 0.05) for i, t in zip((1, 2), aims)) + " + " + huber(relu(f"0.3 - ({offset(2)} - {offset(1)})"), 0.05)
    hue_mean = "(" + " + ".join(f"abs({offset(i)} - {d(t)})" for i, t in zip((1, 2), aims)) + ") / 2"
    arc = f"(CASE WHEN {wrap('h1 - 6.0::DOUBLE')} <= {d((0.4 - 6.0) % 6.283185307179586 + 1e-12)} THEN 0.0::DOUBLE ELSE least({circular('h1', '6.0::DOUBLE')}, {circular('h1', '0.4::DOUBLE')}) END)"
    ratio = "((greatest(y3, y0) + 0.05) / (least(y3, y0) + 0.05))"
    far = f"sqrt({apart(1, '2')})"
    return {
        "lightness_target": (huber("l0 - 0.2", 0.05), "l0"),
        "chroma_target": (f"{huber(relu('0.08 - c2'), 0.02)} + {huber(relu('c2 - 0.1'), 0.02)}", "c2"),
        "hue_target": (f"{huber(circular('h3', '2.0::DOUBLE'), 0.3)} * {gate(3)}", "h3"),
        "hue_arc_target": (huber(arc, 0.2), "h1"),
        "delta_l": (huber(relu("0.65 - abs(l0 - l3)"), 0.03), "abs(l0 - l3)"),
        "delta_c": (huber(relu("abs(c1 - c2) - 0.02"), 0.03), "abs(c1 - c2)"),
        "delta_h": (f"{huber(relu(f'{circular("h2", "h3")} - 0.5'), 0.08)} * (g2 * g3)", circular("h2", "h3")),
        "distance": (huber(relu(f"0.3 - {far}"), 0.03), far),
        "distance_squared": (huber(relu(f"{apart(0, '1')} - 0.02"), 0.002), apart(0, "1")),
        "order": (huber(relu("0.6 - (l3 - l0)"), 0.03), "l3 - l0"),
        "contrast": (huber(relu(f"9.0 - {ratio}"), 0.25), ratio),
        "group_quantile": (group, mean),
        "group_hue": (hues, hue_mean),
    }


PLAIN = _plain_terms()
_SOFT_OVER = relu("c2 - cap2 * 0.8::DOUBLE")


def term(name: str) -> str:
    source = f"SELECT cand_id, {PLAIN[name][0]} AS raw, {PLAIN[name][1]} AS component FROM p" if name in PLAIN else _sample_term(name)
    return f"WITH {WITH_SAMPLES}, t AS ({source}) SELECT cand_id, '{name}' AS name, {r6('raw')} AS raw, {r6('raw')} AS weighted, {r6('component')} AS component FROM t"


def all_terms(*names: str, soft: bool = True) -> str:
    """CTE t(cand_id, name, raw, weighted) of the named terms, with weights by position."""
    parts = []
    for k, n in enumerate(names or TERMS):
        source = f"SELECT cand_id, {PLAIN[n][0]} AS raw FROM p" if n in PLAIN else f"SELECT cand_id, raw FROM ({_sample_term(n)})"
        parts.append(f"SELECT cand_id, '{n}' AS name, raw, raw * {d(1 + 0.25 * k)} AS weighted FROM ({source})")
    if soft:
        parts.append(f"SELECT cand_id, 'soft_cap/accent' AS name, {huber(_SOFT_OVER, 0.02)} AS raw, 2.0::DOUBLE * {huber(_SOFT_OVER, 0.02)} AS weighted FROM p")
    return "t AS (" + " UNION ALL ".join(parts) + ")"


TOTALS = f"WITH {WITH_SAMPLES}, {all_terms()}, o AS (SELECT cand_id, {r6('sum(weighted)')} AS objective FROM t GROUP BY 1)"


def decoded() -> str:
    parts = []
    for i, s in enumerate(SLOTS):
        sigma = 0.12 if i == 2 else 0.08
        k = f"exp(-{apart(i)} / {d(2 * sigma**2)})"
        est = f"(SELECT cand_id AS e_id, CASE WHEN sum({k}) <= 1e-12 THEN 0.0::DOUBLE ELSE sum(ss * {k}) / sum({k}) END AS est FROM p, s GROUP BY 1)"
        values = {"l": f"l{i}", "a": f"a{i}", "b": f"b{i}", "lch_c": f"c{i}", "lch_h": f"h{i}", "luminance": f"y{i}", "hue_gate": f"g{i}", "cap_at_lh": f"cap{i}", "effective_cap_limit": f"limit{i}", "est_saliency": "est"}
        parts.append(f"SELECT cand_id, {i} AS slot, '{s.name}' AS name, {', '.join(f'{r6(v)} AS {n}' for n, v in values.items())} FROM p JOIN {est} ON e_id = cand_id")
    return f"WITH {WITH_SAMPLES} " + " UNION ALL ".join(parts)


def gradient(inner: str) -> str:
    """Central differences of two slot terms: only u0, u9 (lightness) and the chroma and hue of slots 0 and 3 matter."""
    base, eps = PALETTES, "1e-4"
    sides = []
    for j in range(3 * len(SLOTS)):
        for side in (-1, 1):
            us = ", ".join(f"u{k} + {side} * {eps}::DOUBLE * greatest(1, abs(u{k})) AS u{k}" if k == j else f"u{k}" for k in range(3 * len(SLOTS)))
            sides.append(f"SELECT cand_id, {j} AS dim, {side} AS side, {eps}::DOUBLE * greatest(1, abs(u{j})) AS step, {us} FROM base")
    moved = base.replace("cands AS (", "base AS (", 1).replace("p1 AS (", f"cands AS ({' UNION ALL '.join(sides)}),\np1 AS (", 1)
    total = f"{PLAIN['lightness_target'][0]} + {d(1.25)} * {PLAIN['contrast'][0]} + 2.0::DOUBLE * {huber(_SOFT_OVER, 0.02)}"
    return f"WITH {moved}, g AS (SELECT cand_id, dim, sum(side * ({total})) / max(2 * step) AS gradient FROM p GROUP BY 1, 2) {inner}"


_angles = "a AS (SELECT l_orderkey, l_linenumber, l_orderkey * 0.37::DOUBLE - l_linenumber * 11.3::DOUBLE AS x, l_quantity * 0.9::DOUBLE - 7.0::DOUBLE AS y FROM lineitem)"
_arc_len = d((0.9 - 5.8) % 6.283185307179586)
_off = wrap(f"x - {d(5.8)}")
_emb = "e AS (SELECT vec_id, 0.5 + embedding[1]::DOUBLE * 0.4::DOUBLE AS l, embedding[2]::DOUBLE * 0.3::DOUBLE AS a, embedding[3]::DOUBLE * 0.3::DOUBLE AS b FROM embeddings)"


def _soft(tau: float) -> str:
    least = "least(abs(l), abs(a), abs(b))"
    return f"{least} - {d(tau)} * ln({' + '.join(f'exp(({least} - abs({c})) / {d(tau)})' for c in 'lab')})"


def _seed_ranking() -> str:
    parts = []
    for i, s in enumerate(SLOTS):
        fit = f"l >= {d(s.lightness.min)} AND l <= {d(s.lightness.max)}"
        hue = 0.0
        if s.hue:
            hue = (s.hue.start + 0.5 * s.hue.length) % 6.283185307179586
            fit += f" AND {wrap(f'h - {d(s.hue.start)}')} <= {d(s.hue.length + 1e-10)}"
        mid_l, mid_c = (s.lightness.min + s.lightness.max) / 2, (s.chroma.min + s.chroma.max) / 2
        far = f"(pow(l - {d(mid_l)}, 2) + pow(a - {d(mid_c)} * cos({d(hue)}), 2) + pow(b - {d(mid_c)} * sin({d(hue)}), 2))"
        parts.append(f"SELECT {i} AS slot, vec_id AS sample_ord, w - 2.5 * (greatest({d(s.chroma.min)} - c, 0) + greatest(c - {d(s.chroma.max)}, 0)) - 6 * {far} AS score FROM q WHERE {fit}")
    return f"""WITH {_emb}, f AS (SELECT vec_id, {r6('l')} AS l, {r6('a')} AS a, {r6('b')} AS b, (1 + vec_id % 7)::DOUBLE AS w FROM e),
q AS (SELECT *, sqrt(a * a + b * b) AS c, {wrap('atan2(b, a)')} AS h FROM f), u AS ({' UNION ALL '.join(parts)})
SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY score DESC, sample_ord)::INTEGER AS rank, sample_ord, {r6('score')} AS score FROM u"""


def oracles() -> dict[str, str]:
    lab = f"{r6('l')} AS l, {r6('a')} AS a, {r6('b')} AS b"
    root = lambda x, y: f"pow(l + {d(x)} * a + {d(y)} * b, 3)"
    k = (root(0.3963377774, 0.2158037573), root(-0.1055613458, -0.0638541728), root(-0.0894841775, -1.291485548))
    back = {"r": (4.0767416621, -3.3077115913, 0.2309699292), "g": (-1.2684380046, 2.6097574011, -0.3413193965), "b": (-0.0041960863, -0.7034186147, 1.707614701)}
    lin = {c: " + ".join(f"{d(m)} * {x}" for m, x in zip(row, k)) for c, row in back.items()}
    own = f"greatest(0.2126::DOUBLE * greatest({lin['r']}, 0) + 0.7152::DOUBLE * greatest({lin['g']}, 0) + 0.0722::DOUBLE * greatest({lin['b']}, 0), 0)"
    w = "y / 40.0::DOUBLE"
    sal = f"SELECT image_id, idx, {r6('saliency')} AS saliency FROM salient"
    local = f"""{PIXELS}, {blurred({"l": "bl", "a": "ba", "b": "bb", "luminance": "blur_y"}, 2)},
means AS (SELECT image_id, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM pixels WHERE valid GROUP BY 1),
contrast AS (SELECT p.*, CASE WHEN valid THEN 0.8::DOUBLE * (sqrt((l - bl) * (l - bl) + (a - ba) * (a - ba) + (b - bb) * (b - bb)) + abs(luminance - blur_y)) + 0.2::DOUBLE * sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb)) ELSE 0 END AS raw FROM blurred p JOIN means USING (image_id)), {normalised("raw", True)}"""
    tile = lambda at, size, n: f"(({at} + 1) * {n} - 1) // {size}"
    strat = f"""WITH {PIXELS}, t AS (SELECT *, {tile("y", "height", 3)} AS ty, {tile("x", "width", 5)} AS tx, {KEY.format(seed=3)} AS key FROM pixels WHERE valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, ty, tx ORDER BY key, idx) AS rk, count(*) OVER (PARTITION BY image_id, ty, tx) AS n FROM t)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY ty, tx, CASE WHEN n > 4 THEN rk ELSE idx END) - 1)::INTEGER AS rep_ord, idx AS pixel_index FROM ranked WHERE rk <= 4"""
    rand = f"""WITH {PIXELS}, k AS (SELECT image_id, idx, {KEY.format(seed=9)} AS key FROM pixels WHERE valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY key, idx) AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM k)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN n > 40 THEN rk ELSE idx END) - 1)::INTEGER AS rep_ord, idx AS pixel_index FROM ranked WHERE rk <= 40"""
    medoid = f"""WITH {ASSIGNED}, m AS (SELECT g.image_id, g.rep_ord, g.l, g.a, g.b, row_number() OVER (PARTITION BY g.image_id, g.rep_ord ORDER BY (g.l - c.l) * (g.l - c.l) + (g.a - c.a) * (g.a - c.a) + (g.b - c.b) * (g.b - c.b), idx) AS rk FROM assigned g JOIN clusters c ON c.image_id = g.image_id AND c.rep_ord = g.rep_ord)
SELECT image_id, rep_ord, {lab} FROM m WHERE rk = 1"""
    diag = f"""WITH {exported("pow(mass, 1.0)", 0.0)},
size AS (SELECT image_id, max(width) AS w, max(height) AS h, sum(valid::INT)::BIGINT AS nv, sum((NOT valid)::INT)::BIGINT AS ni FROM pixels GROUP BY 1),
st AS (SELECT image_id, min(saliency) AS lo, max(saliency) AS hi, avg(saliency) AS mean FROM salient WHERE valid GROUP BY 1)
SELECT image_id, w AS original_width, h AS original_height, w AS working_width, h AS working_height, nv AS valid_pixels, ni AS invalid_pixels, {r6('lo')} AS saliency_min, {r6('hi')} AS saliency_max, {r6('mean')} AS saliency_mean,
  (SELECT count(*) FROM reps r WHERE r.image_id = size.image_id) AS n_representatives, (SELECT count(*) FROM samples q WHERE q.image_id = size.image_id) AS n_samples, (SELECT {r6('sum(weight)')} FROM samples q WHERE q.image_id = size.image_id) AS total_weight
FROM size JOIN st USING (image_id)"""
    meta = f"""WITH {SMOOTH}, b AS (SELECT image_id, {N_L * N_H} - count(*) AS empty_cells FROM bins GROUP BY 1),
s1 AS (SELECT image_id, avg(cap) AS m1, greatest(max(cap), 0) AS x1 FROM full_grid GROUP BY 1), s2 AS (SELECT image_id, avg(cap) AS m2, greatest(max(cap), 0) AS x2 FROM cap_grid GROUP BY 1)
SELECT image_id, {N_L} AS n_l, {N_H} AS n_h, {r6('l_min')} AS l_min, {r6('l_max')} AS l_max, empty_cells, {r6('m1')} AS mean_before, {r6('x1')} AS max_before, {r6('m2')} AS mean_after, {r6('x2')} AS max_after FROM ranges JOIN b USING (image_id) JOIN s1 USING (image_id) JOIN s2 USING (image_id)"""
    cells = lambda name: f"SELECT image_id, li, hi, {r6('cap')} AS cap FROM {name}"
    return {
        "srgb_linear": f"WITH {RGBA} SELECT image_id, idx, {', '.join(f'{r6(LINEAR.format(v=c))} AS lin_{c}' for c in 'rgb')} FROM rgba",
        "composite_oklab": f"WITH {pixels((30, 60, 90), True)} SELECT image_id, idx, {r6('luminance')} AS luminance, {lab}, {r6('alpha')} AS alpha, valid FROM pixels",
        "oklab_oklch": f"WITH {PIXELS} SELECT image_id, idx, {r6('sqrt(a * a + b * b)')} AS c, {r6(wrap('atan2(b, a)'))} AS h FROM pixels WHERE valid",
        "oklch_roundtrip": f"WITH {PIXELS} SELECT image_id, idx, {lab}, {', '.join(f'{r6(v)} AS lin_{c}' for c, v in lin.items())} FROM pixels WHERE valid",
        "contrast_pairs": f"WITH {PIXELS}, q AS (SELECT p.image_id, p.idx, {own.replace(' l ', ' p.l ')} AS y1, o.luminance AS y2 FROM pixels p JOIN (SELECT image_id AS i2, idx - 1 AS x2, luminance FROM pixels) o ON i2 = p.image_id AND x2 = p.idx) SELECT image_id, idx, {r6('(greatest(y1, y2) + 0.05) / (least(y1, y2) + 0.05)')} AS ratio FROM q",
        "hue_math": f"WITH {_angles} SELECT l_orderkey, l_linenumber, {r6(wrap('x'))} AS wrapped, {r6(wrap('x - y'))} AS arc, {r6(circular('x', 'y'))} AS apart, {r6(f'CASE WHEN {_off} <= {_arc_len} + 1e-12 THEN 0.0::DOUBLE ELSE least({circular("x", d(5.8))}, {circular("x", d(0.9))}) END')} AS off_arc, {r6(f'CASE WHEN {_off} <= {_arc_len} THEN {_off} WHEN {_off} - {_arc_len} <= {TAU} - {_off} THEN {_arc_len} ELSE 0.0::DOUBLE END')} AS on_arc FROM a",
        "huber_targets": f"WITH {_angles} SELECT l_orderkey, l_linenumber, {r6(huber(f'{w} - 0.4', 0.03))} AS huber, {r6(huber(relu(f'0.5 - {w}'), 0.05))} AS t0, {r6(huber(relu(f'{w} - 0.3'), 0.05))} AS t1, {r6(huber(relu(f'0.2 - {w}'), 0.05) + ' + ' + huber(relu(f'{w} - 0.6'), 0.05))} AS t2, {r6(huber(f'{w} - 0.4', 0.1))} AS t3, {r6(smooth(w))} AS smooth, {r6(relu(f'{w} - 0.2'))} AS positive, {r6(sigmoid('x / 50.0::DOUBLE'))} AS squash, {r6(f'ln(least(greatest({smooth(w)}, 1e-12::DOUBLE), {d(1 - 1e-12)}) / (1 - least(greatest({smooth(w)}, 1e-12::DOUBLE), {d(1 - 1e-12)})))')} AS logit FROM a",
        "softmin_rows": f"WITH {_emb} SELECT vec_id, {r6(_soft(0.02))} AS soft, {r6('least(abs(l), abs(a), abs(b))')} AS hard FROM e",
        "saliency_none": f"WITH {PIXELS} SELECT image_id, idx, 1.0::DOUBLE AS saliency FROM pixels",
        "saliency_global_minmax": f"WITH {GLOBAL} {sal}",
        "saliency_global_robust": f"WITH {SALIENT}, {normalised('raw', True)} {sal}",
        "box_blur": f"WITH {PIXELS}, {blurred({'l': 'bl', 'luminance': 'blur_y'}, 2)} SELECT image_id, idx, {r6('bl')} AS bl, {r6('blur_y')} AS blur_y FROM blurred",
        "saliency_local": f"WITH {local} {sal}",
        "saliency_stats": f"WITH {GLOBAL} SELECT image_id, {r6('min(saliency)')} AS saliency_min, {r6('max(saliency)')} AS saliency_max, {r6('avg(saliency)')} AS saliency_mean FROM salient WHERE valid GROUP BY 1",
        "luma_sink": f"WITH {GLOBAL} SELECT image_id, idx, round({clamp('round(saliency, 6)')} * 255)::INTEGER AS luma FROM salient",
        "uniform_grid": f"WITH {PIXELS}, {grid_cells(5)} SELECT * FROM reps",
        "stratified": strat, "random_uniform": rand,
        "stride_candidates": f"WITH {PIXELS} SELECT image_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1 AS n FROM pixels WHERE valid) WHERE n % 7 = 0",
        "reps_keep_first": f"WITH {PIXELS}, {grid_cells(5)} SELECT * FROM reps",
        "assign_nearest": f"WITH {ASSIGNED} SELECT image_id, idx, rep_ord FROM assigned",
        "clusters_centroid": f"WITH {ASSIGNED} SELECT image_id, rep_ord, {r6('mass')} AS mass, pixel_count, {r6('mean_saliency')} AS mean_saliency, {lab} FROM clusters",
        "clusters_medoid": medoid,
        "export_weights": f"WITH {exported('pow(mass, 0.8) * (0.5 + 0.5 * pow(mean_saliency, 1.5))', 0.02)} {SAMPLES}",
        "pipeline_support": f"WITH {exported('pow(mass, 1.0)', 0.0)} {SAMPLES}",
        "image_diagnostics": diag,
        "cap_bins": f"WITH {BINS} {cells('bins')}", "cap_hue_fill": f"WITH {FILLED} {cells('hued')}", "cap_lightness_fill": f"WITH {LIT} {cells('full_grid')}", "cap_smooth": f"WITH {SMOOTH} {cells('cap_grid')}", "cap_meta": meta,
        **{f"cap_query_{n}": cap_query(m) for n, m in CAP_MODES.items()},
        "decode_slots": decoded(),
        **{f"term_{n}": term(n) for n in TERMS},
        "soft_cap": f"WITH {PALETTES} SELECT cand_id, 'soft_cap/accent' AS name, {r6(huber(_SOFT_OVER, 0.02))} AS raw, {r6(f'2 * {huber(_SOFT_OVER, 0.02)}')} AS weighted, {r6(_SOFT_OVER)} AS overflow, {r6('cap2 * 0.8::DOUBLE')} AS relaxed_cap FROM p",
        "objective_breakdown": f"WITH {WITH_SAMPLES}, {all_terms()} SELECT name, round(sum(raw), 4) + 0.0::DOUBLE AS raw, round(sum(weighted), 4) + 0.0::DOUBLE AS weighted, count(*) AS n FROM t GROUP BY 1",
        "objective_totals": f"{TOTALS} SELECT * FROM o",
        "objective_best": f"{TOTALS} SELECT * FROM o ORDER BY objective, cand_id LIMIT 10",
        "fd_gradient": gradient("SELECT cand_id, dim, round(gradient, 4) + 0.0::DOUBLE AS gradient FROM g"),
        "fd_gradient_norm": gradient("SELECT cand_id, round(sqrt(sum(gradient * gradient)), 4) + 0.0::DOUBLE AS gradient_norm FROM g GROUP BY 1"),
        "seed_ranking": _seed_ranking(),
    }
