"""SQL of the queries over views, regions, dust and retouching, written from the definitions."""

from __future__ import annotations

from rasterfold.plans.oracle import BIN, CAP, EMB, FK, FRAMES, GRAY, LI, LUMA, MESH, ORACLE_SQL, PARETO, RGB, TRI, WIN, H, N, W, _dec, _shrink, exp, red, refl, sep, win

#: Both engines round a hair above, as the tables hold short decimals.
HAIR = "2.7e-10"
VIEWS = "vw(view, s) AS (VALUES (0, -0.08), (1, 0.0), (2, 0.11))"
VK = ["view", "frame"]


def rnd(cols: list[str], digits: int = 6, src: str = "") -> str:
    return ", ".join(f"round({src}{c} + {HAIR}, {digits}) + 0.0 AS {c}" for c in cols)


def shifts(sign: int) -> str:
    return f"{VIEWS}, sh AS (SELECT view, f.i AS frame, s * {W} * (f.i / {N - 1}.0 - 0.5) * {sign} AS dx FROM vw, range({N}) f(i))"


def blocks(src: str, k: int, cols: list[str]) -> str:
    """Means of blocks of the shifted frames, place by place; where nothing moves, the last block may be short."""
    ow, oh = -(-W // k), -(-H // k)
    at = f"o.i * {k} + p.i - round_even(dx, 0)::INTEGER"
    return f"""(SELECT view, s.frame, q.i AS y, o.i AS x, {', '.join(f'avg(s.{c}) AS {c}' for c in cols)}, avg(CASE WHEN {at} BETWEEN 0 AND {W - 1} THEN 1.0 ELSE 0.0 END) AS inside
FROM sh, range({oh}) q(i), range({k}) j(i), range({ow}) o(i), range({k}) p(i), {src} s
WHERE s.frame = sh.frame AND s.y = q.i * {k} + j.i AND s.x = least(greatest({at}, 0), {W - 1}) AND (round_even(dx, 0) <> 0 OR o.i * {k} + p.i < {W}) GROUP BY ALL)"""


def _spline(t: str) -> list[str]:
    return [f"((-1/3*{t} + 4/5)*{t} - 7/15)*{t}", f"(({t} - 9/5)*{t} - 1/5)*{t} + 1", f"((6/5 - {t})*{t} + 4/5)*{t}", f"((1/3*{t} - 1/5)*{t} - 2/15)*{t}"]


def _fine() -> str:
    t = "((o.i - dx) - floor(o.i - dx))"
    weight = f"CASE j.i {' '.join(f'WHEN {k} THEN {w}' for k, w in enumerate(_spline(t)))} END"
    at = "floor(o.i - dx)::INTEGER - 1 + j.i"
    return f"WITH {GRAY}, {shifts(-1)}, m AS (SELECT view, s.frame, s.y, o.i AS x, sum(v * ({weight})) AS v, sum(CASE WHEN {at} BETWEEN 0 AND {W - 1} THEN {weight} ELSE 0.0 END) AS inside FROM sh, range({W}) o(i), range(4) j(i), gray s WHERE s.frame = sh.frame AND s.x = least(greatest({at}, 0), {W - 1}) GROUP BY ALL) SELECT view, frame, y, x, {rnd(['v', 'inside'])} FROM m"


def _refold() -> str:
    h, w = H // 2, W // 2
    return f"""WITH {LI}, {shifts(1)}, mv AS {blocks('li', 2, RGB)},
small AS {sep('mv', red(h), red(w), RGB, VK)}, up AS {sep('small', exp(h), exp(w), RGB, VK)},
lap AS (SELECT view, frame, y, x, {', '.join(f'mv.{c} - up.{c} AS {c}' for c in RGB)} FROM mv JOIN up USING (view, frame, y, x)),
e0 AS (SELECT view, frame, y, x, ({LUMA}) * ({LUMA}) AS e FROM lap),
en AS (SELECT lap.*, round(k.e, 10) AS e FROM lap JOIN {sep('e0', win(h, BIN), win(w, BIN), ['e'], VK)} k USING (view, frame, y, x)),
won AS (SELECT view, y, x, r, g, b FROM en QUALIFY row_number() OVER (PARTITION BY view, y, x ORDER BY e DESC, frame) = 1),
rs AS (SELECT view, y, x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM small GROUP BY ALL), ru AS {sep('rs', exp(h), exp(w), RGB, ['view'])},
cv AS (SELECT view, y, x, count(*) FILTER (WHERE inside > 0.999) AS covered FROM mv GROUP BY ALL)
SELECT view, y, x, covered, {', '.join(f'round(least(greatest(won.{c} + ru.{c}, 0.0), 1.0) + {HAIR}, 6) + 0.0 AS {c}' for c in RGB)} FROM won JOIN ru USING (view, y, x) JOIN cv USING (view, y, x)"""


def flood(mask: str, out: str) -> str:
    """Every set pixel with all pixels of its frame that steps to one of the eight neighbours reach, and their least place."""
    return f"""walk(frame, y, x, ty, tx) AS (SELECT frame, y, x, y, x FROM {mask} UNION SELECT k.frame, k.y, k.x, m.y, m.x FROM walk k JOIN {mask} m ON m.frame = k.frame AND abs(m.y - k.ty) <= 1 AND abs(m.x - k.tx) <= 1),
{out} AS (SELECT frame, y, x, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS region FROM (SELECT frame, y, x, min(ty * 1000 + tx) AS root FROM walk GROUP BY ALL))"""


def _bright(least: float) -> str:
    return f"WITH RECURSIVE {GRAY}, lit AS (SELECT frame, y, x FROM gray WHERE v > {least}), {flood('lit', 'rg')}"


# ---- dust

HH, HW, LEVELS = H // 2, W // 2, 3
NINE = ["s", "sx", "sy", "sv", "sxv", "syv", "sxx", "sxy", "syy"]
DUSTY = f"""{GRAY}, dm AS (SELECT frame, y, x, (0.7 + 0.02 * v + 0.004 * x) * CASE WHEN pow(y - (8 + frame), 2) + pow(x - (8 + 2 * frame), 2) < 5 THEN 0.5 WHEN pow(y - 16, 2) + pow(x - 27, 2) < 4 THEN 0.6 ELSE 1.0 END AS v FROM gray),
hf AS {sep('dm', red(H), red(W), ['v'], FK)}"""


def _grow(src: str, axis: str, n: int, keys: str) -> str:
    """One more sample at each end: twice the last less the one before it; places go up by one."""
    ends = " UNION ALL ".join(f"SELECT {keys}, {at} AS {axis}, 2 * max(v) FILTER (WHERE {axis} = {i}) - max(v) FILTER (WHERE {axis} = {j}) AS v FROM {src} GROUP BY {keys}" for at, i, j in ((0, 0, min(1, n - 1)), (n + 1, n - 1, max(n - 2, 0))))
    return f"(SELECT {keys}, {axis} + 1 AS {axis}, v FROM {src} UNION ALL {ends})"


def background(src: str, name: str) -> str:
    """The plane under each coarse cell by Cramer's rule on moments about the cell's centre, expanded back. src has v and wt."""
    xs, ys = f"((x - {HW / 2}) / {HW}.0)", f"((y - {HH / 2}) / {HW}.0)"
    terms = ["1.0", xs, ys, "v", f"{xs} * v", f"{ys} * v", f"{xs} * {xs}", f"{xs} * {ys}", f"{ys} * {ys}"]
    out = [f"{name}0 AS (SELECT frame, y, x, {', '.join(f'wt * {t} AS {n}' for t, n in zip(terms, NINE))} FROM {src})"]
    h, w, sizes = HH, HW, [(HH, HW)]
    for k in range(LEVELS):
        out.append(f"{name}{k + 1} AS {sep(f'{name}{k}', red(h), red(w), NINE, FK)}")
        h, w = (h + 1) // 2, (w + 1) // 2
        sizes.append((h, w))
    step = 2**LEVELS
    out.append(f"{name}c AS (SELECT *, (x * {step} - {HW / 2}) / {HW}.0 AS xc, (y * {step} - {HH / 2}) / {HW}.0 AS yc FROM {name}{LEVELS})")
    out.append(f"{name}d AS (SELECT frame, y, x, s, sv, sx - xc * s AS a, sy - yc * s AS b, sxx - 2 * xc * sx + xc * xc * s AS aa, sxy - xc * sy - yc * sx + xc * yc * s AS ab, syy - 2 * yc * sy + yc * yc * s AS bb, sxv - xc * sv AS av, syv - yc * sv AS bv FROM {name}c)")
    det = "s * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b)"
    out.append(f"{name}p AS (SELECT frame, y, x, (sv * (aa * bb - ab * ab) - a * (av * bb - ab * bv) + b * (av * ab - aa * bv)) / ({det}) AS v FROM {name}d)")
    last = f"{name}p"
    for k in range(LEVELS - 1, -1, -1):
        (h, w), (ch, cw) = sizes[k], sizes[k + 1]
        out.append(f"{name}x{k} AS {_grow(last, 'x', cw, 'frame, y')}, {name}y{k} AS {_grow(f'{name}x{k}', 'y', ch, 'frame, x')}, {name}e{k} AS {sep(f'{name}y{k}', exp(2 * ch + 4), exp(2 * cw + 4), ['v'], FK)}")
        out.append(f"{name}b{k} AS (SELECT frame, y - 2 AS y, x - 2 AS x, v FROM {name}e{k} WHERE y BETWEEN 2 AND {h + 1} AND x BETWEEN 2 AND {w + 1})")
        last = f"{name}b{k}"
    return ", ".join(out)


SEEN = f"""{DUSTY}, w1 AS (SELECT *, 1.0 AS wt FROM hf), {background('w1', 'p')},
d1 AS (SELECT hf.frame, hf.y, hf.x FROM hf JOIN pb0 USING (frame, y, x) WHERE pb0.v > 1e-6 AND hf.v / pb0.v < 0.9),
w2 AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM d1 WHERE d1.frame = hf.frame AND abs(d1.y - hf.y) <= 2 AND abs(d1.x - hf.x) <= 2) THEN 0.0 ELSE 1.0 END AS wt FROM hf), {background('w2', 'q')},
seen AS (SELECT hf.frame, hf.y, hf.x, hf.v, qb0.v AS bg, (qb0.v > 1e-6 AND hf.v / qb0.v < 0.9)::INTEGER AS mask FROM hf JOIN qb0 USING (frame, y, x))"""
SPOTS = f"""{SEEN}, lit AS (SELECT frame, y, x FROM seen WHERE mask = 1), {flood('lit', 'rg')},
bl AS (SELECT frame, region, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rg GROUP BY ALL HAVING count(*) * 4 >= 8),
sp AS (SELECT frame, region, row_number() OVER (PARTITION BY frame ORDER BY n DESC, region) AS spot, greatest(2 * x0 - 1, 0) AS x, greatest(2 * y0 - 1, 0) AS y, least(2 * x1 + 3, {W}) AS xe, least(2 * y1 + 3, {H}) AS ye, n * 4 AS area FROM bl WHERE greatest(x1 - x0 + 1, y1 - y0 + 1) * 4 <= {min(HH, HW)}),
px AS (SELECT DISTINCT frame, spot, y.i AS y, x.i AS x FROM rg JOIN sp USING (frame, region), range({H}) y(i), range({W}) x(i) WHERE y.i BETWEEN 2 * rg.y - 1 AND 2 * rg.y + 2 AND x.i BETWEEN 2 * rg.x - 1 AND 2 * rg.x + 2)"""
RATIO = "rt AS (SELECT frame, y, x, CASE WHEN v > 1e-6 AND bg > v THEN least(bg / v, 10.0) ELSE 1.0 END AS g FROM seen)"
GAIN = f"""{RATIO}, gn AS (SELECT px.frame, spot, px.y, px.x, avg(g) AS gain FROM px, (VALUES (0), (1)) i(i), (VALUES (0), (1)) j(j), rt WHERE rt.frame = px.frame AND rt.y = least((px.y + i) // 2, {HH - 1}) AND rt.x = least((px.x + j) // 2, {HW - 1}) GROUP BY ALL)"""
SHOTS = f"so AS (SELECT frame, 0 AS shot, y, x, v FROM gray UNION ALL SELECT frame, 1, y, {W - 1} - x, v FROM gray)"

# ---- retouching

LOG = """lg AS (SELECT user_id AS list, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 7 < 3 THEN 0 WHEN event_id % 7 < 5 THEN 1 ELSE 2 END AS act, event_id AS stroke FROM events),
st(list, seq, act, stroke, place, top) AS (SELECT list, 0::BIGINT, 1, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT list FROM lg)
UNION ALL SELECT l.list, l.seq, l.act, l.stroke, CASE l.act WHEN 0 THEN s.place + 1 WHEN 1 THEN greatest(s.place - 1, 0) ELSE least(s.place + 1, s.top) END, CASE l.act WHEN 0 THEN s.place + 1 ELSE s.top END FROM st s JOIN lg l ON l.list = s.list AND l.seq = s.seq + 1),
fin AS (SELECT list, arg_max(place, seq) AS place, arg_max(top, seq) AS top FROM st GROUP BY list),
lv AS (SELECT st.list, st.place AS slot, arg_max(stroke, seq) AS stroke FROM st JOIN fin ON fin.list = st.list AND st.place <= fin.place WHERE act = 0 AND seq > 0 GROUP BY ALL)"""
BRUSH = f"""{EMB}, im AS (SELECT stack, y, x, frame, floor(least(greatest(v, 0.0), 1.0) * 65535 + 0.5)::BIGINT AS v FROM emb WHERE frame < 2), {LOG},
db AS (SELECT list AS stack, slot, q.i AS seq, stroke % 7 + q.i * 1.5 AS dx, stroke % 8 AS dy, (1 + stroke % 3)::DOUBLE AS r, (stroke % 10) / 10 AS hard FROM lv, range(3) q(i)),
ht AS (SELECT a.stack, a.y, a.x, b.v AS s, slot, seq, hard, sqrt(pow(a.x - dx, 2) + pow(a.y - dy, 2)) / r AS t FROM im a JOIN im b ON b.stack = a.stack AND b.y = a.y AND b.x = a.x AND a.frame = 0 AND b.frame = 1 JOIN db ON db.stack = a.stack),
hk AS (SELECT *, row_number() OVER (PARTITION BY stack, y, x ORDER BY slot, seq) AS k, least(greatest((t - hard) / (1 - hard), 0.0), 1.0) AS u FROM ht WHERE t < 1),
pt(stack, y, x, k, v) AS (SELECT stack, y, x, 0::BIGINT, v::DOUBLE FROM im WHERE frame = 0 UNION ALL SELECT p.stack, p.y, p.x, h.k, floor(p.v + (1 - u * u * (3 - 2 * u)) * (h.s - p.v) + 0.5) FROM pt p JOIN hk h ON h.stack = p.stack AND h.y = p.y AND h.x = p.x AND h.k = p.k + 1)"""



def _stl() -> str:
    names = [f"{k}_{x}" for k in "abc" for x in "xyz"]
    p = ", ".join(f"{n[0]}.p{n[2]} AS {n}" for n in names)
    return f"WITH h AS ({ORACLE_SQL['heightfield']}), t AS ({ORACLE_SQL['mesh_triangles']}), w AS (SELECT j * 8 + i AS k, px, py, pz FROM h), m AS (SELECT {p} FROM t JOIN w a ON a.k = t.a JOIN w b ON b.k = t.b JOIN w c ON c.k = t.c) SELECT {rnd(names)} FROM m"


SCENE_SQL = {
    "shifted_proxy": f"WITH {GRAY}, {shifts(1)}, m AS {blocks('gray', 3, ['v'])} SELECT view, frame, y, x, {rnd(['v', 'inside'])} FROM m",
    "shifted_frames": _fine(),
    "refold_views": _refold(),
    "bright_regions": f"{_bright(0.52)} SELECT frame, y, x, region FROM rg",
    "region_neighbours": f"{_bright(0.58)}, bx AS (SELECT frame, region, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rg GROUP BY ALL) SELECT a.frame, a.region, b.region AS other_region FROM bx a JOIN bx b ON a.frame = b.frame AND a.region <> b.region AND a.x0 - 2 <= b.x1 AND b.x0 <= a.x1 + 2 AND a.y0 - 2 <= b.y1 AND b.y0 <= a.y1 + 2",
    "dust_background": f"WITH {SEEN} SELECT frame, y, x, {rnd(['bg'])}, mask FROM seen",
    "dust_spots": f"WITH RECURSIVE {SPOTS} SELECT frame, spot, x, y, xe - x AS w, ye - y AS h, area FROM sp",
    "dust_report": f"""WITH RECURSIVE {SPOTS}, f AS (SELECT frame, count(*) AS n, min(greatest(greatest(xe - x, ye - y) - 2, 0)) AS lo, max(greatest(greatest(xe - x, ye - y) - 2, 0)) AS hi FROM sp GROUP BY frame), c AS (SELECT frame, count(*) AS covered FROM px GROUP BY frame),
r AS (SELECT frame, count(*) AS rejected FROM bl WHERE greatest(x1 - x0 + 1, y1 - y0 + 1) * 4 > {min(HH, HW)} GROUP BY frame), j AS (SELECT frame, coalesce(n, 0) AS n, lo, hi, coalesce(covered, 0) AS covered, coalesce(rejected, 0) AS rejected FROM f FULL JOIN c USING (frame) FULL JOIN r USING (frame))
SELECT frame, n AS spots, covered, rejected, CASE WHEN n = 0 THEN 'no dust spots' ELSE n || ' dust spot' || CASE WHEN n = 1 THEN '' ELSE 's' END || ', ' || CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '–' || hi END || ' px across, ' || printf('%.2f', 100.0 * covered / {H * W}) || ' % of the frame' END || CASE WHEN rejected = 0 THEN '' ELSE ' (' || rejected || ' blob' || CASE WHEN rejected = 1 THEN '' ELSE 's' END || ' wider than a quarter of the frame left out: not dust)' END AS report FROM j""",
    "dust_flat": f"WITH RECURSIVE {SPOTS}, {GAIN}, ga AS (SELECT frame, y, x, product(gain) AS gain, max(spot) AS spot FROM gn GROUP BY ALL), {SHOTS} SELECT so.frame, shot, so.y, so.x, round(v * coalesce(gain, 1.0) + {HAIR}, 6) + 0.0 AS v, coalesce(spot, 0) AS spot FROM so LEFT JOIN ga USING (frame, y, x)",
    "mesh_stl": _stl(),
    "history_depths": f"WITH RECURSIVE {LOG} SELECT list, place AS undos, top - place AS redos FROM fin",
    "history_live": f"WITH RECURSIVE {LOG} SELECT list, slot, stroke FROM lv",
    "brush_strokes": f"WITH RECURSIVE {BRUSH} SELECT stack, y, x, arg_max(v, k)::BIGINT AS v FROM pt GROUP BY ALL",
}


# ---- views of a stack, meshes as text, the fold of two levels


def _sheared(name: str, shift: float) -> str:
    """name (y, x, r, g, b): frame 0 seen from the side; `won` has the depth. Every column looks for the surfaces that reach it."""
    k, n = f"{shift * W!r}::DOUBLE", name
    return f"""{n}d AS (SELECT y, x, z, x + {k} * (z - 0.5) AS d0, lead(x + {k} * (z - 0.5)) OVER r AS d1, lead(z) OVER r AS z1 FROM (SELECT y, x, winner / 6.0 AS z FROM won) WINDOW r AS (PARTITION BY y ORDER BY x)),
{n}p AS (SELECT y, c.i AS c, x + (c.i - d0) / (d1 - d0) AS src, -z + (c.i - d0) / (d1 - d0) * (z - z1) AS n, x FROM {n}d, range({W}) c(i) WHERE d1 > d0 AND d1 - d0 <= 2 AND c.i >= d0 AND c.i < d1
UNION ALL SELECT y, round(d0)::BIGINT, x, -z, x FROM {n}d WHERE NOT coalesce(d1 > d0 AND d1 - d0 <= 2, false) AND round(d0) BETWEEN 0 AND {W - 1}),
{n}t AS (SELECT y, c, src, n FROM {n}p QUALIFY row_number() OVER (PARTITION BY y, c ORDER BY n DESC, x) = 1),
{n}h AS (SELECT y, x AS c, (SELECT max(t.c) FROM {n}t t WHERE t.y = g.y AND t.c <= g.x) AS l, (SELECT min(t.c) FROM {n}t t WHERE t.y = g.y AND t.c >= g.x) AS r FROM won g),
{n}s AS (SELECT h.y, h.c, least(greatest(coalesce(CASE WHEN b.n IS NULL OR a.n <= b.n THEN a.src ELSE b.src END, h.c), 0), {W - 1}) AS s FROM {n}h h LEFT JOIN {n}t a ON a.y = h.y AND a.c = h.l LEFT JOIN {n}t b ON b.y = h.y AND b.c = h.r),
{n} AS (SELECT s.y, s.c AS x, {', '.join(f'a.{c} + (s - floor(s)) * (b.{c} - a.{c}) AS {c}' for c in RGB)} FROM {n}s s JOIN li a ON a.frame = 0 AND a.y = s.y AND a.x = floor(s) JOIN li b ON b.frame = 0 AND b.y = s.y AND b.x = least(floor(s) + 1, {W - 1}))"""


_PAIR = f"WITH {WIN}, {_sheared('lv', -0.05)}, {_sheared('rv', 0.05)}"
_TRIANGLES = """SELECT 2 * q AS n, q + 1 AS a, q + 9 AS b, CASE WHEN s THEN q + 10 ELSE q + 2 END AS c FROM tri UNION ALL SELECT CASE WHEN s THEN 2 * q ELSE 2 * q + 2 END, CASE WHEN s THEN q + 1 ELSE q + 2 END, CASE WHEN s THEN q + 10 ELSE q + 9 END, CASE WHEN s THEN q + 2 ELSE q + 10 END FROM tri"""


def _text(letter: str, cols: list[str]) -> str:
    return f"printf('{letter} {' '.join(['%.6f'] * len(cols))}', {', '.join(f'round({c}, 6) + 0.0' for c in cols)})"


def _detail(k: int, src: str, h: int, w: int) -> str:
    """Level k of the pyramid over src, folded: d{k} the next coarser picture, o{k} the coefficients of the frames with the most energy."""
    return f"""d{k} AS {sep(src, red(h), red(w), RGB, FK)}, u{k} AS {sep(f'd{k}', exp(h), exp(w), RGB, FK)}, l{k} AS (SELECT a.frame, a.y, a.x, {', '.join(f'a.{c} - u.{c} AS {c}' for c in RGB)} FROM {src} a JOIN u{k} u USING (frame, y, x)),
q{k} AS (SELECT frame, y, x, ({LUMA}) * ({LUMA}) AS e FROM l{k}), o{k} AS (SELECT l.y, l.x, {', '.join(f'l.{c}' for c in RGB)} FROM l{k} l JOIN {sep(f'q{k}', win(h, BIN), win(w, BIN), ['e'], FK)} e USING (frame, y, x) QUALIFY row_number() OVER (PARTITION BY l.y, l.x ORDER BY round(e.e, 10) DESC, l.frame) = 1)"""


def _marked(src: str, h: int, w: int) -> str:
    """tm: the residuals with their local deviation and entropy, over windows of 3 x 3 and 16 bins."""
    return f"""tl AS (SELECT frame, y, x, {LUMA} AS v FROM {src}),
nb AS (SELECT a.frame, a.y, a.x, b.v, floor(least(greatest(b.v, 0), 1) * 15 + 0.5)::INTEGER AS bin FROM tl a, range(-1, 2) p(dy), range(-1, 2) q(dx), tl b WHERE a.frame = b.frame AND b.y = {refl('a.y + dy', h)} AND b.x = {refl('a.x + dx', w)}),
hb AS (SELECT frame, y, x, bin, count(*) / 9.0 AS p, sum(v) AS s, sum(v * v) AS q FROM nb GROUP BY ALL),
mk AS (SELECT frame, y, x, round(greatest(sum(q) / 9.0 - (sum(s) / 9.0) * (sum(s) / 9.0), 0.0), 10) AS dev, round(-sum(p * ln(p)), 10) AS ent FROM hb GROUP BY ALL),
tm AS (SELECT * FROM {src} JOIN mk USING (frame, y, x))"""


def _added(name: str, won: str, coarse: str, h: int, w: int) -> str:
    return f"{name} AS (SELECT a.y, a.x, {', '.join(f'a.{c} + u.{c} AS {c}' for c in RGB)} FROM {won} a JOIN {sep(coarse, exp(h), exp(w), RGB, [])} u USING (y, x))"


def _camera() -> str:
    """Back through the curve, then three equations for the camera's values by Cramer's rule."""
    m = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]

    def det(cols: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = cols
        return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"

    columns = [[f"{m[r][k]!r}::DOUBLE" for r in range(3)] for k in range(3)]
    linear = [f"({_dec(c)})" for c in RGB]
    solved = [f"{det([linear if j == k else col for j, col in enumerate(columns)])} / {det(columns)} / {by}" for k, by in enumerate((1.9, 1.0, 1.4))]
    return f"WITH {LI}, cm AS (SELECT frame, y, x, {', '.join(f'{v} AS {c}' for v, c in zip(solved, RGB))} FROM li) SELECT frame, y, x, {rnd(RGB)} FROM cm"


SCENE_SQL |= {
    "camera_space": _camera(),
    "capture_times": "WITH e AS (SELECT event_id AS k, epoch(date_trunc('second', ts)) AS s FROM events) SELECT k AS event_id, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN s + 0.25 WHEN k % 5 = 0 THEN s + 3600 WHEN k % 7 < 3 THEN s + 7200 WHEN k % 11 < 5 THEN s + 10800.5 WHEN k % 13 < 6 THEN s + 14400 END::DOUBLE AS t FROM e",
    "subject_distances": "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN p_size / 8 WHEN 3 THEN p_size / 4 END::DOUBLE AS metres FROM part",
    "pixel_sizes": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 3 AS b, p_partkey % 4 AS u, p_size AS v, CASE WHEN p_partkey % 9 > 0 THEN p_size / 2 END AS each FROM part),
s AS (SELECT p_partkey, CASE WHEN a = 0 THEN CASE b WHEN 0 THEN v / 8000 WHEN 2 THEN v / 8 END WHEN a = 1 THEN CASE b WHEN 0 THEN 1 / each WHEN 1 THEN 1000 / each END WHEN a > 2 THEN CASE u WHEN 2 THEN 25400 / each WHEN 3 THEN 10000 / each END END AS um, CASE a WHEN 0 THEN 'OME-XML' WHEN 1 THEN 'ImageJ' ELSE 'TIFF resolution' END AS source FROM p)
SELECT p_partkey, """ + rnd(["um"]) + """, CASE WHEN um IS NOT NULL THEN source END AS source FROM s""",
    "length_labels": """WITH v AS (SELECT p_partkey, p_retailprice * 1.0003::DOUBLE * pow(10.0, p_partkey % 9 - 5) AS v FROM part), c AS (SELECT p_partkey, v, m * pow(10.0, floor(log10(v))) AS k FROM v, (VALUES (1.0), (2.0), (5.0), (10.0)) t(m)),
n AS (SELECT p_partkey, arg_min(k, round(abs(log10(k) - log10(v)), 12)) AS n FROM c GROUP BY p_partkey), w AS (SELECT p_partkey, 'label' AS c, CASE WHEN p_partkey % 10 > 0 THEN v END AS um FROM v UNION ALL SELECT p_partkey, 'nice', n FROM n),
d AS (SELECT *, um / CASE WHEN um < 1 THEN 1e-3 WHEN um < 1e3 THEN 1 WHEN um < 1e6 THEN 1e3 ELSE 1e6 END AS q, CASE WHEN um < 1 THEN ' nm' WHEN um < 1e3 THEN ' µm' WHEN um < 1e6 THEN ' mm' ELSE ' m' END AS unit FROM w),
t AS (SELECT p_partkey, c, rtrim(rtrim(CASE WHEN abs(q - round(q)) < 1e-6 * greatest(q, 1) THEN round(q) ELSE round(q, least(greatest(2 - floor(log10(q)), 0), 6)::INTEGER) END::DECIMAL(38, 6)::VARCHAR, '0'), '.') || unit AS s FROM d)
SELECT p_partkey, max(s) FILTER (WHERE c = 'label') AS label, max(s) FILTER (WHERE c = 'nice') AS nice FROM t GROUP BY p_partkey""",
    "mesh_texture": f"WITH {LI}, t AS {sep('li', _shrink(H, 15), _shrink(W, 20), RGB, FK)} SELECT frame, y, x, {', '.join(f'floor(least(greatest(round({c}, 9), 0.0), 1.0) * 255 + 0.5)::INTEGER AS {c}' for c in RGB)} FROM t",
    "scale_bars": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 > 0 THEN p_size * 0.013::DOUBLE * pow(10.0, p_partkey % 6 - 2) END AS um, CASE WHEN p_partkey % 5 = 0 THEN p_size * 3.0::DOUBLE * pow(10.0, p_partkey % 3) END AS asked, 300 + 7 * p_size AS w, 0.03::DOUBLE * (200 + p_partkey % 900) AS em FROM part),
q AS (SELECT *, coalesce(um, 1.0::DOUBLE) AS e, w - 2 * 0.8::DOUBLE * em - 2 * (greatest(floor(0.05::DOUBLE * em + 0.5), 1) + 1) AS room FROM p),
n AS (SELECT k, arg_min(m * pow(10.0, x), round(abs(log10(m) + x - log10(0.2::DOUBLE * w * e)), 12)) AS near, max(m * pow(10.0, y)) FILTER (WHERE m * pow(10.0, y) <= room * e * (1 + 1e-9::DOUBLE)) AS most FROM (SELECT *, floor(log10(0.2::DOUBLE * w * e)) AS x, floor(log10(room * e)) AS y FROM q), (VALUES (1.0), (2.0), (5.0), (10.0)) t(m) GROUP BY k),
l AS (SELECT k, um, e, CASE WHEN coalesce(asked, near) > room * e THEN most ELSE coalesce(asked, near) END AS length FROM q JOIN n USING (k)),
d AS (SELECT *, length / CASE WHEN um IS NULL THEN 1 WHEN length < 1 THEN 1e-3 WHEN length < 1e3 THEN 1 WHEN length < 1e6 THEN 1e3 ELSE 1e6 END AS v, CASE WHEN um IS NULL THEN ' px' WHEN length < 1 THEN ' nm' WHEN length < 1e3 THEN ' µm' WHEN length < 1e6 THEN ' mm' ELSE ' m' END AS unit FROM l)
SELECT k AS p_partkey, """ + rnd(["length"]) + """, greatest(floor(length / e + 0.5), 1)::INTEGER AS px, rtrim(rtrim(CASE WHEN um IS NULL THEN v WHEN abs(v - round(v)) < 1e-6 * greatest(v, 1) THEN round(v) ELSE round(v, least(greatest(2 - floor(log10(v)), 0), 6)::INTEGER) END::DECIMAL(38, 6)::VARCHAR, '0'), '.') || unit AS label FROM d""",
    "burnt_bar": f"WITH {LI}, cv AS (SELECT frame, y, x, greatest(least(x + 1, frame * 3.5 + 9.75) - greatest(x, 3.25), 0)::DOUBLE * greatest(least(y + 1, 20.75) - greatest(y, 18.5), 0)::DOUBLE AS k FROM li), ha AS (SELECT a.frame, a.y, a.x, max(b.k) AS h FROM cv a JOIN cv b ON a.frame = b.frame AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 4 GROUP BY ALL) SELECT frame, y, x, {', '.join(f'round({c} * (1 - h) * (1 - k) + k + {HAIR}, 6) + 0.0 AS {c}' for c in RGB)} FROM li JOIN cv USING (frame, y, x) JOIN ha USING (frame, y, x)",
    "expanded_inputs": f"WITH {FRAMES}, fl AS (SELECT DISTINCT path, regexp_extract(path, '([0-9]+)/', 1)::INTEGER AS d, regexp_extract(path, 'f([0-9]+)[.]', 1)::INTEGER AS t FROM fr), pl AS (SELECT -2 * d - 1 AS p, min(path) AS path, 0 AS t FROM fl GROUP BY d UNION ALL SELECT -2 * d, path, t FROM fl) SELECT row_number() OVER (ORDER BY p, t, path) - 1 AS n, path FROM pl",
    "project_settings": """WITH l AS (SELECT DISTINCT user_id AS k FROM events)
SELECT k::VARCHAR AS project, 'list' || k || '_stacked.' || CASE WHEN k % 4 = 0 THEN 'jpg' ELSE 'png' END AS output, k % 2 = 0 AS "align", concat_ws(' ', CASE WHEN k % 3 = 0 THEN 'xoff yoff' END, CASE WHEN k % 5 = 0 THEN 'rot' END) AS fixed, true AS brightness, (k % 7)::INTEGER AS coarsen, CASE WHEN k % 4 > 0 THEN 'lanczos3' END AS kernel, nullif(k % 6, 0)::INTEGER AS levels,
CASE k % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'dir' END AS "by", CASE WHEN k % 3 = 0 THEN 10.0::DOUBLE END AS size, CASE WHEN k % 2 = 0 THEN (k + 1)::INTEGER END AS x, CASE WHEN k % 2 = 0 THEN 30 END AS w, k % 5 > 0 AS crop,
concat_ws(' ', CASE WHEN k % 3 > 0 THEN 'depth' END, CASE WHEN k % 2 = 0 THEN 'stereo' END, CASE WHEN k % 3 = 0 THEN 'mesh' END) AS outputs, CASE WHEN k % 2 = 0 THEN k / 4 END::DOUBLE AS shift, CASE WHEN k % 2 = 0 THEN 'sbs' END AS layout, CASE WHEN k % 3 = 0 THEN 'glb' END AS form, CASE WHEN k % 2 = 1 THEN 'left out: winner' ELSE '' END AS notes FROM l""",
    "project_frames": f"WITH {CAP}, s AS (SELECT list, frame, row_number() OVER (PARTITION BY list ORDER BY frame) - 1 AS n FROM cap WHERE frame % 4 <> 0) SELECT list::VARCHAR AS project, n::INTEGER AS frame, 'f' || frame || '.tif' AS name, CASE WHEN frame % 3 > 0 THEN 'shoot/' ELSE '' END || 'f' || frame || '.tif' AS path FROM s",
    "focus_specs": """WITH p AS (SELECT p_partkey, p_partkey % 6 AS a, p_partkey % 5 AS b, p_size::INTEGER AS v FROM part), m AS (SELECT *, CASE WHEN a < 3 AND (a <> 2 OR v < 9) THEN 'ring' WHEN a = 3 THEN 'laplacian' END AS kind FROM p)
SELECT p_partkey, kind, CASE WHEN kind = 'ring' THEN CASE a WHEN 0 THEN 1 ELSE v END END::INTEGER AS inner, CASE WHEN kind = 'ring' THEN CASE a WHEN 0 THEN 3 WHEN 1 THEN v + 2 ELSE 9 END END::INTEGER AS outer, CASE WHEN kind = 'laplacian' THEN v END::INTEGER AS step, CASE b WHEN 0 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN NULL ELSE v END::INTEGER AS radius, CASE b WHEN 1 THEN 0.01 WHEN 2 THEN 0.5 WHEN 3 THEN 0.01 END::DOUBLE AS eps FROM m""".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'),
    "sheared_view": f"WITH {WIN}, {_sheared('vw', 0.07)} SELECT y, x, {rnd(RGB)} FROM vw",
    "anaglyph": f"{_PAIR} SELECT lv.y, lv.x, round(lv.r + {HAIR}, 6) + 0.0 AS r, round(rv.g + {HAIR}, 6) + 0.0 AS g, round(rv.b + {HAIR}, 6) + 0.0 AS b FROM lv JOIN rv USING (y, x)",
    "stereo_pair": f"{_PAIR} SELECT y, x, {rnd(RGB)} FROM lv UNION ALL SELECT y, x + {W}, {rnd(RGB)} FROM rv",
    "stereo_crossed": f"{_PAIR} SELECT y, x, {rnd(RGB)} FROM rv UNION ALL SELECT y, x + {W}, {rnd(RGB)} FROM lv",
    "mesh_obj": f"WITH {MESH}, {TRI}, fc AS ({_TRIANGLES}) "
    + " UNION ALL ".join(f"SELECT {k} AS part, (j * 8 + i)::BIGINT AS n, {_text(t, c)} AS line FROM mesh" for k, (t, c) in enumerate((("v", ["px", "py", "round(pz, 9)"]), ("vt", ["u", "v"]), ("vn", ["nx", "ny", "nz"]))))
    + " UNION ALL SELECT 3, n, 'f ' || a || '/' || a || '/' || a || ' ' || b || '/' || b || '/' || b || ' ' || c || '/' || c || '/' || c FROM fc",
    "fused_deep": f"WITH {LI}, {_detail(0, 'li', H, W)}, {_detail(1, 'd0', H // 2, W // 2)}, {_marked('d1', H // 4, W // 4)}, rs AS {PARETO}, {_added('i1', 'o1', 'rs', H // 2, W // 2)}, {_added('i0', 'o0', 'i1', H, W)} SELECT y, x, {', '.join(f'round(least(greatest({c}, 0.0), 1.0) + {HAIR}, 6) + 0.0 AS {c}' for c in RGB)} FROM i0",
}
