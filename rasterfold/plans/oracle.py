"""The same queries in SQL, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

import math
import re

H, W, N = 24, 32, 7
LUMA = "0.299*r + 0.587*g + 0.114*b"

LI = f"""li AS (
SELECT f.i AS frame, gy.i AS y, gx.i AS x, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b
FROM range({N}) f(i), range({H}) gy(i), range({W}) gx(i)
LEFT JOIN (SELECT l_linenumber - 1 AS frame, l_suppkey % {H} AS y, l_partkey % {W} AS x, avg(l_discount) * 10 AS r, avg(l_tax) * 12.5 AS g, avg(l_quantity) / 50 AS b FROM lineitem GROUP BY ALL) c
ON c.frame = f.i AND c.y = gy.i AND c.x = gx.i)"""
GRAY = f"{LI}, gray AS (SELECT frame, y, x, {LUMA} AS v FROM li)"
EMB = "emb AS (SELECT vec_id // 10 AS stack, vec_id % 10 AS frame, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(greatest(embedding[i]::DOUBLE + 0.5, 0.0), 1.0) AS v FROM embeddings, range(1, 65) t(i))"
CAP = "cap AS (SELECT user_id AS list, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) / 1e6 AS t FROM events)"
FRAMES = "fr AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, 'shoot/' || conv_id % 7 || '/f' || turn || '.' || CASE WHEN turn % 2 = 0 THEN 'tif' ELSE 'png' END AS path FROM conversations)"


def refl(i: str, n: int) -> str:
    return f"(({n} - 1) - abs(({n} - 1) - abs({i})))"


def red(n: int) -> str:
    return f"(SELECT o, {refl('2*o + t - 2', n)} AS i, w / 16 AS w FROM range({(n + 1) // 2}) a(o), (VALUES (0, 1.0), (1, 4.0), (2, 6.0), (3, 4.0), (4, 1.0)) b(t, w))"


def exp(n: int) -> str:
    return f"(SELECT o, {refl('o // 2 + d', (n + 1) // 2)} AS i, w FROM range({n}) a(o), (VALUES (0, -1, 0.125), (0, 0, 0.75), (0, 1, 0.125), (1, 0, 0.5), (1, 1, 0.5)) b(p, d, w) WHERE o % 2 = p)"


def win(n: int, weights: list[float]) -> str:
    r = len(weights) // 2
    rows = ", ".join(f"({k - r}, {w})" for k, w in enumerate(weights))
    return f"(SELECT o, {refl('o + d', n)} AS i, w FROM range({n}) a(o), (VALUES {rows}) b(d, w))"


def sep(src: str, ty: str, tx: str, vals: list[str], keys: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"(SELECT {k}ty.o AS y, x, {', '.join(f'sum({v} * ty.w) AS {v}' for v in vals)} FROM (SELECT {k}y, tx.o AS x, {', '.join(f'sum({v} * tx.w) AS {v}' for v in vals)} FROM {src} s JOIN {tx} tx ON s.x = tx.i GROUP BY {k}y, tx.o) s JOIN {ty} ty ON s.y = ty.i GROUP BY {k}ty.o, x)"


def rnd(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def box(src: str, r: int, vals: list[str], keys: list[str]) -> str:
    """By its definition: the mean over the clipped square, as a join of each pixel with the pixels around it."""
    k = "".join(f"a.{c}, " for c in keys)
    on = " AND ".join([f"a.{c} = b.{c}" for c in keys] + [f"b.y BETWEEN a.y - {r} AND a.y + {r}", f"b.x BETWEEN a.x - {r} AND a.x + {r}"])
    return f"(SELECT {k}a.y, a.x, {', '.join(f'avg(b.{v}) AS {v}' for v in vals)} FROM {src} a JOIN {src} b ON {on} GROUP BY {k}a.y, a.x)"


def conv(src: str, taps: list[tuple[int, int, float]], keys: list[str]) -> str:
    k = "".join(f"a.{c}, " for c in keys)
    rows = ", ".join(str(t) for t in taps)
    on = " AND ".join([f"a.{c} = b.{c}" for c in keys] + [f"b.y = {refl('a.y + t.dy', H)}", f"b.x = {refl('a.x + t.dx', W)}"])
    return f"(SELECT {k}a.y, a.x, sum(b.v * t.w) AS v FROM {src} a CROSS JOIN (VALUES {rows}) t(dy, dx, w) JOIN {src} b ON {on} GROUP BY {k}a.y, a.x)"


RGB = ["r", "g", "b"]
FK = ["frame"]
LAP = f"small AS {sep('li', red(H), red(W), RGB, FK)}, up AS {sep('small', exp(H), exp(W), RGB, FK)}, lap AS (SELECT li.frame, li.y, li.x, li.r - up.r AS r, li.g - up.g AS g, li.b - up.b AS b FROM li JOIN up USING (frame, y, x))"
BIN = [0.25, 0.5, 0.25]
EN = f"{LI}, {LAP}, en0 AS (SELECT frame, y, x, ({LUMA}) * ({LUMA}) AS e FROM lap), en AS (SELECT lap.*, round(w.e, 10) AS e FROM lap JOIN {sep('en0', win(H, BIN), win(W, BIN), ['e'], FK)} w USING (frame, y, x))"
WIN = f"{EN}, won AS (SELECT y, x, frame AS winner, e, r, g, b FROM en QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY e DESC, frame) = 1)"
SHARES = f"{WIN}, det AS (SELECT winner FROM won WHERE e > 0.01 * (SELECT max(e) FROM won)), sh AS (SELECT f.i::INTEGER AS frame, count(winner) / (SELECT count(*) FROM det)::DOUBLE AS share FROM range({N}) f(i) LEFT JOIN det ON winner = f.i GROUP BY f.i)"
ONES = [1.0, 1.0, 1.0]
TOP = f"""{LI}, top AS {sep('li', red(H), red(W), RGB, FK)}, tl AS (SELECT frame, y, x, {LUMA} AS v FROM top),
nb AS (SELECT a.frame, a.y, a.x, b.v, floor(least(greatest(b.v, 0), 1) * 15 + 0.5)::INTEGER AS bin FROM tl a, range(-1, 2) p(dy), range(-1, 2) q(dx), tl b WHERE a.frame = b.frame AND b.y = {refl('a.y + dy', H // 2)} AND b.x = {refl('a.x + dx', W // 2)}),
hb AS (SELECT frame, y, x, bin, count(*) / 9.0 AS p, sum(v) AS s, sum(v * v) AS q FROM nb GROUP BY ALL),
mk AS (SELECT frame, y, x, round(greatest(sum(q) / 9.0 - (sum(s) / 9.0) * (sum(s) / 9.0), 0.0), 10) AS dev, round(-sum(p * ln(p)), 10) AS ent FROM hb GROUP BY ALL),
tm AS (SELECT * FROM top JOIN mk USING (frame, y, x))"""
PARETO = "(SELECT y, x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM tm a WHERE NOT EXISTS (SELECT 1 FROM tm o WHERE o.y = a.y AND o.x = a.x AND o.dev >= a.dev AND o.ent >= a.ent AND (o.dev > a.dev OR o.ent > a.ent)) GROUP BY y, x)"
PK = f"""{EMB}, lg AS (SELECT *, coalesce(lag(v) OVER w, -1.0) AS l, coalesce(lead(v) OVER w, -1.0) AS r FROM emb WINDOW w AS (PARTITION BY stack, y, x ORDER BY frame)),
mx AS (SELECT *, row_number() OVER (PARTITION BY stack, y, x ORDER BY v DESC, frame) AS k FROM lg WHERE v >= l AND v > r),
st AS (SELECT stack, y, x, avg(v) AS mean, min(v) AS low FROM emb GROUP BY ALL),
pk AS (SELECT st.stack, st.y, st.x, a.v AS c1, a.l, a.r, a.frame AS i1, b.v AS c2, mean, low FROM st LEFT JOIN mx a ON a.stack = st.stack AND a.y = st.y AND a.x = st.x AND a.k = 1 LEFT JOIN mx b ON b.stack = st.stack AND b.y = st.y AND b.x = st.x AND b.k = 2),
fl AS (SELECT stack, low AS floor FROM (SELECT stack, low, row_number() OVER (PARTITION BY stack ORDER BY low) - 1 AS k, count(*) OVER (PARTITION BY stack) AS n FROM pk WHERE (y * 8 + x) % 7 = 0) WHERE k = n // 2),
lo AS (SELECT *, ln(greatest(l, 1e-12)) AS ll, ln(greatest(c1, 1e-12)) AS lc, ln(greatest(r, 1e-12)) AS lr FROM pk JOIN fl USING (stack)),
dc AS (SELECT stack, y, x, i1 + CASE WHEN l >= 0 AND r >= 0 AND c1 > 0 AND ll - 2 * lc + lr < 0 THEN least(greatest(0.5 * (ll - lr) / (ll - 2 * lc + lr), -0.5), 0.5) ELSE 0.0 END AS depth,
CASE WHEN c1 > 0 THEN least(greatest(1 - mean / c1, 0.0), 1.0) * least(greatest(1 - coalesce(c2, 0.0) / c1, 0.0), 1.0) * CASE WHEN floor > 0 THEN least(greatest((c1 - floor) / (0.5 * floor), 0.0), 1.0) ELSE 1.0 END ELSE 0.0 END AS conf FROM lo)"""
SML = f"sa AS {conv('gray', [(0, 0, 2.0), (0, -1, -1.0), (0, 1, -1.0)], FK)}, sb AS {conv('gray', [(0, 0, 2.0), (-1, 0, -1.0), (1, 0, -1.0)], FK)}, sml AS (SELECT sa.frame, sa.y, sa.x, abs(sa.v) + abs(sb.v) AS v FROM sa JOIN sb USING (frame, y, x))"
SLABS = "slabs(slab, lo, hi) AS (VALUES (0, 0, 2), (1, 2, 4), (2, 4, 6))"


def _enc(c: str) -> str:
    return f"sign({c}) * CASE WHEN abs({c}) <= 0.0031308 THEN abs({c}) * 12.92 ELSE 1.055 * pow(abs({c}), 1 / 2.4) - 0.055 END"


def _dec(c: str) -> str:
    return f"sign({c}) * CASE WHEN abs({c}) <= 0.04045 THEN abs({c}) / 12.92 ELSE pow((abs({c}) + 0.055) / 1.055, 2.4) END"


def _look() -> str:
    m = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
    rows = [f"r * 1.9 * {a} + g * 1.0 * {b} + b * 1.4 * {c}" for a, b, c in m]
    return f"WITH {LI}, m AS (SELECT frame, y, x, {', '.join(f'{e} AS {c}' for e, c in zip(rows, RGB))} FROM li) SELECT frame, y, x, {', '.join(f'round({_enc(c)}, 6) + 0.0 AS {c}' for c in RGB)} FROM m"


def _q(v: str, top: int) -> str:
    return f"floor(least(greatest({v}, 0.0), 1.0) * {top} + 0.5)::INTEGER"


def _ring() -> list[tuple[int, int, float]]:
    at = [(y, x, y * y + x * x) for y in range(-3, 4) for x in range(-3, 4)]
    disk, ring = [a for a in at if a[2] <= 1], [a for a in at if 1 < a[2] <= 9]
    return [(y, x, 1 / len(disk)) for y, x, _ in disk] + [(y, x, -1 / len(ring)) for y, x, _ in ring]


def _burt(n: int) -> str:
    return f"(SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, 2*o + d AS i, w FROM range({(n + 1) // 2}) a(o), (VALUES (-2, 0.085), (-1, 0.25), (0, 0.33), (1, 0.25), (2, 0.085)) b(d, w)) WHERE i >= 0 AND i < {n})"


def _bilinear(coarse: int, n: int, k: int) -> str:
    at = f"least(greatest((o + 0.5) / {k} - 0.5, 0.0), {coarse - 1}.0)"
    return f"(SELECT o, least(floor(a)::BIGINT + d, {coarse - 1}) AS i, CASE WHEN d = 0 THEN 1 - (a - floor(a)) ELSE a - floor(a) END AS w FROM (SELECT o, {at} AS a FROM range({n}) t(o)), range(2) u(d))"


def _shrink(n: int, m: int) -> str:
    return f"(SELECT o, i, 1.0 / (b - a) AS w FROM (SELECT o, o * {n} // {m} AS a, (o + 1) * {n} // {m} AS b FROM range({m}) t(o)), range({n}) u(i) WHERE i >= a AND i < b)"


def _spline_weights(n: int, m: int) -> str:
    t = "(a - floor(a))"
    ws = [f"((-1.0/3*{t} + 4.0/5)*{t} - 7.0/15)*{t}", f"(({t} - 9.0/5)*{t} - 1.0/5)*{t} + 1", f"((6.0/5 - {t})*{t} + 4.0/5)*{t}", f"((1.0/3*{t} - 1.0/5)*{t} - 2.0/15)*{t}"]
    case = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(ws))
    return f"(SELECT o, least(greatest(floor(a)::BIGINT + d - 1, 0), {n - 1}) AS i, CASE d {case} END AS w FROM (SELECT o, (o + 0.5) * {n} / {m} - 0.5 AS a FROM range({m}) t(o)), range(4) u(d))"


def _moves() -> str:
    """The warp queries' transforms move a pixel to centre + scale * turn * (pixel - centre) + shift; its source is the way back."""
    rows = []
    for f in range(N):
        scale, rot = 1 + 0.004 * f, 0.01 * f
        rows.append(f"({f}, {math.cos(rot)!r}::DOUBLE, {math.sin(rot)!r}::DOUBLE, {scale!r}::DOUBLE, {0.01 * f * W!r}::DOUBLE, {-0.006 * f * H!r}::DOUBLE)")
    u, v = f"(x::DOUBLE - {W / 2} - dx)", f"(y::DOUBLE - {H / 2} - dy)"
    return f"mv(frame, c, s, k, dx, dy) AS (VALUES {', '.join(rows)}), src AS (SELECT frame, y, x, (c * {u} + s * {v}) / k + {W / 2} AS sx, (c * {v} - s * {u}) / k + {H / 2} AS sy FROM gray JOIN mv USING (frame)), ok AS (SELECT *, sx >= 0 AND sx <= {W - 1} AND sy >= 0 AND sy <= {H - 1} AS valid FROM src)"


def _weights(kernel: str, t: str) -> list[str]:
    if kernel == "nearest":
        return [f"(CASE WHEN {t} < 0.5 THEN 1.0 ELSE 0.0 END)", f"(CASE WHEN {t} < 0.5 THEN 0.0 ELSE 1.0 END)"]
    if kernel == "bilinear":
        return [f"(1 - {t})", t]
    if kernel == "bicubic":
        k = lambda d: f"(CASE WHEN abs({d}) < 1 THEN 1.5*pow(abs({d}), 3) - 2.5*pow(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.5*pow(abs({d}), 3) + 2.5*pow(abs({d}), 2) - 4*abs({d}) + 2 ELSE 0 END)"
        return [k(f"({t} + 1 - {i})") for i in range(4)]
    if kernel == "spline4x4":
        return [f"(((-1.0/3*{t} + 4.0/5)*{t} - 7.0/15)*{t})", f"((({t} - 9.0/5)*{t} - 1.0/5)*{t} + 1)", f"(((6.0/5 - {t})*{t} + 4.0/5)*{t})", f"(((1.0/3*{t} - 1.0/5)*{t} - 2.0/15)*{t})"]
    if kernel == "spline6x6":
        k = lambda d: f"(CASE WHEN abs({d}) < 1 THEN ((13.0/11*abs({d}) - 453.0/209)*abs({d}) - 3.0/209)*abs({d}) + 1 WHEN abs({d}) < 2 THEN ((-6.0/11*(abs({d}) - 1) + 270.0/209)*(abs({d}) - 1) - 156.0/209)*(abs({d}) - 1) WHEN abs({d}) < 3 THEN ((1.0/11*(abs({d}) - 2) - 45.0/209)*(abs({d}) - 2) + 26.0/209)*(abs({d}) - 2) ELSE 0 END)"
    else:
        k = lambda d: f"(CASE WHEN abs({d}) < 1e-12 THEN 1.0 WHEN abs({d}) < 3 THEN 3*sin(pi()*{d})*sin(pi()*{d}/3)/(pi()*{d}*pi()*{d}) ELSE 0 END)"
    ws = [k(f"({t} + 2 - {i})") for i in range(6)]
    return [f"({w} / ({' + '.join(ws)}))" for w in ws]


def _warp(kernel: str) -> str:
    n = {"nearest": 2, "bilinear": 2, "bicubic": 4, "spline4x4": 4, "spline6x6": 6, "lanczos3": 6}[kernel]

    def axis(s: str, name: str, size: int) -> str:
        at = ", ".join(f"struct_pack(i := least(greatest(floor({s})::BIGINT + {k - n // 2 + 1}, 0), {size - 1}), w := {w})" for k, w in enumerate(_weights(kernel, f"({s} - floor({s}))")))
        return f"unnest([{at}]) AS {name}"

    return f"""WITH {GRAY}, {_moves()}, tx AS (SELECT frame, y, x, sy, {axis('sx', 'a', W)} FROM ok WHERE valid), ty AS (SELECT frame, y, x, a, {axis('sy', 'b', H)} FROM tx),
got AS (SELECT ty.frame, ty.y, ty.x, sum(a.w * b.w * v) AS v FROM ty JOIN gray g ON g.frame = ty.frame AND g.x = a.i AND g.y = b.i GROUP BY ALL)
SELECT ok.frame::INTEGER AS frame, ok.y, ok.x, valid, round(coalesce(got.v, gray.v), 5) + 0.0 AS v FROM ok JOIN gray USING (frame, y, x) LEFT JOIN got USING (frame, y, x)"""


def _rgb_warp(kernel: str) -> str:
    """wr: the three values of each pixel through the warp queries' transforms, and whether its source is inside."""
    n = 2 if kernel == "bilinear" else 4

    def axis(s: str, name: str, size: int) -> str:
        at = ", ".join(f"struct_pack(i := least(greatest(floor({s})::BIGINT + {k - n // 2 + 1}, 0), {size - 1}), w := {w})" for k, w in enumerate(_weights(kernel, f"({s} - floor({s}))")))
        return f"unnest([{at}]) AS {name}"

    sums = ", ".join(f"sum(ka.w * kb.w * li.{c}) AS {c}" for c in RGB)
    return f"""{GRAY}, {_moves()}, tx AS (SELECT frame, y, x, sy, {axis('sx', 'ka', W)} FROM ok WHERE valid), ty AS (SELECT frame, y, x, ka, {axis('sy', 'kb', H)} FROM tx),
got AS (SELECT ty.frame, ty.y, ty.x, {sums} FROM ty JOIN li ON li.frame = ty.frame AND li.x = ka.i AND li.y = kb.i GROUP BY ALL),
wr AS (SELECT ok.frame::INTEGER AS frame, ok.y, ok.x, valid, {', '.join(f'coalesce(got.{c}, li.{c}) AS {c}' for c in RGB)} FROM ok JOIN li USING (frame, y, x) LEFT JOIN got USING (frame, y, x)),
pair AS (SELECT a.frame, count(*) AS n, {', '.join(f'sum(a.{c}) AS {c}, sum(z.{c}) AS z{c}' for c in RGB)} FROM wr a JOIN wr z ON z.frame = 0 AND z.y = a.y AND z.x = a.x WHERE a.valid AND a.y % 4 = 0 AND a.x % 4 = 0 GROUP BY a.frame),
ga AS (SELECT frame, {', '.join(f'CASE WHEN n < 64 OR {c} <= 0 THEN 1.0 ELSE least(greatest(z{c} / {c}, 0.25), 4.0) END AS {c}' for c in RGB)} FROM pair)"""


def _slope(src: str, axis: str, n: int, keys: str) -> str:
    """One more sample at each end of an axis: twice the last less the one before it; places go up by one."""
    ends = [(0, 0, 1), (n + 1, n - 1, n - 2)]
    more = " UNION ALL ".join(f"SELECT {keys}, {at} AS {axis}, 2 * max(CASE WHEN {axis} = {i} THEN v END) - max(CASE WHEN {axis} = {j} THEN v END) AS v FROM {src} GROUP BY {keys}" for at, i, j in ends)
    return f"(SELECT {keys}, {axis} + 1 AS {axis}, v FROM {src} UNION ALL {more})"


def _fill(small: str, r: int, eps: float) -> str:
    """co: mean a and b of the guided filter over small (frame, y, x, g, v)."""
    a = f"(mgv - mg*mv) / (mgg - mg*mg + {eps})"
    return f"mo AS (SELECT frame, y, x, g AS mg, v AS mv, g*v AS mgv, g*g AS mgg FROM {small}), mm AS {box('mo', r, ['mg', 'mv', 'mgv', 'mgg'], FK)}, ce AS (SELECT frame, y, x, {a} AS a, mv - {a} * mg AS b FROM mm), co AS {box('ce', r, ['a', 'b'], FK)}"


MESH = f"""{WIN}, z AS (SELECT y, x, winner / 6.0 AS v FROM won), cells AS {sep('z', _shrink(H, 6), _shrink(W, 8), ['v'], [])},
vt AS (SELECT x AS i, y AS j, x / 7.0 - 0.5 AS px, {(H - 1) / (W - 1)!r} * (0.5 - y / 5.0) AS py, 0.3 * (1 - least(greatest(v, 0.0), 1.0)) AS pz, x / 7.0 AS u, y / 5.0 AS v FROM cells),
df AS (SELECT a.*, r.px - l.px AS ax, r.py - l.py AS ay, r.pz - l.pz AS az, d.px - t.px AS bx, d.py - t.py AS by_, d.pz - t.pz AS bz FROM vt a JOIN vt l ON l.j = a.j AND l.i = greatest(a.i - 1, 0) JOIN vt r ON r.j = a.j AND r.i = least(a.i + 1, 7) JOIN vt t ON t.i = a.i AND t.j = greatest(a.j - 1, 0) JOIN vt d ON d.i = a.i AND d.j = least(a.j + 1, 5)),
nm AS (SELECT *, by_ * az - bz * ay AS cx, bz * ax - bx * az AS cy, bx * ay - by_ * ax AS cz FROM df),
mesh AS (SELECT i, j, px, py, pz, u, v, cx / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-12) AS nx, cy / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-12) AS ny, cz / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-12) AS nz FROM nm)"""
TRI = """tri AS (SELECT a.j * 8 + a.i AS q, abs(round(a.pz, 9) - round(d.pz, 9)) <= abs(round(b.pz, 9) - round(c.pz, 9)) AS s FROM vt a JOIN vt b ON b.i = a.i + 1 AND b.j = a.j JOIN vt c ON c.i = a.i AND c.j = a.j + 1 JOIN vt d ON d.i = a.i + 1 AND d.j = a.j + 1)"""
GAP = f"{CAP}, lg AS (SELECT *, abs(t - lag(t) OVER (PARTITION BY list ORDER BY frame)) AS d FROM cap), gp AS (SELECT *, sum(CASE WHEN d > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY frame ROWS UNBOUNDED PRECEDING) AS stack FROM lg)"
GF = f"{GRAY}, gg AS (SELECT a.frame, a.y, a.x, a.v AS p, z.v AS i FROM gray a JOIN gray z ON z.frame = 0 AND z.y = a.y AND z.x = a.x WHERE a.frame > 0), g1 AS (SELECT frame, y, x, i AS mi, p AS mp, i*p AS mip, i*i AS mii FROM gg), m1 AS {box('g1', 2, ['mi', 'mp', 'mip', 'mii'], FK)}, ab AS (SELECT frame, y, x, (mip - mi*mp) / (mii - mi*mi + 0.001) AS a, mp - (mip - mi*mp) / (mii - mi*mi + 0.001) * mi AS b FROM m1), m2 AS {box('ab', 2, ['a', 'b'], FK)}"
MEANS = f"{LI}, mean AS (SELECT frame, {', '.join(f'avg({c}) AS {c}' for c in RGB)} FROM li WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY frame)"
GAINS = f"{MEANS}, gain AS (SELECT m.frame, {', '.join(f'least(greatest(z.{c} / m.{c}, 0.25), 4.0) AS {c}' for c in RGB)} FROM mean m, mean z WHERE z.frame = 0)"
NATURAL = "regexp_extract_all(path, '([0-9]+|[^0-9]+)')"

ORACLE_SQL = {
    "raster": f"WITH {LI} SELECT frame, y, x, {rnd(RGB)} FROM li",
    "luma": f"WITH {GRAY} SELECT frame, y, x, {rnd(['v'])} FROM gray",
    "srgb_curve": f"WITH {GRAY}, s AS (SELECT frame, y, x, v * 2 - 0.5 AS v FROM gray) SELECT frame, y, x, round({_enc('v')}, 6) + 0.0 AS e, round({_dec('v')}, 6) + 0.0 AS d FROM s",
    "look_space": _look(),
    "quantise": f"WITH {GRAY}, s AS (SELECT frame, y, x, v * 1.4 - 0.2 AS v FROM gray) SELECT frame, y, x, {_q('v', 65535)} AS q16, {_q('v', 255)} AS q8, floor({_q('v', 65535)} / 257 + 0.5)::INTEGER AS d8 FROM s",
    "gray_stretch": f"WITH {GRAY} SELECT frame, y, x, floor((v - min(v) OVER (PARTITION BY frame)) / greatest(max(v) OVER (PARTITION BY frame) - min(v) OVER (PARTITION BY frame), 1e-12) * 255 + 0.5)::INTEGER AS v FROM gray",
    "turbo_map": f"WITH {GRAY}, s AS (SELECT frame, y, x, least(greatest(v, 0), 1) AS t FROM gray) SELECT frame, y, x, " + ", ".join(f"round(least(greatest({' + '.join(f'{k} * pow(t, {p})' for p, k in enumerate(row))}, 0.0), 1.0), 5) + 0.0 AS {c}" for c, row in zip(RGB, ((0.13572138, 4.6153926, -42.66032258, 132.13108234, -152.94239396, 59.28637943), (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), (0.1066733, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973)))) + " FROM s",
    "rotate_mirror": f"WITH {GRAY} SELECT frame, {rnd(['v'])}, {W - 1} - x AS y, {H - 1} - y AS x FROM gray",
    "crop": f"WITH {GRAY} SELECT frame, y - 3 AS y, x - 5 AS x, {rnd(['v'])} FROM gray WHERE x >= 5 AND x < 25 AND y >= 3 AND y < 18",
    "rect_intersect": "WITH t AS (SELECT l_partkey % 50 AS x, l_suppkey % 50 AS y, l_linenumber * 5 AS w, l_quantity::INTEGER AS h, l_partkey % 37 AS x2, l_suppkey % 41 AS y2 FROM lineitem), u AS (SELECT greatest(x, x2) AS a, greatest(y, y2) AS b, least(x + w, x2 + 12) - greatest(x, x2) AS c, least(y + h, y2 + 9) - greatest(y, y2) AS d FROM t) SELECT CASE WHEN c > 0 AND d > 0 THEN a END::BIGINT AS ix, CASE WHEN c > 0 AND d > 0 THEN b END::BIGINT AS iy, CASE WHEN c > 0 AND d > 0 THEN c END::BIGINT AS iw, CASE WHEN c > 0 AND d > 0 THEN d END::BIGINT AS ih, count(*) AS n FROM u GROUP BY ALL",
    "reduce": f"WITH {GRAY} SELECT frame, y, x, {rnd(['v'])} FROM {sep('gray', red(H), red(W), ['v'], FK)}",
    "expand": f"WITH {GRAY}, s AS {sep('gray', red(H), red(W), ['v'], FK)} SELECT frame, y, x, {rnd(['v'])} FROM {sep('s', exp(H), exp(W), ['v'], FK)}",
    "laplacian": f"WITH {LI}, {LAP} SELECT frame, y, x, {rnd(RGB)} FROM lap",
    # A pyramid loses nothing, so what comes back is what went in.
    "reconstruct": f"WITH {LI} SELECT frame, y, x, {rnd(RGB)} FROM li",
    "registration_reduce": f"WITH {GRAY} SELECT frame, y, x, {rnd(['v'])} FROM {sep('gray', _burt(H), _burt(W), ['v'], FK)}",
    "box_mean": f"WITH {GRAY} SELECT frame, y, x, {rnd(['v'])} FROM {box('gray', 2, ['v'], FK)}",
    "guided_filter": f"WITH {GF} SELECT gg.frame, gg.y, gg.x, round(a * i + b, 6) + 0.0 AS out FROM gg JOIN m2 USING (frame, y, x)",
    "ring_difference": f"WITH {GRAY} SELECT frame, y, x, round(abs(v), 6) + 0.0 AS v FROM {conv('gray', _ring(), FK)}",
    "modified_laplacian": f"WITH {GRAY}, {SML} SELECT frame, y, x, {rnd(['v'])} FROM sml",
    "block_mean": f"WITH {GRAY} SELECT frame, (y // 5)::INTEGER AS y, (x // 5)::INTEGER AS x, round(avg(v), 6) + 0.0 AS v FROM gray GROUP BY frame, y // 5, x // 5",
    "bilinear_upsample": f"WITH {GRAY}, s AS (SELECT frame, y // 4 AS y, x // 4 AS x, avg(v) AS v FROM gray GROUP BY frame, y // 4, x // 4) SELECT frame, y, x, {rnd(['v'])} FROM {sep('s', _bilinear(6, H, 4), _bilinear(8, W, 4), ['v'], FK)}",
    "nearest_upsample": f"WITH {GRAY} SELECT frame, y, x, round(avg(v) OVER (PARTITION BY frame, y // 4, x // 4), 6) + 0.0 AS v FROM gray",
    "median3": f"WITH {GRAY} SELECT a.frame, a.y, a.x, round(median(b.v), 6) + 0.0 AS v FROM gray a, range(-1, 2) p(dy), range(-1, 2) q(dx), gray b WHERE b.frame = a.frame AND b.y = {refl('a.y + dy', H)} AND b.x = {refl('a.x + dx', W)} GROUP BY a.frame, a.y, a.x",
    "area_shrink": f"WITH {GRAY} SELECT frame, y, x, {rnd(['v'])} FROM {sep('gray', _shrink(H, 7), _shrink(W, 9), ['v'], FK)}",
    "dilate_disk": f"WITH {GRAY} SELECT a.frame, a.y, a.x, round(max(b.v), 6) + 0.0 AS v FROM gray a JOIN gray b ON a.frame = b.frame AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY a.frame, a.y, a.x",
    "dilate_square": f"WITH {GRAY} SELECT a.frame, a.y, a.x, round(max(b.v), 6) + 0.0 AS v FROM gray a JOIN gray b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.frame, a.y, a.x",
    "local_contrast": f"WITH {GRAY}, m AS {box('gray', 3, ['v'], FK)} SELECT gray.frame, gray.y, gray.x, round(abs(gray.v - m.v), 6) + 0.0 AS v FROM gray JOIN m USING (frame, y, x)",
    "brightness_means": f"WITH {MEANS} SELECT frame, {rnd(RGB)} FROM mean",
    "brightness_gains": f"WITH {GAINS} SELECT frame, {rnd(RGB)} FROM gain",
    "equalised": f"WITH {GAINS} SELECT li.frame, y, x, {', '.join(f'round(li.{c} * CASE WHEN abs(gain.r - 1) < 1e-6 AND abs(gain.g - 1) < 1e-6 AND abs(gain.b - 1) < 1e-6 THEN 1 ELSE gain.{c} END, 6) + 0.0 AS {c}' for c in RGB)} FROM li JOIN gain USING (frame)",
    "region_energy": f"WITH {EN} SELECT frame, y, x, {rnd(['e'], 8)} FROM en",
    "winner_map": f"WITH {WIN} SELECT y, x, winner, {rnd(['e'], 8)} FROM won",
    "winner_shares": f"WITH {SHARES} SELECT frame, {rnd(['share'])} FROM sh",
    "share_note": f"WITH {SHARES} SELECT (SELECT frame FROM sh ORDER BY share, frame LIMIT 1) AS least, (SELECT frame FROM sh ORDER BY share DESC, frame LIMIT 1) AS most, (SELECT count(*) FROM sh WHERE share < 0.01) AS under",
    "cull_frames": f"WITH {SHARES} SELECT frame FROM sh WHERE share * 100 >= 14",
    "halo_fused": f"WITH {EN}, hw AS (SELECT *, exp(least(greatest(2.0 * ln((e + 1e-8) / 1e-4), -60.0), 60.0)) AS w FROM en) SELECT y, x, {', '.join(f'round(sum(w * {c}) / sum(w), 6) + 0.0 AS {c}' for c in RGB)} FROM hw GROUP BY y, x",
    "deviation_entropy": f"WITH {TOP} SELECT frame, y, x, {rnd(['dev', 'ent'])} FROM mk",
    "residual_pareto": f"WITH {TOP} SELECT y, x, {rnd(RGB)} FROM {PARETO}",
    "residual_deviation": f"WITH {TOP} SELECT y, x, {rnd(RGB)} FROM tm QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY dev DESC, frame) = 1",
    "residual_mean": f"WITH {TOP} SELECT y, x, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in RGB)} FROM tm GROUP BY y, x",
    "fused_image": f"WITH {WIN}, rs AS (SELECT y, x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM small GROUP BY y, x), ru AS {sep('rs', exp(H), exp(W), RGB, [])} SELECT y, x, {', '.join(f'round(least(greatest(won.{c} + ru.{c}, 0.0), 1.0), 6) + 0.0 AS {c}' for c in RGB)} FROM won JOIN ru USING (y, x)",
    "focus_peaks": f"WITH {PK} SELECT stack, y, x, {rnd(['c1', 'l', 'r'])}, i1, {rnd(['c2', 'mean', 'low'])} FROM pk",
    "noise_floor": f"WITH {PK} SELECT stack, {rnd(['floor'])} FROM fl",
    "depth_confidence": f"WITH {PK} SELECT stack, y, x, {rnd(['depth', 'conf'])} FROM dc",
    "confidence_p90": f"WITH {PK}, p9 AS (SELECT stack, conf AS p FROM (SELECT stack, conf, row_number() OVER (PARTITION BY stack ORDER BY conf) - 1 AS k, count(*) OVER (PARTITION BY stack) AS n FROM dc WHERE (y * 8 + x) % 7 = 0) WHERE k = least(n * 9 // 10, n - 1)) SELECT stack, y, x, round(CASE WHEN p > 1e-6 THEN least(conf / p, 1.0) ELSE conf END, 6) + 0.0 AS conf FROM dc JOIN p9 USING (stack)",
    "edge_weights": f"WITH {GRAY} SELECT a.frame, a.y, a.x, round(exp(-abs(b.v - a.v) / 0.1), 6) + 0.0 AS wx, round(exp(-abs(c.v - a.v) / 0.1), 6) + 0.0 AS wy FROM gray a LEFT JOIN gray b ON b.frame = a.frame AND b.y = a.y AND b.x = a.x + 1 LEFT JOIN gray c ON c.frame = a.frame AND c.x = a.x AND c.y = a.y + 1",
    "weighted_average": f"WITH {GRAY}, {SML}, w AS (SELECT frame, y, x, pow(greatest(v - 1.5 * min(v) OVER c, 0.0), 2) + pow(0.01 * min(v) OVER c, 2) + 1e-30 AS w FROM sml WINDOW c AS (PARTITION BY y, x)) SELECT y, x, {', '.join(f'round(sum(w * {c}) / sum(w), 6) + 0.0 AS {c}' for c in RGB)} FROM li JOIN w USING (frame, y, x) GROUP BY y, x",
    # A whole depth gives its own frame the only weight.
    "depth_render": f"WITH {WIN} SELECT li.y, li.x, {', '.join(f'round(li.{c}, 6) + 0.0 AS {c}' for c in RGB)} FROM li JOIN won ON won.y = li.y AND won.x = li.x AND won.winner = li.frame",
    "slab_fold": f"WITH {EN}, {SLABS} SELECT slab, y, x, frame AS winner, {rnd(['e'], 8)} FROM en JOIN slabs ON frame BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY slab, y, x ORDER BY e DESC, frame) = 1",
    "slab_render": f"WITH {WIN}, {SLABS}, sm AS (SELECT slab, any_value(lo) AS lo, any_value(hi) AS hi, y, x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM li JOIN slabs ON frame BETWEEN lo AND hi GROUP BY slab, y, x), st AS (SELECT sm.*, least(greatest(1 - greatest(lo - winner, winner - hi, 0), 0.0), 1.0) AS t FROM sm JOIN won USING (y, x)) SELECT y, x, {', '.join(f'round(sum(t * {c}) / greatest(sum(t), 1e-6), 6) + 0.0 AS {c}' for c in RGB)} FROM st GROUP BY y, x",
    "focus_peaking": f"WITH {EN}, er AS (SELECT frame, y, x, round(e, 8) AS e FROM en), tp AS (SELECT y, x, max(e) AS top FROM er GROUP BY y, x), pp AS (SELECT top AS p FROM (SELECT top, row_number() OVER (ORDER BY top) - 1 AS k, count(*) OVER () AS n FROM tp) WHERE k = least(floor(n * 0.995), n - 1)) SELECT frame, y, x, e >= 0.8 * 0.8 * top AND top > 0.02 * p AS sharp FROM er JOIN tp USING (y, x), pp",
    "depth_slice": f"WITH {PK} SELECT stack, y, x FROM dc WHERE floor(depth + 0.5) = 4",
    "frame_pick": f"WITH {WIN}, vo AS (SELECT a.y, a.x, b.winner, sum(CASE WHEN a.y = b.y AND a.x = b.x THEN 1.5 ELSE 1.0 END) AS n FROM won a JOIN won b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT y, x, winner AS frame FROM vo QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY n DESC, winner) = 1",
    "in_focus_render": f"WITH {WIN}, gr AS (SELECT y, x, {LUMA} AS v FROM li WHERE frame = 3), m AS {box('gr', 2, ['v'], [])}, k AS (SELECT won.y, won.x, 1 - 0.7 * least(greatest((abs(winner - 3) - 0.5) / 2.0, 0.0), 1.0) * (1 - least(greatest(abs(gr.v - m.v), 0.0), 1.0)) AS k FROM won JOIN gr USING (y, x) JOIN m USING (y, x)) SELECT y, x, {', '.join(f'round({c} * k, 6) + 0.0 AS {c}' for c in RGB)} FROM li JOIN k USING (y, x) WHERE frame = 3",
    **{f"warp_{k}": _warp(k) for k in ("nearest", "bilinear", "bicubic", "spline4x4", "spline6x6", "lanczos3")},
    "common_area": """WITH mv AS (SELECT vec_id // 10 AS stack, vec_id % 10 AS frame, list_transform(embedding[1:6], lambda v: v::DOUBLE) AS e FROM embeddings),
placed AS (SELECT stack, frame, gx.i AS x, gy.i AS y, (1 + 0.1 * e[1]) * gx.i + 0.1 * e[2] * gy.i + 2 * e[3] AS sx, 0.1 * e[4] * gx.i + (1 + 0.1 * e[5]) * gy.i + 2 * e[6] AS sy FROM mv, range(8) gx(i), range(8) gy(i)),
ok AS (SELECT stack, y, x FROM placed GROUP BY stack, y, x HAVING bool_and(sx BETWEEN 1 AND 6 AND sy BETWEEN 1 AND 6)),
rw AS (SELECT stack, y, min(x) AS lo, max(x) AS hi FROM ok GROUP BY stack, y),
pr AS (SELECT a.stack, a.y AS y0, b.y AS y1, max(c.lo) AS lo, min(c.hi) AS hi, count(*) AS n FROM rw a JOIN rw b ON a.stack = b.stack AND a.y <= b.y JOIN rw c ON a.stack = c.stack AND c.y BETWEEN a.y AND b.y GROUP BY a.stack, a.y, b.y),
best AS (SELECT * FROM pr WHERE n = y1 - y0 + 1 AND lo <= hi QUALIFY row_number() OVER (PARTITION BY stack ORDER BY (hi - lo + 1) * (y1 - y0 + 1) DESC, y0, y1) = 1)
SELECT stack, coalesce(lo, 0)::INTEGER AS x, coalesce(y0, 0)::INTEGER AS y, coalesce(hi - lo + 1, 8)::INTEGER AS w, coalesce(y1 - y0 + 1, 8)::INTEGER AS h FROM (SELECT DISTINCT stack FROM mv) LEFT JOIN best USING (stack)""",
    "restretch": f"WITH {GRAY}, s AS (SELECT frame, y - 2 AS y, x - 4 AS x, v FROM gray WHERE x >= 4 AND x < 28 AND y >= 2 AND y < 22) SELECT frame, y, x, {rnd(['v'])} FROM {sep('s', _spline_weights(20, H), _spline_weights(24, W), ['v'], FK)}",
    "rocking_shifts": "SELECT list, frame, round(0.03 * sin(2 * pi() * frame / count(*) OVER (PARTITION BY list)), 6) + 0.0 AS shift FROM (SELECT user_id AS list, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)",
    "heightfield": f"WITH {MESH} SELECT i, j, {rnd(['px', 'py', 'pz', 'u', 'v', 'nx', 'ny', 'nz'])} FROM mesh",
    "mesh_triangles": f"WITH {MESH}, {TRI} SELECT q AS a, q + 8 AS b, CASE WHEN s THEN q + 9 ELSE q + 1 END AS c FROM tri UNION ALL SELECT CASE WHEN s THEN q ELSE q + 1 END, CASE WHEN s THEN q + 9 ELSE q + 8 END, CASE WHEN s THEN q + 1 ELSE q + 9 END FROM tri",
    "natural_order": f"WITH {FRAMES} SELECT row_number() OVER (ORDER BY array_to_string(list_transform({NATURAL}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' || lpad(length(regexp_replace(t, '^0+(.)', '\\1'))::VARCHAR, 3, '0') || regexp_replace(t, '^0+(.)', '\\1') ELSE t END), ''), pos) - 1 AS n, path FROM fr",
    "split_gap": f"WITH {GAP} SELECT list, stack::BIGINT AS stack, count(*) AS n, min(frame) AS first FROM gp GROUP BY list, stack",
    "split_count": f"WITH {CAP} SELECT list, (frame // 4)::BIGINT AS stack, count(*) AS n FROM cap GROUP BY list, frame // 4",
    "split_dir": f"WITH {FRAMES}, f2 AS (SELECT pos, regexp_extract(path, '^(.*)/', 1) AS d FROM fr), d2 AS (SELECT d, row_number() OVER (ORDER BY min(pos)) - 1 AS stack FROM f2 GROUP BY d) SELECT pos, stack FROM f2 JOIN d2 USING (d)",
    "split_dir_runs": f"WITH {FRAMES}, f2 AS (SELECT pos, regexp_extract(path, '^(.*)/', 1) AS d FROM fr), d2 AS (SELECT pos, CASE WHEN d != lag(d) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS s FROM f2) SELECT pos, sum(s) OVER (ORDER BY pos)::BIGINT AS stack FROM d2",
    "split_info": f"WITH {GAP}, g2 AS (SELECT list, d, stack = lag(stack) OVER (PARTITION BY list ORDER BY frame) AS same FROM gp), pz AS (SELECT list, max(d) AS pause FROM g2 WHERE d IS NOT NULL GROUP BY list), md AS (SELECT list, d AS step FROM (SELECT list, d, row_number() OVER (PARTITION BY list ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY list) AS n FROM g2 WHERE same) WHERE k = n // 2) SELECT pz.list, {rnd(['pause', 'step'])} FROM pz LEFT JOIN md USING (list)",
    "reverse_frames": f"WITH {CAP} SELECT list, (count(*) OVER (PARTITION BY list) - 1 - frame)::INTEGER AS frame, {rnd(['t'])} FROM cap",
    "skip_frames": f"WITH {FRAMES} SELECT pos, path FROM fr WHERE pos NOT IN (2, 6, 7, 8, 11)",
    "path_parts": f"WITH {FRAMES} SELECT pos, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS dir, regexp_matches(path, '(?i)\\.(png|jpe?g|tiff?)$') AS image FROM fr",
    "output_names": f"WITH {FRAMES} SELECT pos, 'out/' || regexp_extract(path, '([^/]+)/[^/]*$', 1) || '_' || lpad((pos + 1)::VARCHAR, greatest(length((SELECT count(*) FROM fr)::VARCHAR), 2, length((pos + 1)::VARCHAR))::INTEGER, '0') || '_' || regexp_extract(path, '([^/]*)\\.[^./]*$', 1) || '.tif' AS a, 'out/fused_' || lpad((pos + 1)::VARCHAR, greatest(length((SELECT count(*) FROM fr)::VARCHAR), 2, length((pos + 1)::VARCHAR))::INTEGER, '0') || '.tif' AS b FROM fr",
    "clock_caption": "WITH f AS (SELECT user_id AS list, min(ts) AS ts FROM events GROUP BY user_id) SELECT list, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' n=' || list || ' of 7' AS caption FROM f",
    "exif_time": "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN round(epoch(date_trunc('second', ts)) + CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END, 3) + 0.0 END AS t FROM events",
    "near_end": "WITH e AS (SELECT user_id AS list, event_id, value FROM events WHERE event_id % 3 > 0 AND value IS NOT NULL) SELECT list, CASE WHEN arg_min(value, event_id) < arg_max(value, event_id) THEN true WHEN arg_min(value, event_id) > arg_max(value, event_id) THEN false END AS near_first FROM e GROUP BY list",
    "nice_lengths": "WITH v AS (SELECT p_partkey, p_retailprice * pow(10.0, p_partkey % 7 - 3) AS v FROM part), c AS (SELECT p_partkey, v, m * pow(10.0, floor(log10(v))) AS k, m FROM v, (VALUES (1.0), (2.0), (5.0), (10.0)) t(m)) SELECT p_partkey, round(arg_min(k, round(abs(log10(k) - log10(v)), 12)), 6) + 0.0 AS near, round(max(k) FILTER (WHERE k <= v * (1 + 1e-9)), 6) + 0.0 AS floor FROM c GROUP BY p_partkey",
    "unit_lengths": "SELECT p_partkey, round(p_size / 4 * CASE p_partkey % 7 WHEN 0 THEN 1000.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.001 WHEN 3 THEN 1.0 WHEN 4 THEN 25400.0 WHEN 6 THEN 10000.0 END, 6) + 0.0 AS um FROM part",
}

# The tables hold short decimals, so results often lie halfway between two roundings; both engines round a hair above that.
GUIDE = f"{GRAY}, gd AS (SELECT y, x, avg(v) AS g FROM gray GROUP BY y, x)"
ORACLE_SQL |= {
    "expand_linear": f"WITH {GRAY}, s AS {sep('gray', red(H), red(W), ['v'], FK)}, px AS {_slope('s', 'x', W // 2, 'frame, y')}, py AS {_slope('px', 'y', H // 2, 'frame, x')}, big AS {sep('py', exp(H + 4), exp(W + 4), ['v'], FK)} SELECT frame, y - 2 AS y, x - 2 AS x, {rnd(['v'])} FROM big WHERE y BETWEEN 2 AND {H + 1} AND x BETWEEN 2 AND {W + 1}",
    "draft_reduce": f"WITH {LI} SELECT frame, y // 8 AS y, x // 8 AS x, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in RGB)} FROM li GROUP BY frame, y // 8, x // 8",
    "focus_volume": f"WITH {GUIDE}, fm AS {conv('gray', _ring(), FK)}, sl AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(abs(v)) AS v FROM fm GROUP BY frame, y // 2, x // 2), gs AS (SELECT y // 2 AS y, x // 2 AS x, avg(g) AS g FROM gd GROUP BY y // 2, x // 2), sg AS (SELECT frame, y, x, g, v FROM sl JOIN gs USING (y, x)), {_fill('sg', 2, 1e-3)} SELECT frame, y, x, round(greatest(a * g + b, 0.0), 5) + 0.0 AS v FROM sg JOIN co USING (frame, y, x)",
    "guided_upsample": f"WITH {GUIDE}, sg AS (SELECT frame, y // 4 AS y, x // 4 AS x, avg(g) AS g, avg(v) AS v FROM gray JOIN gd USING (y, x) GROUP BY frame, y // 4, x // 4), {_fill('sg', 1, 0.01)}, up AS {sep('co', _bilinear(6, H, 4), _bilinear(8, W, 4), ['a', 'b'], FK)} SELECT frame, y, x, round(a * g + b, 5) + 0.0 AS v FROM up JOIN gd USING (y, x)",
    "aligned_gains": f"WITH {_rgb_warp('bilinear')} SELECT frame, {rnd(RGB, 5)} FROM ga",
    "aligned_frames": f"WITH {_rgb_warp('bilinear')} SELECT frame, wr.y - 2 AS y, wr.x - 3 AS x, {', '.join(f'round(wr.{c} * CASE WHEN abs(ga.r - 1) < 1e-6 AND abs(ga.g - 1) < 1e-6 AND abs(ga.b - 1) < 1e-6 THEN 1 ELSE ga.{c} END, 5) + 0.0 AS {c}' for c in RGB)} FROM wr JOIN ga USING (frame) WHERE wr.x >= 3 AND wr.x < 27 AND wr.y >= 2 AND wr.y < 20",
}
ORACLE_SQL = {k: re.sub(r", ([3568])\) \+ 0\.0", r" + 2.7e-10, \1) + 0.0", v) for k, v in ORACLE_SQL.items()}
