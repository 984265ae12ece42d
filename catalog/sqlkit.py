"""SQL text shared by several checks."""

from __future__ import annotations

from surfpop.functions import color as col


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes)


def linear(v: str) -> str:
    return f"(case when {v} <= {col.SRGB_BREAK}e0 then {v} / 12.92e0 else power(({v} + 0.055e0) / 1.055e0, 2.4e0) end)"


def encoded(v: str) -> str:
    c = f"greatest(0e0, least(1e0, {v}))"
    return f"(case when {c} <= {col.LINEAR_BREAK}e0 then {c} * 12.92e0 else 1.055e0 * power({c}, 1e0 / 2.4e0) - 0.055e0 end)"


def _num(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def lab_cte(src: str, dst: str, r="r", g="g", b="b") -> str:
    """dst = src plus lab_l, lab_a, lab_b."""
    def f(row, white):
        t = "(" + " + ".join(f"{_num(m)} * l{k}" for m, k in zip(row, "rgb")) + f") / {_num(white)}"
        return f"(case when {t} > 0.008856e0 then cbrt({t}) else 7.787e0 * ({t}) + 16e0 / 116e0 end)"

    fs = [f(row, w) for row, w in zip(col.RGB_TO_XYZ, col.WHITE)]
    return f"""
{dst}_lin as (select *, {linear(r)} as lr, {linear(g)} as lg, {linear(b)} as lb from {src}),
{dst}_f as (select *, {fs[0]} as fx, {fs[1]} as fy, {fs[2]} as fz from {dst}_lin),
{dst} as (select * exclude (lr, lg, lb, fx, fy, fz), 116e0 * fy - 16e0 as lab_l, 500e0 * (fx - fy) as lab_a, 200e0 * (fy - fz) as lab_b from {dst}_f)"""


def rgb_cte(src: str, dst: str) -> str:
    """dst = src plus dr, dg, db from lab_l, lab_a, lab_b."""
    def back(t, white):
        return f"(case when {t} > 0.2068966e0 then power({t}, 3) else ({t} - 16e0 / 116e0) / 7.787e0 end * {_num(white)})"

    rows = ["(" + " + ".join(f"{_num(m)} * {k}" for m, k in zip(row, ("vx", "vy", "vz"))) + ")" for row in col.XYZ_TO_RGB]
    return f"""
{dst}_t as (select *, lab_a / 500e0 + (lab_l + 16e0) / 116e0 as tx, (lab_l + 16e0) / 116e0 as ty,
  greatest((lab_l + 16e0) / 116e0 - lab_b / 200e0, 0e0) as tz from {src}),
{dst}_v as (select *, {back('tx', col.WHITE[0])} as vx, {back('ty', col.WHITE[1])} as vy, {back('tz', col.WHITE[2])} as vz from {dst}_t),
{dst} as (select * exclude (tx, ty, tz, vx, vy, vz), {encoded(rows[0])} as dr, {encoded(rows[1])} as dg, {encoded(rows[2])} as db from {dst}_v)"""


def moments_cte(src: str, dst: str) -> str:
    """Per-specimen moments of src(specimen_id, valid, lab_*)."""
    c = "sqrt(lab_a * lab_a + lab_b * lab_b)"
    return f"""
{dst} as (select specimen_id, count(*) as n, avg(lab_l) as mean_l, stddev_pop(lab_l) as std_l, avg({c}) as mean_c, stddev_pop({c}) as std_c
  from {src} where valid group by 1),
{dst}_pool as (select avg(lab_l) as pl, stddev_pop(lab_l) as pls, avg({c}) as pc, stddev_pop({c}) as pcs, count(*) as pn from {src} where valid)"""


def normalized_cte(src: str, dst: str, moments: str) -> str:
    """dst = src with matched lab columns, placeholders 0 on invalid rows."""
    gl = "(case when m.std_l > 1e-12 then p.pls / m.std_l else 0e0 end)"
    gc = "(case when m.std_c > 1e-12 then p.pcs / m.std_c else 0e0 end)"
    c = "sqrt(s.lab_a * s.lab_a + s.lab_b * s.lab_b)"
    ratio = f"(case when {c} > 0.01e0 then greatest(({c} - m.mean_c) * {gc} + p.pc, 0e0) / {c} else 0e0 end)"
    return f"""
{dst} as (select s.specimen_id, s.sample_id, s.valid,
  case when s.valid then greatest(0e0, least(100e0, (s.lab_l - m.mean_l) * {gl} + p.pl)) else 0e0 end as lab_l,
  case when s.valid then s.lab_a * {ratio} else 0e0 end as lab_a, case when s.valid then s.lab_b * {ratio} else 0e0 end as lab_b
  from {src} s join {moments} m using (specimen_id), {moments}_pool p)"""


def dot(p, q):
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(p, q)) + ")"


def vec(prefix, alias=""):
    return [f'{alias}"{prefix}{n}"' for n in "xyz"]


def minus(p, q):
    return [f"({a} - {b})" for a, b in zip(p, q)]


def closest_cte(src: str, dst: str) -> str:
    """dst = src(qx.., ax..cz) plus d2, the squared distance of q to the triangle."""
    q, a, b, c = vec("q"), vec("a"), vec("b"), vec("c")
    ab, ac = minus(b, a), minus(c, a)
    ds = [dot(ab, minus(q, a)), dot(ac, minus(q, a)), dot(ab, minus(q, b)), dot(ac, minus(q, b)), dot(ab, minus(q, c)), dot(ac, minus(q, c))]
    wb = """case when d1 <= 0 and d2 <= 0 then 0e0 when d3 >= 0 and d4 <= d3 then 1e0
      when vc <= 0 and d1 >= 0 and d3 <= 0 then coalesce(d1 / nullif(d1 - d3, 0), 0e0) when d6 >= 0 and d5 <= d6 then 0e0
      when vb <= 0 and d2 >= 0 and d6 <= 0 then 0e0
      when va <= 0 and d4 - d3 >= 0 and d5 - d6 >= 0 then 1e0 - coalesce((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0), 0e0)
      else coalesce(vb / nullif(va + vb + vc, 0), 0e0) end"""
    wc = """case when d1 <= 0 and d2 <= 0 then 0e0 when d3 >= 0 and d4 <= d3 then 0e0
      when vc <= 0 and d1 >= 0 and d3 <= 0 then 0e0 when d6 >= 0 and d5 <= d6 then 1e0
      when vb <= 0 and d2 >= 0 and d6 <= 0 then coalesce(d2 / nullif(d2 - d6, 0), 0e0)
      when va <= 0 and d4 - d3 >= 0 and d5 - d6 >= 0 then coalesce((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0), 0e0)
      else coalesce(vc / nullif(va + vb + vc, 0), 0e0) end"""
    point = [f'("a{n}" + ("b{n}" - "a{n}") * wb + ("c{n}" - "a{n}") * wc - "q{n}")' for n in "xyz"]
    return f"""
{dst}_d as (select *, {', '.join(f'{d} as d{i + 1}' for i, d in enumerate(ds))} from {src}),
{dst}_v as (select *, d1 * d4 - d3 * d2 as vc, d5 * d2 - d1 * d6 as vb, d3 * d6 - d5 * d4 as va from {dst}_d),
{dst}_w as (select *, {wb} as wb, {wc} as wc from {dst}_v),
{dst} as (select * exclude (d1, d2, d3, d4, d5, d6, va, vb, vc, wb, wc), {dot(point, point)} as d2 from {dst}_w)"""


ADJACENCY_CTE = """
fx_sides as (select mesh_id, face_id, least(p, q) as lo, greatest(p, q) as hi from (
  select mesh_id, face_id, unnest([a, b, c]) as p, unnest([b, c, a]) as q from fx_faces)),
fx_adj as (select distinct s.mesh_id, s.face_id, t.face_id as nbr_id from fx_sides s join fx_sides t using (mesh_id, lo, hi)
  where s.face_id <> t.face_id)"""

AREA2 = "sqrt(power((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2) + power((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2) + power((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2))".replace("by_", '"by"')

MEASURES_CTE = f"""
fx_measures as (select mesh_id, face_id, {AREA2} / 2e0 as area, {AREA2} as area2,
  (ax + bx + cx) / 3e0 as mx, (ay + "by" + cy) / 3e0 as my, (az + bz + cz) / 3e0 as mz from fx_tri)"""
