"""Three-vector and triangle arithmetic as columns; ``sub``, ``add``, ``scale``, ``dot`` and ``cross`` take arrays too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # spacing of float64 at 1

Vec = tuple  # three columns


def vec(prefix: str, names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lps_to_ras(x: Column, y: Column, z: Column) -> Vec:
    return -x, -y, z


def triangle_area2(a: Vec, b: Vec, c: Vec) -> Column:
    """Twice the area."""
    return norm(cross(sub(b, a), sub(c, a)))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal; a collapsed triangle gets +Z."""
    n = cross(sub(b, a), sub(c, a))
    d = dot(n, n)
    ok = d > 1e-35
    size = F.sqrt(d)
    return tuple(F.when(ok, v / size).otherwise(F.lit(fallback)) for v, fallback in zip(n, (0.0, 0.0, 1.0)))


def similarity_transform(p: Vec, r: Column, t: Column, s: Column) -> Vec:
    """s * p * R + t with R row-major in a 9-element array."""
    return tuple(
        s * (p[0] * r[k] + p[1] * r[3 + k] + p[2] * r[6 + k]) + t[k] for k in range(3)
    )


def barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column, Column]:
    """(w0, w1, w2, usable): clipped weights that sum to 1; usable is false on slivers."""
    e1, e2, q = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11 = dot(e1, e1), dot(e1, e2), dot(e2, e2)
    d20, d21 = dot(q, e1), dot(q, e2)
    det = d00 * d11 - d01 * d01
    usable = det > d00 * d11 * EPS
    safe = F.when(usable, det)
    w1 = (d11 * d20 - d01 * d21) / safe
    w2 = (d00 * d21 - d01 * d20) / safe
    raw = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)) for w in (1.0 - w1 - w2, w1, w2)]
    total = raw[0] + raw[1] + raw[2]
    return raw[0] / total, raw[1] / total, raw[2] / total, usable


def closest_on_triangle(p, a, b, c) -> list[np.ndarray]:
    """The point of a triangle nearest to p, edges and corners included, for arrays of points and triangles.

    The seven Voronoi regions of the triangle decide.
    """
    ab, ac = sub(b, a), sub(c, a)
    ap, bp, cp = sub(p, a), sub(p, b), sub(p, c)
    d1, d2, d3, d4, d5, d6 = dot(ab, ap), dot(ac, ap), dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    k = np.select([
        (d1 <= 0.0) & (d2 <= 0.0), (d3 >= 0.0) & (d4 <= d3), (vc <= 0.0) & (d1 >= 0.0) & (d3 <= 0.0), (d6 >= 0.0) & (d5 <= d6),
        (vb <= 0.0) & (d2 >= 0.0) & (d6 <= 0.0), (va <= 0.0) & (d4 - d3 >= 0.0) & (d5 - d6 >= 0.0)], range(1, 7), 7)

    def ratio(top, bottom):
        return np.divide(top, bottom, out=np.zeros_like(top), where=bottom != 0.0)

    t_bc = ratio(d4 - d3, (d4 - d3) + (d5 - d6))
    wb = np.select([k == 2, k == 3, k == 6, k == 7], [1.0, ratio(d1, d1 - d3), 1.0 - t_bc, ratio(vb, va + vb + vc)], 0.0)
    wc = np.select([k == 4, k == 5, k == 6, k == 7], [1.0, ratio(d2, d2 - d6), t_bc, ratio(vc, va + vb + vc)], 0.0)
    return [a[i] + ab[i] * wb + ac[i] * wc for i in range(3)]


def segment_distance(p: tuple, a: tuple, b: tuple) -> Column:
    """Distance to a segment; works in 2-D and 3-D. A zero-length segment is its end point."""
    e, q = sub(b, a), sub(p, a)
    length2 = dot(e, e)
    t = F.when(length2 != 0.0, dot(q, e) / length2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return norm(sub(q, scale(e, t)))


def image_position(u: Column, v: Column, width, height) -> tuple[Column, Column]:
    """Continuous pixel-centre position, v upward and rows downward, clamped to the image."""
    x = F.greatest(F.lit(0.0), F.least(width - F.lit(1.0), u * width - 0.5))
    y = F.greatest(F.lit(0.0), F.least(height - F.lit(1.0), (1.0 - v) * height - 0.5))
    return x, y


def repeat_taps(u: Column, v: Column, width: int, height: int) -> Column:
    """Four wrapped taps as structs (px, py, w); rows count from the top."""
    x, y = u * float(width) - 0.5, v * float(height) - 0.5
    x0, y0 = F.floor(x), F.floor(y)
    tx, ty = x - x0, y - y0

    def tap(dx, dy, w):
        return F.struct(
            F.pmod(x0 + dx, F.lit(width)).cast("bigint").alias("px"),
            (F.lit(height - 1) - F.pmod(y0 + dy, F.lit(height))).cast("bigint").alias("py"),
            w.alias("w"),
        )

    return F.array(
        tap(0, 0, (1.0 - ty) * (1.0 - tx)), tap(1, 0, (1.0 - ty) * tx),
        tap(0, 1, ty * (1.0 - tx)), tap(1, 1, ty * tx),
    )
