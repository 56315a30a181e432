"""Planar geometry as Column expressions. Lines are arrays of points, polygons arrays of rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(line: Column) -> Column:
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by"))))


def line_length(line: Column) -> Column:
    return F.coalesce(F.aggregate(_segments(line), F.lit(0.0), lambda s, g: s + F.hypot(g.bx - g.ax, g.by - g.ay)), F.lit(0.0))


def halfway(line: Column) -> Column:
    """The point at half the length of a line, as struct(x, y)."""
    half = line_length(line) / 2
    first = F.element_at(line, 1)
    start = F.struct(F.lit(0.0).alias("run"), first.x.alias("x"), first.y.alias("y"))

    def step(s: Column, g: Column) -> Column:
        d = F.hypot(g.bx - g.ax, g.by - g.ay)
        f = F.when(d > 0, (half - s.run) / d).otherwise(F.lit(0.0))
        inside = (s.run <= half) & (half <= s.run + d)
        return F.struct((s.run + d).alias("run"), F.when(inside, g.ax + f * (g.bx - g.ax)).otherwise(s.x).alias("x"), F.when(inside, g.ay + f * (g.by - g.ay)).otherwise(s.y).alias("y"))

    return F.aggregate(_segments(line), start, step, lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))


def centroid(rings: Column) -> Column:
    """The area centroid as struct(x, y); rings in the other direction are holes."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def edge(s: Column, g: Column) -> Column:
        c = g.ax * g.by - g.bx * g.ay
        return F.struct((s.a + c).alias("a"), (s.x + (g.ax + g.bx) * c).alias("x"), (s.y + (g.ay + g.by) * c).alias("y"))

    return F.aggregate(rings, zero, lambda s, r: F.aggregate(_segments(r), s, edge), lambda s: F.struct((s.x / (3 * s.a)).alias("x"), (s.y / (3 * s.a)).alias("y")))


def _on_segment(x: Column, y: Column, g: Column) -> Column:
    cross = (g.bx - g.ax) * (y - g.ay) - (g.by - g.ay) * (x - g.ax)
    return (cross == 0) & x.between(F.least(g.ax, g.bx), F.greatest(g.ax, g.bx)) & y.between(F.least(g.ay, g.by), F.greatest(g.ay, g.by))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed polygon: on its border, or inside by the even-odd rule."""

    def crosses(g: Column) -> Column:
        spans = (g.ay > y) != (g.by > y)
        return F.when(spans, x < (g.bx - g.ax) * (y - g.ay) / (g.by - g.ay) + g.ax).otherwise(F.lit(False))

    border = F.exists(rings, lambda r: F.exists(_segments(r), lambda g: _on_segment(x, y, g)))
    count = F.aggregate(rings, F.lit(0), lambda s, r: s + F.size(F.filter(_segments(r), crosses)))
    return border | (count % 2 == 1)


def rings_touch(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common: a corner in the other, or crossing edges."""

    def turn(ox, oy, px, py, qx, qy):
        return F.signum((px - ox) * (qy - oy) - (py - oy) * (qx - ox))

    def cross(g: Column, h: Column) -> Column:
        return (turn(g.ax, g.ay, g.bx, g.by, h.ax, h.ay) * turn(g.ax, g.ay, g.bx, g.by, h.bx, h.by) < 0) & (turn(h.ax, h.ay, h.bx, h.by, g.ax, g.ay) * turn(h.ax, h.ay, h.bx, h.by, g.bx, g.by) < 0)

    corner = lambda p, q: F.exists(p, lambda r: F.exists(r, lambda v: contains(q, v.x, v.y)))
    edges = F.exists(a, lambda r: F.exists(_segments(r), lambda g: F.exists(b, lambda s: F.exists(_segments(s), lambda h: cross(g, h)))))
    return corner(a, b) | corner(b, a) | edges


def bounds(rings: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda v: v.x), F.transform(pts, lambda v: v.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def albers(lon: Column, lat: Column) -> Column:
    """Geographic degrees (NAD83) to the conterminous Albers equal-area plane (EPSG:5070), struct(x, y) in metres."""
    # Fixed values of the GRS 1980 ellipsoid and the projection.
    a, f = 6378137.0, 1 / 298.257222101
    lat1, lat2, lat0, lon0 = (math.radians(v) for v in (29.5, 45.5, 23.0, -96.0))
    e = math.sqrt(f * (2 - f))

    def q_of(s: float) -> float:
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    m1, m2 = (math.cos(v) / math.sqrt(1 - (e * math.sin(v)) ** 2) for v in (lat1, lat2))
    q0, q1, q2 = (q_of(math.sin(v)) for v in (lat0, lat1, lat2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = a * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - F.pow(e * s, F.lit(2))) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(F.lit(c) - n * q) / n
    theta = n * (F.radians(lon) - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def project_line(line: Column) -> Column:
    return F.transform(line, lambda v: albers(v.x, v.y))


def project_rings(rings: Column) -> Column:
    return F.transform(rings, project_line)


def close_to(value: Column, target: float) -> Column:
    """Equality up to 1e-8 and a relative 1e-5."""
    return F.abs(value - F.lit(target)) <= 1e-8 + 1e-5 * abs(target)


def md5_bits(text: Column) -> Column:
    """52 bits of a string's MD5 as a bigint, the same on every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
