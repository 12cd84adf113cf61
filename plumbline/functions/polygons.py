"""Polygon measures in plain numpy-free Python, for Arrow batches: overlap areas, rotated rectangles, simplification."""

from __future__ import annotations

import math

Ring = list[tuple[float, float]]


def edges_of(parts: list[list[Ring]]) -> list[tuple[float, float, float, float]]:
    """All edges of all rings, closed, horizontal ones left out."""
    out = []
    for rings in parts:
        for r in rings:
            out += [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True) if y1 != y2]
    return out


def _at(e: tuple[float, float, float, float], y: float) -> float:
    return e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])


def overlap_area(a: list[list[Ring]], b: list[list[Ring]]) -> float:
    """The planar area that two polygons share (holes and parts by the even-odd rule).

    The plane is cut into strips at every vertex and crossing; within a strip edges don't cross, so the shared part is a
    set of trapezoids between edges in order.
    """
    ea, eb = edges_of(a), edges_of(b)
    if not ea or not eb:
        return 0.0
    ys = {y for e in ea + eb for y in (e[1], e[3])}
    lo, hi = max(min(min(e[1], e[3]) for e in s) for s in (ea, eb)), min(max(max(e[1], e[3]) for e in s) for s in (ea, eb))
    if lo >= hi:
        return 0.0
    both = ea + eb
    for i, p in enumerate(both):
        for q in both[:i]:
            y0, y1 = max(min(p[1], p[3]), min(q[1], q[3]), lo), min(max(p[1], p[3]), max(q[1], q[3]), hi)
            if y0 < y1:
                d0, d1 = _at(p, y0) - _at(q, y0), _at(p, y1) - _at(q, y1)
                if d0 * d1 < 0:
                    ys.add(y0 + (y1 - y0) * d0 / (d0 - d1))
    cuts = sorted(y for y in ys if lo <= y <= hi)
    total = 0.0
    for y0, y1 in zip(cuts, cuts[1:], strict=False):
        m = (y0 + y1) / 2
        line = sorted((_at(e, m), k, e) for k, s in ((0, ea), (1, eb)) for e in s if min(e[1], e[3]) < m < max(e[1], e[3]))
        inside = [False, False]
        for (_, k, e), nxt in zip(line, line[1:] + [None], strict=True):
            inside[k] = not inside[k]
            if all(inside) and nxt is not None:
                f = nxt[2]
                total += (_at(f, y0) - _at(e, y0) + _at(f, y1) - _at(e, y1)) / 2 * (y1 - y0)
    return total


def area(ring: Ring) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def hull(points: Ring) -> Ring:
    """The convex hull, counter-clockwise."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: Ring = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def rotated_rectangle(points: Ring) -> tuple[float, float]:
    """Sides (longer first) of the smallest rectangle about the points: one of its sides lies on a side of the hull."""
    h = hull(points)
    if len(h) < 3:
        return (max(math.dist(a, b) for a in h for b in h) if h else 0.0), 0.0
    best = (math.inf, 0.0, 0.0)
    for (x1, y1), (x2, y2) in zip(h, h[1:] + h[:1], strict=True):
        n = math.hypot(x2 - x1, y2 - y1)
        ux, uy = (x2 - x1) / n, (y2 - y1) / n
        u, v = [x * ux + y * uy for x, y in h], [y * ux - x * uy for x, y in h]
        a, b = max(u) - min(u), max(v) - min(v)
        best = min(best, (a * b, max(a, b), min(a, b)))
    return best[1], best[2]


def simplified(ring: Ring, tolerance: float) -> Ring:
    """Vertices that matter: a closed ring is cut at its first and furthest vertex, each half is halved at its furthest point."""
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    if len(pts) < 4:
        return pts
    far = max(range(len(pts)), key=lambda i: math.dist(pts[0], pts[i]))

    def walk(p: Ring) -> Ring:
        (x1, y1), (x2, y2) = p[0], p[-1]
        n = math.hypot(x2 - x1, y2 - y1) or 1.0
        off = [abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / n for x, y in p[1:-1]]
        if not off or max(off) <= tolerance:
            return [p[0], p[-1]]
        i = off.index(max(off)) + 1
        return walk(p[: i + 1])[:-1] + walk(p[i:])

    return walk(pts[: far + 1])[:-1] + walk([*pts[far:], pts[0]])[:-1]


def to_metres(ring: Ring, lon0: float, lat0: float) -> Ring:
    """Local metres about a centre (equirectangular; parcels are small)."""
    k = math.radians(1) * 6_371_008.8
    return [((x - lon0) * k * math.cos(math.radians(lat0)), (y - lat0) * k) for x, y in ring]
