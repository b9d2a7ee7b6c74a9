"""Geometry on coordinate arrays (survey rows G1-G19).

A line or ring is array<struct<x: double, y: double>>. What aggregates over
arrays can say stays in the JVM; clipping, polygon overlap and line surgery are
vectorised or per-pair numpy helpers that run on candidate pairs only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
#: Fixed values of WGS84 and of UTM.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0
CLIP_AT_ONCE = 1 << 19  # segments times sides


def point(x, y) -> Column:
    x, y = (F.lit(v) if not isinstance(v, Column) else v for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """G2."""
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def _segments(points: Column) -> Column:
    """array<struct<a, b>> of consecutive points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _length(s: Column) -> Column:
    return distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])


def running_lengths(segments: Column) -> Column:
    """How far along the line each of its segments begins."""
    step = lambda acc, s: F.struct((acc["at"] + _length(s)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(segments, F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out")), step, lambda a: a["out"])


def line_length(points: Column) -> Column:
    """Planar length; two points, as most pieces have, need no walk."""
    a, b = F.get(points, 0), F.get(points, 1)
    walk = F.aggregate(_segments(points), F.lit(0.0), lambda t, s: t + _length(s))
    return F.when(F.size(points) == 2, distance(a["x"], a["y"], b["x"], b["y"])).otherwise(walk)


def bounds(points: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def geodesic_km(lon0: np.ndarray, lat0: np.ndarray, lon1: np.ndarray, lat1: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Inverse geodesic distance on WGS84 by Vincenty's iteration, in km."""
    b = WGS84_A * (1 - WGS84_F)
    u0, u1 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(v))) for v in (lat0, lat1))
    span = np.radians(lon1 - lon0)
    lam = span.copy()
    for _ in range(rounds):
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(np.cos(u1) * sin_lam, np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * cos_lam)
        cos_s = np.sin(u0) * np.sin(u1) + np.cos(u0) * np.cos(u1) * cos_lam
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s > 0, np.cos(u0) * np.cos(u1) * sin_lam / np.where(sin_s > 0, sin_s, 1), 0)
        cos2_a = 1 - sin_a**2
        cos_m = np.where(cos2_a > 0, cos_s - 2 * np.sin(u0) * np.sin(u1) / np.where(cos2_a > 0, cos2_a, 1), 0)
        c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
        new = span + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
        done = np.max(np.abs(new - lam), initial=0) < 1e-12
        lam = new
        if done:
            break
    e2 = cos2_a * (WGS84_A**2 - b**2) / b**2
    big = 1 + e2 / 16384 * (4096 + e2 * (-768 + e2 * (320 - 175 * e2)))
    small = e2 / 1024 * (256 + e2 * (-128 + e2 * (74 - 47 * e2)))
    part = small * sin_s * (cos_m + small / 4 * (cos_s * (2 * cos_m**2 - 1) - small / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
    return b * big * (sigma - part) / 1000


@F.pandas_udf(T.DoubleType())
def geodesic_length_km(points: pd.Series) -> pd.Series:
    """G1: geodesic length of lon/lat lines, all segments of a batch at once."""
    n = points.map(lambda p: 0 if p is None else max(0, len(p) - 1)).to_numpy()
    starts, ends = [], []
    for p in points:
        if p is not None and len(p) > 1:
            xy = np.array([(q["x"], q["y"]) for q in p])
            starts.append(xy[:-1])
            ends.append(xy[1:])
    if not starts:
        return pd.Series(np.zeros(len(points)))
    a, b = np.concatenate(starts), np.concatenate(ends)
    km = geodesic_km(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    return pd.Series(np.bincount(np.repeat(np.arange(len(points)), n), km, len(points)))


def haversine_km(points: Column, radius: float = 6371.0088) -> Column:
    """G1 on a sphere, without leaving the JVM."""

    def arc(s):
        p, q = F.radians(s["a"]["y"]), F.radians(s["b"]["y"])
        h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(s["b"]["x"] - s["a"]["x"]) / 2), 2)
        return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    return F.aggregate(_segments(points), F.lit(0.0), lambda t, s: t + arc(s))


def project(points: Column, x: Column, y: Column) -> Column:
    """struct(distance, along, x, y): the line's point nearest to (x, y), and how far along the line it is."""

    def step(acc, s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / n))).otherwise(0.0)
        px, py = s["a"]["x"] + t * dx, s["a"]["y"] + t * dy
        here = F.struct(distance(px, py, x, y).alias("distance"), (acc["at"] + t * F.sqrt(n)).alias("along"), px.alias("x"), py.alias("y"))
        return F.struct((acc["at"] + F.sqrt(n)).alias("at"), F.when(acc["best"]["distance"] <= here["distance"], acc["best"]).otherwise(here).alias("best"))

    first = points[0]
    start = F.struct(F.lit(0.0).alias("at"), F.struct(distance(first["x"], first["y"], x, y).alias("distance"), F.lit(0.0).alias("along"), first["x"].alias("x"), first["y"].alias("y")).alias("best"))
    return F.aggregate(_segments(points), start, step, lambda a: a["best"])


def interpolate(points: Column, along: Column) -> Column:
    """The point at a distance along the line, clamped to its ends."""

    def step(acc, s):
        n = _length(s)
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (along - acc["at"]) / n))).otherwise(0.0)
        here = point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
        return F.struct((acc["at"] + n).alias("at"), F.when(along >= acc["at"], here).otherwise(acc["p"]).alias("p"))

    return F.aggregate(_segments(points), F.struct(F.lit(0.0).alias("at"), point(points[0]["x"], points[0]["y"]).alias("p")), step, lambda a: a["p"])


def endpoints(points: Column) -> Column:
    """Array of the two end points."""
    return F.array(F.element_at(points, 1), F.element_at(points, -1))


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part of a multi-part line, other columns copied."""
    return df.select(*(c for c in df.columns if c != parts), F.posexplode(parts).alias("part", "points"))


def rounded(points: Column, places: int) -> Column:
    """G6."""
    return F.transform(points, lambda p: point(F.round(p["x"], places), F.round(p["y"], places)))


def drop_same_geometry(df: DataFrame, points: str, id_col: str) -> DataFrame:
    """One row for each distinct coordinate array, the one with the smallest id."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(points).orderBy(id_col))).where("_k = 1").drop("_k")


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def _rows(xy: np.ndarray) -> list[dict]:
    return [{"x": float(a), "y": float(b)} for a, b in xy]


def cut_at(xy: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """The pieces of a line cut at distances along it."""
    at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
    stops = np.unique(stops[(stops > 1e-9) & (stops < at[-1] - 1e-9)])
    new = np.column_stack([np.interp(stops, at, xy[:, k]) for k in (0, 1)]) if len(stops) else np.empty((0, 2))
    edges, pieces = np.concatenate([[0.0], stops, [at[-1]]]), []
    ends = np.vstack([xy[:1], new, xy[-1:]])
    for i in range(len(edges) - 1):
        inner = xy[(at > edges[i] + 1e-9) & (at < edges[i + 1] - 1e-9)]
        pieces.append(np.vstack([ends[i : i + 1], inner, ends[i + 1 : i + 2]]))
    return pieces


@F.pandas_udf(T.ArrayType(LINE))
def split_line(points: pd.Series, stops: pd.Series) -> pd.Series:
    """The pieces of a line between the given distances along it; null for a null line."""
    return pd.Series([None if p is None else [_rows(q) for q in cut_at(_xy(p), np.asarray(s if s is not None else [], float))] for p, s in zip(points, stops, strict=True)])


def add_vertex(points: Column, x: Column, y: Column) -> Column:
    """The line with its point nearest to (x, y) as a further vertex."""
    near = project(points, x, y)

    def step(acc, s):
        n = _length(s)
        inside = (near["along"] > acc["at"]) & (near["along"] < acc["at"] + n)
        more = F.when(inside, F.array(point(near["x"], near["y"]), s["b"])).otherwise(F.array(s["b"]))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(_segments(points), F.struct(F.lit(0.0).alias("at"), F.slice(points, 1, 1).alias("out")), step, lambda a: a["out"])


def merge_chain(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Parts that touch at their ends, in chains as long as two ends meet; rings stay as they are."""
    lines = [p for p in parts if len(p) > 1]
    merged = True
    while merged:
        merged = False
        ends: dict[tuple, list[int]] = {}
        for i, p in enumerate(lines):
            if tuple(p[0]) != tuple(p[-1]):
                for e in (tuple(p[0]), tuple(p[-1])):
                    ends.setdefault(e, []).append(i)
        for e, at in ends.items():
            if len(at) == 2 and at[0] != at[1]:
                a, b = lines[at[0]], lines[at[1]]
                a = a if tuple(a[-1]) == e else a[::-1]
                b = b if tuple(b[0]) == e else b[::-1]
                lines = [p for i, p in enumerate(lines) if i not in at] + [np.vstack([a, b[1:]])]
                merged = True
                break
    return lines


@F.pandas_udf(T.ArrayType(LINE))
def merge_parts(parts: pd.Series) -> pd.Series:
    """Touching parts of a multi-part line as one; null for null, and null parts are none."""
    return pd.Series([None if m is None else [_rows(q) for q in merge_chain([_xy(p) for p in m if p is not None])] for m in parts])


def in_polygon(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is in the (closed) ring or on its border; sides that polygon() adds are no border."""

    def step(acc, s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        corner = ((x == ax) & (y == ay)) | ((x == bx) & (y == by))
        side = (cross == 0) & ~corner & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        hit = ((ay > y) != (by > y)) & (cross != 0) & ((cross > 0) == (by > ay))
        # A side that is gone over twice counts as none, in crossings and as border.
        return F.struct((acc["odd"] != hit).alias("odd"), (acc["side"] != side).alias("side"), (acc["corner"] | corner).alias("corner"))

    start = F.struct(*(F.lit(False).alias(c) for c in ("odd", "side", "corner")))
    return F.aggregate(_segments(ring), start, step, lambda a: a["odd"] | a["side"] | a["corner"])


def _flat(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all lines of a column, and where each line begins; null lines have none."""
    xy = points.flatten()
    both = np.column_stack([xy.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]) if len(xy) else np.empty((0, 2))
    return both, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sides(xy: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: the line, the first and the last point of each segment."""
    n = np.maximum(np.diff(start) - 1, 0)
    line = np.repeat(np.arange(len(n)), n)
    at = start[:-1][line] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    return line, xy[at], xy[at + 1]


def _met(a: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of sorted group numbers a[i] == b[j]."""
    n = np.bincount(b, minlength=groups)
    first = np.cumsum(n) - n
    i = np.repeat(np.arange(len(a)), n[a])
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n[a]) - n[a], n[a]) + first[a][i]


def inside_lengths(lines: tuple[np.ndarray, np.ndarray], rings: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair the length of the line's part inside the ring: each segment is cut where it crosses the ring, and pieces are told by their middles."""
    pairs = len(lines[1]) - 1
    s_of, p, q = _sides(*lines)
    r_of, a, b = _sides(*rings)
    # Sides run upwards, so that one that is gone over twice gives the same number twice.
    down = a[:, 1:] > b[:, 1:]
    a, b = np.where(down, b, a), np.where(down, a, b)
    i, j = _met(s_of, r_of, pairs)
    d, e, w = (q - p)[i], (b - a)[j], a[j] - p[i]
    det = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / det, (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / det
        hit = (det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    each = np.arange(len(s_of))
    seg, at = np.concatenate([each, each, i[hit]]), np.concatenate([np.zeros(len(each)), np.ones(len(each)), t[hit]])
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    piece = np.nonzero((seg[1:] == seg[:-1]) & (at[1:] > at[:-1]))[0]
    seg, lo, hi = seg[piece], at[piece], at[piece + 1]
    mid = p[seg] + ((lo + hi) / 2)[:, None] * (q - p)[seg]
    k, j = _met(s_of[seg], r_of, pairs)
    over = (a[j, 1] > mid[k, 1]) != (b[j, 1] > mid[k, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[j, 0] + (mid[k, 1] - a[j, 1]) * (b[j, 0] - a[j, 0]) / (b[j, 1] - a[j, 1])
    odd = np.bincount(k[over & (mid[k, 0] < x)], minlength=len(piece)) % 2 == 1
    return np.bincount(s_of[seg][odd], ((hi - lo) * np.hypot(*(q - p)[seg].T))[odd], pairs)


def inside_length(line: np.ndarray, ring: np.ndarray) -> float:
    """inside_lengths of one line and ring."""
    return float(inside_lengths((line, np.array([0, len(line)])), (ring, np.array([0, len(ring)])))[0])


@F.arrow_udf(T.DoubleType())
def clipped_length(points: pa.Array, ring: pa.Array) -> pa.Array:
    """Length of a line inside a ring; null where either is. All pairs of a batch are cut at once, some CLIP_AT_ONCE of segments and sides together."""
    sizes = pc.multiply(pc.fill_null(pc.list_value_length(points), 0), pc.fill_null(pc.list_value_length(ring), 0)).to_numpy(zero_copy_only=False)
    out, at = [np.empty(0)], 0
    part = np.cumsum(sizes.astype(np.int64)) // CLIP_AT_ONCE
    for n in np.unique(part, return_counts=True)[1].tolist():
        out.append(inside_lengths(_flat(points.slice(at, n)), _flat(ring.slice(at, n))))
        at += n
    none = pc.or_(points.is_null(), ring.is_null()).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(out), mask=none)


def _twice_area(ring: Column) -> Column:
    """Twice a closed ring's shoelace area, negative where it runs clockwise."""
    return F.aggregate(_segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    return F.abs(_twice_area(ring)) / 2


def polygon(rings: Column, outer: Column) -> Column:
    """A polygon of several parts or with holes as one closed ring.

    rings: array of closed rings; outer: for each of them whether it bounds a
    part (true) or a hole. The result goes around the first ring, and from its
    first point to each other ring, around it and back, parts anticlockwise and
    holes clockwise. The sides that lead there are gone over in both
    directions, so areas, centroids, clips and crossings count them as nothing.
    No rings give an empty array.
    """
    turned = F.zip_with(rings, outer, lambda r, o: F.when((_twice_area(r) > 0) == o, r).otherwise(F.reverse(r)))
    return F.aggregate(turned, F.array().cast(LINE), lambda acc, r: F.when(F.size(acc) == 0, r).otherwise(F.concat(acc, r, F.slice(acc, 1, 1))))


def outlines(ring: Column) -> Column:
    """The rings of which polygon() has made one, as an array of lines; an open line is its own outline."""
    first = F.get(ring, F.lit(0))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ring), F.lit(1))), lambda i: F.get(ring, i - 1) == first)
    n = F.greatest(F.size(at) - 1, F.lit(0))

    def between(p, q):
        inner = F.slice(ring, p + 1, q - p - 1)
        joined = (F.size(inner) > 1) & (F.get(inner, F.lit(0)) == F.get(inner, F.size(inner) - 1))
        return F.when(joined, inner).otherwise(F.slice(ring, p, q - p + 1))

    return F.when(n == 0, F.array(ring)).otherwise(F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), between))


def centroid(ring: Column) -> Column:
    """Centre of gravity of a closed ring."""

    def step(acc, s):
        c = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        return F.struct((acc["w"] + c).alias("w"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) * c).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) * c).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(_segments(ring), zero, step, lambda a: F.when(a["w"] != 0, point(a["x"] / (3 * a["w"]), a["y"] / (3 * a["w"]))).otherwise(F.element_at(ring, 1)))


def _signed_area(ring: np.ndarray) -> float:
    at = ring - ring[0]
    return float(at[:-1, 0] @ at[1:, 1] - at[1:, 0] @ at[:-1, 1]) / 2


def overlap(ring: np.ndarray, clip: np.ndarray) -> float:
    """Area that two rings share.

    A convex clip cuts the ring at once. Any other is the sum of the triangles
    between its first corner and its sides, signed as they turn, and so is its
    share of the ring; holes and further parts need nothing else.
    """
    if len(ring) < 4 or len(clip) < 4:
        return 0.0
    side, spoke = np.diff(clip, axis=0), clip[1:-1] - clip[0]
    after = np.roll(side, -1, axis=0)
    turns = side[:, 0] * after[:, 1] - side[:, 1] * after[:, 0]
    fans = spoke[:-1, 0] * spoke[1:, 1] - spoke[:-1, 1] * spoke[1:, 0]
    each = np.concatenate([turns, fans])
    if (each >= 0).all() or (each <= 0).all():
        return abs(_cut(ring, clip))
    corners = [np.array([clip[0], clip[k + 1], clip[k + 2], clip[0]]) for k in np.flatnonzero(fans)]
    return abs(sum(np.sign(f) * _cut(ring, t) for f, t in zip(fans[fans != 0], corners, strict=True)))


def _cut(ring: np.ndarray, clip: np.ndarray) -> float:
    """Signed area of ring inside a convex clip ring, by cutting it with each of the clip's sides."""
    side = 1.0 if _signed_area(clip) > 0 else -1.0
    out = ring[:-1]
    for a, b in zip(clip[:-1], clip[1:], strict=True):
        if not len(out):
            return 0.0
        d = side * ((b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0]))
        new = []
        for i in range(len(out)):
            p, dp, dq = out[i], d[i], d[(i + 1) % len(out)]
            if dp >= 0:
                new.append(p)
            if dp * dq < 0:
                new.append(p + dp / (dp - dq) * (out[(i + 1) % len(out)] - p))
        out = np.array(new).reshape(-1, 2)
    return _signed_area(np.vstack([out, out[:1]])) if len(out) > 2 else 0.0


def _areas(xy: np.ndarray, of: np.ndarray, pairs: int) -> np.ndarray:
    """Signed areas of open rings, whose points are numbered by ring and in order."""
    first = np.searchsorted(of, np.arange(pairs))
    p = xy - xy[first[of]] if len(xy) else xy
    q = p[_next(of)]
    return np.bincount(of, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], pairs) / 2


def _next(of: np.ndarray) -> np.ndarray:
    """Position of each ring point's successor, the last one's being the first."""
    after = np.arange(1, len(of) + 1)
    ends = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])) if len(of) else after
    after[ends] = np.concatenate([[0], ends[:-1] + 1]) if len(of) else ends
    return after


def convex_overlaps(rings: tuple[np.ndarray, np.ndarray], clips: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of closed rings the area that they share, and whether that is right: it is where the clip is convex. All pairs are cut by their clips' first sides, then by the second ones, and so on."""
    pairs = len(clips[1]) - 1
    of, out, _ = _sides(*rings)
    at, a, b = _sides(*clips)
    sides = np.bincount(at, minlength=pairs)
    first, side = np.cumsum(sides) - sides, b - a
    after = side[_next(at)]
    turns = side[:, 0] * after[:, 1] - side[:, 1] * after[:, 0]
    spoke, end = a - a[first[at]], b - a[first[at]]
    fans = spoke[:, 0] * end[:, 1] - spoke[:, 1] * end[:, 0]
    some = lambda x: np.bincount(at[x], minlength=pairs) > 0
    convex = ~(some((turns > 0) | (fans > 0)) & some((turns < 0) | (fans < 0)))
    usable = convex & (sides > 2) & (np.diff(rings[1]) > 3)
    turn = np.where(_areas(a, at, pairs) > 0, 1.0, -1.0)
    kept = usable[of]
    of, out = of[kept], out[kept]
    for k in range(sides[usable].max(initial=0)):
        j = np.minimum(first + k, len(a) - 1)[of]
        d = np.where(sides[of] > k, turn[of] * (side[j, 0] * (out[:, 1] - a[j, 1]) - side[j, 1] * (out[:, 0] - a[j, 0])), 0.0)
        if (d >= 0).all():
            continue
        after = _next(of)
        cut, e = d * d[after] < 0, d[after]
        share = np.divide(d, d - e, out=np.zeros(len(d)), where=cut)
        both = np.stack([out, out + share[:, None] * (out[after] - out)], 1).reshape(-1, 2)
        keep = np.stack([d >= 0, cut], 1).reshape(-1)
        out, of = both[keep], np.repeat(of, 2)[keep]
    return np.abs(_areas(out, of, pairs)), convex


@F.arrow_udf(T.DoubleType())
def overlap_area(ring: pa.Array, clip: pa.Array) -> pa.Array:
    """Area that two rings share, convex or not; null where either is. Pairs of a batch with a convex clip are cut at once, the others one by one."""
    (a, i), (b, j) = _flat(ring), _flat(clip)
    none = pc.or_(ring.is_null(), clip.is_null()).to_numpy(zero_copy_only=False)
    out, right = convex_overlaps((a, i), (b, j))
    for k in np.flatnonzero(~right & ~none):
        out[k] = overlap(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
    return pa.array(out, pa.float64(), mask=none)


def within_distance(points: Column, x: Column, y: Column, d: float) -> Column:
    """Whether a point is within d of a line; the buffer polygon is never built."""
    return project(points, x, y)["distance"] <= d


def to_utm(lon: Column, lat: Column, zone: int = 20, south: bool = True) -> Column:
    """struct(x, y) in metres by the transverse Mercator series (Krüger, to the third order)."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * np.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(UTM_EAST + UTM_SCALE * radius * x, (UTM_SOUTH if south else 0.0) + UTM_SCALE * radius * y)


def from_utm(x: Column, y: Column, zone: int = 20, south: bool = True) -> Column:
    """struct(x: lon, y: lat) of UTM metres."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = (y - (UTM_SOUTH if south else 0.0)) / (UTM_SCALE * radius), (x - UTM_EAST) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return point(F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(phi))


def nearer(ring: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The part of an open convex ring that is nearer to `own` than to `other`."""
    d = (ring - (own + other) / 2) @ (own - other)
    if (d >= 0).all():
        return ring
    after = np.roll(d, -1)
    out = []
    for i in range(len(ring)):
        if d[i] >= 0:
            out.append(ring[i])
        if d[i] * after[i] < 0:
            out.append(ring[i] + d[i] / (d[i] - after[i]) * (ring[(i + 1) % len(ring)] - ring[i]))
    return np.array(out).reshape(-1, 2)


def cells_in_tile(nodes: pd.DataFrame) -> pd.DataFrame:
    """The tile's parts of the Voronoi cells of its candidate nodes.

    A node's part is cut by the bisectors to the others, nearest first, until
    the next one lies beyond its farthest corner.
    """
    first = nodes.iloc[0]
    size = float(first["size"])
    x0, y0 = float(first["tx"]) * size, float(first["ty"]) * size
    tile = np.array([(x0, y0), (x0 + size, y0), (x0 + size, y0 + size), (x0, y0 + size)])
    nodes = nodes.sort_values("node_id")
    xy, rows = nodes[["x", "y"]].to_numpy(float), []
    for i, own in enumerate(xy):
        away = np.hypot(*(xy - own).T)
        ring = tile
        for j in np.argsort(away, kind="stable")[1:]:
            if not len(ring) or away[j] / 2 > np.hypot(*(ring - own).T).max():
                break
            ring = nearer(ring, own, xy[j])
        if len(ring) > 2:
            rows.append((int(first["level"]), int(first["tx"]), int(first["ty"]), nodes["node_id"].iloc[i], [{"x": x, "y": y} for x, y in np.vstack([ring, ring[:1]]).tolist()]))
    return pd.DataFrame(rows, columns=["level", "tx", "ty", "node_id", "ring"])


def line_between(points: Column, lo: Column, hi: Column, end: Column | None = None) -> Column:
    """The part of a line between two distances along it (end: its last point, if it is known)."""

    def step(acc, s):
        at = acc["at"] + _length(s)
        return F.struct(at.alias("at"), F.when((at > lo) & (at < hi), F.concat(acc["out"], F.array(s["b"]))).otherwise(acc["out"]).alias("out"))

    inner = F.aggregate(_segments(points), F.struct(F.lit(0.0).alias("at"), F.slice(points, 1, 0).alias("out")), step, lambda a: a["out"])
    to = lambda last: last if end is None else F.coalesce(end, last)
    walk = F.concat(F.array(interpolate(points, lo)), inner, F.array(to(interpolate(points, hi))))
    # A line of two points needs no walk.
    a, b = F.get(points, 0), F.get(points, 1)
    n = distance(a["x"], a["y"], b["x"], b["y"])

    def at(along):
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / n))
        return point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))

    return F.when((F.size(points) == 2) & (n > 0) & (lo >= 0) & (hi <= n), F.array(at(lo), to(at(hi)))).otherwise(walk)


def sub_line(points: Column, along: Column, length: Column) -> Column:
    """The part of a line within half a length of a distance along it, clamped to the line's ends."""
    return line_between(points, F.greatest(F.lit(0.0), along - length / 2), F.least(line_length(points), along + length / 2))


def band_cells(cells: DataFrame, bands: list[tuple[float, float, str]]) -> DataFrame:
    """Cells with their band's label; cells in no band go. bands: (lo, hi, label), lo <= value < hi."""
    label = F.lit(None).cast("string")
    for lo, hi, name in bands:
        label = F.when((F.col("value") >= lo) & (F.col("value") < hi), name).otherwise(label)
    return cells.withColumn("band", label).where(F.col("band").isNotNull())


def colour_cells(cells: DataFrame, colour: tuple[float, float, float]) -> DataFrame:
    """Cells whose three bands have the given values."""
    return cells.where((F.col("band1") == colour[0]) & (F.col("band2") == colour[1]) & (F.col("band3") == colour[2]))


def clean_cells(cells: DataFrame, no_data: float = 0.0) -> DataFrame:
    """NaN and negative values become no_data."""
    v = F.nanvl("value", F.lit(no_data))
    return cells.withColumn("value", F.when(v < 0, no_data).otherwise(F.coalesce(v, F.lit(no_data))))


def row_runs(cells: DataFrame) -> DataFrame:
    """Runs of neighbouring cells of one band in a raster row, as rectangles (row, first, last)."""
    w = Window.partitionBy("raster", "band", "row").orderBy("col")
    runs = cells.withColumn("_g", F.col("col") - F.row_number().over(w))
    return runs.groupBy("raster", "band", "row", "_g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_g")


def rectangles(runs: DataFrame) -> DataFrame:
    """Equal runs of consecutive rows as one rectangle."""
    w = Window.partitionBy("raster", "band", "first", "last").orderBy("row")
    g = runs.withColumn("_g", F.col("row") - F.row_number().over(w))
    return g.groupBy("raster", "band", "first", "last", "_g").agg(F.min("row").alias("top"), F.max("row").alias("bottom")).drop("_g")


def rectangle_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring around a box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
