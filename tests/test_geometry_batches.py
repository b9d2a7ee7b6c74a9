"""Geometry over whole batches against plain loops, and the projection against another series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayrisk.functions import geometry as G

LINES = "k int, line array<struct<x:double,y:double>>, ring array<struct<x:double,y:double>>"


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def sampled_length(line, ring, n=4000):
    total = 0.0
    for (ax, ay), (bx, by) in zip(line[:-1], line[1:], strict=True):
        size = math.hypot(bx - ax, by - ay)
        total += size / n * sum(inside(ax + (i + 0.5) / n * (bx - ax), ay + (i + 0.5) / n * (by - ay), ring) for i in range(n))
    return total


def test_clips_of_a_batch(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(25):
        corners = int(rng.integers(4, 10))  # around the origin, so that no sides cross
        angle = (np.arange(corners) + rng.uniform(0, 0.8, corners)) * 2 * math.pi / corners
        ring = [(float(r * math.cos(a)), float(r * math.sin(a))) for a, r in zip(angle, rng.uniform(2, 9, len(angle)), strict=True)]
        line = [tuple(map(float, p)) for p in rng.uniform(-9, 9, (rng.integers(2, 6), 2))]
        rows.append((k, line, ring + ring[:1]))
    special = [(100, None, rows[0][2]), (101, rows[0][1], None), (102, [], rows[0][2]), (103, [(0.0, 0.0)], rows[0][2]), (104, rows[0][1], [])]
    df = spark.createDataFrame(rows + special, LINES)
    got = {r.k: (r.n, r.a) for r in df.select("k", G.clipped_length("line", "ring").alias("n"), G.overlap_area("ring", "ring").alias("a")).collect()}
    for k, line, ring in rows:
        assert got[k][0] == pytest.approx(sampled_length(line, ring), abs=0.05)
        assert got[k][1] == pytest.approx(abs(G._signed_area(np.array(ring))))
    assert got[100][0] is None and got[101] == (None, None) and [got[k][0] for k in (102, 103, 104)] == [0.0, 0.0, 0.0]
    # All at once is as each for itself.
    alone = [G.inside_length(np.array(line), np.array(ring)) for _, line, ring in rows]
    assert [got[k][0] for k, *_ in rows] == pytest.approx(alone)


def meridian_arc(phi, a, e2):
    return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))


def utm_by_powers(lon, lat, zone=20):
    """The older series in powers of the longitude's difference, good to a centimetre within 3 degrees."""
    f = G.WGS84_F
    e2, phi, a = f * (2 - f), math.radians(lat), G.WGS84_A
    ep2, n, t = e2 / (1 - e2), a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2
    c, d = ep2 * math.cos(phi) ** 2, math.radians(lon - (6 * zone - 183)) * math.cos(phi)
    x = n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * d**5 / 120)
    y = meridian_arc(phi, a, e2) + n * math.tan(phi) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * d**6 / 720)
    return 500000 + 0.9996 * x, 10000000 + 0.9996 * y


def test_utm_equals_another_series(spark):
    places = [(-63 + dx / 2, -22 - 3.5 * k) for dx in (-5, -2, 0, 1, 4) for k in range(9)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for r in df.select("lon", "lat", G.to_utm(F.col("lon"), F.col("lat")).alias("p")).collect():
        x, y = utm_by_powers(r.lon, r.lat)
        assert abs(r.p.x - x) < 0.02 and abs(r.p.y - y) < 0.02
