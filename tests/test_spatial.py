import math
import random
import struct

import numpy as np
from talweg.operators import spatial
from talweg.operators.spatial import EARTH_RADIUS_M, locate, near, trapezoids, within, wkb_rings


def dist(p, q):
    a, b = math.radians(p[0]), math.radians(q[0])
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(s)))


def wkb(polygons, order="<", header=False):
    def one(rings):
        return struct.pack(order + "BII", order == "<", 3, len(rings)) + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)

    body = one(polygons[0]) if len(polygons) == 1 else struct.pack(order + "BII", order == "<", 6, len(polygons)) + b"".join(map(one, polygons))
    return (b"GP\x00\x01" + struct.pack("<i", 4326) if header else b"") + body


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


def star(rnd, cx, cy, size, n):
    return [(cx + size * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + size * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_near_against_brute_force(spark):
    rnd = random.Random(3)
    pts = [(1, 89.999, 10.0), (2, 89.999, -170.0), (3, 10.0, 179.9995), (4, 10.0, -179.9995), (5, 10.0, 180.0005), (6, 0.0, 0.0), (7, None, 3.0), (8, float("nan"), 3.0), (9, 91.0, 3.0), (10, 1.0, 359.9999), (11, 1.0, -0.0001)]
    pts += [(100 + i, 45 + rnd.gauss(0, 0.01), 7 + rnd.gauss(0, 0.01)) for i in range(300)] + [(500, 45.0, 7.0), (501, 45.0, 7.0), (501, 45.0, 7.0), (None, 45.0, 7.0)]
    df = spark.createDataFrame([(*p, 0) for p in pts], "id long, lat double, lng double, count int")
    good = {(i, la, lo - 360 if lo > 180 else lo) for i, la, lo in pts if i and la is not None and abs(la) <= 90 and (la, lo) != (0, 0)}
    want = sorted((a[0], b[0]) for a in good for b in good if a[0] < b[0] and dist(a[1:], b[1:]) <= 1000)
    for hot in (5, 2000):
        got = sorted((r.id_a, r.id_b) for r in near(df, "id", "lat", "lng", 1000.0, hot).collect())
        assert got == want


def test_within_against_ray_casting(spark, monkeypatch):
    rnd = random.Random(4)
    regions, polygons = [], {}
    for i in range(60):
        cx, cy, size = rnd.uniform(-5, 5), rnd.uniform(40, 50), rnd.choice([0.01, 0.2, 3.0])
        outer = star(rnd, cx, cy, size, rnd.choice([3, 8, 40]))
        rings = [outer, [(cx + 0.1 * (x - cx), cy + 0.1 * (y - cy)) for x, y in outer][::-1]] if i % 3 == 0 else [outer]
        parts = [rings] if i % 4 else [rings, [[(x + 20, y) for x, y in outer]]]
        polygons[i] = [r for p in parts for r in p]
        regions.append((i, wkb([[r + r[:1] for r in p] for p in parts], "<>"[i % 2], i % 5 == 0)))
    regions += [regions[0], (90, None), (91, b""), (92, b"nonsense"), (93, wkb([[[(0.0, 0.0), (1.0, 1.0)]]])), (None, regions[1][1])]
    pts = [(i, rnd.uniform(38, 52), rnd.uniform(-7, 7)) for i in range(600)] + [(600 + i, polygons[i][0][0][1] - 0.001, polygons[i][0][0][0] + 0.0003) for i in range(60)] + [(900, None, 3.0)]
    pts += pts[:20]
    p = spark.createDataFrame([(*x, "t") for x in pts], "id long, lat double, lng double, level string")
    r = spark.createDataFrame(regions, "comid long, geom binary")
    want = sorted({(i, k) for i, la, lo in pts if la is not None for k, rings in polygons.items() if inside(rings, lo, la)})
    assert len(want) > 100
    for group in (7, 50_000):
        got = sorted(map(tuple, within(p, "id", "lat", "lng", r, "comid", "geom", group).collect()))
        assert got == want
    monkeypatch.setattr(spatial, "LARGE_VERTICES", 12)
    assert sorted(map(tuple, within(p, "id", "lat", "lng", r, "comid", "geom").collect())) == want
    assert within(p, "id", "lat", "lng", r.limit(0), "comid", "geom").count() == 0
    assert within(p.limit(0), "id", "lat", "lng", r, "comid", "geom").count() == 0


def test_few_slabs_find_the_same():
    rnd = random.Random(6)
    rings = [[star(rnd, rnd.uniform(0, 5), rnd.uniform(0, 5), 1.0, 30)] for _ in range(40)]
    traps, owner = trapezoids([[np.array(r) for r in rs] for rs in rings])
    xs, ys = np.array([rnd.uniform(-1, 6) for _ in range(500)]), np.array([rnd.uniform(-1, 6) for _ in range(500)])
    found = []
    for slabs in (1, 7, 512):
        p, t = locate(xs, ys, traps, slabs)
        found.append(sorted({(int(a), int(b)) for a, b in zip(p, owner[t])}))
    assert found[0] == found[1] == found[2] == sorted((i, k) for i in range(500) for k in range(40) if inside(rings[k], xs[i], ys[i]))


def test_full_cells_are_slabs_of_their_own():
    cells = [(5, 3), (-4, 2), (7, 25), (6, 4), (9, 1)]
    assert spatial.slabs_of(cells, 10) == [(-4, 0, 1), (5, 0, 1), (6, 0, 1), (7, 1, 3), (9, 2, 1)]


def test_crowded_slabs_are_split(spark, monkeypatch):
    """All points and regions at one longitude: points in parts, trapezoids in parts, and nothing twice."""
    monkeypatch.setattr(spatial, "TRAPS_PER_ROW", 2)
    square = lambda i: [(7.0 - 1e-4, i / 100), (7.0 + 1e-4, i / 100), (7.0 + 1e-4, (i + 2) / 100), (7.0 - 1e-4, (i + 2) / 100)]
    r = spark.createDataFrame([(i, wkb([[[*square(i), square(i)[0]]]])) for i in range(40)], "comid long, geom binary")
    p = spark.createDataFrame([(k, k / 150 + 0.001, 7.0) for k in range(60)], "id long, lat double, lng double")
    want = sorted((k, i) for k in range(60) for i in range(40) if inside([square(i)], 7.0, k / 150 + 0.001))
    assert sorted(map(tuple, within(p, "id", "lat", "lng", r, "comid", "geom", 6).collect())) == want


def test_wkb_of_other_kinds_is_no_region():
    assert wkb_rings(struct.pack("<BIdd", 1, 1, 3.0, 4.0)) == []
    assert spatial.GROUP_ROWS > 0
