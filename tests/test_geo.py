import math
import random

import pytest

from brinewell.operators.geo import EARTH_KM, RegionIndex, ear_clip, near_sites, near_sites_join, unwrap_ring
from brinewell.runtime import TooLarge, bounded_rows

POINTS = "obs_id long, longitude double, latitude double, site_id string"
STATIONS = "station_id int, station_name string, longitude double, latitude double"
REGIONS = "region_id int, ring_no int, region_name string, ocean string, is_hole boolean, ring array<struct<lon:double,lat:double>>"


def area(t):
    return abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2


def star(n, seed, cx=0.0, cy=0.0):
    r = random.Random(seed)
    return [(cx + (a := r.uniform(1, 9)) * math.cos(2 * math.pi * i / n), cy + a * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_triangles_fill_the_ring(seed):
    ring = star(5 + 3 * seed, seed)
    for r in (ring, ring[::-1], ring + ring[:1]):
        tri = ear_clip(r)
        shoelace = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
        assert sum(map(area, tri)) == pytest.approx(shoelace)


@pytest.mark.parametrize("ring", [[(0, 0), (4, 4), (4, 0), (0, 4)], [(math.sin(4 * math.pi * i / 5), math.cos(4 * math.pi * i / 5)) for i in range(5)], [(0, 0), (6, 0), (6, 4), (2, 4), (2, -2), (4, -2), (4, 6), (0, 6)]])
def test_crossed_rings_are_even_odd(ring):
    tri = ear_clip(ring)
    r = random.Random(1)
    hits = 0
    for _ in range(3000):
        x, y = r.uniform(-2, 7), r.uniform(-3, 7)
        within = sum(all((v[0] - u[0]) * (y - u[1]) - (v[1] - u[1]) * (x - u[0]) >= 0 for u, v in zip(t, t[1:] + t[:1])) for t in tri)
        assert (within > 0) == inside(ring, x, y)
        hits += within > 0
    assert hits


def test_rings_of_many_vertices():
    import time

    ring = star(6000, 5)
    began = time.time()
    tri = ear_clip(ring)
    assert time.time() - began < 20 and len(tri) <= len(ring) - 2
    assert sum(map(area, tri)) == pytest.approx(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2)


def test_degenerate_rings():
    assert ear_clip([]) == [] and ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2)]) == []


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def great_circle(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1, h)))


def as_rings(rid, ring, hole=False, no=1):
    return (rid, no, f"r{rid}", "o", hole, [{"lon": float(x), "lat": float(y)} for x, y in ring])


def test_against_brute_force(spark):
    r = random.Random(4)
    pts = [(i, r.choice([r.uniform(-180, 360), r.uniform(170, 190), r.uniform(-12, 12)]), r.choice([r.uniform(-90, 90), r.uniform(-12, 12), r.uniform(86, 90)]), "x") for i in range(400)]
    pts += [(400, None, 1.0, None), (401, 1.0, None, None), (402, 1.0, 91.0, None), (403, -181.0, 1.0, None), (404, 361.0, 0.0, None), (405, float("nan"), 0.0, None), (7, pts[7][1], pts[7][2], "again")]
    sts = [(i, f"s{i}", r.choice([r.uniform(-180, 180), 179.9, -179.9, r.uniform(-5, 5)]), r.choice([r.uniform(-90, 90), 89.0, r.uniform(-5, 5)])) for i in range(150)] + [(900, "none", None, None)]
    outer, hole = star(12, 1), [(x / 3, y / 3) for x, y in star(12, 1)]
    seam = [(170.0, -5.0), (-170.0, -5.0), (-170.0, 5.0), (170.0, 5.0)]
    regs = [as_rings(1, outer), as_rings(1, hole, True, 2), as_rings(2, seam), as_rings(3, star(9, 3, 40, 30)), as_rings(3, star(9, 4, 80, -30), no=2), as_rings(4, [(0, 0)])]
    p, s, g = spark.createDataFrame(pts, POINTS), spark.createDataFrame(sts, STATIONS), spark.createDataFrame(regs, REGIONS)
    got = sorted(map(tuple, near_sites(p, "obs_id", stations=s, regions=g, radius_km=300.0).collect()))
    want = []
    for i, x, y, _ in pts:
        if x is None or y is None or x != x or not -90 <= y <= 90 or not -180 <= x <= 360:
            continue
        x = x - 360 if x > 180 else x
        want += [(i, "station", k) for k, _, a, b in sts if a is not None and great_circle((x, y), (a, b)) <= 300]
        for rid in (1, 2, 3):
            rings = [(unwrap_ring([(v["lon"], v["lat"]) for v in q[5]]), q[4]) for q in regs if q[0] == rid]
            hit = lambda ring: any(inside(ring, x + t, y) for t in (-360, 0, 360))  # noqa: B023, E731
            if any(hit(q) for q, h in rings if not h) and not any(hit(q) for q, h in rings if h):
                want.append((i, "region", rid))
    assert got == sorted(want)
    joined = sorted(map(tuple, near_sites_join(p, "obs_id", s, "station_id", 300.0).collect()))
    assert joined == sorted(w for w in want if w[1] == "station")
    by_cells = sorted(map(tuple, near_sites(p, "obs_id", regions=g, max_triangles=3).collect()))
    assert by_cells == sorted(w for w in want if w[1] == "region") and by_cells
    forced = sorted(map(tuple, near_sites(p, "obs_id", stations=s, radius_km=300.0, max_stations=3).collect()))
    assert forced == joined


def test_shared_border_goes_to_the_lowest_region():
    import numpy as np

    tri = [t for ring in ([(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (2, 0), (2, 1), (1, 1)]) for t in ear_clip(ring)]
    idx = RegionIndex([5, 5, 2, 2], [False] * 4, tri)
    p, r = idx.find(np.array([1.0, 0.5, 1.5, 3.0]), np.array([0.5, 0.5, 0.5, 0.5]))
    assert list(zip(p, r)) == [(0, 2), (1, 5), (2, 2)]


def test_empty_tables(spark):
    p, s, g = (spark.createDataFrame([], d) for d in (POINTS, STATIONS, REGIONS))
    assert near_sites(p, "obs_id", stations=s, regions=g).collect() == []
    q = spark.createDataFrame([(1, 0.0, 0.0, "a")], POINTS)
    assert near_sites(q, "obs_id", stations=s, regions=g).collect() == []
    assert near_sites_join(q, "obs_id", s, "station_id", 5.0).collect() == []


def test_bound_is_checked(spark):
    with pytest.raises(TooLarge):
        bounded_rows(spark.range(5), 4, "rows")
