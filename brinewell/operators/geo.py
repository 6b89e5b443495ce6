"""Points near other points, and points inside regions.

Regions are triangulated ring by ring with ear clipping; triangles and radius
discs go into a bounding-volume hierarchy that every task holds (its size is
checked first), batches of points descend it together, and each candidate is
tested exactly.  Stations and triangles over the bound go through
:func:`near_sites_join` and :func:`containing_regions_join`, salted cell joins
without any broadcast of the sites.

Defined results: a null coordinate, NaN, a latitude outside -90..90 or a
longitude outside -180..360 gives no row; repeated points give a row each; a
position on a border shared by two regions belongs to the lowest region id;
sites without a position are never found; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import TooLarge, bounded_rows

EARTH_KM = 6371.0088


# -- ear clipping ---------------------------------------------------------------------------------


def _cross(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles of one ring (implicitly closed, either direction).

    Consecutive equal vertices are merged; a ring of under three distinct
    vertices or without area has no triangles.  Only reflex vertices can lie in an
    ear, and clipping goes on where the last ear was, so most vertices are tested
    once, against the reflex ones together.  A ring that crosses itself has no ears
    in the end: what is left of it is cut into slabs, its inside by the even-odd rule.
    """
    pts = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3:
        return []
    area2 = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1]))
    ways = [math.atan2(q[1] - p[1], q[0] - p[0]) for p, q in zip(pts, pts[1:] + pts[:1])]
    turned = sum(math.remainder(b - a, 2 * math.pi) for a, b in zip(ways, ways[1:] + ways[:1]))
    if area2 == 0 or abs(abs(turned) - 2 * math.pi) > 1:  # a simple ring turns once
        return slabs(pts)
    if area2 < 0:
        pts.reverse()
    n = len(pts)
    xy = np.array(pts, float)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    before[0], after[n - 1] = n - 1, 0
    turn = lambda i: _cross(pts[before[i]], pts[i], pts[after[i]])
    reflex = np.array([turn(i) < 0 for i in range(n)])

    def is_ear(i: int) -> bool:
        a, b, c = pts[before[i]], pts[i], pts[after[i]]
        if _cross(a, b, c) <= 0:
            return False
        r = xy[reflex]
        if not len(r):
            return True
        x, y = r[:, 0], r[:, 1]
        side = lambda u, v: (v[0] - u[0]) * (y - u[1]) - (v[1] - u[1]) * (x - u[0])
        inside = (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0)
        if inside.any():
            corner = ((x == a[0]) & (y == a[1])) | ((x == b[0]) & (y == b[1])) | ((x == c[0]) & (y == c[1]))
            inside &= ~corner
        return not inside.any()

    out, left, i, missed = [], n, 0, 0
    while left > 3:
        flat = turn(i) == 0
        if flat or is_ear(i):
            a, c = before[i], after[i]
            if not flat:
                out.append((pts[a], pts[i], pts[c]))
            after[a], before[c] = c, a
            reflex[i] = False
            for k in (a, c):
                reflex[k] = turn(k) < 0
            left, missed, i = left - 1, 0, c
            continue
        i, missed = after[i], missed + 1
        if missed > left:
            rest, k = [], i
            for _ in range(left):
                rest.append(pts[k])
                k = after[k]
            return out + slabs(rest) if not out else slabs(pts)
    last = (pts[before[i]], pts[i], pts[after[i]])
    if _cross(*last) > 0:
        out.append(last)
    return out


def slabs(pts: list[tuple[float, float]]) -> list[tuple]:
    """Triangles of the inside, by the even-odd rule, of a ring that may cross itself: cut at the height of every
    vertex and crossing, each slab holds pairs of edges that do not meet."""
    edges = [(p, q) if p[1] < q[1] else (q, p) for p, q in zip(pts, pts[1:] + pts[:1]) if p[1] != q[1]]
    cuts = {p[1] for p in pts}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                y = a[1] + t * (b[1] - a[1])
                if 0 < t < 1 and c[1] < y < d[1]:
                    cuts.add(y)
    at = lambda e, y: e[0][0] + (y - e[0][1]) / (e[1][1] - e[0][1]) * (e[1][0] - e[0][0])
    out, heights = [], sorted(cuts)
    for low, high in zip(heights, heights[1:]):
        mid = (low + high) / 2
        across = sorted((e for e in edges if e[0][1] < mid < e[1][1]), key=lambda e: at(e, mid))
        for u, v in zip(across[::2], across[1::2]):
            ll, lr, hr, hl = (at(u, low), low), (at(v, low), low), (at(v, high), high), (at(u, high), high)
            out += [t for t in ((ll, lr, hr), (ll, hr, hl)) if _cross(*t) > 0]
    return out


def unwrap_ring(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Longitudes made continuous: a jump of more than 180 degrees crosses the date line."""
    out, shift, last = [], 0.0, None
    for lon, lat in ring:
        if last is not None:
            if lon - last > 180:
                shift -= 360
            elif lon - last < -180:
                shift += 360
        out.append((lon + shift, lat))
        last = lon
    return out


# -- bounding-volume hierarchy --------------------------------------------------------------------


class BoxTree:
    """Boxes (x0, y0, x1, y1) halved at the median centre of the longer side; leaves of eight."""

    LEAF = 8

    def __init__(self, boxes: np.ndarray):
        self.boxes = np.asarray(boxes, float).reshape(-1, 4)
        self.bounds, self.kids, self.items = [], [], []
        if len(self.boxes):
            self._grow(np.arange(len(self.boxes)))

    def _grow(self, ids: np.ndarray) -> int:
        b, me = self.boxes[ids], len(self.bounds)
        self.bounds.append((b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max()))
        self.kids.append(None)
        self.items.append(None)
        if len(ids) <= self.LEAF:
            self.items[me] = ids
            return me
        mid = np.stack([b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]])
        order = np.argsort(mid[int(np.ptp(mid[1]) > np.ptp(mid[0]))], kind="stable")
        half = len(ids) // 2
        self.kids[me] = (self._grow(ids[order[:half]]), self._grow(ids[order[half:]]))
        return me

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) index pairs with the point in the box; points descend the tree together."""
        ps, bs = [], []
        stack = [(0, np.arange(len(x)))] if self.bounds else []
        while stack:
            node, idx = stack.pop()
            x0, y0, x1, y1 = self.bounds[node]
            px, py = x[idx], y[idx]
            idx = idx[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
            if not len(idx):
                continue
            if self.kids[node]:
                stack += [(k, idx) for k in self.kids[node]]
                continue
            px, py = x[idx], y[idx]
            for item in self.items[node]:
                x0, y0, x1, y1 = self.boxes[item]
                hit = idx[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
                if len(hit):
                    ps.append(hit)
                    bs.append(np.full(len(hit), item))
        none = np.zeros(0, np.int64)
        return (np.concatenate(ps), np.concatenate(bs)) if ps else (none, none)


class DiscIndex:
    """Sites with a radius on the sphere."""

    def __init__(self, ids, lon, lat, radius_km: float):
        lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        self.radius_km = radius_km
        reach = radius_km / EARTH_KM
        dlat = math.degrees(reach) * (1 + 1e-9)
        boxes, owner = [], []
        for i, (lo, la) in enumerate(zip(lon, lat)):
            c = math.cos(math.radians(la))
            polar = abs(la) + dlat >= 90
            dlon = 180.0 if polar or c <= 0 else math.degrees(math.asin(min(1.0, math.sin(min(reach, math.pi / 2)) / c))) * (1 + 1e-9)
            base = (lo + 180) % 360 - 180
            for turn in (-360, 0, 360):
                x0, x1 = base + turn - dlon, base + turn + dlon
                if polar and turn:
                    continue
                if polar:
                    x0, x1 = -180.0, 180.0
                if x1 >= -180 and x0 <= 180:
                    boxes.append((x0, la - dlat, x1, la + dlat))
                    owner.append(i)
        self.ids, self.owner = np.asarray(ids), np.asarray(owner, np.int64)
        self.xyz = _unit(lon, lat)
        self.tree = BoxTree(np.asarray(boxes))

    def find(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, b = self.tree.candidates(lon, lat)
        s = self.owner[b] if len(b) else b
        chord = np.sqrt(((_unit(lon[p], lat[p]) - self.xyz[s]) ** 2).sum(1)) if len(p) else np.zeros(0)
        near = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, chord / 2)) <= self.radius_km
        # a disc that spans the seam has two boxes; a point lies in at most one of them, but polar ones may touch
        pair = np.unique(np.stack([p[near], s[near]]), axis=1)
        return pair[0], self.ids[pair[1]] if pair.size else self.ids[:0]


class RegionIndex:
    """Triangles of every ring; a region is its outer rings less its holes."""

    def __init__(self, region, hole, tri):
        self.region, self.hole = np.asarray(region, np.int64), np.asarray(hole, bool)
        self.tri = np.asarray(tri, float).reshape(-1, 3, 2)
        t = self.tri
        self.tree = BoxTree(np.concatenate([t.min(1), t.max(1)], axis=1) if len(t) else np.zeros((0, 4)))

    def find(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ins, outs = [], []
        for turn in (-360.0, 0.0, 360.0):
            x = lon + turn
            p, b = self.tree.candidates(x, lat)
            if not len(p):
                continue
            t, px, py = self.tri[b], x[p], lat[p]
            hit = np.ones(len(p), bool)
            for i in range(3):
                u, v = t[:, i], t[:, (i + 1) % 3]
                hit &= (v[:, 0] - u[:, 0]) * (py - u[:, 1]) - (v[:, 1] - u[:, 1]) * (px - u[:, 0]) >= 0
            p, b = p[hit], b[hit]
            pair = np.stack([p, self.region[b]], axis=1)
            ins.append(pair[~self.hole[b]])
            outs.append(pair[self.hole[b]])
        if not ins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.unique(np.concatenate(ins), axis=0)
        cut = np.concatenate(outs)
        if len(cut):
            gone = set(map(tuple, cut.tolist()))
            inside = inside[[tuple(r) not in gone for r in inside.tolist()]]
        # rows are in order of (point, region): the first region of a point is the lowest
        first = np.unique(inside[:, 0], return_index=True)[1]
        return inside[first, 0], inside[first, 1]


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


# -- operators ------------------------------------------------------------------------------------


def region_triangles(regions: DataFrame, *, region: str = "region_id", ring: str = "ring", hole: str = "is_hole") -> DataFrame:
    """One row per triangle: region_id, is_hole, triangle_no, x1, y1, ... y3 (longitudes unwrapped).

    Rings with a null vertex or without area give none.
    """
    schema = pa.schema([("region_id", pa.int64()), ("is_hole", pa.bool_()), ("triangle_no", pa.int32())] + [(f"{a}{i}", pa.float64()) for i in (1, 2, 3) for a in "xy"])

    def clip(batches):
        for batch in batches:
            rows = []
            for rid, h, pts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if rid is None or not pts or any(p is None or p["lon"] is None or p["lat"] is None for p in pts):
                    continue
                for k, t in enumerate(ear_clip(unwrap_ring([(p["lon"], p["lat"]) for p in pts]))):
                    rows.append((rid, bool(h), k, *(v for corner in t for v in corner)))
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    picked = regions.select(F.col(region).cast("long").alias("region_id"), F.coalesce(F.col(hole), F.lit(False)).alias("is_hole"), F.col(ring).alias("ring"))
    ddl = "region_id long, is_hole boolean, triangle_no int, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xy")
    return picked.mapInArrow(clip, ddl)


def valid_position(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 360) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)


def wrapped(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def near_sites(
    points: DataFrame,
    point_id: str,
    *,
    lon: str = "longitude",
    lat: str = "latitude",
    stations: DataFrame | None = None,
    station_id: str = "station_id",
    radius_km: float = 25.0,
    regions: DataFrame | None = None,
    max_stations: int = 200_000,
    max_triangles: int = 200_000,
) -> DataFrame:
    """(point_id, site_kind, site_id): every station within the radius, and the region around each point.

    One pass over the points, no shuffle: the hierarchies over stations and
    triangles are held by every task (both are checked against their bound;
    more go through cell joins with the same results).
    """
    spark = points.sparkSession
    discs = tris = None
    extra = []
    if stations is not None:
        placed = stations.where(F.col(station_id).isNotNull() & valid_position(F.col("longitude"), F.col("latitude"))).select(station_id, "longitude", "latitude")
        try:
            rows = bounded_rows(placed, max_stations, "stations")
            discs = DiscIndex([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], radius_km) if rows else None
        except TooLarge:
            extra.append(near_sites_join(points, point_id, placed, station_id, radius_km, lon=lon, lat=lat))
    if regions is not None:
        try:
            rows = bounded_rows(region_triangles(regions), max_triangles, "triangles")
        except TooLarge:
            rows = []
            extra.append(containing_regions_join(points, point_id, region_triangles(regions), lon=lon, lat=lat))
        if rows:
            tris = RegionIndex([r["region_id"] for r in rows], [r["is_hole"] for r in rows], [[[r[f"x{i}"], r[f"y{i}"]] for i in (1, 2, 3)] for r in rows])
    shared = spark.sparkContext.broadcast((discs, tris))
    schema = pa.schema([("point_id", pa.int64()), ("site_kind", pa.string()), ("site_id", pa.int32())])

    def find(batches):
        stations_, regions_ = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).to_numpy(zero_copy_only=False)
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for kind, index in (("station", stations_), ("region", regions_)):
                if index is None:
                    continue
                p, s = index.find(x, y)
                if len(p):
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[p], pa.int64()), pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [kind]).cast(pa.string()), pa.array(s.astype(np.int32))],
                        schema=schema,
                    )

    placed_points = points.where(valid_position(F.col(lon), F.col(lat))).select(
        F.col(point_id).cast("long").alias("point_id"), wrapped(F.col(lon).cast("double")).alias("lon"), F.col(lat).cast("double").alias("lat")
    )
    found = placed_points.mapInArrow(find, "point_id long, site_kind string, site_id int")
    for more in extra:
        found = found.unionByName(more)
    return found.withColumnRenamed("point_id", point_id)


def near_sites_join(points: DataFrame, point_id: str, sites: DataFrame, site_id: str, radius_km: float, *, lon: str = "longitude", lat: str = "latitude", salt: int = 16) -> DataFrame:
    """The same pairs for site tables of any size: an equi-join on grid cells, nothing broadcast.

    Cells are about a radius high; a site is copied to every cell that its disc
    can touch, a point lies in one. Points are salted, so that one crowded cell
    is spread over ``salt`` tasks (its sites are copied that often).
    """
    dlat = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    size = max(dlat, 0.01)
    row = lambda y: F.floor((y + 90) / size)
    # cells of a row are as wide as the disc's reach at the row's edge nearer to a pole
    edge = lambda r: F.least(F.greatest(F.abs(r * size - 90), F.abs((r + 1) * size - 90)) + F.lit(dlat), F.lit(89.999))
    wide = lambda r: F.least(F.lit(360.0), F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(radius_km / EARTH_KM)) / F.cos(F.radians(edge(r)))))) * 1.000001 + 1e-6)
    ncol = lambda r: F.greatest(F.lit(1), F.floor(360 / wide(r)))
    col = lambda x, r: F.pmod(F.floor((x + 180) / 360 * ncol(r)), ncol(r))
    p = points.where(valid_position(F.col(lon), F.col(lat))).select(F.col(point_id).cast("long").alias("point_id"), wrapped(F.col(lon)).alias("px"), F.col(lat).alias("py"))
    p = p.withColumn("_r", row(F.col("py"))).withColumn("_c", col(F.col("px"), F.col("_r"))).withColumn("_s", F.pmod(F.xxhash64("point_id"), F.lit(salt)))
    s = sites.where(valid_position(F.col("longitude"), F.col("latitude"))).select(F.col(site_id).cast("int").alias("site_id"), wrapped(F.col("longitude")).alias("sx"), F.col("latitude").alias("sy"))
    s = s.withColumn("_r", F.explode(F.sequence(row(F.col("sy") - dlat), row(F.col("sy") + dlat))))
    s = s.withColumn("_mid", F.floor((F.col("sx") + 180) / 360 * ncol(F.col("_r"))))
    s = s.withColumn("_c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_mid") + d, ncol(F.col("_r")))))))
    s = s.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))).drop("_mid")
    h = F.pow(F.sin(F.radians(F.col("sy") - F.col("py")) / 2), 2) + F.cos(F.radians("sy")) * F.cos(F.radians("py")) * F.pow(F.sin(F.radians(F.col("sx") - F.col("px")) / 2), 2)
    return (
        p.join(s, ["_r", "_c", "_s"])
        .where(2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))) <= radius_km)
        .select("point_id", F.lit("station").alias("site_kind"), "site_id")
    )


#: Finest cells of the region join are 360 / 2**FINEST degrees wide.
FINEST = 20


def containing_regions_join(points: DataFrame, point_id: str, triangles: DataFrame, *, lon: str = "longitude", lat: str = "latitude", salt: int = 16) -> DataFrame:
    """The region of each point for triangles of any number: an equi-join on cells of a hierarchy, nothing broadcast.

    A triangle is filed at the level whose cells are just larger than its box, so
    in at most four cells; a point is looked up in its cell of every level that
    occurs.  Points are salted, so a crowded cell is spread over ``salt`` tasks.
    """
    t = triangles.withColumns({"_x0": F.least("x1", "x2", "x3"), "_x1": F.greatest("x1", "x2", "x3"), "_y0": F.least("y1", "y2", "y3"), "_y1": F.greatest("y1", "y2", "y3")})
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9))
    t = t.withColumn("_l", F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / extent)))).cast("int"))
    cell = lambda v, level: F.floor(v * F.pow(F.lit(2.0), level) / 360.0)
    levels = [r[0] for r in t.select("_l").distinct().collect()]  # at most FINEST + 1 numbers
    t = t.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x0"), F.col("_l")), cell(F.col("_x1"), F.col("_l"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0"), F.col("_l")), cell(F.col("_y1"), F.col("_l")))))
    t = t.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    p = points.where(valid_position(F.col(lon), F.col(lat))).select(F.col(point_id).cast("long").alias("point_id"), F.monotonically_increasing_id().alias("_row"), wrapped(F.col(lon)).alias("_px"), F.col(lat).alias("_py"))
    # rings that cross the date line are unwrapped, so every point is looked up at its place and a turn to both sides
    p = p.withColumn("px", F.explode(F.array(F.col("_px") - 360, F.col("_px"), F.col("_px") + 360))).withColumn("_l", F.explode(F.lit(levels).cast("array<int>")))
    p = p.withColumns({"_cx": cell(F.col("px"), F.col("_l")), "_cy": cell(F.col("_py"), F.col("_l")), "_s": F.pmod(F.xxhash64("point_id"), F.lit(salt))})
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("_py") - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (F.col("px") - F.col(f"x{i}")) >= 0
    hit = p.join(t, ["_l", "_cx", "_cy", "_s"]).where(side(1, 2) & side(2, 3) & side(3, 1))
    inside = hit.groupBy("point_id", "_row", "region_id").agg(F.max("is_hole").alias("_hole")).where("not _hole")
    return inside.groupBy("point_id", "_row").agg(F.min("region_id").alias("site_id")).select("point_id", F.lit("region").alias("site_kind"), F.col("site_id").cast("int").alias("site_id"))
