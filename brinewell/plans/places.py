"""Problem 3: stations close to each reading and the sea region around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.geo import near_sites
from ..sources.tables import table

RADIUS_KM = 25.0


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_sites(
        table(spark, folder, "observations"),
        "obs_id",
        stations=table(spark, folder, "stations"),
        regions=table(spark, folder, "sea_regions"),
        radius_km=RADIUS_KM,
    )


QUERIES = {"p3_found": p3_found}

ORACLES = {
    "p3_found": """
WITH p AS (
  SELECT obs_id, CASE WHEN longitude > 180 THEN longitude - 360 ELSE longitude END AS lon, latitude AS lat
  FROM observations WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360
), s AS (
  SELECT station_id, longitude AS lon, latitude AS lat FROM stations WHERE longitude IS NOT NULL AND latitude IS NOT NULL
), near AS (
  SELECT obs_id, 'station' AS site_kind, station_id AS site_id FROM p JOIN s ON abs(p.lat - s.lat) < 0.23
  WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2)
        + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= 25.0
), r AS (
  SELECT region_id, ring_no, is_hole, list_max([v.lon FOR v IN ring]) - list_min([v.lon FOR v IN ring]) > 180 AS seam, ring
  FROM sea_regions
), v AS (
  SELECT region_id, ring_no, is_hole, len(ring) AS n, seam, unnest(generate_series(1, len(ring))) AS i, ring FROM r
), e AS (
  SELECT region_id, ring_no, is_hole, seam,
         CASE WHEN seam AND ring[i].lon < 0 THEN ring[i].lon + 360 ELSE ring[i].lon END AS x1, ring[i].lat AS y1,
         CASE WHEN seam AND ring[i % n + 1].lon < 0 THEN ring[i % n + 1].lon + 360 ELSE ring[i % n + 1].lon END AS x2, ring[i % n + 1].lat AS y2
  FROM v
), c AS (
  SELECT obs_id, region_id, ring_no, is_hole, count(*) % 2 AS odd
  FROM p JOIN e ON (y1 > lat) <> (y2 > lat)
  WHERE CASE WHEN seam AND lon < 0 THEN lon + 360 ELSE lon END < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  GROUP BY ALL
), inside AS (
  SELECT obs_id, region_id FROM c GROUP BY obs_id, region_id HAVING max(CASE WHEN NOT is_hole THEN odd ELSE 0 END) = 1 AND max(CASE WHEN is_hole THEN odd ELSE 0 END) = 0
)
SELECT obs_id, site_kind, site_id FROM near
UNION ALL SELECT obs_id, 'region', min(region_id) FROM inside GROUP BY obs_id
""",
}
