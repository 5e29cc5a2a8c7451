"""The map: a grid of exact base cells, rolled up by zoom, and points in detail.

Coordinates are integers in thousandths of a degree, so cells are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 5
# Side of a cell, in thousandths of a degree, by zoom; from DETAIL on, points.
SIDES = {5: 500, 6: 250, 7: 200, 8: 100, 9: 50, 10: 25, 11: 20, 12: 10, 13: 5}
DETAIL, MOST = 14, 2000


def side(zoom: int) -> int:
    return SIDES[min(max(zoom, 5), 13)]


def base_cells(points: DataFrame) -> DataFrame:
    """lat_idx, lon_idx, addresses, entities, lat_sum, lon_sum of placed, unmerged points."""
    live = points.filter("merged_into_id is null and lat is not null and lon is not null")
    idx = lambda c: F.floor(F.col(c) / BASE).cast("long")
    return live.groupBy(idx("lat").alias("lat_idx"), idx("lon").alias("lon_idx")).agg(F.count("*").alias("addresses"), F.sum("degree").alias("entities"), F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum"))


def clusters(cells: DataFrame, zoom: int, box: tuple[int, int, int, int] | None = None, most: int = MOST) -> DataFrame:
    """Base cells in box (south, west, north, east) rolled up to the zoom's cells, fullest first."""
    k = side(zoom) // BASE
    if box:
        check_box(box)
        s, w, n, e = (v // BASE for v in box)
        cells = cells.filter(F.col("lat_idx").between(s, n) & F.col("lon_idx").between(w, e))
    up = lambda c: F.floor(F.col(c) / k).cast("long")
    rolled = cells.groupBy(up("lat_idx").alias("lat_idx"), up("lon_idx").alias("lon_idx")).agg(*[F.sum(c).alias(c) for c in ("addresses", "entities", "lat_sum", "lon_sum")])
    rolled = rolled.select("lat_idx", "lon_idx", "addresses", "entities", F.round(F.col("lat_sum") / F.col("addresses"), 6).alias("lat"), F.round(F.col("lon_sum") / F.col("addresses"), 6).alias("lon"))
    return rolled.orderBy(F.col("addresses").desc(), "lat_idx", "lon_idx").limit(most)


def cluster_page(cells: DataFrame, zoom: int, box: tuple[int, int, int, int] | None = None, most: int = MOST) -> DataFrame:
    """clusters() with truncated on every row: whether as many came as can, so that others may be missing."""
    shown = clusters(cells, zoom, box, most)
    return shown.crossJoin(F.broadcast(shown.agg((F.count("*") >= most).alias("truncated"))))


def check_box(box: tuple[int, int, int, int]) -> None:
    s, w, n, e = box
    if not (s < n and w < e) or n - s > 20_000 or e - w > 20_000:
        raise ValueError("a box has a south below its north, a west below its east, and sides of at most 20 degrees")


def points_in(points: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Exact coordinates in box: how many addresses and entities, and a label."""
    s, w, n, e = box
    live = points.filter("merged_into_id is null").filter(F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return live.groupBy("lat", "lon").agg(F.count("*").alias("addresses"), F.coalesce(F.sum("degree"), F.lit(0)).alias("entities"), F.min("label").alias("label"))


def at_zoom(points: DataFrame, cells: DataFrame, zoom: int, box: tuple[int, int, int, int], most: int = MOST) -> DataFrame:
    """Clusters, or from DETAIL on points, unless there are more than most: then the finest grid."""
    check_box(box)
    if zoom >= DETAIL:
        detail = points_in(points, box)
        if detail.limit(most + 1).count() <= most:
            return detail
    return clusters(cells, zoom, box, most)


def coverage(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("all_points"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("placed"))
