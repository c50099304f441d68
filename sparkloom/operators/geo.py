"""Nearest documents by distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIUS_KM = 6371.0087714


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """On the plane that touches the mean latitude; longitudes go the short way round."""
    dlon = F.abs(lon2 - lon1)
    x = F.radians(F.least(dlon, 360 - dlon)) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return RADIUS_KM * F.sqrt(x * x + y * y)


def nearest(docs: DataFrame, lon: float, lat: float, exclude: list[str] | None = None) -> DataFrame:
    """Documents with a point, and ``distance_km`` of their nearest one."""
    far = F.array_min(F.transform("geo_point", lambda p: distance_km(F.lit(lon), F.lit(lat), p["lon"], p["lat"])))
    rows = docs.where(F.size("geo_point") > 0)
    if exclude:
        rows = rows.where(~F.col("_id").isin(exclude))
    return rows.withColumn("distance_km", far)


def nearest_pairs(points: DataFrame, within_km: float, k: int | None = None) -> DataFrame:
    """(a, b, distance_km) of all pairs of ``points`` (_id, lon, lat) within a
    distance, each way; the ``k`` nearest of each on request.

    An equi-join of grid cells: each point meets those of its own and the adjacent
    cells of its band of latitude and those next to it. A cell is as wide in
    degrees as the distance is at the band's greatest latitude."""
    dlat = within_km / RADIUS_KM * 180 / math.pi * 1.000001
    band = F.floor(F.col("lat") / dlat)
    #: The mean latitude of two points within reach is within a band of either's.
    top = lambda b: F.least(F.greatest(F.abs(b * dlat), F.abs((b + 1) * dlat)) + 2 * dlat, F.lit(89.9))
    n_cells = lambda b: F.greatest(F.floor(360 / (dlat / F.cos(F.radians(top(b))))), F.lit(1))
    cell = lambda lon, b: F.pmod(F.floor((lon + 180) * n_cells(b) / 360), n_cells(b))
    left = points.select(F.col("_id").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), band.alias("band")).withColumn("cell", cell(F.col("lon1"), F.col("band")))
    right = points.select(
        F.col("_id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.explode(F.array(band - 1, band, band + 1)).alias("band")
    ).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"))
    right = right.withColumn("cell", F.pmod(cell(F.col("lon2"), F.col("band")) + F.col("step"), n_cells(F.col("band")))).drop("step").distinct()
    met = left.join(right, ["band", "cell"]).where("a <> b")
    out = met.select("a", "b", distance_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("distance_km")).where(F.col("distance_km") <= within_km)
    if k is None:
        return out
    w = W.partitionBy("a").orderBy("distance_km", "b")
    return out.withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= k).drop("k__")
