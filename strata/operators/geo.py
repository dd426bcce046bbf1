"""Geo operators: GeoJSON features and grid marker clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up


def points_geojson(df: DataFrame, lat: str, lon: str, props: Sequence[str],
                   value: str | None = None, digits: int = 2) -> DataFrame:
    """One GeoJSON ``Feature`` string per row (``to_json(struct)``, JVM side);
    write the column as JSON lines for a FeatureCollection."""
    properties = [F.col(p) for p in props]
    if value:
        properties.append(round_half_up(value, digits).alias(value))
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
        .alias("geometry"),
        F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feat).alias("feature"))


def geo_cluster(df: DataFrame, lat: str, lon: str, cell_deg: float, value: str | None = None,
                digits: int = 6) -> DataFrame:
    """Marker clustering re-aimed as a grid: points grouped by
    ``floor(lat / cell), floor(lon / cell)`` with count and centroid."""
    keys = [F.floor(F.col(lat) / cell_deg).alias("cell_lat"), F.floor(F.col(lon) / cell_deg).alias("cell_lon")]
    aggs = [F.count(F.lit(1)).alias("n"), round_half_up(F.avg(lat), digits).alias("centroid_lat"),
            round_half_up(F.avg(lon), digits).alias("centroid_lon")]
    if value:
        aggs.append(round_half_up(F.sum(value), digits).alias(f"sum_{value}"))
    return df.groupBy(*keys).agg(*aggs)
