"""Origin-destination distances.

Areas are administrative codes, so the area tables have a size fixed by geography and not by the
number of episodes. The distance matrix is by definition one row per (home area, facility area).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.functions.geo import haversine_km, normalize_area_code


def area_coordinates(geo: DataFrame, code_col: str = "code_full") -> DataFrame:
    """(area_id, lat, lon) from the coordinate file with check digits."""
    return geo.select(normalize_area_code(code_col).alias("area_id"), "lat", "lon")


def area_distances(
    origins: DataFrame,
    destinations: DataFrame,
    coordinates: DataFrame,
    origin_col: str = "area_id",
    destination_col: str = "facility_area_id",
) -> DataFrame:
    """(area_id, facility_area_id, km) for every distinct home area and facility area.

    Only areas with coordinates take part. The located destinations travel as one array (at most one
    entry per area code), so each home area expands its own row of the matrix in place.
    """
    home = (
        origins.select(F.col(origin_col).alias("area_id"))
        .distinct()
        .join(coordinates, "area_id")
    )
    there = (
        destinations.select(F.col(destination_col).alias("area_id"))
        .distinct()
        .join(coordinates, "area_id")
        .agg(F.collect_list(F.struct(F.col("area_id").alias("id"), "lat", "lon")))
        .scalar()
    )
    return home.select("area_id", "lat", "lon", F.explode(there).alias("to")).select(
        "area_id",
        F.col("to.id").alias("facility_area_id"),
        haversine_km(F.col("lat"), F.col("lon"), F.col("to.lat"), F.col("to.lon")).alias("km"),
    )


def facility_distances(distances: DataFrame, facility_areas: DataFrame) -> DataFrame:
    """(area_id, facility_id, km): area distances carried over to the facilities of each area.

    A facility seen in two areas counts with its smallest distance. ``facility_areas`` is any table
    with (facility_id, facility_area_id).
    """
    places = facility_areas.select("facility_id", "facility_area_id").dropna().distinct()
    return (
        distances.join(places, "facility_area_id")
        .groupBy("area_id", "facility_id")
        .agg(F.min("km").alias("km"))
    )


def add_overflow_distance(
    od: DataFrame,
    facility: int = fv.OVERFLOW_FACILITY,
    km: float = fv.OVERFLOW_KM,
    areas: DataFrame | None = None,
) -> DataFrame:
    """Add the overflow facility, at a prohibitive distance from every area.

    ``areas`` is any table with area_id, such as the demand: its areas without coordinates, which have no distance to
    any real facility, can then reach the overflow facility at least. A distance that is already there stays.
    """
    there = od.select("area_id", "facility_id", "km")
    known = there.select("area_id")
    if areas is not None:
        known = known.unionByName(areas.select("area_id").where("area_id is not null"))
    overflow = known.distinct().select(
        "area_id",
        F.lit(facility).cast(od.schema["facility_id"].dataType).alias("facility_id"),
        F.lit(float(km)).alias("km"),
    )
    done = there.where(F.col("facility_id") == facility).select("area_id")
    return there.unionByName(overflow.join(done, "area_id", "left_anti"))


def restrict_od(
    od: DataFrame,
    demand: DataFrame,
    facilities: DataFrame,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> DataFrame:
    """Keep areas that have demand and facilities that occur in the data (or the overflow one)."""
    kept = od.join(demand.select("area_id").distinct(), "area_id", "left_semi")
    known = facilities.select("facility_id").distinct()
    real = kept.where(F.col("facility_id") != overflow).join(known, "facility_id", "left_semi")
    return real.select("area_id", "facility_id", "km").unionByName(
        kept.where(F.col("facility_id") == overflow).select("area_id", "facility_id", "km")
    )
