"""The nineteen suitability factors and their weights.

A factor maps one row of measurements to a score in [0, 1]. A missing
measurement never zeroes a factor: each one names its own fallback, so a
built-in score is never NULL. Factors expect rows from ``with_measurements``,
which makes NaN and absent columns NULL once, ahead of all of them.

Keep the expressions small. A stage compiles to one method, and the JVM does not
optimise methods above 8 000 bytes: factors read plain columns and repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scalar import ENERGY_TYPES, cases, measured

NEUTRAL = 0.5


# The measurements that the factors read, and their types.
MEASUREMENTS = {
    "ghi_kwh_m2_day": "double", "wind_speed_ms": "double", "avg_temp_c": "double", "cloud_fraction": "double",
    "precipitation_mm_day": "double", "elevation_m": "double", "slope_degrees": "double", "head_m": "double",
    "discharge_m3s": "double", "earthquake_density": "double", "direction_consistency": "double",
    "roughness_length_m": "double", "watershed_ndvi": "double", "heat_flow_mwm2": "double",
    "fault_distance_km": "double", "grid_distance_km": "double", "road_distance_km": "double", "flood_zone": "string",
    "flood_probability": "double", "in_protected_area": "boolean", "protected_area_distance_km": "double",
}


def with_measurements(df: DataFrame) -> DataFrame:
    """Rows with every measurement column: NaN becomes NULL, an absent column is all NULL."""
    have = set(df.columns)
    return df.withColumns({
        name: F.lit(None).cast(kind) if name not in have else
        measured(F.col(name).cast(kind)) if kind == "double" else F.col(name)
        for name, kind in MEASUREMENTS.items()})


def _reading(name: str) -> Column:
    return F.col(name)


def _share(x: Column) -> Column:
    """A reading that is a score already: clipped to [0, 1], neutral when missing."""
    return cases((x.isNull(), F.lit(NEUTRAL)), (x <= 0, F.lit(0.0)), (x >= 1, F.lit(1.0)), otherwise=F.coalesce(x, F.lit(NEUTRAL)))


def _steps(x: Column, bounds: tuple[tuple[float, float], ...], top: float, closed: bool = False) -> Column:
    """Score of the first bound above ``x`` (``closed``: at or above), else ``top``."""
    rows = [((x <= b) if closed else (x < b), F.lit(score)) for b, score in bounds]
    return cases((x.isNull(), F.lit(NEUTRAL)), *rows, otherwise=F.lit(top))


def _with_estimate(x: Column, estimates: tuple, table: tuple[tuple[float, float], ...], top: float,
                   closed: bool = False) -> Column:
    """Score of a reading; a missing one is estimated by rules (condition, value), the last without condition.

    The estimates are constants, so their scores are looked up here and not per row.
    """
    def constant(value: float) -> Column:
        hits = (score for bound, score in table if (value <= bound if closed else value < bound))
        return F.lit(next(hits, top))

    *rules, (_, last) = estimates
    estimated = cases(*[(condition, constant(value)) for condition, value in rules], otherwise=constant(last))
    return F.when(x.isNull(), estimated).otherwise(_steps(x, table, top, closed))


def land_cover() -> Column:
    # No land-cover model is attached to the measurements, so every site is neutral.
    return F.lit(NEUTRAL)


def terrain_slope() -> Column:
    return _share(1.0 - _reading("slope_degrees") / 15.0)


def terrain_elevation() -> Column:
    h = _reading("elevation_m")
    return cases(
        (h.isNull(), F.lit(NEUTRAL)), (h < 0, F.lit(0.0)), (h < 10, F.lit(0.3)), (h < 100, F.lit(0.7)),
        (h <= 2000, F.lit(1.0)), (h <= 3000, F.lit(0.6)), otherwise=F.lit(0.3),
    )


def solar_irradiance() -> Column:
    north = F.abs(F.col("lat"))
    by_latitude = ((north <= 25, 6.0), (north <= 35, 5.5), (north <= 45, 4.5), (north <= 55, 3.5), (None, 2.5))
    table = ((2.0, 0.1), (3.0, 0.3), (4.0, 0.5), (5.0, 0.7), (6.0, 0.85))
    return _with_estimate(_reading("ghi_kwh_m2_day"), by_latitude, table, 1.0, closed=True)


def cloud_coverage() -> Column:
    return _share(1.0 - _reading("cloud_fraction"))


def temperature_effect() -> Column:
    t = _reading("avg_temp_c")
    return F.coalesce(cases(
        (t < -10, F.lit(0.3)),
        (t < 10, 0.6 + 0.4 * (t + 10.0) / 20.0),
        (t <= 25, F.lit(1.0)),
        (t <= 35, 1.0 - 0.2 * (t - 25.0) / 10.0),
        (t <= 45, 0.8 - 0.3 * (t - 35.0) / 10.0),
        (t > 45, F.lit(0.3)),
    ), F.lit(NEUTRAL))


def wind_speed() -> Column:
    north = F.abs(F.col("lat"))
    by_latitude = ((north < 25, 4.5), (north < 35, 5.5), (north <= 55, 7.0), (None, 6.0))
    table = ((3.0, 0.0), (4.0, 0.1), (5.0, 0.3), (6.0, 0.5), (7.0, 0.7), (9.0, 0.9))
    return _with_estimate(_reading("wind_speed_ms"), by_latitude, table, 1.0)


def wind_direction_consistency() -> Column:
    return _share(_reading("direction_consistency"))


def terrain_roughness() -> Column:
    z0 = _reading("roughness_length_m")
    return _steps(z0, ((0.001, 1.0), (0.03, 0.9), (0.1, 0.8), (0.3, 0.5), (1.0, 0.2)), 0.1, closed=True)


def water_flow() -> Column:
    q = _reading("discharge_m3s")
    return cases(
        (q.isNull(), F.lit(NEUTRAL)), (q <= 0, F.lit(0.0)), (q < 1, F.lit(0.2)), (q < 10, F.lit(0.5)),
        (q < 100, F.lit(0.8)), otherwise=F.lit(1.0),
    )


def elevation_drop() -> Column:
    return _steps(_reading("head_m"), ((2.0, 0.1), (10.0, 0.4), (50.0, 0.7), (200.0, 0.9)), 1.0)


def watershed_health() -> Column:
    ndvi, rain = _reading("watershed_ndvi"), _reading("precipitation_mm_day")
    return F.coalesce(cases(
        (ndvi >= 0.6, F.lit(1.0)),
        (ndvi >= 0.3, 0.4 + (ndvi - 0.3) / 0.3 * 0.6),
        (ndvi.isNotNull(), F.lit(0.2)),
        (rain >= 5, F.lit(0.95)), (rain >= 3, F.lit(0.8)), (rain >= 1.5, F.lit(0.6)), (rain >= 0.5, F.lit(0.4)),
        (rain.isNotNull(), F.lit(0.2)),
    ), F.lit(NEUTRAL))


def heat_flow() -> Column:
    q = _reading("heat_flow_mwm2")
    return _steps(q, ((40.0, 0.0), (65.0, 0.2), (80.0, 0.4), (120.0, 0.7), (200.0, 0.9)), 1.0)


def fault_proximity() -> Column:
    return _steps(_reading("fault_distance_km"), ((1.0, 1.0), (5.0, 0.8), (15.0, 0.5), (50.0, 0.2)), 0.05)


def seismic_activity() -> Column:
    density = _reading("earthquake_density")
    return _steps(density, ((0.0, 0.2), (5.0, 0.5), (20.0, 0.8), (50.0, 1.0)), 0.7, closed=True)


def grid_proximity() -> Column:
    km = _reading("grid_distance_km")
    return _steps(km, ((1.0, 1.0), (5.0, 0.85), (15.0, 0.6), (30.0, 0.35), (50.0, 0.15)), 0.05)


def road_access() -> Column:
    return _steps(_reading("road_distance_km"), ((0.5, 1.0), (2.0, 0.8), (5.0, 0.6), (15.0, 0.3)), 0.1)


def flood_risk() -> Column:
    zone = F.upper(F.trim(F.col("flood_zone")))
    return cases(
        (zone.isin("X", "X500_SHADED"), F.lit(0.9)),
        (zone == "X500", F.lit(0.7)),
        (zone.isin("A", "AE", "AO", "AH"), F.lit(0.2)),
        (zone.isin("V", "VE"), F.lit(0.0)),
        (zone.isNotNull(), F.lit(NEUTRAL)),
        otherwise=_share(1.0 - _reading("flood_probability")),
    )


def protected_area() -> Column:
    inside = F.coalesce(F.col("in_protected_area"), F.lit(False))
    km = _reading("protected_area_distance_km")
    return F.when(inside, F.lit(0.0)).otherwise(_steps(km, ((1.0, 0.3), (5.0, 0.7)), 1.0))


@dataclass(frozen=True)
class Factor:
    """One catalog entry: how to compute a score and where it applies."""

    key: str
    name: str
    energy_types: tuple[str, ...]
    weight: float
    score: Callable[[], Column]

    def applies_to(self, energy_type: str) -> bool:
        return "all" in self.energy_types or energy_type in self.energy_types


# Factor names, the energy types they serve and their default weights.
CATALOG: tuple[Factor, ...] = (
    Factor("land_cover", "Land Cover", ("all",), 1.5, land_cover),
    Factor("terrain_slope", "Terrain Slope", ("all",), 1.0, terrain_slope),
    Factor("terrain_elevation", "Terrain Elevation", ("all",), 0.5, terrain_elevation),
    Factor("solar_irradiance", "Solar Irradiance", ("solar",), 2.0, solar_irradiance),
    Factor("cloud_coverage", "Cloud Coverage", ("solar",), 1.0, cloud_coverage),
    Factor("temperature_effect", "Temperature Effect", ("solar",), 0.5, temperature_effect),
    Factor("wind_speed", "Wind Speed", ("wind",), 2.0, wind_speed),
    Factor("wind_direction_consistency", "Wind Direction Consistency", ("wind",), 0.8, wind_direction_consistency),
    Factor("terrain_roughness", "Terrain Roughness", ("wind",), 0.8, terrain_roughness),
    Factor("water_flow", "Water Flow", ("hydro",), 2.0, water_flow),
    Factor("elevation_drop", "Elevation Drop", ("hydro",), 1.5, elevation_drop),
    Factor("watershed_health", "Watershed Health", ("hydro",), 0.8, watershed_health),
    Factor("heat_flow", "Heat Flow", ("geothermal",), 2.0, heat_flow),
    Factor("fault_proximity", "Fault Proximity", ("geothermal",), 1.5, fault_proximity),
    Factor("seismic_activity", "Seismic Activity", ("geothermal",), 1.0, seismic_activity),
    Factor("grid_proximity", "Grid Proximity", ("all",), 1.5, grid_proximity),
    Factor("road_access", "Road Access", ("all",), 0.8, road_access),
    Factor("flood_risk", "Flood Risk", ("all",), 1.0, flood_risk),
    Factor("protected_area", "Protected Area", ("all",), 1.2, protected_area),
)

# Weight of each factor per energy type.
TYPE_WEIGHTS: dict[str, dict[str, float]] = {
    "solar": {
        "Land Cover": 1.5, "Terrain Slope": 1.2, "Terrain Elevation": 0.4,
        "Solar Irradiance": 2.5, "Cloud Coverage": 1.2, "Temperature Effect": 0.6,
        "Grid Proximity": 1.5, "Road Access": 0.8, "Flood Risk": 1.0, "Protected Area": 1.2,
    },
    "wind": {
        "Land Cover": 1.0, "Terrain Slope": 0.6, "Terrain Elevation": 0.5,
        "Wind Speed": 2.5, "Wind Direction Consistency": 1.0, "Terrain Roughness": 1.2,
        "Grid Proximity": 1.5, "Road Access": 1.0, "Flood Risk": 0.8, "Protected Area": 1.2,
    },
    "hydro": {
        "Land Cover": 0.8, "Terrain Slope": 0.3, "Terrain Elevation": 0.3,
        "Water Flow": 2.5, "Elevation Drop": 2.0, "Watershed Health": 1.0,
        "Grid Proximity": 1.5, "Road Access": 0.8, "Flood Risk": 0.5, "Protected Area": 1.5,
    },
    "geothermal": {
        "Land Cover": 0.8, "Terrain Slope": 0.5, "Terrain Elevation": 0.4,
        "Heat Flow": 2.5, "Fault Proximity": 1.8, "Seismic Activity": 1.2,
        "Grid Proximity": 1.5, "Road Access": 1.0, "Flood Risk": 0.8, "Protected Area": 1.2,
    },
}


def default_weights(energy_type: str) -> dict[str, float]:
    """Weight table of one energy type; an unknown type raises ``KeyError``."""
    return dict(TYPE_WEIGHTS[energy_type])


def catalog_frame(spark: SparkSession) -> DataFrame:
    """Catalog rows (position, factor, energy_types, class weight)."""
    rows = [(i, f.key, f.name, list(f.energy_types), f.weight) for i, f in enumerate(CATALOG)]
    return spark.createDataFrame(
        rows, "position int, factor_key string, factor string, energy_types array<string>, class_weight double")


def weights_frame(spark: SparkSession) -> DataFrame:
    """Weight rows (energy_type, factor, weight)."""
    rows = [(t, name, w) for t in ENERGY_TYPES for name, w in TYPE_WEIGHTS[t].items()]
    return spark.createDataFrame(rows, "energy_type string, factor string, weight double")
