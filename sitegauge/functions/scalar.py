"""Column builders: rounding, parsing, bands, grid cells, regions, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

ENERGY_TYPES = ("solar", "wind", "hydro", "geothermal")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cases(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """``CASE WHEN`` from (condition, result) pairs; the first match wins."""
    chain = None
    for condition, result in branches:
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(otherwise)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip to [lo, hi]. NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def measured(x: Column) -> Column:
    """NaN counts as missing: Spark orders it above every number."""
    return F.when(~F.isnan(x), x)


def report_round(x: Column | str, digits: int) -> Column:
    """Half-even rounding of the decimal value: float noise is cleared first, so ties are ties."""
    return F.bround(F.round(as_col(x), 9), digits)


# -- random order -----------------------------------------------------------

def hash_order(key: Column, seed: object = 42) -> Column:
    """Reproducible uniform integer in [0, 2^32) for a row key."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: object = 42) -> Column:
    return hash_order(key, seed) / F.lit(4294967296.0)


# -- strings ----------------------------------------------------------------

def safe_double(x: Column, default: float = 0.0) -> Column:
    """Number from text; missing or unreadable text gives ``default``."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


# Tag keys that carry an electrical output, in order of preference.
CAPACITY_KEYS = ("plant:output:electricity", "generator:output:electricity")


def capacity_number(text: Column) -> Column:
    """Digits in front of the first MW / mw; the unit itself is not interpreted."""
    head = F.substring_index(F.substring_index(text, "MW", 1), "mw", 1)
    digits = F.regexp_replace(head, "[^0-9.]", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def parse_capacity(tags: Column) -> Column:
    """Capacity in MW from a tag map, 0.0 when no key yields a number."""
    readings = [capacity_number(F.try_element_at(tags, F.lit(key))) for key in CAPACITY_KEYS]
    return F.coalesce(*readings, F.lit(0.0))


def year4(x: Column) -> Column:
    """Four-digit year as int, else NULL."""
    return F.when(x.rlike("^[0-9]{4}$"), x.try_cast("int"))


# -- bands ------------------------------------------------------------------

BAND_DIGITS = 9   # a weighted mean is exact to some fifteen digits; its last bit must not choose the band


def confidence_band(score: Column) -> Column:
    score = F.round(score, BAND_DIGITS)
    return cases((score > 0.7, F.lit("high")), (score > 0.4, F.lit("moderate")), otherwise=F.lit("low"))


def event_risk_band(probability: Column) -> Column:
    return cases((probability > 0.3, F.lit("High")), (probability > 0.1, F.lit("Medium")), otherwise=F.lit("Low"))


def risk_gauge_band(score: Column) -> Column:
    score = F.round(score, BAND_DIGITS)
    return cases((score < 0.3, F.lit("lightgreen")), (score < 0.6, F.lit("gold")), otherwise=F.lit("salmon"))


def ml_verdict(probability: Column) -> Column:
    return cases((probability > 0.8, F.lit("resembles known sites")),
                 (probability < 0.3, F.lit("does not resemble known sites")),
                 otherwise=F.lit(None).cast("string"))


# -- grid cells -------------------------------------------------------------

def cell_round(x: Column, size: float = 1.0) -> Column:
    """Nearest cell, ties to even."""
    return F.bround(x / F.lit(size), 0).cast("bigint")


def cell_trunc(x: Column, size: float = 1.0) -> Column:
    """Truncation toward zero: the cells around zero are twice as wide."""
    return (x / F.lit(size)).cast("bigint")


def cell_floor(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("bigint")


def cell_key(lat_cell: Column, lon_cell: Column) -> Column:
    return F.concat_ws("_", lat_cell.cast("string"), lon_cell.cast("string"))


# -- regions ----------------------------------------------------------------

# Continent boxes as (name, lat_min, lat_max, lon_min, lon_max);
# bounds inclusive, the first box that contains the point wins.
CONTINENT_BOXES = (
    ("North America", 15.0, 72.0, -170.0, -50.0),
    ("South America", -56.0, 15.0, -82.0, -34.0),
    ("Europe", 35.0, 72.0, -25.0, 45.0),
    ("Africa", -35.0, 37.0, -18.0, 52.0),
    ("Middle East", 12.0, 42.0, 25.0, 63.0),
    ("Central Asia", 35.0, 55.0, 45.0, 90.0),
    ("South Asia", 5.0, 38.0, 60.0, 98.0),
    ("East Asia", 18.0, 55.0, 73.0, 150.0),
    ("Southeast Asia", -11.0, 24.0, 95.0, 153.0),
    ("Oceania", -48.0, -8.0, 110.0, 180.0),
)


def region_boxes(lat: Column, lon: Column) -> Column:
    inside = [(lat.between(s, n) & lon.between(w, e), F.lit(name)) for name, s, n, w, e in CONTINENT_BOXES]
    return cases(*inside, otherwise=F.lit("Other"))


def _between(x: Column, lo: float, hi: float) -> Column:
    return (x > lo) & (x < hi)


def region_rules(lat: Column, lon: Column) -> Column:
    """Continents for facilities. Only southern bounds exist, which is part of the rule."""
    return cases(
        ((lat > 15) & _between(lon, -170, -50), F.lit("North America")),
        ((lat > -55) & _between(lon, -82, -34), F.lit("South America")),
        ((lat > 35) & _between(lon, -25, 45), F.lit("Europe")),
        ((lat > -35) & _between(lon, -20, 55), F.lit("Africa")),
        ((lat > -47) & (lon > 110), F.lit("Oceania")),
        otherwise=F.lit("Asia"),
    )


def region_rules_negative(lat: Column, lon: Column) -> Column:
    """Continents for sampled negatives, with northern bounds."""
    return cases(
        ((lat > 15) & _between(lon, -170, -50), F.lit("North America")),
        (_between(lat, -55, 15) & _between(lon, -82, -34), F.lit("South America")),
        ((lat > 35) & _between(lon, -25, 45), F.lit("Europe")),
        (_between(lat, -35, 37) & _between(lon, -20, 55), F.lit("Africa")),
        ((lat < -10) & (lon > 110), F.lit("Oceania")),
        otherwise=F.lit("Asia"),
    )


def is_land_rough(lat: Column, lon: Column) -> Column:
    """Crude land test: no polar latitudes, no far southern ocean."""
    polar = (lat < -60) | (lat > 75)
    southern_ocean = _between(lat, -60, -40) & ((lon < -70) | (lon > 150))
    return ~(polar | southern_ocean)


def is_land_sampled(lat: Column, lon: Column, uniform: Column) -> Column:
    """Crude land test that keeps only 30 % of the sparsely settled far north."""
    southern_ocean = _between(lat, -55, -35) & _between(lon, -180, -60)
    far_north = (lat > 60) & (_between(lon, -180, -90) | _between(lon, 30, 180))
    return ~southern_ocean & (~far_north | (uniform <= 0.3))


# -- distance ---------------------------------------------------------------

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Plain Euclidean distance in degrees; longitudes are not wrapped."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))
