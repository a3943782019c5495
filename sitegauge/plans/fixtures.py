"""Domain tables derived from the given Parquet tables.

Each table is one SELECT in the dialect that Spark and DuckDB share, with
``{name}`` for the tables it reads, so both engines start from the same rows.
This is the only place that knows the names of the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")


def _lat(k: str) -> str:
    """Even keys spread over the globe, odd keys fill a dense box."""
    return (f"(CASE WHEN ({k})%2=0 THEN cast((({k})*7919)%12801 AS double)/1e2-56e0 "
            f"ELSE 30e0+cast((({k})*7919)%2001 AS double)/1e2 END)")


def _lon(k: str) -> str:
    return (f"(CASE WHEN ({k})%2=0 THEN cast((({k})*104729)%36001 AS double)/1e2-180e0 "
            f"ELSE -10e0+cast((({k})*104729)%4001 AS double)/1e2 END)")


def _reading(k: str, prime: int, modulus: int, lo: str, scale: str, null_every: int) -> str:
    return f"CASE WHEN {k}%{null_every}=0 THEN NULL ELSE {lo}+cast(({k}*{prime})%{modulus} AS double)/{scale} END"


def _energy_type(k: str) -> str:
    return f"CASE ({k})%4 WHEN 0 THEN 'solar' WHEN 1 THEN 'wind' WHEN 2 THEN 'hydro' ELSE 'geothermal' END"


_MEASUREMENTS = {
    "ghi_kwh_m2_day": (37, 600, "1e0", "1e2", 7),
    "wind_speed_ms": (41, 900, "2e0", "1e2", 11),
    "avg_temp_c": (43, 7000, "-20e0", "1e2", 13),
    "cloud_fraction": (47, 130, "-1e-1", "1e2", 17),
    "precipitation_mm_day": (53, 700, "0e0", "1e2", 19),
    "elevation_m": (59, 4000, "-50e0", "1e0", 23),
    "slope_degrees": (61, 2000, "0e0", "1e2", 29),
    "head_m": (67, 30000, "0e0", "1e2", 31),
    "discharge_m3s": (71, 20000, "-5e0", "1e2", 37),
    "earthquake_density": (73, 7000, "-2e0", "1e2", 41),
    "direction_consistency": (79, 130, "-1e-1", "1e2", 43),
    "roughness_length_m": (83, 2000, "0e0", "1e3", 47),
    "watershed_ndvi": (89, 100, "0e0", "1e2", 3),
    "heat_flow_mwm2": (97, 25000, "20e0", "1e2", 53),
    "fault_distance_km": (101, 8000, "0e0", "1e2", 59),
    "grid_distance_km": (103, 7000, "0e0", "1e2", 61),
    "road_distance_km": (107, 2000, "0e0", "1e2", 67),
    "flood_probability": (109, 130, "-1e-1", "1e2", 2),
    "protected_area_distance_km": (113, 1000, "0e0", "1e2", 4),
}

_K = "c_custkey"
_ZONES = ["X", "x500 ", " AE", "V", "X500_SHADED", "ve", "A", "AO", "AH", "D"]
_ZONE_CASE = " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONES))
_TXT = "cast({} AS string)"

TABLES: dict[str, str] = {
    "sites": (
        f"SELECT {_K} AS site_id, {_lat(_K)} AS lat, {_lon(_K)} AS lon, "
        + ", ".join(f"{_reading(_K, *spec)} AS {name}" for name, spec in _MEASUREMENTS.items())
        + f", CASE {_K}%11 {_ZONE_CASE} END AS flood_zone"
        + f", CASE WHEN {_K}%5=0 THEN NULL ELSE {_K}%13=0 END AS in_protected_area"
        + f", {_energy_type(_K)} AS energy_type, cast({_K}%2 AS int) AS label FROM {{customer}}"),
    "locations": (
        f"SELECT o_orderkey AS loc_id, {_lat('o_custkey')} AS lat, {_lon('o_custkey')} AS lon, "
        f"{_energy_type('o_orderkey')} AS energy_type, "
        "CASE o_orderkey%3 WHEN 0 THEN 'global_file' WHEN 1 THEN 'eia_860' ELSE 'osm_overpass' END AS source, "
        "cast(o_orderkey%3 AS int) AS source_rank, 'plant ' || cast(o_orderkey AS string) AS name, "
        "o_totalprice/1e3 AS capacity_mw, CASE WHEN o_orderkey%5=0 THEN '' ELSE n_name END AS country_code, "
        "CASE WHEN o_orderkey%7=0 THEN '' ELSE cast(year(o_orderdate)+22 AS string) END AS operating_year "
        "FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey"),
    "embedded": (
        f"SELECT vec_id, {_lat('2*vec_id+1')} AS lat, {_lon('2*vec_id+1')} AS lon, {_energy_type('vec_id')} AS energy_type, "
        "cast(CASE WHEN label<5 THEN 1 ELSE 0 END AS int) AS label, "
        "cast((vec_id*37)%1000 AS double)/1e3 AS ml_score, 'N' || cast(vec_id%12 AS string) AS country_code FROM {embeddings}"),
    "vectors": "SELECT vec_id, embedding FROM {embeddings}",
    "quakes": (
        f"SELECT event_id AS quake_id, {_lat('event_id')} AS lat, {_lon('event_id')} AS lon, "
        "1e0+cast(event_id%50 AS double)/1e1 AS magnitude, ts FROM {events}"),
    "readings": (
        "SELECT event_id, user_id AS site_id, ts, CASE WHEN event_id%13=0 THEN -value "
        "WHEN event_id%17=0 THEN NULL ELSE value END AS discharge, value AS speed, "
        "cast(replace(replace(props,'{{\"k\": ',''),'}}','') AS double)*36e-1 AS direction_deg, event_type FROM {events}"),
    "heat_points": (
        f"SELECT event_id AS point_id, {_lat('event_id')} AS lat, {_lon('event_id')} AS lon, "
        "20e0+value AS heat_flow_mwm2 FROM {events}"),
    "scenes": (
        "SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) "
        "|| '-' || cast(l_suppkey AS string) AS scene_id, "
        f"{_lat('l_suppkey')} AS lat, {_lon('l_suppkey')} AS lon, l_suppkey AS tile, l_shipdate AS acquired, "
        "cast(quarter(l_shipdate) AS int) AS season, "
        "CASE WHEN l_partkey%17=0 THEN NULL ELSE l_quantity*2e0 END AS cloud FROM {lineitem}"),
    "places": (
        f"SELECT s_suppkey AS city_id, {_lat('s_suppkey')} AS lat, {_lon('s_suppkey')} AS lon, "
        "'C' || cast(s_nationkey AS string) AS country_code FROM {supplier}"),
    "predictions": (
        "SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) "
        "|| '-' || cast(l_suppkey AS string) AS row_id, "
        "cast((l_partkey*31+l_linenumber*17)%1000 AS double)/1e3 AS y_prob, "
        "cast(CASE WHEN (l_partkey*31+l_linenumber*17)%1000+(l_orderkey*13)%700>850 THEN 1 ELSE 0 END AS int) AS y_true, "
        "'R' || cast(l_suppkey%7 AS string) AS region FROM {lineitem}"),
    "class_pixels": (
        "SELECT cast(l_partkey%11 AS int) AS pred, "
        "cast(CASE WHEN l_linenumber<5 THEN l_partkey%11 ELSE l_suppkey%11 END AS int) AS label FROM {lineitem}"),
    "pred_pixels": (
        "SELECT o_orderkey%64 AS window_id, cast(floor(o_orderkey/64e0) AS bigint) AS pixel, "
        "cast(o_custkey%11 AS int) AS pred FROM {orders}"),
    "label_pixels": (
        "SELECT o_orderkey%64 AS window_id, cast(floor(o_orderkey/64e0) AS bigint) AS pixel, "
        "cast(CASE WHEN o_orderkey%5<4 THEN o_custkey%11 ELSE o_orderkey%11 END AS int) AS label, "
        "CASE WHEN o_orderkey%64%4=0 THEN 'val' ELSE 'train' END AS split "
        "FROM {orders} WHERE o_orderkey%10<>3"),
    "tagged": (
        "SELECT p_partkey AS id, p_size AS size, "
        "CASE p_partkey%5 WHEN 0 THEN cast(p_size AS string) || ' MW' WHEN 1 THEN cast(p_size AS string) || '.5mw' "
        "WHEN 2 THEN '1.2.3 MW' WHEN 3 THEN 'yes' ELSE '~' || cast(p_size AS string) || ' kW' END AS plant_output, "
        "CASE WHEN p_partkey%3=0 THEN NULL ELSE cast(p_size AS string) || ' MW' END AS generator_output, "
        "CASE p_partkey%9 WHEN 0 THEN 'solar' WHEN 1 THEN ' Wind ' WHEN 2 THEN 'hydro;solar' WHEN 3 THEN 'foo; gas' "
        "WHEN 4 THEN 'battery' WHEN 5 THEN 'tidal' WHEN 6 THEN 'waste;coal' WHEN 7 THEN NULL ELSE '' END AS generator_source, "
        "CASE p_partkey%4 WHEN 0 THEN 'nuclear' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE 'WATER' END AS plant_source, "
        "CASE WHEN p_partkey%7=0 THEN NULL ELSE 'plant' END AS power, p_name AS name, "
        f"CASE WHEN p_partkey%13=0 THEN 0e0 ELSE {_lat('p_partkey')} END AS lat, {_lon('p_partkey')} AS lon FROM {{part}}"),
    "polygons": (
        "SELECT osm_id, class_id, class_name, x1, y1, x2, y2, x3, y3, x4, y4 FROM ("
        "SELECT p_partkey AS osm_id, cast(1+p_partkey%10 AS int) AS class_id, "
        "CASE p_partkey%3 WHEN 0 THEN 'solar farm' WHEN 1 THEN 'Wind' ELSE NULL END AS class_name, "
        "lon-r AS x1, lat-r AS y1, lon+r AS x2, lat-r*5e-1 AS y2, lon+r*8e-1 AS x3, lat+r AS y3, lon-r*6e-1 AS x4, lat+r*7e-1 AS y4 "
        f"FROM (SELECT p_partkey, {_lat('p_partkey')} AS lat, {_lon('p_partkey')} AS lon, 2e-1+cast(p_partkey%9 AS double)/1e1 AS r "
        "FROM {part}) AS placed) AS cornered"),
    "generators": (
        "SELECT o_orderkey AS generator_id, o_custkey AS plant_code, 'plant ' || cast(o_custkey AS string) AS name, "
        "n_name AS state, 'entity ' || cast(c_nationkey AS string) AS entity_name, "
        f"{_lat('o_custkey')} AS lat, {_lon('o_custkey')} AS lon, "
        "CASE o_orderkey%6 WHEN 0 THEN 'SUN' WHEN 1 THEN 'WND' WHEN 2 THEN 'WAT' WHEN 3 THEN 'GEO' WHEN 4 THEN 'NG' ELSE 'PC' END AS fuel_code, "
        "CASE WHEN o_orderkey%29=0 THEN NULL ELSE o_totalprice/1e3 END AS capacity_mw, "
        "CASE o_orderstatus WHEN 'O' THEN 'OP' WHEN 'F' THEN 'RE' ELSE 'P' END AS status, "
        "o_orderdate AS period, o_orderkey AS row_id, "
        "CASE o_orderkey%3 WHEN 0 THEN 'RES' WHEN 1 THEN 'COM' ELSE 'IND' END AS sector, o_totalprice AS amount "
        "FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey"),
    "eia_records": (
        "SELECT o_orderkey AS record_id, cast(floor(o_orderkey/5e2) AS bigint) AS page, cast(o_custkey AS string) AS plantid, "
        f"CASE WHEN o_orderkey%17=0 THEN NULL WHEN o_orderkey%19=0 THEN '0' WHEN o_orderkey%23=0 THEN '' ELSE cast({_lat('o_custkey')} AS string) END AS latitude, "
        f"CASE WHEN o_orderkey%31=0 THEN NULL ELSE cast({_lon('o_custkey')} AS string) END AS longitude, "
        "'plant ' || cast(o_custkey AS string) AS plant_name, "
        "CASE WHEN o_orderkey%37=0 THEN NULL WHEN o_orderkey%41=0 THEN 'n/a' ELSE cast(o_totalprice AS string) END AS capacity, "
        "cast(year(o_orderdate) AS string) || '-01' AS started, "
        "CASE o_orderkey%7 WHEN 0 THEN 'SUN' WHEN 1 THEN 'WND' WHEN 2 THEN 'WAT' WHEN 3 THEN NULL WHEN 4 THEN 'BIT' WHEN 5 THEN 'ZZZ' ELSE 'MSW' END AS code_a, "
        "CASE o_orderkey%14 WHEN 3 THEN 'GEO' ELSE NULL END AS code_b FROM {orders}"),
    "terrain": (
        f"SELECT c_custkey AS site_id, {_lat('c_custkey')} AS lat, cast((c_custkey*59)%4000 AS double) AS c, "
        "cast((c_custkey*61)%4000 AS double) AS n, cast((c_custkey*67)%4000 AS double) AS s, "
        "cast((c_custkey*71)%4000 AS double) AS e, "
        "CASE WHEN c_custkey%10=0 THEN NULL ELSE cast((c_custkey*73)%4000 AS double) END AS w FROM {customer}"),
    "watershed": (
        "SELECT l_suppkey AS site_id, cast(l_quantity-1e0 AS double) AS nir, l_discount*1e2 AS red FROM {lineitem}"),
    "climatology": (
        "SELECT c_custkey AS site_id, CASE WHEN c_custkey%10=0 THEN -999e0 ELSE cast((c_custkey*37)%700 AS double)/1e2 END AS ghi, "
        "CASE WHEN c_custkey%11=0 THEN -999e0 ELSE cast((c_custkey*41)%900 AS double)/1e2 END AS ws, "
        "CASE WHEN c_custkey%12=0 THEN -999e0 ELSE cast((c_custkey*43)%7000 AS double)/1e2-20e0 END AS t2, "
        "CASE WHEN c_custkey%13=0 THEN NULL ELSE cast((c_custkey*47)%100 AS double) END AS cl, "
        "CASE WHEN c_custkey%14=0 THEN -999e0 ELSE cast((c_custkey*53)%700 AS double)/1e2 END AS pr FROM {customer}"),
    "windows": (
        "SELECT s_suppkey AS window_id, col0, row0, 3125e-5 AS x_resolution, -3125e-5 AS y_resolution, "
        "CASE WHEN s_suppkey%4=0 THEN 'val' ELSE 'train' END AS split, s_suppkey%10<>8 AS has_bounds FROM ("
        f"SELECT s_suppkey, cast(floor({_lon('s_suppkey')}/3125e-5) AS bigint)-16 AS col0, "
        f"cast(floor(-{_lat('s_suppkey')}/3125e-5) AS bigint)-16 AS row0 FROM {{supplier}}) AS placed"),
}


def _needs(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", TABLES[name])


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table as a lazy DataFrame."""
    if name in BASE:
        return base(spark, sf_dir, name)
    return spark.sql(TABLES[name], **{n: frame(spark, sf_dir, n) for n in _needs(name)})


def cte(*names: str) -> str:
    """``WITH`` clause that defines the domain tables for DuckDB."""
    bodies = [f"{n} AS ({TABLES[n].format(**{b: b for b in BASE})})" for n in names]
    return "WITH " + ", ".join(bodies)
