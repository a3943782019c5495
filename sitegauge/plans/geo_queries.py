"""Spatial join queries with brute-force oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sitegauge.functions import scalar
from sitegauge.operators import spatial
from sitegauge.operators.labels import UTM_K0, WGS84_A, WGS84_F, to_utm, utm_zone
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.registry import query
from sitegauge.sources import osm


def hav(a: str, b: str) -> str:
    return (f"2*6371.0::double*asin(sqrt(least(1::double, pow(sin(radians({b}.lat-{a}.lat)/2),2)"
            f"+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))")


def ring_frame(polygons):
    """Polygons with their corners as a closed ring."""
    corner = lambda i: F.struct(F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat"))
    return polygons.withColumn("ring", F.array(*[corner(i) for i in (1, 2, 3, 4, 1)])).drop(*[f"{a}{i}" for a in "xy" for i in range(1, 5)])


_DEG = "sqrt((s.lat-e.lat)*(s.lat-e.lat)+(s.lon-e.lon)*(s.lon-e.lon))"


@query("nearest_within_deg", cte("sites", "embedded") + f", p AS (SELECT s.site_id, e.vec_id, {_DEG} AS dist FROM sites s JOIN embedded e ON abs(s.lat-e.lat)<=0.5 AND abs(s.lon-e.lon)<=0.5), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dist, vec_id) AS rn FROM p WHERE dist<0.5) SELECT site_id, vec_id AS nearest_id, round(dist, 9) AS distance FROM r WHERE rn=1")
def nearest_within_deg(spark, d):
    out = spatial.nearest_within(frame(spark, d, "sites"), frame(spark, d, "embedded"), 0.5, "site_id", "vec_id")
    return out.withColumn("distance", F.round("distance", 9))


@query("nearest_feature_distance", cte("sites", "places") + f", p AS (SELECT s.site_id, c.city_id, {hav('s', 'c')} AS dist FROM sites s, places c), "
       "r AS (SELECT site_id, min(dist) AS distance FROM p GROUP BY 1) SELECT site_id, round(distance, 6) AS distance_km FROM r")
def nearest_feature_distance(spark, d):
    out = spatial.nearest_feature(frame(spark, d, "sites"), frame(spark, d, "places"), "site_id", "city_id")
    return out.select("site_id", F.round("distance", 6).alias("distance_km"))


@query("radius_count", cte("sites", "quakes") + ", q AS (SELECT lat, lon, count(*) AS n FROM quakes WHERE magnitude>=2 GROUP BY 1,2), "
       f"h AS (SELECT s.site_id, sum(q.n) AS n FROM sites s JOIN q ON abs(s.lat-q.lat)<1 AND {hav('s', 'q')}<=100 GROUP BY 1) "
       "SELECT site_id, coalesce(n, 0)::bigint AS n FROM sites LEFT JOIN h USING (site_id)")
def radius_count(spark, d):
    quakes = frame(spark, d, "quakes").filter(F.col("magnitude") >= 2.0)
    return spatial.radius_count(frame(spark, d, "sites"), quakes, 100.0, "site_id", "quake_id")


_PB = "SELECT osm_id, least(x1,x2,x3,x4) AS xmin, greatest(x1,x2,x3,x4) AS xmax, least(y1,y2,y3,y4) AS ymin, greatest(y1,y2,y3,y4) AS ymax FROM polygons"


@query("bbox_overlap_join", cte("places", "polygons") + f", b AS ({_PB}), w AS (SELECT city_id, lon-0.3::double AS xmin, lon+0.3::double AS xmax, lat-0.2::double AS ymin, lat+0.2::double AS ymax FROM places) "
       "SELECT city_id, osm_id FROM w JOIN b ON NOT (w.xmax<b.xmin OR w.xmin>b.xmax OR w.ymax<b.ymin OR w.ymin>b.ymax)")
def bbox_overlap_join(spark, d):
    from sitegauge.operators.spatial import ring_bbox
    polygons = ring_frame(frame(spark, d, "polygons"))
    boxes = polygons.select("osm_id", *[c.alias(n) for n, c in ring_bbox(F.col("ring")).items()])
    w = frame(spark, d, "places").select("city_id", (F.col("lon") - 0.3).alias("xmin"), (F.col("lon") + 0.3).alias("xmax"),
                                         (F.col("lat") - 0.2).alias("ymin"), (F.col("lat") + 0.2).alias("ymax"))
    return spatial.bbox_join(w, boxes, ["city_id"], ["osm_id"])


@query("ring_bbox", cte("polygons") + f", b AS ({_PB}) SELECT osm_id, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax FROM b")
def ring_bbox_query(spark, d):
    polygons = ring_frame(frame(spark, d, "polygons"))
    return polygons.select("osm_id", *[F.round(c, 9).alias(n) for n, c in spatial.ring_bbox(F.col("ring")).items()])


@query("exclude_near_cells_3x3", cte("sites", "locations") + ", pos AS (SELECT DISTINCT cast(floor(lat/0.05::double) AS bigint) AS cy, cast(floor(lon/0.05::double) AS bigint) AS cx FROM locations WHERE energy_type='solar') "
       "SELECT site_id FROM sites s WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.cy-cast(floor(s.lat/0.05::double) AS bigint) IN (-1,0,1) AND p.cx-cast(floor(s.lon/0.05::double) AS bigint) IN (-1,0,1))")
def exclude_near_cells(spark, d):
    occupied = frame(spark, d, "locations").filter(F.col("energy_type") == "solar")
    return spatial.exclude_near(frame(spark, d, "sites").select("site_id", "lat", "lon"), occupied).select("site_id")


@query("exclude_same_cell", cte("sites", "locations") + ", pos AS (SELECT DISTINCT round_even(lat/0.05::double, 0) AS cy, round_even(lon/0.05::double, 0) AS cx FROM locations) "
       "SELECT site_id FROM sites s WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.cy=round_even(s.lat/0.05::double, 0) AND p.cx=round_even(s.lon/0.05::double, 0))")
def exclude_same_cell(spark, d):
    return spatial.exclude_same_cell(frame(spark, d, "sites").select("site_id", "lat", "lon"), frame(spark, d, "locations")).select("site_id")


def _crossings(point: str) -> str:
    edges = [("x1", "y1", "x2", "y2"), ("x2", "y2", "x3", "y3"), ("x3", "y3", "x4", "y4"), ("x4", "y4", "x1", "y1")]
    return "+".join(f"(CASE WHEN (({py}>{point}.lat)<>({qy}>{point}.lat)) AND {point}.lon<{px}+({point}.lat-{py})/({qy}-{py})*({qx}-{px}) THEN 1 ELSE 0 END)"
                    for px, py, qx, qy in edges)


@query("point_in_polygon", cte("sites", "polygons") + f" SELECT s.site_id, g.osm_id FROM sites s JOIN polygons g ON abs(s.lat-g.y1)<3 AND abs(s.lon-g.x1)<3 WHERE ({_crossings('s')})%2=1")
def point_in_polygon(spark, d):
    return spatial.point_in_polygon(frame(spark, d, "sites"), ring_frame(frame(spark, d, "polygons")), "site_id", "osm_id")


@query("land_mask_polygons", cte("sites", "polygons") + f" SELECT DISTINCT s.site_id FROM sites s JOIN polygons g ON abs(s.lat-g.y1)<3 AND abs(s.lon-g.x1)<3 WHERE ({_crossings('s')})%2=1")
def land_mask_polygons(spark, d):
    return spatial.on_land(frame(spark, d, "sites"), ring_frame(frame(spark, d, "polygons")), "osm_id").select("site_id")


@query("idw_interpolate", cte("sites", "heat_points") + f", p AS (SELECT s.site_id, h.heat_flow_mwm2 AS v, {hav('s', 'h')} AS dist FROM sites s JOIN heat_points h ON abs(s.lat-h.lat)<1), "
       "n AS (SELECT * FROM p WHERE dist<=100) SELECT site_id, round(coalesce(avg(CASE WHEN dist=0 THEN v END), sum(CASE WHEN dist>0 THEN v/(dist*dist) END)/sum(CASE WHEN dist>0 THEN 1/(dist*dist) END)), 6) AS heat_flow_mwm2 FROM n GROUP BY 1")
def idw_interpolate(spark, d):
    out = spatial.idw(frame(spark, d, "sites"), frame(spark, d, "heat_points"), "heat_flow_mwm2", 100.0, "site_id")
    return out.withColumn("heat_flow_mwm2", F.round("heat_flow_mwm2", 6))


@query("reverse_geocode", cte("sites", "places") + f", m AS (SELECT site_id, lat, lon, CASE WHEN site_id%3=0 THEN 'KNOWN' WHEN site_id%3=1 THEN '' END AS country_code FROM sites), "
       f"p AS (SELECT m.site_id, c.country_code AS cc, row_number() OVER (PARTITION BY m.site_id ORDER BY round({hav('m', 'c')}, 9), c.city_id) AS rn FROM m, places c) "
       "SELECT m.site_id, CASE WHEN coalesce(m.country_code, '')<>'' THEN m.country_code ELSE p.cc END AS country_code FROM m JOIN p ON p.site_id=m.site_id AND p.rn=1")
def reverse_geocode(spark, d):
    rows = frame(spark, d, "sites").select("site_id", "lat", "lon", F.when(F.col("site_id") % 3 == 0, F.lit("KNOWN")).when(
        F.col("site_id") % 3 == 1, F.lit("")).alias("country_code"))
    return spatial.reverse_geocode(rows, frame(spark, d, "places"), "site_id").select("site_id", "country_code")


_BOXES = ", ".join(f"('{n}', {s}::double, {w}::double, {t}::double, {e}::double)" for n, s, w, t, e in osm.QUERY_BOXES)


@query("assign_source_region_box", cte("locations") + f" SELECT l.loc_id, b.box FROM locations l JOIN (VALUES {_BOXES}) b(box, south, west, north, east) ON l.lat BETWEEN south AND north AND l.lon BETWEEN west AND east WHERE l.energy_type='wind' OR b.box<>'North America'")
def assign_source_region_box(spark, d):
    """Wind is collected in all boxes, every other type in all but one."""
    locs = frame(spark, d, "locations")
    wind, rest = locs.filter(F.col("energy_type") == "wind"), locs.filter(F.col("energy_type") != "wind")
    hits = [spatial.region_box_rows(part.select("loc_id", "lat", "lon"), osm.query_boxes(kind)).select("loc_id", "box")
            for part, kind in ((wind, "wind"), (rest, "solar"))]
    return hits[0].unionByName(hits[1])


# -- cells, regions, distances ----------------------------------------------

_V1 = " ".join(f"WHEN lat>={s} AND lat<={n} AND lon>={w} AND lon<={e} THEN '{name}'" for name, s, n, w, e in scalar.CONTINENT_BOXES)
REGION_V2 = ("CASE WHEN lat>15 AND lon>-170 AND lon<-50 THEN 'North America' WHEN lat>-55 AND lon>-82 AND lon<-34 THEN 'South America' "
             "WHEN lat>35 AND lon>-25 AND lon<45 THEN 'Europe' WHEN lat>-35 AND lon>-20 AND lon<55 THEN 'Africa' WHEN lat>-47 AND lon>110 THEN 'Oceania' ELSE 'Asia' END")
REGION_NEG = ("CASE WHEN lat>15 AND lon>-170 AND lon<-50 THEN 'North America' WHEN lat>-55 AND lat<15 AND lon>-82 AND lon<-34 THEN 'South America' "
              "WHEN lat>35 AND lon>-25 AND lon<45 THEN 'Europe' WHEN lat>-35 AND lat<37 AND lon>-20 AND lon<55 THEN 'Africa' WHEN lat<-10 AND lon>110 THEN 'Oceania' ELSE 'Asia' END")


@query("region_box_v1", cte("sites") + f" SELECT site_id, CASE {_V1} ELSE 'Other' END AS region FROM sites")
def region_box_v1(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.region_boxes(F.col("lat"), F.col("lon")).alias("region"))


@query("region_rules_v2", cte("sites") + f" SELECT site_id, {REGION_V2} AS region FROM sites")
def region_rules_v2(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.region_rules(F.col("lat"), F.col("lon")).alias("region"))


@query("region_rules_neg", cte("sites") + f" SELECT site_id, {REGION_NEG} AS region FROM sites")
def region_rules_neg(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.region_rules_negative(F.col("lat"), F.col("lon")).alias("region"))


@query("land_heuristic_v1", cte("locations") + " SELECT loc_id FROM locations WHERE NOT (lat<-60 OR lat>75) AND NOT (lat>-60 AND lat<-40 AND (lon<-70 OR lon>150))")
def land_heuristic_v1(spark, d):
    return frame(spark, d, "locations").filter(scalar.is_land_rough(F.col("lat"), F.col("lon"))).select("loc_id")


_U = "(('0x' || substr(md5('42:' || cast({} AS varchar)), 1, 8))::bigint)"


@query("land_heuristic_v2", cte("locations") + " SELECT loc_id FROM locations WHERE NOT (lat>-55 AND lat<-35 AND lon>-180 AND lon<-60) AND (NOT (lat>60 AND ((lon>-180 AND lon<-90) OR (lon>30 AND lon<180))) "
       f"OR {_U.format('loc_id')}/4294967296.0::double<=0.3::double)")
def land_heuristic_v2(spark, d):
    u = scalar.hash_uniform(F.col("loc_id"))
    return frame(spark, d, "locations").filter(scalar.is_land_sampled(F.col("lat"), F.col("lon"), u)).select("loc_id")


@query("grid_cell_round", cte("sites") + " SELECT site_id, cast(cast(round_even(lat, 0) AS bigint) AS varchar) || '_' || cast(cast(round_even(lon, 0) AS bigint) AS varchar) AS cell FROM sites")
def grid_cell_round(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.cell_key(scalar.cell_round(F.col("lat")), scalar.cell_round(F.col("lon"))).alias("cell"))


@query("grid_cell_trunc", cte("sites") + " SELECT site_id, cast(cast(trunc(lat) AS bigint) AS varchar) || '_' || cast(cast(trunc(lon) AS bigint) AS varchar) AS cell FROM sites")
def grid_cell_trunc(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.cell_key(scalar.cell_trunc(F.col("lat")), scalar.cell_trunc(F.col("lon"))).alias("cell"))


@query("grid_cell_floor", cte("sites") + " SELECT site_id, cast(floor(lat/0.05::double) AS bigint) AS cy, cast(floor(lon/0.05::double) AS bigint) AS cx FROM sites")
def grid_cell_floor(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.cell_floor(F.col("lat"), 0.05).alias("cy"), scalar.cell_floor(F.col("lon"), 0.05).alias("cx"))


@query("snap_grid", cte("sites") + " SELECT site_id, cast(round_even(lat/0.005::double, 0) AS bigint) AS cy, cast(round_even(lon/0.005::double, 0) AS bigint) AS cx FROM sites")
def snap_grid(spark, d):
    return frame(spark, d, "sites").select("site_id", scalar.cell_round(F.col("lat"), 0.005).alias("cy"), scalar.cell_round(F.col("lon"), 0.005).alias("cx"))


@query("haversine_km", cte("locations", "places") + f" SELECT l.loc_id, round({hav('l', 'c')}, 6) AS km FROM locations l JOIN places c ON c.city_id=l.loc_id%100 WHERE true")
def haversine(spark, d):
    cities = frame(spark, d, "places").select("city_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    joined = frame(spark, d, "locations").join(cities, F.col("city_id") == F.col("loc_id") % 100)
    return joined.select("loc_id", F.round(scalar.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 6).alias("km"))


_N = WGS84_F / (2.0 - WGS84_F)
_ECC = f"{2 * math.sqrt(_N) / (1 + _N)!r}::double"
_RADIUS = f"{UTM_K0 * (WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64))!r}::double"
_ALPHA = [f"{v!r}::double" for v in (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5, 61 * _N ** 3 / 240)]
_EAST = "+".join(["eta", *[f"{a}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(_ALPHA, start=1)]])
_NORTH = "+".join(["xi", *[f"{a}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(_ALPHA, start=1)]])


@query("reproject_utm", cte("sites") + ", a AS (SELECT site_id, lat, least(60, floor((lon+180)/6)+1)::int AS zone, lon, radians(lat) AS phi FROM sites), "
       f"b AS (SELECT *, radians(lon-(zone*6-183)) AS lam, sinh(atanh(sin(phi))-{_ECC}*atanh({_ECC}*sin(phi))) AS t FROM a), "
       "c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM b) "
       f"SELECT site_id, zone, cast(round_even(500000+{_RADIUS}*({_EAST}), 0) AS bigint) AS x_m, "
       f"cast(round_even(CASE WHEN lat>=0 THEN 0 ELSE 10000000 END+{_RADIUS}*({_NORTH}), 0) AS bigint) AS y_m FROM c")
def reproject_utm(spark, d):
    """Whole metres; the oracle states the same Krueger series, as one good to a millimetre rounds some sites to the next metre."""
    zone = utm_zone(F.col("lon"))
    p = frame(spark, d, "sites").select("site_id", zone.alias("zone"), to_utm(F.col("lat"), F.col("lon"), zone).alias("p"))
    return p.select("site_id", "zone", F.bround("p.x", 0).cast("bigint").alias("x_m"), F.bround("p.y", 0).cast("bigint").alias("y_m"))
