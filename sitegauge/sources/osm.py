"""Map data: landed element pages to point rows, polygons and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import cases, parse_capacity
from sitegauge.operators.ranking import keep_first

# Fuel code of each energy type collected from the map.
POINT_FUEL_CODES = {"solar": "SUN", "wind": "WND", "hydro": "WAT", "geothermal": "GEO"}

# Facility classes and the tag values that name them.
FACILITY_CLASSES = (
    (1, "solar", ("solar",)),
    (2, "wind", ("wind",)),
    (3, "gas", ("gas", "natural_gas")),
    (4, "coal", ("coal",)),
    (5, "nuclear", ("nuclear",)),
    (6, "hydro", ("hydro", "hydro;solar", "water")),
    (7, "oil", ("oil",)),
    (8, "biomass", ("biomass", "biogas", "waste")),
    (9, "geothermal", ("geothermal",)),
    (10, "storage", ("battery", "battery_storage")),
)

# Tag keys to look at, in order of preference.
CLASS_KEYS = ("generator:source", "plant:source", "generator:type", "plant:type", "source")

# Query boxes as (name, south, west, north, east). They overlap.
QUERY_BOXES = (
    ("Europe", 35.0, -25.0, 72.0, 45.0),
    ("Asia", 0.0, 45.0, 60.0, 180.0),
    ("Africa", -35.0, -20.0, 37.0, 55.0),
    ("South America", -55.0, -82.0, 15.0, -34.0),
    ("Oceania", -47.0, 110.0, -10.0, 180.0),
    ("East Asia", 18.0, 73.0, 55.0, 145.0),
    ("North America", 15.0, -170.0, 72.0, -50.0),
)

ELEMENT_SCHEMA = (
    "elements array<struct<type: string, id: bigint, lat: double, lon: double, "
    "center: struct<lat: double, lon: double>, tags: map<string, string>, nodes: array<bigint>>>"
)


def query_boxes(energy_type: str = "wind") -> list[tuple[str, float, float, float, float]]:
    """Continent boxes of one energy type: only wind is collected over North America too."""
    return [b for b in QUERY_BOXES if energy_type == "wind" or b[0] != "North America"]


def elements(pages: DataFrame, value: str = "value") -> DataFrame:
    """One row per element of the landed pages."""
    keep = [c for c in pages.columns if c != value]
    return pages.select(*keep, F.explode(F.from_json(value, ELEMENT_SCHEMA)["elements"]).alias("e")).select(*keep, "e.*")


def _truthy(x: Column) -> Column:
    return F.when(x != 0.0, x)


def parse_points(rows: DataFrame, energy_type: str | Column) -> DataFrame:
    """Location rows from elements; the centre of an area wins over a node position."""
    kind = F.lit(energy_type) if isinstance(energy_type, str) else energy_type
    codes = F.create_map(*[F.lit(x) for pair in POINT_FUEL_CODES.items() for x in pair])
    located = rows.withColumns({
        "_lat": F.coalesce(_truthy(F.col("center.lat")), _truthy(F.col("lat"))),
        "_lon": F.coalesce(_truthy(F.col("center.lon")), _truthy(F.col("lon")))})
    return located.filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).select(
        F.col("id").alias("osm_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        kind.alias("energy_type"), F.lit("osm_overpass").alias("source"),
        F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"),
        parse_capacity(F.col("tags")).alias("capacity_mw"), F.lit("").alias("country_code"),
        F.try_element_at(codes, kind).alias("fuel_code"), F.lit("").alias("operating_year"))


def _tag_lookup() -> tuple[Column, Column]:
    ids = F.create_map(*[F.lit(x) for cid, _, tags in FACILITY_CLASSES for t in tags for x in (t, cid)])
    names = F.create_map(*[F.lit(x) for _, name, tags in FACILITY_CLASSES for t in tags for x in (t, name)])
    return ids, names


def classify_tags(tags: Column) -> Column:
    """Struct (class_id, class_name, source_tag) from a tag map; NULL when nothing matches.

    Per key the whole value is tried before its semicolon-separated parts.
    """
    ids, names = _tag_lookup()

    def hit(key: str) -> Column:
        value = F.trim(F.lower(F.try_element_at(tags, F.lit(key))))
        options = F.concat(F.array(value), F.transform(F.split(value, ";"), lambda p: F.trim(p)))
        known = F.filter(options, lambda o: F.try_element_at(ids, o).isNotNull())
        tag = F.try_element_at(known, F.lit(1))
        return F.when(tag.isNotNull(), F.struct(
            F.try_element_at(ids, tag).alias("class_id"), F.try_element_at(names, tag).alias("class_name"),
            F.concat(F.lit(f"{key}="), tag).alias("source_tag")))

    return F.coalesce(*[hit(k) for k in CLASS_KEYS])


def way_coordinates(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(osm_id, position, lon, lat): one row per known node of every way."""
    refs = ways.select(F.col("id").alias("osm_id"), F.posexplode("nodes").alias("position", "node"))
    places = nodes.select(F.col("id").alias("node"), "lon", "lat")
    return refs.join(places, "node").select("osm_id", "position", "lon", "lat")


def way_polygons(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Closed rings of classified power ways with at least three known nodes."""
    facilities = (ways.filter(F.map_contains_key("tags", "power"))
                  .withColumn("class", classify_tags(F.col("tags"))).filter(F.col("class").isNotNull()))
    rings = (way_coordinates(facilities, nodes).groupBy("osm_id")
             .agg(F.array_sort(F.collect_list(F.struct("position", "lon", "lat"))).alias("path"))
             .filter(F.size("path") >= 3)
             .select("osm_id", F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("path")))
    start, end = F.element_at("path", 1), F.element_at("path", -1)
    closed = F.when(start == end, F.col("path")).otherwise(F.concat("path", F.array(start)))
    return (rings.withColumn("ring", closed).drop("path")
            .join(facilities.select(F.col("id").alias("osm_id"), "class.*"), "osm_id"))


def first_per_feature(features: DataFrame) -> DataFrame:
    """One feature per map id across overlapping query regions: the earliest region wins."""
    return keep_first(features, ["osm_id"], ["region_seq"])


POINT = "array<double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"
MULTI_POLYGON = f"array<{POLYGON}>"


def vertex_mean(geometry_type: Column, coordinates_json: Column) -> Column:
    """Struct (lat, lon): mean of the outer vertices, closing vertex included."""
    def read(schema: str) -> Column:
        return F.from_json(coordinates_json, schema)

    outer_rings = F.flatten(F.transform(read(MULTI_POLYGON), lambda poly: poly[0]))
    vertices = cases(
        (geometry_type == "Point", F.array(read(POINT))),
        (geometry_type == "LineString", read(LINE)),
        (geometry_type == "Polygon", read(POLYGON)[0]),
        (geometry_type == "MultiLineString", F.flatten(read(POLYGON))),
        (geometry_type == "MultiPolygon", outer_rings),
    )

    def mean(axis: int) -> Column:
        total = F.aggregate(vertices, F.lit(0.0), lambda acc, v: acc + v[axis])
        return F.try_divide(total, F.size(vertices).cast("double"))

    return F.struct(mean(1).alias("lat"), mean(0).alias("lon"))


def area_centroid(ring: Column) -> Column:
    """Struct (lat, lon): centroid of a closed ring by the shoelace sums.

    Coordinates are taken relative to the first vertex, which keeps precision for
    small rings far from the origin.
    """
    origin = ring[0]
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"),
                         F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))

    def step(acc: Column, e: Column) -> Column:
        px, py = e["p"]["lon"] - origin["lon"], e["p"]["lat"] - origin["lat"]
        qx, qy = e["q"]["lon"] - origin["lon"], e["q"]["lat"] - origin["lat"]
        cross = px * qy - qx * py
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (px + qx) * cross).alias("x"),
                        (acc["y"] + (py + qy) * cross).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(edges, zero, step)
    return F.struct((origin["lat"] + F.try_divide(sums["y"], 3.0 * sums["a"])).alias("lat"),
                    (origin["lon"] + F.try_divide(sums["x"], 3.0 * sums["a"])).alias("lon"))


def polygon_centroids(features: DataFrame, energy_type: str) -> DataFrame:
    """Centroids of the features whose class name mentions ``energy_type``."""
    named = features.filter(F.coalesce(F.lower("class_name").contains(energy_type.lower()), F.lit(False)))
    placed = named.withColumn("c", vertex_mean(F.col("geometry_type"), F.col("coordinates")))
    return placed.filter(F.col("c.lat").isNotNull() & F.col("c.lon").isNotNull()).select(
        "osm_id", "class_name", "c.lat", "c.lon")
