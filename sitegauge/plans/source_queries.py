"""Source, sink and catalog queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions.scalar import parse_capacity, safe_double
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.geo_queries import ring_frame
from sitegauge.plans.registry import query
from sitegauge.session import scratch_path
from sitegauge.sources import eia, osm, tables
from sitegauge.streaming import jobs


@query("scan_parquet", cte("sites") + " SELECT site_id, round(lat, 6) AS lat, round(lon, 6) AS lon, energy_type FROM sites WHERE lat>10")
def scan_parquet(spark, d):
    path = scratch_path(spark, "sites")
    tables.write_table(frame(spark, d, "sites"), path)
    return tables.read_table(spark, path).filter(F.col("lat") > 10).select(
        "site_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "energy_type")


def _meta(spark, d):
    return frame(spark, d, "embedded").select(
        F.col("vec_id").alias("index"), "lat", "lon", "energy_type", "label", F.lit("").alias("region"), "country_code")


_META_SQL = cte("embedded") + " SELECT vec_id AS \"index\", lat, lon, energy_type, label, country_code FROM embedded"


@query("scan_csv", _META_SQL)
def scan_csv(spark, d):
    path = scratch_path(spark, "meta") + ".csv"
    tables.write_table(_meta(spark, d), path, "csv")
    return tables.read_table(spark, path, tables.EMBEDDING_META).drop("region")


@query("scan_embeddings", cte("embedded", "vectors") + " SELECT e.vec_id AS \"index\", e.energy_type, len(v.embedding)::bigint AS dims, round(list_sum(v.embedding::double[]), 5) AS total "
       "FROM embedded e JOIN vectors v USING (vec_id)")
def scan_embeddings(spark, d):
    vectors = frame(spark, d, "vectors").withColumnRenamed("vec_id", "index")
    joined = tables.attach_embeddings(_meta(spark, d), vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.select("index", "energy_type", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 5).alias("total"))


@query("embeddings_meta_join", cte("embedded", "vectors") + " SELECT count(*) AS n, count(*) FILTER (WHERE v.vec_id IS NULL) AS unmatched FROM embedded e LEFT JOIN vectors v USING (vec_id)")
def embeddings_meta_join(spark, d):
    meta, vectors = frame(spark, d, "embedded"), frame(spark, d, "vectors")
    missing = tables.unmatched(meta, vectors, "vec_id").select("vec_id", F.lit(1).alias("miss"))
    return meta.select("vec_id").join(missing, "vec_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("miss").alias("unmatched"))


def _eia_pages(spark, d):
    r = frame(spark, d, "eia_records")
    record = F.struct(
        F.col("latitude"), F.col("longitude"), F.col("plant_name").alias("plantName"), F.col("plantid"),
        F.col("capacity").alias("nameplate-capacity-mw"), F.col("started").alias("operating-year-month"),
        F.col("code_a").alias("energy_source_code"), F.col("code_b").alias("energySourceCode"),
        F.lit("TX").alias("stateid"), F.lit("e").alias("entityName"), F.lit("OP").alias("status"))
    # A landed page holds at most 500 records by construction.
    return r.groupBy("page").agg(F.collect_list(record).alias("data")).select(
        F.to_json(F.struct(F.struct("data").alias("response"))).alias("value"))


_EIA_OK = "try_cast(latitude AS double)<>0 AND try_cast(longitude AS double)<>0 AND (capacity IS NULL OR try_cast(capacity AS double) IS NOT NULL)"
_FUEL = "coalesce(code_a, code_b)"
_GLOBAL = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in eia.fuel_map("global").items())


@query("parse_eia_generators", cte("eia_records") + f" SELECT plantid AS plant_code, {_FUEL} AS fuel_code, CASE {_FUEL} {_GLOBAL} ELSE 'other' END AS energy_type, "
       "round(try_cast(latitude AS double), 6) AS lat, round(try_cast(longitude AS double), 6) AS lon, coalesce(try_cast(capacity AS double), 0) AS capacity_mw, substr(started, 1, 4) AS operating_year "
       f"FROM eia_records WHERE {_EIA_OK} AND {_FUEL} IS NOT NULL")
def parse_eia_generators(spark, d):
    out = eia.parse_pages(_eia_pages(spark, d))
    return out.select("plant_code", "fuel_code", "energy_type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "capacity_mw", "operating_year")


@query("parse_eia_plants", cte("eia_records") + f" SELECT count(*) AS n, round(sum(coalesce(try_cast(capacity AS double), 0)), 3) AS capacity FROM eia_records WHERE {_EIA_OK}")
def parse_eia_plants(spark, d):
    return eia.parse_pages(_eia_pages(spark, d), need_fuel=False).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("capacity_mw"), 3).alias("capacity"))


_FULL = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in eia.FUEL_CODES.items())


@query("map_fuel_code", cte("eia_records") + f" SELECT record_id, CASE coalesce(code_a, '') {_FULL} ELSE 'other' END AS energy_type FROM eia_records")
def map_fuel_code(spark, d):
    return eia.map_fuel(frame(spark, d, "eia_records"), "full", "code_a").select("record_id", "energy_type")


def _tags(spark, d):
    t = frame(spark, d, "tagged")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (
        ("plant:output:electricity", "plant_output"), ("generator:output:electricity", "generator_output"),
        ("generator:source", "generator_source"), ("plant:source", "plant_source"), ("power", "power"), ("name", "name"))])
    return t.withColumn("tags", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


_CAP = ("coalesce(try_cast(nullif(regexp_replace(split_part(split_part(plant_output, 'MW', 1), 'mw', 1), '[^0-9.]', '', 'g'), '') AS double), "
        "try_cast(nullif(regexp_replace(split_part(split_part(generator_output, 'MW', 1), 'mw', 1), '[^0-9.]', '', 'g'), '') AS double), 0)")


@query("parse_overpass_points", cte("tagged") + f" SELECT id AS osm_id, round(lat, 6) AS lat, round(lon, 6) AS lon, name, {_CAP} AS capacity_mw, 'WND' AS fuel_code, 'wind' AS energy_type FROM tagged WHERE lat<>0 AND lon<>0")
def parse_overpass_points(spark, d):
    t = _tags(spark, d)
    even = F.col("id") % 2 == 0
    element = F.struct(
        F.lit("way").alias("type"), "id", F.when(~even, F.col("lat")).alias("lat"), F.when(~even, F.col("lon")).alias("lon"),
        F.when(even, F.struct("lat", "lon")).alias("center"), "tags")
    pages = t.groupBy(F.floor(F.col("id") / 200).alias("page")).agg(F.collect_list(element).alias("elements")).select(
        F.to_json(F.struct("elements")).alias("value"))
    out = osm.parse_points(osm.elements(pages), "wind")
    return out.select("osm_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name", "capacity_mw", "fuel_code", "energy_type")


@query("parse_capacity", cte("tagged") + f" SELECT id, {_CAP} AS capacity_mw FROM tagged")
def capacity(spark, d):
    return _tags(spark, d).select("id", parse_capacity(F.col("tags")).alias("capacity_mw"))


@query("safe_float", cte("eia_records") + " SELECT record_id, coalesce(try_cast(capacity AS double), 0) AS x FROM eia_records")
def safe_float(spark, d):
    return frame(spark, d, "eia_records").select("record_id", safe_double(F.col("capacity")).alias("x"))


_CLASS_ROWS = ", ".join(f"('{t}', {cid}, '{name}')" for cid, name, ts in osm.FACILITY_CLASSES for t in ts)
_CLASSIFY = (
    f", classes(tag, cid, cname) AS (VALUES {_CLASS_ROWS}), "
    "vals AS (SELECT id, 1 AS pri, 'generator:source' AS k, trim(lower(generator_source)) AS v FROM tagged WHERE generator_source IS NOT NULL UNION ALL "
    "SELECT id, 2, 'plant:source', trim(lower(plant_source)) FROM tagged WHERE plant_source IS NOT NULL), "
    "opts AS (SELECT id, pri, k, 0 AS pos, v AS tag FROM vals UNION ALL SELECT id, pri, k, u.pos, trim(u.part) FROM vals, unnest(string_split(v, ';')) WITH ORDINALITY AS u(part, pos)), "
    "hit AS (SELECT id, cid AS class_id, cname AS class_name, k || '=' || tag AS source_tag, row_number() OVER (PARTITION BY id ORDER BY pri, pos) AS rn FROM opts JOIN classes USING (tag))")


@query("classify_osm_tags", cte("tagged") + _CLASSIFY + " SELECT id, class_id, class_name, source_tag FROM hit WHERE rn=1")
def classify(spark, d):
    out = _tags(spark, d).select("id", osm.classify_tags(F.col("tags")).alias("c")).filter(F.col("c").isNotNull())
    return out.select("id", "c.*")


def _nodes_and_ways(spark, d):
    """Every polygon as four nodes and a way; every seventh way names a node that does not exist."""
    p = frame(spark, d, "polygons")
    corners = F.array(*[F.struct((F.col("osm_id") * 4 + i - 1).alias("id"), F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat")) for i in range(1, 5)])
    nodes = p.select(F.explode(corners).alias("n")).select("n.*").filter(F.col("id") % 29 != 0)
    k = F.col("osm_id") * 4
    refs = F.when(F.col("id") % 2 == 0, F.array(k, k + 1, k + 2, k + 3, k)).when(
        F.col("id") % 7 == 1, F.array(k, k + 1, F.lit(-1).cast("bigint"))).otherwise(F.array(k, k + 1, k + 2, k + 3))
    ways = p.select("osm_id").join(_tags(spark, d).select("id", "tags"), F.col("osm_id") == F.col("id")).select("id", "tags", refs.alias("nodes"))
    return nodes, ways


_WAYS = (cte("tagged", "polygons") + _CLASSIFY +
         ", raw AS (SELECT osm_id, 0 AS c, x1 AS lon, y1 AS lat FROM polygons UNION ALL SELECT osm_id, 1, x2, y2 FROM polygons UNION ALL SELECT osm_id, 2, x3, y3 FROM polygons UNION ALL SELECT osm_id, 3, x4, y4 FROM polygons), "
         "nodes AS (SELECT *, osm_id*4+c AS node FROM raw WHERE (osm_id*4+c)%29<>0), "
         "refs AS (SELECT id, u.pos, u.node FROM tagged, unnest(CASE WHEN id%2=0 THEN [id*4, id*4+1, id*4+2, id*4+3, id*4] WHEN id%7=1 THEN [id*4, id*4+1, -1] ELSE [id*4, id*4+1, id*4+2, id*4+3] END) WITH ORDINALITY AS u(node, pos) WHERE power IS NOT NULL), "
         "pts AS (SELECT r.id, r.pos, n.lon, n.lat FROM refs r JOIN nodes n USING (node))")


@query("osm_ways_to_polygons", _WAYS + ", agg AS (SELECT id, count(*) AS n, sum(lon) AS slon, sum(lat) AS slat, arg_min(lon, pos) AS flon, arg_min(lat, pos) AS flat, arg_max(lon, pos) AS llon, arg_max(lat, pos) AS llat FROM pts GROUP BY 1) "
       "SELECT a.id AS osm_id, h.class_id, h.class_name, h.source_tag, (CASE WHEN flon=llon AND flat=llat THEN n ELSE n+1 END)::bigint AS n_points, "
       "round(CASE WHEN flon=llon AND flat=llat THEN slon ELSE slon+flon END, 6) AS sum_lon, round(CASE WHEN flon=llon AND flat=llat THEN slat ELSE slat+flat END, 6) AS sum_lat FROM agg a JOIN hit h ON h.id=a.id AND rn=1 WHERE n>=3")
def osm_ways_to_polygons(spark, d):
    out = osm.way_polygons(*_nodes_and_ways(spark, d))
    total = lambda axis: F.round(F.aggregate("ring", F.lit(0.0), lambda acc, p: acc + p[axis]), 6)
    return out.select("osm_id", "class_id", "class_name", "source_tag", F.size("ring").cast("bigint").alias("n_points"),
                      total("lon").alias("sum_lon"), total("lat").alias("sum_lat"))


@query("way_node_join", _WAYS + " SELECT id AS osm_id, (pos-1)::bigint AS position, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pts")
def way_node_join(spark, d):
    nodes, ways = _nodes_and_ways(spark, d)
    out = osm.way_coordinates(ways.filter(F.map_contains_key("tags", "power")), nodes)
    return out.select("osm_id", F.col("position").cast("bigint").alias("position"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("dedup_features", cte("locations") + f", b(box, south, west, north, east, seq) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {s}::double, {w}::double, {t}::double, {e}::double, {i})' for i, (n, s, w, t, e) in enumerate(osm.QUERY_BOXES))}), "
       "hits AS (SELECT l.loc_id, b.box, row_number() OVER (PARTITION BY l.loc_id ORDER BY b.seq) AS rn FROM locations l JOIN b ON lat BETWEEN south AND north AND lon BETWEEN west AND east) SELECT loc_id AS osm_id, box FROM hits WHERE rn=1")
def dedup_features(spark, d):
    from sitegauge.operators.spatial import region_box_rows
    hits = region_box_rows(frame(spark, d, "locations").select(F.col("loc_id").alias("osm_id"), "lat", "lon"), osm.query_boxes())
    return osm.first_per_feature(hits.withColumnRenamed("box_seq", "region_seq")).select("osm_id", "box")


_GEO_TYPES = ("Point", "LineString", "Polygon", "MultiLineString", "MultiPolygon")


def _geojson(spark, d):
    """Polygons as geometry JSON of five types, by key."""
    p = ring_frame(frame(spark, d, "polygons"))
    line = F.transform("ring", lambda v: F.array(v["lon"], v["lat"]))
    kind = F.element_at(F.array(*[F.lit(t) for t in _GEO_TYPES]), (F.col("osm_id") % 5 + 1).cast("int"))
    shapes = [line[0], line, F.array(line), F.array(line, F.slice(line, 1, 2)), F.array(F.array(line), F.array(F.slice(line, 1, 3)))]
    text = F.coalesce(*[F.when(F.col("osm_id") % 5 == i, F.to_json(s)) for i, s in enumerate(shapes)])
    return p.select("osm_id", "class_name", "ring", kind.alias("geometry_type"), text.alias("coordinates"))


def _vm(a: str) -> str:
    ring = f"{a}1+{a}2+{a}3+{a}4+{a}1"
    return (f"round(CASE osm_id%5 WHEN 0 THEN {a}1 WHEN 1 THEN ({ring})/5 WHEN 2 THEN ({ring})/5 WHEN 3 THEN ({ring}+{a}1+{a}2)/7 ELSE ({ring}+{a}1+{a}2+{a}3)/8 END, 6)")


@query("geojson_centroids", cte("polygons") + f" SELECT osm_id, class_name, {_vm('y')} AS lat, {_vm('x')} AS lon FROM polygons WHERE lower(class_name) LIKE '%solar%'")
def geojson_centroids(spark, d):
    out = osm.polygon_centroids(_geojson(spark, d), "Solar")
    return out.select("osm_id", "class_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_CROSS = [("x1", "y1", "x2", "y2"), ("x2", "y2", "x3", "y3"), ("x3", "y3", "x4", "y4"), ("x4", "y4", "x1", "y1")]
_A = "+".join(f"(({a}-x1)*({q}-y1)-({c}-x1)*({b}-y1))" for a, b, c, q in _CROSS)
_CX = "+".join(f"(({a}-x1)+({c}-x1))*(({a}-x1)*({q}-y1)-({c}-x1)*({b}-y1))" for a, b, c, q in _CROSS)
_CY = "+".join(f"(({b}-y1)+({q}-y1))*(({a}-x1)*({q}-y1)-({c}-x1)*({b}-y1))" for a, b, c, q in _CROSS)


@query("area_centroids", cte("polygons") + f" SELECT osm_id, round(y1+({_CY})/(3*({_A})), 6) AS lat, round(x1+({_CX})/(3*({_A})), 6) AS lon FROM polygons")
def area_centroids(spark, d):
    out = ring_frame(frame(spark, d, "polygons")).select("osm_id", osm.area_centroid(F.col("ring")).alias("c"))
    return out.select("osm_id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("landing_stream", cte("eia_records") + f" SELECT plantid AS plant_code, {_FUEL} AS fuel_code, coalesce(try_cast(capacity AS double), 0) AS capacity_mw FROM eia_records WHERE {_EIA_OK} AND {_FUEL} IS NOT NULL")
def landing_stream(spark, d):
    """Landed pages through the file source, exactly once, into Parquet."""
    folder, out, state = (scratch_path(spark, n) for n in ("landing", "parsed", "state"))
    _eia_pages(spark, d).write.text(folder)
    stream = jobs.landing_stream(spark, folder, "value string", "text")
    jobs.catch_up(eia.parse_pages(stream), out, state)
    return spark.read.parquet(out).select("plant_code", "fuel_code", "capacity_mw")


# -- sinks ------------------------------------------------------------------

@query("sink_parquet", cte("sites") + " SELECT site_id, energy_type, label FROM sites")
def sink_parquet(spark, d):
    path = scratch_path(spark, "out")
    tables.write_table(frame(spark, d, "sites").select("site_id", "energy_type", "label"), path, partition_by=["energy_type"])
    return spark.read.parquet(path)


@query("sink_csv", cte("predictions") + " SELECT row_id, y_true, y_prob FROM predictions")
def sink_csv(spark, d):
    path = scratch_path(spark, "out")
    tables.write_table(frame(spark, d, "predictions").select("row_id", "y_true", "y_prob"), path, "csv")
    return spark.read.schema("row_id string, y_true int, y_prob double").option("header", True).csv(path)


@query("sink_json_report", cte("sites") + " SELECT energy_type, count(*) AS n, round(avg(lat), 6) AS mean_lat FROM sites GROUP BY 1")
def sink_json_report(spark, d):
    path = scratch_path(spark, "out")
    report = frame(spark, d, "sites").groupBy("energy_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 6).alias("mean_lat"))
    tables.report_json(report, []).write.text(path)
    return spark.read.schema("energy_type string, n bigint, mean_lat double").json(path)


@query("sink_geojson", cte("polygons") + " SELECT osm_id, 'Polygon' AS geometry_type, round(x1, 6) AS first_lon, round(y4, 6) AS fourth_lat FROM polygons")
def sink_geojson(spark, d):
    path = scratch_path(spark, "out")
    tables.geojson_lines(ring_frame(frame(spark, d, "polygons")), "ring", ["osm_id", "class_id"]).write.text(path)
    back = spark.read.schema("geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<osm_id: bigint, class_id: int>").json(path)
    ring = F.col("geometry.coordinates")[0]
    return back.select("properties.osm_id", F.col("geometry.type").alias("geometry_type"), F.round(ring[0][0], 6).alias("first_lon"), F.round(ring[3][1], 6).alias("fourth_lat"))


@query("checkpoint_progress", cte("sites") + " SELECT site_id, CASE WHEN site_id%3=0 THEN 'first' ELSE 'second' END AS run FROM sites")
def checkpoint_progress(spark, d):
    """Two appending runs: the second one takes only what the first left open."""
    path = scratch_path(spark, "progress")
    rows = frame(spark, d, "sites").select("site_id")
    tables.write_table(rows.filter(F.col("site_id") % 3 == 0).withColumn("run", F.lit("first")), path, mode="append")
    rest = tables.pending(rows, spark.read.parquet(path), "site_id")
    tables.write_table(rest.withColumn("run", F.lit("second")), path, mode="append")
    return spark.read.parquet(path)


# -- simple table operators -------------------------------------------------

@query("filter_energy_type", cte("sites") + " SELECT site_id FROM sites WHERE energy_type='wind'")
def filter_energy_type(spark, d):
    return tables.of_type(frame(spark, d, "sites"), "WIND").select("site_id")


@query("resume_pending", cte("sites", "embedded") + " SELECT site_id FROM sites WHERE site_id NOT IN (SELECT vec_id FROM embedded)")
def resume_pending(spark, d):
    done = frame(spark, d, "embedded").select(F.col("vec_id").alias("site_id"))
    return tables.pending(frame(spark, d, "sites"), done, "site_id").select("site_id")


@query("anti_resume", cte("locations", "sites") + " SELECT loc_id FROM locations WHERE loc_id NOT IN (SELECT site_id FROM sites)")
def anti_resume(spark, d):
    done = frame(spark, d, "sites").select(F.col("site_id").alias("loc_id"))
    return tables.pending(frame(spark, d, "locations"), done, "loc_id").select("loc_id")


@query("keep_columns", cte("locations") + " SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, energy_type, '' AS label, '' AS region, country_code, '' AS osm_id FROM locations")
def keep_columns(spark, d):
    out = tables.keep_columns(frame(spark, d, "locations"), ["lat", "lon", "energy_type", "label", "region", "country_code", "osm_id"])
    return out.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# -- catalog look-ups -------------------------------------------------------

@query("plant_summary", cte("generators") + " SELECT plant_code, arg_min(name, generator_id) AS plant_name, arg_min(state, generator_id) AS state, round(sum(coalesce(capacity_mw, 0)), 6) AS total_capacity_mw, "
       "count(*) AS n_generators, string_agg(DISTINCT fuel_code, '|' ORDER BY fuel_code) AS energy_sources FROM generators GROUP BY 1")
def plant_summary(spark, d):
    out = eia.plant_summary(frame(spark, d, "generators"))
    return out.select("plant_code", "plant_name", "state", F.round("total_capacity_mw", 6).alias("total_capacity_mw"),
                      "n_generators", F.array_join("energy_sources", "|").alias("energy_sources"))


@query("plant_generators", cte("generators") + " SELECT generator_id, capacity_mw FROM generators WHERE plant_code=77")
def plant_generators(spark, d):
    return eia.plant_generators(frame(spark, d, "generators"), 77).select("generator_id", "capacity_mw")


@query("generators_query", cte("generators") + ", p AS (SELECT generator_id, capacity_mw FROM generators WHERE fuel_code='WND' AND status='OP' ORDER BY capacity_mw DESC NULLS LAST, generator_id LIMIT 200 OFFSET 20) SELECT * FROM p WHERE capacity_mw>=300")
def generators_query(spark, d):
    out = eia.generators_page(frame(spark, d, "generators"), fuel_type="wnd", min_capacity_mw=300.0, limit=200, offset=20)
    return out.select("generator_id", "capacity_mw")


@query("price_series", cte("generators") + " SELECT row_id, state, sector, amount FROM generators WHERE state='NATION_3' AND sector='RES' ORDER BY period DESC, row_id LIMIT 100")
def price_series(spark, d):
    out = eia.price_series(frame(spark, d, "generators"), "nation_3", "RES", 100)
    return out.select("row_id", "state", "sector", "amount")


@query("state_generation", cte("generators") + " SELECT row_id, state, fuel_code, amount FROM generators WHERE state='NATION_5' AND fuel_code='SUN' ORDER BY period DESC, row_id LIMIT 100")
def state_generation(spark, d):
    out = eia.state_generation(frame(spark, d, "generators"), "nation_5", "sun", 100)
    return out.select("row_id", "state", "fuel_code", "amount")


@query("state_renewable_summary", cte("generators") + " SELECT state, fuel_code, count(*) AS generators, round(sum(capacity_mw), 6) AS capacity_mw FROM generators WHERE fuel_code IN ('SUN','WND','WAT','GEO') GROUP BY 1,2")
def state_renewable_summary(spark, d):
    return eia.state_summary(frame(spark, d, "generators")).withColumn("capacity_mw", F.round("capacity_mw", 6))
