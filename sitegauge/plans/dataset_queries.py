"""Merging, dedup, sampling, split and report queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import scalar
from sitegauge.operators import dataset, reports
from sitegauge.operators.ranking import top_n
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.geo_queries import REGION_NEG, REGION_V2, hav
from sitegauge.plans.registry import query


def u_sql(key: str, seed: object = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || cast({key} AS varchar)), 1, 8))::bigint"


def _labelled(spark, d):
    """Locations with a label, a region and a shuffled order of their own."""
    return frame(spark, d, "locations").select(
        "*", (F.col("loc_id") % 3 == 0).cast("int").alias("label"),
        scalar.region_rules(F.col("lat"), F.col("lon")).alias("region"))


_LAB = f", lab AS (SELECT *, cast(CASE WHEN loc_id%3=0 THEN 1 ELSE 0 END AS int) AS label, {REGION_V2} AS region FROM locations)"


@query("merge_sources", cte("locations") + " SELECT loc_id, source_rank, energy_type, source, CASE WHEN source_rank=2 THEN '' ELSE name END AS name, CASE WHEN source_rank=1 THEN 0 ELSE round(capacity_mw, 6) END AS capacity_mw, "
       "CASE WHEN source_rank=2 THEN '' ELSE country_code END AS country_code FROM locations")
def merge_sources(spark, d):
    """Three files with different missing columns, united on the common ones."""
    locs = frame(spark, d, "locations")
    part = lambda i: locs.filter(F.col("source_rank") == i).drop("source_rank")
    merged = dataset.merge_sources(part(0), part(1).drop("capacity_mw"), part(2).drop("name", "country_code"))
    return merged.select("loc_id", "source_rank", "energy_type", "source", "name", F.round("capacity_mw", 6).alias("capacity_mw"), "country_code")


_SNAP = "round_even(lat/0.005::double, 0), round_even(lon/0.005::double, 0), energy_type"


@query("dedup_grid", cte("locations") + f" SELECT loc_id, source, energy_type FROM (SELECT *, row_number() OVER (PARTITION BY {_SNAP} ORDER BY source_rank, loc_id) AS rn FROM locations) WHERE rn=1")
def dedup_grid(spark, d):
    return dataset.dedup_grid(frame(spark, d, "locations")).select("loc_id", "source", "energy_type")


@query("dedup_exact", cte("locations") + " SELECT loc_id, name FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon, energy_type ORDER BY source_rank, loc_id) AS rn FROM locations) WHERE rn=1")
def dedup_exact(spark, d):
    return dataset.dedup_exact(frame(spark, d, "locations")).select("loc_id", "name")


@query("merge_pipeline_report", cte("locations", "places") + f", dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SNAP} ORDER BY source_rank, loc_id) AS rn FROM locations) WHERE rn=1), "
       f"pts AS (SELECT DISTINCT lat, lon FROM dd WHERE country_code=''), near AS (SELECT p.lat, p.lon, arg_min(c.country_code, (round({hav('p', 'c')}, 9), c.city_id)) AS cc FROM pts p, places c GROUP BY 1,2) "
       f"SELECT energy_type, region, cc AS country_code, count(*) AS n FROM (SELECT dd.energy_type, {REGION_V2.replace('lat', 'dd.lat').replace('lon', 'dd.lon')} AS region, coalesce(nullif(dd.country_code, ''), near.cc) AS cc "
       "FROM dd LEFT JOIN near ON near.lat=dd.lat AND near.lon=dd.lon) GROUP BY 1,2,3")
def merge_report(spark, d):
    """Dedup, geocode, region and counts as one lineage."""
    from sitegauge.operators.spatial import reverse_geocode
    dd = dataset.dedup_grid(frame(spark, d, "locations"))
    coded = reverse_geocode(dd, frame(spark, d, "places"), "loc_id")
    region = scalar.region_rules(F.col("lat"), F.col("lon"))
    return coded.groupBy("energy_type", region.alias("region"), "country_code").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = {"solar": 900, "wind": 700, "hydro": 300, "geothermal": 100000}


def _positives_sql(cell: str, quota: str) -> str:
    goals = " ".join(f"WHEN '{t}' THEN {n}" for t, n in _TARGETS.items())
    return (cte("locations") + f", pool AS (SELECT loc_id, energy_type, {cell} AS cell, {u_sql('loc_id')} AS u FROM locations), "
            "per AS (SELECT energy_type, count(DISTINCT cell) AS cells, count(*) AS n FROM pool GROUP BY 1), "
            f"goal AS (SELECT energy_type, cells, least(n, CASE energy_type {goals} END) AS goal FROM per), "
            f"q AS (SELECT *, greatest(1, {quota}) AS quota FROM goal), "
            "r AS (SELECT p.*, row_number() OVER (PARTITION BY energy_type, cell ORDER BY u, loc_id) AS place FROM pool p), "
            "f AS (SELECT r.loc_id, r.energy_type, q.goal, row_number() OVER (PARTITION BY r.energy_type ORDER BY CASE WHEN place<=quota THEN 0 ELSE 1 END, u, loc_id) AS k FROM r JOIN q USING (energy_type)) "
            "SELECT loc_id, energy_type FROM f WHERE k<=goal")


_ROUND_CELL = "cast(cast(round_even(lat, 0) AS bigint) AS varchar) || '_' || cast(cast(round_even(lon, 0) AS bigint) AS varchar)"
_TRUNC_CELL = "cast(cast(trunc(lat) AS bigint) AS varchar) || '_' || cast(cast(trunc(lon) AS bigint) AS varchar)"


@query("sample_positives_v1", _positives_sql(_ROUND_CELL, "ceil(goal/cells*3)"))
def sample_positives_v1(spark, d):
    return dataset.sample_positives(frame(spark, d, "locations"), _TARGETS, "loc_id", "round").select("loc_id", "energy_type")


@query("sample_positives_v2", _positives_sql(_TRUNC_CELL, "floor(goal/cells)"))
def sample_positives_v2(spark, d):
    return dataset.sample_positives(frame(spark, d, "locations"), _TARGETS, "loc_id", "trunc").select("loc_id", "energy_type")


def _uniform(seed: str, key: str = "candidate") -> str:
    return f"({u_sql(key, seed)}/4294967296.0::double)"


def negatives_sql(name: str, n: str, m: str, seed: str, style: str, occupied: str) -> str:
    """CTEs ``<name>`` (candidate, lat, lon): the first n accepted of m candidates."""
    ulat, ulon, u = _uniform(f"{seed}:lat"), _uniform(f"{seed}:lon"), _uniform(f"{seed}:keep")
    if style == "spaced":
        lat, lon = f"degrees(asin(2*{ulat}-1))", f"-180+360*{ulon}"
        land = "lat>-56 AND lat<72 AND NOT (lat<-60 OR lat>75) AND NOT (lat>-60 AND lat<-40 AND (lon<-70 OR lon>150))"
        near = ("EXISTS (SELECT 1 FROM {0}_occ p WHERE p.cy BETWEEN cast(floor(c.lat/0.05::double) AS bigint)-1 AND cast(floor(c.lat/0.05::double) AS bigint)+1 "
                "AND p.cx BETWEEN cast(floor(c.lon/0.05::double) AS bigint)-1 AND cast(floor(c.lon/0.05::double) AS bigint)+1)").format(name)
        cy, cx = "cast(floor(lat/0.05::double) AS bigint)", "cast(floor(lon/0.05::double) AS bigint)"
    else:
        lat, lon = f"-55+125*{ulat}", f"-170+350*{ulon}"
        land = "NOT (lat>-55 AND lat<-35 AND lon>-180 AND lon<-60) AND (NOT (lat>60 AND ((lon>-180 AND lon<-90) OR (lon>30 AND lon<180))) OR u<=0.3::double)"
        near = f"EXISTS (SELECT 1 FROM {name}_occ p WHERE p.cy=round_even(c.lat/0.05::double, 0) AND p.cx=round_even(c.lon/0.05::double, 0))"
        cy, cx = "round_even(lat/0.05::double, 0)", "round_even(lon/0.05::double, 0)"
    return (f"{name}_occ AS (SELECT DISTINCT {cy} AS cy, {cx} AS cx FROM ({occupied})), "
            f"{name}_cand AS (SELECT candidate, round({lat}, 6) AS lat, round({lon}, 6) AS lon, {u} AS u FROM (SELECT unnest(range({m})) AS candidate)), "
            f"{name} AS (SELECT candidate, lat, lon FROM (SELECT *, row_number() OVER (ORDER BY candidate) AS rn FROM {name}_cand c WHERE {land} AND NOT {near}) WHERE rn<={n})")


def _n_type(energy_type: str) -> str:
    return f"(SELECT count(*) FROM locations WHERE energy_type='{energy_type}')"


def _negatives(spark, d, style):
    """As many negatives of every type as it has sites."""
    locs = frame(spark, d, "locations")
    wanted = {r[0]: r[1] for r in locs.groupBy("energy_type").count().collect()}   # one row per energy type
    return dataset.negatives_by_type(locs, wanted, 42, style).select("energy_type", "candidate", "lat", "lon")


def _negatives_sql(style: str) -> str:
    """Eight candidates per wanted row are more than enough here."""
    own = lambda t: f"SELECT * FROM locations WHERE energy_type='{t}'" if style == "spaced" else "SELECT * FROM locations"
    parts = ", ".join(negatives_sql(f"neg_{t}", _n_type(t), f"8*{_n_type(t)}", f"42:{t}", style, own(t)) for t in scalar.ENERGY_TYPES)
    return cte("locations") + ", " + parts + " " + " UNION ALL ".join(
        f"SELECT '{t}' AS energy_type, candidate, lat, lon FROM neg_{t}" for t in scalar.ENERGY_TYPES)


@query("negatives_v1", _negatives_sql("spaced"))
def negatives_v1(spark, d):
    return _negatives(spark, d, "spaced")


@query("negatives_v2", _negatives_sql("sampled"))
def negatives_v2(spark, d):
    return _negatives(spark, d, "sampled")


_NEG_PARTS = ", ".join(negatives_sql(f"neg_{t}", str(n), str(n * 4), f"42:{t}", "sampled", "SELECT * FROM locations") for t, (_, n) in dataset.TARGETS.items())


@query("build_dataset", _positives_sql(_TRUNC_CELL, "floor(goal/cells)").replace(
    " ".join(f"WHEN '{t}' THEN {n}" for t, n in _TARGETS.items()), " ".join(f"WHEN '{t}' THEN {p}" for t, (p, _) in dataset.TARGETS.items())).replace(
    "SELECT loc_id, energy_type FROM f WHERE k<=goal", "").rstrip() + f", {_NEG_PARTS}, al AS (SELECT 'p' || cast(l.loc_id AS varchar) AS sample_id, l.energy_type, 1 AS label, l.country_code, l.lat, l.lon, {REGION_V2.replace('lat', 'l.lat').replace('lon', 'l.lon')} AS region "
       "FROM locations l JOIN f ON f.loc_id=l.loc_id AND f.k<=f.goal" + "".join(
    f" UNION ALL SELECT 'n{t}' || cast(candidate AS varchar), '{t}', 0, '', lat, lon, {REGION_NEG} FROM neg_{t}" for t in dataset.TARGETS) +
    f") SELECT sample_id, energy_type, label, country_code, region, round(lat, 6) AS lat, round(lon, 6) AS lon, {u_sql('sample_id')} AS shuffle_key FROM al")
def build_dataset(spark, d):
    out = dataset.build_dataset(frame(spark, d, "locations"), dataset.TARGETS, "loc_id")
    return out.select("sample_id", "energy_type", "label", "country_code", "region", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "shuffle_key")


def _goals(sql: str, targets: dict) -> str:
    """The positives oracle for other targets, without its final SELECT."""
    old = " ".join(f"WHEN '{t}' THEN {n}" for t, n in _TARGETS.items())
    new = " ".join(f"WHEN '{t}' THEN {p}" for t, (p, _) in targets.items())
    kinds = ", ".join(f"'{t}'" for t in targets)
    return sql.replace(old, new).replace("AS u FROM locations)", f"AS u FROM locations WHERE energy_type IN ({kinds}))").replace(
        "SELECT loc_id, energy_type FROM f WHERE k<=goal", "").rstrip()


_NEG_SPACED = ", ".join(negatives_sql(f"neg_{t}", str(n), str(n * 4), f"42:{t}", "spaced", f"SELECT * FROM locations WHERE energy_type='{t}'") for t, (_, n) in dataset.TARGETS_POLYGONS.items())
_BOXES_SQL = "CASE " + " ".join(f"WHEN lat>={s} AND lat<={n} AND lon>={w} AND lon<={e} THEN '{name}'" for name, s, n, w, e in scalar.CONTINENT_BOXES) + " ELSE 'Other' END"


@query("build_dataset_polygons", _goals(_positives_sql(_ROUND_CELL, "ceil(goal/cells*3)"), dataset.TARGETS_POLYGONS) + f", {_NEG_SPACED}, al AS (SELECT 'p' || cast(f.loc_id AS varchar) AS sample_id, f.energy_type, 1 AS label, l.lat, l.lon FROM f JOIN locations l ON f.loc_id=l.loc_id AND f.k<=f.goal"
       + "".join(f" UNION ALL SELECT 'n{t}' || cast(candidate AS varchar), '{t}', 0, lat, lon FROM neg_{t}" for t in dataset.TARGETS_POLYGONS)
       + f") SELECT sample_id, energy_type, label, {_BOXES_SQL} AS region FROM al")
def build_dataset_polygons(spark, d):
    """The polygon-based variant: spaced negatives per type, continent boxes."""
    out = dataset.build_dataset(frame(spark, d, "locations"), dataset.TARGETS_POLYGONS, "loc_id", style="spaced")
    return out.select("sample_id", "energy_type", "label", "region")


@query("per_group_sample", cte("locations") + f" SELECT loc_id, energy_type FROM (SELECT *, row_number() OVER (PARTITION BY energy_type ORDER BY {u_sql('loc_id')}, loc_id) AS rn FROM locations) WHERE rn<=50")
def per_group_sample(spark, d):
    return dataset.sample_per_group(frame(spark, d, "locations"), ["energy_type"], 50, "loc_id").select("loc_id", "energy_type")


@query("topn_per_group", cte("locations") + " SELECT loc_id, energy_type, country_code FROM (SELECT *, row_number() OVER (PARTITION BY energy_type, country_code ORDER BY capacity_mw DESC, loc_id) AS rn FROM locations) WHERE rn<=3")
def topn_per_group(spark, d):
    return top_n(frame(spark, d, "locations"), ["energy_type", "country_code"], [F.col("capacity_mw").desc(), "loc_id"], 3).select("loc_id", "energy_type", "country_code")


@query("anti_topup", cte("locations") + f", s AS (SELECT loc_id FROM (SELECT *, row_number() OVER (PARTITION BY energy_type ORDER BY {u_sql('loc_id')}, loc_id) AS rn FROM locations) WHERE rn<=50) SELECT loc_id FROM locations WHERE loc_id NOT IN (SELECT loc_id FROM s)")
def anti_topup(spark, d):
    locs = frame(spark, d, "locations")
    taken = dataset.sample_per_group(locs, ["energy_type"], 50, "loc_id").select("loc_id")
    return locs.join(taken, "loc_id", "left_anti").select("loc_id")


@query("stratified_split", cte("locations") + _LAB + f", r AS (SELECT loc_id, label, row_number() OVER (PARTITION BY label ORDER BY {u_sql('loc_id')}, loc_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM lab) "
       "SELECT loc_id, label, place<=round_even(n*0.2::double, 0) AS is_test FROM r")
def stratified_split(spark, d):
    return dataset.stratified_split(_labelled(spark, d), "label", "loc_id").select("loc_id", "label", "is_test")


@query("stratified_kfold", cte("locations") + _LAB + f" SELECT loc_id, cast(ntile(5) OVER (PARTITION BY label ORDER BY {u_sql('loc_id')}, loc_id)-1 AS int) AS fold FROM lab")
def stratified_kfold(spark, d):
    return dataset.stratified_folds(_labelled(spark, d), "label", "loc_id", 5).select("loc_id", "fold")


# -- reports ----------------------------------------------------------------

_DIMS = ("energy_type", "region", "source", "country_code")


@query("summary_counts", cte("locations") + _LAB + " " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM lab GROUP BY 2" for c in _DIMS))
def summary_counts(spark, d):
    return reports.summary(_labelled(spark, d), _DIMS)


def _count_by(column: str):
    def run(spark, d):
        return reports.summary(_labelled(spark, d), [column]).select("value", "n")
    return run


for _name, _column in (("count_by_type", "energy_type"), ("count_by_region", "region"), ("count_by_source", "source")):
    query(_name, cte("locations") + _LAB + f" SELECT {_column} AS value, count(*) AS n FROM lab GROUP BY 1")(_count_by(_column))


@query("count_by_country_top15", cte("locations") + " SELECT country_code AS value, count(*) AS n FROM locations GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def count_by_country(spark, d):
    return reports.top_values(reports.summary(frame(spark, d, "locations"), ["country_code"]), "country_code").select("value", "n")


@query("count_by_type_label", cte("locations") + _LAB + " SELECT energy_type, label, count(*) AS n FROM lab GROUP BY 1,2")
def count_by_type_label(spark, d):
    return reports.count_by_label(_labelled(spark, d))


@query("region_mix_positives", cte("locations") + _LAB + " SELECT energy_type, region, count(*) AS n FROM lab WHERE label=1 GROUP BY 1,2")
def region_mix_positives(spark, d):
    return reports.region_mix(_labelled(spark, d))


@query("spatial_separation", cte("locations") + _LAB + ", m AS (SELECT energy_type, avg(lat) FILTER (WHERE label=1) AS pa, avg(lon) FILTER (WHERE label=1) AS po, avg(lat) FILTER (WHERE label=0) AS na, avg(lon) FILTER (WHERE label=0) AS no FROM lab GROUP BY 1) "
       "SELECT energy_type, round(pa, 6) AS pos_lat, round(po, 6) AS pos_lon, round(na, 6) AS neg_lat, round(no, 6) AS neg_lon, round(sqrt(pow(pa-na,2)+pow(po-no,2)), 6) AS distance_deg FROM m")
def spatial_separation(spark, d):
    out = reports.spatial_separation(_labelled(spark, d))
    return out.select("energy_type", *[F.round(c, 6).alias(c) for c in out.columns if c != "energy_type"])


@query("time_split_summary", cte("locations") + ", y AS (SELECT energy_type, cast(operating_year AS int) AS y FROM locations WHERE regexp_matches(operating_year, '^[0-9]{4}$')) "
       "SELECT energy_type, min(y) AS min_year, max(y) AS max_year, count(*) FILTER (WHERE y<2020) AS n_before, count(*) FILTER (WHERE y>=2020) AS n_after FROM y GROUP BY 1")
def time_split_summary(spark, d):
    return reports.time_split(frame(spark, d, "locations"))


_TYPES = scalar.ENERGY_TYPES
_QC = (cte("locations") + ", lab AS (SELECT CASE WHEN loc_id%101=0 THEN 91::double ELSE lat END AS lat, lon, energy_type, CASE WHEN loc_id%3=0 THEN 1 ELSE 0 END AS label, CASE WHEN energy_type='hydro' THEN 'Asia' ELSE "
       + REGION_V2 + " END AS region FROM locations WHERE NOT (energy_type='geothermal' AND loc_id%3<>0)), "
       "checks AS (SELECT 'no_nan_lat' AS \"check\", count(*) FILTER (WHERE lat IS NULL)=0 AS passed FROM lab UNION ALL SELECT 'no_nan_lon', count(*) FILTER (WHERE lon IS NULL)=0 FROM lab UNION ALL "
       "SELECT 'no_nan_energy_type', count(*) FILTER (WHERE energy_type IS NULL)=0 FROM lab UNION ALL SELECT 'no_nan_label', count(*) FILTER (WHERE label IS NULL)=0 FROM lab UNION ALL "
       "SELECT 'valid_labels', count(*) FILTER (WHERE label NOT IN (0,1))=0 FROM lab UNION ALL SELECT 'valid_coords', count(*) FILTER (WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180)=0 FROM lab UNION ALL "
       "SELECT 'no_duplicates', count(*)=count(DISTINCT (lat, lon, energy_type)) FROM lab UNION ALL "
       "SELECT 'balance_' || energy_type, CASE WHEN count(*) FILTER (WHERE label=0)=0 THEN false ELSE count(*) FILTER (WHERE label=1)/count(*) FILTER (WHERE label=0)>0.3::double AND count(*) FILTER (WHERE label=1)/count(*) FILTER (WHERE label=0)<3 END FROM lab GROUP BY energy_type UNION ALL "
       "SELECT 'geo_diversity_' || energy_type, count(DISTINCT CASE WHEN label=1 THEN region END)>=2 FROM lab GROUP BY energy_type)")


def _quality(spark, d):
    """Data with planted faults: bad latitudes, a one-region type and a type without negatives."""
    df = _labelled(spark, d).filter(~((F.col("energy_type") == "geothermal") & (F.col("loc_id") % 3 != 0)))
    return reports.data_quality(df.withColumns({
        "lat": F.when(F.col("loc_id") % 101 == 0, F.lit(91.0)).otherwise(F.col("lat")),
        "region": F.when(F.col("energy_type") == "hydro", F.lit("Asia")).otherwise(F.col("region"))}))


@query("data_quality", _QC + " SELECT * FROM checks")
def data_quality(spark, d):
    return _quality(spark, d)


@query("data_quality_rate", _QC + " SELECT count(*) FILTER (WHERE passed) AS n_pass, count(*) AS n_total FROM checks")
def data_quality_rate(spark, d):
    return reports.pass_rate(_quality(spark, d))


@query("embedding_quality", cte("vectors") + ", x AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS dim FROM vectors), dd AS (SELECT dim, stddev_pop(v) AS sd FROM x GROUP BY 1), "
       "r AS (SELECT vec_id, bool_or(isnan(v)) AS bad, min(v)=max(v) AS flat FROM x GROUP BY 1) SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM r WHERE bad) AS nan_rows, (SELECT count(*) FROM r WHERE flat) AS degenerate_rows, "
       "(SELECT count(*) FROM dd) AS n_dims, (SELECT count(*) FROM dd WHERE sd>0.001) AS active_dims")
def embedding_quality(spark, d):
    return reports.embedding_quality(frame(spark, d, "vectors"))


@query("spatial_cv_eligibility", cte("embedded") + " SELECT country_code, count(*) FILTER (WHERE label=1) AS n_pos, count(*) FILTER (WHERE label=0) AS n_neg FROM embedded GROUP BY 1 HAVING count(*) FILTER (WHERE label=1)>=5 AND count(*) FILTER (WHERE label=0)>=5")
def spatial_cv_eligibility(spark, d):
    return reports.eligible_groups(frame(spark, d, "embedded"), "country_code")


_HOLD = (cte("locations") + ", y AS (SELECT *, try_cast(operating_year AS int) AS built FROM locations), tr AS (SELECT DISTINCT lat, lon FROM y WHERE built<2020), "
         "te AS (SELECT * FROM y WHERE built>=2020), tp AS (SELECT DISTINCT lat, lon FROM te), "
         f"nr AS (SELECT tp.lat, tp.lon, min({hav('tp', 'tr')}) AS km FROM tp, tr GROUP BY 1,2)")


@query("temporal_holdout", _HOLD + " SELECT te.loc_id, round(km, 6) AS train_km, km>200 AS independent FROM te JOIN nr ON nr.lat=te.lat AND nr.lon=te.lon")
def temporal_holdout(spark, d):
    out = reports.temporal_holdout(frame(spark, d, "locations"), "loc_id")
    return out.select("loc_id", F.round("train_km", 6).alias("train_km"), "independent")
