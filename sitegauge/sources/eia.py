"""Generator statistics: landed API pages to rows, plus the usual look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scalar import safe_double

# Fuel codes and the energy type each one stands for.
FUEL_CODES = {
    "SUN": "solar", "WND": "wind", "NG": "gas", "COL": "coal", "NUC": "nuclear", "WAT": "hydro",
    "OIL": "oil", "WDS": "biomass", "BIT": "coal", "SUB": "coal", "LIG": "coal", "PC": "oil",
    "DFO": "oil", "RFO": "oil", "GEO": "geothermal", "MWH": "storage", "WH": "other",
    "BLQ": "biomass", "OBG": "biomass", "AB": "biomass", "MSW": "biomass", "LFG": "biomass",
}
RENEWABLE_FUELS = ("SUN", "WND", "WAT", "GEO")
NOT_IN_GLOBAL_MAP = ("OIL", "LIG", "PC", "BLQ", "MSW")

# Status words and their codes.
STATUS_CODES = {"operating": "OP", "proposed": "P", "retired": "RE"}

PAGE_SCHEMA = (
    "response struct<data: array<struct<latitude: string, longitude: string, plantName: string, "
    "plantid: string, `nameplate-capacity-mw`: string, `operating-year-month`: string, "
    "energy_source_code: string, energySourceCode: string, stateid: string, entityName: string, status: string>>>"
)


def fuel_map(kind: str = "full") -> dict[str, str]:
    """The ``full`` table, the ``global`` ingest subset or the ``renewable`` four."""
    if kind == "renewable":
        return {c: FUEL_CODES[c] for c in RENEWABLE_FUELS}
    if kind == "global":
        return {c: t for c, t in FUEL_CODES.items() if c not in NOT_IN_GLOBAL_MAP}
    return dict(FUEL_CODES)


def fuel_frame(spark: SparkSession, kind: str = "full") -> DataFrame:
    return spark.createDataFrame(list(fuel_map(kind).items()), "fuel_code string, mapped_type string")


def map_fuel(df: DataFrame, kind: str = "full", code: str = "fuel_code") -> DataFrame:
    """Add ``energy_type``; unknown codes become ``other``. The map is a constant of 22 rows."""
    table = F.broadcast(fuel_frame(df.sparkSession, kind).withColumnRenamed("fuel_code", "_code"))
    joined = df.join(table, F.col(code) == F.col("_code"), "left")
    return joined.withColumn("energy_type", F.coalesce("mapped_type", F.lit("other"))).drop("_code", "mapped_type")


def _present(text: Column) -> Column:
    """A coordinate counts when it is a non-zero number."""
    return F.coalesce(text.try_cast("double") != 0.0, F.lit(False))


def parse_pages(pages: DataFrame, need_fuel: bool = True, value: str = "value") -> DataFrame:
    """Explode landed JSON pages into location rows; unusable records are dropped."""
    record = pages.select(F.explode(F.from_json(value, PAGE_SCHEMA)["response"]["data"]).alias("r"))
    fuel = F.coalesce(F.nullif("r.energy_source_code", F.lit("")), F.nullif("r.energySourceCode", F.lit("")))
    rows = record.filter(_present(F.col("r.latitude")) & _present(F.col("r.longitude")))
    if need_fuel:
        rows = rows.filter(fuel.isNotNull())
    capacity = F.coalesce(F.nullif(F.col("r").getField("nameplate-capacity-mw"), F.lit("")), F.lit("0"))
    parsed = rows.select(
        F.col("r.plantid").alias("plant_code"),
        F.col("r.latitude").try_cast("double").alias("lat"), F.col("r.longitude").try_cast("double").alias("lon"),
        fuel.alias("fuel_code"), F.coalesce("r.plantName", F.lit("")).alias("name"),
        capacity.try_cast("double").alias("capacity_mw"),
        F.substring(F.coalesce(F.col("r").getField("operating-year-month"), F.lit("")), 1, 4).alias("operating_year"),
        F.col("r.stateid").alias("state"), F.col("r.entityName").alias("entity_name"), F.col("r.status").alias("status"))
    readable = parsed.filter(F.col("capacity_mw").isNotNull())
    return map_fuel(readable, "global").withColumns({"source": F.lit("eia_860"), "country_code": F.lit("US")})


def plant_summary(generators: DataFrame) -> DataFrame:
    """One row per plant: leading attributes, capacity, energy sources, number of generators.

    The attributes are those of the first generator. The generators themselves
    stay rows (see ``plant_generators``): a list per plant would grow without bound.
    """
    first = F.min_by(F.struct("name", "state", "entity_name", "lat", "lon"), "generator_id")
    return generators.groupBy("plant_code").agg(
        first.alias("f"),
        F.sum(safe_double(F.col("capacity_mw"))).alias("total_capacity_mw"),
        F.count(F.lit(1)).alias("n_generators"),
        F.array_sort(F.collect_set(F.coalesce("fuel_code", F.lit("")))).alias("energy_sources"),
    ).select("plant_code", F.coalesce("f.name", F.lit("Unknown")).alias("plant_name"), "f.state", "f.entity_name",
             safe_double(F.col("f.lat")).alias("latitude"), safe_double(F.col("f.lon")).alias("longitude"),
             "total_capacity_mw", "n_generators", "energy_sources")


def plant_generators(generators: DataFrame, plant_code: int) -> DataFrame:
    """The generators of one plant."""
    return generators.filter(F.col("plant_code") == plant_code)


def generators_page(df: DataFrame, state: str | None = None, fuel_type: str | None = None,
                    min_capacity_mw: float | None = None, status: str | None = "operating",
                    limit: int = 5000, offset: int = 0) -> DataFrame:
    """One page of generators, largest first. The capacity floor applies after paging."""
    rows = df
    if state:
        rows = rows.filter(F.col("state") == state.upper())
    if fuel_type:
        rows = rows.filter(F.col("fuel_code") == fuel_type.upper())
    if status:
        rows = rows.filter(F.col("status") == STATUS_CODES.get(status, status))
    page = rows.orderBy(F.col("capacity_mw").desc(), "generator_id").offset(offset).limit(limit)
    return page if min_capacity_mw is None else page.filter(F.col("capacity_mw") >= min_capacity_mw)


def price_series(df: DataFrame, state: str | None = None, sector: str = "ALL", limit: int = 5000) -> DataFrame:
    """Retail prices, newest first."""
    rows = df if state is None else df.filter(F.col("state") == state.upper())
    if sector != "ALL":
        rows = rows.filter(F.col("sector") == sector)
    return rows.orderBy(F.col("period").desc(), "row_id").limit(limit)


def state_generation(df: DataFrame, state: str, fuel_type: str | None = None, limit: int = 5000) -> DataFrame:
    """Generation of one state, newest first."""
    rows = df.filter(F.col("state") == state.upper())
    if fuel_type:
        rows = rows.filter(F.col("fuel_code") == fuel_type.upper())
    return rows.orderBy(F.col("period").desc(), "row_id").limit(limit)


def state_summary(df: DataFrame) -> DataFrame:
    """Generators and capacity per state and renewable fuel."""
    return df.filter(F.col("fuel_code").isin(*RENEWABLE_FUELS)).groupBy("state", "fuel_code").agg(
        F.count(F.lit(1)).alias("generators"), F.sum("capacity_mw").alias("capacity_mw"))
