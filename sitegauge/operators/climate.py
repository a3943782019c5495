"""Climate-risk projection: one projection per site and scenario, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.functions.scalar import cases, report_round

# Projected change per scenario in the knot years below;
# temperature in degrees C, precipitation in percent, and the severity factor.
KNOT_YEARS = (2030, 2050, 2070, 2100)
SCENARIOS = {
    "SSP126": {"temperature": (0.6, 1.0, 1.2, 1.4), "precipitation": (1.0, 2.0, 2.5, 3.0), "severity": 0.8},
    "SSP245": {"temperature": (0.7, 1.4, 2.0, 2.7), "precipitation": (1.5, 3.0, 4.5, 5.5), "severity": 1.0},
    "SSP370": {"temperature": (0.7, 1.6, 2.5, 3.6), "precipitation": (1.5, 3.5, 5.5, 7.0), "severity": 1.2},
    "SSP585": {"temperature": (0.8, 1.9, 3.1, 4.4), "precipitation": (2.0, 4.5, 7.0, 9.0), "severity": 1.5},
}
FALLBACK_SCENARIO = "SSP245"

# Used where a site has no measurement.
DEFAULTS = {
    "ghi_kwh_m2_day": 4.5, "wind_speed_ms": 5.0, "avg_temp_c": 15.0,
    "cloud_fraction": 0.5, "precipitation_mm_day": 2.0,
}


def knots_frame(spark: SparkSession) -> DataFrame:
    """Projection table (scenario, variable, year, delta)."""
    rows = [(s, v, y, d) for s, spec in SCENARIOS.items() for v in ("temperature", "precipitation")
            for y, d in zip(KNOT_YEARS, spec[v])]
    return spark.createDataFrame(rows, "scenario string, variable string, year int, delta double")


def segments(knots: DataFrame) -> DataFrame:
    """Knots paired with their successor: the linear pieces of each projection."""
    w = Window.partitionBy("scenario", "variable").orderBy("year")
    return knots.select("scenario", "variable", F.col("year").alias("y0"), F.col("delta").alias("d0"),
                        F.lead("year").over(w).alias("y1"), F.lead("delta").over(w).alias("d1"))


def known_scenario(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.isin(*SCENARIOS), upper).otherwise(F.lit(FALLBACK_SCENARIO))


def interpolate_one(values: tuple[float, ...], year: Column) -> Column:
    """Change of one scenario in a year, linear between the knots and constant outside them."""
    pieces = [(year <= KNOT_YEARS[0], F.lit(values[0]))]
    for y0, y1, d0, d1 in zip(KNOT_YEARS, KNOT_YEARS[1:], values, values[1:]):
        pieces.append((year <= y1, F.lit(d0) + (year - y0) / F.lit(float(y1 - y0)) * F.lit(d1 - d0)))
    return cases(*pieces, otherwise=F.lit(values[-1]))


def interpolate(scenario: Column, year: Column, variable: str) -> Column:
    """The same, with the scenario taken from a column."""
    return cases(*[(scenario == s, interpolate_one(spec[variable], year)) for s, spec in SCENARIOS.items()],
                 otherwise=interpolate_one(SCENARIOS[FALLBACK_SCENARIO][variable], year))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill missing climate measurements; ``has_climate`` tells whether any was real."""
    real = F.coalesce(*[F.col(c) for c in DEFAULTS]).isNotNull()
    return df.withColumns({"has_climate": real, **{
        f"now_{c}": F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}})


def _events(dt: Column, dp: Column) -> dict[str, Column]:
    """Probabilities of the four extreme events under a temperature and rain change."""
    north = F.abs(F.col("lat"))
    temp, rain = F.col("now_avg_temp_c"), F.col("now_precipitation_mm_day")
    zero = F.lit(0.0)
    return {
        "cyclone": F.when((north > 5) & (north < 30), 0.15 * (1.0 + 0.1 * dt)).otherwise(zero),
        "heat": F.when(temp > 20, F.greatest(zero, F.least(F.lit(0.8), (temp + dt - 25.0) * 0.05))).otherwise(zero),
        "flood": F.least(F.lit(0.5), rain * 0.03 * (1.0 + dp / 100.0)),
        "drought": F.greatest(zero, 0.5 - 0.05 * rain) * (1.0 + 0.05 * dt),
    }


def _risk(events: dict[str, Column], severity: Column) -> Column:
    weighted = 0.3 * events["heat"] + 0.25 * events["flood"] + 0.25 * events["cyclone"] + 0.2 * events["drought"]
    return F.least(F.lit(1.0), weighted * severity)


def _ghi_year(dt: Column) -> Column:
    return F.col("now_ghi_kwh_m2_day") * 365.0 * (1.0 - 0.005 * dt)


def assess(df: DataFrame, scenario: Column, year: Column) -> DataFrame:
    """Append the projected resources, event probabilities and risk of every site."""
    base = with_defaults(df).withColumns({"scenario": known_scenario(scenario), "target_year": year})
    base = base.withColumns({"dt": interpolate(F.col("scenario"), F.col("target_year"), "temperature"),
                             "dp": interpolate(F.col("scenario"), F.col("target_year"), "precipitation")})
    dt = F.col("dt")
    parts = base.withColumns({"ghi_year": _ghi_year(dt), "wind": F.col("now_wind_speed_ms") * (1.0 + 0.01 * dt),
                              **_events(dt, F.col("dp"))})
    severity = cases(*[(F.col("scenario") == s, F.lit(spec["severity"])) for s, spec in SCENARIOS.items()],
                     otherwise=F.lit(1.0))
    events = {name: F.col(name) for name in ("cyclone", "heat", "flood", "drought")}
    risk = parts.withColumns({"risk": _risk(events, severity), "spread": 0.1 + 0.02 * dt})

    def bands(value: str, low: float, high: float, digits: int) -> Column:
        v = F.col(value)
        return F.struct(report_round(v * low, digits).alias("p10"), report_round(v, digits).alias("p50"),
                        report_round(v * high, digits).alias("p90"))

    names = {"tropical_cyclone": "cyclone", "extreme_heat": "heat", "flooding": "flood", "drought": "drought"}
    return risk.select(
        *df.columns, "scenario", "target_year",
        report_round("risk", 3).alias("risk_score"),
        bands("ghi_year", 0.9, 1.1, 0).alias("solar_ghi_kwh_m2_year"),
        bands("wind", 0.85, 1.15, 1).alias("wind_speed_projection"),
        F.create_map(*[x for k, c in names.items() for x in (F.lit(k), report_round(c, 3))]).alias("extreme_event_probs"),
        report_round("dt", 1).alias("temperature_change_c"),
        report_round("dp", 1).alias("precipitation_change_pct"),
        F.when(F.col("has_climate"), F.lit(0.85)).otherwise(F.lit(0.5)).alias("confidence"),
        F.array(report_round(F.greatest(F.lit(0.0), F.col("risk") - F.col("spread")), 3),
                report_round(F.least(F.lit(1.0), F.col("risk") + F.col("spread")), 3)).alias("uncertainty_range"),
    )


def assess_all(df: DataFrame, year: Column) -> DataFrame:
    """Every site under all scenarios: the scenarios are a constant array, not a join."""
    names = F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("_scenario")
    wide = df.select("*", names)
    return assess(wide, F.col("_scenario"), year).drop("_scenario")


def compare_scenarios(df: DataFrame, year: Column, keep: str = "site_id") -> DataFrame:
    """Risk, warming and median irradiation of all scenarios side by side, one row per site.

    The scenarios become columns of one projection: no row is multiplied or shuffled.
    """
    columns = [F.col(keep)]
    for s, spec in SCENARIOS.items():
        dt, dp = (interpolate_one(spec[v], year) for v in ("temperature", "precipitation"))
        risk = _risk(_events(dt, dp), F.lit(spec["severity"]))
        columns += [report_round(risk, 3).alias(f"risk_{s.lower()}"), report_round(dt, 1).alias(f"warming_{s.lower()}"),
                    report_round(_ghi_year(dt), 0).alias(f"ghi_p50_{s.lower()}")]
    return with_defaults(df).select(*columns)
