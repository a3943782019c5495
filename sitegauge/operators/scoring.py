"""Weighted suitability scores as one projection over the measurement columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.factors import (
    CATALOG, ENERGY_TYPES, MEASUREMENTS, Factor, default_weights, with_measurements)
from sitegauge.functions.scalar import clamp, confidence_band, report_round
from sitegauge.operators.spatial import nearest_within

# Measurements a site can carry and where they come from.
MEASUREMENT_SOURCES = {
    "ghi_kwh_m2_day": "NASA POWER",
    "wind_speed_ms": "NASA POWER",
    "avg_temp_c": "NASA POWER",
    "cloud_fraction": "NASA POWER",
    "precipitation_mm_day": "NASA POWER",
    "elevation_m": "Open-Elevation",
    "slope_degrees": "Open-Elevation",
    "head_m": "Open-Elevation",
    "discharge_m3s": "Open-Meteo Flood",
    "earthquake_density": "USGS Earthquake",
}

# Well-known comparison sites (name, lat, lon, state).
PRESET_SITES = (
    ("Alabama, US — Solar Farm", 30.84, -87.34, "AL"),
    ("Kansas, US — Wind Farm", 37.55, -98.24, "KS"),
    ("Morocco — Solar Site", 34.30, -5.66, ""),
    ("Spain — Solar Site", 42.53, -7.54, ""),
    ("Siberia, Russia — Remote", 59.38, 138.72, ""),
    ("Amazon, Brazil — Rainforest", -2.81, -64.79, ""),
    ("Northern Canada — Wilderness", 64.56, -126.03, ""),
    ("Alaska, US — Remote", 55.00, -134.72, ""),
)


def presets_frame(spark: SparkSession) -> DataFrame:
    rows = [(-(i + 1), *site) for i, site in enumerate(PRESET_SITES)]
    return spark.createDataFrame(rows, "site_id bigint, name string, lat double, lon double, state string")


@dataclass(frozen=True)
class Scorecard:
    """Which factors count for one energy type, and how much.

    Immutable: every change returns a new scorecard, so a plan already built
    from an older one keeps its meaning.
    """

    energy_type: str
    factors: tuple[Factor, ...]
    weights: Mapping[str, float]
    disabled: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, energy_type: str, custom_weights: Mapping[str, float] | None = None,
           extra: Iterable[Factor] = ()) -> Scorecard:
        """Default scorecard; unknown names in ``custom_weights`` are ignored with a warning."""
        if energy_type not in ENERGY_TYPES:
            raise ValueError(f"energy_type must be one of {ENERGY_TYPES}, not {energy_type!r}")
        factors = tuple(f for f in (*CATALOG, *extra) if f.applies_to(energy_type))
        table = default_weights(energy_type)
        weights = {f.name: table.get(f.name, f.weight) for f in factors}
        for name, weight in (custom_weights or {}).items():
            if name in weights:
                weights[name] = weight
            else:
                warnings.warn(f"no factor named {name!r} for {energy_type}; weight ignored", stacklevel=2)
        return cls(energy_type, factors, weights)

    def _check(self, name: str) -> None:
        if name not in self.weights:
            raise KeyError(name)

    def with_weight(self, name: str, weight: float) -> Scorecard:
        self._check(name)
        if weight < 0:
            raise ValueError("a weight must not be negative")
        return replace(self, weights={**self.weights, name: weight})

    def disable(self, name: str) -> Scorecard:
        self._check(name)
        return replace(self, disabled=self.disabled | {name})

    def enable(self, name: str) -> Scorecard:
        self._check(name)
        return replace(self, disabled=self.disabled - {name})

    @property
    def active(self) -> tuple[Factor, ...]:
        return tuple(f for f in self.factors if f.name not in self.disabled)

    def overall(self, scores: Mapping[str, Column]) -> Column:
        """Weighted mean of the active factors; a user's factor that gave NULL is left out.

        Built-in scores are never NULL: their weights add up here, not per row.
        """
        own = [f for f in self.active if f not in CATALOG]
        fixed = sum(float(self.weights[f.name]) for f in self.active if f in CATALOG)
        terms = [F.lit(float(self.weights[f.name])) * scores[f.name] for f in self.active if f in CATALOG]
        terms += [F.coalesce(F.lit(float(self.weights[f.name])) * scores[f.name], F.lit(0.0)) for f in own]
        if not terms:
            return F.lit(0.0)
        total = reduce(lambda a, b: a + b, terms)
        if not own:
            return total / F.lit(fixed) if fixed > 0 else F.lit(0.0)
        weight = reduce(lambda a, b: a + b, [F.lit(fixed)] + [
            F.when(scores[f.name].isNotNull(), F.lit(float(self.weights[f.name]))).otherwise(F.lit(0.0)) for f in own])
        return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def register_factor(name: str, energy_types: tuple[str, ...], weight: float,
                    score: Callable[[], Column]) -> Factor:
    """A user-defined factor: any Column expression, or a pandas UDF call."""
    return Factor(name.lower().replace(" ", "_"), name, energy_types, weight, score)


def factor_matrix(df: DataFrame, keep: Iterable[str] = ("site_id",)) -> DataFrame:
    """All nineteen factor scores side by side."""
    return with_measurements(df).select(*keep, *[f.score().alias(f.key) for f in CATALOG])


def _score_columns(factors: Iterable[Factor]) -> list[Column]:
    """Scores under their inner names. Built-in factors stay in [0, 1] by themselves."""
    return [(f.score() if f in CATALOG else clamp(f.score())).alias(f"_f_{f.key}") for f in factors]


def score_sites(df: DataFrame, card: Scorecard, detail: bool = False) -> DataFrame:
    """Add ``overall_score``; with ``detail`` also the score and weight maps.

    One projection without a shuffle. Factor columns are materialised once in an
    inner projection, so the weighted mean does not evaluate them again.
    """
    active = card.active
    wide = with_measurements(df).select("*", *_score_columns(active))
    scores = {f.name: F.col(f"_f_{f.key}") for f in active}
    out = wide.withColumns({"overall_score": card.overall(scores), "energy_type": F.lit(card.energy_type)})
    if detail:
        names = F.array(*[F.lit(f.name) for f in active]) if active else F.array().cast("array<string>")
        values = F.array(*[F.coalesce(scores[f.name], F.lit(0.0)) for f in active]) if active else F.array().cast("array<double>")
        weights = F.array(*[F.lit(float(card.weights[f.name])) for f in active]) if active else F.array().cast("array<double>")
        out = out.withColumns({"factor_scores": F.map_from_arrays(names, values),
                               "factor_weights": F.map_from_arrays(names, weights)})
    absent = [m for m in MEASUREMENTS if m not in df.columns]
    return out.drop(*[f"_f_{f.key}" for f in active], *absent)


def score_all_types(df: DataFrame, keep: Iterable[str | Column] = ("site_id",)) -> DataFrame:
    """One row per site and energy type; shared factors are computed once per site."""
    wide = with_measurements(df).select(*keep, *_score_columns(CATALOG))
    kept = [c for c in wide.columns if not c.startswith("_f_")]
    rows = []
    for energy_type in ENERGY_TYPES:
        card = Scorecard.of(energy_type)
        overall = card.overall({f.name: F.col(f"_f_{f.key}") for f in card.active})
        rows.append(F.struct(F.lit(energy_type).alias("energy_type"), overall.alias("overall_score")))
    return wide.select(*kept, F.explode(F.array(*rows)).alias("r")).select(*kept, "r.*")


def data_sources(df: DataFrame) -> DataFrame:
    """Map of the measurements a site has: name -> (source, rounded value)."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("key"), F.struct(F.lit(source).alias("source"),
                 report_round(F.col(name).cast("double"), 3).alias("value")).alias("value"))
        for name, source in MEASUREMENT_SOURCES.items()])
    present = F.filter(entries, lambda e: e["value"]["value"].isNotNull())
    return df.withColumn("data_sources", F.map_from_entries(present))


def split_measured(scores: Column) -> tuple[Column, Column]:
    """(measured, estimated) parts of a score map: estimated means exactly 0.5."""
    return F.map_filter(scores, lambda _, v: v != 0.5), F.map_filter(scores, lambda _, v: v == 0.5)


def rounded_report(df: DataFrame) -> DataFrame:
    """Report rounding: four digits, ties to even."""
    four = lambda _, v: report_round(v, 4)
    return df.withColumns({
        "overall_score": report_round("overall_score", 4),
        "factor_scores": F.transform_values("factor_scores", four),
        "factor_weights": F.transform_values("factor_weights", four)})


def combined_score(factor_score: Column, ml_score: Column) -> Column:
    """60 % model, 40 % factors; factors alone when no model score exists."""
    return F.coalesce(0.6 * ml_score + 0.4 * factor_score, factor_score)


def ml_score_nearest(sites: DataFrame, scored_points: DataFrame, site_id: str = "site_id",
                     point_id: str = "vec_id", inclusive: bool = False) -> DataFrame:
    """Attach the model score of the nearest embedded location within half a degree."""
    # The score travels with the id, so a point that serves many sites is never a join key.
    tagged = scored_points.select("lat", "lon", F.struct(point_id, "ml_score").alias("_point"))
    found = nearest_within(sites, tagged, 0.5, site_id, "_point", inclusive).select(
        site_id, "distance", F.col(f"nearest_id.{point_id}").alias("nearest_id"), "nearest_id.ml_score")
    return sites.join(found, site_id, "left").withColumn("ml_available", F.col("ml_score").isNotNull())


def suitability_report(df: DataFrame, card: Scorecard, confidence_on: str = "factor") -> DataFrame:
    """Factor score, combined score and confidence for rows that carry ``ml_score``."""
    scored = score_sites(df, card)
    both = combined_score(F.col("overall_score"), F.col("ml_score"))
    out = scored.withColumn("combined_score", both)
    return out.withColumn("confidence", confidence_band(
        F.col("combined_score") if confidence_on == "combined" else F.col("overall_score")))


def describe(card: Scorecard, spark: SparkSession) -> DataFrame:
    """The scorecard as rows, in catalog order."""
    rows = [(i, f.name, list(f.energy_types), float(card.weights[f.name]), f.name not in card.disabled)
            for i, f in enumerate(card.factors)]
    return spark.createDataFrame(
        rows, "position int, factor string, energy_types array<string>, weight double, enabled boolean")


