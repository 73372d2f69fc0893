"""Scenarios and events at rest: JSON documents with a default, a ring of the latest saved scenarios, and an allow-listed event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many scenarios are kept, the length of their names, and the events that are logged.
KEPT, NAME = 30, 80
EVENTS = (
    "app_opened", "flow_started", "document_selected", "document_read_locally", "manual_flow_selected", "review_completed", "forecast_generated",
    "improve_forecast_opened", "comparison_opened", "advanced_assumptions_opened", "retirement_age_changed",
)


def load(raw: Column, schema: str, default: Column) -> Column:
    """A JSON document, or the default where there is none or it can't be read."""
    return F.coalesce(F.when(F.get_json_object(raw, "$").isNotNull(), F.from_json(raw, schema)), default)


def save(document: Column) -> Column:
    return F.to_json(document)


def ring(scenarios: DataFrame, owner: str = "owner", most: int = KEPT, place: str | None = None) -> DataFrame:
    """Each owner's latest scenarios by saved_at (then saved_order); names are trimmed and cut, and nameless ones aren't kept.

    `place` names a new column for the number of each, the latest being 1; else the columns are those of scenarios.
    """
    if place in scenarios.columns:
        raise ValueError(f"scenarios already have a column {place}")
    number = place or "_".join([*scenarios.columns, "place"])
    named = scenarios.withColumn("name", F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, NAME)).filter("name <> ''")
    order = Window.partitionBy(owner).orderBy(F.col("saved_at").desc(), F.col("saved_order").desc())
    kept = named.withColumn(number, F.row_number().over(order)).filter(F.col(f"`{number}`") <= most)
    return kept if place else kept.drop(number)


def loaded_names(names: Column) -> Column:
    """The names of a stored array of scenarios (name, usable): the first KEPT usable ones, with a default name by place."""
    kept = F.slice(F.filter(names, lambda x: x["usable"]), 1, KEPT)
    return F.transform(kept, lambda x, i: F.substring(F.coalesce(F.when(x["name"] != "", x["name"]), F.concat(F.lit("תרחיש "), (i + 1).cast("string"))), 1, NAME))


def logged(events: DataFrame, allowed: tuple[str, ...] = EVENTS, name: str = "event_type") -> DataFrame:
    """Events that may be logged. Works on tables and on streams alike, as each row stands alone."""
    return events.filter(F.col(name).isin(*allowed))
