"""Costs of measured events under several price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (price table, component, measure, units, dollars for so many units).
PRICES = [
    ("current", "ocr", "pages", 1, 0.0015),
    ("current", "embedding", "tokens", 1000, 0.00002),
    ("current", "llm", "input_tokens", 1000, 0.00015),
    ("current", "llm", "output_tokens", 1000, 0.0006),
    ("current", "crawl", "pages", 1, 0.0),
    ("open_weight", "ocr", "pages", 1, 0.0),
    ("open_weight", "embedding", "tokens", 1000, 0.0),
    ("open_weight", "llm", "input_tokens", 1000, 0.0),
    ("open_weight", "llm", "output_tokens", 1000, 0.0),
    ("open_weight", "crawl", "pages", 1, 0.0),
]
MEASURES = ["pages", "tokens", "input_tokens", "output_tokens"]


def component_costs(events: DataFrame, prices: list[tuple[str, str, str, int, float]] = PRICES) -> DataFrame:
    """``(component, events, seconds, engine, cost_usd, cost_usd_<table> for each other table)`` from events ``(component, at, seconds, engine, *MEASURES)``.

    Names of components are trimmed and lower-cased; null measures count 0; the engine is the first
    one by ``at`` that isn't blank. Components without a price cost 0, as their time still counts.
    Prices are a configured list, so they are column expressions over the sums of a component.
    """
    name = F.lower(F.trim("component")).alias("component")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    engine = F.coalesce(F.min_by("engine", F.when(F.col("engine") != "", F.col("at"))), F.lit("")).alias("engine")
    sums = events.groupBy(name).agg(F.count(F.lit(1)).alias("events"), total("seconds"), engine, *map(total, MEASURES))
    tables = list(dict.fromkeys(p[0] for p in prices))
    cost = lambda t: sum((F.when(F.col("component") == c, F.col(m) / per * usd).otherwise(0.0) for s, c, m, per, usd in prices if s == t), F.lit(0.0))
    return sums.select("component", "events", "seconds", "engine", *(cost(t).alias("cost_usd" if i == 0 else f"cost_usd_{t}") for i, t in enumerate(tables)))
