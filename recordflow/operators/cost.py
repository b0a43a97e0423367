"""Cost of model calls from token counts and an ordered price list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Price:
    """USD per million tokens of the models whose name contains ``key``."""

    key: str
    prompt: float
    completion: float


# List prices of May 2025, in lookup order.
PRICES = [
    Price("gpt-4o", 2.5, 10.0),
    Price("gpt-4.1", 2.0, 8.0),
    Price("gpt-4.1-mini", 0.4, 1.6),
    Price("gpt-4.1-nano", 0.1, 0.4),
    Price("o3-mini", 1.1, 4.4),
    Price("o4-mini", 1.1, 4.4),
    Price("default", 1000.0, 2000.0),
    Price("o3", 10.0, 40.0),
]


def base_model(model: Column) -> Column:
    """Model name without deployment and tag: the text before the first ``:`` and ``@``, lower-cased."""
    return F.lower(F.split_part(F.split_part(model, F.lit(":"), F.lit(1)), F.lit("@"), F.lit(1)))


def price_lookup(calls: DataFrame, prices: list[Price] | None = None, model: str = "model",
                 longest_match: bool = False) -> DataFrame:
    """Add price_key, prompt_price and completion_price.

    The first listed key contained in the base model wins, else ``default``; ``longest_match`` tries
    longer keys first, so that a shorter name does not shadow its variants. The list is
    configuration and compiles to one expression: no join.
    """
    prices = prices or PRICES
    default = next(p for p in prices if p.key == "default")
    ordered = sorted(prices, key=lambda p: -len(p.key)) if longest_match else prices
    name = base_model(F.col(model))

    def entry(price: Price) -> Column:
        return F.struct(
            F.lit(price.key).alias("key"), F.lit(float(price.prompt)).alias("prompt"),
            F.lit(float(price.completion)).alias("completion"),
        )

    chosen = F.coalesce(*[F.when(name.contains(p.key.lower()), entry(p)) for p in ordered], entry(default))
    return calls.withColumn("_price", chosen).select(
        *calls.columns, F.col("_price.key").alias("price_key"),
        F.col("_price.prompt").alias("prompt_price"), F.col("_price.completion").alias("completion_price"),
    )


def call_cost(calls: DataFrame, prices: list[Price] | None = None, **options) -> DataFrame:
    """Add prompt_cost, completion_cost and total_cost in USD."""
    priced = price_lookup(calls, prices, **options)
    costs = priced.withColumns({
        "prompt_cost": F.col("prompt_tokens") / 1e6 * F.col("prompt_price"),
        "completion_cost": F.col("completion_tokens") / 1e6 * F.col("completion_price"),
    })
    return costs.withColumn("total_cost", F.col("prompt_cost") + F.col("completion_cost"))


def cost_breakdown(costed: DataFrame, agent: str = "agent") -> DataFrame:
    """Cost and calls per agent and their ``Total``. The total adds up the per-agent rows."""
    per_agent = costed.groupBy(agent).agg(F.sum("total_cost").alias("cost"), F.count("*").alias("calls"))
    return (
        per_agent.rollup(agent)
        .agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), F.grouping(agent).alias("_total"))
        .select(F.when(F.col("_total") == 1, F.lit("Total")).otherwise(F.col(agent)).alias(agent), "cost", "calls")
    )


def cost_report(costed: DataFrame, agent: str = "agent", model: str = "model", digits: int = 8) -> DataFrame:
    """One JSON document: total cost, cost and calls per agent, and the models each agent used.

    Calls reduce to (agent, model) rows first; only those meet in the document.
    """
    pairs = costed.groupBy(agent, model).agg(F.sum("total_cost").alias("cost"), F.count("*").alias("calls"))
    agents = pairs.groupBy(agent).agg(
        F.sum("cost").alias("cost"), F.sum("calls").alias("calls"),
        F.array_join(F.sort_array(F.collect_list(model)), ",").alias("models"),
    )

    def as_map(value: Column) -> Column:
        entries = F.collect_list(F.struct(F.col(agent).alias("key"), value.alias("value")))
        return F.map_from_entries(F.sort_array(entries))

    document = agents.agg(
        F.round(F.sum("cost"), digits).alias("total_cost"),
        as_map(F.round("cost", digits)).alias("breakdown"),
        as_map(F.col("calls")).alias("api_calls"),
        as_map(F.col("models")).alias("models_used"),
    )
    return document.select(F.to_json(F.struct("*")).alias("report"))
