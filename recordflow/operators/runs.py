"""Logged runs: what is still to do, reports per configuration, best settings and their progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Iterations per window of ``iteration_delta``.
_BLOCK = 1_000


def resume_pending(docs: DataFrame, results: DataFrame, key: str, success: str) -> DataFrame:
    """Inputs without a successful result: new ones and failed ones."""
    done = results.where(F.col(success)).select(key).distinct()
    return docs.join(done, key, "left_anti")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, met, "left").drop(*[f"_right_{k}" for k in keys])


def _nearest_rank(results: DataFrame, config: str, millis: str, share: float) -> DataFrame:
    """Exact nearest-rank percentile of whole milliseconds per configuration.

    Times reduce map-side to a histogram; seconds are ranked first and then only the milliseconds
    of the second that holds the rank, so no window sees more than the distinct seconds of a
    configuration or a thousand rows.
    """
    histogram = results.groupBy(config, millis).agg(F.count("*").alias("_n"))
    second = F.floor(F.col(millis) / 1000).alias("_second")
    seconds = histogram.groupBy(config, second).agg(F.sum("_n").alias("_n"))
    above = Window.partitionBy(config).orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    total = seconds.groupBy(config).agg(F.sum("_n").alias("_total"))
    placed = (
        seconds.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
        .transform(lambda df: _null_safe_join(df, total, [config]))
        .withColumn("_rank", F.ceil(F.col("_total") * share))
        .where((F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_n") >= F.col("_rank")))
        .select(config, "_second", "_before", "_rank")
    )
    inside = Window.partitionBy(config).orderBy(millis).rowsBetween(Window.unboundedPreceding, 0)
    fine = _null_safe_join(histogram.withColumn("_second", F.floor(F.col(millis) / 1000)), placed, [config, "_second"]).where(F.col("_rank").isNotNull())
    reached = fine.withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    return reached.where(F.col("_upto") >= F.col("_rank")).groupBy(config).agg(F.min(millis).alias("_p"))


def run_report(results: DataFrame, config: str, digits: int = 6) -> DataFrame:
    """Runs, success rate, mean and p95 time (seconds), tokens and cost per configuration.

    Input columns: config, success, time_ms, tokens, cost.
    """
    base = results.groupBy(config).agg(
        F.count("*").alias("runs"),
        F.round(F.count_if("success") / F.count("*"), digits).alias("success_rate"),
        F.round(F.sum("time_ms") / F.count("time_ms") / 1000, digits).alias("mean_time"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("cost"), digits).alias("cost"),
    )
    p95 = _nearest_rank(results.where(F.col("time_ms").isNotNull()), config, "time_ms", 0.95)
    return _null_safe_join(base, p95, [config]).withColumn("p95_time", F.round(F.col("_p") / 1000, digits)).drop("_p")


def best_config(runs: DataFrame, group: str, config: str, score: str) -> DataFrame:
    """Best mean score per group; equal scores go to the configuration that sorts first."""
    means = runs.groupBy(group, config).agg((F.sum(score) / F.count(score)).alias("_mean"), F.count(score).alias("_runs"))
    best = means.groupBy(group).agg(F.min(F.struct((-F.col("_mean")).alias("s"), F.col(config).alias("c"), F.col("_runs").alias("n"))).alias("_b"))
    return best.select(group, F.col("_b.c").alias(config), (-F.col("_b.s")).alias("best_score"), F.col("_b.n").alias("runs"))


def iteration_delta(runs: DataFrame, prompt: str, iteration: str, score: str) -> DataFrame:
    """Change of score against the previous iteration of the same prompt, and its verdict.

    Windows cover a block of iterations each; the last score of the blocks before is carried in
    from one row per block, so a prompt with very many iterations is not one task's work.
    """
    blocked = runs.withColumn("_block", F.floor(F.col(iteration) / _BLOCK))
    # Rows without an iteration are returned but come before nothing.
    numbered = blocked.where(F.col(iteration).isNotNull())
    last = numbered.groupBy(prompt, "_block").agg(F.max(F.struct(iteration, score)).alias("_last"))
    by_block = Window.partitionBy(prompt).orderBy("_block")
    carried = last.select(prompt, "_block", F.lag(f"_last.{score}").over(by_block).alias("_carried"))
    inside = Window.partitionBy(prompt, "_block").orderBy(iteration)
    joined = numbered.withColumn("_lag", F.lag(score).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    joined = joined.unionByName(blocked.where(F.col(iteration).isNull()), allowMissingColumns=True)
    joined = _null_safe_join(joined, carried, [prompt, "_block"])
    previous = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))
    delta = F.col(score) - F.col("previous_score")
    return joined.select(prompt, iteration, score, previous.alias("previous_score")).withColumns({
        "delta": F.round(delta, 6),
        "verdict": F.when(delta > 0, "gain").when(delta < 0, "regression").when(delta == 0, "same"),
    })
