"""Scores of predictions against gold values, including the case where neither has information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(gold: DataFrame, pred: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, gold, pred) as text, over every key of either side.

    The outer join is made of a left join and an anti join: adaptive execution splits a dominant
    key in those, but not in a full join.
    """
    left = gold.select(key, *[F.col(f).cast("string").alias(f"_g_{f}") for f in fields])
    right = pred.select(key, *[F.col(f).cast("string").alias(f"_p_{f}") for f in fields])
    only_gold = left.join(right.select(key), key, "left_anti")
    none = F.lit(None).cast("string")
    both = right.join(left, key, "left").unionByName(only_gold.select("*", *[none.alias(f"_p_{f}") for f in fields]))
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_g_{f}").alias("gold"), F.col(f"_p_{f}").alias("pred")) for f in fields
    ])
    return both.select(F.inline(cells))


def score_fields(gold: DataFrame, pred: DataFrame, key: str, fields: list[str], digits: int = 6) -> DataFrame:
    """Per field: tp, fp, fn, tn, precision, recall, f1 and accuracy.

    Both null is a true negative; gold null alone a false positive; prediction null alone a false
    negative; two unequal values are a false positive and a false negative.
    """
    g, p = F.col("gold"), F.col("pred")
    wrong = g.isNotNull() & p.isNotNull() & (g != p)
    counts = _pairs(gold, pred, key, fields).groupBy("field").agg(
        F.count_if(g == p).alias("tp"),
        F.count_if((g.isNull() & p.isNotNull()) | wrong).alias("fp"),
        F.count_if((g.isNotNull() & p.isNull()) | wrong).alias("fn"),
        F.count_if(g.isNull() & p.isNull()).alias("tn"),
        F.count("*").alias("_n"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.round(F.try_divide(top, bottom), digits)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "field", "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, F.col("_n")).alias("accuracy"),
    )


def valid_option_rate(pred: DataFrame, options: dict[str, list[str]], digits: int = 6) -> DataFrame:
    """Per field the number of predictions and the share inside its options. One pass, one row out
    of the aggregation."""
    totals = pred.agg(*[
        a for f, allowed in options.items()
        for a in (F.count(f).alias(f"_n_{f}"), F.count_if(F.col(f).cast("string").isin(*allowed)).alias(f"_ok_{f}"))
    ])
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"_n_{f}").alias("n"),
            F.round(F.try_divide(f"_ok_{f}", f"_n_{f}"), digits).alias("valid_rate"),
        )
        for f in options
    ])
    return totals.select(F.inline(rows))


def edge_cases(gold: DataFrame, pred: DataFrame, key: str, fields: list[str], k: int = 3) -> DataFrame:
    """The ``k`` commonest disagreements per field. Counts combine map-side and the limit applies
    per task before the ranking shuffle."""
    differ = ~F.col("gold").eqNullSafe(F.col("pred"))
    counts = _pairs(gold, pred, key, fields).where(differ).groupBy("field", "gold", "pred").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_first("gold"), F.asc_nulls_first("pred"))
    ranked = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return ranked.select("field", F.col("_rank").cast("bigint").alias("rank"), "gold", "pred", "n")
