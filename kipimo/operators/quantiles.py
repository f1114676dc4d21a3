"""Exact quantiles without sorting or gathering the values.

``percentile`` keeps every distinct value of a group in one task.  Here doubles become
64-bit keys of the same order, and the ranks that a quantile lies between are found by
radix histograms (:mod:`selection`): values are neither shuffled nor written.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import crossing_keys, double_of_bits, ordered_bits, same_keys


def exact_quantiles(
    df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """One row per group with ``wanted`` = {output: (column, probability)}.

    Linear interpolation between the two neighbouring ranks; nulls are skipped.
    The input is read two to four times, so it should be a table or cheap to derive.
    """
    asked: dict[str, list[float]] = {}
    for column, q in wanted.values():
        asked.setdefault(column, []).append(float(q))
    cells = [F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in asked]
    values = (
        df.select(*by, F.explode(F.array(*cells)).alias("_x"))
        .select(*by, "_x.*")
        .filter("_v is not null")
        .select(*by, "_name", ordered_bits(F.col("_v")).alias("key"), F.lit(1).cast("long").alias("weight"))
    )

    def position(q, total):
        return F.lit(q) * (total - 1)

    def ranks(total):
        goals = F.array().cast("array<bigint>")
        for name, shares in asked.items():
            at = [f(position(q, total)).cast("long") for q in shares for f in (F.floor, F.ceil)]
            goals = F.when(F.col("_name") == name, F.array(*at)).otherwise(goals)
        return goals

    found = crossing_keys(values, [*by, "_name"], ranks).withColumn("_v", double_of_bits(F.col("key")))

    def picked(column, q, rounded):
        here = (F.col("_name") == column) & (F.col("goal") == rounded(position(q, F.col("total"))).cast("long"))
        return F.max(F.when(here, F.col("_v")))

    # Two rows at most answer one request, so this last aggregate is tiny.
    aggregates = []
    for out, (column, q) in wanted.items():
        at = position(float(q), F.max(F.when(F.col("_name") == column, F.col("total"))))
        lo, hi = picked(column, float(q), F.floor), picked(column, float(q), F.ceil)
        aggregates.append((lo + (hi - lo) * (at - F.floor(at))).alias(out))
    return found.groupBy(*by).agg(*aggregates) if by else found.agg(*aggregates)


def with_quantiles(summary: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """Attach quantile columns to an aggregate over the same groups."""
    if not by:
        return summary.crossJoin(F.broadcast(quantiles))
    keys = {c: f"_q_{c}" for c in by}
    return summary.join(quantiles.withColumnsRenamed(keys), same_keys(by, "_q_"), "left").drop(*keys.values())
