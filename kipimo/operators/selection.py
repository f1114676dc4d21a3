"""Exact selection by radix histograms: where a running sum crosses a goal.

Keys are 64-bit integers.  A pass counts the weights of 16 bits of the key per group,
finds the digit where each goal is crossed, and the next pass looks only at keys below
that digit.  One to four passes read the input; what is shuffled are histograms of at
most 65,536 entries per group and goal, pre-aggregated in each task.  A group with most
rows, or values that pile up at one place, is no more work for any task.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.stage import staged

_DIGIT = 16
_FEW_ROWS = 1 << _DIGIT
#: A table of groups of up to so many rows is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 100_000


def same_keys(names: list[str], other: str) -> Column:
    """Equality of ``names`` with the columns of the same names after ``other``; null equals null."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other + c)) for c in names], F.lit(True))


def join_groups(df: DataFrame, groups: DataFrame, by: list[str], n_groups: int, how: str = "inner") -> DataFrame:
    """Attach the columns of ``groups``, a table of one row per group and ``n_groups`` rows."""
    named = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    side = F.broadcast(named) if n_groups <= SMALL_ROWS else named
    return df.join(side, same_keys(by, "_of_"), how).drop(*[f"_of_{c}" for c in by])


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order (NaN last, -0.0 equal to 0.0)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0))
    bits = bits.cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def double_of_bits(key: Column) -> Column:
    """The double that ``ordered_bits`` made ``key`` from."""
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def crossing_keys(
    values: DataFrame, by: list[str], goals: DataFrame | Callable[[Column], Column]
) -> DataFrame:
    """Per goal the smallest key whose running weight exceeds it.

    ``values``: the columns ``by``, ``key`` (long) and ``weight`` (long, not negative).
    ``goals``: a table of ``by`` and ``goal`` (long), several per group if need be, or a
    function from a group's total weight to an array of goals.
    Returns by, goal, key, before (weight of all smaller keys of the group) and total
    (of the group); goals that are never exceeded, and groups without values, give no row.  With
    weights of 1 and a goal r the key is that of rank r, from 0.

    ``values`` is counted and read once per pass, so it should be a table or cheap to
    derive.  Few rows are not cut further: one pass then tells all keys of a cell apart.
    """
    whole = Window.partitionBy(*by)
    shift, few, asks, n_asks = 64, values.count() <= _FEW_ROWS, None, 0
    while True:
        if asks is None:
            inside, matching = F.lit(0).cast("long"), values
        else:
            # the first pass keeps the sign in its digit, later ones look below it
            inside = F.shiftright("key", shift)
            open_cells = asks.groupBy(*by).agg(F.collect_set("prefix").alias("_open"))
            matching = join_groups(values, open_cells, by, n_asks).filter(F.array_contains("_open", inside))
        shift = 0 if few else shift - _DIGIT
        histogram = matching.groupBy(*by, inside.alias("prefix"), F.shiftright("key", shift).alias("_digit")).agg(
            F.sum("weight").alias("_in"), F.count(F.lit(1)).alias("_rows"), F.min("key").alias("_low"), F.max("key").alias("key")
        )
        upto = Window.partitionBy(*by, "prefix").orderBy("_digit")
        cells = histogram.withColumn("_upto", F.sum("_in").over(upto))
        if asks is None:
            cells = cells.withColumn("total", F.sum("_in").over(whole)).withColumn("before", F.lit(0).cast("long"))
            if callable(goals):
                asked = cells.withColumn("goal", F.explode(F.array_distinct(goals(F.col("total")))))
            else:
                named = goals.select(*[F.col(c).alias(f"_ask_{c}") for c in by], "goal")
                asked = cells.join(named, same_keys(by, "_ask_"))
        else:
            ask = [*by, "prefix"]
            named = asks.select(*[F.col(c).alias(f"_ask_{c}") for c in ask], "goal", "before", "total")
            asked = cells.join(named, same_keys(ask, "_ask_"))
        crossed = F.col("before") + F.col("_upto")
        seen, unresolved = Observation(), ~F.col("_found")
        asks = staged(
            asked.filter((crossed > F.col("goal")) & (crossed - F.col("_in") <= F.col("goal"))).select(
                *by,
                "goal",
                F.col("_digit").alias("prefix"),
                (crossed - F.col("_in")).alias("before"),
                "total",
                "key",
                (F.col("_low") == F.col("key")).alias("_found"),
                "_rows",
            ).observe(
                seen,
                F.count(F.lit(1)).alias("asks"),
                F.count_if(unresolved).alias("open"),
                F.max(F.when(unresolved, F.col("_rows"))).alias("most"),
            )
        )
        n_asks = seen.get["asks"]
        if not seen.get["open"]:
            return asks.select(*by, "goal", "key", "before", "total")
        few = seen.get["most"] <= _FEW_ROWS
