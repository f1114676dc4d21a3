"""Reshaping between record form (models map), long form and wide form.

Arrays and maps that come from costly expressions are unfolded with the outer
generators: a plain explode adds a size filter below itself, which would evaluate
such an expression a second time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_models(manifest: DataFrame, models: list[str]) -> DataFrame:
    """Every manifest row for every model; row-local, so no join is planned."""
    return manifest.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def melt_models(records: DataFrame, models: str = "models") -> DataFrame:
    """Record form -> one row per (record, model)."""
    keep = [c for c in records.columns if c != models]
    long = records.select(*keep, F.explode_outer(models).alias("model", "_score"))
    return long.filter("model is not null").select(*keep, "model", "_score.*")


def one_row(df: DataFrame, what: str) -> DataFrame:
    """The row of a table that has to have exactly one; fails at run time otherwise."""
    wrong = F.raise_error(F.lit(f"{what}: exactly one row is needed"))
    row = F.first(F.struct(*df.columns))
    return df.agg(F.count(F.lit(1)).alias("_n"), row.alias("_row")).select(
        F.when(F.col("_n") == 1, F.col("_row")).otherwise(wrong).alias("_row")
    ).select("_row.*")


def listed(name: Column, names: list[str]) -> Column:
    """``name`` itself; fails at run time where it is none of ``names``."""
    wrong = F.raise_error(F.concat(F.lit("not a listed name: "), F.coalesce(name, F.lit("null"))))
    return F.when(name.isin(*names), name).otherwise(wrong.cast("string"))


def exclude_leaked(rows: DataFrame, held_out: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content is not among the held-out ones, compared by SHA-256.

    An anti-join on the digest of equal content; null content is never excluded.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    leaked = held_out.select(digest.alias("_leaked")).filter("_leaked is not null").distinct()
    return rows.join(leaked, digest == F.col("_leaked"), "left_anti")


def leaked_counts(rows: DataFrame, held_out: DataFrame, content: str = "content") -> DataFrame:
    """One row: rows, rows whose content is held out, and distinct contents among those."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    leaked = held_out.select(digest.alias("_leaked")).filter("_leaked is not null").distinct()
    # counted per content first, so that a content with most rows is one row per task
    counted = rows.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    marked = counted.join(leaked, F.col("_digest") == F.col("_leaked"), "left")
    hit = F.col("_leaked").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return marked.agg(
        total(F.col("_n")).alias("rows"),
        total(F.when(hit, F.col("_n"))).alias("leaked_rows"),
        F.count_if(hit).alias("leaked_contents"),
    )


def pivot_models(
    long: DataFrame, keys: list[str], values: list[str], models: list[str]
) -> DataFrame:
    """Long form -> one row per key with ``<value>_<model>`` columns.

    A model that is not listed fails.
    """
    model = listed(F.col("model"), models)
    picks = [
        F.max(F.when(model == m, F.col(v))).alias(f"{v}_{m}")
        for m in models
        for v in values
    ]
    return long.groupBy(*keys).agg(*picks)


def score_of(model: str, field: str) -> Column:
    """A model's value in record form."""
    return F.col("models")[model][field]


def grid(wide: DataFrame, keys: list[str], name: str, entries: dict[str, Column]) -> DataFrame:
    """One row per key and entry from struct columns, so that every listed entry
    appears even where nothing was counted."""
    cells = F.array(
        *[F.struct(F.lit(k).alias(name), v.alias("_cell")) for k, v in entries.items()]
    )
    return wide.select(*keys, F.explode(cells).alias("_g")).select(
        *keys, f"_g.{name}", "_g._cell.*"
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group, with ``rank``; Spark prunes to k per task before
    the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
