"""Moments of vector columns that tasks merge as arrays.

Each task reduces its batches to one row per group: for every position of the vector the
count, mean, sum of squared distances from it and the extremes.  Only those rows are
unfolded and merged, so no row is made per value, whatever the number of vectors.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import MISSING_ATOL

_MOMENTS = ["n", "mean", "m2", "low", "high", "size", "small", "bad"]
_SCHEMA = "at array<int>, " + ", ".join(f"{c} array<double>" for c in _MOMENTS)


def flat_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of vectors, or of arrays of vectors, and each value's position; nulls are left out."""
    while pa.types.is_list(column.type) and pa.types.is_list(column.type.value_type):
        column = column.flatten()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    ends = np.cumsum(lengths)
    position = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    if flat.null_count:
        known = np.asarray(flat.is_valid())
        return np.asarray(flat.drop_null(), np.float64), position[known]
    return np.asarray(flat, np.float64), position


class Moments:
    """Count, mean, squared distances, extremes and sizes per position (or range of positions)."""

    def __init__(self):
        self.parts: dict[str, np.ndarray] = {}

    def add(self, x: np.ndarray, at: np.ndarray) -> None:
        if not len(x):
            return
        k = max(int(at.max()) + 1, len(self.parts.get("n", ())))
        n = np.bincount(at, minlength=k).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            mean = np.bincount(at, x, k) / n
            m2 = np.bincount(at, np.square(x - mean[at]), k)
            new = {
                "n": n,
                "mean": np.where(n > 0, mean, 0.0),
                "m2": m2,
                "low": _extreme(np.fmin, x, at, k),
                "high": _extreme(np.maximum, x, at, k),
                "size": np.bincount(at, np.abs(x), k),
                "small": np.bincount(at, np.abs(x) <= MISSING_ATOL, k),
                "bad": np.bincount(at, ~np.isfinite(x), k),
            }
            self.parts = _merged(self.parts, new, k) if self.parts else new

    def row(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        at = np.flatnonzero(self.parts["n"])
        columns = [pa.array([at], pa.list_(pa.int32()))]
        columns += [pa.array([self.parts[c][at]], pa.list_(pa.float64())) for c in _MOMENTS]
        return pa.RecordBatch.from_arrays(columns, ["at", *_MOMENTS])


def _extreme(rule, x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The least value that is a number, or the largest with NaN above all, per position."""
    out = np.full(k, np.nan if rule is np.fmin else -np.inf)
    rule.at(out, at, x)
    return out


def _merged(a: dict, b: dict, k: int) -> dict:
    a = {c: np.concatenate([v, np.full(k - len(v), {"low": np.nan, "high": -np.inf}.get(c, 0.0))]) for c, v in a.items()}
    n = a["n"] + b["n"]
    step = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    share = np.divide(b["n"], n, out=np.zeros(k), where=n > 0)
    mean = np.where(a["n"] > 0, a["mean"] + step * share, b["mean"])
    return {
        "n": n,
        "mean": mean,
        "m2": a["m2"] + b["m2"] + step * step * a["n"] * share,
        "low": np.fmin(a["low"], b["low"]),
        "high": np.maximum(a["high"], b["high"]),
    } | {c: a[c] + b[c] for c in ("size", "small", "bad")}


def position_moments(df: DataFrame, column: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """One row per position of the vectors in ``column`` (or per range of positions, first to end).

    at, n, mean, std (population), min, max, max_abs, mean_abs, all_finite, near_zero.
    Vectors may differ in width and may be nested one level deeper, as clips are; null
    values count nowhere, NaN as the largest value.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments()
        for batch in batches:
            x, at = flat_values(batch.column(0))
            if ranges is None:
                total.add(x, at)
                continue
            for r, (first, end) in enumerate(ranges):
                inside = (at >= first) & (at < end)
                total.add(x[inside], np.full(int(inside.sum()), r))
        row = total.row()
        if row is not None:
            yield row

    partial = df.select(column).mapInArrow(reduced, _SCHEMA)
    # task rows only: as many as tasks times positions
    cells = partial.select(F.explode(F.arrays_zip("at", *_MOMENTS)).alias("c")).select("c.*")
    near = F.min("mean").over(Window.partitionBy("at"))  # close to all means: keeps the squares small
    off = F.col("mean") - F.col("near")
    n, largest = F.sum("n"), F.max("high")
    shifted = F.sum(F.col("n") * off)
    squares = F.sum("m2") + F.sum(F.col("n") * off * off) - shifted * shifted / n
    return (
        cells.withColumn("near", near)
        .groupBy("at")
        .agg(
            n.cast("long").alias("n"),
            (F.min("near") + shifted / n).alias("mean"),
            F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("std"),
            F.min("low").alias("min"),
            largest.alias("max"),
            F.greatest(largest, -F.min("low")).alias("max_abs"),
            (F.sum("size") / n).alias("mean_abs"),
            (F.sum("bad") == 0).alias("all_finite"),
            F.sum("small").cast("long").alias("near_zero"),
        )
    )


_HELD_GROUPS = 50_000


def _by_group(keys: pa.Table, sums: np.ndarray, weight: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of equal keys (null equals null) added up."""
    names = keys.column_names
    group = np.zeros(len(sums), np.int64)
    if names:
        group = keys.to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    n = int(group.max(initial=-1)) + 1
    first = np.full(n, len(group))
    np.minimum.at(first, group, np.arange(len(group)))
    total = np.zeros((n, sums.shape[1]))
    np.add.at(total, group, sums)
    return keys.take(pa.array(first)), total, np.bincount(group, weight, n)


def weighted_sums(df: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """Sum of weight * vector per group, and of the weights: keys, sums, weight.

    Vectors have one width; a null vector counts nowhere, a null value or weight as 0.  A
    task adds up each of its groups as one array, and a second stage adds those arrays,
    about one per task that has the group.
    """
    chosen = df.filter(F.size(vector) > 0).select(
        *keys, weight.cast("double").alias("_w"), F.col(vector).cast("array<double>").alias("_v")
    )
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.select(*keys).schema)

    def out(table, sums, total):
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        lists = pa.array(list(sums), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array(total)], [*keys, "sums", "weight"])

    def reduced(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = np.asarray(batch.column(len(keys)).fill_null(0.0))
            flat = np.asarray(batch.column(len(keys) + 1).flatten().fill_null(0.0))
            table, sums = pa.Table.from_batches([batch.select(keys)]), flat.reshape(len(w), -1) * w[:, None]
            if held is not None:
                table = pa.concat_tables([held[0], table])
                sums, w = np.concatenate([held[1], sums]), np.concatenate([held[2], w])
            held = _by_group(table, sums, w)
            if len(held[2]) > _HELD_GROUPS:
                yield out(*held)
                held = None
        if held is not None:
            yield out(*held)

    partial = chosen.mapInArrow(reduced, f"{fields}sums array<double>, weight double")
    added = F.aggregate(
        F.slice("_all", 2, F.size("_all")),
        F.get("_all", F.lit(0)),
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
    )
    return (
        partial.groupBy(*keys)
        .agg(F.collect_list("sums").alias("_all"), F.sum("weight").alias("weight"))
        .select(*keys, added.alias("sums"), "weight")
    )
