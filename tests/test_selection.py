"""Selection by radix histograms against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.operators import quantiles, selection


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_ranks_of_any_doubles(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "_FEW_ROWS", few)
    rng = np.random.default_rng(few)
    bits = rng.integers(0, 1 << 64, 1500, dtype=np.uint64).view(np.float64)
    values = np.concatenate([bits[np.isfinite(bits)], [0.0, -0.0, 5e-324, -5e-324, 1e308, np.inf, -np.inf], np.full(400, 0.1)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    keyed = df.select(selection.ordered_bits(F.col("v")).alias("key"), F.lit(1).cast("long").alias("weight"))
    goals = [0, 1, 17, 700, 701, len(values) - 1, len(values)]
    asked = spark.createDataFrame([(g,) for g in goals], "goal long")
    found = selection.crossing_keys(keyed, [], asked).withColumn("v", selection.double_of_bits(F.col("key")))
    rows = {r.goal: r for r in found.collect()}
    ordered = np.sort(values)
    assert {g: r.v for g, r in rows.items()} == {g: ordered[g] for g in goals[:-1]}
    assert all(r.before == (values < r.v).sum() and r.total == len(values) for r in rows.values())


def test_weights_groups_and_negative_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None if g == 2 else int(g), int(k), int(w)) for g, k, w in zip(rng.integers(0, 4, 900), rng.integers(-(1 << 62), 1 << 62, 900), rng.integers(0, 5, 900))]
    rows += [(9, 5, 0), (9, 6, 0)]
    df = spark.createDataFrame(rows, "g int, key long, weight long")
    goals = spark.createDataFrame([(g, x) for g in (0, 1, 3, None, 9, 77) for x in (0, 10, 333, 10**6)], "g int, goal long")
    expected = set()
    for g, goal in {(r.g, r.goal) for r in goals.collect()}:
        run = 0
        for k, w in sorted((k, w) for h, k, w in rows if h == g):
            if run + w > goal:
                expected.add((g, goal, k, run))
                break
            run += w
    for limit in (selection.SMALL_ROWS, -1):
        monkeypatch.setattr(selection, "SMALL_ROWS", limit)
        found = selection.crossing_keys(df, ["g"], goals).collect()
        assert {(r.g, r.goal, r.key, r.before) for r in found} == expected and len(found) == len(expected)


def test_quantiles_equal_percentile_on_ties_and_skew(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(5000, 0.25), rng.normal(size=3000), rng.exponential(1e-9, 200)])
    rows = [("hot" if i % 3 else f"g{i % 30}", float(v), None if i % 5 else float(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"a": ("v", 0.05), "b": ("v", 0.5), "c": ("v", 0.951), "d": ("w", 0.3), "e": ("v", 0.0), "f": ("v", 1.0)}
    found = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], wanted).collect()}
    exact = df.groupBy("g").agg(*[F.percentile(c, q).alias(o) for o, (c, q) in wanted.items()]).collect()
    for r in exact:
        assert all(found[r.g][o] == (r[o] and pytest.approx(r[o], rel=1e-14, abs=1e-18)) for o in wanted)


def test_no_value_is_exchanged(spark):
    df = spark.range(200_000).select((F.rand(1) * 1e6).alias("key").cast("long").alias("key"), F.lit(1).cast("long").alias("weight"))
    found = selection.crossing_keys(df.repartition(3), [], lambda total: F.array(F.floor(total / 2)))
    assert found.count() == 1
    assert quantiles.exact_quantiles(df.filter("key < 0"), [], {"m": ("key", 0.5)}).first().m is None
