"""Small Column helpers shared by the function modules."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A higher-order function evaluates captured expressions once per element, so
    anything reused inside a lambda has to be bound first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def safe_rate(value: Column, denominator: Column) -> Column:
    """value / denominator, 0.0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(value / denominator)


def realtime_factor(inference_seconds: Column, audio_seconds: Column) -> Column:
    """Inference seconds per audio second; null where there is no audio."""
    return F.when(audio_seconds > 0, inference_seconds / audio_seconds)


def frame_timestamp(frame_index: Column, fps: Column) -> Column:
    """Seconds from the start of the clip; an unknown rate counts as 30 fps."""
    return F.round(frame_index / usable_fps(fps), 6)


def usable_fps(fps: Column) -> Column:
    return F.when(fps > 0, fps).otherwise(F.lit(30.0))


def round_nested(col: Column, dtype: T.DataType, digits: int = 6) -> Column:
    """Round every double inside structs and maps; arrays stay untouched."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(col, digits)
    if isinstance(dtype, T.StructType):
        rounded = F.struct(
            *[round_nested(col[f.name], f.dataType, digits).alias(f.name) for f in dtype.fields]
        )
        return F.when(col.isNotNull(), rounded)
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: round_nested(v, dtype.valueType, digits))
    return col


def round_report(df, digits: int = 6):
    """Round all doubles of a report table (see :func:`round_nested`)."""
    return df.select(
        *[round_nested(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema]
    )
