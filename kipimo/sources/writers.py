"""Report, CSV and clip sinks."""

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_report
from .clip_files import FORMAT, SUFFIX, local_path, registered


def report_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """One ``value`` column: each row as pretty-printed JSON, doubles rounded."""
    rounded = round_report(df, digits)
    whole = F.struct(*[F.col(f"`{c}`") for c in rounded.columns])
    return rounded.select(F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines report, UTF-8; one object per row, written in parallel."""
    round_report(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def nested_report(header: dict, lists: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """One row: the header's fields, then each table's rounded rows as a list.

    For reports, which are as small as their aggregates: all rows of the tables come
    together in one object.
    """
    whole = None
    for name, df in lists.items():
        rounded = round_report(df, digits)
        row = F.struct(*[F.col(f"`{c}`") for c in rounded.columns])
        listed = rounded.agg(F.collect_list(row).alias(name))
        whole = listed if whole is None else whole.crossJoin(listed)  # one row each
    return whole.select(*[F.lit(v).alias(k) for k, v in header.items()], *lists)


def write_nested_report(
    header: dict, lists: dict[str, DataFrame], path: str, mode: str = "errorifexists"
) -> None:
    """The nested report as one indented JSON object, UTF-8, in one file."""
    text = report_json(nested_report(header, lists))
    text.coalesce(1).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _stem() -> Column:
    return F.regexp_replace("file", r"\.[^.]*$", "")


def _shape(frames: str) -> Column:
    return F.concat_ws("x", F.size(frames), F.size(F.get(F.col(frames), F.lit(0))))


def write_clips(clips: DataFrame, path: str, frames: str = "sequence", mode: str = "errorifexists") -> None:
    """Processed clips as files ``<label>/<stem>_<T>x<D>.npy`` below a mounted folder.

    Two clips of one name fail the write, which then leaves nothing behind.
    """
    name = F.concat(F.concat_ws("_", _stem(), _shape(frames)), F.lit(SUFFIX))
    named = clips.select("label", name.alias("file"), F.col(frames).alias("frames"))
    write_clip_files(named, path, mode)


def write_clip_files(clips: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Clips as files ``[<split>/]<label>/<file>`` through the ``clips`` data source."""
    if mode == "errorifexists" and os.path.exists(local_path(path)):
        raise FileExistsError(path)
    registered(clips.sparkSession)
    clips.write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").save(path)


def write_clip_table(
    clips: DataFrame, path: str, frames: str = "sequence", mode: str = "errorifexists"
) -> None:
    """Processed clips as Parquet, partitioned by label, named ``<stem>_<T>x<D>``; for any store."""
    name = F.concat_ws("_", _stem(), _shape(frames))
    named = clips.select("label", name.alias("name"), F.col(frames).alias("frames"))
    named.write.mode(mode).partitionBy("label").parquet(path)
