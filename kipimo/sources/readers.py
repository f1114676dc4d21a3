"""Readers for manifests, stored results, clip directories and media listings.

The default is JSON Lines, which Spark splits.  Files that hold one JSON document need
``multi_line=True`` and are read by one task each.
"""

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import staged
from ..schemas import CLIP, MANIFESTS, RECORDS
from .clip_files import FORMAT, clip_problem, is_mounted, local_path, registered, shown

# Media suffixes that count as video assets.
VIDEO_SUFFIXES = ("mp4", "mov", "m4v", "avi")

_SLICE_BYTES = 8 << 20
_LISTED_ROWS = 10_000


def read_pairs(spark: SparkSession, path, kind: str = "pairs", multi_line: bool = False) -> DataFrame:
    """Pair (``kind="pairs"``) or stress (``kind="stress"``) manifest."""
    reader = spark.read.schema(MANIFESTS[kind]).option("multiLine", multi_line)
    return reader.option("mode", "FAILFAST").json(path)


def read_speech_manifest(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    return read_pairs(spark, path, "speech", multi_line)


def read_result_records(
    spark: SparkSession, path, kind: str = "pairs", multi_line: bool = False
) -> DataFrame:
    """``{"records": [...]}`` result files -> one row per record (``models`` map).

    A missing file fails, as any Spark read does.
    """
    schema = T.StructType([T.StructField("records", T.ArrayType(RECORDS[kind]))])
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
    return reader.json(path).select(F.inline("records"))


def read_clips(spark: SparkSession, path, width: int = 126, strict: bool = True) -> DataFrame:
    """Directory ``[<split>/]<label>/<file>.npy`` -> split, label, file, frames, reason.

    Mounted folders are read by the ``clips`` data source, other stores through Spark's
    binary file reader.  A clip that is not a finite T x ``width`` matrix fails the read,
    or with ``strict=False`` comes back with its reason and no frames: ``unreadable``,
    ``dimensions``, ``width``, ``empty`` or ``not_finite``.
    """
    if is_mounted(path):
        clips = registered(spark).read.format(FORMAT).option("width", width).load(path).drop("bytes")
        return _usable(clips) if strict else clips
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.npy")
        .load(path)
    )
    return decode_clips(files, width, strict)


def _usable(clips: DataFrame) -> DataFrame:
    bad = F.concat_ws(" ", F.lit("unusable clip"), "label", "file", "reason")
    failed = F.when(F.col("reason").isNotNull(), F.raise_error(bad).cast("string"))
    return clips.withColumn("reason", failed)


def _by_bytes(batch):
    """Consecutive rows of a batch with about ``_SLICE_BYTES`` of content each."""
    at = (batch["content"].str.len().cumsum() - 1) // _SLICE_BYTES
    return (part for _, part in batch.groupby(at, sort=False))


def decode_clips(files: DataFrame, width: int = 126, strict: bool = True) -> DataFrame:
    """(path, content) of ``.npy`` files -> split, label, file, frames, reason.

    Decoding is per file inside the task, in slices of about ``_SLICE_BYTES`` of
    content, so that a worker holds few decoded clips at a time.  A clip that is not
    a finite T x ``width`` matrix fails the read, or with ``strict=False`` comes back
    with its reason and no frames.
    """
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("frames", CLIP),
            T.StructField("reason", T.StringType()),
        ]
    )

    def decode(batches):
        for batch in (part for whole in batches for part in _by_bytes(whole)):
            made = [clip_problem(content, width) for content in batch["content"]]
            frames = [None if clip is None else list(clip) for clip, _ in made]
            yield batch[["path"]].assign(frames=frames, reason=[reason for _, reason in made])

    part = r"([^/]+)/([^/]+)/([^/]+)$"
    clips = files.select("path", "content").mapInPandas(decode, schema).select(
        F.regexp_extract("path", part, 1).alias("split"),
        F.regexp_extract("path", part, 2).alias("label"),
        F.regexp_extract("path", part, 3).alias("file"),
        "frames",
        "reason",
    )
    return _usable(clips) if strict else clips


def list_assets(spark: SparkSession, path, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """Media files below a folder, sorted by path; their contents are not read.

    Fails when there is none: that check is a one-row limit on the listing.
    """
    if is_mounted(path):
        listed = listed_files(spark, path, suffixes)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        listed = media_files(files.select("path", "length"), suffixes)
    if listed.isEmpty():
        raise FileNotFoundError(f"no media files under {path}")
    return listed.orderBy("path")


def listed_files(spark: SparkSession, path: str, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """path, length, suffix of the files below a mounted folder that end in a suffix, whatever the case.

    Each level of folders is a table dealt out over the tasks, which list them; the
    driver holds no names.  A file's status is asked for only where its suffix counts.
    """
    root = local_path(path)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder: {path}")
    wanted = tuple(s.lower() for s in suffixes)

    def listed(batches):
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if not shown(entry.name):
                            continue
                        if entry.is_dir():
                            rows.append((entry.path, None, None))
                        else:
                            suffix = os.path.splitext(entry.name)[1][1:].lower()
                            if suffix in wanted:
                                rows.append((entry.path, entry.stat().st_size, suffix))
                        if len(rows) == _LISTED_ROWS:
                            yield _listing(rows)
                            rows = []
                yield _listing(rows)

    level, found = spark.createDataFrame([(root,)], "path string"), []
    while True:
        below = staged(level.mapInPandas(listed, "path string, length long, suffix string"))
        found.append(below.filter("suffix is not null"))
        level = below.filter("suffix is null").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _listing(rows):
    import pandas as pd

    paths, lengths, suffixes = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame(
        {"path": pd.Series(paths, dtype=object), "length": pd.array(lengths, dtype="Int64"), "suffix": pd.Series(suffixes, dtype=object)}
    )


def media_files(listing: DataFrame, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """Rows of a (path, length) listing with one of the suffixes, whatever the case."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return listing.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes))
