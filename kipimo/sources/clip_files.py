"""A Spark data source for folders of ``.npy`` clips, ``[<split>/]<label>/<file>.npy``.

For folders that the driver and all executors reach by one path: shared mounts, or a
local disk where all run on one machine.  Reading lists one folder at a time on the
driver and keeps only ranges of file names of about ``partition_bytes``; a task lists
its folder again, takes its range, and yields Arrow batches of about ``_BATCH_BYTES``.
So neither a folder with most files nor a long file name list ends up in one place.

Writing is in two steps.  A task writes below a hidden folder of its own; the commit
moves what the successful tasks wrote to its place and drops the rest.  A task that fails, or that
runs twice, leaves no file where readers look, and a job that fails leaves none at all.
"""

import io
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schemas import CLIP

FORMAT = "clips"
SUFFIX = ".npy"
PARTITION_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
_STAGING = ".staging-"
_SCHEMA = f"split string, label string, file string, bytes long, frames {CLIP.simpleString()}, reason string"


def is_mounted(path: str) -> bool:
    """Whether ``path`` is one of the file system, not of a store that only Spark reaches."""
    return urlparse(path).scheme in ("", "file")


def local_path(path: str) -> str:
    parsed = urlparse(path)
    if not is_mounted(path):
        raise ValueError(f"not a mounted path: {path}")
    return unquote(parsed.path) if parsed.scheme else path


def shown(name: str) -> bool:
    """Names that Spark's own readers would not skip."""
    return not name.startswith((".", "_"))


def clip_problem(content: bytes, width: int) -> tuple[np.ndarray | None, str | None]:
    """The clip's frames as a float matrix, or why it has none."""
    try:
        array = np.load(io.BytesIO(content), allow_pickle=False)
        numeric = np.issubdtype(array.dtype, np.number) or array.dtype == bool
    except (ValueError, EOFError, OSError):
        return None, "unreadable"
    if not numeric or np.issubdtype(array.dtype, np.complexfloating):
        return None, "unreadable"
    if array.ndim != 2:
        return None, "dimensions"
    if array.shape[1] != width:
        return None, "width"
    if array.shape[0] == 0:
        return None, "empty"
    if not np.isfinite(array).all():
        return None, "not_finite"
    return array.astype(np.float32), None


def clip_lists(clips: list[np.ndarray | None]) -> pa.Array:
    """Matrices as lists of lists, without a Python object per value."""
    rows = [0 if c is None else len(c) for c in clips]
    widths = [np.full(len(c), c.shape[1]) for c in clips if c is not None]
    inner = np.concatenate([[0], np.cumsum(np.concatenate(widths))]) if widths else np.zeros(1)
    flat = np.concatenate([c.ravel() for c in clips if c is not None]) if widths else np.zeros(0, np.float32)
    frames = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(flat, pa.float32()))
    offsets = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
    missing = np.array([c is None for c in clips] + [False])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=missing), frames)


def _folders(root: str) -> Iterator[str]:
    """``root`` and the folders below it, one at a time."""
    waiting = [root]
    while waiting:
        folder = waiting.pop()
        yield folder
        with os.scandir(folder) as entries:
            waiting += sorted((e.path for e in entries if shown(e.name) and e.is_dir()), reverse=True)


def _sizes(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the clips of one folder, by name."""
    with os.scandir(folder) as entries:
        return sorted((e.name, e.stat().st_size) for e in entries if shown(e.name) and e.name.endswith(SUFFIX) and e.is_file())


@dataclass
class NameRange(InputPartition):
    """The clips of one folder from one name to another, both included."""

    folder: str
    first: str
    last: str

    def __post_init__(self):
        self.value = f"{self.folder}: {self.first} - {self.last}"


class ClipReader(DataSourceReader):
    def __init__(self, root: str, width: int, partition_bytes: int):
        self.root, self.width, self.partition_bytes = root, width, partition_bytes

    def partitions(self) -> list[NameRange]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder of clips: {self.root}")
        found = []
        for folder in _folders(self.root):
            first, last, held = None, None, 0
            for name, size in _sizes(folder):
                if first is not None and held + size > self.partition_bytes:
                    found.append(NameRange(folder, first, last))
                    first, held = None, 0
                first, last, held = first if first is not None else name, name, held + size
            if first is not None:
                found.append(NameRange(folder, first, last))
        return found or [NameRange(self.root, "", "")]

    def read(self, partition: NameRange):
        if not partition.last:
            return
        place = os.path.relpath(partition.folder, self.root).split(os.sep)
        place = [] if place == ["."] else place
        label, split = (place[-1] if place else None), (place[-2] if len(place) > 1 else None)
        rows, held = [], 0
        for name, _ in _sizes(partition.folder):
            if not partition.first <= name <= partition.last:
                continue
            with open(os.path.join(partition.folder, name), "rb") as file:
                content = file.read()
            rows.append((name, len(content), *clip_problem(content, self.width)))
            held += len(content)
            if held >= _BATCH_BYTES:
                yield self._batch(split, label, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(split, label, rows)

    @staticmethod
    def _batch(split, label, rows) -> pa.RecordBatch:
        names, sizes, clips, reasons = zip(*rows)
        columns = [
            pa.array([split] * len(rows), pa.string()),
            pa.array([label] * len(rows), pa.string()),
            pa.array(names, pa.string()),
            pa.array(sizes, pa.int64()),
            clip_lists(list(clips)),
            pa.array(reasons, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["split", "label", "file", "bytes", "frames", "reason"])


@dataclass
class Written(WriterCommitMessage):
    """The folder in which one task left its files, as paths below it."""

    folder: str
    files: int = 0
    labels: list[str] = field(default_factory=list)


class ClipWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = os.path.join(root, _STAGING + uuid.uuid4().hex)

    def write(self, iterator) -> Written:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        written, places = 0, set()
        for batch in iterator:
            names = batch.schema.names
            frames = batch.column(names.index("frames"))
            parts = [batch.column(names.index(c)).to_pylist() for c in ("split", "label", "file") if c in names]
            for row, place in enumerate(zip(*parts)):
                below = _checked(place)
                if below not in places:
                    os.makedirs(os.path.join(folder, below), exist_ok=True)
                    places.add(below)
                target = os.path.join(folder, below, place[-1])
                if os.path.exists(target):
                    raise FileExistsError(f"two clips of one name: {os.path.join(below, place[-1])}")
                np.save(target, _matrix(frames[row]))
                written += 1
        return Written(folder, written, sorted(places))

    def commit(self, messages: list[Written | None]) -> None:
        by_place: dict[str, list[str]] = {}
        for message in messages:
            for below in message.labels if message is not None else ():
                by_place.setdefault(below, []).append(message.folder)
        with ThreadPoolExecutor(16) as pool:  # one thread per place, so names are compared safely
            list(pool.map(self._gathered, by_place.items()))
            # nothing is shown before all names are known to be free
            if self.overwrite and os.path.isdir(self.root):
                for entry in os.scandir(self.root):
                    if shown(entry.name):
                        shutil.rmtree(entry.path) if entry.is_dir() else os.remove(entry.path)
            list(pool.map(self._published, by_place))
        os.makedirs(self.root, exist_ok=True)
        shutil.rmtree(self.staging, ignore_errors=True)
        with open(os.path.join(self.root, "_SUCCESS"), "w"):
            pass

    def _gathered(self, place: tuple[str, list[str]]) -> None:
        """Bring the files of one place from all tasks together, still hidden."""
        below, folders = place
        together = os.path.join(self.staging, "all", below)
        os.makedirs(together, exist_ok=True)
        for folder in folders:
            for entry in os.scandir(os.path.join(folder, below)):
                if not entry.is_file():
                    continue  # a place below this one
                target = os.path.join(together, entry.name)
                public = os.path.join(self.root, below, entry.name)
                if os.path.exists(target) or (not self.overwrite and os.path.exists(public)):
                    raise FileExistsError(f"two clips of one name: {os.path.join(below, entry.name)}")
                os.rename(entry.path, target)

    def _published(self, below: str) -> None:
        target = os.path.join(self.root, below)
        os.makedirs(target, exist_ok=True)
        for entry in os.scandir(os.path.join(self.staging, "all", below)):
            if entry.is_file():
                os.rename(entry.path, os.path.join(target, entry.name))

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _checked(place: tuple[str | None, ...]) -> str:
    """The folder of a clip below the root; no part may lead elsewhere."""
    for part in place:
        if not part or part in (".", "..") or "/" in part or not shown(part):
            raise ValueError(f"not a name of a clip, label or split: {part!r}")
    if not place[-1].endswith(SUFFIX):
        raise ValueError(f"not a clip file name: {place[-1]!r}")
    return os.path.join(*place[:-1])


def _matrix(clip: pa.ListScalar) -> np.ndarray:
    """One clip as a float matrix; fails where its frames are not of one width."""
    if clip.values is None:
        raise ValueError("a clip without frames cannot be written")
    frames = clip.values
    width = len(frames[0]) if len(frames) else 0
    flat = frames.flatten().to_numpy(zero_copy_only=False)
    if frames.null_count or len(flat) != len(frames) * width or len(set(np.diff(frames.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("frames of different widths")
    return flat.astype(np.float32).reshape(len(frames), width)


class ClipFiles(DataSource):
    """Options: path, width (features per frame), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ClipReader:
        size = int(self.options.get("partition_bytes", PARTITION_BYTES))
        return ClipReader(local_path(self.options["path"]), int(self.options.get("width", 126)), size)

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        missing = {"label", "file", "frames"} - set(schema.names)
        if missing:
            raise ValueError(f"clips without {sorted(missing)}")
        return ClipWriter(local_path(self.options["path"]), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format ``clips``."""
    spark.dataSource.register(ClipFiles)
    return spark
