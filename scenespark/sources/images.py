"""Image files as Spark data sources: frames of a folder, in a batch or as they come, and files written by executors.

``register(spark)`` makes three uses of one format, ``frames``:

* ``spark.read.format("frames")`` reads a folder of frames on a sampling grid. A partition is a stretch of the grid, snapped to it;
  a range of time that a filter asks for is taken off before any file is opened.
* ``spark.readStream.format("frames")`` follows a folder that a decoder writes to, some frames a batch.
* ``df.write.format("frames")`` writes image files under their own names: all of them or, if the job fails, none.

Paths are reached through Arrow's file systems, by executors and the driver alike.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import png

SCHEMA = "stream_id int, source_idx long, analyzed_idx int, timestamp_sec double, bgr_path string, content binary, image struct<height:int,width:int,nChannels:int,data:binary>"
# The endings of frames' files.
ENDINGS = (".png", ".jpg", ".jpeg", ".bmp")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def streams_of(path: str) -> dict[int, list[str]]:
    """The frames' files of a folder by stream, in order of name: those of folders named by numbers, or else of the folder itself, as stream 0.

    Names that begin with a dot or an underline are not there yet, or no frames.
    """
    files, root = opened(path)
    out: dict[int, list[str]] = {}
    for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
        inside = f.path[len(root.rstrip("/")) :].lstrip("/").split("/")
        if f.type != fs.FileType.File or not inside[-1].lower().endswith(ENDINGS) or any(x[0] in "._" for x in inside):
            continue
        if len(inside) == 1 or len(inside) == 2 and inside[0].isdigit():
            out.setdefault(int(inside[0]) if len(inside) == 2 else 0, []).append(f.path)
    return {k: sorted(v) for k, v in sorted(out.items())}


def pixels(content: bytes) -> tuple | None:
    """height, width, channels and bytes of a PNG's content; null for other kinds, which Spark's own image source reads."""
    if content[:8] != png.SIGNATURE:
        return None
    x = png.decode(content)
    return x.shape[0], x.shape[1], 3, np.ascontiguousarray(x).tobytes()


@dataclass
class Stretch(InputPartition):
    """Samples of one stream: (sample number, frame number, time, file)."""

    stream: int
    samples: list[tuple[int, int, float, str]] = field(default_factory=list)
    value: int = 0


def read_samples(path: str, part: Stretch, attempts: int, pause_sec: float) -> Iterator[tuple]:
    """The rows of a stretch; a file that cannot be read whole is tried again before it is an error."""
    files, _ = opened(path)
    for analyzed, frame, t, name in part.samples:
        for left in range(attempts, 0, -1):
            try:
                with files.open_input_stream(name) as f:
                    content = f.read()
                image = pixels(content)
                break
            except (OSError, ValueError):
                if left == 1:
                    raise
                time.sleep(pause_sec)
        yield part.stream, frame, analyzed, t, name, content, image


class FrameReader(DataSourceReader):
    """Options: path, fps (frames a second of the files, 1), interval_sec (of the grid, 1 / fps), workers (stretches a stream, 8), pushdown (false).

    Spark keeps what it was told of a table's reader, and a scan without any filter is given the reader of the scan before. So filters are taken on
    only with ``pushdown``, which ``frames.frames_folder`` sets on tables that it filters itself.
    """

    def __init__(self, options: dict):
        self.path, self.fps = options["path"], float(options.get("fps", 1.0))
        self.interval, self.workers = float(options.get("interval_sec", 1 / self.fps if self.fps else 0)), int(options.get("workers", 8))
        self.attempts, self.pause = int(options.get("attempts", 1)), float(options.get("pause_sec", 0.5))
        self.pushdown = options.get("pushdown", "false") == "true"
        if self.fps <= 0 or self.interval <= 0 or self.workers < 1:
            raise ValueError("fps, interval_sec and workers must be positive")
        self.lo, self.lo_in, self.hi, self.hi_in = float("-inf"), True, float("inf"), True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on timestamp_sec are kept to; other filters are Spark's."""
        for f in filters:
            if not self.pushdown or getattr(f, "attribute", None) != ("timestamp_sec",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            t = float(f.value)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and (t, isinstance(f, GreaterThan)) >= (self.lo, not self.lo_in):
                self.lo, self.lo_in = t, not isinstance(f, GreaterThan)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and (-t, isinstance(f, LessThan)) >= (-self.hi, not self.hi_in):
                self.hi, self.hi_in = t, not isinstance(f, LessThan)

    def wanted(self, t: float) -> bool:
        return (t > self.lo or self.lo_in and t == self.lo) and (t < self.hi or self.hi_in and t == self.hi)

    def partitions(self) -> list[Stretch]:
        """A stretch for each worker's share of a stream's duration, its bounds snapped to the grid; stretches without samples are left out."""
        out = []
        for stream, names in streams_of(self.path).items():
            duration = len(names) / self.fps
            bounds = [np.rint(duration / self.workers * i / self.interval) * self.interval for i in range(1, self.workers)]
            parts = [Stretch(stream) for _ in range(self.workers)]
            k = 0
            while k * self.interval < duration - 1e-6:
                t = k * self.interval
                frame = min(int(np.rint(t * self.fps)), len(names) - 1)
                if self.wanted(t):
                    parts[int(np.searchsorted(bounds, t, side="right"))].samples.append((k, frame, t, names[frame]))
                k += 1
            out += [p for p in parts if p.samples]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition is not None and isinstance(partition, Stretch):
            yield from read_samples(self.path, partition, self.attempts, self.pause)


class LiveReader(DataSourceStreamReader):
    """Follows a folder. An offset is, for each stream, its number of frames so far and the last one's name.

    Options, besides those of the batch: most (frames of a stream in one batch, 30), start (``begin`` or ``now``). Files must come in order
    of name; one that sorts before a name already read is not seen. A reader that begins again is told the offsets of the last batch.
    """

    def __init__(self, options: dict):
        self.path, self.fps = options["path"], float(options.get("fps", 1.0))
        self.most, self.start = int(options.get("most", 30)), options.get("start", "begin")
        self.attempts, self.pause = int(options.get("attempts", 5)), float(options.get("pause_sec", 0.5))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        if self.start == "now":
            return {str(k): [len(v), v[-1]] for k, v in streams_of(self.path).items()}
        return {}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        out = dict(self.at)
        for stream, names in streams_of(self.path).items():
            n, last = out.get(str(stream), [0, ""])
            new = [x for x in names if x > last][: self.most]
            if new:
                out[str(stream)] = [n + len(new), new[-1]]
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        if self.at is None:  # begun again: the engine first plans the last batch of its log
            self.at = end
        out, there = [], streams_of(self.path)
        for stream, (count, last) in end.items():
            n, before = start.get(stream, [0, ""])
            names = [x for x in there.get(int(stream), []) if before < x <= last]
            if len(names) != count - n:
                raise ValueError(f"stream {stream}: {count - n} frames were planned after {before!r}, {len(names)} are there")
            if names:
                out.append(Stretch(int(stream), [(n + i, n + i, (n + i) / self.fps, x) for i, x in enumerate(names)]))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        yield from read_samples(self.path, partition, self.attempts, self.pause)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """How many files a task has written."""

    files: int


class ImageWriter(DataSourceArrowWriter):
    """Writes rows (name, content) or (name, image) as files below ``path``.

    A task writes under hidden names in the job's folder. Once all its rows are written, it lists the names there and moves its files to
    them. If the job fails, every listed name is deleted, whether its task had ended, was killed or failed, and the job's folder goes,
    without which a task that is still running moves nothing. The driver hears a number from each task. A task that is
    run twice writes the same files again.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        job = f"{root}/_job-{self.job}"
        hidden, names = f"{job}/{uuid.uuid4().hex}", []
        files.create_dir(hidden, recursive=True)
        for batch in iterator:
            columns = batch.schema.names
            for row in batch.to_pylist():
                content = row["content"] if "content" in columns else None
                if content is None and row.get("image") is not None:
                    i = row["image"]
                    content = png.encode(np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])[:, :, :3])
                if content is None or row["name"] is None:
                    raise ValueError(f"no name or no picture in a row: {row['name']!r}")
                with files.open_output_stream(f"{hidden}/{len(names)}") as f:
                    f.write(content)
                names.append(row["name"])
        with files.open_output_stream(f"{hidden}/names") as f:
            f.write("\n".join(names).encode())
        for folder in sorted({f"{root}/{n}".rpartition("/")[0] for n in names}):
            files.create_dir(folder, recursive=True)
        for k, n in enumerate(names):
            files.move(f"{hidden}/{k}", f"{root}/{n}")
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        files.create_dir(f"{root}/_job-{self.job}", recursive=True)
        files.delete_dir(f"{root}/_job-{self.job}")
        with files.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Take back what the job has written. The job's folder is renamed first, so that no more is moved."""
        files, root = opened(self.path)
        job, gone = f"{root}/_job-{self.job}", f"{root}/_gone-{self.job}"
        if files.get_file_info(job).type != fs.FileType.Directory:
            return
        files.move(job, gone)
        for listing in files.get_file_info(fs.FileSelector(gone, recursive=True)):
            if listing.base_name == "names":
                with files.open_input_stream(listing.path) as f:
                    names = f.read().decode()
                for n in names.split("\n") if names else []:
                    if files.get_file_info(f"{root}/{n}").type == fs.FileType.File:
                        files.delete_file(f"{root}/{n}")
        files.delete_dir(gone)


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> LiveReader:
        return LiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        if "name" not in schema.names or not {"content", "image"} & {*schema.names}:
            raise ValueError("images are written from rows of name and content, or of name and image")
        return ImageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.dataSource.register(Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
