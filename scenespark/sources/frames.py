"""Frames from tables, images and event logs; sampling by time; readers of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embedders
from ..functions.vectors import var_pop
from ..operators.folds import fold
from ..operators.prefix import running
from ..schema import PICK_CSV
from ..store import exists
from . import images

MEDIA = ("mp4", "mov", "mkv", "avi", "webm", "m4v")


def frames_from_embeddings(vectors: DataFrame, step_sec: float = 1.0) -> DataFrame:
    """Labels are streams, ids the order; a frame each ``step_sec``; sharpness from the vector's spread."""
    ordinal = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return vectors.select(
        F.col("label").cast("int").alias("stream_id"),
        F.col("vec_id").alias("source_idx"),
        ordinal.cast("int").alias("analyzed_idx"),
        (ordinal * F.lit(step_sec)).cast("double").alias("timestamp_sec"),
        "embedding",
        (var_pop(F.col("embedding")) * 1000).alias("sharpness"),
    )


def seconds(ts: Column) -> Column:
    """A timestamp, with or without zone, as seconds since 1970 in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def frames_from_events(events: DataFrame) -> DataFrame:
    """Users are streams; the value is the sharpness."""
    return events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("source_idx"), seconds(F.col("ts")).alias("timestamp_sec"), F.col("value").alias("sharpness"), "event_type")


def frames_from_images(spark: SparkSession, path: str, embedder: str = "phash", interval_sec: float = 1.0, stream_id: int = 0, device: str = "auto", max_width: int = 0) -> DataFrame:
    """A folder of images as a stream, in the order of their names; unreadable ones are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    # Only names are numbered in one order, sorted by ranges; the images stay where they are read.
    placed = running(rows.select("image.origin", F.lit(stream_id).alias("stream_id")), ["stream_id"], ["origin"], {"_at": None})
    names = placed.select("origin", (F.col("_at") - 1).cast("int").alias("analyzed_idx"))
    named = rows.join(names, rows["image.origin"] == names["origin"]).select("image", "analyzed_idx")
    return named.select(F.lit(stream_id).alias("stream_id"), F.col("analyzed_idx").cast("long").alias("source_idx"), "analyzed_idx", (F.col("analyzed_idx") * interval_sec).alias("timestamp_sec"), embedders.embed(F.col("image"), embedder, device, max_width).alias("embedding"), embedders.image_sharpness(F.col("image")).alias("sharpness"), F.col("image.origin").alias("bgr_path"))


def greedy_sample(frames: DataFrame, interval_sec: float, key: str = "stream_id") -> DataFrame:
    """The first frame of each stream, and each that is ``interval_sec`` or more after the last one kept."""

    def step(state: list, t: float) -> tuple[bool]:
        keep = not state or t - state[0] >= interval_sec
        if keep:
            state[:] = [t]
        return (keep,)

    return fold(frames, [key], ["timestamp_sec", "source_idx"], ["timestamp_sec"], list, step, "keep boolean").where("keep").drop("keep")


def grid_sample(frames: DataFrame, interval_sec: float, fps: float, key: str = "stream_id") -> DataFrame:
    """A sample every ``interval_sec`` while below the duration: the frame nearest by number.

    The sample has its own ordinal and the grid's time. Frames are numbered in time order.
    """
    if interval_sec <= 0 or fps <= 0:
        raise ValueError("interval and rate must be positive")
    placed = running(frames.select(key, "source_idx", "timestamp_sec"), [key], ["timestamp_sec", "source_idx"], {"_at": None})
    rows = placed.select(key, F.col("source_idx").alias("frame"), (F.col("_at") - 1).alias("n"))
    length = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    last = F.floor((F.col("count") / fps - 1e-6) / interval_sec)
    last = F.when(last * interval_sec < F.col("count") / fps - 1e-6, last).otherwise(last - 1)
    grid = length.where(last >= 0).select(key, "count", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("analyzed_idx"))
    grid = grid.withColumn("timestamp_sec", F.col("analyzed_idx") * F.lit(float(interval_sec))).withColumn("n", F.least(F.rint(F.col("timestamp_sec") * fps).cast("long"), F.col("count") - 1))
    return grid.join(rows, [key, "n"]).select(key, "analyzed_idx", "timestamp_sec", F.col("frame").alias("source_idx"))


def slot_dedup(frames: DataFrame, interval_sec: float, key: str = "stream_id") -> DataFrame:
    """The first frame of each slot of the grid, at the slot's time."""
    slot = F.rint(F.col("timestamp_sec") / interval_sec).cast("long")
    first = frames.groupBy(key, slot.alias("slot")).agg(F.min(F.struct("timestamp_sec", "source_idx")).alias("f"))
    return first.select(key, "slot", (F.col("slot") * F.lit(float(interval_sec))).alias("timestamp_sec"), F.col("f.source_idx").alias("source_idx"))


def chunk_of(t: Column, duration: Column, workers: int, interval_sec: float) -> Column:
    """The chunk, of some that begin on the grid, that holds a time."""
    begins = [F.rint(duration / workers * i / interval_sec) * interval_sec for i in range(1, workers)]
    place = F.lit(0)
    for b in begins:
        place = place + (t >= b).cast("int")
    return place


def sampled_source(spark: SparkSession, spec: str | None, upload: str | None = None) -> tuple[str, str]:
    """(kind, spec) of a source: a local pick goes before an upload; blank is camera 0; digits are cameras."""
    text = (spec or upload or "").strip() or "0"
    if text.isdigit():
        return "camera", text
    if "://" in text:
        return "url", text
    return "file", text


def pick_backend(kind: str, realtime: bool, workers: int = 1, decoder: bool = False) -> str:
    """How a source is read: streams and paced files as a stream, files by decoder, chunks or scan."""
    if kind != "file" or realtime:
        return "stream"
    if decoder:
        return "parallel" if workers > 1 else "decoder"
    return "scan"


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Media files of a folder, by extension and then name; one listing, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(MEDIA) + "}").load(folder).select("path", "length")
    place = F.array_position(F.array(*[F.lit(x) for x in MEDIA]), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    return files.orderBy(place, "path")


def between(frames: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Frames from ``start`` on and before ``end``: a filter on the time column, which Parquet scans prune by."""
    if start is not None:
        frames = frames.where(F.col("timestamp_sec") >= F.lit(float(start)))
    return frames if end is None else frames.where(F.col("timestamp_sec") < F.lit(float(end)))


def sample(frames: DataFrame, interval_sec: float, fps: float | None = None, key: str = "stream_id") -> DataFrame:
    """Frames thinned out by time: on a grid where the rate is known, so that frames can be sought by number, else greedily."""
    if fps:
        grid = grid_sample(frames, interval_sec, fps, key)
        rest = [c for c in frames.columns if c not in grid.columns]
        return grid.join(frames.select(key, "source_idx", *rest), [key, "source_idx"])
    return greedy_sample(frames, interval_sec, key) if interval_sec > 0 else frames


def capture(frames: DataFrame, seconds: float | None = None, most: int | None = None, key: str = "stream_id") -> DataFrame:
    """A bounded piece of each stream: its first ``seconds``, and of these at most ``most`` frames."""
    if seconds is not None:
        frames = frames.withColumn("_t0", F.min("timestamp_sec").over(Window.partitionBy(key))).where(F.col("timestamp_sec") - F.col("_t0") <= seconds).drop("_t0")
    if most is not None:
        frames = frames.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("timestamp_sec", "source_idx"))).where(F.col("_n") <= most).drop("_n")
    return frames


def frames_folder(spark: SparkSession, path: str, fps: float = 1.0, interval_sec: float | None = None, start: float | None = None, end: float | None = None, workers: int = 8) -> DataFrame:
    """The frames of a folder on a sampling grid, with their files' bytes and pixels, a task for each stretch of a stream.

    Stretches begin on the grid and stand in order of time. Files outside the range from ``start`` on and before ``end`` are never opened.
    """
    images.register(spark)
    bounded = start is not None or end is not None
    options = {"path": path, "fps": str(fps), "workers": str(workers), "pushdown": str(bounded).lower()} | ({"interval_sec": str(interval_sec)} if interval_sec else {})
    return between(spark.read.format("frames").options(**options).load(), start, end)


def live_frames(spark: SparkSession, path: str, fps: float = 1.0, most: int = 30, start: str = "begin") -> DataFrame:
    """A stream of the frames that a decoder writes to a folder, at most so many of each stream in a batch."""
    images.register(spark)
    return spark.readStream.format("frames").options(path=path, fps=str(fps), most=str(most), start=start).load()


def embedded(rows: DataFrame, embedder: str = "phash", device: str = "auto", max_width: int = 0) -> DataFrame:
    """Frames with pixels (column ``image``) as frames with embedding and sharpness; those without pixels are left out."""
    whole = rows.where("image is not null")
    made = whole.withColumn("embedding", embedders.embed(F.col("image"), embedder, device, max_width)).withColumn("sharpness", embedders.image_sharpness(F.col("image")))
    return made.select("stream_id", "source_idx", "analyzed_idx", "timestamp_sec", "embedding", "sharpness", "bgr_path")


def is_table(name: str) -> bool:
    return name.rstrip("/").endswith(".parquet")


def open_source(spark: SparkSession, spec: str, realtime: bool = False, embedder: str = "phash", interval_sec: float = 1.0, files_per_batch: int = 1, device: str = "auto", max_width: int = 0, fps: float = 0.0, start: float | None = None, end: float | None = None, workers: int = 8) -> DataFrame:
    """A table of frames (``.parquet``) or a folder of images, as a batch or, with ``realtime``, as a stream of what comes in.

    A folder with a rate (``fps``) is read on the grid of ``interval_sec`` in ``workers`` stretches, of PNG files; without one, all its images, of
    any kind, ``interval_sec`` apart. With ``realtime`` it is followed, ``files_per_batch`` frames of each stream a batch. Cameras and network streams need a
    decoder that writes their frames to a folder. Other specs are an error.
    """
    kind, name = sampled_source(spark, spec)
    if kind != "file":
        raise ValueError(f"{kind} {name!r}: let a decoder write its frames to a folder and open that with realtime=True")
    way = pick_backend(kind, realtime, workers, fps > 0)
    if way == "stream":
        if not is_table(name):
            return embedded(live_frames(spark, name, fps or 1 / interval_sec, files_per_batch), embedder, device, max_width)
        schema = spark.read.parquet(name).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(name)
    if is_table(name):
        return between(spark.read.parquet(name), start, end)
    if way == "scan":
        return between(frames_from_images(spark, name, embedder, interval_sec, 0, device, max_width), start, end)
    return embedded(frames_folder(spark, name, fps, interval_sec, start, end, workers if way == "parallel" else 1), embedder, device, max_width)


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """A run's table of picks, its columns by the header's names; rows with a bad time or number are left out; in time order."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    have = {c.lstrip("\ufeff"): c for c in rows.columns}
    typed = rows.select(*[(F.col(f"`{have[f.name]}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in PICK_CSV])
    return typed.where("timestamp_sec is not null and pick_id is not null").orderBy("timestamp_sec")


# Files that mark a folder as a finished run.
MARKERS = ("summary.json", "compare.json", "caption_bench.json", "caption_benchmark.json")


def run_history(spark: SparkSession, root: str, most: int = 200) -> DataFrame:
    """Folders below a root that hold a marker file, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path", "modificationTime")
    marked = files.select(F.regexp_extract("path", r"^(.*)/([^/]+)$", 1).alias("run"), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2).alias("marker"), "modificationTime").where(F.col("marker").isin(*MARKERS))
    return marked.groupBy("run").agg(F.max("modificationTime").alias("at"), F.min("marker").alias("marker")).orderBy(F.desc("at"), "run").limit(most)


def load_run(spark: SparkSession, run: str) -> DataFrame:
    """An overview of one run, a row per stream: counts from its summary, or, where that lacks them, from its tables.

    A table or a summary that is missing or broken counts as empty: streams are those that any part knows.
    """

    def table(name: str, *columns: str) -> DataFrame:
        if exists(spark, f"{run}/{name}.csv"):
            rows = spark.read.csv(f"{run}/{name}.csv", header=True)
            if {"stream_id", *columns} <= {*rows.columns}:
                return rows.withColumn("stream_id", F.col("stream_id").try_cast("long")).where("stream_id is not null")
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", stream_id long" if columns else "stream_id long")

    frames = table("analyzed_frames", "timestamp_sec").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_frames"), (F.max(F.col("timestamp_sec").try_cast("double")) - F.min(F.col("timestamp_sec").try_cast("double"))).alias("span"))
    segments = table("segments").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_segments"))
    picks = table("picks").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_picks"))
    kind = "streams array<struct<stream_id:long,frames:long,segments:long,picks:long,duration_sec:double>>"
    whole, part = f"{run}/summary_rows", f"{run}/summary.json"
    said = spark.createDataFrame([], "stream_id long, frames long, segments long, picks long, duration_sec double")
    if exists(spark, whole):
        said = spark.read.schema(said.schema).json(whole)
    elif exists(spark, part):
        said = spark.read.text(part, wholetext=True).select(F.inline(F.from_json("value", kind)["streams"]))
    every = frames.join(segments, "stream_id", "full").join(picks, "stream_id", "full").join(said.where("stream_id is not null"), "stream_id", "full")
    return every.select("stream_id", F.coalesce("frames", "n_frames", F.lit(0)).alias("frames"), F.coalesce("segments", "n_segments", F.lit(0)).alias("segments"), F.coalesce("picks", "n_picks", F.lit(0)).alias("picks"), F.coalesce("duration_sec", "span").alias("duration_sec"))


def probe(meta: DataFrame, column: str = "meta") -> DataFrame:
    """Width, height, rate, duration, frames and clockwise rotation from a prober's JSON."""
    from ..functions.text import rate, rotation

    kind = "streams array<struct<width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,nb_frames:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>>>, format struct<duration:string>"
    s = meta.withColumn("_m", F.from_json(column, kind)).withColumn("_s", F.get("_m.streams", F.lit(0)))
    fps = F.coalesce(F.nullif(rate(F.col("_s.avg_frame_rate")), F.lit(0.0)), rate(F.col("_s.r_frame_rate")), F.lit(0.0))
    duration = F.coalesce(F.nullif(F.col("_s.duration").try_cast("double"), F.lit(0.0)), F.col("_m.format.duration").try_cast("double"), F.lit(0.0))
    side = F.filter(F.transform("_s.side_data_list", lambda x: x["rotation"]), lambda x: x.isNotNull())
    turn = F.coalesce(F.get(side, F.lit(0)).try_cast("int"), F.col("_s.tags.rotate").try_cast("int"), F.lit(0))
    count = F.when(F.coalesce(F.col("_s.nb_frames"), F.lit("")) == "", F.floor(duration * fps)).otherwise(F.coalesce(F.col("_s.nb_frames").try_cast("long"), F.floor(duration * fps)))
    return s.select(*meta.columns, F.col("_s.width").alias("width"), F.col("_s.height").alias("height"), fps.alias("fps"), duration.alias("duration_sec"), count.alias("frame_count"), rotation(turn).alias("rotation"))
