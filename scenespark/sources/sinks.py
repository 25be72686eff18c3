"""Tables and documents of a run: CSV, JSON, JSON lines, reports, and copies of images, all by Spark's file systems."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png
from ..functions.images import resize_max_width
from ..functions.text import frame_file, pick_file
from ..schema import PICK_CSV
from ..store import write_text
from . import images


def run_folder(root: str, label: str) -> str:
    safe = re.sub(r"[^\w.-]", "_", label)
    return f"{root}/{safe}_{time.strftime('%Y%m%d_%H%M%S')}"


def rounded(**places: int) -> list[Column]:
    return [F.bround(c, n).alias(c) for c, n in places.items()]


def frames_table(sampled: DataFrame) -> DataFrame:
    """The rows of analyzed_frames.csv, with the rounding that readers expect."""
    return sampled.select("stream_id", "analyzed_idx", "source_idx", *rounded(timestamp_sec=3, sim_to_shot_mean=4, sharpness=1), F.col("is_shot_start").cast("int").alias("is_shot_start"))


def segments_table(segments: DataFrame) -> DataFrame:
    return segments.select("stream_id", "segment_id", *rounded(start_sec=3, end_sec=3, duration_sec=3), "num_frames")


def own_kind(name: Column, path: Column) -> Column:
    """A file's name with the ending of the file that it is copied from."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(kind, F.lit("")) == "", name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", "."), kind))


def pick_path(picks: DataFrame) -> Column:
    """Where a pick's picture lies in the folder of its run: below picks/ and its stream, where frames name files; else the name alone."""
    name = pick_file(F.col("pick_id"), F.col("segment_id"), F.col("timestamp_sec"))
    if "bgr_path" not in picks.columns:
        return name
    return F.when(F.col("bgr_path").isNotNull(), F.concat(F.lit("picks/"), F.col("stream_id").cast("string"), F.lit("/"), own_kind(name, F.col("bgr_path")))).otherwise(name)


def frame_path() -> Column:
    name = own_kind(frame_file(F.col("analyzed_idx"), F.col("timestamp_sec")), F.col("bgr_path"))
    return F.concat(F.lit("frames/"), F.col("stream_id").cast("string"), F.lit("/"), name)


def picks_table(picks: DataFrame) -> DataFrame:
    return picks.select("stream_id", "pick_id", "segment_id", *rounded(timestamp_sec=3, sharpness=1, representativeness=4, composite_score=4), "rank_in_segment", pick_path(picks).alias("saved_path")).select(*PICK_CSV.names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_tables(folder: str, sampled: DataFrame, segments: DataFrame, picks: DataFrame) -> None:
    write_csv(frames_table(sampled), f"{folder}/analyzed_frames.csv")
    write_csv(segments_table(segments), f"{folder}/segments.csv")
    write_csv(picks_table(picks), f"{folder}/picks.csv")


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition."""
    events.write.mode("append").json(path)


def write_json(spark, folder: str, name: str, content: dict | list) -> None:
    write_text(spark, f"{folder}/{name}", json.dumps(content, indent=2, ensure_ascii=False, default=str))


def copy_images(rows: DataFrame, folder: str, name: Column, most: int = 0) -> None:
    """The files that rows name in ``bgr_path``, copied to ``name`` below the folder: all of them, or none if the job fails.

    PNG files that are wider than ``most`` are shrunk to it; other kinds are copied as they are. Executors read and write the bytes, a file at a
    time; the driver sees neither names nor bytes.
    """
    wanted = rows.where("bgr_path is not null").select(name.alias("name"), F.regexp_replace("bgr_path", "^file:/+", "/").alias("bgr_path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = images.opened(row["bgr_path"])
                with files.open_input_stream(path) as f:
                    content = f.read()
                if most and content[:8] == png.SIGNATURE:
                    whole = png.decode(content)
                    content = content if whole.shape[1] <= most else png.encode(resize_max_width(whole, most))
                yield pa.RecordBatch.from_pydict({"name": [row["name"]], "content": [content]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

    images.register(rows.sparkSession)
    wanted.mapInArrow(read, "name string, content binary").write.format("frames").mode("append").save(folder)


def first_rows(df: DataFrame, most: int) -> tuple[list, int]:
    """The first rows of a table, and how many it has."""
    return df.limit(most).collect(), df.count()


def shown(n: int, of: int, where: str) -> str:
    return f"{n} of {of} rows are shown" + (f"; all of them are in `{where}`" if where and n < of else "") + "."


def markdown(title: str, df: DataFrame, most: int = 200, where: str = "") -> str:
    """A report's table of the first rows of a result, with a line that says how many rows there are, and where."""
    rows, n = first_rows(df, most)
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(x) for x in r) + " |" for r in rows) + f"\n\n{shown(len(rows), n, where)}\n"


def write_rows(spark, folder: str, name: str, df: DataFrame, most: int = 1000, key: str = "rows") -> DataFrame:
    """A result as JSON lines in ``name``_rows, whole, and its first rows in ``name``.json, which says how many there are; the table as written."""
    df.write.mode("overwrite").json(f"{folder}/{name}_rows")
    back = spark.read.schema(df.schema).json(f"{folder}/{name}_rows")
    rows, n = first_rows(back, most)
    write_json(spark, folder, f"{name}.json", {key: [r.asDict(recursive=True) for r in rows], "shown": len(rows), "of": n, "all": f"{name}_rows"})
    return back


def write_report(spark, folder: str, name: str, title: str, df: DataFrame, notes: str = "", most: int = 200) -> str:
    """A result whole in ``name``_rows, its first rows as a table in ``name``.md and as a list in ``name``.json; the report's text."""
    back = write_rows(spark, folder, name, df, most)
    text = markdown(title, back, most, f"{name}_rows") + (f"\n{notes}\n" if notes else "")
    write_text(spark, f"{folder}/{name}.md", text)
    return text


def run_readme(folder: str, cfg, summary: DataFrame, segments: DataFrame, picks: DataFrame, captions: DataFrame, most: int = 200) -> str:
    """What a run did: settings, counts, files, and its first shots, picks and captions."""
    s, g = cfg.selector, cfg.segmenter
    settings = [
        f"sampled every {cfg.sampler.interval_sec:.2f} s, embedder `{cfg.embedder.name}`",
        f"similarity below {g.sim_threshold} cuts after {g.min_shot_sec:.1f} s ({'running' if g.use_ema else 'arithmetic'} mean)",
        f"weights of sharpness and representativeness {s.sharpness_weight} and {s.representativeness_weight}",
    ]
    files = {"analyzed_frames.csv": "frames with their similarity", "segments.csv": "shots", "picks.csv": "chosen frames", "config.json": "settings", "summary.json": "counts", "caption.md": "the narration"}
    parts = [f"# Run {folder.rpartition('/')[2]}", "\n".join(f"* {x}" for x in settings), "| File | Holds |\n| --- | --- |\n" + "\n".join(f"| `{k}` | {v} |" for k, v in files.items())]
    for title, df in (("Summary", summary), ("Shots", segments.select("stream_id", "segment_id", *rounded(start_sec=2, end_sec=2, duration_sec=2), "num_frames").orderBy("stream_id", "segment_id")), ("Picks", picks.select("stream_id", F.format_string("KF%02d", "pick_id").alias("pick"), "segment_id", *rounded(timestamp_sec=2, sharpness=0, representativeness=3, composite_score=2)).orderBy("stream_id", "pick"))):
        parts.append(markdown(title, df, most, {"Summary": "summary_rows", "Shots": "segments.csv", "Picks": "picks.csv"}[title]).replace("# ", "## ", 1).rstrip())
    said, n = first_rows(captions.orderBy("stream_id"), most)
    parts.append("## Caption\n\n" + ("\n\n".join(r["text"] or "(no caption)" for r in said) or "(no caption)") + f"\n\n{shown(len(said), n, 'captions_rows')}")
    return "\n\n".join(parts) + "\n"


def caption_document(captions: DataFrame, source: str, embedder: str, most: int = 200) -> str:
    """The narration of each stream, with its model, frames and latency: of the first streams, and how many there are."""
    rows, n = first_rows(captions.orderBy("stream_id"), most)
    out = ["# Captions", f"Source `{source}`, embedder `{embedder}`."]
    for r in rows:
        out.append(f"## Stream {r['stream_id']}\n\nModel `{r['model']}`, {r['frames_sent']} frames sent, {r['latency_sec']:.2f} s.\n\n{r['text'] or r['error']}")
    return "\n\n".join([*out, shown(len(rows), n, "captions_rows")]) + "\n"


def shot_captions_document(captions: DataFrame, most: int = 1000) -> str:
    """A line for each shot's caption, in order of streams and shots: of the first shots, and how many there are."""
    rows, n = first_rows(captions.orderBy("stream_id", "segment_id"), most)
    lines = [f"- **#{r['segment_id']}** `t={r['start_sec']:.1f}–{r['end_sec']:.1f}s` ({r['latency_sec']:.1f}s, `{r['model']}`): {r['text'] or r['error']}" for r in rows]
    return "\n".join(["# Captions of shots", "", *lines, "", shown(len(rows), n, "segment_captions_rows")]) + "\n"
