"""Text and number expressions: names, messages, parsing, metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What in an error's text makes the next model worth a try, and the stages' icons.
RETRY_MARKS = ("403", "not available in your region", "country", "invalid_api_key", "Unauthorized", "401")
STAGE_ICONS = {"init": "[init]", "frame": "[frame]", "segment_closed": "[shot]", "segment_caption": "[say]", "select": "[pick]", "visualize": "[viz]", "caption": "[llm]", "done": "[done]"}


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def shorten(text: Column, most: int = 220) -> Column:
    """One line, trimmed, cut to ``most`` characters with an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(text, "\n", " "), r"^\s+|\s+$", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))).cast("long")


def retryable(error: Column) -> Column:
    found = F.lit(False)
    for mark in RETRY_MARKS:
        found = found | F.contains(error, F.lit(mark))
    return found


def model_list(text: Column) -> Column:
    """Names separated by commas or newlines, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def frame_file(index: Column, t: Column) -> Column:
    return F.format_string("f%05d_t%07.2fs.jpg", index, t)


def pick_file(pick: Column, segment: Column, t: Column) -> Column:
    return F.format_string("kf_%03d_seg%02d_t%07.2fs.jpg", pick, segment, t)


def prompt_line(pick: Column, of: Column, t: Column, segment: Column) -> Column:
    return F.format_string("FRAME %d/%d @ t=%.2fs  (segment #%d)", pick, of, t, segment)


def rate(text: Column) -> Column:
    """Frames per second of "num/den" or a number; null for nonsense or a zero denominator."""
    part = F.split(text, "/")
    return F.when(F.size(part) == 2, F.try_divide(F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))


def rotation(degrees: Column) -> Column:
    """Counter-clockwise metadata as a clockwise turn below 360."""
    return F.pmod(-degrees, F.lit(360))


def output_size(width: Column, height: Column, turn: Column, most: int) -> tuple[Column, Column]:
    """Size after rotation and scaling down to ``most`` wide, in even numbers of at least 2."""
    turned = turn.isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    scale = F.least(F.lit(1.0), F.lit(float(most)) / w)
    even = lambda x: F.greatest(F.lit(2), (F.floor(F.floor(x * scale) / 2) * 2)).cast("int")
    return even(w), even(h)


def colour(index: Column) -> Column:
    return F.pmod(index * 137, F.lit(180))


def stage_icon(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STAGE_ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, stage), F.lit("[?]"))


def data_url(image: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(image), "\r\n", ""))


def target_k(duration: Column, seconds_per: float, most: int) -> Column:
    """How many picks a segment may give."""
    if seconds_per <= 0:
        return F.lit(most)
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(duration / seconds_per))).cast("int")


def tick(i: Column, n: Column, ticks: Column) -> Column:
    """Place of label i of some over n cells."""
    return F.floor(i * (n - 1) / F.greatest(ticks - 1, F.lit(1))).cast("int")


def shot_header(start: Column, end: Column, n: Column) -> Column:
    return F.format_string("Shot starting at t=%.1fs, ending at t=%.1fs (%.1fs long). %d frame(s) follow.", start, end, end - start, n)


def closed_message(segment: Column, end: Column, duration: Column, n: Column) -> Column:
    return F.format_string("Segment #%d closed at t=%.1fs (%.1fs, %d frames)", segment, end, duration, n)


def frame_message(number: Column, t: Column, sim: Column, sharp: Column, embed_ms: Column, begins: Column) -> Column:
    """The message of a sampled frame, numbered from 1."""
    line = F.format_string("Frame %d: t=%.1fs  sim=%.3f  sharp=%.0f  embed=%.1fms", number, t, sim, sharp, embed_ms)
    return F.concat(line, F.when(begins, "  [SHOT START]").otherwise(""))


def caption_message(segment: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("Segment #%d (%.1f-%.1fs): %s", segment, start, end, text)


def complete_message(frames: Column, segments: Column, picks: Column, wall_sec: Column) -> Column:
    return F.format_string("Complete: %d frames -> %d segments -> %d keyframes  (%.1fs wall)", frames, segments, picks, wall_sec)


def banner(pick: Column, segment: Column, t: Column) -> Column:
    return F.format_string("KF%02d  seg #%d  t=%.1fs", pick, segment, t)


def rotation_filter(turn: Column) -> Column:
    return F.when(turn == 90, "transpose=1").when(turn == 180, "transpose=1,transpose=1").when(turn == 270, "transpose=2")
