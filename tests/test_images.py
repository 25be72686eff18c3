"""Image files: the codec, frames read on a grid, folders that are followed, files that are written whole or not at all."""

import os
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.functions import png
from scenespark.sources import frames as src
from scenespark.sources import images


def picture(k, h=6, w=9):
    return np.random.default_rng(k).integers(0, 256, (h, w, 3), dtype=np.uint8)


def put(folder, names, hidden=True):
    os.makedirs(folder, exist_ok=True)
    for k, n in enumerate(names):
        with open(f"{folder}/.{n}", "wb") as f:
            f.write(png.encode(picture(k)))
        os.rename(f"{folder}/.{n}", f"{folder}/{n}")


def filtered(x, kind):
    """A PNG whose rows are written with one of the format's filters."""
    h, w, n = x.shape
    rows, flat = [], x[:, :, ::-1].reshape(h, w * n).astype(int)
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]])
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"tEXt", b"note") + png.chunk(b"IDAT", zlib.compress(b"".join(rows))) + png.chunk(b"IEND", b"")


def test_codec():
    x = picture(1)
    assert (png.decode(png.encode(x)) == x).all() and (png.decode(png.encode(x[:, :, :1])) == x[:, :, :1]).all()
    for kind in range(5):
        assert (png.decode(filtered(x, kind)) == x).all()
    whole = png.encode(x)
    for broken in (b"", b"GIF89a", whole[:-3], whole[:40] + b"x" + whole[41:]):
        with pytest.raises(ValueError):
            png.decode(broken)


def test_files_outside_a_range_are_not_opened(spark, tmp_path):
    """All files but those of the range are broken: reading one is an error."""
    put(tmp_path / "in", [f"f{k:03d}.png" for k in range(40)])
    for k in [*range(10), *range(30, 40)]:
        (tmp_path / "in" / f"f{k:03d}.png").write_bytes(png.SIGNATURE + b"broken")
    (tmp_path / "in" / "_note.png").write_bytes(b"")
    rows = src.frames_folder(spark, f"{tmp_path}/in", 2.0, 1.0, 5, 15, 4)
    got = rows.select("analyzed_idx", "source_idx", "timestamp_sec", "image.height", "image.data").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(k, 2 * k, float(k)) for k in range(5, 15)] and {r["height"] for r in got} == {6}
    assert all(bytes(r["data"]) == picture(r["source_idx"]).tobytes() for r in got)
    assert rows.where("timestamp_sec > 6 and timestamp_sec <= 8").select("source_idx", "content").count() == 2
    with pytest.raises(Exception, match="PNG"):
        src.frames_folder(spark, f"{tmp_path}/in", 2.0, 1.0).select("image.height").collect()
    # a scan without filters after one with them sees all frames
    put(tmp_path / "good", [f"f{k:03d}.png" for k in range(6)])
    plain = spark.read.format("frames").option("path", f"{tmp_path}/good").load()
    assert [plain.where("timestamp_sec >= 2").count(), plain.count(), src.frames_folder(spark, f"{tmp_path}/good", end=3.0).count()] == [4, 6, 3]


@pytest.mark.parametrize("workers", [1, 3, 8])
def test_stretches_equal_one_sequential_read(workers, tmp_path):
    put(tmp_path / "7", [f"f{k:03d}.png" for k in range(23)])
    put(tmp_path / "12", ["f000.png"])
    reader = images.FrameReader({"path": str(tmp_path), "fps": "3", "interval_sec": "0.7", "workers": str(workers)})
    parts = reader.partitions()
    rows = [r[:5] for p in parts for r in reader.read(p)]
    want, k = [], 0
    while k * 0.7 < 23 / 3 - 1e-6:
        frame = min(int(np.rint(k * 0.7 * 3)), 22)
        want.append((7, frame, k, k * 0.7, f"{tmp_path}/7/f{frame:03d}.png"))
        k += 1
    assert rows == [*want, (12, 0, 0, 0.0, f"{tmp_path}/12/f000.png")] and len([p for p in parts if p.stream == 7]) == workers
    with pytest.raises(ValueError):
        images.FrameReader({"path": "", "fps": "0"})


def test_bounds_of_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

    t = ("timestamp_sec",)
    reader = images.FrameReader({"path": "", "pushdown": "true"})
    other = EqualTo(("stream_id",), 3)
    assert list(reader.pushFilters([GreaterThanOrEqual(t, 2.0), GreaterThan(t, 2.0), LessThan(t, 9.0), LessThanOrEqual(t, 8.0), other])) == [other]
    assert [x for x in (1.0, 2.0, 2.1, 8.0, 8.1) if reader.wanted(x)] == [2.1, 8.0]
    assert list(images.FrameReader({"path": ""}).pushFilters([LessThan(t, 9.0)])) == [LessThan(t, 9.0)]


def followed(spark, tmp_path, fail_at=None, most=7):
    """Take all that has come to the folder, or fail at a frame; the batches' sizes."""
    rows = src.live_frames(spark, f"{tmp_path}/live", 2.0, most).select("stream_id", "source_idx", "timestamp_sec", "bgr_path", F.col("image.width").alias("w"))
    if fail_at is not None:
        rows = rows.withColumn("w", F.when(F.col("source_idx") == fail_at, F.raise_error(F.lit("fails"))).otherwise(F.col("w")))
    query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress]
    finally:
        query.stop()


def test_live_folder_loses_and_repeats_nothing(spark, tmp_path):
    put(tmp_path / "live", [f"f{k:05d}.png" for k in range(20)])
    with pytest.raises(Exception, match="fails"):
        followed(spark, tmp_path, fail_at=12)
    assert max(followed(spark, tmp_path)) <= 7
    put(tmp_path / "live", [f"f{k:05d}.png" for k in range(20, 25)])
    put(tmp_path / "live" / "3", ["a.png", "b.png"])
    followed(spark, tmp_path)
    got = sorted((r["stream_id"], r["source_idx"], r["timestamp_sec"], os.path.basename(r["bgr_path"]), r["w"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [(0, k, k / 2, f"f{k:05d}.png", 9) for k in range(25)] + [(3, 0, 0.0, "a.png", 9), (3, 1, 0.5, "b.png", 9)]


def test_live_offsets(tmp_path):
    put(tmp_path, [f"f{k}.png" for k in range(5)])
    live = images.LiveReader({"path": str(tmp_path), "most": "3"})
    first, second = live.latestOffset(), live.latestOffset()
    assert (first["0"][0], second["0"][0]) == (3, 5) and [s[1] for p in live.partitions(first, second) for s in p.samples] == [3, 4]
    again = images.LiveReader({"path": str(tmp_path), "most": "3"})
    again.partitions({}, first)
    assert again.latestOffset() == second
    assert images.LiveReader({"path": str(tmp_path), "start": "now"}).initialOffset()["0"][0] == 5
    os.remove(tmp_path / "f4.png")
    with pytest.raises(ValueError):
        again.partitions(first, second)


def test_unfinished_file_is_tried_again(tmp_path):
    put(tmp_path, ["a.png"])
    whole = (tmp_path / "a.png").read_bytes()
    (tmp_path / "a.png").write_bytes(whole[:20])
    part = images.Stretch(0, [(0, 0, 0.0, f"{tmp_path}/a.png")])
    with pytest.raises(ValueError):
        list(images.read_samples(str(tmp_path), part, 2, 0.0))
    later = threading.Timer(0.3, lambda: (tmp_path / "a.png").write_bytes(whole))
    later.start()
    assert len(list(images.read_samples(str(tmp_path), part, 20, 0.1))) == 1


def test_images_are_written_whole_or_not_at_all(spark, tmp_path):
    images.register(spark)
    rows = spark.createDataFrame([(f"a/{k}.png", (6, 9, 3, picture(k).tobytes())) for k in range(12)], "name string, image struct<height:int,width:int,nChannels:int,data:binary>").repartition(3)
    rows.write.format("frames").mode("append").save(f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["_SUCCESS", "a"] and (tmp_path / "out" / "_SUCCESS").read_text() == "12"
    assert all((png.decode((tmp_path / "out" / "a" / f"{k}.png").read_bytes()) == picture(k)).all() for k in range(12))
    bad = rows.withColumn("image", F.when(F.col("name") != "a/7.png", F.col("image")))
    with pytest.raises(Exception, match="no picture"):
        bad.write.format("frames").mode("append").save(f"{tmp_path}/bad")
    time.sleep(1)
    assert [f for _, _, names in os.walk(tmp_path / "bad") for f in names] == []
    with pytest.raises(Exception, match="name and"):
        spark.range(2).write.format("frames").mode("append").save(f"{tmp_path}/bad")
