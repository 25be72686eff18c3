"""Embedders: a registry of vectorised functions from images to vectors."""

from __future__ import annotations

import importlib.util
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images


@dataclass(frozen=True)
class EmbedderInfo:
    name: str
    dim: int
    device: str
    backend: str
    weight_size_mb: float | None = None


class Embedder(ABC):
    """Turns images (blue, green, red) into vectors; made once per task."""

    name = ""
    dim = 0
    backend = "numpy"

    def __init__(self, device: str = "auto"):
        self.device = "cpu"

    @abstractmethod
    def embed(self, bgr: np.ndarray) -> np.ndarray: ...

    def embed_batch(self, bgrs: list[np.ndarray]) -> list[np.ndarray]:
        return [self.embed(x) for x in bgrs]

    def info(self) -> EmbedderInfo:
        return EmbedderInfo(self.name, self.dim, self.device, self.backend)


REGISTRY: dict[str, type[Embedder]] = {}


def register(name: str):
    def add(cls: type[Embedder]) -> type[Embedder]:
        cls.name = name
        REGISTRY[name] = cls
        return cls

    return add


def list_embedders() -> list[str]:
    return sorted(REGISTRY)


def build_embedder(name: str, device: str = "auto") -> Embedder:
    if name not in REGISTRY:
        raise KeyError(f"unknown embedder {name!r}; known: {', '.join(list_embedders())}")
    return REGISTRY[name](device)


@register("phash")
class PerceptualHash(Embedder):
    dim = 64

    def embed(self, bgr):
        return images.phash(bgr)


@register("hsv")
class ColourHistogram(Embedder):
    dim = 96

    def embed(self, bgr):
        return images.hsv_histogram(bgr)


class Weighted(Embedder):
    """A model whose weights and library come with the cluster; its loader is injected."""

    library = ""
    loader = None

    def __init__(self, device: str = "auto"):
        super().__init__(device)
        if type(self).loader is None:
            found = "is" if importlib.util.find_spec(self.library) else "is not"
            raise RuntimeError(f"{self.name} needs weights: set {type(self).__name__}.loader to a function of the device ({self.library} {found} installed)")
        self.model = type(self).loader(device)

    def embed(self, bgr):
        return np.asarray(self.model(bgr), np.float32)


# Model names, their vectors' lengths, and the libraries that load them.
WEIGHTED = {
    "ultralytics": {"yolov8n": 256, "yolov8s": 512, "yolov8m": 576, "yolov8n-seg": 256, "yolo11n": 256, "yolo11s": 512, "yolo26n": 256, "mobile_sam": 256},
    "open_clip": {"clip-vit-b32": 512, "clip-vit-b16": 512, "clip-vit-l14": 768, "siglip-b16": 768, "mobileclip-s1": 512, "mobileclip-s2": 512, "mobileclip-b": 512, "mobileclip2-s0": 512},
}
for _library, _models in WEIGHTED.items():
    for _name, _dim in _models.items():
        register(_name)(type(f"Model_{_name}", (Weighted,), {"dim": _dim, "backend": _library, "library": _library}))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, REGISTRY[n].dim, REGISTRY[n].backend) for n in list_embedders()], "name string, dim int, backend string").orderBy("name")


def embed(image: Column, name: str, device: str = "auto", max_width: int = 0) -> Column:
    """The vector of an image struct (height, width, nChannels, data), in Arrow batches; wider images are shrunk to ``max_width`` first."""
    build_embedder_here = build_embedder

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = build_embedder_here(name, device)
        for x in batches:
            bgrs = [images.decode(h, w, c, d) for h, w, c, d in zip(x["height"], x["width"], x["nChannels"], x["data"], strict=True)]
            bgrs = [images.resize_max_width(b, max_width) for b in bgrs] if max_width else bgrs
            yield pd.Series([v.astype(np.float32) for v in model.embed_batch(bgrs)], dtype=object)

    return run(F.struct(image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("nChannels"), image["data"].alias("data")))


def image_sharpness(image: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([images.sharpness(images.decode(h, w, c, d)) for h, w, c, d in zip(x["height"], x["width"], x["nChannels"], x["data"], strict=True)], dtype=float)

    return run(F.struct(image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("nChannels"), image["data"].alias("data")))


def microbenchmark(name: str, bgr: np.ndarray, warm: int = 3, runs: int = 20) -> dict:
    """Latency of one image on the driver: mean, p50, p95 in ms, and frames a second."""
    model = build_embedder(name)
    for _ in range(warm):
        model.embed(bgr)
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        model.embed(bgr)
        took.append((time.perf_counter() - t) * 1000)
    mean = float(np.mean(took))
    return {"name": name, "mean_ms": mean, "p50_ms": float(np.percentile(took, 50)), "p95_ms": float(np.percentile(took, 95)), "fps": 1000 / max(mean, 1e-6)}
