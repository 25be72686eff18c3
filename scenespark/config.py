"""Settings as frozen dataclasses; the defaults are part of the semantics."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class SamplerConfig:
    interval_sec: float = 1.0


@dataclass(frozen=True)
class SegmenterConfig:
    sim_threshold: float = 0.96
    use_ema: bool = True
    ema_alpha: float = 0.25
    min_shot_sec: float = 2.0


@dataclass(frozen=True)
class SelectorConfig:
    max_frames_per_segment: int = 3
    seconds_per_pick: float = 8.0
    min_temporal_spacing_sec: float = 1.0
    sharpness_weight: float = 0.45
    representativeness_weight: float = 0.55
    diversity_sim_threshold: float = 0.97
    min_picks: int = 6


@dataclass(frozen=True)
class CaptionerConfig:
    max_picks: int = 24
    detail: str = "low"
    stream_per_segment: bool = True
    segment_max_frames: int = 3
    model: str = "default"
    segment_model: str = ""
    fallback_models: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class EmbedderConfig:
    name: str = "phash"
    device: str = "auto"


@dataclass(frozen=True)
class PipelineConfig:
    output_root: str = "outputs"
    embed_max_width: int = 640
    cache_frames: bool = True
    cache_width: int = 640
    sampler: SamplerConfig = field(default_factory=SamplerConfig)
    segmenter: SegmenterConfig = field(default_factory=SegmenterConfig)
    selector: SelectorConfig = field(default_factory=SelectorConfig)
    captioner: CaptionerConfig = field(default_factory=CaptionerConfig)
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)

    def to_dict(self) -> dict:
        return asdict(self)


def resolve_device(name: str) -> str:
    """Executors have CPUs: automatic choice is "cpu", a named device is passed through."""
    return "cpu" if name == "auto" else name


def load_dotenv(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines into the environment, quotes stripped, set variables left alone; returns what was read."""
    found: dict[str, str] = {}
    path = Path(path)
    if path.is_file():
        for line in path.read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().partition("=")
            key = key.strip()
            if eq and key and not key.startswith("#"):
                found[key] = value.strip().strip("\"'")
                os.environ.setdefault(key, found[key])
    return found
