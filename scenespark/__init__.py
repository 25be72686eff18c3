"""scenespark: ordered-stream frame analytics expressed as Spark plans."""

from .config import PipelineConfig
from .functions.embedders import build_embedder, list_embedders, register
from .operators.segment import ShotState, segment_frames, segment_rollup
from .operators.select import select_picks
from .plans.pipeline import Pipeline, benchmark
from .streaming.shots import stream_shots

__all__ = ["Pipeline", "PipelineConfig", "ShotState", "benchmark", "build_embedder", "list_embedders", "register", "segment_frames", "segment_rollup", "select_picks", "stream_shots"]
