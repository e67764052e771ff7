"""Settings of runs: read from TOML, checked, written back. Unknown keys are errors; whole numbers do for fractions.

What the engine decides with is used there; what models are told (model_options) is handed to the functions plugged into operators/inference.py.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.render import FORMATS


@dataclass(frozen=True)
class Settings:
    out_dir: str = ""
    work_dir: str = ""
    db_path: str = ""
    model_dir: str = ""
    keep_work: bool = False
    mirror_tree: bool = True
    formats: list[str] = field(default_factory=lambda: ["srt", "md", "json"])
    overwrite: bool = False
    recursive: bool = True
    language: str = ""
    model: str = "default"
    backend: str = "whisper"
    asr_accel: str = "auto"
    translate: bool = False
    beam_size: int = 5
    n_threads: int = 0
    condition_on_previous_text: bool = False
    temperature_fallback: bool = True
    entropy_threshold: float = 2.4
    logprob_threshold: float = -1.0
    no_speech_threshold: float = 0.6
    word_timestamps: bool = True
    suppress_non_speech: bool = True
    vad_filter: bool = True
    hotwords: list[str] = field(default_factory=list)
    initial_prompt: str = ""
    isolate_model: str = ""
    isolate_accel: str = "auto"
    onnx_accel: str = "auto"
    gpu_runtime: str = "prompt"
    segmentation_model: str = ""
    embedding_model: str = ""
    min_speakers: int = -1
    max_speakers: int = -1
    diar_cluster_threshold: float = 0.5
    decode_lookahead: int = 1
    isolate: str = "auto"
    isolate_auto_threshold: float = 0.28
    diarize: bool = True
    num_speakers: int = -1
    embed_min_segment: float = 3.0
    embed_max_segments: int = 8
    min_speaker_speech: float = 8.0
    match_threshold: float = 0.65
    review_threshold: float = 0.50
    cluster_threshold: float = 0.65
    enroll_match_threshold: float = 0.55
    enroll_collapse: bool = True
    enroll_window: float = 4.0
    enroll_min_clip: float = 3.0
    recluster_after_batch: bool = True
    split_channels: bool = False
    max_split_channels: int = 8
    channel_independence: float = 0.35

    def model_options(self) -> dict:
        """What models are told: recognition, diarization, isolation; the prompt ends with the words that are expected."""
        words = ", ".join(self.hotwords) + "." if self.hotwords else ""
        names = ("backend model language translate beam_size n_threads condition_on_previous_text temperature_fallback entropy_threshold logprob_threshold no_speech_threshold "
                 "word_timestamps suppress_non_speech vad_filter segmentation_model embedding_model isolate_model num_speakers min_speakers max_speakers diar_cluster_threshold").split()
        return {n: getattr(self, n) for n in names} | {"prompt": " ".join(x for x in (self.initial_prompt, words) if x)}

    def problems(self) -> list[str]:
        """What is wrong with the values; empty if nothing is."""
        found = [f"{n} must be between 0 and 1" for n in ("match_threshold", "cluster_threshold", "enroll_match_threshold") if not 0 < getattr(self, n) < 1]
        least = {"enroll_min_clip": 1, "enroll_window": 1, "min_speaker_speech": 0, "embed_min_segment": 0.5, "embed_max_segments": 1, "max_split_channels": 1}
        found += [f"{n} must be at least {low}" for n, low in least.items() if getattr(self, n) < low]
        if not 1 <= self.beam_size <= 32:
            found.append("beam_size must be between 1 and 32")
        if self.review_threshold >= self.match_threshold:
            found.append("review_threshold must be below match_threshold")
        if not self.formats:
            found.append("formats must name one format at least")
        found += [f"unknown format {f}" for f in self.formats if f.lower() not in FORMATS]
        if self.isolate.lower() not in ("never", "auto", "always"):
            found.append("isolate must be never, auto or always")
        if not self.model:
            found.append("model must be set")
        return found


KEYS = tuple(sorted(f.name for f in fields(Settings)))


def unknown_keys(keys: DataFrame, column: str = "key") -> DataFrame:
    """The keys that name no setting, each once."""
    return keys.select(column).where(~F.col(column).isin(*KEYS)).distinct()


def load(text: str) -> Settings:
    """Settings from TOML; ValueError names unknown keys, wrong types and values out of range."""
    given = tomllib.loads(text)
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    if unknown := sorted(given.keys() - kinds.keys()):
        raise ValueError("unknown keys: " + ", ".join(unknown))
    for key, value in given.items():
        if kinds[key] is float and type(value) is int:
            given[key] = float(value)
        elif type(value) is not kinds[key] or (kinds[key] is list and not all(isinstance(x, str) for x in value)):
            raise ValueError(f"{key} must be of type {kinds[key].__name__}")
    settings = Settings(**given)
    if found := settings.problems():
        raise ValueError("; ".join(found))
    return settings


def save(settings: Settings) -> str:
    """TOML that load() reads back."""
    return "".join(f"{f.name} = {json.dumps(getattr(settings, f.name), ensure_ascii=False)}\n" for f in fields(settings))
