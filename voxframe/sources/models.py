"""The models a run can name: what is known of them, and where one lies. None is fetched."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, kinds and sizes of models. Fixed values.
CATALOGUE = (
    ("tiny", "whisper", 78_000_000, "tiny.bin"),
    ("base", "whisper", 148_000_000, "base.bin"),
    ("small", "whisper", 488_000_000, "small.bin"),
    ("medium", "whisper", 1_530_000_000, "medium.bin"),
    ("large-v2", "whisper", 3_090_000_000, "large-v2.bin"),
    ("large-v3", "whisper", 3_100_000_000, "large-v3.bin"),
    ("large-v3-turbo", "whisper", 1_620_000_000, "large-v3-turbo.bin"),
    ("pyannote-segmentation-3.0", "segmentation", 6_000_000, "pyannote-segmentation-3.0.onnx"),
    ("wespeaker-resnet293", "embedding", 110_000_000, "wespeaker-resnet293.onnx"),
    ("3dspeaker-campplus-en", "embedding", 28_000_000, "3dspeaker-campplus-en.onnx"),
    ("3dspeaker-eres2netv2", "embedding", 68_000_000, "3dspeaker-eres2netv2.onnx"),
    ("uvr-mdxnet", "separation", 66_759_516, "uvr-mdxnet.onnx"),
    ("parakeet-tdt-0.6b-v3", "parakeet", 660_000_000, "parakeet-tdt-0.6b-v3"),
    ("silero-vad", "vad", 2_200_000, "silero_vad.onnx"),
    ("whisper-vad", "whisper_vad", 885_098, "whisper-vad.bin"),
)
#: What a kind of model is for, as the table shows it.
USES = {"whisper": "transcription", "parakeet": "transcription", "segmentation": "segmentation", "separation": "isolation", "vad": "vad", "whisper_vad": "vad"}


def catalogue(spark: SparkSession) -> DataFrame:
    """name, kind, n_bytes, file."""
    return spark.createDataFrame(CATALOGUE, "name string, kind string, n_bytes long, file string")


def find_model(models: DataFrame, name: str, kind: str) -> DataFrame:
    """The model of that kind and name, in letters of any case; no row if there is none."""
    return models.where((F.col("kind") == kind) & (F.lower("name") == name.lower()))


def resolve(name: str, kind: str, folder: str) -> str:
    """Where a model lies: the path itself if it is absolute, the file of that name in the folder, or the catalogue's file there. ValueError if it isn't there."""
    known = [file for n, k, _, file in CATALOGUE if k == kind and n.lower() == name.lower()]
    for at in [name] if os.path.isabs(name) else [os.path.join(folder, x) for x in (name, *known)]:
        if os.path.exists(at):
            return at
    raise ValueError(f"no {kind} model {name} in {folder}")
