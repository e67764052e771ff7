"""WAV audio: parsing of any PCM layout, a strict reader for 16 kHz mono, measures and samples of files as DataFrames, and a writer.

Samples come in rows of a few seconds, so a recording of hours is never one row. Other formats are turned to WAV by an outside program (transcode).
"""

from __future__ import annotations

import struct
import subprocess
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import files as shared_files
from voxframe.workspace import small_batches, write_table

# Fixed values of the RIFF format.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
LAYOUTS = frozenset([(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32)])
#: Extensions taken as media. Fixed values.
MEDIA = frozenset(
    ".wav .flac .mp3 .m4a .aac .ogg .opus .wma .aiff .aif .alac .ape .mka .m4b .amr .caf .wv .dts "
    ".mp4 .mkv .mov .avi .webm .m4v .wmv .flv .mpg .mpeg .ts .m2ts .mts .vob .3gp .ogv .asf .rm".split()
)
#: Neighbours on either side that a sample of another rate is made from.
TAPS = 16


def parse(data: bytes) -> tuple[np.ndarray, int]:
    """float32 samples [channel, frame] in [-1, 1] and the rate; 8, 16, 24 and 32 bit PCM and 32 bit float."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, (n,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        body, at = data[at + 8 : at + 8 + n], at + 8 + n + (n & 1)  # odd chunks are padded
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENSIBLE and len(body) >= 26:
                (tag,) = struct.unpack_from("<H", body, 24)
            fmt = tag, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            return samples_of(body, *fmt), fmt[2]
    raise ValueError("no data")


def samples_of(body: bytes, tag: int, channels: int, rate: int, bits: int) -> np.ndarray:
    """float32 samples [channel, frame] of raw frames."""
    width = bits // 8
    if channels < 1 or (tag, bits) not in LAYOUTS:
        raise ValueError(f"unknown layout: format {tag}, {bits} bits, {channels} channels")
    body = body[: len(body) // (width * channels) * width * channels]
    if tag == FLOAT:
        x = np.frombuffer(body, "<f4")
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 8388608
    else:
        x = np.frombuffer(body, f"<i{width}").astype(np.float32) / float(1 << (bits - 1))
    return np.ascontiguousarray(x.reshape(-1, channels).T, np.float32)


def parse_mono16k(data: bytes) -> np.ndarray:
    x, rate = parse(data)
    if rate != 16_000 or len(x) != 1 or struct.unpack_from("<H", data, data.index(b"fmt ") + 22)[0] != 16:
        raise ValueError("not 16 kHz, mono, 16 bit")
    return x[0]


def raw(samples: np.ndarray, bits: int = 16, tag: int = PCM) -> bytes:
    """Frames of PCM of 8, 16, 24 or 32 bits of samples [channel, frame], cut to [-1, 1], rounded half away from zero; or 32-bit float, as they are."""
    x = np.atleast_2d(samples)
    if (tag, bits) == (FLOAT, 32):
        x = x.astype("<f4")
    elif tag == PCM and bits in (8, 16, 24, 32):
        y = np.clip(x.astype(np.float64), -1, 1) * ((1 << (bits - 1)) - 1)
        y = np.trunc(y + np.copysign(0.5, y))
        x = (y + 128).astype(np.uint8) if bits == 8 else y.astype("<i2" if bits == 16 else "<i4")
    else:
        raise ValueError(f"unknown layout: format {tag}, {bits} bits")
    body = np.ascontiguousarray(x.T)
    return np.ascontiguousarray(body[..., None].view(np.uint8)[..., :3]).tobytes() if bits == 24 else body.tobytes()


def wav_head(size: int, rate: int, channels: int, bits: int, tag: int) -> bytes:
    """What stands before so many bytes of frames."""
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * bits // 8 * channels, bits // 8 * channels, bits)
    padded = size + (size & 1)
    return b"RIFF" + struct.pack("<I", 36 + padded) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", padded)


def to_wav(samples: np.ndarray, rate: int, bits: int = 16, tag: int = PCM) -> bytes:
    """A whole file of samples [channel, frame]."""
    body = raw(samples, bits, tag)
    return wav_head(len(body), rate, len(np.atleast_2d(samples)), bits, tag) + body + b"\0" * (len(body) & 1)


def reach(rate: int, to: int) -> int:
    """Neighbours on either side that a sample is made from."""
    return int(np.ceil(TAPS / min(1.0, to / rate)))


def resampled(x: np.ndarray, at: int, rate: int, to: int, first: int, last: int) -> np.ndarray:
    """Samples first to last at another rate, by a windowed sinc that passes what both rates hold; x: what is known of one channel from its frame at on, the rest counts as silence."""
    cut, half = min(1.0, to / rate), reach(rate, to)
    out, k = np.empty(last - first, np.float32), np.arange(-half + 1, half + 1)
    padded = np.concatenate([np.zeros(1), x, np.zeros(1)])
    for start in range(first, last, 1 << 14):
        t = np.arange(start, min(start + (1 << 14), last)) * (rate / to)
        d = k[None, :] - (t - np.floor(t))[:, None]
        w = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / half, -1, 1)))
        place = np.clip(np.floor(t).astype(np.int64)[:, None] + k - at + 1, 0, len(x) + 1)
        out[start - first : start - first + len(t)] = (padded[place] * w).sum(1)
    return out


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """float32 samples of one channel at another rate."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    return resampled(x, 0, rate, to, 0, max(1, round(len(x) * to / rate)))


def picked(x: np.ndarray, rate: int, channel: int | None = None, start: float = 0.0, end: float | None = None, to: int | None = None) -> tuple[np.ndarray, int]:
    """One channel of samples [channel, frame], or the mean of all, from start to end (if after it) in seconds, at another rate if asked."""
    if channel is not None and not 0 <= channel < len(x):
        raise ValueError(f"no channel {channel}")
    stop = x.shape[1] if end is None or end <= start else round(end * rate)
    x = x[:, max(0, round(start * rate)) : stop]
    one = x[channel] if channel is not None else x.mean(0, dtype=np.float64)
    return resample(one, rate, to or rate), to or rate


def _energy(x: np.ndarray, frame: int) -> np.ndarray:
    n = len(x) // frame
    return np.abs(x[: n * frame].astype(np.float64)).reshape(n, frame).mean(1)


def noise_floor(x: np.ndarray, rate: int = 16_000) -> float:
    """Tenth over middle of the sorted energies of 20 ms frames, 1 at most; 0 under 20 frames, 1 for silence."""
    e = np.sort(_energy(x, rate // 50))
    if len(e) < 20:
        return 0.0
    return 1.0 if e[len(e) // 2] <= 1e-6 else float(min(1.0, e[len(e) // 10] / e[len(e) // 2]))


def channel_correlation(x: np.ndarray, rate: int) -> float:
    """|r| of the first two channels' frame energies; 0 under 100 frames, 1 for constant ones."""
    a, b = (_energy(c, rate // 50) for c in x[:2])
    if len(a) < 100:
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    spread = float((a * a).sum() * (b * b).sum())
    return 1.0 if spread < 1e-6 else float(min(1.0, abs((a * b).sum()) / spread**0.5))


def is_media(path: F.Column) -> F.Column:
    """Whether the path ends like a media file, in letters of any case."""
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)).isin(*sorted(MEDIA))


def media_paths(listed: DataFrame) -> DataFrame:
    """path of the media files among the paths, sorted, once each."""
    return listed.select("path").where(is_media(F.col("path"))).distinct().orderBy("path")


def discover(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """path of the media files below the folders, sorted, once each; contents are not read."""
    return media_paths(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").load(paths))


def _rows(files: DataFrame, schema: pa.Schema, ddl: str, of) -> DataFrame:
    """Rows that of() makes of (content), with path; a file that can't be read gives a row with its error and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    yield from of(path, content.as_buffer().to_pybytes() if content.is_valid else b"")
                except (ValueError, struct.error, ZeroDivisionError) as e:
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"path": path, "error": str(e)}], schema)

    small_batches(files.sparkSession, 16)
    return files.select("path", "content").mapInArrow(run, ddl)


def decode(files: DataFrame) -> DataFrame:
    """path, rate, channels, frames, duration, noise_floor, correlation, error: from rows path, content."""
    schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration", pa.float64()), ("noise_floor", pa.float64()), ("correlation", pa.float64()), ("error", pa.string())])

    def of(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        x, rate = parse(content)
        yield pa.RecordBatch.from_pylist([{"path": path, "rate": rate, "channels": len(x), "frames": x.shape[1], "duration": x.shape[1] / rate, "noise_floor": noise_floor(x[0], rate), "correlation": channel_correlation(x, rate) if len(x) > 1 else None, "error": None}], schema)

    return _rows(files, schema, "path string, rate int, channels int, frames long, duration double, noise_floor double, correlation double, error string", of)


def read_samples(files: DataFrame, *, channel: int | None = None, start: float = 0.0, end: float | None = None, rate: int | None = 16_000, seconds: float = 30.0) -> DataFrame:
    """path, chunk, first (its first frame), rate, samples (array of float), error: one channel, or the mean of all, of a range of each file, in rows of so many seconds."""
    schema = pa.schema([("path", pa.string()), ("chunk", pa.int32()), ("first", pa.int64()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])

    def of(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        x, own = picked(*parse(content), channel, start, end, rate)
        step = max(1, round(seconds * own))
        for k, at in enumerate(range(0, max(1, len(x)), step)):
            part = x[at : at + step]
            samples = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part, pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([own], pa.int32()), samples, pa.nulls(1, pa.string())], schema=schema)

    return _rows(files, schema, "path string, chunk int, first long, rate int, samples array<float>, error string", of)


def write_files(chunks: DataFrame, root: str, bits: int = 16, tag: int = PCM) -> DataFrame:
    """path, n_bytes of mono WAV files written below root, the URI of a folder that the executors share: from rows path (relative), chunk, rate, samples.

    Each row is written as a part by the task that has it; then a recording's parts, in order of chunk, are copied behind a head in blocks of bounded size, and the file is renamed when it is whole. So
    no task holds a recording, a lost task's parts are passed over, and a job that fails leaves no file of its own and no part.
    """
    base, spark = root.rstrip("/"), chunks.sparkSession
    staging = f"{base}/_parts-{uuid.uuid4().hex}"
    schema = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("rate", pa.int64()), ("part", pa.string()), ("n", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, chunk, rate, samples in zip(*(b.column(k) for k in range(4))):
                x = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.empty(0, np.float32)
                part = f"{staging}/{uuid.uuid4().hex}"
                rows.append({"path": path.as_py(), "chunk": chunk.as_py(), "rate": rate.as_py(), "part": part, "n": shared_files.write_whole(part, [raw(x, bits, tag)])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        size = sum(group.column("n").to_pylist())
        blocks = (block for part in group.column("part").to_pylist() for block in shared_files.blocks(part))
        n = shared_files.write_whole(f"{base}/{key[0].as_py()}", chain([wav_head(size, group.column("rate")[0].as_py(), 1, bits, tag)], blocks, [b"\0" * (size & 1)]))
        return pa.table({"path": [key[0].as_py()], "n_bytes": pa.array([n], pa.int64())})

    small_batches(spark, 64)
    try:
        rows = chunks.select("path", F.col("chunk").cast("long"), F.col("rate").cast("long"), F.col("samples").cast("array<double>"))
        listed = write_table(rows.mapInArrow(parts, "path string, chunk long, rate long, part string, n long"), "parts")
        return write_table(listed.groupBy("path").applyInArrow(whole, "path string, n_bytes long"), "written")
    finally:
        shared_files.remove(staging)


def transcode(files: DataFrame, program: str = "ffmpeg", *, channel: int | None = None, start: float = 0.0, end: float | None = None, rate: int = 16_000, channels: int = 1) -> DataFrame:
    """path, content (WAV), error of media files in any format that the program on the executors reads: from rows path, content. A file that fails gives its error."""
    arguments = [program, "-nostdin", "-loglevel", "error", *(["-ss", str(start)] if start > 0 else []), "-i", "pipe:0", *(["-t", str(end - start)] if end and end > start else [])]
    mix = f"pan=mono|c0=c{channel}," if channel is not None else ""
    arguments += ["-vn", "-map", "0:a:0", "-af", f"{mix}aresample={rate}", "-ac", str(channels), "-ar", str(rate), "-c:a", "pcm_s16le", "-f", "wav", "pipe:1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data, error = None, None
                try:
                    done = subprocess.run(arguments, input=content.as_buffer() if content.is_valid else b"", capture_output=True)
                    data, error = (done.stdout, None) if done.returncode == 0 else (None, f"{program} failed: {done.stderr.decode(errors='replace').strip().splitlines()[:1]}")
                except OSError as e:
                    error = f"{program}: {e.strerror}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    small_batches(files.sparkSession, 4)
    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")
