"""WAV files as a data source: byte ranges of files are the partitions, heads are read by seeking, and a range of time reads its own bytes only.

Planning needs no head, just names and sizes: a task reads a file's head, finds which rows of samples begin in its bytes, and seeks to each. So a long recording is read by many tasks and no row
or task holds it whole. Predicates on path, channel and first are pushed down.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from voxframe import files
from voxframe.sources import wav

SCHEMA = "path string, chunk long, channel int, first long, rate int, channels int, bits int, frames long, samples array<float>, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("channel", pa.int32()), ("first", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
}


@dataclass
class Head:
    tag: int
    channels: int
    rate: int
    bits: int
    at: int
    frames: int

    @property
    def width(self) -> int:
        return self.bits // 8 * self.channels


def head_of(source: files.Source | files.Held) -> Head:
    """The layout of a file and where its samples are; no sample is read."""
    top = source.read_at(0, 12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, fmt = 12, None
    while at + 8 <= source.size:
        name, n = struct.unpack("<4sI", source.read_at(at, 8))
        if name == b"fmt ":
            body = source.read_at(at + 8, min(n, 40))
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == wav.EXTENSIBLE and len(body) >= 26:
                (tag,) = struct.unpack_from("<H", body, 24)
            if channels < 1 or rate < 1 or (tag, bits) not in wav.LAYOUTS:
                raise ValueError(f"unknown layout: format {tag}, {bits} bits, {channels} channels")
            fmt = tag, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            return Head(*fmt, at + 8, min(n, source.size - at - 8) // (fmt[3] // 8 * fmt[1]))
        at += 8 + n + (n & 1)  # odd chunks are padded
    raise ValueError("no data")


@dataclass
class Ranges(InputPartition):
    """Files and the bytes of each in which its rows begin."""

    parts: list[tuple[str, int, int]]


class WavReader(DataSourceReader):
    """Options: path (a folder's URI); seconds (length of a row, 30); channel (each, mean or a number); start and end in seconds; rate (samples are brought to it; their own if not given);
    samples (false: a row a file, without them); strict (true: what isn't 16 kHz, mono, 16 bit is an error); partition_bytes."""

    def __init__(self, options: dict[str, str]):
        self.path, self.seconds = options["path"], float(options.get("seconds", 30))
        self.channel = options.get("channel", "each")
        self.start, self.end = float(options.get("start", 0)), float(options["end"]) if "end" in options else None
        self.rate = int(options["rate"]) if "rate" in options else None
        self.samples, self.strict = options.get("samples", "true").lower() == "true", options.get("strict", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[Filter] = []
        if self.channel not in ("each", "mean") and not self.channel.isdigit():
            raise ValueError("channel is each, mean or a number")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # Spark tests all of them again, as rows of errors have no channel or frame
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("channel",), ("first",)):
                self.tests.append(f)
            yield f

    def _wanted(self, **values: object) -> bool:
        return all(v is not None and _TESTS[type(f)](v, f) for f in self.tests for k, v in values.items() if f.attribute == (k,))

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = [Ranges([])]
        held = 0
        for name, size in sorted(files.list_files(self.path, ".wav") + files.list_files(self.path, ".WAV")):
            if not self._wanted(path=name):
                continue
            step = self.partition_bytes if self.samples else size + 1
            for at in range(0, max(size, 1), step):
                if out[-1].parts and held + min(step, size - at) > self.partition_bytes:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((name, at, at + step))
                held += min(step, size - at)
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for name, low, high in partition.parts:
            try:
                source = files.Source(name)
                head = head_of(source)
                if self.strict and (head.rate, head.channels, head.bits, head.tag) != (16_000, 1, 16, wav.PCM):
                    raise ValueError("not 16 kHz, mono, 16 bit")
                if self.channel.isdigit() and int(self.channel) >= head.channels:
                    raise ValueError(f"no channel {self.channel}")
                yield from self._rows(name, source, head, low, high)
            except (ValueError, struct.error) as e:
                if low == 0:
                    yield self._batch(name, error=str(e))

    @staticmethod
    def _batch(path: str, samples: np.ndarray | None = None, **values: object) -> pa.RecordBatch:
        rows = {"path": [path]} | {k: [v] for k, v in values.items()}
        if samples is not None:
            rows["samples"] = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if isinstance(rows.get(f.name), list) else rows[f.name] if f.name in rows else pa.nulls(1, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def _rows(self, name: str, source: files.Source, head: Head, low: int, high: int) -> Iterator[pa.RecordBatch]:
        told = {"rate": self.rate or head.rate, "channels": head.channels, "bits": head.bits, "frames": head.frames}
        if not self.samples:
            yield self._batch(name, **told)
            return
        begin = min(head.frames, max(0, round(self.start * head.rate)))
        stop = head.frames if self.end is None or self.end <= self.start else min(head.frames, round(self.end * head.rate))
        n, to = max(0, stop - begin), told["rate"]
        total = n if to == head.rate else (max(1, round(n * to / head.rate)) if n else 0)
        step = max(1, round(self.seconds * to))
        # rows that begin in this task's bytes; the first one belongs to the file's first bytes
        for k in range(self._first_row(head, begin, to, step, low), -(-total // step) or 1):
            first = k * step
            if k and head.at + (begin + first * head.rate // to) * head.width >= high:
                return
            if not self._wanted(first=first):
                continue
            x = self._frames(source, head, begin, n, first, min(first + step, total))
            for channel in range(head.channels) if self.channel == "each" else [None if self.channel == "mean" else int(self.channel)]:
                if self.channel == "mean" or self._wanted(channel=channel):
                    one = x.mean(0, dtype=np.float64) if channel is None else x[channel]
                    yield self._batch(name, self._brought(one, head, n, first, min(first + step, total)), chunk=k, channel=channel, first=first, **told)

    @staticmethod
    def _first_row(head: Head, begin: int, to: int, step: int, low: int) -> int:
        if low == 0:
            return 0
        k = max(1, (max(0, (low - head.at) // head.width - begin)) * to // head.rate // step - 1)
        while head.at + (begin + k * step * head.rate // to) * head.width < low:
            k += 1
        return k

    def _span(self, head: Head, n: int, first: int, last: int) -> tuple[int, int]:
        """Frames of the range from which the samples first to last are made."""
        to = self.rate or head.rate
        if to == head.rate:
            return first, last
        half = wav.reach(head.rate, to)
        return max(0, first * head.rate // to - half), min(n, last * head.rate // to + half + 2)

    def _frames(self, source: files.Source, head: Head, begin: int, n: int, first: int, last: int) -> np.ndarray:
        low, high = self._span(head, n, first, last)
        body = source.read_at(head.at + (begin + low) * head.width, max(0, high - low) * head.width)
        return wav.samples_of(body, head.tag, head.channels, head.rate, head.bits)

    def _brought(self, x: np.ndarray, head: Head, n: int, first: int, last: int) -> np.ndarray:
        if self.rate in (None, head.rate):
            return x.astype(np.float32)
        return wav.resampled(x, self._span(head, n, first, last)[0], head.rate, self.rate, first, last)


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """path, chunk, channel, first, rate, channels, bits, frames, samples, error of the WAV files below folder; options as WavReader. Turns on the session's setting by which Python data sources are given predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavDataSource)
    return spark.read.format("wav").options(path=folder, **{k: str(v) for k, v in options.items() if v is not None}).load()
