"""Codecs of packed columns: the words of a segment and vectors as blobs, as other stores keep them.

Words: their number, then for each three 32-bit floats (start, end, probability), the length of its text and the text in UTF-8; all little-endian. A blob that was cut gives the words
before the cut. Both ways go through whole Arrow batches: a step handles the k-th word of all blobs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = "array<struct<start:float,end:float,probability:float,text:string>>"
_WORD = pa.struct([("start", pa.float32()), ("end", pa.float32()), ("probability", pa.float32()), ("text", pa.string())])
#: Bytes before a word's text.
HEAD = 16


def _bytes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each blob begins and ends (nulls: nowhere)."""
    blobs = pa.array(blobs.to_pylist(), pa.binary()) if blobs.offset or not pa.types.is_binary(blobs.type) else blobs
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(blobs) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at[:-1], np.where(blobs.is_valid().to_numpy(zero_copy_only=False), at[1:], at[:-1])


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view(kind).ravel()


def words_of(blobs: pa.Array) -> pa.Array:
    """The words of each blob; none for null and for blobs without a number."""
    data, at, end = _bytes(blobs)
    row = np.flatnonzero(end - at >= 4)
    left, at = _numbers(data, at[row], "<u4").astype(np.int64) if len(row) else np.empty(0, np.int64), at[row] + 4
    found = [(np.empty(0, np.int64),) * 4]
    k = 0
    while len(row):
        go = (left > 0) & (at + HEAD <= end[row])
        row, at, left = row[go], at[go], left[go]
        if not len(row):
            break
        size = _numbers(data, at + 12, "<u4").astype(np.int64)
        go = at + HEAD + size <= end[row]
        row, at, left, size = row[go], at[go], left[go] - 1, size[go]
        found.append((row, np.full(len(row), k), at, size))
        at, k = at + HEAD + size, k + 1
    row, k, at, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((k, row))
    row, at, size = row[order], at[order], size[order]
    columns = [pa.array(_numbers(data, at + 4 * i, "<f4"), pa.float32()) if len(at) else pa.array([], pa.float32()) for i in range(3)]
    raw = data.tobytes()
    texts = pa.array([raw[i : i + n].decode("utf-8", "replace") for i, n in zip((at + HEAD).tolist(), size.tolist())], pa.string())
    stop = np.append(0, np.cumsum(np.bincount(row, minlength=len(blobs))))
    return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.StructArray.from_arrays([*columns, texts], fields=list(_WORD)))


def blobs_of(words: pa.Array) -> pa.Array:
    """The blob of each row of words; null rows have none of them."""
    n = np.array([len(x) if x.is_valid else 0 for x in words], np.int64)
    flat = words.flatten()
    numbers = [np.nan_to_num(flat.field(k).to_numpy(zero_copy_only=False).astype("<f4")) if len(flat) else np.empty(0, "<f4") for k in range(3)]
    texts = [(t or "").encode() for t in flat.field(3).to_pylist()] if len(flat) else []
    heads = np.stack([*[x.view("<u4") for x in numbers], np.array([len(t) for t in texts], "<u4")], 1).astype("<u4")
    raw = heads.tobytes()
    parts = [raw[HEAD * i : HEAD * (i + 1)] + t for i, t in enumerate(texts)]
    stop = np.cumsum(n).tolist()
    return pa.array([int(k).to_bytes(4, "little") + b"".join(parts[j - k : j]) for k, j in zip(n.tolist(), stop)], pa.binary())


def vectors_of(blobs: pa.Array) -> pa.Array:
    """Raw 32-bit floats; what is left over at the end is passed over."""
    data, at, end = _bytes(blobs)
    n = (end - at) // 4
    place = np.repeat(at - 4 * (np.cumsum(n) - n), n) + 4 * np.arange(n.sum())
    values = pa.array(_numbers(data, place, "<f4"), pa.float32()) if len(place) else pa.array([], pa.float32())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)


def unpack_words(blobs: str | Column) -> Column:
    return F.arrow_udf(words_of, WORDS)(blobs)


def pack_words(words: str | Column) -> Column:
    return F.arrow_udf(blobs_of, "binary")(words)


def unpack_vector(blobs: str | Column) -> Column:
    return F.arrow_udf(vectors_of, "array<float>")(blobs)
