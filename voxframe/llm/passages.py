"""Passages that repeat across documents, found level by level in windows of doubling length.

Windows of a level are hashed in chunks of documents of bounded size; a chunk hands on each hash once, with the smallest and the largest id that has it there, so a passage in many documents is
a row a chunk. A window whose hash stands under two ids repeats; those alone are extended to twice the length, and so on until none is left or the last
length asked for is reached. Below the shortest length that counts, a level need not test each of its windows: of those that lie in a window of the full length the smallest hash stands for them
all, and as equal windows choose alike, whatever repeats is found by it. A last step that would go past that length overlaps its halves.

The documents, their texts compressed, are dealt to their chunks by one shuffle that all levels of a plan share. What a level found goes back to the chunks that have it. Windows of the full length and beyond are
compared by 96 bits, shorter ones by 64, as these only decide what is looked at next.

Defined cases: null and empty texts have no words and stay as they are; a null id counts as the largest; documents with one id are none before the other, so they don't remove each other's
words; repeated rows are each judged; texts with fewer words than a window have none; an empty table gives an empty table; columns kept are passed through, whatever
their names are, but for those that begin with _vx_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.batches import map_batches, numbered
from voxframe.llm.decontaminate import vocabulary
from voxframe.workspace import small_batches, write_table

#: Bytes of text in a chunk about.
CHUNK = 8 << 20
#: Multipliers (odd) of the two hashes of a window.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FOUND = "chunk int, size int, x long, y long, first long"


def lengths(window: int, start: int) -> list[int]:
    """Lengths of the levels up to the window: from one of at most start words each is twice the one before, the last at most."""
    out = [window]
    while out[0] > max(1, start):
        out.insert(0, -(-out[0] // 2))
    return out


def words_of(text: str | bytes | None) -> list[bytes]:
    """Runs of what is no ASCII white space."""
    return (text if isinstance(text, bytes) else (text or "").encode()).split()


def _polys(v: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of each n values in a row."""
    if n == 1:
        return v
    h, half = _polys(v, n // 2, factor), n // 2
    h = h[: len(h) - half] * np.uint64(pow(factor, half, 1 << 64)) + h[half:]
    return h if n % 2 == 0 else h[:-1] * np.uint64(factor) + v[n - 1 :]


def _mixed(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    h = (a ^ a >> np.uint64(29)) * np.uint64(factor) + (b ^ b >> np.uint64(32))
    return (h ^ h >> np.uint64(31)) * np.uint64(FACTORS[0])


class Chunk:
    """The words of a chunk's documents in one row and the windows of the full length that are still looked at."""

    def __init__(self, ids: np.ndarray, texts: list[bytes | None], window: int):
        self.window, known, self.words = window, vocabulary(), []
        numbers = []
        for text in texts:
            words = words_of(text)
            self.words.append(words)
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        size = np.array([len(x) for x in numbers], np.int64)
        self.start = np.cumsum(size) - size
        row = np.concatenate([*numbers, np.empty(0, np.int64)])
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.left = np.repeat(self.start + size, size) - np.arange(len(row))  # words from here to the document's end
        self.id = ids[self.doc]
        digests = [xxhash.xxh3_128_intdigest(w) for w in known]
        halves = [np.array([0, *(d >> s & (1 << 64) - 1 for d in digests)], np.uint64) for s in (0, 64)]
        self.values = [half[row] for half in halves]
        self.alive = np.flatnonzero(self.left >= window)

    def sampled(self, n: int) -> np.ndarray:
        """For each window that is looked at the hash of those n of its words whose hash is smallest."""
        h = _polys(self.values[0], n, FACTORS[0])
        near = np.lib.stride_tricks.sliding_window_view(h, self.window - n + 1)[self.alive] if len(self.alive) else np.empty((0, 1), np.uint64)
        return near.min(1)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window that is looked at, the second of 32 bits."""
        if not len(self.alive):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        x, y = (_polys(v, self.window, f)[self.alive] for v, f in zip(self.values, FACTORS))
        return x, y >> np.uint64(32)


def _has(x: np.ndarray, y: np.ndarray, known: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether level n is known to have each pair of hashes, and its smallest id."""
    at = np.flatnonzero(known.column("size").to_numpy() == n)
    kx, ky, first = (known.column(c).to_numpy()[at] for c in ("x", "y", "first"))
    order = np.lexsort((ky, kx.view(np.uint64)))
    kx, ky, first = kx[order].view(np.uint64), ky[order].view(np.uint64), first[order]
    low, high = np.searchsorted(kx, x), np.searchsorted(kx, x, "right")
    hit, least = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(int((high - low).max(initial=0))):  # once, but for pairs that share the first hash
        of = np.flatnonzero(low + k < high)
        of = of[ky[low[of] + k] == y[of]]
        hit[of], least[of] = True, first[low[of] + k]
    return hit, least


def _levels(chunk: Chunk, known: pa.Table, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level the places of the windows that are looked at and their two hashes; before the next one, those that are not known to repeat go."""
    place, x, y = chunk.alive, np.empty(0, np.uint64), np.empty(0, np.uint64)
    for k, n in enumerate(sizes):
        if n < chunk.window:
            x = chunk.sampled(n)
            y = np.zeros(len(x), np.uint64)
        elif n == chunk.window:
            x, y = chunk.whole()
        else:  # the window and the one that follows it
            step = sizes[k - 1]
            at = np.searchsorted(place, place + step)
            of = np.flatnonzero(at < len(place))
            of = of[place[at[of]] == place[of] + step]
            of = of[chunk.left[place[of]] >= n]
            x, y, place = _mixed(x[of], x[at[of]], FACTORS[0]), _mixed(y[of], y[at[of]], FACTORS[1]) >> np.uint64(32), place[of]
        yield place, x, y
        if k + 1 < len(sizes):
            hit = _has(x, y, known, n)[0]
            place, x, y = place[hit], x[hit], y[hit]
            if n < chunk.window:
                chunk.alive = place


def _ids_texts(rows: pa.Table) -> tuple[np.ndarray, list[bytes | None]]:
    texts = rows.column(rows.num_columns - 1)
    unpacked = zstandard.ZstdDecompressor()
    return rows.column(rows.num_columns - 2).to_numpy(), [unpacked.decompress(t.as_buffer()) if t.is_valid else None for t in texts]


def _packed(rows: DataFrame) -> DataFrame:
    """The last column's texts compressed, as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = pa.array([pack.compress(t.as_buffer()) if t.is_valid else None for t in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], b.schema.names)

    small_batches(rows.sparkSession, 1000)
    return map_batches(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField(rows.columns[-1], T.BinaryType())]))


def _hashes(window: int, sizes: list[int]):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        chunk = Chunk(*_ids_texts(rows), window)
        *_, (place, x, y) = _levels(chunk, known, sizes)
        order = np.lexsort((y, x))
        x, y, ids = x[order], y[order], chunk.id[place[order]]
        head = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.empty(0, np.int64)
        low, high = (f.reduceat(ids, head) if len(x) else ids for f in (np.minimum, np.maximum))
        at = rows.column(rows.num_columns - 3)[0].as_py() if rows.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(len(head), at), pa.int32()), "x": x[head].view(np.int64), "y": y[head].view(np.int64), "low": low, "gap": low ^ high})

    return run


def _repeated(hashes: DataFrame, size: int, hits: bool) -> DataFrame:
    """The hashes that stand under two ids, in each chunk that has them (with hits: that has one that is not the smallest)."""
    by, high = Window.partitionBy("x", "y"), F.col("low").bitwiseXOR(F.col("gap"))
    rows = hashes.withColumn("first", F.min("low").over(by)).withColumn("last", F.max(high).over(by))
    if hits:  # where all of a chunk's ids are larger, it needn't know the smallest
        rows = rows.where(high > F.col("first")).withColumn("first", F.when(F.col("low") > F.col("first"), -1 << 63).otherwise(F.col("first")))
    else:
        rows = rows.where(F.col("last") > F.col("first"))
    return rows.select("chunk", F.lit(size).alias("size"), "x", "y", "first")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = 13, start: int = 7, longest: bool = True) -> DataFrame:
    """The columns in keep (default: all), _vx_n_words, _vx_spans (array of start, end: the maximal runs of words covered by a window that also starts in a document of a
    smaller id), _vx_kept (the other words, joined by a space) and _vx_longest (words of the longest level at which a window also starts in such a document, 0 if none).

    With longest the windows are doubled until no candidate survives, each level in a job of its own; without it the window is the last length, which decides the words, and one plan holds all levels.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    n_chunks = 1 + (docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0) // CHUNK
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    text = F.col(f"`{text_col}`").cast("string")
    dealt = F.pmod(F.xxhash64(doc, text, F.spark_partition_id()), F.lit(n_chunks)).cast("int")  # so equal rows part, too
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], dealt.alias("_vx_chunk"), doc.alias("_vx_id"), text.alias("_vx_text"))
    kept = rows.schema.fields[:-3]
    rows = _packed(rows)
    rows = numbered(write_table(rows, "texts") if longest else rows)
    by = rows.columns[-3]
    known, sizes = spark.createDataFrame([], _FOUND), lengths(window, start)
    level = 0
    while level < len(sizes):
        n = sizes[level]
        hashes = rows.groupBy(by).cogroup(known.groupBy("chunk")).applyInArrow(_hashes(window, sizes[: level + 1]), "chunk int, x long, y long, low long, gap long")
        found = _repeated(hashes, n, hits=not longest and n == window)
        found = found if longest or n == window else found.withColumn("first", F.lit(0).cast("long"))
        level += 1
        if longest:
            found = write_table(found, "level")
            if n >= window and not found.isEmpty():
                sizes.append(2 * n)
        known = known.unionByName(found)
    known = known.where(F.col("size") >= window) if not longest else known
    extra = [T.StructField("_vx_n_words", T.LongType()), T.StructField("_vx_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("_vx_kept", T.StringType()), T.StructField("_vx_longest", T.LongType())]
    out = T.StructType([*[T.StructField(f"_{i}", f.dataType) for i, f in enumerate(kept)], *extra])
    removed = rows.groupBy(by).cogroup(known.groupBy("chunk")).applyInArrow(_removed(window, sizes if longest else [window]), out)
    return removed.toDF(*[f.name for f in kept], *[f.name for f in extra])


def _removed(window: int, sizes: list[int]):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        chunk = Chunk(*_ids_texts(rows), window)
        gone, most = np.zeros(len(chunk.doc) + 1, np.int64), np.zeros(rows.num_rows, np.int64)
        for n, (place, x, y) in zip(sizes, _levels(chunk, known, sizes)):
            if n >= window:
                hit, first = _has(x, y, known, n)
                place = place[hit & (first < chunk.id[place])]
                most[chunk.doc[place]] = n
                if n == window:
                    np.add.at(gone, place, 1)
                    np.add.at(gone, place + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone, prepend=False) | np.append(True, chunk.doc[1:] != chunk.doc[:-1])) if len(gone) else np.empty(0, np.int64)
        end = np.append(edge[1:], len(gone))
        edge, end = edge[gone[edge]], end[gone[edge]]
        of = chunk.doc[edge]
        spans = pa.StructArray.from_arrays([pa.array(p - chunk.start[of]) for p in (edge, end)], ["start", "end"])
        at = np.append(0, np.cumsum(np.bincount(of, minlength=rows.num_rows)))
        kept, stop = [], [*chunk.start[1:].tolist(), len(gone)]
        for words, i, j, spanned in zip(chunk.words, chunk.start.tolist(), stop, np.diff(at).tolist()):
            kept.append(b" ".join([w for w, g in zip(words, gone[i:j].tolist()) if not g] if spanned else words))
        new = [pa.array([len(w) for w in chunk.words], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(most)]
        return pa.Table.from_arrays([*rows.columns[:-3], *new], names=[*rows.column_names[:-3], "_vx_n_words", "_vx_spans", "_vx_kept", "_vx_longest"])

    return run
