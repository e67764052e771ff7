"""Benchmark decontamination with suffix arrays of the training text.

A task takes its documents in shards. A shard's words become numbers of its own, and all its suffixes are ranked by growing prefixes (1, 2, 4 ... words; a rank is the
place of a pair of shorter ranks among the sorted pairs) up to the window, and sorted: the shard's suffix array. It is built once. Every suffix of the test set is
ranked by binary search at each length, as long as it is found, and all places of its window are read off the array; places that follow one another
on the same diagonal are joined to the longest verbatim matches. To a search for windows an order by more words makes no difference.

The test set is never in the driver: tasks number its words and write it, in blocks of bounded bytes, as files in the shared folder, and hand back their paths and
the lengths of their windows. The documents are read once, whatever the size of the test set; a task searches its shard for one block after the other and holds one at a time.

Defined cases: null and empty texts have no words and no match; items without words match nothing; items of fewer words than the
window are one window; a window that an item repeats counts where it begins first, so a match over such a window comes in pieces; repeated items are found once by id, a null id reads "null"; repeated documents are each searched; an empty table on either side
gives no matches; long texts are numbered in pieces; columns kept are passed through, whatever their names are, but for _vx_matches and _vx_n_words.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe import files
from voxframe.llm.batches import map_batches
from voxframe.workspace import new_path, small_batches, write_table

#: Bytes of a shard's text before it is searched; bytes of a text that are split into words at once.
SHARD, PIECE = 8 << 20, 1 << 20
_WORD_CHARS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower case, and a space for whatever is no part of a word.
_MAP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_CHARS else 0x20 for c in range(256))
MATCHES = "array<struct<item:string,item_pos:int,doc_pos:int,n_words:int>>"
_MATCH = pa.list_(pa.struct([("item", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())]))


def words_of(text: str | bytes | None) -> Iterator[list[bytes]]:
    """Runs of 0-9, a-z (A-Z lower-cased) and what is not ASCII, in lists of bounded size."""
    data = ((text or "").encode() if not isinstance(text, bytes) else text).translate(_MAP)
    at = 0
    while len(data) - at > PIECE:
        cut = data.rfind(b" ", at, at + PIECE)
        cut = data.find(b" ", at + PIECE) if cut < 0 else cut
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut + 1
    yield (data[at:] if at else data).split()


def numbers(text: str | bytes | None, vocabulary: defaultdict) -> np.ndarray:
    return np.concatenate([np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in words_of(text)])


def vocabulary() -> defaultdict:
    """Numbers from 1 on, given as words are met."""
    return defaultdict(count(1).__next__)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a 0 after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    end = np.zeros(1, np.int64)
    return np.concatenate([x for t in texts for x in (t, end)] or [end]), np.cumsum(sizes) - sizes


class Block:
    """A block of the test set: its words, the items' words as numbers (0 after each item) and their windows."""

    def __init__(self, ids: list[str], words: list[bytes], of: np.ndarray, size: np.ndarray, window: int):
        """of: the items' words as numbers from 1 on, a 0 after each item; size: how many words each item has."""
        self.ids, self.words, self.numbers, self.size = ids, words, of.astype(np.int64), size.astype(np.int64)
        self.item = np.repeat(np.arange(len(size)), self.size + 1)
        start = np.cumsum(self.size + 1) - self.size - 1
        self.place = np.arange(len(self.numbers)) - start[self.item]
        n = np.minimum(self.size, window)[self.item]
        self.window = np.where((n > 0) & (self.place + n <= self.size[self.item]), n, 0)  # words of the window that begins here, or 0
        self.lengths = sorted(set(self.window[self.window > 0].tolist()))

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Block:
        known, items = vocabulary(), list(dict.fromkeys(items))
        texts = [numbers(text, known) for _, text in items]
        size = np.array([len(t) for t in texts], np.int64)
        return cls([i for i, _ in items], list(known), _joined(texts)[0][: (size + 1).sum()], size, window)

    def packed(self) -> bytes:
        """What the rest is worked out from."""
        words, ids = (pa.array(x, t) for x, t in ((self.words, pa.binary()), (self.ids, pa.string())))
        arrays = [words, ids, pa.array(self.size.astype(np.int32)), pa.array(self.numbers.astype(np.int32))]
        row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays], ["words", "ids", "size", "numbers"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, row.schema) as out:
            out.write_batch(row)
        return zstandard.compress(sink.getvalue())

    @classmethod
    def unpacked(cls, data: bytes, window: int) -> Block:
        row = pa.ipc.open_stream(zstandard.decompress(data)).read_next_batch()
        words, ids, size, of = (c.values for c in row.columns)
        return cls(ids.to_pylist(), words.to_pylist(), of.to_numpy(), size.to_numpy(), window)


class SuffixArray:
    """The suffixes of a shard's documents, sorted by their first words."""

    def __init__(self, docs: list[np.ndarray], known: dict[bytes, int], lengths: list[int]):
        self.known, (self.numbers, self.start) = known, _joined(docs)
        self.levels: list[tuple[int, np.ndarray]] = []  # length ranked so far, sorted pairs of ranks
        self.sorted: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # by length: how far apart the pairs are, sorted pairs, places
        rank, size, most = self.numbers, 1, max(lengths, default=0)
        while True:
            for n in lengths:
                if size <= n < 2 * size:
                    key, at = self._pairs(rank, n - size)
                    order = np.argsort(key, kind="stable")
                    self.sorted[n] = n - size, key[order], at[order]
            if 2 * size > most:
                return
            key, at = self._pairs(rank, size)
            keys, of = np.unique(key, return_inverse=True)
            rank = np.zeros(len(rank), np.int64)
            rank[at] = of + 1
            self.levels.append((size, keys))
            size *= 2

    @staticmethod
    def _pairs(rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place's rank and that of the place step on, as one number, and the places that have both."""
        n = len(rank) - step
        at = np.flatnonzero((rank[:n] > 0) & (rank[step:] > 0)) if n > 0 else np.empty(0, np.int64)
        return rank[at] << 32 | rank[at + step], at

    def search(self, block: Block) -> tuple[np.ndarray, ...]:
        """Longest matches with a block: document, item's place in the block, first word in the item, first word in the document, words."""
        own = np.fromiter(map(self.known.get, block.words, repeat(0)), np.int64, len(block.words))
        rank = np.where(block.numbers > 0, np.append(own, 0)[block.numbers - 1], 0)
        test, place, size = [], [], []
        for level in range(len(self.levels) + 1):
            for n, (step, keys, places) in self.sorted.items():
                if n.bit_length() - 1 == level:
                    key, at = self._pairs(rank, step)
                    at, key = at[m := block.window[at] == n], key[m]
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    at, lo, hi = at[m := hi > lo], lo[m], hi[m]
                    # an item's equal windows find the same places: the first stands for them
                    _, first = np.unique(np.stack([lo, block.item[at]]), axis=1, return_index=True)
                    at, lo, k = at[first], lo[first], (hi - lo)[first]
                    test.append(np.repeat(at, k))
                    place.append(places[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())])
                    size.append(np.full(k.sum(), n))
            if level < len(self.levels):
                step, keys = self.levels[level]
                key, at = self._pairs(rank, step)
                of = np.searchsorted(keys, key)
                hit = np.flatnonzero(of < len(keys))
                hit = hit[keys[of[hit]] == key[hit]]
                rank = np.zeros(len(rank), np.int64)
                rank[at[hit]] = of[hit] + 1
        test, place, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (test, place, size))
        item, word = block.item[test], block.place[test]
        order = np.lexsort((place, item))
        item, word, place, size = item[order], word[order], place[order], size[order]
        new = np.ones(len(item), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(place) != 1) | (np.diff(word) != 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(item)) - 1 if len(item) else head
        doc = np.searchsorted(self.start, place[head], "right") - 1
        order = np.argsort(doc, kind="stable")
        head, last, doc = head[order], last[order], doc[order]
        return doc, item[head], word[head], place[head] - self.start[doc], place[last] + size[last] - place[head]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """path, lengths (words of its windows): the test set in files of about block_bytes of text each, written by tasks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 40)).first()[0] or 0
    folder = new_path(spark, "blocks")

    def written(items: list[tuple[str, str | None]]) -> tuple[str, list[int]]:
        block = Block.of(items, window)
        path = f"{folder}/{uuid.uuid4().hex}"
        files.write_whole(path, [block.packed()])
        return path, block.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, []
        for b in batches:
            for item, text in zip(b.column(0), b.column(1)):
                held.append((item.as_py(), text.as_py()))
                n += len(held[-1][1] or "") + 40
                if n >= block_bytes:
                    made.append(written(held))
                    held, n = [], 0
        if held:
            made.append(written(held))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([x for _, x in made], pa.list_(pa.int32()))], ["path", "lengths"])

    dealt = items.distinct().repartition(max(1, -(-size // block_bytes)))
    return write_table(dealt.mapInArrow(run, "path string, lengths array<int>"), "blocks_made")


def locate(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The columns in keep (default: all), _vx_n_words and _vx_matches (longest verbatim matches: item, first word in the item, first word in the document, words)."""
    small_batches(docs.sparkSession, 1000)
    keep = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    out = T.StructType([*docs.select(*kept).schema.fields, T.StructField("_vx_n_words", T.IntegerType()), T.StructField("_vx_matches", T.DataType.fromDDL(MATCHES))])
    made = blocks_of(benchmark, item_col, item_text, window, block_bytes)
    lengths = sorted(r[0] for r in made.select(F.explode("lengths")).distinct().collect())  # window of them at most
    paths = [r.path for r in made.where(F.size("lengths") > 0).select("path").orderBy("path").toLocalIterator()]  # a path for each block_bytes of the test set
    return map_batches(docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("_vx_text")), _searcher(paths, lengths, window), out)


def _searcher(paths: list[str], lengths: list[int], window: int):
    only: list[Block] = []  # a single block is read once a task

    def opened() -> Iterator[Block]:
        if only:
            yield from only
            return
        for path in paths:
            block = Block.unpacked(files.read_whole(path), window)
            if len(paths) == 1:
                only.append(block)
            yield block

    def flush(held: list[pa.RecordBatch], docs: list[np.ndarray], known: dict) -> Iterator[pa.RecordBatch]:
        array, found = SuffixArray(docs, known, lengths), []
        for block in opened():
            doc, item, *rest = array.search(block)
            found.append((doc, pa.array(block.ids, pa.string()).take(pa.array(item)), *rest))
        found = found or [(np.empty(0, np.int64), pa.array([], pa.string()), *(np.empty(0, np.int64),) * 3)]
        doc = np.concatenate([f[0] for f in found])
        order = np.argsort(doc, kind="stable")
        parts = [pa.concat_arrays([f[1] for f in found]).take(pa.array(order)), *(pa.array(np.concatenate([f[k] for f in found])[order], pa.int32()) for k in (2, 3, 4))]
        ends = np.cumsum(np.bincount(doc, minlength=len(docs)))
        new = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays(parts, ["item", "item_pos", "doc_pos", "n_words"])).cast(_MATCH)
        at = 0
        for b in held:
            n_words = pa.array([len(w) for w in docs[at : at + b.num_rows]], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n_words, new.slice(at, b.num_rows)], [*b.schema.names[:-1], "_vx_n_words", "_vx_matches"])
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size, known = [], [], 0, vocabulary()
        for b in batches:
            docs += [numbers(t.as_buffer().to_pybytes() if t.is_valid else None, known) for t in b.column(b.num_columns - 1)]
            held.append(b)
            size += b.nbytes
            if size >= SHARD:
                yield from flush(held, docs, known)
                held, docs, size, known = [], [], 0, vocabulary()
        if held:
            yield from flush(held, docs, known)

    return run


def digest(located: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from what locate returns."""
    m = F.col("_vx_matches")
    hit = F.array_distinct(F.flatten(F.transform(m, lambda x: F.sequence(x["doc_pos"], x["doc_pos"] + x["n_words"] - 1))))
    items = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["item"])))
    n_hit = F.when(F.size(m) > 0, F.size(hit)).otherwise(0).cast("long")
    return located.select(F.col(id_col), F.col("_vx_n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(m) > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any match, with their columns."""
    return locate(docs, benchmark, **options).where(F.size("_vx_matches") == 0).drop("_vx_matches", "_vx_n_words")
