"""Token ids of a corpus in binary files, coded by a static range asymmetric numeral system (see rans.py).

Documents are range-partitioned and sorted by id; a task tokenizes its documents and writes files of about FILE_IDS
ids in order. Files are named by their place, written whole and renamed, so a repeated task writes them again. The list of files with
the number of ids before each is a table; only its count reaches the driver. A range of ids is read from the blocks that hold it, by checkpoint.

A tokenizer of the known kind (CHUNKED) drops white space and nothing it does crosses it, so a text is split at ASCII white space and each distinct
chunk is encoded by the tokenizers library once while it stays in a bounded cache; the ids are those of the whole text. Any other tokenizer encodes whole texts.

Defined cases: null and empty texts are documents of the end id only; a null id comes first; rows with equal ids are
documents one after another, in order of text; an empty table writes no file and reads back as an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe import files
from voxframe.llm import rans
from voxframe.workspace import small_batches, write_table

#: Ids in a file about, chunks in the cache at most, bytes of text encoded at once.
FILE_IDS, CACHE, STEP = 4_000_000, 250_000, 3 << 20
#: Tasks that read files at most; each takes its share.
READERS = 100_000
#: Stands between chunks that the library encodes together; a space goes where an ASCII or Latin-1 letter meets ASCII punctuation.
SEPARATOR = "\x01"
#: Texts with a special token or a combining mark are left as they are.
AS_IS = r"<\||[\x{0300}-\x{036F}]"
BEFORE_PUNCTUATION = r"([a-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
# The normalizer and pre-tokenizer of tokenizers that may be given chunks.
CHUNKED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class Encoder:
    """Ids of texts by the tokenizers library, with a cache of chunks between white space.

    Chunks are ASCII lower case and end where a letter meets punctuation, as the tokenizer lower-cases and splits there
    too; texts that may hold a special token ("<|") are left as they are, and so are those with combining marks, which the
    tokenizer composes before it lower-cases. When the cache is full, chunks used once go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.chunked = (made["normalizer"], made["pre_tokenizer"]) == CHUNKED and all(t["content"].startswith("<|") for t in made["added_tokens"])
        sep = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = sep[0] if len(sep) == 1 else None
        self.at: dict[str, int] = {}
        self.first, self.size, self.uses, self.ids, self.used = *(np.zeros(CACHE, np.int64) for _ in range(3)), np.zeros(1 << 20, np.uint32), 0

    def _forget(self) -> None:
        """Keeps what was used more than once, half of the cache at most, the most used first."""
        keep = np.flatnonzero(self.uses[: len(self.at)] > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")][: CACHE // 2])
        chunks = list(self.at)
        size = self.size[keep]
        ids = self.ids[_ranges(self.first[keep], size)]
        self.at = {chunks[k]: i for i, k in enumerate(keep.tolist())}
        self.size[: len(keep)], self.first[: len(keep)] = size, np.cumsum(size) - size
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.uses[:] = 0

    def _library(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Groups of the chunks with their ids and numbers of ids; most are encoded as one text with separators between them."""
        plain, rest = [], []
        for c in chunks:
            (rest if self.separator is None or SEPARATOR in c or "<|" in c else plain).append(c)
        for at in range(0, len(plain), 300):
            own = plain[at : at + 300]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator)
            yield own, np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        if rest:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            yield rest, np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids])

    def _learn(self, chunks: list[str]) -> None:
        for own, flat, size in self._library(chunks):
            n = len(self.at)
            if n + len(own) > len(self.first):
                self.first, self.size, self.uses = (np.concatenate([x, np.zeros(max(len(own), len(x) // 2), np.int64)]) for x in (self.first, self.size, self.uses))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.first[n : n + len(own)], self.size[n : n + len(own)] = self.used + np.cumsum(size) - size, size
            self.used += len(flat)
            self.at.update(zip(own, range(n, n + len(own))))

    def encode(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end after it, and their numbers. Arrow splits the texts and finds the distinct chunks."""
        if not self.chunked:
            whole = [e.ids + [end] * (end is not None) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for ids in whole for x in ids], np.uint32), np.array([len(ids) for ids in whole], np.int64)
        special = pc.match_substring_regex(texts, AS_IS)
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), BEFORE_PUNCTUATION, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, lower))
        words = lists.flatten().dictionary_encode()
        chunks, of = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        if new := [c for c in chunks if c not in self.at]:
            if len(self.at) + len(new) > CACHE:
                self._forget()
                new = [c for c in chunks if c not in self.at]
            self._learn(new)
        places = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        self.uses[places] += np.bincount(of, minlength=len(chunks))
        at = places[of]
        size = self.size[at]
        ids = self.ids[_ranges(self.first[at], size)]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()] if len(texts) else np.empty(0, np.int64)
        counts = np.diff(ends, prepend=0)
        return (ids, counts) if end is None else (np.insert(ids, ends, end), counts + 1)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of first[1] and so on."""
    before = np.cumsum(size)
    return np.repeat(first - before + size, size) + np.arange(before[-1] if len(before) else 0)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the corpus below folder; a table of its files in order: file, before (ids before it), n (ids)."""
    spark = docs.sparkSession
    small_batches(spark, 1500)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = encoder_of(tokenizer), TaskContext.get().partitionId(), []
        ids, docs_held, lengths, held = [], [], [], 0

        def flush() -> None:
            nonlocal ids, docs_held, lengths, held
            name = f"{folder}/part-{part:06d}-{len(made):06d}.vxtk"
            files.write_whole(name, [rans.encode(np.concatenate(ids), docs_held, np.concatenate(lengths))])
            made.append((part, len(made), name, held))
            ids, docs_held, lengths, held = [], [], [], 0

        for b in batches:
            step = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) // STEP
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                new, counts = encoder.encode(b.column(1)[at:to], end)
                ids.append(new)
                lengths.append(counts)
                docs_held += b.column(0)[at:to].to_pylist()
                held += len(new)
                if held >= file_ids:
                    flush()
        if docs_held:
            flush()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * 4, kinds)], ["part", "k", "file", "n"])

    made = write_table(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "part int, k int, file string, n long"), "files")
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(so_far.orderBy("part")), F.lit(0)).alias("first"))  # a row a partition
    inside = F.coalesce(F.sum("n").over(so_far.partitionBy("part").orderBy("k")), F.lit(0))
    return write_table(made.withColumn("inside", inside).join(parts, "part").select("file", (F.col("first") + F.col("inside")).alias("before"), "n"), "starts")


def read(spark: SparkSession, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before, n in zip(*(c.to_pylist() for c in b.columns)):
                r = rans.Reader(files.Source(file))
                if r.n != n:
                    raise rans.CorruptFile(f"{file}: {r.n} ids, not {n}")
                ids, ends = r.decode(), np.cumsum(r.lengths)
                for at in range(0, len(ends), 1000):
                    own = [ids[e - m : e].tobytes() for e, m in zip(ends[at : at + 1000], r.lengths[at : at + 1000])]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at : at + 1000], pa.int64()), pa.array(before + ends[at : at + 1000] - r.lengths[at : at + 1000]), pa.array(r.lengths[at : at + 1000]), pa.array([zlib.crc32(x) for x in own], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(READERS, written.count()))
    return written.select("file", "before", "n").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(written: DataFrame, start: int, n: int) -> np.ndarray:
    """The n ids from start on, from the blocks of the files that hold them."""
    out = []
    for file, before, k in written.where((F.col("before") < start + n) & (F.col("before") + F.col("n") > start)).orderBy("before").select("file", "before", "n").collect():  # the files of the range
        out.append(rans.Reader(files.Source(file)).decode(max(0, start - before), min(k, start + n - before)))
    return np.concatenate(out) if out else np.empty(0, "<u4")
