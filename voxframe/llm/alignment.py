"""Alignment of two tokenizers' tokens over the same bytes.

Each document is encoded by A and B; a token covers a range of bytes. Over the sorted ends of B's tokens, which never change, every token of A is a stabbing query by bisection:
its first and its last overlapping token of B, and so all links between them. A byte offset that no token of either side spans is a group boundary. All documents of a
batch are searched at once, as their ranges follow one another.

Counts of linked id pairs are worked out for chunks of documents of bounded size, so a pair is one row a chunk, however often it occurs there; the
chunk's pairs come back with the corpus-wide counts, and its documents are scored beside them.

Neither tokenizer of the known kinds (a byte-level one that splits at white space, a piece model without rules for normalizing) joins anything over a space between visible
characters, so a text is cut there and each distinct unit is encoded once while it stays in a bounded cache; the ids are those of the whole text. Other tokenizers encode whole texts.

Defined cases: null and empty texts, and texts that either side doesn't give back byte for byte, have no tokens; equal texts and repeated rows each count; an
empty table gives an empty table; a text without spaces is one unit; columns kept are passed through, whatever their names are, but for those that begin with _vx_.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.batches import map_batches, numbered
from voxframe.workspace import small_batches, write_table

#: Bytes of text in a chunk; units in the cache at most; tokens that are linked at once.
CHUNK, CACHE, STEP = 8 << 20, 600_000, 1 << 19
#: A space between visible characters; those beyond Latin letters are left whole.
CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
# The bytes that byte-level vocabularies write as themselves; the others are written as the code points from 256 on, in order.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class ByteLevel:
    """A tokenizer file whose vocabulary entries stand for bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        #: Whether it splits at white space, so that units can be encoded one by one.
        self.cuts = made["normalizer"] is None and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        hidden = [b for b in range(256) if b not in VISIBLE]
        byte = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes = [b""] * self.tokenizer.get_vocab_size(True)
        for piece, i in self.tokenizer.get_vocab(True).items():
            self.bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A piece model, which itself puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize("ﬁ  á ") == "▁ﬁ▁▁á▁"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, with a cache of units: each has a number, by which arrays know its ids."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        self.cuts = all(side.cuts for side in self.sides)
        self.kind = "<u2" if max(map(len, self.lengths)) <= 1 << 16 else "<u4"
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.good = np.empty(0, bool)  # whether a unit comes back from both sides
        self.stop = [np.zeros(1, np.int64) for _ in self.sides]
        self.ids = [np.empty(0, self.kind) for _ in self.sides]

    def _learn(self, units: list[str]) -> None:
        good, stops, kept = [self.good], [[x] for x in self.stop], [[x] for x in self.ids]
        for at in range(0, len(units), 10_000):
            own = units[at : at + 10_000]
            data = [b" " + u.encode() for u in own]
            same = np.ones(len(own), bool)
            for side, length, stop, all_ids in zip(self.sides, self.lengths, stops, kept):
                ids = side.encode(own)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
                stop.append(stop[-1][-1] + np.cumsum(size))
                all_ids.append(flat.astype(self.kind))
                back = b"".join([side.bytes[i] for i in flat.tolist()])
                n = np.diff(np.append(0, np.cumsum(length[flat]))[np.append(0, np.cumsum(size))])
                if back != b"".join(data) or n.tolist() != list(map(len, data)):
                    same &= [b"".join([side.bytes[i] for i in x]) == d for x, d in zip(ids, data)]
            good.append(same)
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.good = np.concatenate(good)
        self.stop, self.ids = ([np.concatenate(x) for x in y] for y in (stops, kept))

    def encode(self, texts: list[str | None]) -> list[pa.Array]:
        """Ids of A and of B in little-endian integers, 16 bits wide if they suffice; nothing for texts that don't come back."""
        units = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(units))
        new = dict.fromkeys([u for u in flat if u not in self.at])
        if new and len(new) + len(self.at) > CACHE:
            self._forget()
            new = dict.fromkeys(flat)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), [len(u) for u in units])
        found, bad = [], np.unique(of[~self.good[at]]).tolist()
        for stop, ids in zip(self.stop, self.ids):
            size = stop[at + 1] - stop[at]
            whole = ids[np.repeat(stop[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            found.append((whole, np.append(0, np.cumsum(np.bincount(of, size, len(texts)).astype(np.int64)))))
        # units that don't come back may yet do so together
        lost = {k for k in bad if any(b"".join([side.bytes[i] for i in ids[stop[k] : stop[k + 1]].tolist()]) != b" " + texts[k].encode() for side, (ids, stop) in zip(self.sides, found))}
        return [_binary(ids, stop, lost) for ids, stop in found]


def _binary(ids: np.ndarray, stop: np.ndarray, lost: set[int]) -> pa.Array:
    if lost:
        return pa.array([b"" if k in lost else ids[i:j].tobytes() for k, (i, j) in enumerate(zip(stop.tolist(), stop[1:].tolist()))], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(stop) - 1, [None, pa.py_buffer((stop * ids.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    """Loaded once a worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def tokenized(docs: DataFrame, a_path: str, b_path: str, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep (default: all), _vx_chunk, and the ids _vx_a and _vx_b as little-endian integers (Pair.kind), compressed; write it before it is used twice."""
    small_batches(docs.sparkSession, 500)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_vx_text"))
    fields = [T.StructField("_vx_chunk", T.LongType()), T.StructField("_vx_a", T.BinaryType()), T.StructField("_vx_b", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, seen, pack = _pair(a_path, b_path), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            chunk = (part << 32) + (seen + sizes) // CHUNK
            seen += int(sizes[-1]) if len(sizes) else 0
            new = [pa.array(chunk, pa.int64()), *(pa.array([pack.compress(x.as_buffer()) for x in ids], pa.binary()) for ids in pair.encode(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], *[f.name for f in fields]])

    return map_batches(rows, run, T.StructType([*rows.schema.fields[:-1], *fields]))


def linked(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of two rows of tokens over the same bytes, given the tokens' lengths: token of A, token of B; the last tokens of A and of B in each group."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, "right")
    last = np.searchsorted(b_end, a_end, "left")
    n = last - first + 1
    of_b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    cut = np.flatnonzero(b_end[last] == a_end)
    return np.repeat(np.arange(len(n)), n), of_b, cut, last[cut]


def _steps(kind: str, a: list[bytes], b: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in steps of bounded size: which, all ids of A, of B, and where each row's end."""
    wide, unpacked = int(kind[-1]), zstandard.ZstdDecompressor()
    a, b = ([unpacked.decompress(x) for x in side] for side in (a, b))
    size = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) // wide
    step = (np.cumsum(size) - size) // STEP
    for k in np.unique(step).tolist():
        at = np.flatnonzero(step == k)
        own = slice(int(at[0]), int(at[-1]) + 1)
        ids = [np.frombuffer(b"".join(x[own]), kind).astype(np.int64) for x in (a, b)]
        yield own, *ids, *(np.cumsum([len(r) // wide for r in x[own]]) for x in (a, b))


def _keys(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    links = linked(pair.lengths[0][a], pair.lengths[1][b])
    return a[links[0]] << 32 | b[links[1]], links


def pair_counts(tokens: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Tables _vx_chunk, a, b, n of each chunk's links, and a, b, n, best of all: best if no other a has more links with that b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = _pair(a_path, b_path), {}

        def flush(chunk: int) -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held[chunk]])
            key, of = np.unique(keys, return_inverse=True)
            n = np.bincount(of, np.concatenate([n for _, n in held.pop(chunk)])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk)), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["_vx_chunk", "a", "b", "n"])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk).tolist():
                for done in [x for x in held if x != c]:
                    yield flush(done)
                at = pa.array(np.flatnonzero(chunk == c))
                for _, a, b, *_ in _steps(pair.kind, *(batch.column(k).take(at).to_pylist() for k in (1, 2))):
                    held.setdefault(c, []).append(np.unique(_keys(pair, a, b)[0], return_counts=True))
        for c in list(held):
            yield flush(c)

    chunks = write_table(tokens.select("_vx_chunk", "_vx_a", "_vx_b").mapInArrow(run, "_vx_chunk long, a long, b long, n long"), "chunk_pairs")
    n = chunks.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return chunks, n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # a b meets as many ids as A has at most


_OUT = [("_vx_n_a", T.LongType()), ("_vx_n_b", T.LongType()), ("_vx_n_groups", T.LongType()), ("_vx_n_links", T.LongType()), ("_vx_n_best", T.LongType()), ("_vx_count_sum", T.LongType()), ("_vx_groups", T.StringType())]


def align(docs: DataFrame, a_path: str, b_path: str, *, keep: list[str] | None = None, text_col: str = "text", digest: bool = False) -> DataFrame:
    """The columns in keep (default: all) and _vx_n_a, _vx_n_b, _vx_n_groups, _vx_n_links, _vx_n_best, _vx_count_sum, _vx_groups.

    _vx_groups is a1,a2|b1;a3|b2,b3: the ids of each group in order, or with digest its SHA-256 in hex; '' without tokens. A link's count is how many links of all documents hold its
    ids; _vx_n_best counts the links of which no other has a larger count for the same id of B, _vx_count_sum adds the counts.
    """
    tokens = write_table(tokenized(docs, a_path, b_path, keep=keep, text_col=text_col), "tokens")
    chunks, counts = pair_counts(tokens, a_path, b_path)
    known = chunks.select("_vx_chunk", "a", "b").join(counts, ["a", "b"]).select(F.col("_vx_chunk").alias("chunk"), "a", "b", "n", "best")
    names = tokens.columns
    out = T.StructType([*tokens.schema.fields[:-3], *[T.StructField(*f) for f in _OUT]])

    def score(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        pair = _pair(a_path, b_path)
        key = pairs.column("a").to_numpy() << 32 | pairs.column("b").to_numpy()
        order = np.argsort(key, kind="stable")
        key, n, best = key[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order]
        a, b = (rows.column(rows.num_columns - k).to_pylist() for k in (2, 1))
        found = [_scored(pair, key, n, best, digest, *step[1:]) for step in _steps(pair.kind, a, b)]
        new = [pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(6)] + [pa.array([g for f in found for g in f[6]], pa.string())]
        return pa.Table.from_arrays([*rows.columns[:-3], *new], names=[*rows.column_names[:-3], *[f[0] for f in _OUT]])

    by = f"_{len(names) - 3}"
    plain = T.StructType([T.StructField(f"_{i}" if i < len(names) - 3 else f.name, f.dataType) for i, f in enumerate(out)])
    scored = numbered(tokens).groupBy(by).cogroup(known.groupBy("chunk")).applyInArrow(score, plain)
    return scored.toDF(*[f.name for f in out])


def _texts(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A and of B in decimal, followed by a comma, or (second half) by what ends a group's side."""
    if not hasattr(pair, "decimals"):
        pair.decimals = tuple(np.array([f"{i}{end}" for end in (",", last) for i in range(len(lengths))], object) for lengths, last in zip(pair.lengths, "|;"))
    return pair.decimals


def _scored(pair: Pair, key: np.ndarray, n: np.ndarray, best: np.ndarray, digest: bool, a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple:
    keys, (of_a, _, a_cut, b_cut) = _keys(pair, a, b)
    at = np.searchsorted(key, keys)
    ends = np.searchsorted(of_a, a_stop)  # links of the documents up to each
    groups = np.searchsorted(a_cut, a_stop)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)

    last = [np.zeros(len(x), np.int64) for x in (a, b)]
    last[0][a_cut], last[1][b_cut] = 1, 1
    # a token of A stands after the tokens of B of former groups, one of B after the tokens of A up to its group
    place = [np.arange(len(a)) + np.append(0, b_cut + 1)[np.cumsum(last[0]) - last[0]], np.arange(len(b)) + np.append(a_cut + 1, len(a))[np.cumsum(last[1]) - last[1]]]
    text = np.empty(len(a) + len(b), object)
    for ids, ending, where, decimal in zip((a, b), last, place, _texts(pair)):
        text[where] = decimal[ids + ending * (len(decimal) // 2)]
    text, stop = text.tolist(), (a_stop + b_stop).tolist()
    whole = ["".join(text[i:j])[:-1] for i, j in zip([0, *stop], stop)]
    if digest:
        from hashlib import sha256

        whole = [sha256(w.encode()).hexdigest() if w else "" for w in whole]
    return np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0), np.diff(groups, prepend=0), np.diff(ends, prepend=0), summed(best[at]) if len(at) else ends, summed(n[at]) if len(at) else ends, whole
