"""Static range asymmetric numeral system for token ids: the codec and the file format, without Spark.

One frequency table serves all blocks of a file. A block holds up to BLOCK ids dealt to LANES states in turn; blocks depend on
nothing but the table, so any of them is decoded alone, and numpy advances the states of all wanted blocks at once.

File: a head (sizes and CRC-32 of what follows), then, each deflated, the table (symbols as differences,
frequencies) and the documents' index (ids, null flags, lengths), then the checkpoints (per block: first word,
number of ids, CRC-32 of the ids as little-endian 32-bit integers, states), then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from voxframe.files import Held, Source

MAGIC, HEAD = b"VXTK0001", struct.Struct("<8sIIIQQQQQI")
LANES, STEPS = 32, 512
BLOCK = LANES * STEPS
#: Blocks that are coded and decoded at once; bounds the memory.
GROUP = 64
_LOW, _32 = np.uint64(1 << 31), np.uint64(32)


class CorruptFile(ValueError):
    """A checksum or a size doesn't hold."""


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in order, frequencies (1 at least) that add up to 2**bits, bits."""
    symbols, n = np.unique(ids, return_counts=True)
    bits = max(12, min(20, int(len(symbols) * 8).bit_length()))
    if len(symbols) > 1 << (bits - 1):
        bits = int(len(symbols) * 2).bit_length()
    f = np.maximum(1, n * (1 << bits) // max(1, n.sum()))
    rest = (1 << bits) - int(f.sum())
    if rest > 0 and len(f):
        f[f.argmax()] += rest
    while rest < 0:  # as many symbols were lifted to 1: the frequent ones pay, in proportion
        cut = np.minimum(f - 1, np.maximum(1, f * -rest // max(1, int(f[f > 1].sum()))) * (f > 1))
        order = np.argsort(-f, kind="stable")
        taken = np.minimum(np.cumsum(cut[order]), -rest)
        f[order] -= np.diff(taken, prepend=0)
        rest += int(taken[-1])
    return symbols.astype(np.uint32), f.astype(np.uint64), bits


def _places(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(symbols) or symbols[-1] >= 1 << 22:
        return np.searchsorted(symbols, ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int32)
    place[symbols] = np.arange(len(symbols))
    return place[ids]


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A whole file of documents; ids: those of all documents, in order."""
    ids = np.ascontiguousarray(ids, "<u4")
    symbols, f, bits = table(ids)
    low, n = np.cumsum(f) - f, len(ids)
    blocks = -(-n // BLOCK)
    coded = [_coded(_places(symbols, ids[at * BLOCK : (at + GROUP) * BLOCK]), f, low, np.uint64(bits)) for at in range(0, blocks, GROUP)]
    stream, n_words, x = (np.concatenate(c) if coded else np.empty(0, kind) for c, kind in zip(zip(*coded) if coded else ((), (), ()), ("<u4", np.int64, np.uint64)))
    counts = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    crc = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(blocks)]
    points = (np.cumsum(n_words) - n_words).astype("<u8").tobytes() + counts.astype("<u4").tobytes() + np.array(crc, "<u4").tobytes() + x.astype("<u8").tobytes()
    freq = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.asarray(lengths).astype("<u8").tobytes(), 6)
    body = freq + index + points
    return HEAD.pack(MAGIC, bits, len(symbols), blocks, n, len(doc_ids), len(freq), len(index), len(stream), zlib.crc32(body)) + body + stream.tobytes()


def _coded(places: np.ndarray, f: np.ndarray, low: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, number of words of each block, and states of a group of blocks, coded side by side."""
    n = len(places)
    blocks = -(-n // BLOCK)
    at = np.zeros(blocks * BLOCK, np.int64)
    at[:n] = places
    at = at.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, blocks * LANES)
    live = (np.arange(blocks * BLOCK) < n).reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, blocks * LANES)
    x = np.full(blocks * LANES, _LOW, np.uint64)
    words, sent = np.zeros((STEPS, blocks * LANES), "<u4"), np.zeros((STEPS, blocks * LANES), bool)
    for t in range(STEPS - 1, -1, -1):
        fs, on = f[at[t]], live[t]
        full = on & (x >= ((_LOW >> shift) << _32) * fs)
        words[t], sent[t] = x, full
        x = np.where(full, x >> _32, x)
        q = x // fs
        x = np.where(on, (q << shift) + (x - q * fs) + low[at[t]], x)
    by_block = sent.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)
    return words.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)[by_block], by_block.sum((1, 2)), x


class Reader:
    """A file: documents' ids and lengths, and the token ids of any range. It reads the head, table, index and checkpoints, then the words of the blocks that hold the range."""

    def __init__(self, source: bytes | Source):
        source = Held(source) if isinstance(source, bytes) else source
        try:
            magic, self.bits, n_symbols, self.blocks, self.n, docs, n_freq, n_index, n_words, crc = HEAD.unpack(source.read_at(0, HEAD.size))
        except struct.error as e:
            raise CorruptFile("the head is cut") from e
        n_points = self.blocks * (16 + 8 * LANES)
        size = n_freq + n_index + n_points
        if magic != MAGIC or source.size != HEAD.size + size + 4 * n_words or zlib.crc32(body := source.read_at(HEAD.size, size)) != crc:
            raise CorruptFile("the head or a size doesn't hold")
        raw = zlib.decompress(body[:n_freq])
        self.symbols = np.cumsum(np.frombuffer(raw, "<u4", n_symbols), dtype=np.uint32)
        self.f = np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.uint64)
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), self.f.astype(np.int64))
        raw = zlib.decompress(body[n_freq : n_freq + n_index])
        null = np.frombuffer(raw, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(raw, "<i8", docs), null)]
        self.lengths = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
        p, b = body[n_freq + n_index :], self.blocks
        self.first, self.counts = np.frombuffer(p, "<u8", b).astype(np.int64), np.frombuffer(p, "<u4", b, 8 * b).astype(np.int64)
        self.crc, self.states = np.frombuffer(p, "<u4", b, 12 * b), np.frombuffer(p, "<u8", b * LANES, 16 * b)
        self.source, self.at, self.n_words = source, HEAD.size + size, n_words

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; blocks outside are not touched, each block's checksum is verified."""
        stop = self.n if stop is None else stop
        if start >= stop:
            return np.empty(0, "<u4")
        lo, hi = start // BLOCK, -(-stop // BLOCK)
        ids = np.concatenate([self._blocks(at, min(hi, at + GROUP)) for at in range(lo, hi, GROUP)])
        for i in range(lo, hi):
            at = (i - lo) * BLOCK
            if zlib.crc32(ids[at : at + self.counts[i]].tobytes()) != self.crc[i]:
                raise CorruptFile(f"block {i}: the checksum doesn't hold")
        return ids[start - lo * BLOCK : stop - lo * BLOCK]

    def _blocks(self, lo: int, hi: int) -> np.ndarray:
        n, shift, mask = hi - lo, np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        low, x = np.cumsum(self.f) - self.f, self.states[lo * LANES : hi * LANES].astype(np.uint64)
        begin = int(self.first[lo])
        end = int(self.first[hi]) if hi < self.blocks else self.n_words
        words = np.frombuffer(self.source.read_at(self.at + 4 * begin, 4 * (end - begin)), "<u4")
        at, out = self.first[lo:hi] - begin, np.zeros((STEPS, n, LANES), "<u4")
        live = np.arange(BLOCK).reshape(STEPS, 1, LANES) < self.counts[None, lo:hi, None]
        for t in range(STEPS):
            on = live[t].reshape(-1)
            slot = x & mask
            s = self.slots[slot]
            out[t] = self.symbols[s].reshape(n, LANES)
            x = np.where(on, self.f[s] * (x >> shift) + slot - low[s], x)
            want = (on & (x < _LOW)).reshape(n, LANES)
            k = want.sum(1)
            if k.any():
                where = (at[:, None] + np.cumsum(want, 1) - 1)[want]
                if where.max() >= len(words):
                    raise CorruptFile("words are missing")
                flat = want.reshape(-1)
                x[flat] = (x[flat] << _32) | words[where].astype(np.uint64)
                at += k
        return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(-1)
