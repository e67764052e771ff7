"""Exact substring dedup by distributed prefix doubling.

A position is where a string of `length` bytes starts; it repeats if its string also starts earlier. Positions carry ranks of growing
prefixes: equal strings have equal ranks. In each round a position's rank is paired with the rank of the place as far on as the prefix grows,
Spark sorts the pairs, positions alone with their pair are unique and drop out, and the pair is the rank of the next round, until
the prefixes reach `length`.

Neighbours advance together while their strings share bytes. A unit is a range of up to w positions; all their strings hold the same core of
length - w + 1 bytes, and it's the core that has the rank.

1. Round 0 ranks the grams of GRAM bytes. Of any `length` consecutive bytes the gram with the least hash (the anchor) stands for
   the positions that chose it, so a unit has up to length - GRAM + 1 of them; equal strings choose equal anchors. Units whose anchor occurs
   once drop out. Of units that agree in all bytes that they cover, all but the first repeat at all positions.
2. The first ones of units that share their anchor with an unlike unit go on, with the bytes that they cover. Each round splits a unit, at places counted from the
   anchor, into units whose cores are up to twice as long (growth()), ranks a core by the pair (rank of its first bytes, rank of its last bytes, at the
   offset by which it grows; both ranks are of the round before), sorts the pairs and drops what is alone.
3. In the last round a unit is one position and the core its string: all but the first of equal pairs repeat.

Ranks are names of 128 bits in place of places in the sort, so that both ranks of a pair are had from the bytes at hand without a join: a gram's rank is
a hash of its words, and a longer core's rank names the pair of ranks of the round before, and nothing else (ranks()). Unlike cores are taken as equal only if 128
bits agree by chance; covers are compared by XXH3's 128 bits. The hash that chooses anchors only deals units; a collision there costs time, not truth.

A task first settles what repeats, or is sure to go on, inside its batch and under keys that it has met: a large group of copies, or a passage in many
unlike texts, sends a few rows a task, not a row a copy, to where its rank is sorted, and the others are dealt by their place. Sorts spill; a rank's rows stream through the scan, none are collected.

Defined cases: null and empty texts have no bytes; texts under `length` bytes keep all; rows with equal ids and equal texts are
one document and report the same; rows with equal ids and unlike texts are documents in the order of a hash of the text; null ids come first; an
empty table gives an empty table; other columns are not read. Long texts are hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.workspace import small_batches, write_table

#: Bytes of a gram; bytes hashed at once; rows of a sorted stream scanned at once; keys that a task remembers.
GRAM, PIECE, SCAN, HELD = 36, 1 << 18, 100_000, 20_000
#: Unlike units of a batch that share an anchor and are sent to its place.
CROWD = 8
#: A packed range of positions: start, number, how far the anchor is from the start, whether it is known to repeat; negative if it is known to share its anchor.
OPEN = np.int64(-(2**63))
START, COUNT, ANCHOR = np.int64(32), np.int64(12), np.int64(1)
LONGEST = 1 << 19
#: Units ranked at once: what fits a processor's cache.
BLOCK = 1 << 13
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(2).integers(0, 2**64, (2, 8), dtype=np.uint64) | np.uint64(1)


def packed(start: np.ndarray, count: np.ndarray, anchor: np.ndarray | int = 0, known: int = 0) -> np.ndarray:
    return start << START | count << COUNT | np.int64(anchor) << ANCHOR | np.int64(known)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number, distance of the anchor."""
    at = at & ~OPEN
    return at >> START, (at >> COUNT) & ((1 << 20) - 1), (at >> ANCHOR) & ((1 << 11) - 1)


class Grams:
    """Hashes of the grams of a buffer of up to `size` bytes: polynomials modulo 2**64, mixed."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**62)) * 2 + 1
        self.up, self.down = _powers(base, size + 1), _powers(pow(base, -1, 2**64), size + 1)

    def of(self, data: np.ndarray, n: int = GRAM) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return _mixed((sums[n:] - sums[:-n]) * self.down[: len(sums) - n])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_grams: dict[int, Grams] = {}


def _grams_of(size: int) -> Grams:
    if size not in _grams:
        _grams[size] = Grams(size)
    return _grams[size]


def growth(length: int) -> list[tuple[int, int]]:
    """Bytes of a core before and after each round: at most doubled, and near the end a unit goes to about a quarter of its positions."""
    out, core = [], GRAM
    while core < length:
        width = length - core + 1
        out.append((core, min(2 * core, length - width // 4 if width > 8 else length)))
        core = out[-1][1]
    return out


def windows_of(texts: list[bytes], length: int, piece: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of up to about 2 * piece bytes, with their parts: text, where the part starts in it, where in the buffer, number of positions."""
    held, parts, n = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), piece):
            own = t[at : at + piece + length - 1]
            held.append(own)
            parts.append((k, at, n, len(own) - length + 1))
            n += len(own)
            if n >= piece:
                yield b"".join(held), parts
                held, parts, n = [], [], 0
    if held:
        yield b"".join(held), parts


def ranges_of(texts: list[bytes], length: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """For each buffer: anchor's rank, name (two numbers) of what the unit covers, text, first position, number of positions, distance of the anchor."""
    size, width = 2 * piece + 2 * length, length - GRAM + 1
    grams, bits = _grams_of(size), np.uint64(size.bit_length())  # the same bits in all buffers, so ties go the same way
    for raw, parts in windows_of(texts, length, piece):
        g = grams.of(np.frombuffer(raw, np.uint8))
        least = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        inside, of = np.zeros(len(anchor), bool), np.zeros(len(anchor), np.int32)
        for k, (_, _, at, n) in enumerate(parts):
            inside[at : at + n], of[at : at + n] = True, k
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        edge = np.flatnonzero(new | ~inside)
        nxt = np.searchsorted(edge, first, "right")
        count = np.where(nxt < len(edge), edge[np.minimum(nxt, len(edge) - 1)], len(anchor)) - first
        p = np.array(parts, np.int64)[of[first]]
        view, name = memoryview(raw), xxhash.xxh3_128_digest
        cover = np.frombuffer(b"".join([name(view[i:j]) for i, j in zip(first.tolist(), (first + count - 1 + length).tolist())]), np.int64).reshape(-1, 2)
        yield g[anchor[first]].view(np.int64), cover[:, 0], cover[:, 1], p[:, 0], p[:, 1] + first - p[:, 2], count, anchor[first] - first


def _named(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A name of 128 bits for each row of 64-bit words: two sums with unlike odd factors, mixed."""
    one, two = (_mixed(sum(w * f for w, f in zip(words, fs))) for fs in _FACTORS)
    return one, two


def ranks(raw: bytes | pa.Buffer, at: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, in two halves, of the cores that begin at these bytes and have grown by steps: each names the pair of ranks, in the round before, of the core's first and last bytes."""
    if steps:
        return _named([*ranks(raw, at, steps[:-1]), *ranks(raw, at + steps[-1], steps[:-1])])
    words = np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,))
    return _named([_mixed(words[at + i] + f) for i, f in zip((*range(0, GRAM - 8, 8), GRAM - 8), _FACTORS[0])])


def units_of(at: np.ndarray, covers: pa.Array, length: int, core: int, longer: int) -> tuple[np.ndarray, ...]:
    """The units into which packed ranges split when their cores grow from core to longer bytes: the two halves of the core's rank, the range that
    the unit comes from, its packed range, and what it covers (in the last round nothing). covers: bytes of each range."""
    width = length - longer + 1
    start, count, far = unpacked(at)
    low, high = (far - count + 1) // width, far // width
    n = high - low + 1
    k = np.repeat(np.arange(len(n)), n)
    cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[k]
    anchor = (start + far)[k]
    begin = anchor - cell * width
    first, last = np.maximum(start[k], begin - width + 1), np.minimum((start + count - 1)[k], begin)
    offsets = np.frombuffer(covers.buffers()[1], np.int32, len(covers) + 1, 4 * covers.offset).astype(np.int64)
    raw, shift = covers.buffers()[2] or b"", (offsets[:-1] - start)[k]
    view, steps = memoryview(raw), [y - x for x, y in growth(length) if y <= longer]
    names = [ranks(raw, x, steps) for x in np.split(begin + shift, range(BLOCK, len(k), BLOCK))]
    # equal strings at unlike distances from their anchors are no equals
    one, two = ((np.concatenate(x) + cell.astype(np.uint64) * _ODD).view(np.int64) for x in zip(*names))
    held = [None] * len(k) if longer == length else [bytes(view[x:y]) for x, y in zip((first + shift).tolist(), (last + length + shift).tolist())]
    return one, two, k, packed(first, last - first + 1, anchor - first), pa.array(held, pa.binary())


def _place(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mixed(doc.astype(np.uint64) * _ODD + at.astype(np.uint64)).view(np.int64)


def _repeated(a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal (a, b, c) comes before a row in the batch, and whether any row is equal to it."""
    order = np.lexsort((start, doc, c, b, a))
    like = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    again, twin = np.zeros(len(a), bool), np.zeros(len(a), bool)
    again[order[1:]] = like
    twin[order[1:]] |= like
    twin[order[:-1]] |= like
    return again, twin


class _Met:
    """HELD keys at most that a task remembers, each with a place."""

    def __init__(self):
        self.at: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.first = np.empty(0, np.int64)

    def held(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[tuple[int, tuple[int, int, int]]]:
        """The rows whose key is remembered."""
        maybe = np.flatnonzero(np.isin(a, self.first)).tolist() if len(self.first) else []
        return [(i, key) for i in maybe if (key := (int(a[i]), int(b[i]), int(c[i]))) in self.at]

    def learn(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        if len(a) and len(self.at) < HELD:
            for x in zip(*(v[: HELD - len(self.at)].tolist() for v in (a, b, c, doc, start))):
                self.at.setdefault(x[:3], x[3:])
            self.first = np.unique(np.array([k[0] for k in self.at], np.int64))


def _crowded(met: _Met, a: np.ndarray) -> np.ndarray:
    """Rows of unlike units that need not come to their anchor's place: it is shared by many here, and two unlike units or more of this task are sent there."""
    order = np.argsort(a, kind="stable")
    new = np.ones(len(a), bool)
    new[1:] = a[order[1:]] != a[order[:-1]]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    many = np.bincount(group) > CROWD
    out, none = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    out[order] = many[group] & (np.arange(len(a)) - head[group] >= 2)
    out[[i for i, _ in met.held(a, none, none)]] = True
    own = a[order[head[many]]]
    met.learn(own, *(none[: len(own)],) * 4)
    return out


def _settle(met: _Met, a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, shared: _Met | None = None) -> tuple[np.ndarray, ...]:
    """Rows a, b, c, doc, at. What is known to repeat is joined to runs, marked, and dealt by place, not by rank; with shared, so is what is known to be open."""
    start, count, _ = unpacked(at)
    again, twin = _repeated(a, b, c, doc, start)
    for i, key in met.held(a, b, c):  # a later place of a key that was sent repeats
        place = (int(doc[i]), int(start[i]))
        if met.at[key] < place:
            again[i] = True
        else:
            met.at[key] = place
    new = np.flatnonzero(twin & ~again)
    met.learn(a[new], b[new], c[new], doc[new], start[new])
    keep, run = np.flatnonzero(~again), np.flatnonzero(again)
    if shared is not None:
        crowd = _crowded(shared, a[keep])
        place = np.where(crowd, _place(doc[keep], at[keep]), 0)
        own = [np.where(crowd, place, x[keep]) for x in (a, b, c)] + [doc[keep], np.where(crowd, at[keep] | OPEN, at[keep])]
    else:
        own = [x[keep] for x in (a, b, c, doc, at)]
    run = run[np.lexsort((start[run], doc[run]))]
    d, s, e = doc[run], start[run], start[run] + count[run]
    cut = np.ones(len(run), bool)
    cut[1:] = (d[1:] != d[:-1]) | (s[1:] != e[:-1]) | (s[1:] // LONGEST != s[:-1] // LONGEST)
    head = np.flatnonzero(cut)
    d, s, e = d[head], s[head], e[np.append(head[1:], len(run)) - 1] if len(run) else e
    place = _place(d, s)
    return tuple(np.append(x, y) for x, y in zip(own, (place, place, place if shared is not None else np.zeros_like(place), d, packed(s, e - s, 0, 1))))


_NAMES = ["a", "b", "c", "doc", "at"]
_ROWS = "a long, b long, c long, doc long, at long"
_UNITS = f"{_ROWS}, s binary"


def _batch(columns: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([c[i : i + 50_000] if isinstance(c, pa.Array) else pa.array(c[i : i + 50_000]) for c in columns], names)


def _anchors(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, shared = _Met(), _Met()
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), [t.as_buffer().to_pybytes() for t in batch.column(1)]
            found = list(ranges_of(texts, length, piece))
            if found:
                g, b, c, k, start, count, far = (np.concatenate(x) for x in zip(*found))
                yield from _batch(_settle(met, g, b, c, docs[k], packed(start, count, far), shared), _NAMES)

    return run


def _split(met: _Met, doc: np.ndarray, at: np.ndarray, covers: pa.Array, length: int, core: int, longer: int) -> Iterator[pa.RecordBatch]:
    """Rows of the units of ranges. Before the last round, units with an equal in the batch are marked as known to go on and all but one dealt by place."""
    a, b, k, at, s = units_of(at, covers, length, core, longer)
    c = np.zeros_like(a)
    doc = doc[k]
    if longer == length:
        rows = _settle(met, a, b, c, doc, at)
        yield from _batch((*rows, pa.nulls(len(rows[0]), pa.binary())), [*_NAMES, "s"])
        return
    again, twin = _repeated(a, b, c, doc, at)
    again[[i for i, _ in met.held(a, b, c)]] = True  # the task has sent one that is marked
    twin |= again
    new = np.flatnonzero(twin & ~again)
    met.learn(a[new], b[new], c[new], doc[new], at[new])
    place = _place(doc, at)
    yield from _batch((*(np.where(again, place, x) for x in (a, b)), c, doc, at | twin, s), [*_NAMES, "s"])


def _begin(length: int, core: int, longer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            doc, at, covers = [], [], []
            for d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = np.sort(np.array(wanted.as_py(), np.int64))
                start, count, _ = unpacked(own)
                view = memoryview(text.as_buffer())
                covers += [view[i:j] for i, j in zip(start.tolist(), (start + count - 1 + length).tolist())]
                doc.append(np.full(len(own), d))
                at.append(own)
            if doc:
                doc, at = np.concatenate(doc), np.concatenate(at)
                for i in range(0, len(doc), SCAN):
                    yield from _split(met, doc[i : i + SCAN], at[i : i + SCAN], pa.array([bytes(x) for x in covers[i : i + SCAN]], pa.binary()), length, core, longer)

    return run


def _next(length: int, core: int, longer: int):
    """Of units sorted by rank those that aren't alone, split for cores of `longer` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, waits, gone_on = _Met(), None, None  # the last row if it is alone so far, the last rank if it isn't
        for batch in batches:
            rows = pa.Table.from_batches([batch] if waits is None else [waits, batch]).combine_chunks().to_batches()[0] if batch.num_rows else None
            if rows is None:
                continue
            a, b, c, doc, at = (rows.column(i).to_numpy() for i in range(5))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            group = np.cumsum(new) - 1
            on = (np.bincount(group) > 1) | (np.bincount(group, at & 1) > 0)
            if gone_on == (a[0], b[0], c[0]):
                on[0] = True
            waits = None if on[-1] else rows.slice(len(a) - 1)
            gone_on = (a[-1], b[-1], c[-1]) if on[-1] else None
            keep = np.flatnonzero(on[group])
            for i in range(0, len(keep), SCAN):
                k = keep[i : i + SCAN]
                yield from _split(met, doc[k], at[k] >> 1 << 1, rows.column(5).take(pa.array(k)), length, core, longer)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, b, c, document and place: doc, at, open. All but the first of equal (a, b, c) repeat (open 0); the first of an (a, b, c) whose a
    has another is open (1), and so is what is known to be; what is left is unique and dropped. Keeps one row from batch to batch."""
    held, n, last, before = [], 0, None, None

    def flush(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n, last, before
        if held:
            a, b, c, doc, at = (np.concatenate(x) for x in zip(*held))
        else:
            a = b = c = doc = at = np.empty(0, np.int64)
        held, n = [], 0
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        if len(a) and last is not None:
            new[0] = (a[0], b[0], c[0]) != last
        last = (a[-1], b[-1], c[-1]) if len(a) else last
        known, apart = (at & 1) > 0, at < 0
        hit = (~new | known) & ~apart
        head = np.flatnonzero(new & ~known & ~apart)
        ha, hd, hp = a[head], doc[head], at[head]
        shared = np.zeros(len(head), bool)
        if before is not None:  # the last head of the batch before waits for its neighbour
            ha, hd, hp = np.append(before[0], ha), np.append(before[1], hd), np.append(before[2], hp)
            shared = np.append(before[3], shared)
        like = ha[1:] == ha[:-1]
        shared[1:] |= like
        shared[:-1] |= like
        before = None
        if len(ha) and not end:
            before = (ha[-1], hd[-1], hp[-1], shared[-1])
            hd, hp, shared = hd[:-1], hp[:-1], shared[:-1]
        yield from _batch((np.concatenate([doc[hit], hd[shared], doc[apart]]), np.concatenate([at[hit] >> 1 << 1, hp[shared], at[apart] & ~OPEN]), np.repeat(np.array([0, 1], np.int32), [hit.sum(), shared.sum() + apart.sum()])), ["doc", "at", "open"])

    for batch in batches:
        held.append([x.to_numpy() for x in batch.columns])
        n += batch.num_rows
        if n >= SCAN:
            yield from flush(False)
    yield from flush(True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """_k, doc_id, text, and whether a _k may repeat: _k orders documents like their ids and is one for rows with equal ids and texts. It is the id itself unless ids repeat or are null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("_k"), "doc_id", "text").where("_k is not null"), False
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc_id", F.xxhash64("text").alias("h")).distinct().repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    keys = write_table(keys.select(F.monotonically_increasing_id().alias("_k"), F.col("doc_id").alias("k_id"), "h"), "keys")
    rows = rows.withColumn("_h", F.xxhash64("text"))
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_h") == F.col("h"))).select("_k", "doc_id", "text").where("_k is not null"), True


def repeats(rows: DataFrame, length: int = 100, piece: int = PIECE) -> DataFrame:
    """doc, at (packed range of positions whose string starts earlier, too): from rows _k, text."""
    if not GRAM + 2 <= length <= GRAM + 2000:
        raise ValueError(f"strings of {GRAM + 2} to {GRAM + 2000} bytes")
    spark = rows.sparkSession
    small_batches(spark, 1000)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("_k", F.col("text").cast("binary").alias("text"))
    ranked = rows.mapInArrow(_anchors(length, piece), _ROWS).repartition(parts, "a").sortWithinPartitions(*_NAMES)
    ranked = write_table(ranked.mapInArrow(_scan, "doc long, at long, open int"), "ranked")
    open_ = ranked.where("open = 1").groupBy("doc").agg(F.collect_list("at").alias("open_at"))
    first, *later = growth(length)
    units = rows.join(open_, F.col("_k") == F.col("doc")).select("_k", "text", "open_at").mapInArrow(_begin(length, *first), _UNITS)
    for core, longer in later:
        units = units.repartition(parts, "a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(_next(length, core, longer), _UNITS)
    settled = units.select(*_NAMES).repartition(parts, "a", "b", "c").sortWithinPartitions(*_NAMES).mapInArrow(_scan, "doc long, at long, open int")
    return ranked.where("open = 0").select("doc", "at").unionByName(settled.where("open = 0").select("doc", "at"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed [start, end) runs, in bytes), kept (the bytes left): a row for each row of docs."""
    rows, again = keyed(docs, id_col, text_col)
    hits = repeats(rows.dropDuplicates(["_k"]) if again else rows, length, piece).groupBy("doc").agg(F.collect_list("at").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, sizes = [], [], []
            for text, hit in zip(b.column(1), b.column(2)):
                data = text.as_buffer().to_pybytes()
                own = removed(np.array(hit.as_py() or [], np.int64), length)
                edges = [0, *own.reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[i:j] for i, j in zip(edges[0::2], edges[1::2])))
                spans.append([{"start": i, "end": j} for i, j in own.tolist()])
                sizes.append(len(data))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    # the columns are those that repeats() joins to its ranges, so Spark shuffles the texts once for both
    both = rows.select("_k", *(["doc_id"] if again else []), F.col("text").cast("binary").alias("text")).join(hits, F.col("_k") == F.col("doc"), "left")
    return both.select(F.col("doc_id" if again else "_k").alias("doc_id"), "text", "hits").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removed(hits: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [start, end) that the strings at the positions of packed ranges cover."""
    start = np.sort(hits)
    start, count, _ = unpacked(start)
    end = np.maximum.accumulate(start + count - 1 + length) if len(start) else start
    cut = np.ones(len(start), bool)
    cut[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(cut)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1] if len(start) else end], 1)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
