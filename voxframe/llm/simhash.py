"""SimHash near-duplicates by multi-index hashing.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one of their 32-bit halves. So the
table holds both halves of each distinct fingerprint, a query asks for the ball of radius 1 (33 keys) about each of
its halves, and every match is verified on the complete distance. With half as keys, chance matches stay rare at any
size: n fingerprints meet n * n * 66 / 2**32 others.

A key with many fingerprints (a large group of near copies) never yields its pairs: it is cut into blocks of bounded
size, a block compares its fingerprints with numpy and returns a spanning forest of its links. The class of a fingerprint that many documents share
(exact copies, empty texts) is brought to them by a broadcast of bounded size, so they aren't dealt to one task.

Defined cases: null and empty texts and texts without words have the fingerprint 0 and are linked like others; equal
texts share a fingerprint; ids may repeat; fingerprints are the nodes of the graph, so rows with a null or repeated id link as others do, but a null
id becomes a component's id only if all its ids are null; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.batches import map_batches
from voxframe.operators.components import connected_components
from voxframe.operators.joins import spread_join
from voxframe.workspace import small_batches, write_table

#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Fingerprints under one key up to which Spark's join compares them; beyond, blocks of BLOCK by BLOCK do.
FEW, BLOCK = 64, 4096
MASKS = [0] + [1 << i for i in range(32)]
LOW = (1 << 32) - 1


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that end at white space, or the whole if it is short."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def simhash(text: str | None, k: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of the k-word shingles, repeats included."""
    bits, n, last = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or "").encode().lower()):
        words = last + piece.split()
        if len(words) >= k:
            bits += _set_bits(_shingles(words, k, seed))
            n += len(words) - k + 1
        last = words[max(0, len(words) - k + 1) :]
    if not n and last:
        bits, n = _set_bits([xxhash.xxh64_intdigest(b" ".join(last), seed)]), 1
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def _shingles(words: list[bytes], k: int, seed: int) -> list[int]:
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[k - 1 :])]


def _set_bits(h: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), k, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession, 1000)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _halves(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """key (which half, and its value with a mask's bit turned), fp, node."""
    half = F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("fp").bitwiseAND(F.lit(LOW)).alias("x")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("fp", 32).alias("x"))))
    rows = nodes.select("fp", "node", half.alias("s"))
    if masks != [0]:
        rows = rows.select("fp", "node", "s", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
        return rows.select(F.col("s.x").bitwiseXOR(F.col("m")).bitwiseOR(F.shiftleft(F.col("s.h").cast("long"), 32)).alias("key"), "fp", "node")
    return rows.select(F.col("s.x").bitwiseOR(F.shiftleft(F.col("s.h").cast("long"), 32)).alias("key"), "fp", "node")


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """a, b: links that connect the same nodes as all pairs within max_bits (3 at most) do; nodes: fp distinct, node."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius 1 find up to 3 differing bits")
    table, asked = _halves(nodes, [0]), _halves(nodes, MASKS)
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    many = write_table(sizes.where(F.col("n") > FEW), "keys")
    t = table.select("key", F.col("fp").alias("t_fp"), F.col("node").alias("t_node"))
    hot = not many.isEmpty()
    if hot:
        t = t.join(many.select("key"), "key", "left_anti")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("t_fp"))) <= max_bits
    # a merge by hint: Spark sizes exploded rows as those they come from, and would broadcast the 66 keys of each fingerprint
    found = asked.hint("merge").join(t, "key").where((F.col("node") > F.col("t_node")) & close).select(F.col("node").alias("a"), F.col("t_node").alias("b"))
    return found.unionByName(_hot_links(table, asked, many, max_bits)) if hot else found


def _hot_links(table: DataFrame, asked: DataFrame, many: DataFrame, max_bits: int) -> DataFrame:
    q = asked.join(many.select("key", "n"), "key")
    q_sizes = q.groupBy("key").agg(F.count("*").alias("nq"))
    grid = many.join(q_sizes, "key").select("key", F.ceil(F.col("n") / BLOCK).alias("ct"), F.ceil(F.col("nq") / BLOCK).alias("cq"))
    grid = write_table(grid, "grid")  # so that its size is known, and it is what a join broadcasts

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        rows = rows.join(grid, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col(own)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        t_at, q_at = ("own", "other") if side == 0 else ("other", "own")
        return rows.select("key", F.col(t_at).alias("t_at"), F.col(q_at).alias("q_at"), F.lit(side).alias("side"), "fp", "node")

    def block(group: pa.Table) -> pa.Table:
        side, fp, node = (group.column(c).to_numpy() for c in ("side", "fp", "node"))
        a, b = forest(fp[side == 0], node[side == 0], fp[side == 1], node[side == 1], max_bits)
        return pa.table({"a": a, "b": b})

    both = dealt(table, "ct", "cq", 0).unionByName(dealt(asked.select("key", "fp", "node"), "cq", "ct", 1))
    return both.groupBy("key", "t_at", "q_at").applyInArrow(block, "a long, b long")


def forest(t_fp: np.ndarray, t_node: np.ndarray, q_fp: np.ndarray, q_node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At most len(t) + len(q) links that connect what the pairs (t, q) within max_bits connect."""
    part, of_q = np.arange(len(t_fp)), np.full(len(q_fp), -1)
    for at in range(0, len(q_fp), 256):
        near = np.bitwise_count(q_fp[at : at + 256, None] ^ t_fp[None, :]) <= max_bits
        for i in np.flatnonzero(near.any(1)):
            parts = np.unique(part[hits := np.flatnonzero(near[i])])
            of_q[at + i] = hits[0]
            if len(parts) > 1:
                part[np.isin(part, parts)] = parts[0]
    has = of_q >= 0
    a, b = np.concatenate([t_node, q_node[has]]), np.concatenate([t_node[part], t_node[part[of_q[has]]]])
    return a[a != b], b[a != b]


def _linked(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """fp, first, component (its smallest fp) of the fingerprints that have a link; nodes: fp distinct, first (smallest non-null id)."""
    parts = connected_components(links(nodes.select("fp", F.col("fp").alias("node")), max_bits))
    return nodes.join(parts.withColumnRenamed("node", "fp"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach): one row for each row of docs."""
    rows = write_table(fingerprints(docs, id_col, text_col), "simhash")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    linked = _linked(nodes, max_bits)
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = linked.join(least, "component").select("fp", "least")
    classes = write_table(nodes.join(found, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "classes")
    return spread_join(rows, classes, "fp", "n", rows.count()).select("doc_id", "fp", "component_id")


def hex16(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that lead their group of near copies (smallest id), once each; rows with a null id stay only if no other row is near.
    Of rows with that id and one fingerprint the one with the smallest hash of its text stays, then the smallest text, then the smallest hash of the row."""
    rows = fingerprint_column(docs, text_col)
    rows = write_table(rows, "simhash")
    nodes = write_table(rows.groupBy("_vx_fp").agg(F.min(F.col(f"`{id_col}`").cast("long")).alias("first")).withColumnRenamed("_vx_fp", "fp"), "nodes")
    linked = write_table(_linked(nodes), "linked")
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("s"))
    leads = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", "first").unionByName(best.select("s.fp", "s.first"))
    leads = leads.select(F.col("fp").alias("_vx_lead"), F.col("first").alias("_vx_first"))
    led = rows.join(leads, (F.col("_vx_fp") == F.col("_vx_lead")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_vx_first")))
    text, own = F.col(f"`{text_col}`").cast("string"), F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    best = led.groupBy("_vx_fp").agg(F.min_by(own, F.struct(F.xxhash64(text), text, F.xxhash64(F.to_json(own)))).alias("_vx_row"))
    return best.select(*[F.col(f"_vx_row._{i}").alias(c) for i, c in enumerate(docs.columns)])


def fingerprint_column(docs: DataFrame, text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """docs with _vx_fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), k, seed) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "_vx_fp"])

    small_batches(docs.sparkSession, 1000)
    text = F.col(f"`{text_col}`").cast("string").alias("_vx_text")
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in docs.columns], text), run, docs.select("*").withColumn("_vx_fp", F.lit(0).cast("long")).schema)
