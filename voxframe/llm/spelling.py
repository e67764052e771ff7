"""Spelling variants grouped by a symmetric-delete join.

Words are counted inside each task first, so a frequent word is a few rows of the shuffle. Each word of the vocabulary emits itself and its distinct
single deletions; two words within one edit share exactly one such string, so an equi-join on it meets each near pair once. What is emitted is not the string but a hash
of it worked out from sums over the word (linear in the word, however long), beside the run of places at which the deletion gives that string: a pair of deletions is a replacement
if its runs meet, a word that equals another's deletion is an insertion. The join yields such pairs only; each is then verified on the words themselves, so that a
clash of hashes does no harm. Words that share a string of length L are at most (L + 1) times the alphabet, so no key is hot.

The form of a word is its near word with the largest count, if that is large enough; counts at least double along forms, so following them ends, and doubling the pointers
finds all roots in a few joins.

Defined cases: null and empty texts have no words; a null id reads "null"; repeated rows count as often as they come; long texts are read in pieces; an empty table gives an
empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.workspace import small_batches, write_table

#: Code points of a text that are read at once; distinct words that a task counts before it hands them on; code points whose deletions are worked out at once.
PIECE, HELD, STEP = 1 << 20, 300_000, 1 << 20
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
#: Moduli and bases of the two hashes of a string.
HASHES = ((2147483647, 1000003), (2147483629, 998244353))


def counted(doc: str, text: bytes, least: int, typo: int) -> Counter:
    """Words of a text of at least so many code points. Where typo divides the crc32 of id and word, a code point of the word is left out."""
    found, runs = Counter(), re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least))
    line, at = text.translate(_LOWER).decode(), 0
    while at < len(line):
        cut = _BREAK.search(line, at + PIECE) if len(line) - at > PIECE else None
        end = cut.start() if cut else len(line)
        found.update(runs.findall(line[at:end] if at or cut else line))
        at = end
    if not typo:
        return found
    start, out = zlib.crc32(f"{doc}:".encode()), Counter()
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % typo == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) < least:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3, typo: int = 0) -> DataFrame:
    """word, n: words of at least so many code points that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text.is_valid:
                    held.update(counted(doc, text.as_buffer().to_pybytes(), least, typo))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    small_batches(docs.sparkSession, 1000)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _powers(base: int, mod: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % mod
    return out


def emitted(ids: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """id, key, first, last: for each word its own key (places -1), and one for each distinct deletion with the first and last place that gives it."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        of = np.flatnonzero(sizes == size)
        powers = [_powers(base, mod, size) for mod, base in HASHES]
        for at in range(0, len(of), max(1, STEP // size)):
            own = of[at : at + max(1, STEP // size)]
            code = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(len(own), size).astype(np.uint64) + 1
            whole, gone = np.zeros(len(own), np.uint64), np.zeros(code.shape, np.uint64)
            for (mod, _), power in zip(HASHES, powers):
                full = code * power[::-1] % mod
                head = np.zeros_like(code)
                head[:, 1:] = np.cumsum(code[:, :-1] * power[::-1][1:] % mod, 1)
                tail = full.sum(1, keepdims=True) - np.cumsum(full, 1)
                whole, gone = whole << 32 | full.sum(1) % mod, gone << 32 | (head + tail) % mod
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            row, first = np.nonzero(new)
            last = np.append(np.where(row[1:] == row[:-1], first[1:], size), size) - 1
            none = np.full(len(own), -1)
            yield np.concatenate([ids[own], ids[own][row]]), np.concatenate([whole, gone[row, first]]).view(np.int64), np.concatenate([none, first]), np.concatenate([none, last])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: ids of the words that differ by exactly one inserted, deleted or replaced code point, each pair once; words: id (distinct), word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, key, first, last in emitted(b.column(0).to_numpy(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(key), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["id", "key", "first", "last"])

    rows = words.select("id", "word").mapInArrow(run, "id long, key long, first int, last int").repartition("key")
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "first", "last")]) for k in "ab")
    inserted = (F.col("first_a") < 0) != (F.col("first_b") < 0)
    replaced = (F.col("first_a") >= 0) & (F.col("first_b") >= 0) & (F.greatest("first_a", "first_b") <= F.least("last_a", "last_b"))
    met = a.join(b, (a["key"] == b["key"]) & (F.col("id_a") < F.col("id_b")) & (inserted | replaced)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    left, right = (words.select(F.col("id").alias(k), F.col("word").alias(f"_{k}")) for k in "ab")
    return met.join(left, "a").join(right, "b").where(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """id, root of rows id, form: the last of the forms that follow one another. Forms must not go round in a ring."""
    now = write_table(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        now = write_table(now.join(after, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of rows word, n. A form has at least times (2 or more) the count of its word, so that forms end."""
    if times < 2:
        raise ValueError("forms may go round in a ring if they needn't be more frequent")
    words = write_table(words.select("word", "n", F.monotonically_increasing_id().alias("id")), "words")
    pairs = write_table(near_pairs(words), "near")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct(-F.col("n"), F.col("word"), F.col("id")).alias("_b"))
    near = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("_b").alias("_b")).withColumnRenamed("a", "id")
    best = F.when(-F.col("_b.col1") >= F.lit(times) * F.col("n"), F.col("_b"))
    rows = words.join(near, "id", "left").withColumn("_b", best)
    rows = write_table(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_b.word").alias("form"), (-F.col("_b.col1")).alias("form_n"), F.col("_b.id").alias("form_id")), "forms")
    found = roots(rows.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    last = found.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return rows.join(last, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))
