"""Transcripts as text: one string a file, from segments file_id, idx, label, seg_start, seg_end, text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe import files
from voxframe.functions import text as t

FORMATS = ("srt", "vtt", "txt", "tsv", "md", "json")


def _joined(rows: DataFrame, line: Column, order: str = "idx") -> DataFrame:
    lines = rows.select("file_id", F.struct(F.col(order).alias("k"), line.alias("line")).alias("x"))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("body"))


def cues(segments: DataFrame) -> DataFrame:
    """Segments with text and their number in the file from 1, _n."""
    return segments.where(F.col("text") != "").withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("idx")))


def search(segments: DataFrame, needle: str) -> DataFrame:
    """Segments with the words in their label or text, whatever the case of letters."""
    return segments.where(F.contains(F.lower(F.concat_ws(" ", "label", "text")), F.lower(F.lit(needle))))


def render(segments: DataFrame, fmt: str) -> DataFrame:
    """file_id, body. Segments with empty text are left out."""
    fmt = fmt.lower()
    rows = segments.where(F.col("text") != "")
    label, text = F.coalesce(F.col("label"), F.lit("")), F.col("text")
    times = [(t.timestamp(F.col("seg_start"), c), t.timestamp(F.col("seg_end"), c)) for c in (True, False)]
    if fmt == "srt":
        rows = cues(segments)
        head = F.when(label != "", F.concat(F.lit("["), label, F.lit("] "))).otherwise("")
        return _joined(rows, F.concat(F.col("_n").cast("string"), F.lit("\n"), times[0][0], F.lit(" --> "), times[0][1], F.lit("\n"), head, text, F.lit("\n\n")))
    if fmt == "vtt":
        said = F.when(label != "", F.concat(F.lit("<v "), label, F.lit(">"), text, F.lit("</v>"))).otherwise(text)
        out = _joined(rows, F.concat(times[1][0], F.lit(" --> "), times[1][1], F.lit("\n"), said, F.lit("\n\n")))
        return out.withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))
    if fmt == "txt":
        return _joined(rows, F.concat(F.when(label != "", F.concat(label, F.lit(": "))).otherwise(""), text, F.lit("\n")))
    if fmt == "tsv":
        out = _joined(rows, F.concat(t.general(F.col("seg_start")), F.lit("\t"), t.general(F.col("seg_end")), F.lit("\t"), label, F.lit("\t"), F.translate(text, "\t\n", "  "), F.lit("\n")))
        return out.withColumn("body", F.concat(F.lit("start\tend\tspeaker\ttext\n"), "body"))
    raise ValueError(f"unknown format {fmt}")


def json(segments: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, body: segments as above with global_id (null: -1), local_label and, where known, avg_logprob, no_speech and words (functions.packed.WORDS); files: file_id, source, track, track_count, duration, language, model. Numbers have six digits."""
    rows = segments.where(F.col("text") != "")

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), t.escape_json(F.coalesce(c, F.lit(""))), F.lit('"'))

    def number(name: str) -> Column:
        return t.general(F.coalesce(F.col(name), F.lit(0.0)).cast("double")) if name in rows.columns else F.lit("0")

    def word(w: Column) -> Column:
        times = [F.concat(F.lit(f'"{name}": '), t.general(w[name].cast("double")), F.lit(", ")) for name in ("start", "end", "probability")]
        return F.concat(F.lit("        {"), *times, F.lit('"text": '), quoted(w["text"]), F.lit("}"))

    words = F.lit("")
    if "words" in rows.columns:
        said = F.concat(F.lit(',\n      "words": [\n'), F.array_join(F.transform("words", word), ",\n"), F.lit("\n      ]"))
        words = F.when(F.size("words") > 0, said).otherwise("")

    def member(name: str, value: Column, last: bool = False) -> Column:
        return F.concat(F.lit(f'      "{name}": '), value, F.lit("" if last else ",\n"))

    parts = [member("start", t.general(F.col("seg_start"))), member("end", t.general(F.col("seg_end"))), member("speaker", quoted(F.col("label"))), member("speaker_id", F.coalesce("global_id", F.lit(-1)).cast("string")), member("local_label", quoted(F.col("local_label"))), member("avg_logprob", number("avg_logprob")), member("no_speech", number("no_speech")), member("text", quoted(F.col("text")), True), words]
    body = rows.select("file_id", F.struct("idx", F.concat(F.lit("    {\n"), *parts, F.lit("\n    }")).alias("line")).alias("x")).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), ",\n").alias("segments"))
    head = [("source", quoted(F.col("source"))), ("track", F.col("track").cast("string")), ("track_count", F.col("track_count").cast("string")), ("duration", t.general(F.col("duration"))), ("language", quoted(F.col("language"))), ("model", quoted(F.col("model")))]
    top = F.concat(F.lit("{\n"), *[F.concat(F.lit(f'  "{k}": '), v, F.lit(",\n")) for k, v in head], F.lit('  "segments": [\n'), F.coalesce("segments", F.lit("")), F.lit("\n  ]\n}\n"))
    return files.join(body, "file_id", "left").select("file_id", top.alias("body"))


def markdown(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file_id, body from folded blocks (attribution.fold_runs); below a head where files (as for json, source: the name shown) are given, with a row for each."""
    name = F.when(F.coalesce(F.col("speaker"), F.lit("")) == "", "Unattributed").otherwise(F.col("speaker"))
    body = _joined(blocks.withColumnRenamed("body", "_said"), F.concat(F.lit("**"), name, F.lit("** `"), t.timestamp(F.col("start"), False), F.lit("`\n\n"), F.col("_said"), F.lit("\n\n")), "block")
    if files is None:
        return body

    def line(shown: Column, when: Column) -> Column:
        return F.when(when, F.concat(shown, F.lit("  \n"))).otherwise("")

    language, model = F.coalesce("language", F.lit("")), F.coalesce("model", F.lit(""))
    head = F.concat(F.lit("# "), "source", F.lit("\n\n"), line(F.format_string("Track %d of %d", F.col("track") + 1, F.col("track_count")), F.col("track_count") > 1), F.lit("Duration: "), t.duration(F.col("duration")), F.lit("  \n"), line(F.concat(F.lit("Language: "), language), language != ""), line(F.concat(F.lit("Model: "), model), model != ""), F.lit("\n---\n\n"))
    return files.join(body, "file_id", "left").select("file_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("body"))


def write_files(bodies: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """file_id, path, n_bytes of the transcripts written below root, the URI of a folder that the executors share: rows file_id, body and file_id, path (relative).

    Each is written under a name of its own and then renamed, so a reader never sees a part and a task that runs twice does no harm.
    """
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file_id": r["file_id"], "path": r["path"], "n_bytes": files.write_whole(f"{base}/{r['path']}", [r["body"].encode()])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())]))

    return bodies.join(paths, "file_id").select(F.col("file_id").cast("long"), "path", "body").mapInArrow(run, "file_id long, path string, n_bytes long")
