"""Changes of the store as functions from tables to tables; Parquet has no MERGE, so a change is a new snapshot."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxframe.functions.vectors import canonical_pair
from voxframe.workspace import write_table

#: Parts of a table that lies in parts; the mark's numbers for a table in one piece, and for a table's schema.
BUCKETS, WHOLE, SCHEMA = 64, -1, -2


def classify_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """path, track, action of each file seen: new; same (size equal, mtime within a second, done); redo (same but not done); changed."""
    s = stored.select("path", "track", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("status").alias("s_status"))
    same = (F.col("size") == F.col("s_size")) & (F.abs(F.col("mtime") - F.col("s_mtime")) < 1.0)
    action = F.when(F.col("s_size").isNull(), "new").when(same & (F.col("s_status") == "done"), "same").when(same, "redo").otherwise("changed")
    return seen.join(s, ["path", "track"], "left").select("path", "track", action.alias("action"))


def upsert_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """path, track, size, mtime, status after the look: new and changed files are pending, files not seen stay."""
    s = stored.select("path", "track", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("status").alias("s_status"))
    same = (F.col("size") == F.col("s_size")) & (F.abs(F.col("mtime") - F.col("s_mtime")) < 1.0)
    status = F.when(F.col("size").isNull() | F.coalesce(same, F.lit(False)), F.col("s_status")).otherwise("pending")
    return seen.join(s, ["path", "track"], "full").select("path", "track", F.coalesce("size", "s_size").alias("size"), F.coalesce("mtime", "s_mtime").alias("mtime"), status.alias("status"))


def update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of changes (one row a key) where there is a change."""
    own = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(own, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def columns(rows: DataFrame) -> DataFrame:
    """name of each column."""
    return rows.sparkSession.createDataFrame([(c,) for c in rows.columns], "name string")


def has_column(rows: DataFrame, name: str) -> bool:
    return name in rows.columns


def delete(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the last by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")


def put_locals(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Locals after an upsert on (file_id, label), one fresh row a key: centroid, n_segments and total_dur are replaced, id, global_id and similarity stay. New rows have ids above all others, by file and label."""
    own = ["centroid", "n_segments", "total_dur"]
    new = fresh.select("file_id", "label", *[F.col(c).alias(f"_{c}") for c in own], F.col("global_id").alias("_g"), F.col("similarity").alias("_s"), F.lit(True).alias("_hit"))
    kept = stored.join(new.drop("_g", "_s"), ["file_id", "label"], "left")
    kept = kept.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in stored.columns])
    return kept.unionByName(_with_ids(fresh.join(stored, ["file_id", "label"], "left_anti"), stored, ["file_id", "label"]).select(*stored.columns))


def _with_ids(rows: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Rows with an id above the stored ones by the order. Numbers are dealt a range at a time, so no task sees all rows."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    # written once: ranges are drawn from samples, so a second evaluation could draw others
    parts = write_table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    parts = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    numbered = parts.join(F.broadcast(before), "_part").join(F.broadcast(top), F.lit(True))  # a row a partition, and one row
    return numbered.withColumn("id", F.col("_top") + F.col("_before") + F.col("_k")).drop("_top", "_before", "_k", "_part")


def mint(stored: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with id: new identities, numbered above the stored ones."""
    return _with_ids(rows, stored, order)


def dismiss(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """low, high after pairs (a, b in any order) have been dismissed too; each once."""
    low, high = canonical_pair(F.col("a"), F.col("b"))
    return stored.select("low", "high").unionByName(pairs.select(low.alias("low"), high.alias("high"))).distinct()


def undismiss(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    low, high = canonical_pair(F.col("a"), F.col("b"))
    return stored.join(pairs.select(low.alias("low"), high.alias("high")), ["low", "high"], "left_anti")


def cascade(files: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after the files with these ids have gone: rows of children that refer to them by file_id go too."""
    keys = gone.select(F.col("id").alias("file_id"))
    return {"files": files.join(gone.select("id"), "id", "left_anti")} | {k: delete(v, keys, "file_id") for k, v in children.items()}


def forget(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows after the identities with these ids have gone: references to them are null."""
    g = gone.select(F.col("id").alias("global_id"), F.lit(True).alias("_gone")).distinct()
    joined = rows.join(g, "global_id", "left")
    return joined.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == "global_id" else F.col(c) for c in rows.columns])


def align_or_replace(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Segments after labels have come: in files where both have the same idx the columns are updated in place, other files of new replace the old ones. Files not in new stay."""
    both = old.select("file_id", "idx", F.lit(1).alias("_o")).join(new.select("file_id", "idx", F.lit(1).alias("_n")), ["file_id", "idx"], "full")
    fit = both.groupBy("file_id").agg(F.max("_n").alias("_seen"), F.bool_and(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("_fit")).where("_seen = 1").drop("_seen")
    fresh = new.select("file_id", "idx", *[F.col(c).alias(f"_new_{c}") for c in columns])
    inside = old.join(fit.where("_fit"), "file_id").join(fresh, ["file_id", "idx"])
    inside = inside.select(*[F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in old.columns])
    replaced = new.join(fit.where("not _fit"), "file_id").select(*old.columns)
    return inside.unionByName(replaced).unionByName(old.join(fit, "file_id", "left_anti").select(*old.columns))


def last_version(spark: SparkSession, root: str) -> int | None:
    """The number of the last version committed; None without one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/marks")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [p.getPath().getParent().getName() for p in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/marks/*/_SUCCESS")) or [])]
    return max((int(n[1:]) for n in done), default=None)


def bucket(key: str) -> Column:
    """The part of a table that a row with this key lies in."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, key: str) -> list[int]:
    """The parts that the rows lie in: BUCKETS numbers at most."""
    return [r[0] for r in rows.select(bucket(key)).distinct().collect()]


def commit(tables: dict[str, DataFrame], root: str, keys: dict[str, str] | None = None, only: dict[str, list[int]] | None = None) -> int:
    """Writes the tables as the next version and returns its number; tables not given are those of the version before, by reference.

    Tables with a key in keys lie in parts by it, and of those named in only, just these parts are written; the others stay, by reference.
    A version holds once its mark is complete, so a commit that fails leaves the former one in place. Of two writers of one version the second
    fails: each must create the version's claim, which the file system lets one of them do, after its tables are written.
    """
    spark, keys, only = next(iter(tables.values())).sparkSession, keys or {}, only or {}
    last = last_version(spark, root)
    marked = {} if last is None else _mark(spark, root, last)
    version, tag = (last or 0) + 1, uuid.uuid4().hex[:8]
    for name, rows in tables.items():
        path = f"v{version}-{tag}/{name}"
        schema = rows.schema.json()
        if name not in keys:
            rows.write.parquet(f"{root}/{path}")
            marked[name] = schema, {WHOLE: path}
            continue
        parts, kept = rows.withColumn("_bucket", bucket(keys[name])), {}
        if name in only and name in marked:
            parts = parts.where(F.col("_bucket").isin(only[name]))
            kept = {k: v for k, v in marked[name][1].items() if k not in only[name]}
        parts.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{path}")
        fs, at = _files(spark, f"{root}/{path}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        marked[name] = schema, kept | {int(n.partition("=")[2]): f"{path}/{n}" for n in names if n.startswith("_bucket=")}
    return _put_mark(spark, root, version, marked)


def _files(spark: SparkSession, at: str):
    """The Hadoop file system and path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _put_mark(spark: SparkSession, root: str, version: int, marked: dict[str, tuple[str, dict[int, str]]]) -> int:
    fs, claim = _files(spark, f"{root}/claims/v{version}")
    fs.mkdirs(claim.getParent())
    if not fs.createNewFile(claim):
        raise RuntimeError(f"version {version} of {root} has been claimed by another writer")
    rows = sorted((name, k, path) for name, (schema, parts) in marked.items() for k, path in [(SCHEMA, schema), *parts.items()])
    spark.createDataFrame(rows, "name string, bucket int, path string").coalesce(1).write.json(f"{root}/marks/v{version}")
    return version


def abandon(spark: SparkSession, root: str) -> int:
    """Takes back claims without a complete mark, which a writer left that died between the two; their number. For use when no writer is at work."""
    fs, at = _files(spark, f"{root}/claims")
    last, n = last_version(spark, root) or 0, 0
    for f in fs.listStatus(at) if fs.exists(at) else []:
        if int(f.getPath().getName()[1:]) > last:
            fs.delete(f.getPath(), True)
            mark_fs, mark = _files(spark, f"{root}/marks/{f.getPath().getName()}")
            mark_fs.delete(mark, True)
            n += 1
    return n


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """Makes the tables of an earlier version the next one, by reference; its number."""
    return _put_mark(spark, root, (last_version(spark, root) or 0) + 1, _mark(spark, root, version))


def backup(spark: SparkSession, root: str, dest: str, keys: dict[str, str] | None = None) -> int:
    """Copies the last version to another folder as a store of its own; its version there. If that fails, dest goes."""
    fs, at = _files(spark, dest)
    if fs.exists(at):
        raise ValueError(f"{dest} exists")
    try:
        return commit(current(spark, root), dest, keys)
    except Exception:
        fs.delete(at, True)
        raise


def _mark(spark: SparkSession, root: str, version: int) -> dict[str, tuple[str, dict[int, str]]]:
    """For each table its schema and the paths of its parts."""
    out: dict[str, dict[int, str]] = {}
    for r in spark.read.schema("name string, bucket int, path string").json(f"{root}/marks/v{version}").collect():  # BUCKETS rows a table at most
        out.setdefault(r.name, {})[r.bucket] = r.path
    return {name: (parts.pop(SCHEMA), parts) for name, parts in out.items()}


def current(spark: SparkSession, root: str, version: int | None = None, only: dict[str, list[int]] | None = None) -> dict[str, DataFrame]:
    """The tables of the last version committed, or of an earlier one; of those named in only, just these parts."""
    version = last_version(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"no version below {root}")
    out = {}
    for name, (schema, parts) in _mark(spark, root, version).items():
        kept, kind = (only or {}).get(name), StructType.fromJson(json.loads(schema))
        paths = [f"{root}/{path}" for k, path in sorted(parts.items()) if kept is None or k in kept or k == WHOLE]
        out[name] = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    return out


def counts(files: DataFrame, segments: DataFrame, identities: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: files, segments, speakers, named, enrolled, clips."""
    parts = [files.agg(F.count("*").alias("files")), segments.agg(F.count("*").alias("segments")), identities.agg(F.count("*").alias("speakers"), F.count_if(F.col("name") != "").alias("named"), F.count_if("enrolled").alias("enrolled")), clips.agg(F.count("*").alias("clips"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out
