"""Records, stage tables, inventories, and the flat exports."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_records(records: DataFrame, path: str, per_task: int = 250) -> None:
    """A file for each record (dir, value), below ``part=<task>/dir=<dir>``; ``dir`` is unique and not null.

    A task writes some ``per_task`` files, below a folder of its own. In a folder of the machine (or mounted there) it writes them itself, each moved into
    place whole: Hadoop starts several processes for every file it makes there. Elsewhere Spark's writer does; a task's folder is then moved as one."""
    tasks = records.count() // per_task + 1
    dealt = records.select("dir", "value").repartition(tasks, "dir").withColumn("part", F.spark_partition_id())
    scheme, root = re.fullmatch("(?:([\\w+.-]+):(?://(?=/))?)?(.*)", path).groups()
    scheme = scheme or urlsplit(records.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    if scheme != "file":
        dealt.write.partitionBy("part", "dir").text(path)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, name, value in zip(*(b[c].to_pylist() for c in ("part", "dir", "value"))):
                home = f"{root}/part={part}/dir={quote(name, safe='')}"
                os.makedirs(home, exist_ok=True)
                made = f"{home}/.{uuid.uuid4().hex}"
                with open(made, "w", encoding="utf-8") as f:
                    f.write(f"{value}\n")
                os.replace(made, f"{home}/record.json")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    os.makedirs(root)
    dealt.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def read_records(spark: SparkSession, glob: str, schema: T.StructType | str, id_pattern: str = "([^/]+)/[^/]+$") -> DataFrame:
    """One row per JSON file with its declared schema; ``traj_id`` from the path.

    ``glob``: files, or folders that hold them at any depth. The driver expands a pattern alone, folder by folder; what lies below a folder is listed by tasks."""
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(glob)
    return raw.withColumn("traj_id", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1))


def read_stage_table(spark: SparkSession, glob: str, schema: T.StructType | str, required: list[str]) -> DataFrame:
    """CSV of one stage over all trajectories; rows whose required columns don't parse are skipped; no file, no rows."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        raw = spark.read.schema(declared).option("header", True).option("mode", "PERMISSIVE").csv(glob)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], declared)
    return raw.dropna(subset=required)


def coerce(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Text columns to a declared schema; what does not parse is null, what is missing is null."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared))


def inventory(files: DataFrame, needed: dict[str, str], key: str = "dir") -> DataFrame:
    """Status of each directory from its files (dir, name): valid with exactly one file per needed pattern, ambiguous with more, else invalid; messages too."""
    counts = files.groupBy(key).agg(*(F.count_if(F.col("name").rlike(p)).alias(f"n_{k}") for k, p in needed.items()))
    miss = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") == 0, F.lit(f"missing {k}")) for k in needed)))
    many = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") > 1, F.lit(f"several {k}")) for k in needed)))
    status = F.when(F.size(miss) > 0, "invalid").when(F.size(many) > 0, "ambiguous").otherwise("valid")
    return counts.withColumns({"status": status, "messages": F.concat(miss, many)})


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(dir, name, size) without reading any content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path", F.col("length").alias("size"))
    return raw.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size")


def flat(df: DataFrame, leading: list[str]) -> DataFrame:
    """Leading columns first, list columns as one text joined by semicolons."""
    rest = [c for c in df.columns if c not in leading]
    text = lambda f: F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
    fields = {f.name: f for f in df.schema.fields}
    return df.select(*(text(fields[c]) for c in [*leading, *rest]))


def write_flat_csv(df: DataFrame, path: str, leading: list[str]) -> None:
    flat(df, leading).write.option("header", True).csv(path)


def save_frames(points: DataFrame, name: str, buckets: int, keys: tuple[str, ...] = ("traj_id", "frame")) -> DataFrame:
    """Store points of frames as table ``name`` in buckets of whole frames: what works frame by frame, and what it reduces per frame, then reads them where
    they lie, without an exchange. ``buckets``: some 128 MB of points each."""
    dealt = points.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("error").saveAsTable(name)
    return points.sparkSession.table(name)
