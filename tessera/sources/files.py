"""Readers and writers of JSON lines, blobs, folders and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import stable_id


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped. strict: the first bad line fails the read; otherwise bad lines
    come with their text in _corrupt_record. A path that doesn't exist gives no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    with_text = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(with_text).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The commit protocol makes the whole write appear, or nothing of it."""
    df.write.mode(mode).json(path)


def append_valid(df: DataFrame, path: str, rules: dict[str, Column]) -> DataFrame:
    """Append the rows that keep all rules (name: condition) to JSON lines at path, if no row breaks one; else append
    nothing. The rows that break one, with broken (the rules' names)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]), lambda x: x.isNotNull())
    bad = df.withColumn("broken", broken).where(F.size("broken") > 0)
    if bad.isEmpty():
        write_json_lines(df, path, "append")
    return bad


def write_document(spark: SparkSession, document: dict | list, path: str) -> None:
    """One JSON document, written beside its place and moved there, so readers never see half of it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"cannot move {beside} to {path}")


def read_document(spark: SparkSession, path: str) -> dict | list:
    """One JSON document."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_report(document: DataFrame, path: str) -> None:
    """Reports (see audit.report_document) as Markdown, a folder per run; rows are sorted on their way and never collected."""
    ordered = document.repartition("run_id").sortWithinPartitions("run_id", "part", "subject_id")
    ordered.select("run_id", "text").write.mode("overwrite").partitionBy("run_id").text(path)


def blobs(contents: DataFrame) -> DataFrame:
    """content_hash, content: each distinct content once (contents: content, binary or text)."""
    return contents.select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])


def write_blobs(contents: DataFrame, path: str) -> None:
    """Add the contents that the store at path (Parquet, one row per hash) doesn't hold yet."""
    spark = contents.sparkSession
    new = blobs(contents)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    new.write.mode("append").parquet(path)


def read_folder(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to root), sha256, bytes of every file below root, but for paths with an excluded part."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.substring_index(F.col("path"), base, -1)
    out = files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    for part in exclude:
        out = out.where(~F.array_contains(F.split("path", "/"), part))
    return out


def folder_digest(files: DataFrame) -> DataFrame:
    """digest: one hash over the paths and hashes of all files; equal folders have equal digests. Per-file hashes are
    combined in the order of paths, by 256 groups first, so no task holds more than a share of them."""
    one = files.select(F.concat_ws("\0", "path", "sha256").alias("f")).withColumn("g", F.substring(F.sha2("f", 256), 1, 2))
    parts = one.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "h"))), "\n"), 256).alias("digest"))


def migrate_records(records: DataFrame, sources: DataFrame, run_id: str, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Older graph records as run-store rows: episodes, nodes and edges of a run.

    records: record_type, id, node_type, data, edge_type, from_id, to_id, source_id, provenance; sources: source_id,
    locator, content_hash, authority_tier, independence_group. Episodes are marked unverified-legacy; edges are valid from
    as_of on, open, and name the episode of their source if it is known.
    """
    at = F.to_timestamp(F.lit(as_of))
    episode = stable_id("episode", F.lit(run_id), F.col("source_id"), F.col("content_hash"))
    episodes = sources.select(F.lit(run_id).alias("run_id"), episode.alias("episode_id"), "source_id", F.lit(1).alias("version"), "locator", "content_hash", F.col("authority_tier").alias("authority"), "independence_group", F.lit("unverified-legacy").alias("injection_risk"), at.alias("retrieved_at"))
    nodes = records.where("record_type = 'node'").select(F.lit(run_id).alias("run_id"), F.col("id").alias("node_id"), "node_type", F.lit(0).alias("ontology_version"), F.col("data").alias("data_json"), at.alias("created_at"))
    edges = records.where("record_type = 'edge'").join(episodes.select("source_id", F.col("episode_id").alias("source_episode_id")), "source_id", "left")
    edges = edges.select(F.lit(run_id).alias("run_id"), F.col("id").alias("edge_id"), "edge_type", "from_id", "to_id", F.lit(0).alias("ontology_version"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), at.alias("recorded_at"), "source_episode_id", F.col("provenance").alias("provenance_json"), F.lit("active").alias("status"))
    return episodes, nodes, edges
