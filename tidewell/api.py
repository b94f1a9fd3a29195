"""What a user calls: probe recordings, check and extract them to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import sequences
from tidewell.operators.publish import publish
from tidewell.sources import container, records

#: Ids of the metadata, motion and exposure records.
METADATA, MOTION, EXPOSURE = 1, 3, 4


def read(spark: SparkSession, path: str, part: str = "boxes", payload: bool = True) -> DataFrame:
    """Rows of capture files; part is boxes, records or pts."""
    container.register(spark)
    return spark.read.format("recording").option("part", part).option("payload", str(payload).lower()).load(path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: boxes, records, bytes of records, frames and times of the video tracks, and the first error of each part."""
    error = F.min(F.when(F.col("status") != "ok", F.col("status")))
    boxes = read(spark, path).groupBy("path").agg(F.count("kind").alias("n_boxes"), error.alias("box_error"))
    found = read(spark, path, "records", payload=False).groupBy("path").agg(F.count("id").alias("n_records"), F.coalesce(F.sum("size"), F.lit(0)).alias("record_bytes"), error.alias("record_error"))
    times = read(spark, path, "pts").groupBy("path").agg(F.countDistinct("track").alias("n_tracks"), F.count("ordinal").alias("n_frames"), F.max("pts_us").alias("last_pts_us"), error.alias("pts_error"))
    return boxes.join(found, "path", "full").join(times, "path", "full").na.fill(0, ["n_boxes", "n_records", "record_bytes", "n_tracks", "n_frames"])


def preflight(spark: SparkSession, path: str) -> DataFrame:
    """Files that cannot be extracted, with the reason."""
    return probe(spark, path).select("path", F.coalesce("box_error", "record_error", "pts_error").alias("reason")).where("reason IS NOT NULL")


def input_sets(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """The files of a folder put together to recordings by their names."""
    return sequences.input_sets(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"), extension=extension)


def unique_record(records: DataFrame, number: int) -> DataFrame:
    """(path, payload, error) of the record of an id: a file with several of them is an error, one without has no row."""
    mine = records.where((F.col("id") == number) & (F.col("status") == "ok"))
    return mine.groupBy("path").agg(F.count("*").alias("n"), F.min("payload").alias("payload")).select("path", F.when(F.col("n") == 1, F.col("payload")).alias("payload"), F.when(F.col("n") > 1, "duplicate").alias("error"))


def extract(spark: SparkSession, path: str, target: str, raw_motion: bool = True) -> dict[str, str]:
    """Tables boxes, records, pts, metadata, motion and manifest under a folder; none replaces one that exists.

    A damaged file does not stop the others: its rows say what is wrong. Metadata and
    motion are made from the records as they were stored, so files are read once for
    each part. The manifest, written last, has a row for each file of each table, with
    its length and digest; `verify` holds a folder against it.
    """
    target = target.rstrip("/")
    made = {part: publish(read(spark, path, part), f"{target}/{part}") for part in ("boxes", "records", "pts")}
    stored = spark.read.parquet(made["records"])
    inner = lambda number: stored.where(F.col("id") == number).withColumnRenamed("path", "recording")
    made["metadata"] = publish(records.protobuf_fields(inner(METADATA)), f"{target}/metadata")
    made["motion"] = publish(records.motion_samples(inner(MOTION), raw_motion), f"{target}/motion")
    made["manifest"] = publish(manifest(spark, made), f"{target}/manifest")
    return made


def manifest(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table, file, length, sha256) of the data files of stored tables."""
    out = None
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        rows = files.select(F.lit(name).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionAll(rows)
    return out


def verify(spark: SparkSession, target: str) -> DataFrame:
    """(table, file, status) of the files that are missing, added or changed since a folder was extracted."""
    target = target.rstrip("/")
    said = spark.read.parquet(f"{target}/manifest")
    names = [r["table"] for r in said.select("table").distinct().collect()]  # five at most
    found = manifest(spark, {n: f"{target}/{n}" for n in names}).select("table", "file", F.col("length").alias("length_now"), F.col("sha256").alias("sha256_now"))
    both = said.join(found, ["table", "file"], "full")
    status = F.when(F.col("sha256_now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when((F.col("length") != F.col("length_now")) | (F.col("sha256") != F.col("sha256_now")), "changed")
    return both.select("table", "file", status.alias("status")).where("status IS NOT NULL")
