"""Typed telemetry of records: metadata of protobuf fields, motion and exposure on the media clock."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.records import EXPOSURE

#: Numbers of the fields and their names; each is a text, an integer or the bits of a double.
TEXTS = {1: "serial", 2: "camera", 3: "firmware", 5: "offset_v1", 53: "offset_v2", 54: "offset_v3", 111: "offset_v6"}
LONGS = {24: "first_frame", 64: "pts_map_type", 68: "optics_state", 104: "guard", 128: "blend_angle", 62: "is_raw_gyro"}
#: Ranges of the axes where a recording states none.
ACC_RANGE, GYRO_RANGE = 8.0, 2000.0


def metadata(fields: DataFrame) -> DataFrame:
    """One row a recording out of `records.protobuf_fields`: the last good value of each known field, and all other fields as they were.

    One aggregate; of each key only structs of a place and a value are kept, but the
    unknown fields, which a file bounds, are kept whole.
    """
    good = F.col("status") == "ok"
    last = lambda number, wire, value: F.max_by(value, F.when(good & (F.col("number") == number) & (F.col("wire") == wire) & value.isNotNull(), F.col("ord")))
    text = F.when(F.is_valid_utf8(F.col("value_bin").cast("string")), F.col("value_bin").cast("string"))
    known = [last(k, "bytes", text).alias(v) for k, v in TEXTS.items()] + [last(k, "varint", F.col("value_long")).alias(v) for k, v in LONGS.items()]
    unknown = F.sort_array(F.collect_list(F.when(good & ~F.col("number").isin(*TEXTS, *LONGS), F.struct("ord", "number", "wire", "value_long", "value_bin"))))
    found = fields.groupBy("recording").agg(*known, unknown.alias("unknown"), F.max(F.when(~good, F.col("status"))).alias("error"))
    return found.withColumn("is_raw_gyro", F.col("is_raw_gyro") != 0)


def agreed(fields: DataFrame, number: int) -> DataFrame:
    """(recording, state, value_bin) of a field that may be repeated only alike: absent, valid or conflict."""
    mine = F.when(F.col("number") == number, F.coalesce(F.col("value_bin"), F.encode(F.col("value_long").cast("string"), "utf-8")))
    kinds = F.min(F.when(F.col("number") == number, F.col("wire"))) != F.max(F.when(F.col("number") == number, F.col("wire")))
    state = F.when(F.min(mine).isNull(), "absent").when((F.min(mine) != F.max(mine)) | kinds, "conflict").otherwise("valid")
    return fields.groupBy("recording").agg(state.alias("state"), F.when(state == "valid", F.min(mine)).alias("value_bin"))


def media_clock(samples: DataFrame, by: list[str], clock: Column, raw: Column, first: Column, adjust_ms: Column) -> DataFrame:
    """Samples with `t_us` on the media clock and `clock_status`: those before the first frame go, then the clock must rise.

    Clocks are in microseconds if raw, else milliseconds; where a recording states no
    first frame, its first sample is it. A whole recording gets the status of its
    worst sample, so that one that breaks the rule can be taken out.
    """
    unit = F.when(raw, 1).otherwise(1000)
    start = F.coalesce(first, F.min(clock).over(Window.partitionBy(*by)))
    moved = samples.withColumn("t_us", clock * unit - start * unit - F.round(F.coalesce(adjust_ms, F.lit(0.0)) * 1000).cast("long")).where("t_us >= 0")
    step = F.col("t_us") - F.lag("t_us").over(Window.partitionBy(*by).orderBy("ordinal"))
    marked = moved.withColumn("__step", step)
    bad = F.coalesce(F.min("__step").over(Window.partitionBy(*by)) <= 0, F.lit(False))
    return marked.withColumn("clock_status", F.when(bad, "not_monotonic").otherwise("ok")).drop("__step")


def exposure_samples(records: DataFrame, payload: str = "payload", key: str = "recording") -> DataFrame:
    """(recording, ordinal, ts, shutter_ns, status) of packed exposure records; a payload of no whole number of samples is one row bad_size, a shutter that is no length of time is a row bad_shutter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = data is not None and len(data) % EXPOSURE.itemsize == 0
                x = np.frombuffer(data if whole else b"", EXPOSURE)
                fine = np.isfinite(x["shutter"]) & (x["shutter"] >= 0) & (x["shutter"] < 9e9)
                ns = np.rint(np.where(fine, x["shutter"], 0) * 1e9).astype("int64")
                n = len(x) if whole else 1
                columns = [pa.array([name] * n, pa.string()), pa.array(range(n) if whole else [None], pa.int64()), pa.array(x["ts"] if whole else [None], pa.int64())]
                columns += [pa.array(ns, pa.int64(), mask=~fine) if whole else pa.array([None], pa.int64()), pa.array(np.where(fine, "ok", "bad_shutter").tolist() if whole else ["bad_size"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["recording", "ordinal", "ts", "shutter_ns", "status"])

    return records.select(F.col(key).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, "recording string, ordinal long, ts long, shutter_ns long, status string")
