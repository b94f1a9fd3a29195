"""Each streaming twin against its batch form, over files that arrive one after another."""

import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tidewell.functions.clock import micros
from tidewell.operators import ordered
from tidewell.streaming import stateful


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), micros("ts").alias("t"), "value")
    cuts = rows.approxQuantile("t", [0.3, 0.6], 0.0)
    for k, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 1e18], strict=True)):
        rows.where((F.col("t") > low) & (F.col("t") <= high)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    return rows, stream, tmp_path


def drained(stream, folder, name):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{folder}/c-{name}").option("path", f"file://{folder}/o-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(f"file://{folder}/o-{name}")


def test_ema(events):
    rows, stream, folder = events
    got = drained(stateful.ema_with_reset(stream, ["user_id"], "t", "value", 0.8), folder, "ema")
    want = ordered.ema_with_reset(rows, ["user_id"], "t", "value", 0.8, 3_600_000_000)
    rounded = lambda df: sorted((r["user_id"], r["t"], round(r["ema"], 8)) for r in df.collect())
    assert rounded(got) == rounded(want)


def test_strictly_later(events):
    rows, stream, folder = events
    got = drained(stateful.strictly_later(stream.unionByName(stream), ["user_id"], "t"), folder, "later")
    assert got.count() == rows.select("user_id", "t").distinct().count()


def test_window_statistics(events):
    rows, stream, folder = events
    got = {(r["user_id"], r["start"]): (r["n"], round(r["total"], 6)) for r in drained(stateful.window_statistics(stream, ["user_id"], "at", "1 day", "1 day", F.col("value")), folder, "win").collect()}
    want = {(r["user_id"], r["start"]): (r["n"], round(r["v"], 6)) for r in rows.groupBy("user_id", F.window("at", "1 day")["start"].alias("start")).agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 3 * 20  # only windows that the watermark has not passed are held back
