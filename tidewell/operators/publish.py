"""Publication: staged writes, no overwriting, indexed bundles and verified loads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def publish(df: DataFrame, target: str, kind: str = "parquet") -> str:
    """Write beside the target, then rename; an existing target is never replaced and a failed write leaves nothing."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(target)
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise FileExistsError(target)
    stage = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.stage-{uuid.uuid4().hex[:8]}")
    try:
        df.write.format(kind).mode("errorifexists").save(stage.toString())
        if fs.exists(final) or not fs.rename(stage, final):
            raise FileExistsError(target)
    finally:
        if fs.exists(stage):
            fs.delete(stage, True)
    return target


def bundle_index(df: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """Offset of each payload in the concatenation of a group's payloads."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def verified(df: DataFrame, content: str, length: str, digest: str) -> DataFrame:
    """Rows with a status: ok, wrong_length or wrong_digest."""
    data = F.col(content).cast("binary")
    status = F.when(F.octet_length(data) != F.col(length), "wrong_length").when(F.sha2(data, 256) != F.col(digest), "wrong_digest").otherwise("ok")
    return df.withColumn("status", status)


#: Keys that hold references, and keys of what was recorded, which is never touched.
REFERENCES = frozenset({"path", "raw_path", "packet_payload", "packet_index", "side_data_payload", "extradata"})
RECORDED = frozenset({"metadata", "tags"})


def with_references(value, known: dict[str, object]):
    """A JSON value whose references are replaced by what they stand for now, at any depth outside of what was recorded."""
    if isinstance(value, list):
        return [with_references(v, known) for v in value]
    if not isinstance(value, dict):
        return value
    swapped = lambda k, v: known[v] if k in REFERENCES and isinstance(v, str) and v in known else with_references(v, known)
    return {k: v if k in RECORDED else swapped(k, v) for k, v in value.items()}


def rewrite_references(df: DataFrame, column: str, references: DataFrame) -> DataFrame:
    """df with references (path, bundle, offset, size) put into a column of JSON texts.

    A text meets only the references that occur in it, by a join on its strings, so
    the table of references may be of any size. A text that is no JSON stays.
    """
    numbered = df.withColumn("__key", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
    quoted = F.regexp_extract_all(F.col(column), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    named = numbered.select("__key", F.explode(F.array_distinct(quoted)).alias("path")).distinct().join(references, "path")
    slices = named.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("path", F.to_json(F.struct("bundle", "offset", "size"))))).alias("__known"))
    # Plain names on the way through Arrow: mapInArrow does not take dotted ones.
    plain = [f"c{i}" for i in range(len(df.columns))]
    kinds = StructType([StructField(p, f.dataType) for p, f in zip(plain, df.schema, strict=True)])
    place = plain[df.columns.index(column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, known in zip(batch.column(place).to_pylist(), batch.column("known").to_pylist(), strict=True):
                try:
                    out.append(json.dumps(with_references(json.loads(text), {k: json.loads(v) for k, v in known})) if text is not None and known else text)
                except ValueError:
                    out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if p == place else batch.column(p) for p in plain], plain)

    both = numbered.join(slices, "__key", "left").select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, df.columns, strict=True)], F.col("__known").alias("known"))
    return both.mapInArrow(run, kinds).toDF(*df.columns)
