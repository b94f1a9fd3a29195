"""Binary capture records: fixed-width motion and exposure samples, and protobuf fields, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The widths of the packed samples.
RAW_MOTION = np.dtype([("ts", "<u8"), ("axis", "<u2", 6)])
COMMON_MOTION = np.dtype([("ts", "<u8"), ("axis", "<f8", 6)])
EXPOSURE = np.dtype([("ts", "<i8"), ("shutter", "<f8")])


def motion_samples(records: DataFrame, raw: bool, payload: str = "payload", key: str = "recording") -> DataFrame:
    """(recording, ordinal, ts, axis array<double>, status) of packed motion records.

    A payload that is no whole number of samples gives one row of status
    bad_size; others are decoded a batch at a time.
    """
    kind = RAW_MOTION if raw else COMMON_MOTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None or len(data) % kind.itemsize:
                    rows.append((name, None, None, None, "bad_size"))
                    continue
                x = np.frombuffer(data, kind)
                rows.extend((name, i, int(t), a.tolist(), "ok" if np.isfinite(a).all() else "not_finite") for i, (t, a) in enumerate(zip(x["ts"], x["axis"].astype(float), strict=True)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["recording", "ordinal", "ts", "axis", "status"])

    return records.select(F.col(key).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, "recording string, ordinal long, ts long, axis array<double>, status string")


def scaled_axes(axis, acc_range: float, gyro_range: float):
    """Raw axes to g and rad/s: (raw - 32768) * range / 32768."""
    unit = lambda i, full: (F.element_at(axis, i + 1) - 32768) * full / 32768
    return F.struct(F.array(*[unit(i, acc_range) for i in range(3)]).alias("acc"), F.array(*[F.radians(unit(i, gyro_range)) for i in range(3, 6)]).alias("gyro"))


def protobuf_fields(messages: DataFrame, payload: str = "payload", key: str = "recording") -> DataFrame:
    """(recording, ord, number, wire, value_long, value_bin, status): one row for each field of a message."""

    def fields(data: bytes) -> Iterator[tuple]:
        at = ord_ = 0

        def varint() -> int:
            nonlocal at
            value = 0
            for k in range(10):
                if at >= len(data):
                    raise ValueError("truncated")
                byte = data[at]
                at += 1
                value |= (byte & 0x7F) << (7 * k)
                if not byte & 0x80:
                    if value >> 64:
                        break
                    return value
            raise ValueError("varint")

        while at < len(data):
            tag = varint()
            number, wire = tag >> 3, tag & 7
            if not number:
                raise ValueError("field number")
            long, raw = None, None
            if wire == 0:
                long = varint()
            elif wire in (1, 2, 5):
                size = varint() if wire == 2 else 8 if wire == 1 else 4
                if at + size > len(data):
                    raise ValueError("truncated")
                raw, at = data[at : at + size], at + size
            else:
                raise ValueError("wire type")
            yield ord_, number, {0: "varint", 1: "fixed64", 2: "bytes", 5: "fixed32"}[wire], None if long is None else long - (1 << 64) if long >> 63 else long, raw
            ord_ += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.extend((name, *f, "ok") for f in list(fields(data or b"")))
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["recording", "ord", "number", "wire", "value_long", "value_bin", "status"])

    return messages.select(F.col(key).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, "recording string, ord int, number int, wire string, value_long long, value_bin binary, status string")
