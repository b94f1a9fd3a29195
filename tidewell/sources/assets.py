"""Asset files as rows: linear decision functions in XML and byte colour tables."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: the XML's version and kernel; the table's element type, levels and trailer lengths.
SVM_FORMAT, SVM_KERNEL = "3", "LINEAR"
ELEMENT, LEVELS, TRAILERS = 16, 256, (0, 128, 132)


def _numbers(text: str | None, what: str) -> list[float]:
    found = [float(x) for x in (text or "").split()]
    if not all(map(math.isfinite, found)):
        raise ValueError(f"{what} is not finite")
    return found


def _only(node: ET.Element, name: str) -> ET.Element:
    found = node.findall(name)
    if len(found) != 1:
        raise ValueError(f"{len(found)} elements {name}, one is due")
    return found[0]


def parse_svm(data: bytes) -> dict:
    """(rho, alpha, vectors) of a linear decision function; ValueError says which rule is broken."""
    try:
        svm = _only(ET.fromstring(data), "opencv_ml_svm")
    except ET.ParseError as e:
        raise ValueError(f"no XML: {e}") from None
    value = lambda name, node=svm: (_only(node, name).text or "").strip()
    if value("format") != SVM_FORMAT or not value("svmType") or value("type", _only(svm, "kernel")) != SVM_KERNEL:
        raise ValueError("format, type or kernel")
    width, total = int(value("var_count")), int(value("sv_total"))
    vectors = [_numbers(v.text, "support vector") for v in _only(svm, "support_vectors").findall("_")]
    if width < 1 or len(vectors) != total or any(len(v) != width for v in vectors):
        raise ValueError("number of support vectors or of their values")
    functions = _only(svm, "decision_functions").findall("_")
    if len(functions) != 1 or functions[0].find("index") is not None:
        raise ValueError("one decision function without an index is due")
    alpha, rho = _numbers(value("alpha", functions[0]), "alpha"), _numbers(value("rho", functions[0]), "rho")
    if len(rho) != 1 or not int(value("sv_count", functions[0])) == len(alpha) == total:
        raise ValueError("rho or number of alphas")
    return {"rho": rho[0], "alpha": alpha, "vectors": vectors}


def parse_byte_table(data: bytes) -> dict:
    """(step, edge, red, green, blue) of a byte look-up on a grid, the last axis fastest."""
    if len(data) < 12:
        raise ValueError("header")
    element, levels, step = struct.unpack_from("<3I", data)
    if element != ELEMENT or levels != LEVELS or not 1 <= step <= 256:
        raise ValueError("element, levels or step")
    edge = 254 // step + 2
    end = 12 + 3 * edge**3
    if len(data) - end not in TRAILERS:
        raise ValueError("length")
    return {"step": step, "edge": edge} | {name: list(data[12 + c : end : 3]) for c, name in enumerate(("red", "green", "blue"))}


KINDS: dict[str, tuple[Callable[[bytes], dict], str]] = {
    "svm": (parse_svm, "rho double, alpha array<double>, vectors array<array<double>>"),
    "byte_table": (parse_byte_table, "step int, edge int, red array<int>, green array<int>, blue array<int>"),
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, value, error) of each file: a file that breaks a rule is a row that says which; an empty file has none."""
    parse, fields = KINDS[kind]
    value = spark.createDataFrame([], f"value struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(', '))}>").schema
    from pyspark.sql.pandas.types import to_arrow_type

    inner = to_arrow_type(value["value"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    values.append(parse(data))
                    errors.append(None)
                except ValueError as e:
                    values.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(values, inner), pa.array(errors, pa.string())], ["path", "value", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {value['value'].simpleString().replace(':', ' ', 1)}, error string")


def decision(features, rho, alpha, vectors):
    """alpha-weighted products with the support vectors, less rho; null where widths differ."""
    dot = lambda v: F.aggregate(F.zip_with(v, features, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(F.zip_with(alpha, vectors, lambda a, v: a * dot(v)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.forall(vectors, lambda v: F.size(v) == F.size(features)), total - rho)
