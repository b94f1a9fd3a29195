import json
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_container import box, movie, trailer
from tidewell import api
from tidewell.__main__ import main
from tidewell.operators import publish
from tidewell.sources import assets


def test_extract_verify_and_command_line(spark, tmp_path, capsys):
    files = tmp_path / "in"
    files.mkdir()
    for name, data in (("v_00_1", movie([(3, 1001)]) + trailer([(1, 1, b""), (3, 1, bytes(20))])), ("v_10_1", movie([(3, 1001)])), ("bad", b"abc")):
        (files / f"{name}.rec").write_bytes(data)
    target = str(tmp_path / "out")
    assert main(["extract", str(files), target], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert set(made) == {"boxes", "records", "pts", "metadata", "motion", "manifest"}
    assert spark.read.parquet(made["motion"]).count() == 1 and main(["verify", target], spark) == 0
    assert main(["extract", str(files), target], spark) == 2
    assert main(["preflight", str(files)], spark) == 1 and "bad.rec" in capsys.readouterr().out
    assert main(["sets", str(files), "--extension", "rec"], spark) == 0
    sets = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted(len(s["paths"]) for s in sets) == [1, 2]
    spark.range(1).write.mode("append").parquet(f"{target}/pts")
    assert main(["verify", target], spark) == 1 and "added" in capsys.readouterr().out
    stored = spark.read.parquet(made["records"])
    twice = stored.unionAll(stored)
    assert {r["error"] for r in api.unique_record(stored, 3).collect()} == {None} and {r["error"] for r in api.unique_record(twice, 3).collect()} == {"duplicate"}


SVM = "<opencv_storage><opencv_ml_svm><format>3</format><svmType>EPS_SVR</svmType><kernel><type>LINEAR</type></kernel><var_count>2</var_count><sv_total>2</sv_total><support_vectors><_>1 2</_><_>3. -4e-1</_></support_vectors><decision_functions><_><sv_count>2</sv_count><rho>0.5</rho><alpha>1 -2</alpha></_></decision_functions></opencv_ml_svm></opencv_storage>"


def test_decision_functions(spark, tmp_path):
    bad = {"kernel": SVM.replace("LINEAR", "RBF"), "short": SVM.replace("<_>1 2</_>", "<_>1</_>"), "index": SVM.replace("<rho>", "<index>0 1</index><rho>"), "nan": SVM.replace("0.5", "nan"), "cut": SVM[:-9]}
    for name, text in (bad | {"good": SVM}).items():
        (tmp_path / name).write_text(text)
    rows = assets.read(spark, str(tmp_path), "svm")
    got = {r["path"].split("/")[-1]: r for r in rows.collect()}
    assert got["good"]["error"] is None and all(got[n]["error"] for n in bad)
    value = rows.where("error IS NULL").select(assets.decision(F.array(F.lit(2.0), F.lit(5.0)), F.col("value.rho"), F.col("value.alpha"), F.col("value.vectors")).alias("d")).first()["d"]
    assert value == pytest.approx(1 * 12 - 2 * (6 - 2) - 0.5)


def test_byte_tables(spark, tmp_path):
    edge = 254 // 128 + 2
    body = struct.pack("<3I", 16, 256, 128) + bytes(range(3 * edge**3))
    for name, data in (("plain", body), ("described", body + bytes(132)), ("partial", body + bytes(60)), ("step", struct.pack("<3I", 16, 256, 0)), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].split("/")[-1]: r for r in assets.read(spark, str(tmp_path), "byte_table").collect()}
    assert got["plain"]["value"]["edge"] == edge and got["plain"]["value"]["green"][:3] == [1, 4, 7] and got["described"]["error"] is None
    assert all(got[n]["error"] for n in ("partial", "step")) and "empty" not in got


def test_references_are_rewritten_outside_of_what_was_recorded(spark):
    text = json.dumps({"path": "a/b.bin", "metadata": {"path": "a/b.bin"}, "streams": [{"raw_path": "c", "tags": {"extradata": "c"}, "name": "c"}], "size": 3})
    refs = spark.createDataFrame([("a/b.bin", "bundle-0", 5, 7), ("c", "bundle-1", 0, 2), ("unused", "x", 0, 0)], "path string, bundle string, offset long, size long")
    rows = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, text)], "`k.1` long, doc string")
    got = {r["k.1"]: r["doc"] for r in publish.rewrite_references(rows, "doc", refs).collect()}
    new = json.loads(got[1])
    assert new["path"] == {"bundle": "bundle-0", "offset": 5, "size": 7} and new["metadata"] == {"path": "a/b.bin"} and new["streams"] == [{"raw_path": {"bundle": "bundle-1", "offset": 0, "size": 2}, "tags": {"extradata": "c"}, "name": "c"}]
    assert got[2] == "no json" and got[3] is None and got[4] == got[1]
