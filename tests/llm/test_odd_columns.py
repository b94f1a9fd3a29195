"""Every operator and stage on ids of text, names with dots, and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import bpe_automaton, language_id, media_chunks, near_dedup, packing, quality, secret_scan, suffix_dedup, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "The quick brown fox jumps over the lazy dog and runs on through the long green field until the evening comes again. " * 3


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [("a1", TEXT + "one", "en", 1), ("a2", TEXT + "one", "en", 2), ("a3", None, None, 3), (None, "", "en", 4), ("a1", TEXT + "one", "en", 1), ("b", "key 0123456789abcdef0123 there", "en", 5), ("b", "key 0123456789abcdef0123 there", "en", 6)]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, "`doc.id` string, `the.text` string, lang string, `a.b` int").write.parquet(path)
    return spark.read.parquet(path)


NAMES = {"id_column": "doc.id", "text_column": "the.text"}


def ids(df, column="doc_id"):
    return sorted(str(r[0]) for r in df.select(F.col(f"`{column}`")).collect())


def test_ids_of_text_and_names_with_dots(spark, docs):
    table = secret_scan.train(secret_scan.default_samples(spark))
    every = ["None", "a1", "a1", "a2", "a3", "b", "b"]
    assert ids(near_dedup.classes(docs, **NAMES)) == every
    assert ids(suffix_dedup.spans(docs, **NAMES)) == every
    assert ids(secret_scan.scan(docs, table, **NAMES), "doc.id") == every
    assert ids(language_id.identify(docs, **NAMES)) == every
    assert ids(bpe_automaton.digests(docs, WORDS, **NAMES)) == every
    assert ids(media_chunks.round_trip(docs, **NAMES)) == every
    assert set(ids(packing.pack(docs, WORDS, **NAMES))) == set(every)
    assert token_files.round_trip(docs, BYTES, **NAMES).where("doc_id IS NULL").count() == 7
    labels = spark.createDataFrame([("a1", 1), ("b", 0)], "`doc.id` string, quality int")
    assert ids(quality.classify(docs, labels, **NAMES)) == every


def test_other_columns_stay(spark, docs):
    table = secret_scan.train(secret_scan.default_samples(spark))
    kept = near_dedup.keep_one(docs, **NAMES)
    assert kept.columns == docs.columns and sorted((str(r["doc.id"]), r["a.b"]) for r in kept.collect()) in ([("a1", 1), ("a3", 3), ("b", 5)], [("a1", 1), ("a3", 3), ("b", 6)])
    clean = secret_scan.redact(docs, table, **NAMES)
    assert clean.columns == docs.columns and sorted(r["a.b"] for r in clean.collect()) == [1, 1, 2, 3, 4, 5, 6]
    assert {r["the.text"] for r in clean.where("`a.b` IN (5, 6)").collect()} == {"key [SECRET] there"}
    cut = suffix_dedup.remove(docs, "the.text")
    assert cut.columns == docs.columns and {r["the.text"] for r in cut.where("`a.b` < 4").collect()} == {""}
    assert language_id.accepted(docs, **NAMES).columns == docs.columns


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    bare = spark.createDataFrame([(1, "only these columns"), (1, "only these columns"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, bare, "")
        assert out.count() and (name == "packing" or out.columns == bare.columns)
