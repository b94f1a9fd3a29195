from tests.compare import SF, same

import __spark_entry__
import corpus_pipeline
from tidewell.llm import registry


def test_names_and_sql(spark):
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 11))} and names <= set(__spark_entry__.queries())
    for name, sql in registry.oracle_sql().items():
        same(registry.queries()[name](spark, SF), sql)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in docs.collect()}
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert kept <= ids and len(kept) > 0.7 * len(ids)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near", "repeats", "secrets", "packing"]
