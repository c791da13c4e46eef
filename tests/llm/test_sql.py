"""Queries against their SQL on a whole small table."""

import pytest
from oracle import same

from folioflow.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    assert len(set(same(registry.QUERIES[name], registry.SQL[name], spark, sf))) > 1


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, sf, name, tmp_path):
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_langid", "op2_decontaminate", "op3_substring_dedup", "op4_mix", "op7_near_dedup", "op9_pii", "op10_quality", "op11_resample", "op12_periodic_runs", "op13_pack"])
def test_null_columns_and_repeated_rows(spark, sf, name, tmp_path):
    """A row of nulls, one with only an id, and a repeated row: each gives its rows, and the others' results stay."""
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    more = spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", None, "src0", 0)], d.schema)
    d.unionByName(more).unionByName(d.where("doc_id = 3")).withColumn("score", d["text"]).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if name != "op2_decontaminate":
        assert len([r for r in out if not (name == "op13_pack" and r["piece"])]) == 44
        assert {r["doc_id"] for r in out} >= {None, 10**9, 10**9 + 1}
        assert len({repr([r[c] for c in r.__fields__ if c not in ("sequence_id", "offset", "rank")]) for r in out if r["doc_id"] == 3}) == 1
