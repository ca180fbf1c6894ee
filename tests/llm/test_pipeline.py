"""The corpus pipeline, stage by stage and as a whole."""

import pytest
from edge_rows import ROWS, edge_docs
from pyspark.sql import functions as F
from test_pairs import brute_groups

import corpus_pipeline as cp
from foliotab.llm import decontaminate, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_by_brute_force(spark, documents):
    docs = documents
    toxic = cp.toxic_documents(spark, docs, SF)
    labelled = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    assert toxic.columns == cp.COLUMNS and 0 < toxic.count() < docs.count()
    assert docs.join(labelled, "doc_id").join(toxic, "doc_id", "left_anti").count() <= 0.03 * labelled.count()

    lines = cp.repeated_lines(spark, toxic, SF)
    kept = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == cp.COLUMNS and all(r["n_chars"] == len(r["text"]) for r in kept.values())
    whole = {r["doc_id"]: r["text"] for r in toxic.collect()}
    assert all(set(r["text"].split("\n")) <= set(whole[d].split("\n")) for d, r in kept.items())

    near = cp.near_copies(spark, toxic, SF)
    want, _ = brute_groups(whole, 5)
    assert {r["doc_id"] for r in near.collect()} == set(want.values())

    clean = cp.benchmark_leaks(spark, toxic, SF)
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(whole) - {r["doc_id"] for r in clean.collect()}
    assert gone == {d for d, t in whole.items() if any(i in decontaminate.normalise(t) for i in items)}


def test_run(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert rows.where("start = 0").count() > 50
    per = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.where("n > 1024").count() == 0


def test_stages_take_edge_rows(spark, tmp_path):
    docs = edge_docs(spark).select(*cp.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like any of these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cp.COLUMNS and 0 < out.count() <= len(ROWS), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_shard_twin(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op7_sharding"]).fetchall())
    assert sorted(tuple(r) for r in queries.op7_sharding(spark, SF).collect()) == want
