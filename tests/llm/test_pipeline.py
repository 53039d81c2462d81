"""The pipeline's stages against what the operators' plain versions say, and its whole run."""

import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from glyphflow.llm.common import checkpoint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 9000))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    extra = [(9100, f"before {item} after and more words here", "en", "s", 1), (9101, "12 34 !!", "en", "s", 1), (9102, None, None, None, None), (9103, "The that with mail me at joe@example.com please and thanks", "en", "s", 1)]
    sample = sample.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        sample = checkpoint(stage(spark, sample, sf))
        kept[name] = {r["doc_id"]: r for r in sample.collect()}
        if name != "pieces":
            assert sample.columns == COLUMNS
    assert not {9101, 9102} & kept["language"].keys() and 9100 in kept["language"]
    assert not {9000, 9001, 9002} & kept["near_duplicates"].keys() and {0, 1, 2} <= kept["near_duplicates"].keys()
    assert 9100 in kept["near_duplicates"] and 9100 not in kept["decontamination"] and 9103 in kept["decontamination"]
    assert kept["personal_data"].keys() == kept["decontamination"].keys()
    assert "joe@" not in kept["personal_data"][9103]["text"] and "<EMAIL>" in kept["personal_data"][9103]["text"]
    assert kept["personal_data"][9103]["n_chars"] == len(kept["personal_data"][9103]["text"])
    assert kept["pieces"].keys() == kept["personal_data"].keys()
    assert all(r["n_pieces"] == len(r["piece_ids"]) > 0 for r in kept["pieces"].values())


def test_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0


def test_sql_twins(spark, sf):
    import duckdb

    from glyphflow.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, sf), c.sql(sql)
        order = sorted(df.columns)
        assert order == sorted(want.columns), name
        got = sorted((tuple(r[k] for k in order) for r in df.collect()), key=repr)
        assert got == sorted((tuple(r[want.columns.index(k)] for k in order) for r in want.fetchall()), key=repr), name


def test_op1_columns(spark, sf):
    from glyphflow.llm import sharding

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in sharding.query(spark, sf).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        assert re.fullmatch("key", r["law"])
