"""Entries of local-hash embeddings, against column expressions and DuckDB's SQL."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.operators import vectors
from lodestar.plans.oracles import ORACLE_SQL
from lodestar.plans.queries import QUERIES


def test_entries_of_hash_embeddings_are_made_where_texts_are(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE_BYTES", 200)
    assert "hashpartitioning" not in QUERIES["local_hash_embedding"](spark, sf_dir)._jdf.queryExecution().toString()
    r = random.Random(9)
    texts = [None, "", "a", "one", "x" * 300 + " yy", "É KK " * 150] + [" ".join(r.choices(["wing", "é", "b", "Flow2", "of"], k=r.randint(0, 30))) for _ in range(600)]
    assert [t for part in vectors._slices(pa.array(texts, pa.string())) for t in part.to_pylist()] == texts
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    for ids in (range(len(texts)), [k // 2 if k % 7 else None for k in range(len(texts))]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, text string").repartition(3)
        for n in (7, 384):
            got = vectors.hash_entries(docs, "text", n)
            assert got.dtypes == [("id", "bigint"), ("component", "bigint"), ("value", "double")]
            assert rows(got) == rows(vectors.hash_features(docs, "text", n))
    assert vectors.hash_entries(docs.limit(0), "text").count() == 0


def test_rows_of_one_document_make_one_embedding(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") / 3).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    rows = lambda found: sorted(map(str, found))
    got = rows(map(tuple, QUERIES["local_hash_embedding"](spark, str(tmp_path)).collect()))
    assert len(got) > 10_000 and got == rows(con.sql(ORACLE_SQL["local_hash_embedding"]).fetchall())
