import hashlib
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.sources import corpora as C

TAGGED = "noise before\n.I 7\n.T\nfirst title\nsecond line\n.A\nan author\n.B\nbib\n.W\nsome   text\n.X unknown marker\n.I 9\n.T\n.A\n.B\n.W\nother text\n"
QUERIES = ".I 10\n.W\nwhat  is\nlift\n.I 20\n.W\ndrag\n"
QRELS = "1 1 4\n1 2 -1\n\n2 2 3\n1 1 5\n"


def files(spark, text):
    return spark.createDataFrame([("f", text)], "path string, value string")


def test_tagged_records(spark):
    docs = {r.id: r for r in C.tagged_documents(files(spark, TAGGED)).collect()}
    assert docs["7"].title == "first title second line" and docs["7"].abstract == "some text .X unknown marker"
    assert docs["7"].text == "first title second line an author bib some text .X unknown marker"
    assert docs["9"].title == "Cranfield document 9" and docs["9"].abstract == "other text"
    assert {r.query_id: r.query for r in C.tagged_queries(files(spark, QUERIES)).collect()} == {"1": "what is lift", "2": "drag"}


def test_qrels_and_evaluation_queries(spark, tmp_path):
    (tmp_path / "q").write_text(QRELS)
    qrels = C.qrels_lines(C.numbered_lines(spark, str(tmp_path / "q")))
    assert {(r.query_id, r.id): r.grade for r in qrels.collect()} == {("1", "1"): 5, ("1", "2"): -1, ("2", "2"): 3}
    whole = {r.query_id: r.qrels for r in C.evaluation_queries(spark.createDataFrame([("1", "a"), ("3", "b")], "query_id string, query string"), qrels).collect()}
    assert whole == {"1": {"1": 5, "2": -1}, "3": {}}
    (tmp_path / "bad").write_text("1 2\n")
    with pytest.raises(Exception, match="Invalid qrel line"):
        C.qrels_lines(C.numbered_lines(spark, str(tmp_path / "bad"))).collect()


def test_json_lines_and_tsv(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T1", "text": "x"}\n{"_id": "d2", "text": "y", "more": 1}\n')
    assert sorted(map(tuple, C.jsonl_corpus(spark, str(tmp_path / "corpus.jsonl")).collect())) == [("d1", "T1", "x"), ("d2", "", "y")]
    (tmp_path / "queries.jsonl").write_text("".join(f'{{"_id": "q{k}", "text": "t{k}"}}\n' for k in (10, 2, 1)))
    queries = C.jsonl_queries(spark, str(tmp_path / "queries.jsonl"))
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq10\td1\t1\nq2\td2\t0\nq10\td1\t2\n")
    qrels = C.tsv_qrels(spark, str(tmp_path / "test.tsv"))
    assert {(r.query_id, r.id): r.grade for r in qrels.collect()} == {("q10", "d1"): 2, ("q2", "d2"): 0}
    assert [r.query_id for r in C.judged_queries(queries, qrels).orderBy("place").collect()] == ["q2", "q10"]
    with pytest.raises(Exception, match="unknown query"):
        C.judged_queries(queries.where("query_id <> 'q2'"), qrels).collect()
    (tmp_path / "bad.tsv").write_text("q1\td1\tx\n")
    with pytest.raises(Exception, match="Invalid qrels grade"):
        C.tsv_qrels(spark, str(tmp_path / "bad.tsv")).collect()


def test_archives(spark, tmp_path):
    parts = {"cran.all.1400": TAGGED, "cran.qry": QUERIES, "cranqrel": QRELS}
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as archive:
        for name, text in parts.items():
            info = tarfile.TarInfo(f"dir/{name}")
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    found = C.tagged_archive(spark, str(tmp_path / "c.tar.gz"))
    assert found["documents"].count() == 2 and found["queries"].count() == 2 and found["qrels"].count() == 3
    C.check_counts(found, {"documents": 2, "queries": 2, "qrels": 3})
    with pytest.raises(ValueError, match="instead of"):
        C.check_counts(found)
    digest = hashlib.md5((tmp_path / "c.tar.gz").read_bytes()).hexdigest()
    assert C.verified(spark, str(tmp_path / "c.tar.gz"), {digest}) and not C.verified(spark, str(tmp_path / "c.tar.gz"), {"0"})
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("scifact/corpus.jsonl", "{}")
        archive.writestr("scifact/qrels/test.tsv", "a")
    assert {r["name"] for r in C.archive_files(spark, str(tmp_path / "b.zip")).collect()} == {"scifact/corpus.jsonl", "scifact/qrels/test.tsv"}
    with pytest.raises(ValueError, match="missing"):
        C.tagged_archive(spark, str(tmp_path / "b.zip"))


def test_sinks_and_resume(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", None)], "id string, text string")
    lines = sorted(r.value for r in C.bulk_payload(docs, "idx").collect())
    assert lines[0] == '{"index":{"_index":"idx","_id":"1"}}\n{"id":"1","text":"a"}'
    assert [r.id for r in C.resumed(docs, docs.where("id = '1'")).collect()] == ["2"]


def test_candidates_of_qrels_are_all_containing_documents(spark, sf_dir):
    docs = C.table_documents(C.read_table(spark, f"{sf_dir}/documents.parquet"))
    queries = C.table_queries(C.read_table(spark, f"{sf_dir}/benchmark.parquet"))
    got = {(r.query_id, r.id) for r in C.table_qrels(docs, queries, C.read_table(spark, f"{sf_dir}/labels.parquet")).collect()}
    texts = docs.select("id", "text").collect()
    assert got == {(q.query_id, d.id) for q in queries.collect() for d in texts if q.query in d.text} and got
    assert docs.where(F.col("title").contains("\n")).isEmpty()
