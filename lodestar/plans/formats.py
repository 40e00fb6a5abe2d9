"""Registered queries of readers and writers: the driver's tables are written in a collection's formats and read back.

All files go to the shared folder, a new one for each query. Where a reader takes whole files, the writer bounds their rows.
"""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators.store import shared_folder
from lodestar.sources import corpora

if TYPE_CHECKING:
    from lodestar.plans.queries import Tables

#: Documents of a file that is read as one row.
FILE_ROWS = 200
DATASET = "driver-tables"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4()}"


def _held(text: Column) -> Column:
    """A text as a tagged record holds it: no line of it starts with a point, so none is taken for a marker; white space is collapsed by the reader anyway."""
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", "\n "))


def tagged_collection(t: Tables) -> DataFrame:
    docs = t.docs.join(t.read("documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("source").alias("author")), "id")
    record = F.concat(F.lit(".I "), F.col("id"), F.lit("\n.T\n"), _held(F.col("title")), F.lit("\n.A\n"), _held(F.col("author")), F.lit("\n.B\n"), _held(F.col("lang")), F.lit("\n.W\n"), _held(F.col("abstract")))
    path = _folder(t, "tagged")
    docs.select(record.alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    found = corpora.tagged_documents(corpora.whole_files(t.spark, path), DATASET, "documents", F.lit("2000-01-01").cast("timestamp"))
    return found.select("id", "dataset", "title", F.md5("abstract").alias("abstract_md5"), F.md5("text").alias("text_md5"), "source")


def tagged_queries(t: Tables) -> DataFrame:
    """A query's id is its place in the one file; tags, which are to be ignored, are ten times the items' ids."""
    path = _folder(t, "queries")
    asked = t.read("benchmark").repartition(1).sortWithinPartitions("item_id")
    asked.select(F.concat(F.lit(".I "), (F.col("item_id") * 10).cast("string"), F.lit("\n.W\n"), _held(F.col("text"))).alias("value")).write.text(path)
    return corpora.tagged_queries(corpora.whole_files(t.spark, path))


def qrels_lines(t: Tables) -> DataFrame:
    """Each judgement after one that it supersedes, and with a blank line; then the map of a query's judgements."""
    path = _folder(t, "qrels")
    pair = F.concat_ws(" ", "query_id", "id")
    t.qrels().select(F.concat(pair, F.lit(" 9\n\n"), pair, F.lit("\t"), F.col("grade").cast("string")).alias("value")).write.option("maxRecordsPerFile", 10_000).text(path)
    judged = corpora.evaluation_queries(t.queries, corpora.qrels_lines(corpora.numbered_lines(t.spark, path)))
    told = F.array_sort(F.transform(F.map_entries("qrels"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return judged.select("query_id", F.size("qrels").cast("long").alias("judged"), F.array_join(told, ",").alias("judgements"))


def jsonl_corpus(t: Tables) -> DataFrame:
    path = _folder(t, "corpus")
    t.docs.select(F.col("id").alias("_id"), F.nullif("title", F.lit("")).alias("title"), "text", F.lit(1).alias("more")).write.json(path)
    return corpora.jsonl_corpus(t.spark, path).select("id", "title", F.md5("text").alias("text_md5"))


def judged_queries(t: Tables) -> DataFrame:
    """The queries that a file of tab-separated judgements names, in natural order, with the sum of their grades."""
    path = _folder(t, "split")
    t.queries.select(F.concat(F.lit("q"), "query_id").alias("_id"), F.col("query").alias("text")).write.json(f"{path}/queries")
    line = F.concat_ws("\t", F.concat(F.lit("q"), "query_id"), "id", F.col("grade").cast("string"))
    header = t.spark.range(1).select(F.lit("query-id\tcorpus-id\tscore").alias("value"))
    header.unionByName(t.qrels().select(line.alias("value"))).write.option("maxRecordsPerFile", 10_000).text(f"{path}/qrels")
    qrels = corpora.tsv_qrels(t.spark, f"{path}/qrels")
    judged = corpora.judged_queries(corpora.jsonl_queries(t.spark, f"{path}/queries", qrels), qrels)
    grades = qrels.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("grade").alias("grades"))
    return judged.join(grades, "query_id").select("query_id", F.col("place").cast("long").alias("place"), "query", "n", "grades")


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (name, content) two archives (path, content): names with an even number of characters zipped, others in a compressed tar."""
    for batch in batches:
        zipped, tarred = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z, tarfile.open(fileobj=tarred, mode="w:gz") as tar:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(name) % 2 == 0:
                    z.writestr(name, content)
                else:
                    info = tarfile.TarInfo(f"folder/{name}")
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
        yield pa.RecordBatch.from_arrays([pa.array(["zip", "tar"]), pa.array([zipped.getvalue(), tarred.getvalue()], pa.binary())], names=["path", "content"])


def archive_members(t: Tables) -> DataFrame:
    """Documents as members of archives, many small ones, unpacked again."""
    members = t.docs.select(F.concat("id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    found = corpora.unpacked(members.mapInArrow(_archives, "path string, content binary"))
    return found.select("name", F.col("archive").alias("kind"), F.md5("content").alias("content_md5"))


def bulk_payload(t: Tables) -> DataFrame:
    """The lines of a bulk payload, read back: actions name their index, documents their text."""
    path = _folder(t, "bulk")
    corpora.bulk_payload(t.docs.select("id", "title", "text"), DATASET).write.text(path)
    lines = t.spark.read.text(path).select(F.from_json("value", "index struct<_index: string, _id: string>, id string, title string, text string").alias("r"))
    action = F.col("r.index").isNotNull()
    return lines.select(F.when(action, "action").otherwise("document").alias("kind"), F.coalesce("r.index._id", "r.id").alias("id"), F.md5(F.when(action, F.col("r.index._index")).otherwise(F.concat_ws("\n", "r.title", "r.text"))).alias("content_md5"))


def embedding_input(t: Tables) -> DataFrame:
    path = _folder(t, "embed")
    corpora.embedding_input(t.docs.select("id", "title", F.col("abstract").alias("text")), t.queries, t.qrels(), path)
    read = lambda part: t.spark.read.schema("id string, text string").json(f"{path}/{part}")
    return read("documents").withColumn("kind", F.lit("document")).unionByName(read("queries").withColumn("kind", F.lit("query"))).select("kind", "id", F.md5("text").alias("text_md5"))


def resumed_work(t: Tables) -> DataFrame:
    """Documents that a run has yet to do which was broken off after those of one language."""
    done = t.read("documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"))
    return corpora.resumed(t.docs.select("id", F.length("text").cast("long").alias("n_chars")), done)


def text_forms(t: Tables) -> DataFrame:
    """What embedders and rerankers are given of each document."""
    forms = {
        "cleaned": tx.clean(F.col("text")),
        "whole": tx.embedding_text("full", "passage: "),
        "short": tx.embedding_text("title-abstract"),
        "body": tx.body(["abstract", "text"]),
        "feedback": tx.feedback_text(),
    }
    return t.docs.select("id", *[F.md5(c).alias(f"{n}_md5") for n, c in forms.items()])


FORMATS = [tagged_collection, tagged_queries, qrels_lines, jsonl_corpus, judged_queries, archive_members, bulk_payload, embedding_input, resumed_work, text_forms]
