"""Readers of retrieval collections. Schemas are explicit; what is malformed raises."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import text as tx

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "dataset", "title", "abstract", "text", "source")] + [T.StructField("indexed_at", T.TimestampType())])
# Markers of tagged records, names within the archive, its size.
MARKERS = {".T": "title", ".A": "author", ".B": "bib", ".W": "text"}
ARCHIVE_MEMBERS = {"documents": "cran.all.1400", "queries": "cran.qry", "qrels": "cranqrel"}
EXPECTED = {"documents": 1400, "queries": 225, "qrels": 1837}


def tagged_records(text: DataFrame, markers: dict[str, str]) -> DataFrame:
    """(path, at, record_id, one text column per marker) from files of ``.I`` records: ``text`` has (path, value), a file's whole text a row.

    What stands before the first ``.I`` is left out; lines that look like other markers are content.
    """
    records = text.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n")), r"\n\.I[ \t]+")).alias("at", "record")).where("at > 0")
    name = F.trim(F.substring_index("record", "\n", 1))
    content = F.concat(F.lit("\n"), F.substr("record", F.length(F.substring_index(F.col("record"), "\n", 1)) + 2), F.lit("\n"))
    stop = "|".join(m.replace(".", r"\.") for m in markers)

    def section(marker: str) -> Column:
        parts = F.regexp_extract_all(content, F.lit(rf"(?s)\n{marker.replace('.', chr(92) + '.')}[ \t]*(?=\n)(.*?)(?=\n(?:{stop})[ \t]*\n|\n?$)"), 1)
        return F.trim(F.array_join(parts, "\n"))

    return records.select("path", "at", name.alias("record_id"), *[section(m).alias(c) for m, c in markers.items()])


def tagged_documents(text: DataFrame, dataset: str = "cranfield", source: str = "glasgow-cranfield-1400", indexed_at: Column | None = None) -> DataFrame:
    records = tagged_records(text, MARKERS)
    title = tx.clean(F.col("title"))
    named = F.when(title == "", F.concat(F.lit("Cranfield document "), "record_id")).otherwise(title)
    joined = F.concat_ws("\n", named, *[F.nullif(F.col(c), F.lit("")) for c in ("author", "bib", "text")])
    return records.select(F.col("record_id").alias("id"), F.lit(dataset).alias("dataset"), named.alias("title"), tx.clean(F.col("text")).alias("abstract"), tx.clean(joined).alias("text"), F.lit(source).alias("source"), (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"))


def tagged_queries(text: DataFrame) -> DataFrame:
    """(query_id, query): a query's id is its place in the file, from 1, not the number that it is tagged with."""
    records = tagged_records(text, {".W": "text"})
    return records.select(F.col("at").cast("string").alias("query_id"), tx.clean(F.col("text")).alias("query"))


def qrels_lines(lines: DataFrame) -> DataFrame:
    """(query_id, id, grade) from lines (value, and at, the line's number) of three words; others but blank ones raise; the last of a pair counts."""
    words = F.split(F.trim("value"), r"\s+")
    told = lines.where(F.trim("value") != "").select("at", F.when(F.size(words) >= 3, words).otherwise(F.raise_error(F.concat(F.lit("Invalid qrel line: "), "value")).cast("array<string>")).alias("w"))
    rows = told.select("at", F.get("w", 0).alias("query_id"), F.get("w", 1).alias("id"), F.regexp_extract(F.get("w", 2), r"^[+-]?\d+", 0).cast("int").alias("grade"))
    return rows.groupBy("query_id", "id").agg(F.max_by("grade", "at").alias("grade"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): a file's lines in order. Judgement files are small, and one whole file is one row."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def evaluation_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """All queries, with their judgements as a map (empty without any)."""
    maps = qrels.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "grade")))).alias("qrels"))
    return queries.join(maps, "query_id", "left").withColumn("qrels", F.coalesce("qrels", F.create_map().cast("map<string,int>")))


def jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) from JSON lines; a title or text that is missing is empty."""
    rows = spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_id").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "text")])


def jsonl_queries(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, query) from JSON lines, of the queries in ``asked`` (query_id) only, if given: their lines are picked as they are read."""
    rows = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(path)
    if asked is not None:
        rows = rows.join(asked.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_semi")
    return rows.select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id, grade) from tab-separated lines, with or without a header; a grade that is no number raises; the last of a pair counts."""
    w = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("at", *[F.trim(F.get(w, k)).alias(n) for k, n in enumerate(("query_id", "id", "score"))])
    rows = rows.where("query_id <> '' and query_id <> 'query-id'")
    grade = F.coalesce(F.expr("try_cast(score as double)"), F.raise_error(F.concat(F.lit("Invalid qrels grade for query "), "query_id")).cast("double"))
    return rows.withColumn("grade", grade).groupBy("query_id", "id").agg(F.max_by("grade", "at").cast("int").alias("grade"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(place, query_id, query) of the judged queries only, in natural order (q2 before q10); a judged query that is unknown raises."""
    asked = qrels.select("query_id").distinct().join(queries, "query_id", "left")
    text = F.coalesce("query", F.raise_error(F.concat(F.lit("Qrels reference unknown query "), "query_id")))
    key = F.array_join(F.transform(F.regexp_extract_all("query_id", F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")
    return asked.select("query_id", text.alias("query"), F.row_number().over(Window.orderBy(key, "query_id")).alias("place"))


def tar_members(content: bytes) -> dict[str, bytes]:
    """Files of a tar archive, compressed or not, by base name."""
    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
        return {m.name.rsplit("/", 1)[-1]: archive.extractfile(m).read() for m in archive.getmembers() if m.isfile()}


def zip_members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return {n: archive.read(n) for n in archive.namelist() if not n.endswith("/")}


def unpacked(archives: DataFrame) -> DataFrame:
    """(archive, name, content) of the members of zip and tar archives (path, content), one row each, unpacked by the tasks that hold them."""

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, n, c) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for n, c in (zip_members(raw) if raw[:2] == b"PK" else tar_members(raw)).items()]
            yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return archives.select("path", "content").mapInPandas(unpack, "archive string, name string, content binary")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The members of all archives at a path."""
    return unpacked(spark.read.format("binaryFile").load(path))


def tagged_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents, queries and judgements of the tagged collection's archive; raises if one of its files is missing."""
    files = archive_files(spark, path)
    there = {r["name"] for r in files.select("name").collect()}
    if not set(ARCHIVE_MEMBERS.values()) <= there:
        raise ValueError("the archive is missing documents, queries, or qrels")
    text = lambda part: files.where(F.col("name") == ARCHIVE_MEMBERS[part]).select(F.col("archive").alias("path"), F.decode("content", "UTF-8").alias("value"))
    lines = text("qrels").select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return {"documents": tagged_documents(text("documents")), "queries": tagged_queries(text("queries")), "qrels": qrels_lines(lines)}


def verified(spark: SparkSession, path: str, digests: set[str]) -> bool:
    """Whether all files at a path have one of the accepted MD5 digests."""
    return spark.read.format("binaryFile").load(path).where(~F.md5("content").isin(*digests)).isEmpty()


def check_counts(parts: dict[str, DataFrame], expected: dict[str, int] = EXPECTED) -> None:
    for name, n in expected.items():
        if (found := parts[name].count()) != n:
            raise ValueError(f"{name}: {found} rows instead of {n}")


def bulk_payload(docs: DataFrame, index: str) -> DataFrame:
    """(value): two lines of JSON per document, an action and the document, to be written as text."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("id").alias("_id")).alias("index")))
    return docs.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*docs.columns))).alias("value"))


def embedding_input(docs: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """Writes what an external model embeds, as JSON lines (id, text): documents with their titles, and the judged queries of a split."""
    title = F.coalesce("title", F.lit(""))
    text = F.concat(F.when(title != "", F.concat(title, F.lit("\n"))).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    docs.select("id", text.alias("text")).write.mode("errorifexists").json(f"{path}/documents")
    judged = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    judged.select(F.col("query_id").alias("id"), F.col("query").alias("text")).write.mode("errorifexists").json(f"{path}/queries")


def resumed(work: DataFrame, done: DataFrame) -> DataFrame:
    """What of ``work`` (id) isn't among ``done`` yet."""
    return work.join(done.select("id"), "id", "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one of fewer files than cores (a file may be a single row group, one task's work) is dealt out to all cores."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 64) else df


# --- the driver tables as a collection


def table_documents(documents: DataFrame, dataset: str | None = None) -> DataFrame:
    """(id, title, abstract, text): the first line is the title, the rest the abstract; with the column ``dataset`` as their dataset, if given."""
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, "\n", 1)
    return documents.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.substr(text, F.length(title) + 2).alias("abstract"), text.alias("text"), *([] if dataset is None else [F.col(dataset).alias("dataset")]))


def table_queries(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def table_qrels(docs: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, id, grade): documents that hold the query's text, graded by label: toxic -1, good 3, unlabelled 2, poor 1.

    Candidates come from the longest inner word of each query, which a document must have as a token, not from all pairs. Queries of fewer than
    three words have no inner word; they go to each document as one list.
    """
    from lodestar.operators.index import small

    words = tx.tokens(F.col("query"))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    key = F.element_at(F.sort_array(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w")))), -1)["w"]
    asked = queries.where(F.size(words) >= 3).select("query_id", "query", key.alias("word"))
    each = docs.select("id", "text", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word"))
    found = each.join(small(asked), "word").where(F.contains("text", "query")).select("query_id", "id").distinct()
    short = queries.where(F.size(words) < 3).agg(F.collect_list(F.struct("query_id", "query")).alias("s"))
    held = docs.select("id", F.col("text"), F.explode(short.scalar()).alias("q")).where(F.contains("text", F.col("q.query"))).select("q.query_id", "id")
    found = found.unionByName(held.distinct())
    graded = found.join(labels.select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic"), "id", "left")
    grade = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 3).when(F.col("quality").isNull(), 2).otherwise(1)
    return graded.select("query_id", "id", grade.alias("grade"))
