"""Embeddings that are made once: a table of vectors by model and text, filled piece by piece by providers.

A provider turns distinct texts into vectors: ``LocalHash`` by hashing, ``Batches`` by any function of a list of texts that tasks call (``OpenAI`` and ``Ollama`` post to
a service, ``Child`` starts a program). A cache is a Parquet table partitioned by provider, model and length; its key is the text's SHA-256, so equal texts, in whatever
document, are made once, and a changed text is a new one.
"""

from __future__ import annotations

import json
import math
import subprocess
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import vectors
from lodestar.operators.store import Folder, shared_folder

ROW = "key string, embedding array<double>, space string"
#: Texts that one write makes; a run that is broken off loses the write that it was in, no more.
WRITE_ROWS = 100_000
#: Seconds that a service or program may take for one batch.
PATIENCE = 300


def key(text: Column) -> Column:
    """What a text is known by; a null one is the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


@dataclass(frozen=True)
class LocalHash:
    """Local-hash embeddings, of some hundred texts at a time in Arrow columns: hashing letter by letter in column expressions takes far longer."""

    dimensions: int = vectors.DIMENSIONS

    @property
    def space(self) -> str:
        return f"local-hash {self.dimensions}"

    def made(self, texts: DataFrame) -> DataFrame:
        """(key, embedding) of texts (key, text) whose keys differ."""
        dimensions = self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found = vectors.hash_matrix(part.column("text"), dimensions)
                    lists = pa.ListArray.from_arrays(pa.array(range(0, found.size + 1, dimensions), pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "embedding"])

        return texts.select("key", "text").mapInArrow(run, "key string, embedding array<double>")


@dataclass(frozen=True)
class Batches:
    """Embeddings by ``embed``, a function of a list of texts that is called in tasks, ``size`` texts at a time; they are scaled to length 1, zeros stay zeros."""

    name: str
    model: str
    embed: Callable[[list[str]], list[list[float]]] = field(repr=False)
    size: int = 32

    @property
    def space(self) -> str:
        return f"{self.name} {self.model}"

    def made(self, texts: DataFrame) -> DataFrame:
        embed, size, name = self.embed, self.size, self.space

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    found = embed(part.column("text").to_pylist())
                    if len(found) != part.num_rows:
                        raise ValueError(f"{name}: {len(found)} vectors for {part.num_rows} texts")
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([_unit(v, name) for v in found], pa.list_(pa.float64()))], names=["key", "embedding"])

        return texts.select("key", "text").mapInArrow(run, "key string, embedding array<double>")


def _unit(vector: list[float], name: str) -> list[float]:
    length = math.sqrt(sum(float(x) * float(x) for x in vector))
    if not vector or not math.isfinite(length):
        raise ValueError(f"{name}: a vector is empty or has entries that are no numbers")
    return [float(x) / (length or 1.0) for x in vector]


def _posted(url: str, body: dict, headers: dict[str, str]) -> dict:
    """The service's answer; one that is no success raises, and Spark tries the task again."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=PATIENCE) as answer:
        return json.loads(answer.read())


@dataclass(frozen=True)
class OpenAI:
    """Embeddings of a service with this interface; vectors are ordered by their index."""

    model: str
    secret: str = field(repr=False)
    url: str = "https://api.openai.com/v1/embeddings"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        data = _posted(self.url, {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.secret}"})["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    def provider(self, size: int = 32) -> Batches:
        return Batches("openai", self.model, self, size)


@dataclass(frozen=True)
class Ollama:
    model: str
    host: str = "http://127.0.0.1:11434"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return _posted(f"{self.host.rstrip('/')}/api/embed", {"model": self.model, "input": texts}, {})["embeddings"]

    def provider(self, size: int = 32) -> Batches:
        return Batches("ollama", self.model, self, size)


@dataclass(frozen=True)
class Child:
    """Embeddings of a program that reads {"rows": [{id, text}]} and writes {"embeddings": [{id, embedding}]}, in any order."""

    model: str
    command: tuple[str, ...]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        rows = [{"id": str(k), "text": t} for k, t in enumerate(texts)]
        done = subprocess.run(self.command, input=json.dumps({"rows": rows}), capture_output=True, text=True, timeout=PATIENCE, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} ended with status {done.returncode}: {done.stderr.strip()[-500:]}")
        found = {r["id"]: r["embedding"] for r in json.loads(done.stdout)["embeddings"]}
        return [found[r["id"]] for r in rows]

    def provider(self, size: int = 256) -> Batches:
        return Batches("child", self.model, self, size)


class EmbeddingCache:
    """The cache at ``path``; one writer at a time for a provider's vectors, any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def held(self, provider: LocalHash | Batches) -> DataFrame:
        """(key, embedding) of what is there; only the provider's own folder is read."""
        if not Folder(self.spark, self.path).names():
            return self.spark.createDataFrame([], "key string, embedding array<double>")
        return self.spark.read.schema(ROW).parquet(self.path).where(F.col("space") == provider.space).select("key", "embedding")

    def fill(self, docs: DataFrame, provider: LocalHash | Batches, *, write_rows: int = WRITE_ROWS) -> int:
        """Makes the vectors that texts of ``docs`` (text) lack; how many that were.

        Work is what has no key in the table yet, cut into pieces of some ``write_rows`` texts each. A piece is one write that is visible whole or not at all,
        so a run that is broken off, and then started again, makes nothing again that was written. Equal and null texts are one, further columns are ignored, and no rows are no work.
        """
        wanted = docs.select(key(F.col("text")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["key"])
        at = f"{shared_folder(self.spark)}/embed-{uuid.uuid4()}"
        folder = Folder(self.spark, at)
        try:
            # the tasks that find texts apart also write them, a folder each, so texts are shuffled once
            wanted.join(self.held(provider).select("key"), "key", "left_anti").withColumn("task", F.spark_partition_id()).write.partitionBy("task").parquet(f"{at}/work")
            work = self.spark.read.schema("key string, text string, task int").parquet(f"{at}/work")
            n = work.count()
            pieces = -(-n // write_rows)
            folders = len([f for f in Folder(self.spark, f"{at}/work").names() if f.startswith("task=")])
            by = F.col("task") if folders >= pieces else F.xxhash64("key")  # folders of a piece alone are read, if there are enough
            for k in range(pieces):
                made = provider.made(work.where(F.pmod(by, F.lit(pieces)) == k).select("key", "text")).select("key", "embedding", F.lit(provider.space).alias("space"))
                made.write.mode("append").partitionBy("space").parquet(self.path)
            return n
        finally:
            folder.delete()

    def lookup(self, docs: DataFrame, provider: LocalHash | Batches) -> DataFrame:
        """(id, embedding) of each row of ``docs`` (id, text), null for a text that wasn't made."""
        return docs.select("id", key(F.col("text")).alias("key")).join(self.held(provider), "key", "left").select("id", "embedding")

    def embedded(self, docs: DataFrame, provider: LocalHash | Batches, **options) -> DataFrame:
        """``lookup`` after ``fill``."""
        self.fill(docs, provider, **options)
        return self.lookup(docs, provider)

    def drop(self) -> None:
        Folder(self.spark, self.path).delete()
