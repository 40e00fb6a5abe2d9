"""Vector ranking and rank fusion.

Exact search (a stored index is in ``vectorindex``) compares a stated query set with all vectors: queries go out in blocks (arrays of at most ``BLOCK`` vectors, broadcast), and
each task keeps the best k of each query before anything is dealt out, so what is shuffled grows with queries and tasks, not with pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import text as tx
from lodestar.functions.numbers import min_max, number, round_half_up
from lodestar.operators.retrieval import top_k
from lodestar.operators.vectorindex import matrix

DIMENSIONS = 384
RRF_K = 60
#: Query vectors that one pass over the documents compares with.
BLOCK = 4096
#: Texts whose words a task holds at a time, fewer if these have more than ``SLICE_BYTES``, but one.
SLICE = 256
SLICE_BYTES = 4 << 20


def hash_features(docs: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, component, value): the sparse local-hash embedding of a text column, of unit length, rounded to 6 digits. Rows of one id are parts of one text.

    In column expressions, letter by letter, with a row a feature dealt out; ``hash_entries`` has the same rows sooner.
    """
    words = tx.embedding_tokens(F.col(text))
    single = F.transform(words, lambda t: F.struct(F.concat(F.lit("tok:"), t).alias("feature"), F.lit(1.0).alias("weight")))
    pairs = F.transform(tx.bigrams(words, ":"), lambda t: F.struct(F.concat(F.lit("bi:"), t).alias("feature"), F.lit(0.5).alias("weight")))
    each = docs.select("id", F.explode(F.concat(single, pairs)).alias("f")).groupBy("id", "f.feature").agg(F.sum("f.weight").alias("weight"))
    hashed = each.select("id", tx.fnv1a(F.col("feature")).alias("h"), "weight")
    sums = hashed.select("id", (F.col("h") % dimensions).cast("int").alias("component"), (F.when(F.col("h") % 2 == 1, 1.0).otherwise(-1.0) * F.col("weight")).alias("weight")).groupBy("id", "component").agg(F.sum("weight").alias("weight"))
    return _unit(sums)


def _unit(sums: DataFrame) -> DataFrame:
    """(id, component, value) of sums of weights (id, component, weight)."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return sums.withColumn("value", round_half_up(F.col("weight") / F.when(norm == 0, F.lit(1.0)).otherwise(norm), 6)).where("value <> 0").select("id", "component", "value")


def hash_entries(docs: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, component, value): the rows of ``hash_features``, made where the texts are. Ids are counted first: only if some repeat are sums dealt out, by id and component."""
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return _cells(docs, text, "value", lambda texts: hash_matrix(texts, dimensions))
    sums = _cells(docs, text, "weight", lambda texts: _hash_sums(texts, dimensions))
    return _unit(sums.groupBy("id", "component").agg(F.sum("weight").alias("weight")))


def _cells(docs: DataFrame, text: str, name: str, made: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(id, component, ``name``): cells other than 0 of the matrix that ``made`` makes of some texts."""
    schema = T.StructType([docs.schema["id"], T.StructField("component", T.LongType()), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text")):
                found = made(texts)
                row, component = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row + at)), pa.array(component), pa.array(found[row, component])], names=["id", "component", name])
                at += len(texts)

    return docs.select("id", F.col(text).alias("text")).mapInArrow(run, schema)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        n = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE_BYTES, "right")) - at
        n = min(max(n, 1), SLICE, len(texts) - at)
        yield texts.slice(at, n)
        at += n


def hash_embeddings(docs: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding): the same, as dense arrays, zeros for texts without tokens."""
    some = hash_features(docs, text, dimensions).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("component", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return docs.select("id").join(some, "id", "left").select("id", dense.alias("embedding"))


def hash_vectors(docs: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding): the rows of ``hash_embeddings``, made where the texts are: nothing is dealt out, and ``SLICE`` texts are in the making at a time."""

    def made(texts: pa.Array) -> pa.Array:
        own = [hash_matrix(texts.slice(k, SLICE), dimensions) for k in range(0, len(texts), SLICE)]
        flat = np.concatenate(own).ravel() if own else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dimensions, pa.int32()), pa.array(flat))

    return docs.select("id", F.arrow_udf(made, "array<double>")(F.col(text)).alias("embedding"))


def _fnv1a(states: np.ndarray, starts: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a states (uint32) after words of ASCII letters, a letter of all words at a time."""
    if not len(sizes):
        return states
    order = np.argsort(sizes.astype(np.min_scalar_type(sizes.max())), kind="stable")
    starts, sizes, hashes = starts[order], sizes[order], states[order]
    for k in range(int(sizes[-1])):
        n = int(np.searchsorted(sizes, k, "right"))  # from here on, words have more than k letters
        hashes[n:] = (hashes[n:] ^ letters[starts[n:] + k]) * np.uint32(16777619)
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _after(states: np.ndarray, letters: bytes) -> np.ndarray:
    """FNV-1a states after the same letters for all."""
    for letter in letters:
        states = (states ^ np.uint32(letter)) * np.uint32(16777619)
    return states


def _hash_sums(texts: pa.Array, dimensions: int) -> np.ndarray:
    """Sums of weights by component, a row a text. Words are coded once; a pair goes on from the state that its first word leaves."""
    lists = tx.arrow_tokens(texts)
    doc, coded = pc.list_parent_indices(lists).to_numpy(), lists.flatten().cast(pa.string()).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    if not len(words):
        return np.zeros((len(texts), dimensions))
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters, starts, sizes = np.frombuffer(words.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
    long = sizes[code] > 1
    doc, code = doc[long], code[long]
    same = doc[:-1] == doc[1:]
    first, second = code[:-1][same], code[1:][same]
    begun = np.full(len(words), 2166136261, np.uint32)
    single = _fnv1a(_after(begun, b"tok:"), starts, sizes, letters)
    opened = _after(_fnv1a(_after(begun, b"bi:"), starts, sizes, letters), b":")
    hashes = np.concatenate([single[code], _fnv1a(opened[first], starts[second], sizes[second], letters)])
    weight = np.concatenate([np.ones(len(code)), np.full(len(first), 0.5)])
    place = np.concatenate([doc, doc[:-1][same]]) * dimensions + hashes % dimensions
    return np.bincount(place, np.where(hashes % 2 == 1, weight, -weight), len(texts) * dimensions).reshape(len(texts), dimensions)


def hash_matrix(texts: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Local-hash embeddings of an Arrow column of texts, a row each: the same numbers as ``hash_embeddings``, for tasks that are in Python anyway."""
    sums = _hash_sums(texts, dimensions)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.floor(sums / np.where(length == 0, 1.0, length) * 1e6 + 0.5) / 1e6


def nearest(documents: DataFrame, queries: DataFrame, k: int, *, ignore_identical: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` documents (id, embedding) with the largest dot product with each query (query_id, embedding).

    Scores are rounded to 6 digits before they order; ties go by id. Vectors of different length meet over the shorter one.
    """
    spark = documents.sparkSession
    found = None
    for names, left in _blocks(queries, block):
        shared = spark.sparkContext.broadcast((names, left))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, left = shared.value
            held: list[list[tuple]] = [[] for _ in names]
            for batch in batches:
                ids = batch.column("id").to_pylist()
                right = matrix(batch.column("embedding"))
                if right.shape[1] > left.shape[1]:
                    left = np.pad(left, ((0, 0), (0, right.shape[1] - left.shape[1])))
                right = np.pad(right, ((0, 0), (0, left.shape[1] - right.shape[1])))
                scores = np.floor((left @ right.T) * 1e6 + 0.5) / 1e6
                for q, row in enumerate(scores):
                    # the k best of the batch, and all that are equal to the last of them
                    top = np.flatnonzero(row >= np.partition(row, -k - 1)[-k - 1]) if len(row) > k + 1 else range(len(row))
                    mine = [(-row[j], ids[j]) for j in top if not (ignore_identical and ids[j] == names[q])]
                    held[q] = heapq.nsmallest(k, held[q] + mine)
            rows = [(name, i, -s) for name, own in zip(names, held, strict=True) for s, i in own]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

        part = documents.select("id", "embedding").mapInArrow(best, "query_id string, id string, score double")
        found = part if found is None else found.unionAll(part)
    return top_k(found, k)


def _blocks(queries: DataFrame, block: int):
    """Blocks of the query set, streamed; one empty block if there are no queries."""
    names, vectors, any_ = [], [], False
    for row in queries.select("query_id", "embedding").toLocalIterator():
        names.append(row.query_id)
        vectors.append(row.embedding)
        if len(names) == block:
            any_ = True
            yield names, matrix(pa.array(vectors, pa.list_(pa.float64())))
            names, vectors = [], []
    if names or not any_:
        yield names, matrix(pa.array(vectors, pa.list_(pa.float64())))


def scaled(run: DataFrame, *keys: str) -> DataFrame:
    """``run`` with scaled: scores by query from 0 (least) to 1 (largest); equal scores are 0."""
    own = Window.partitionBy("query_id", *keys)
    score = number(F.col("score"))
    return run.withColumn("scaled", min_max(score, F.min(score).over(own), F.max(score).over(own)))


def blended(left: DataFrame, right: DataFrame, weights: list[tuple[float, float]], size: int) -> DataFrame:
    """(left_weight, right_weight, query_id, id, score, rank): weighted sums of scaled scores, a side that lacks a document counting 0."""
    a = scaled(left).select("query_id", "id", F.col("scaled").alias("a"))
    b = scaled(right).select("query_id", "id", F.col("scaled").alias("b"))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("w", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("left_weight"), F.lit(float(y)).alias("right_weight")) for x, y in weights])))
    score = round_half_up(F.col("w.left_weight") * number(F.col("a")) + F.col("w.right_weight") * number(F.col("b")), 6)
    scored = both.select(F.col("w.left_weight"), F.col("w.right_weight"), "query_id", "id", score.alias("score"))
    return top_k(scored, size, "left_weight", "right_weight")


def reciprocal_ranks(runs: list[tuple[DataFrame, list[float]]], size: int, k: int = RRF_K) -> DataFrame:
    """(variant, query_id, id, score, rank): sums of weight / (k + rank) over runs; the n-th weight of each run makes variant n."""
    k = k or RRF_K
    parts = None
    for run, weights in runs:
        each = run.select("query_id", "id", "rank", F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("variant", "weight"))
        parts = each if parts is None else parts.unionByName(each)
    summed = parts.groupBy("variant", "query_id", "id").agg(round_half_up(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))
    return top_k(summed, size, "variant")
