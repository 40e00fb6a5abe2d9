"""A stored vector index: lists by nearest centre as folders, with short codes beside the vectors, and bounds that make its search exact.

Each vector is in the list of its nearest centre; there are about half the root of the rows' number of lists, so that lists and rows of a list grow alike. Beside the
vector stands a code: what is left after the centre is taken off, in 4 bits a dimension times a scale, and how far code and vector are apart. A query's product with
a vector then lies within that distance (times the query's length) of its product with the code, and its products with a list within the list's radius of that with the
centre. So a search reads codes only, an eighth of the vectors' bytes: first of the lists that promise most, then of those whose bound reaches the k-th best lower
bound, and folders of the others are never opened. Vectors are read for what may still be among the k best.

``rerank`` takes that many of the best codes a query instead of all that bounds leave: a search of fixed cost, whose recall the registered queries measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.index import small
from lodestar.operators.retrieval import top_k
from lodestar.operators.store import materialized

#: Vectors that centres are fitted on, on average over hashes of ids, and rounds of fitting. Every row is indexed.
SAMPLE, ROUNDS = 20_000, 8
MOST_LISTS = 4096
#: Queries that are compared at a time, and the share of lists that are read first.
BLOCK, FIRST = 2048, 1 / 16
#: What rounding may add to a score or a bound.
SLACK = 2e-6
_OPTIONS = {"parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "512", "compression": "zstd"}


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; those that are shorter end in zeros, and those that are longer than ``width`` are cut."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == most).all():
        return flat.reshape(len(lengths), most)
    out = np.zeros((len(lengths), max(most, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :most]


def _centres(points: np.ndarray, lists: int) -> np.ndarray:
    """k-means over a sample, from points evenly spread over it."""
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(ROUNDS):
        own = _nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))[:, None]
        np.add.at(sums, own, points)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def coded(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, scales, distances) of what is left of vectors: two dimensions a byte, each from -7 to 7."""
    scale = np.abs(rest).max(axis=1, initial=0.0) / 7
    code = np.rint(rest / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
    apart = np.linalg.norm(rest - code * scale[:, None], axis=1)
    even = np.pad(code + 8, ((0, 0), (0, code.shape[1] % 2)), constant_values=8).astype(np.uint8)
    return even[:, ::2] << 4 | even[:, 1::2], scale, apart


def decoded(packed: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.float32)
    out[:, ::2], out[:, 1::2] = (packed >> 4).astype(np.float32) - 8, (packed & 15).astype(np.float32) - 8
    return out[:, :width]


class VectorIndex:
    """What ``build`` wrote at ``path``; the driver holds centres, radii and sizes of lists, ``MOST_LISTS`` rows at most."""

    def __init__(self, spark: SparkSession, path: str, kind: str) -> None:
        self.spark, self.path = spark, path
        told = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        self.width = len(told[0]["centre"]) if told else 0
        self.centres = np.array([r["centre"] for r in told]).reshape(len(told), self.width)
        sizes = {r["list"]: (r["n"], r["radius"]) for r in spark.read.parquet(f"{path}/sizes").collect()}
        self.sizes = np.array([sizes.get(k, (0, 0.0))[0] for k in range(len(told))], np.int64)
        self.radii = np.array([sizes.get(k, (0, 0.0))[1] for k in range(len(told))])
        self.rows = spark.read.schema(f"row long, id string, embedding {kind}, code binary, scale double, apart double, list int").parquet(f"{path}/lists")

    @classmethod
    def build(cls, documents: DataFrame, path: str, *, lists: int | None = None) -> VectorIndex:
        """Writes the index of ``documents`` (id, embedding); null vectors are left out. Vectors of other lengths meet over the shorter one, as elsewhere."""
        spark = documents.sparkSession
        own = documents.select(F.col("id").cast("string").alias("id"), "embedding").where("embedding is not null")
        kind = own.schema["embedding"].dataType.simpleString()
        n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        share = min(1.0, SAMPLE / max(n, 1))
        taken = own.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).orderBy("id").limit(2 * SAMPLE).toArrow()
        points = matrix(taken.column("embedding"), width) if taken.num_rows else np.zeros((min(n, 1), width))
        centres = _centres(points, min(lists or max(1, round(n**0.5 / 2)), MOST_LISTS)) if len(points) else points
        told = pa.table({"list": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})
        spark.createDataFrame(told).write.parquet(f"{path}/centres")
        shared = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = matrix(batch.column("embedding"), width)
                which = _nearest(points, middle)
                rest = points - middle[which]
                code, scale, apart = coded(rest)
                far = np.linalg.norm(rest, axis=1)
                columns = [batch.column("id"), batch.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(apart), pa.array(far), pa.array(which.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "code", "scale", "apart", "far", "list"])

        dealt = own.mapInArrow(run, f"id string, embedding {kind}, code binary, scale double, apart double, far double, list int")
        dealt = dealt.withColumn("row", F.xxhash64("id"))
        dealt.repartition("list", F.pmod("row", F.lit(max(1, spark.sparkContext.defaultParallelism // 4)))).sortWithinPartitions("list", "row").write.options(**_OPTIONS).partitionBy("list").parquet(f"{path}/lists")
        written = spark.read.schema("far double, list int").parquet(f"{path}/lists") if n else spark.createDataFrame([], "far double, list int")
        written.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).write.parquet(f"{path}/sizes")
        return cls(spark, path, kind)

    def _codes(self, vectors: np.ndarray, wanted: np.ndarray, bar: np.ndarray, k: int, rerank: int | None) -> DataFrame:
        """(query, list, row, lower, upper): of the wanted lists of each query, what may be among its ``k`` best, by each task's own view; or the ``rerank`` best codes."""
        lists = np.flatnonzero(wanted.any(axis=0)).tolist()
        shared = self.spark.sparkContext.broadcast((vectors, self.centres, wanted, bar))
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, centres, wanted, bar = shared.value
            length, most = np.linalg.norm(asked, axis=1), rerank or k
            best = np.full((len(asked), most), -np.inf)  # lower bounds, or products with codes
            low_bar = bar.copy()
            held: list[tuple] = []
            for batch in batches:
                which = batch.column("list").to_numpy()
                rows, scale, apart = (batch.column(c).to_numpy() for c in ("row", "scale", "apart"))
                code = decoded(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1), width) if batch.num_rows else np.zeros((0, width))
                for x in np.unique(which):
                    mine, own = np.flatnonzero(wanted[:, x]), np.flatnonzero(which == x)
                    product = (asked[mine] @ centres[x])[:, None] + (asked[mine] @ code[own].T) * scale[own]
                    slack = length[mine][:, None] * apart[own] if rerank is None else 0.0
                    lower, upper = product - slack, product + slack
                    keep = min(most, lower.shape[1])
                    both = np.concatenate([best[mine], -np.partition(-lower, keep - 1, axis=1)[:, :keep]], axis=1)
                    best[mine] = -np.partition(-both, most - 1, axis=1)[:, :most]
                    low_bar[mine] = np.maximum(low_bar[mine], best[mine].min(axis=1))
                    q, r = np.nonzero(upper + SLACK >= low_bar[mine][:, None])
                    held.append((mine[q], np.full(len(q), x), rows[own[r]], lower[q, r], upper[q, r]))
            columns = [np.concatenate([h[c] for h in held]) if held else np.zeros(0) for c in range(5)]
            still = columns[4] + SLACK >= low_bar[columns[0].astype(int)] if held else np.zeros(0, bool)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c[still]).cast(t) for c, t in zip(columns, types, strict=True)], names=["query", "list", "row", "lower", "upper"])

        some = self.rows.where(F.col("list").isin(lists)) if len(lists) < len(self.centres) else self.rows
        return some.select("list", "row", "code", "scale", "apart").mapInArrow(run, "query int, list int, row long, lower double, upper double")

    def _left(self, vectors: np.ndarray, k: int, rerank: int | None) -> DataFrame:
        """(query, list, row): the rows whose vectors are read."""
        middle, length = vectors @ self.centres.T, np.linalg.norm(vectors, axis=1)
        bound = middle + length[:, None] * self.radii
        order = np.argsort(-bound, axis=1)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order[:, : max(1, round(len(self.centres) * FIRST))], True, axis=1)
        none = np.full(len(vectors), -np.inf)
        if rerank is not None:
            found = self._codes(vectors, np.ones(bound.shape, bool), none, k, rerank)
            order_of = Window.partitionBy("query").orderBy(F.col("upper").desc(), "row")
            return found.withColumn("r", F.row_number().over(order_of)).where(F.col("r") <= rerank).select("query", "list", "row").distinct()
        ranked = Window.partitionBy("query").orderBy(F.col("lower").desc())
        kth = lambda df: df.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query", F.col("lower").alias("bar"))
        near = self._codes(vectors, first, none, k, None)
        bar = none.copy()
        for row in kth(near).collect():  # a row a query
            bar[row["query"]] = row["bar"]
        rest = ~first & (bound + SLACK >= bar[:, None]) & (self.sizes > 0)
        found = materialized(near.unionAll(self._codes(vectors, rest, bar, k, None)))  # narrow rows, read twice
        last = small(kth(found))
        return found.join(last, "query", "left").where(F.col("bar").isNull() | (F.col("upper") + SLACK >= F.col("bar"))).select("query", "list", "row").distinct()

    def nearest(self, queries: DataFrame, k: int, *, rerank: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` rows with the largest dot product with each query (query_id, embedding), exactly unless ``rerank`` is given.

        Scores are rounded to 6 digits before they order; ties go by id.
        """
        found = None
        for names, vectors in self._blocks(queries):
            part = self._products(self._left(vectors, k, rerank), vectors, names)
            found = part if found is None else found.unionAll(part)
        return top_k(found, k) if found is not None else self.spark.createDataFrame([], "query_id string, id string, score double, rank int")

    def products(self, queries: DataFrame, k: int, *, rerank: int | None = None) -> DataFrame:
        """(query_id, products, n_rows): how many vectors a query is multiplied with, of how many rows."""
        found = None
        for names, vectors in self._blocks(queries):
            told = self.spark.createDataFrame(list(enumerate(names)), "query int, query_id string")
            part = self._left(vectors, k, rerank).groupBy("query").agg(F.count("*").alias("products")).join(F.broadcast(told), "query").select("query_id", "products", F.lit(int(self.sizes.sum())).cast("long").alias("n_rows"))
            found = part if found is None else found.unionAll(part)
        return found if found is not None else self.spark.createDataFrame([], "query_id string, products long, n_rows long")

    def _products(self, left: DataFrame, vectors: np.ndarray, names: list[str]) -> DataFrame:
        shared, width = self.spark.sparkContext.broadcast((vectors, names)), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, names = shared.value
            for batch in batches:
                which = batch.column("query").to_numpy()
                score = np.floor(np.einsum("ij,ij->i", matrix(batch.column("embedding"), width), asked[which]) * 1e6 + 0.5) / 1e6
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in which], pa.string()), batch.column("id"), pa.array(score)], names=["query_id", "id", "score"])

        own = self.rows.select("list", "row", "id", "embedding")
        return own.join(left, ["list", "row"]).select("query", "id", "embedding").mapInArrow(run, "query_id string, id string, score double")

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
        """Blocks of the query set, streamed, cut to the index's width."""
        if not len(self.centres):
            return
        names, vectors = [], []
        for row in queries.where("embedding is not null").select(F.col("query_id").cast("string"), "embedding").toLocalIterator():
            names.append(row[0])
            vectors.append(row[1])
            if len(names) == BLOCK:
                yield names, matrix(pa.array(vectors, pa.list_(pa.float64())), self.width)
                names, vectors = [], []
        if names:
            yield names, matrix(pa.array(vectors, pa.list_(pa.float64())), self.width)
