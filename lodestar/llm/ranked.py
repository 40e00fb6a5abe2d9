"""Ranked lexical search with range-maximum tables over posting lists.

A query's score of a document sums what its terms are worth there. A task holds documents in blocks, in ascending order of id, with a posting list a term and, over
each list, a sparse table that finds the largest worth in any range of it at once. An interval of documents can't hold a better score than the sum of its terms' largest
worths. So a query takes intervals best first: the document with the largest single worth is scored whole and splits its interval in two, which are bounded anew; intervals
that can't reach the k-th best score (or, at that very score, a smaller id) are left alone. Several of the best intervals are split at a time, which changes no result.

Texts are read once for a block of queries: each document's length and its counts of the queries' terms are stored, sums over all documents follow, and the search reads the
stored counts. The queries' terms are the only vocabulary that reaches the driver or the tasks, in blocks of bounded size. A task gives k rows a query.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import Rounds

K = 10
#: Distinct terms and queries that one pass over the documents answers, at most (a single longer query is a pass of its own).
BLOCK_TERMS, BLOCK_QUERIES = 100_000, 5_000
#: Documents and postings of a block, which a task holds in memory.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 13, 1 << 19
#: Intervals that are split at a time.
WIDTH = 48
SALT = 64
#: Bytes of a text that are cut into words at a time.
CUT = 1 << 20
# A term's characters are digits, letters and all beyond ASCII; only A-Z are lowered.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists that are short for a long text, too."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CUT) if at + CUT < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, terms): rows of one id are one query, and terms are distinct and sorted."""
    kind = to_arrow_type(queries.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[w.decode() for w in sorted({w for part in words((t or "").encode()) for w in part})] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query").cast(kind), pa.array(terms, pa.list_(pa.string()))], names=["query", "terms"])

    each = queries.select(F.col(f"`{id_col}`").alias("query"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = each.mapInArrow(run, f"query {queries.schema[id_col].dataType.simpleString()}, terms array<string>")
    return kept.groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def counted(docs: DataFrame, vocabulary: dict[bytes, int], *, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of each document that has a term at all: its length, and how often it has which terms of ``vocabulary``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch in batches:
            texts, lengths, found = batch.column("text"), [], []
            for k in range(len(texts)):
                counts, n = Counter(), 0
                for part in words(texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""):
                    n += len(part)
                    counts.update(map(find, part))
                counts.pop(None, None)
                lengths.append(n)
                found.append(counts)
            some = [k for k, n in enumerate(lengths) if n]
            columns = [batch.column("id").cast(kind).take(pa.array(some, pa.int64())), pa.array([lengths[k] for k in some], pa.int64())]
            columns += [pa.array([list(found[k].keys()) for k in some], pa.list_(pa.int32())), pa.array([list(found[k].values()) for k in some], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, terms array<int>, counts array<long>")


# --- one block of documents


@dataclass
class Lists:
    """Posting lists of a block, one after the other by term, and the places of range maxima: ``table[j][i]`` is that of [i, i + 2**j)."""

    keys: np.ndarray
    worth: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    table: np.ndarray
    size: int

    @classmethod
    def of(cls, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, size: int, n_terms: int) -> Lists:
        order = np.lexsort((doc, term))
        doc, term, worth = doc[order], term[order], worth[order]
        begin, end = np.searchsorted(term, np.arange(n_terms)), np.searchsorted(term, np.arange(n_terms), "right")
        levels = [np.arange(len(term), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= (end - begin).max(initial=0):
            half, last = 1 << (len(levels) - 1), levels[-1]
            level = last.copy()
            level[: len(last) - half] = np.where(worth[last[half:]] > worth[last[:-half]], last[half:], last[:-half])
            levels.append(level)
        return cls(term.astype(np.int64) * size + doc, worth, begin, end, np.stack(levels), size)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place of the largest worth in each [low, high); any place where that is empty."""
        level = np.frexp(np.maximum(high - low, 1))[1] - 1
        last = max(len(self.worth) - 1, 0)
        left = self.table[level, np.minimum(low, last)]
        right = self.table[level, np.clip(high - (1 << level), 0, last)]
        return np.where(self.worth[right] > self.worth[left], right, left)


class Best:
    """The k best of a query so far, by score and then id (null last)."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def bar(self, ids: list[tuple]) -> tuple[int, int]:
        """(score, place): a document of ``ids`` gets in with a larger score, or with this score and a smaller place."""
        if len(self.rows) < self.k:
            return 0, 0
        score, key = self.rows[-1]
        return -score, bisect_left(ids, key)

    def offer(self, scores: list[int], keys: list[tuple]) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *zip((-s for s in scores), keys, strict=True)])


def search_block(lists: Lists, terms: np.ndarray, ids: list[tuple], best: Best) -> int:
    """Puts what a block has into ``best``; returns how many documents were scored."""
    terms = terms[lists.end[terms] > lists.begin[terms]]
    if not len(terms):
        return 0
    base = terms.astype(np.int64) * lists.size
    serial, scored = 0, 0
    held: dict[int, tuple] = {}
    heap: list[tuple[int, int]] = []
    score_bar, place_bar = best.bar(ids)

    def push(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> None:
        nonlocal serial
        at = lists.maxima(low, high)
        worth = np.where(high > low, lists.worth[at], 0)
        bound = worth.sum(axis=1)
        top = at[np.arange(len(at)), worth.argmax(axis=1)]
        split = lists.keys[top] % lists.size
        for r in np.flatnonzero((bound > score_bar) | ((bound == score_bar) & (bound > 0) & (first < place_bar))):
            held[serial] = (low[r], high[r], first[r], split[r])
            heapq.heappush(heap, (-int(bound[r]), serial))
            serial += 1

    push(lists.begin[terms][None, :], lists.end[terms][None, :], np.zeros(1, np.int64))
    while heap:
        taken = []
        while heap and len(taken) < WIDTH:
            bound, number = heapq.heappop(heap)
            interval = held.pop(number)
            if -bound > score_bar or (-bound == score_bar and interval[2] < place_bar):
                taken.append(interval)
            elif -bound < score_bar:
                heap, held = [], {}  # no other bound is larger
        if not taken:
            break
        low, high, first, split = (np.array(c) for c in zip(*taken, strict=True))
        at = np.searchsorted(lists.keys, base + split[:, None])
        there = (at < high) & (lists.keys[np.minimum(at, len(lists.keys) - 1)] == base + split[:, None])
        scores = np.where(there, lists.worth[np.minimum(at, len(lists.keys) - 1)], 0).sum(axis=1)
        scored += len(scores)
        good = np.flatnonzero((scores > score_bar) | ((scores == score_bar) & (scores > 0) & (split < place_bar)))
        if len(good):
            best.offer(scores[good].tolist(), [ids[d] for d in split[good].tolist()])
            score_bar, place_bar = best.bar(ids)
        push(np.concatenate([low, at + there]), np.concatenate([at, high]), np.concatenate([first, split + 1]))
    return scored


# --- the whole search


def _found(stored: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_words: int, k: int, kind: str, arrow_kind: pa.DataType) -> DataFrame:
    """(query, id, score): the k best of each query among the documents of each task."""
    shared = stored.sparkSession.sparkContext.broadcast(([np.array(q, np.int64) for q in queries], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, worth_of = shared.value
        best = [Best(k) for _ in asked]

        def block(part: pa.RecordBatch) -> None:
            part = part.take(pc.sort_indices(part.column("id"), null_placement="at_end"))
            ids = [(i is None, i) for i in part.column("id").to_pylist()]
            lengths = part.column("n").to_numpy()
            per_doc = np.diff(part.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(len(ids)), per_doc)
            term, count = part.column("terms").flatten().to_numpy().astype(np.int64), part.column("counts").flatten().to_numpy()
            m = 10 + (90 * lengths * n_docs) // n_words
            worth = worth_of[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
            lists = Lists.of(doc, term, worth, max(len(ids), 1), len(worth_of))
            for q, own in zip(asked, best, strict=True):
                search_block(lists, q, ids, own)

        for batch in batches:
            at, ends = 0, np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, min(at + BLOCK_DOCS, int(np.searchsorted(ends, before + BLOCK_POSTINGS, "right"))))
                block(batch.slice(at, stop - at))
                at = stop
        rows = [(q, key[1], -score) for q, own in enumerate(best) for score, key in own.rows]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), arrow_kind, pa.int64()), strict=True)], names=["query", "id", "score"])

    return stored.mapInArrow(run, f"query int, id {kind}, score long")


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[list[int]], list[str]]]:
    """(ids, term numbers of each query, terms) of blocks of queries, streamed."""
    ids, asked, numbers = [], [], {}
    for row in queries.toLocalIterator():
        if ids and (len(ids) == BLOCK_QUERIES or len(numbers) + len(row["terms"]) > BLOCK_TERMS):
            yield ids, asked, list(numbers)
            ids, asked, numbers = [], [], {}
        ids.append(row["query"])
        asked.append([numbers.setdefault(t, len(numbers)) for t in row["terms"]])
    if ids:
        yield ids, asked, list(numbers)


def search(docs: DataFrame, queries: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query, rank, id, score): the ``k`` best documents of each query with a score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); with m = 10 + 90 n N div L it adds weight times (10**9 tf div (1000 tf + 8 m)). Equal scores are ordered
    by id, null last. Null and empty texts have no terms and don't count; very long ones are cut for memory only. Rows of one id are one query among ``queries``, but
    documents of their own among ``docs`` (repeated rows are found each). Further columns are left out. Queries without terms, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    asked_kind = queries.schema[query_id_col].dataType.simpleString()
    tables = Rounds(spark)
    result = None
    for number, (ids, asked, terms) in enumerate(_blocks(tables.written(_query_terms(queries, query_id_col, query_text_col), "queries"))):
        stored = Rounds(spark).written(counted(docs, {t.encode(): i for i, t in enumerate(terms)}, id_col=id_col, text_col=text_col), f"counts{number}")
        n_docs, n_words = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = frequencies.select("term", F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
        weights = np.zeros(len(terms), np.int64)
        for row in weighed.collect():  # a row a term of the block
            weights[row["term"]] = row["w"]
        found = _found(stored, asked, weights, n_docs, max(n_words, 1), k, kind.simpleString(), to_arrow_type(kind))
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        salted = Window.partitionBy("query", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"at int, name {asked_kind}")  # at most BLOCK_QUERIES rows
        found = found.join(F.broadcast(names), F.col("query") == F.col("at")).select(F.col("name").alias("query"), "rank", "id", "score")
        result = found if result is None else result.unionAll(found)
    return spark.createDataFrame([], f"query {asked_kind}, rank int, id {kind.simpleString()}, score long") if result is None else result


def ranked_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of each benchmark item's 10 best documents."""
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
