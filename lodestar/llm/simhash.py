"""SimHash near-duplicates with bit-sliced comparison.

1. A fingerprint per document: word shingles hashed to 64 bits, each bit by majority.
2. Fingerprints that differ in at most ``RADIUS`` of 64 bits agree in whole on all but ``RADIUS`` of m pieces of the bits.
   Every choice of m - RADIUS pieces is a table, keyed by their bits; a linked pair meets in one table at least, and no
   others need comparing. m follows from the number of distinct fingerprints, so keys stay selective as the input grows.
3. Rows with the same table and key are compared bit-sliced: the bit planes of a block of fingerprints are stored
   vertically, 64 fingerprints a machine word, and carry-save counters take in one plane of differences after the
   other, until all of a block exceed the radius.
   Each block keeps a spanning forest of the links it finds, so links are at most as many as its fingerprints.
4. Components by alternating large and small stars, checkpointed each round.

Copies are one fingerprint. A key with more than ``BLOCK`` fingerprints is cut into blocks, and pairs of blocks are
compared apart, in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import similar
from lodestar.llm.common import Rounds, checkpoint, map_rows, packed, unpacked, utf8

SHINGLE = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Fingerprints of one key that are compared as one block.
BLOCK = 4096
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The majority bits of the shingles' hashes, as an unsigned number; 0 without words."""
    words = text.translate(_UPPER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 65536):
        part = hashes[first : first + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = np.array([fingerprint(t, size) for t in utf8(batch.column(text_col))], np.uint64)
        return {"fp": pa.array(made.view(np.int64))}

    return map_rows(docs, run, T.StructType([T.StructField("fp", T.LongType())]))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def pieces(distinct: int, radius: int = RADIUS) -> int:
    """The least number of pieces whose keys are wide enough that a key has some 8 of ``distinct`` even fingerprints."""
    m = radius + 1
    while m < radius + 5 and 2 ** (BITS * (m - radius) // m) * 8 < distinct:
        m += 1
    return m


def _masks(m: int, radius: int) -> list[int]:
    cuts = [BITS * k // m for k in range(m + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(part[k] for k in chosen) for chosen in combinations(range(m), m - radius)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in masks]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints of one or more words: row k has bit k of all, 64 to a word; padded with zeros."""
    fps = fps.reshape(len(fps), -1)
    padded = np.concatenate((fps, np.zeros((-len(fps) % 64, fps.shape[1]), np.uint64)))
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters of differences, one a bit of each word; they start so that they overflow beyond ``radius``."""

    def __init__(self, radius: int, shape: tuple[int, ...]) -> None:
        width = max(radius.bit_length(), 1)
        start = (1 << width) - 1 - radius
        self.bits = [np.full(shape, _ALL if start >> k & 1 else 0, np.uint64) for k in range(width)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for k, bit in enumerate(self.bits):
            self.bits[k], carry = bit ^ carry, bit & carry
        self.over |= carry

    def keep(self, which: np.ndarray) -> None:
        self.bits = [x[which] for x in self.bits]
        self.over = self.over[which]


def near(queries: np.ndarray, block: np.ndarray, vertical: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member of the block) at ``radius`` or fewer differing bits; ``vertical`` are the block's planes.

    For each query, one word of counters per 64 members takes in a plane of differences at a time.
    """
    queries, block = queries.reshape(len(queries), -1), block.reshape(len(block), -1)
    counters = Counters(radius, (len(queries), vertical.shape[1]))
    rows, last = np.arange(len(queries)), len(vertical) - 1
    for k in range(last + 1):
        bit = np.where(queries[rows, k // BITS] >> np.uint64(k % BITS) & np.uint64(1), _ALL, np.uint64(0))
        counters.add(vertical[k][None, :] ^ bit[:, None])
        if radius <= k < last and k % 8 == 7:
            open_rows = (counters.over != _ALL).any(axis=1)
            if not open_rows.all():  # of these queries, the whole block exceeds the radius
                rows = rows[open_rows]
                counters.keep(open_rows)
                if not len(rows):
                    break
    found_row, found_word = np.nonzero(counters.over != _ALL)
    bits = np.unpackbits((~counters.over[found_row, found_word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    query, member = rows[found_row[which]], found_word[which] * 64 + bit
    inside = member < len(block)
    query, member = query[inside], member[inside]
    close = np.bitwise_count(queries[query] ^ block[member]).sum(axis=1) <= radius
    return query[close], member[close]


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what was apart, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places at which two rows of fingerprints differ in at most ``radius`` bits, counted the same way."""
    left, right = left.reshape(len(left), -1), right.reshape(len(right), -1)
    mine, theirs = planes(left), planes(right)
    words, last = np.arange(mine.shape[1]), len(mine) - 1
    counters = Counters(radius, (len(words),))
    for k in range(last + 1):
        counters.add(mine[k, words] ^ theirs[k, words])
        if radius <= k < last and k % 8 == 7 and not (still := counters.over != _ALL).all():
            words = words[still]
            counters.keep(still)
            if not len(words):
                break
    word, bit = np.nonzero(np.unpackbits((~counters.over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = words[word] * 64 + bit
    at = at[at < len(left)]
    return at[np.bitwise_count(left[at] ^ right[at]).sum(axis=1) <= radius]


def _between(queries: np.ndarray, block: np.ndarray, names: tuple[np.ndarray, np.ndarray], same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one, by the blocks' names."""
    vertical = planes(block)
    kept: list[tuple[int, int]] = []
    for first in range(0, len(queries), 256):
        query, member = near(queries[first : first + 256], block, vertical, radius)
        query += first
        if same:
            query, member = query[query < member], member[query < member]
        if len(query):
            old = np.array(kept, np.uint64).reshape(-1, 2)
            kept = _forest(np.concatenate((old[:, 0], names[0][query])), np.concatenate((old[:, 1], names[1][member])))
    return kept


def _within_small(fps: np.ndarray, names: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within many small groups, which are runs of equal numbers in ``group``."""
    left, right = [], []
    at = np.arange(len(fps) - 1)
    step = 1
    while len(at := at[at + step < len(fps)]) and len(at := at[group[at] == group[at + step]]):
        for first in range(0, len(at), 65536):
            mine = at[first : first + 65536]
            close = near_pairs(fps[mine], fps[mine + step], radius)
            left.append(names[mine[close]])
            right.append(names[mine[close] + step])
        step += 1
    return _forest(np.concatenate(left), np.concatenate(right)) if left else []


def links(distinct: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``radius``; at most one a fingerprint and table."""
    m = pieces(distinct.count(), radius)
    masks = _masks(m, radius)
    return linked(distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("t", "key")), ["fp"], radius=radius, block=block)


def in_blocks(rows: DataFrame, keys: list[str], weight: Column, block: int) -> DataFrame:
    """``rows`` (keys, fp and more) with i, j and own, once for each pair of blocks of its group that its own block is in.

    A group weighing more than ``block`` is cut into blocks by hash of fp, so that every two of its rows stand together under one (i, j).
    """
    crowded = rows.groupBy(*keys).agg(F.sum(weight).alias("_weight")).where(F.col("_weight") > block).select(*keys, F.ceil(F.col("_weight") / block).cast("int").alias("_blocks"))
    cut = rows.join(crowded, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_blocks", "_other")
    return cut


def linked(keyed: DataFrame, words: list[str], *, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b), by fp, of rows (fp, t, key) that share table and key and differ in at most ``radius`` bits of ``words``; a forest a block."""
    dealt = in_blocks(keyed, ["t", "key"], F.lit(1), block).select("t", "key", "i", "j", "own", "fp", *[w for w in words if w != "fp"])
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "own")
    wide = len(dealt.columns) > 6

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[np.ndarray]) -> list[tuple[int, int]]:
            """Links within whole groups of rows (t, key, i, j, own, fp, words)."""
            table = np.concatenate(rows, axis=1)
            names = table[5].view(np.uint64)
            fps = np.ascontiguousarray(table[6:].T).view(np.uint64) if wide else names
            new = np.concatenate(([True], (table[:4, 1:] != table[:4, :-1]).any(axis=0)))
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            some = (sizes[group] > 1) & (sizes[group] <= 64)
            kept = _within_small(fps[some], names[some], group[some], radius) if some.any() else []
            starts = np.flatnonzero(new)
            for g in np.flatnonzero(sizes > 64):
                rows_of = slice(starts[g], starts[g] + sizes[g])
                mine, called, own_block = fps[rows_of], names[rows_of], table[4, rows_of]
                if table[2, starts[g]] == table[3, starts[g]]:
                    kept += _between(mine, mine, (called, called), True, radius)
                else:
                    first = own_block == table[2, starts[g]]
                    kept += _between(mine[first], mine[~first], (called[first], called[~first]), False, radius)
            return kept

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(batch.num_columns)])
            change = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
            cut_at = change[-1] + 1 if len(change) else 0  # from here on is the last group, which may go on
            if cut_at:
                yield _pairs(flush([*held, rows[:, :cut_at]]))
                held = [rows[:, cut_at:]]
            elif held and (held[-1][:4, -1] != rows[:4, 0]).any():
                yield _pairs(flush(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield _pairs(flush(held))

    return dealt.mapInArrow(compare, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])


#: A node with more than this share of all edges is a hub; there are fewer than twice its inverse.
HUB = 1 / 256


def _with_least(edges: DataFrame, n: int, rounds: Rounds) -> DataFrame:
    """``edges`` (u, v) with m, the least v of each u. Hubs, a bounded number, are joined by broadcast, so that none meets in one task."""
    least = rounds.written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
    hub = F.col("degree") > HUB * n
    rest = edges.join(least.where(~hub).select("u", "m"), "u")
    return rest.unionAll(edges.join(F.broadcast(least.where(hub).select("u", "m")), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), root being the least node of its component.

    Large stars hang a node's larger neighbours on its least one, small stars its smaller ones; what remains after some
    rounds (of the order of the logarithm of the nodes) is a star per component.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now
        both = edges.union(edges.select("v", "u"))
        large = rounds.written(_with_least(both, 2 * now[0], rounds).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        small = _with_least(large, now[0], rounds).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = rounds.written(small.where("u != v").distinct(), "edges")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row a row of ``docs``: its id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Texts without words (null and empty ones too) have fingerprint 0 and are linked like any other; repeated rows are linked
    to each other; null ids are passed over for component_id, unless there are no others. A very long text counts in whole; ties are no
    matter, as the least id names a component. Other columns are left out, whatever their names. An empty table gives an empty table.
    """
    fps = checkpoint(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", size).select("id", "fp"))
    found = groups(fps, radius=radius)
    return fps.join(found, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def groups(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in ``fps`` (id, fp)."""
    least = fps.groupBy("fp").agg(F.min("id").alias("first"))
    return _grouped(least, links(checkpoint(least.select("fp")), radius=radius))


def _grouped(least: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``groups``, of ``least`` (fp, first), by the links ``edges`` (a, b)."""
    roots = components(edges)
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, that of the smallest id, with the columns of ``docs``.

    Near copies have a Jaccard similarity of 0.8 or more of five-word shingles (``similar``). Texts without words, null and empty ones, are copies
    of each other; very long texts count in whole. If ids repeat or are null, a component's rows are ordered by id (nulls last) and then text, and
    its first stays, of rows repeated in whole one. Columns of any name pass through; an empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = checkpoint(similar.marked(texts))
    sets = checkpoint(similar.distinct_sets(marks))
    loose = linked(similar.keyed(sets), similar.WORDS, radius=similar.RADIUS)
    edges = similar.exact_links(texts, sets, components(loose))
    found = _grouped(sets.select("fp", "first"), edges)
    if marks.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return docs.join(found.select(F.col("component_id").alias(id_col)).distinct(), id_col, "left_semi").select(docs.columns)
    rows = packed(docs, id_col, text_col)
    key = similar.row_key(F.col(id_col), F.col(text_col).cast("string"))
    rooted = marks.select("row", "fp").distinct().join(found, "fp").select("row", "root")
    rows = rows.withColumn("_row", key).join(rooted.withColumnRenamed("row", "_row"), "_row")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("no_text"), F.col(text_col).alias("text"))
    first = rows.groupBy("root").agg(F.min_by(F.struct(id_col, text_col, "_rest"), order).alias("kept")).select("kept.*")
    return unpacked(first, docs.columns)
