"""Near copies by Jaccard similarity of five-word shingles, found through wide SimHash prints and checked on whole sets.

At a similarity of 0.8, prints differ in some 15 % of their bits, so keys made of their bits aren't selective at that radius. So

1. a text has ``TABLES`` keys, each made of ``ROWS`` min-hashes of its shingles, and a print of 256 bits,
2. texts that share a key are compared bit-sliced, as in ``simhash``; what is within ``RADIUS`` bits is a loose link, of which each block keeps a
   spanning forest,
3. the whole sets of each loose component meet and are intersected; components above ``ELEMENTS`` shingles are cut into blocks, every two of
   which meet. Links of 0.8 or more are kept, again as a forest, so no step makes all pairs of a group.

A pair at 0.8 has no key in common with probability (1 - 0.8 ** ROWS) ** TABLES = 0.0007, and is beyond the radius, four deviations off,
with 0.00003; more similar pairs are missed less. Links of less than 0.8 are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, join_checked, utf8

SHINGLE = 5
#: The least similarity of near copies, p / q.
SIMILAR = (4, 5)
SEED = 42
TABLES, ROWS = 24, 6
#: Of 256 bits; at a similarity of 0.8 they differ in 38.8, with a deviation of 5.7.
RADIUS = 62
WORDS = ["w0", "w1", "w2", "w3"]
#: Shingles of sets that are intersected in one place.
ELEMENTS = 1 << 20
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([xxhash.xxh64_intdigest(f"similar-{k}") | 1 for k in range(TABLES * ROWS + len(WORDS))], np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    words = text.translate(_UPPER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64))


def _spread(hashes: np.ndarray) -> np.ndarray:
    return hashes ^ hashes >> np.uint64(29)


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key a table; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    spread, factors = _spread(hashes), _MIX[: TABLES * ROWS, None]
    least = np.full(TABLES * ROWS, ~np.uint64(0))
    for first in range(0, len(spread), 1024):
        np.minimum(least, (spread[None, first : first + 1024] * factors).min(axis=1), out=least)
    least, out = least.reshape(TABLES, ROWS), np.zeros(TABLES, np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The majority bits of four words mixed from each shingle's hash."""
    ones = np.zeros((len(WORDS), 64), np.int64)
    for first in range(0, len(hashes), 16384):
        part = _spread(hashes[first : first + 16384])[None, :] * _MIX[TABLES * ROWS :, None]
        part = (part ^ part >> np.uint64(32)) * _MIX[0]
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(WORDS), -1, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1).view(np.int64)[:, 0]


def name_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def row_key(row_id: Column, text: Column) -> Column:
    """A hash of a row's id and text; rows that share it are the same row, repeated."""
    return F.xxhash64(row_id.cast("string"), F.lit(0), text)


def marked(texts: DataFrame) -> DataFrame:
    """(row, id, fp, n, keys, w0..w3) of each row of ``texts`` (id, text); fp is a hash of the set of shingles, n its size."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in utf8(batch.column("text"))]
            wide = np.array([wide_print(s) for s in sets], np.int64).reshape(-1, len(WORDS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("id"),
                    pa.array(np.array([name_of(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([keys(s) for s in sets], pa.list_(pa.int64())),
                    *[pa.array(np.ascontiguousarray(wide[:, k])) for k in range(len(WORDS))],
                ],
                names=["row", "id", "fp", "n", "keys", *WORDS],
            )

    own = texts.select(row_key(F.col("id"), F.col("text")).alias("row"), "id", "text")
    return own.mapInArrow(run, f"row long, id {kind}, fp long, n long, keys array<long>, " + ", ".join(f"{w} long" for w in WORDS))


def distinct_sets(marks: DataFrame) -> DataFrame:
    """One row a set of ``marks``: fp, first (the least id), row (one that has it), n, keys and the print."""
    return marks.groupBy("fp").agg(F.min("id").alias("first"), F.min("row").alias("row"), *[F.any_value(c).alias(c) for c in ("n", "keys", *WORDS)])


def keyed(sets: DataFrame) -> DataFrame:
    return sets.select("fp", F.posexplode("keys").alias("t", "key"), *WORDS)


def _overlaps(sets: list[np.ndarray], first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that are similar, in all of ``sets`` or between those that are ``first`` and the others; each set counts its hashes in common with all
    others at once, through the places of each hash."""
    p, q = SIMILAR
    sizes = np.array([len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    whose = np.repeat(np.arange(len(sets)), sizes)
    number, whose = number[times[number] > 1], whose[times[number] > 1]
    by_hash = np.argsort(number, kind="stable")
    places = whose[by_hash]
    begin = np.searchsorted(number[by_hash], np.arange(len(times)))
    edge = np.searchsorted(whose, np.arange(len(sets) + 1))
    left, right = [], []
    for a in range(len(sets)) if first is None else np.flatnonzero(first):
        own = number[edge[a] : edge[a + 1]]
        if not len(own):
            continue
        lengths = times[own]
        at = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(places[at], minlength=len(sets))
        close = (p + q) * shared >= p * (sizes + sizes[a])
        close[: a + 1] &= first is not None
        if first is not None:
            close &= ~first
        right.append(np.flatnonzero(close))
        left.append(np.full(len(right[-1]), a))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def exact_links(texts: DataFrame, sets: DataFrame, loose: DataFrame, *, elements: int = ELEMENTS) -> DataFrame:
    """Links (a, b), by fp, of all ``sets`` that are similar and in one component of ``loose`` (node, root)."""
    from lodestar.llm.simhash import _forest, _pairs, in_blocks

    rooted = loose.select(F.col("node").alias("fp"), "root")
    members = checkpoint(sets.join(rooted, "fp").select(F.col("row").alias("of"), "fp", "root", "n"))
    blocks = in_blocks(members, ["root"], F.col("n"), elements)
    wanted = checkpoint(blocks.groupBy("of").agg(F.any_value("fp").alias("fp"), F.collect_list(F.struct("root", "i", "j", "own")).alias("seats")))
    rows = texts.select(row_key(F.col("id"), F.col("text")).alias("row"), "text")
    found = join_checked(rows, wanted, F.col("row"), "of", "inner").select("fp", "seats", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingles(t).view(np.int64) for t in utf8(batch.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("seats"), made], names=["fp", "seats", "hashes"])

    seats = found.schema["seats"].dataType.simpleString()
    whole = found.mapInArrow(hashed, f"fp long, seats {seats}, hashes array<long>").select("fp", "hashes", F.explode("seats").alias("s")).select("s.root", "s.i", "s.j", "s.own", "fp", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        last = None

        def flush() -> pa.RecordBatch:
            names = np.array(list(held), np.int64).view(np.uint64)
            first = np.array([own == last[1] for own, _ in held.values()]) if last[1] != last[2] else None
            left, right = _overlaps([s for _, s in held.values()], first)
            return _pairs(_forest(names[left], names[right]))

        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for k, (root, i, j, own, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "own", "fp")), strict=True)):
                if (root, i, j) != last:
                    if len(held) > 1:
                        yield flush()
                    held, last = {}, (root, i, j)
                held[fp] = (own, flat[ends[k] : ends[k + 1]].copy())
        if len(held) > 1:
            yield flush()

    return whole.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compare, "a long, b long")
