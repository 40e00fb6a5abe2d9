"""Removal of long repeated strings: every byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere.

The method asked for, merging shards' Burrows-Wheeler transforms by interleave refinement, takes a pass over all bytes for each byte
of a match, 400 here, which is out of reach of the limits; the README has figures. What is done instead finds the same strings:

1. Anchors. Of each window of ``LENGTH`` bytes, the gram of ``GRAM`` bytes with the least hash (leftmost of equals) is its anchor, so
   equal windows have equal anchors at equal places. An anchor's windows are a range of starts; the bytes that these cover are its cover.
2. Anchors are dealt out by gram and sorted by cover. A gram that is there once settles its windows: none repeats. A cover that is
   there twice settles its windows: all repeat. Occurrences with the same cover within a batch travel as one row. Grams with a
   large share of all rows, as a sample of the texts shows, are dealt out by gram and cover, and taken to have several covers.
3. What remains are the ends of repeats: anchors whose gram repeats and whose cover doesn't. Their covers, and one of each repeated cover
   beside them, are fetched from the texts and meet by gram, where windows at the same distance from the anchor are compared by
   128-bit rolling hashes. Grams with more than ``GROUP`` covers are cut up; what their parts can't settle goes on as
   one row a window, counted in Spark.
4. Ranges of starts come together per text and are joined to the texts.

Texts are known by 128 bits of hash, so copies of a text share their ranges, which are the same for each. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import checkpoint, fresh, map_rows, utf8

LENGTH = 400
GRAM = 64
#: Covers of one gram that are compared in one place.
GROUP = 4096
#: One text in so many is looked at beforehand for grams that many anchors have; what it shows changes where rows go, not the result.
SAMPLED = 32
#: A gram with at least this share of the sample's rows, and so many of them, is dealt out by cover: fewer grams than its inverse.
COMMON, COMMON_ROWS = 1 / 1024, 8
#: Windows whose anchors are sought at once.
_SEGMENT = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=16).digest()[:8], "big") for b in range(256)], np.uint64)
_TABLE2 = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=16).digest()[8:], "big") for b in range(256)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place, by joining hashes of halves."""
    h, n = _TABLE[text], 1
    while n < size:
        step = min(n, size - n)
        right = h[step:]
        h = h[: len(h) - step] * _M3 + (right ^ right >> np.uint64(31))
        n += step
    h = (h ^ h >> np.uint64(32)) * _M1
    return h ^ h >> np.uint64(29)


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order: place, first and last start of its windows, and its gram's hash."""
    raw = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    places, firsts, lasts, grams = [], [], [], []
    for begin in range(0, len(raw) - length + 1, _SEGMENT):
        h = gram_hashes(raw[begin : begin + _SEGMENT + length - 1], gram)
        n = len(h)
        key = h & ~_PLACE | np.arange(n, dtype=np.uint64)
        blocks = np.concatenate((key, np.full(-n % width, ~np.uint64(0)))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        places.append(place[first] + begin)
        firsts.append(first + begin)
        lasts.append(np.concatenate((first[1:] - 1, [windows - 1])) + begin)
        grams.append(h[place[first]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, firsts, lasts, grams))


def _found(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, c1, c2, before, width, n, k1, k2, first): covers of a batch with the texts and places that have them."""
    for batch in batches:
        held: dict[tuple[int, bytes], list] = {}
        for text, k1, k2 in zip(utf8(batch.column("text")), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
            if not text or len(text) < length:
                continue
            place, first, last, g = anchors(text, length, gram)
            for p, a, b, x in zip(place.tolist(), first.tolist(), last.tolist(), g.view(np.int64).tolist(), strict=True):
                cover = xxhash.xxh3_128_digest(text[a : b + length])
                row = held.get((x, cover))
                if row is None:
                    row = held[x, cover] = [p - a, b - a, 0, {}]
                row[2] += 1
                row[3][k1, k2, a] = None
        if not held:
            continue
        covers = np.frombuffer(b"".join(c for _, c in held), "<i8").reshape(-1, 2)
        lengths = np.fromiter((len(r[3]) for r in held.values()), np.int32, len(held))
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        where = np.array([x for r in held.values() for x in r[3]], np.int64).reshape(-1, 3)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(where[:, k]).astype(t))) for k, t in enumerate((np.int64, np.int64, np.int32))]
        own = [pa.array([r[k] for r in held.values()], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.int64()), pa.array(np.ascontiguousarray(covers[:, 0])), pa.array(np.ascontiguousarray(covers[:, 1])), *own, *lists], names=_FOUND)


_FOUND = ["gram", "c1", "c2", "before", "width", "n", "k1", "k2", "first"]
_FOUND_TYPE = "gram long, c1 long, c2 long, before int, width int, n long, k1 array<long>, k2 array<long>, first array<int>"


def common_grams(texts: DataFrame, length: int, gram: int) -> list[int]:
    """Grams that a sample of the texts (text, k1, k2) has in a large share of its rows; there can be at most 1 / ``COMMON``."""
    some = texts.where(F.col("k1") % SAMPLED == 0).mapInArrow(lambda batches: _found(batches, length, gram), _FOUND_TYPE)
    rows = checkpoint(some.groupBy("gram").count())
    total = rows.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = rows.where(F.col("count") >= max(COMMON_ROWS, COMMON * total))
    return sorted(r["gram"] for r in often.select("gram").collect())


def dealt(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``_found`` and ``common``, all of a gram together; of a common one, all of a cover."""
    common = common_grams(texts, length, gram)
    found = texts.mapInArrow(lambda batches: _found(batches, length, gram), _FOUND_TYPE)
    found = found.withColumn("common", F.col("gram").isin(*common) if common else F.lit(False))
    return found.repartition("gram", F.when(F.col("common"), F.col("c1"))).sortWithinPartitions("gram", "c1", "c2")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of gram and cover: settled ranges (fetch null) and covers to fetch (1 to settle, 0 to compare with).

    A cover is known by its first row until it is over; a gram's first cover waits until there is a second, for only then is either fetched.
    Of a common gram, which has covers elsewhere, none waits.
    """
    out: list[tuple] = []
    gram = cover = row = waiting = None
    total = covers = 0

    def emit(row: tuple, at: int, fetch: int | None) -> None:
        out.append((row[6][at], row[7][at], row[8][at], row[4], row[0], row[3], fetch))

    def close() -> None:
        nonlocal waiting
        if row is None:
            return
        fetch = int(total == 1)
        if covers == 1 and not row[9]:
            waiting = (row, fetch)
            return
        if waiting is not None:
            emit(waiting[0], 0, waiting[1])
            waiting = None
        emit(row, 0, fetch)

    for batch in batches:
        for new in zip(*(batch.column(c).to_pylist() for c in (*_FOUND, "common")), strict=True):
            if new[0] != gram or new[1:3] != cover:
                close()
                if new[0] != gram:
                    gram, waiting, covers = new[0], None, 0
                cover, row, total = new[1:3], new, 0
                covers += 1
            if total == 1:
                emit(row, 0, None)
            total += new[5]
            if total > 1:
                for at in range(len(new[6])):
                    emit(new, at, None)
        yield _columns(out, _SETTLED_SCHEMA)
        out.clear()
    close()
    yield _columns(out, _SETTLED_SCHEMA)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_SETTLED = ["k1", "k2", "first", "width", "gram", "before", "fetch"]
_SETTLED_SCHEMA = pa.schema(list(zip(_SETTLED, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)))
_SETTLED_TYPE = "k1 long, k2 long, first int, width int, gram long, before int, fetch int"


def _rolling(rows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row (of at most twice ``length`` bytes), two 64-bit hashes of the ``length`` bytes at each place."""
    size = max(map(len, rows))
    padded = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), np.uint8).reshape(len(rows), size)
    out = []
    for table, factor in ((_TABLE, _M2), (_TABLE2, _M3)):
        powers = np.ones(2 * length + 1, np.uint64)
        np.multiply.accumulate(np.full(2 * length, factor, np.uint64), out=powers[1:])
        sums = np.zeros((len(rows), size + 1), np.uint64)
        np.cumsum(table[padded] * powers[:size], axis=1, out=sums[:, 1:])
        # sums of bytes times powers; brought to one power, equal strings are equal at any place
        out.append((sums[:, length:] - sums[:, : size + 1 - length]) * powers[2 * length - np.arange(size + 1 - length)])
    return out[0], out[1]


def _compare(rows: list[tuple], length: int) -> list[tuple]:
    """Of whole groups of covers (rows as in ``_COVERS``): ranges to settle that repeat within their group; of parts of groups, also windows to count."""
    rows = list({(r[4], r[8], r[0], r[1], r[2]): r for r in sorted(rows, key=lambda r: r[6])}.values())
    h1, h2 = _rolling([r[9] for r in rows], length)
    width, gram, before, fetch, parts = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6, 7))
    row, at = np.nonzero(np.arange(h1.shape[1])[None, :] <= width[:, None])
    a, b, g, distance = h1[row, at], h2[row, at], gram[row], before[row] - at
    part = np.array([r[8] for r in rows])[row]
    # windows of one gram can only be equal at the same distance from it
    mixed = a ^ (g.view(np.uint64) + distance.astype(np.uint64)) * _M1 ^ part.astype(np.uint64) * _M3
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    for x in (a, b, g, distance, part):
        same &= x[order][1:] == x[order][:-1]
    again = np.zeros(len(order), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    hit = again & (fetch[row] == 1)
    beside = row[1:] == row[:-1]
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & beside)))
    last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & beside, [False])))
    out = [(*rows[row[x]][:2], int(rows[row[x]][2] + at[x]), int(at[y] - at[x]), None, None, None, None, None) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
    if (parts > 1).any():
        leads = np.ones(len(order), bool)
        leads[order[1:]] = ~same  # of windows that are equal here, one goes on, to settle others
        for k in np.flatnonzero(leads & (parts[row] > 1)).tolist():
            r = rows[row[k]]
            out.append((r[0], r[1], int(r[2] + at[k]), 0, r[4], int(distance[k]), int(a[k].view(np.int64)), int(b[k].view(np.int64)), bool(r[6])))
    return out


#: Covers that are compared in one go: of many small groups, or of one part.
_BUNDLE = 512
_COVERS = [*_SETTLED, "parts", "part", "cover"]
_COVERS_SCHEMA = pa.schema([*_SETTLED_SCHEMA, ("parts", pa.int32()), ("part", pa.int32()), ("cover", pa.binary())])
_COMPARED_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("width", pa.int32()), ("gram", pa.int64()), ("distance", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("open", pa.bool_())])


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From covers in order of gram and part: ranges that are settled, and windows to count (with gram)."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _COVERS), strict=True):
            if len(held) >= _BUNDLE and (row[4], row[8]) != last:
                yield _columns(_compare(held, length), _COMPARED_SCHEMA)
                held = []
            last = (row[4], row[8])
            held.append(row)
    if held:
        yield _columns(_compare(held, length), _COMPARED_SCHEMA)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2"))


def repeated_starts(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k1, k2, ranges): for each text that has some, the ranges (first, width) of starts of repeated strings of ``length`` bytes."""
    texts = _keyed(docs, text_col)
    settled = checkpoint(dealt(texts, length, gram).mapInArrow(_settled, _SETTLED_TYPE))
    asked = settled.where("fetch is not null").distinct()
    crowded = asked.groupBy("gram").count().where(F.col("count") > group).select("gram", F.ceil(F.col("count") / group).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(crowded), "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "width", "gram", "before", "fetch", "parts")).alias("asked"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            for text, k1, k2, asks in zip(utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in ("k1", "k2", "asked")), strict=True):
                if (k1, k2) != last:  # copies of a text stand together
                    last = (k1, k2)
                    rows += [(k1, k2, a["first"], a["width"], a["gram"], a["before"], a["fetch"], a["parts"], hash((k1, a["first"])) % a["parts"], text[a["first"] : a["first"] + a["width"] + length]) for a in asks]
            yield _columns(rows, _COVERS_SCHEMA)

    covers = texts.join(asked, ["k1", "k2"]).mapInArrow(cut_out, _SETTLED_TYPE + ", parts int, part int, cover binary")
    compared = covers.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(lambda batches: _compared(batches, length), "k1 long, k2 long, first int, width int, gram long, distance long, h1 long, h2 long, open boolean")
    compared = checkpoint(compared)
    windows = compared.where("gram is not null")
    often = windows.groupBy("gram", "distance", "h1", "h2").count().where("count > 1").drop("count")
    spread = windows.where("open").join(often, ["gram", "distance", "h1", "h2"], "left_semi")
    plain = ["k1", "k2", "first", "width"]
    every = settled.where("fetch is null").select(plain).unionAll(compared.where("gram is null").select(plain)).unionAll(spread.select(plain))
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "width")).alias("ranges"))


def spans_of(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte spans that ranges of starts cover, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((r["first"], r["first"] + r["width"] + length) for r in ranges or ()):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def with_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, repeats (byte spans that are removed) and kept (the remaining bytes).

    Null and empty texts, and those shorter than ``length``, have no repeats (null: no bytes); a very long text is cut by one task, window by
    window. Copies, repeated rows too, count as documents of their own, so all of each goes; no copy is preferred. Columns named like new ones are replaced; an empty table gives an empty table.
    """
    starts = repeated_starts(docs, text_col=text_col, length=length, gram=gram, group=group)
    k1, k2, ranges = (fresh(docs, n) for n in ("_k1", "_k2", "_ranges"))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("text"), text)})
    joined = keyed.join(starts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("ranges").alias(ranges)), [k1, k2], "left")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        new: dict[str, list] = {f.name: [] for f in _ADDED.fields}
        for text, found in zip(utf8(batch.column(text_col)), batch.column(ranges).to_pylist(), strict=True):
            text = text or b""
            spans = spans_of(found, length)
            edges = [0, *(x for s in spans for x in s), len(text)]
            new["n_bytes"].append(len(text))
            new["n_removed"].append(sum(b - a for a, b in spans))
            new["n_spans"].append(len(spans))
            new["repeats"].append([{"start": a, "end": b} for a, b in spans])
            new["kept"].append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
        return new

    return map_rows(joined, cut, _ADDED).drop(k1, k2, ranges)


_ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def repeats_digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return with_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
