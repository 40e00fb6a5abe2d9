"""Packed postings and the search over them.

Documents are taken in shards of at most ``SHARD_DOCS``, in ascending order of id, so a document is a place in a shard. A row holds what one field of a shard
has of one term: places as deltas, counts, lengths and positions, each packed as bytes, in blocks of ``WINDOW`` neighbouring places. A block carries its
best postings: those (count, length) that no other one of the block beats in both. BM25 grows with the count and falls with the length, so a block's largest score
is that of one of these, whatever the statistics and parameters are at the time of a search.

A search takes a shard at a time. Blocks of all terms lie on the same windows, so a window's bound is the sum of its blocks' largest scores, put together like a
document's score. Windows are scored in falling order of bounds, and those that can't reach the query's k-th best score are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SHARD_DOCS, SHARD_TOKENS, WINDOW = 8192, 1 << 22, 256
#: Windows that are scored before the others are held against what they gave.
FIRST = 2
#: How the numbers of each column are packed.
KINDS = {k: np.dtype(t) for k, t in {"places": "<u2", "counts": "<u4", "lengths": "<u4", "positions": "<u4", "blocks": "u1", "edge_blocks": "u1", "edge_counts": "<u4", "edge_lengths": "<u4"}.items()}

ROW = "shard string, dataset string, field string, term string, n long, words long, " + ", ".join(f"{k} binary" for k in KINDS) + ", ids array<string>"
_ARROW = {"n": pa.int64(), "words": pa.int64(), "ids": pa.list_(pa.string())} | dict.fromkeys(KINDS, pa.binary())
_SCHEMA = pa.schema([(n, _ARROW.get(n, pa.string())) for n in (c.rsplit(" ", 1)[0] for c in ROW.split(", "))])


def _put(name: str, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A value of bytes a row, from all rows' numbers and where each row's end; null for rows without numbers."""
    kind = KINDS[name]
    offsets = np.append(0, ends).astype(np.int32) * kind.itemsize
    some = np.packbits(np.diff(offsets) > 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(ends), [pa.py_buffer(some), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, kind))])


def get(name: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' numbers, and how many each row has."""
    kind = KINDS[name]
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind).astype(np.int64) if len(values) else np.zeros(0, np.int64), np.diff(offsets) // kind.itemsize


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _summed_from(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of the values of each row."""
    whole, ends = np.cumsum(values), np.cumsum(sizes)
    return whole - np.repeat(np.append(0, whole)[ends - sizes], sizes)


def _field_rows(code: np.ndarray, length: np.ndarray, terms: pa.Array) -> dict[str, pa.Array]:
    """The columns of one field's rows, by term, from its tokens (codes) in order of documents and positions; of arrays by token, few and narrow ones are held at a time."""
    order = np.argsort(code, kind="stable").astype(np.int32)  # tokens lie by document and position
    code = code[order]
    place = np.repeat(np.arange(len(length), dtype=np.uint16), length)[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (place[1:] != place[:-1]))) if len(order) else np.zeros(0, np.int64)  # a posting each
    term, place = code[first], place[first].astype(np.int32)
    del code
    count = np.diff(np.append(first, len(order))).astype(np.int32)
    step = np.arange(len(order), dtype=np.int32)
    step -= np.repeat((np.cumsum(length) - length).astype(np.int32), length)
    step = step[order]
    tokens = len(order)
    del order
    begin = step[first]
    step[1:] -= step[:-1].copy()
    step[first] = begin
    size = length[place].astype(np.int32)
    row = _starts(term)
    delta = np.diff(place, prepend=np.int32(0))
    delta[row] = place[row]
    block = _starts(term.astype(np.int64) * (SHARD_DOCS // WINDOW + 1) + place // WINDOW)
    number = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(np.append(block, len(place))))
    # the best postings of a block: by falling count, those that are shorter than all before them
    best = np.lexsort((size, -count, number)).astype(np.int32)
    falling = size[best] - number[best].astype(np.int64) * (int(length.max(initial=0)) + 1)
    lowest = np.minimum.accumulate(falling)
    best = best[np.append(True, falling[1:] < lowest[:-1])] if len(best) else best
    # a row of one posting is its own bound
    several = np.repeat(np.diff(np.append(row, len(place))) > 1, np.diff(np.append(row, len(place))))
    best, block = best[several[best]], block[several[block]]
    row_end = np.append(row[1:], len(place))[: len(row)]
    block_end, edge_row = np.searchsorted(block, row_end), np.searchsorted(row, best, "right") - 1
    edge_end = np.searchsorted(edge_row, np.arange(len(row)), "right")
    first_block = number[row]
    return {
        "term": terms.take(pa.array(term[row])), "n": pa.array(row_end - row, pa.int64()), "places": _put("places", delta, row_end), "counts": _put("counts", count, row_end), "lengths": _put("lengths", size, row_end),
        "positions": _put("positions", step, np.append(first, tokens)[row_end]), "blocks": _put("blocks", place[block] // WINDOW, block_end), "edge_blocks": _put("edge_blocks", number[best] - first_block[edge_row], edge_end),
        "edge_counts": _put("edge_counts", count[best], edge_end), "edge_lengths": _put("edge_lengths", size[best], edge_end),
    }


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    """``n`` rows; a column that isn't given is null, and a single value is that of all rows."""
    full = lambda f: columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.repeat(pa.scalar(columns.get(f.name), f.type), n)
    return pa.RecordBatch.from_arrays([full(f) for f in _SCHEMA], schema=_SCHEMA)


def _coded(lists: pa.ChunkedArray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(codes, length of each document, where documents begin and end, terms) of the tokens of documents in the order ``by``; codes count the terms as they sort."""
    chunks = [c for c in lists.chunks if len(c)]
    flat = pa.chunked_array([c.flatten() for c in chunks], pa.string()).dictionary_encode().unify_dictionaries().combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    order = pc.sort_indices(flat.dictionary).to_numpy()  # rows of a field are sorted by term
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    length = np.concatenate([np.zeros(0, np.int64), *[np.diff(c.offsets.to_numpy()) for c in chunks]]).astype(np.int64)
    begin, own = np.cumsum(length) - length, length[by]
    ends = np.append(0, np.cumsum(own))
    at = np.repeat((begin[by] - ends[:-1]).astype(np.int32), own)
    at += np.arange(len(at), dtype=np.int32)
    return rank[flat.indices.to_numpy()[at]], own, ends, flat.dictionary.take(pa.array(order))


def _shard_rows(held: pa.Table, fields: list[str], name: str) -> Iterator[pa.RecordBatch]:
    """All rows of some documents (id, dataset, an array of tokens a field): shards of one dataset each."""
    by = pc.sort_indices(held.select(["dataset", "id"]), sort_keys=[("dataset", "ascending"), ("id", "ascending")])
    datasets, ids = held.column("dataset").take(by).to_pylist(), held.column("id").take(by).to_pylist()
    coded = {f: _coded(held.column(f), by.to_numpy()) for f in fields}
    del held  # codes are all that is needed from here on
    begin = [k for k in range(len(datasets)) if k == 0 or datasets[k] != datasets[k - 1]]
    for part, (a, b) in enumerate(zip(begin, [*begin[1:], len(datasets)], strict=True)):
        same = {"shard": f"{name}-{part}", "dataset": datasets[a]}
        yield _batch(1, same | {"n": b - a, "ids": pa.array([ids[a:b]], pa.list_(pa.string()))})
        for f in fields:
            code, lengths, ends, terms = coded[f]
            length = lengths[a:b]
            yield _batch(1, same | {"field": f, "n": int((length > 0).sum()), "words": int(length.sum())})
            made = _field_rows(code[ends[a] : ends[b]], length, terms)
            for k in range(0, len(made["term"]), 4096):
                own = {c: v.slice(k, 4096) for c, v in made.items()}
                yield _batch(len(own["term"]), same | {"field": f} | own)
            del made


def packed(tokens: DataFrame, fields: list[str], tokenizer: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """Rows as ``ROW`` of documents (id, dataset, and an array of tokens a field, or a text that ``tokenizer`` makes one of), each task packing its own.

    A row without a term gives a shard's ids in order (no field), or how many of its documents have a field, and with how many words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            if tokenizer is None:
                return batch
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dataset"), *[tokenizer(batch.column(f)) for f in fields]], names=["id", "dataset", *fields])

        context = TaskContext.get()
        task, number = (context.partitionId() if context else 0), 0
        parts, docs, words = [], 0, 0
        for batch in (cut(b) for whole in batches for b in ((whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)) if tokenizer else [whole])):
            at = 0
            sizes = sum(np.diff(batch.column(f).offsets.to_numpy()) for f in fields) if batch.num_rows else np.zeros(0, int)
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                room = int(np.searchsorted(ends, before + SHARD_TOKENS - words, "right")) - at
                take = max(min(room, SHARD_DOCS - docs, batch.num_rows - at), 0 if docs else 1)
                if take:
                    parts.append(batch.slice(at, take))
                    at, docs, words = at + take, docs + take, words + int(ends[at + take - 1] - before)
                if docs == SHARD_DOCS or words >= SHARD_TOKENS or not take:
                    whole_shard, parts = pa.Table.from_batches(parts), []
                    made = _shard_rows(whole_shard, fields, f"{task:06d}-{number:06d}")
                    del whole_shard
                    yield from made
                    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest shard took
                    docs, words, number = 0, 0, number + 1
        if parts:
            yield from _shard_rows(pa.Table.from_batches(parts), fields, f"{task:06d}-{number:06d}")
            pa.default_memory_pool().release_unused()

    return tokens.select("id", "dataset", *fields).mapInArrow(run, ROW)


# --- decoding


@dataclass(frozen=True)
class Model:
    """BM25 with the statistics of the whole index: (field, term) to idf, field to average length."""

    k1: float
    b: float
    factor: float
    idf: dict[tuple[str, str], float]
    average: dict[str, float]
    #: idf of a term by the largest of its fields' frequencies, for scores across fields
    blended: dict[tuple[str, str], float] = field(default_factory=dict)

    def shares(self, average: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return count / (count + self.k1 * ((1.0 - self.b) + self.b * length / average))

    def scores(self, idf: np.ndarray, average: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return idf * self.shares(average, count, length) * self.factor


class Shard:
    """The rows of a shard, decoded for all queries: postings by row with their scores, and each row's largest score by window."""

    def __init__(self, name: str, rows: pa.Table, model: Model) -> None:
        self.name = name
        names = list(zip(rows.column("field").to_pylist(), rows.column("term").to_pylist(), strict=True))
        told = np.array([n in model.idf for n in names], bool)
        dead = rows.filter(pa.array([t is None for _, t in names], pa.bool_())).combine_chunks()
        self.dead = get("places", _whole(dead, "places"))[0]
        self.given = _given(dead)
        rows, names = rows.filter(pa.array(told)).combine_chunks(), [n for n, t in zip(names, told, strict=True) if t]
        self.row = {n: k for k, n in enumerate(names)}
        idf, average = np.array([model.idf[n] for n in names]), np.array([model.average[f] for f, _ in names])
        deltas, self.size = get("places", _whole(rows, "places"))
        self.places = _summed_from(deltas, self.size)
        self.end = np.cumsum(self.size)
        each = np.repeat(np.arange(len(names)), self.size)
        shares = model.shares(average[each], get("counts", _whole(rows, "counts"))[0], get("lengths", _whole(rows, "lengths"))[0])
        self.scores = idf[each] * shares * model.factor
        self.across = np.array([model.blended[n] for n in names])[each] * shares * model.factor if model.blended else None
        self.best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.bound = np.zeros((len(names), SHARD_DOCS // WINDOW))
        if "blocks" not in rows.column_names:
            return  # formulas ask for no bounds
        single = np.flatnonzero(self.size == 1)
        self.bound[single, self.places[self.end[single] - 1] // WINDOW] = self.scores[self.end[single] - 1]
        windows, per_row = get("blocks", _whole(rows, "blocks"))
        blocks, edges = get("edge_blocks", _whole(rows, "edge_blocks"))
        each = np.repeat(np.arange(len(names)), edges)
        bounds = model.scores(idf[each], average[each], get("edge_counts", _whole(rows, "edge_counts"))[0], get("edge_lengths", _whole(rows, "edge_lengths"))[0])
        if len(blocks):
            self.bound[np.repeat(np.arange(len(names)), per_row), windows] = np.maximum.reduceat(bounds, _starts(each * 256 + blocks))


    def of(self, fields: list[str], asked: list[tuple[str, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By field, what each place scores in all terms asked, and how many of these it has, both with repeats."""
        out = {}
        for f in fields:
            own = [(slice(self.end[r] - self.size[r], self.end[r]), n) for r, n in ((self.row.get((f, t)), n) for t, n in asked) if r is not None]
            places = np.concatenate([np.zeros(0, np.int64), *[self.places[s] for s, _ in own]])
            scores = np.concatenate([np.zeros(0), *[self.scores[s] * n for s, n in own]])
            times = np.concatenate([np.zeros(0), *[np.full(s.stop - s.start, float(n)) for s, n in own]])
            out[f] = np.bincount(places, scores, minlength=SHARD_DOCS), np.bincount(places, times, minlength=SHARD_DOCS)
        return out

    def best_field(self, term: str, boosts: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of a term across fields: that of the best field at each place, by the blended idf."""
        if term not in self.best:
            best = np.zeros(SHARD_DOCS)
            for f, w in boosts.items():
                if (r := self.row.get((f, term))) is not None:
                    s = slice(self.end[r] - self.size[r], self.end[r])
                    best[self.places[s]] = np.maximum(best[self.places[s]], float(w) * self.across[s])
            places = np.flatnonzero(best)
            self.best[term] = places, best[places]
        return self.best[term]


def _given(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By query, (places, scores) that come with the rows."""
    if "query" not in rows.column_names:
        return {}
    told = rows.filter(pc.is_valid(rows.column("query"))).select(["query", "at", "points"]).to_pylist()
    return {r["query"]: (np.array(r["at"], np.int64), np.array(r["points"], float)) for r in told}


def _whole(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else pa.array([], pa.binary()) if isinstance(column, pa.ChunkedArray) else column


@dataclass(frozen=True)
class Combine:
    """How fields make a document's score: the best one and ``tie`` times the others, or, with no ``tie``, their sum."""

    boosts: dict[str, float]
    tie: float | None = None

    def of(self, by_field: dict[str, np.ndarray]) -> np.ndarray:
        every = [by_field[f] * float(w) for f, w in self.boosts.items()]
        total = sum(every[1:], every[0])
        if self.tie is None:
            return total
        best = np.maximum.reduce(every)
        return best + self.tie * (total - best)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


@dataclass(frozen=True)
class AtLeast:
    """The best field among those that have floor(share * terms) of a query's terms, repeats counted, one at least."""

    boosts: dict[str, float]
    share: float

    def scores(self, shard: Shard, query: int, asked: list[tuple]) -> np.ndarray:
        """Of every place, 0 for those that aren't found."""
        needed = max(math.floor(sum(n for _, n in asked) * self.share), 1)
        best = np.zeros(SHARD_DOCS)
        for f, (score, times) in shard.of(list(self.boosts), asked).items():
            best = np.maximum(best, np.where(times >= needed, score * float(self.boosts[f]), 0.0))
        return _rounded(best)


@dataclass(frozen=True)
class CrossFields:
    """Each term by its best field, all terms needed."""

    boosts: dict[str, float]

    def scores(self, shard: Shard, query: int, asked: list[tuple]) -> np.ndarray:
        out = np.zeros(SHARD_DOCS)
        own = sorted(((*shard.best_field(t, self.boosts), n) for t, n in asked), key=lambda x: len(x[0]))
        places = own[0][0] if own else np.zeros(0, np.int64)
        for other, _, _ in own[1:]:
            if not len(places):
                return out
            places = places[np.isin(places, other, assume_unique=True)]
        for other, score, n in own:
            out[places] += score[np.searchsorted(other, places)] * n
        return _rounded(out)


@dataclass(frozen=True)
class Rescue:
    """Best fields as a must, with scores that come with the rows (x3), those across fields (x2) and of fields with 70 % of the terms (x1.5) added."""

    boosts: dict[str, float]

    def scores(self, shard: Shard, query: int, asked: list[tuple]) -> np.ndarray:
        must = _rounded(Combine(self.boosts, 0.0).of({f: s for f, (s, _) in shard.of(list(self.boosts), asked).items()}))
        given = np.zeros(SHARD_DOCS)
        places, points = shard.given.get(query, (np.zeros(0, np.int64), np.zeros(0)))
        given[places] = points
        total = must + given * 3.0 + CrossFields(self.boosts).scores(shard, query, asked) * 2.0 + AtLeast(self.boosts, 0.7).scores(shard, query, asked) * 1.5
        return np.where(must > 0, _rounded(total), 0.0)


@dataclass(frozen=True)
class Expanded:
    """Field sums of a query's own terms and of further ones, with boosts for either: terms are asked as (term, count, 0 or 1)."""

    boosts: dict[str, float]
    more: dict[str, float]

    def scores(self, shard: Shard, query: int, asked: list[tuple]) -> np.ndarray:
        total = np.zeros(SHARD_DOCS)
        for part, boosts in enumerate((self.boosts, self.more)):
            total = total + Combine(boosts).of({f: s for f, (s, _) in shard.of(list(boosts), [(t, n) for t, n, p in asked if p == part]).items()})
        return _rounded(total)


@dataclass
class Found:
    """What a query has found in a task's shards so far, and how many windows with any of its terms it has seen and scored."""

    k: int
    top: list[float] = field(default_factory=list)  # a heap of the k best scores
    rows: list[tuple[float, str, int]] = field(default_factory=list)
    seen: int = 0
    read: int = 0

    def bar(self) -> float:
        return self.top[0] if len(self.top) == self.k else 0.0

    def add(self, shard: str, places: np.ndarray, scores: np.ndarray) -> None:
        """The best of one shard; of equal scores those of the least places, which have the least ids."""
        order = np.lexsort((places, -scores))[: self.k]
        for s, p in zip(scores[order].tolist(), places[order].tolist(), strict=True):
            self.rows.append((s, shard, p))
            if len(self.top) < self.k:
                heapq.heappush(self.top, s)
            else:
                heapq.heappushpop(self.top, s)
        bar = self.bar()
        self.rows = [r for r in self.rows if r[0] >= bar]


def search_shard(shard: Shard, asked: list[tuple[str, int]], combine: Combine, found: Found) -> None:
    """Puts a shard's best documents for one query (term, count) into ``found``."""
    held = {f: [(shard.row[f, t], n) for t, n in asked if (f, t) in shard.row] for f in combine.boosts}
    if not any(held.values()):
        return
    windows = SHARD_DOCS // WINDOW
    sums = {f: np.array([n for _, n in own], float) @ shard.bound[[r for r, _ in own]] if own else np.zeros(windows) for f, own in held.items()}
    bound = combine.of(sums)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    found.seen += len(order)
    for part in (order[:FIRST], order[FIRST:]):
        part = part[_rounded(bound[part] + 1e-9) >= found.bar()]
        if not len(part):
            continue
        found.read += len(part)
        every = len(part) == len(order)
        wanted = np.zeros(windows, bool)
        wanted[part] = True
        by_field = {}
        for f, own in held.items():
            at = [shard.places[shard.end[r] - shard.size[r] : shard.end[r]] for r, _ in own]
            scores = [shard.scores[shard.end[r] - shard.size[r] : shard.end[r]] * n for r, n in own]
            places, score = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *scores])
            if not every:
                taken = wanted[places // WINDOW]
                places, score = places[taken], score[taken]
            by_field[f] = np.bincount(places, score, minlength=SHARD_DOCS)
        hit = sum(by_field.values()) > 0
        hit[shard.dead] = False
        places = np.flatnonzero(hit)
        score = _rounded(combine.of({f: s[places] for f, s in by_field.items()}))
        good = score >= found.bar()
        found.add(shard.name, places[good], score[good])


def score_shard(shard: Shard, query: int, asked: list[tuple], formula: AtLeast | CrossFields | Rescue | Expanded, found: Found) -> None:
    """Puts a shard's best documents for one query into ``found`` by a formula that needs all places' scores: arrays of a shard's length, whatever matches."""
    scores = formula.scores(shard, query, asked)
    scores[shard.dead] = 0.0
    good = np.flatnonzero((scores > 0) & (scores >= found.bar()))
    if len(good):
        found.add(shard.name, good, scores[good])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """(shard, rows) of a task's rows, which are sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("shard").to_pylist()
        begin = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        for a, b in zip(begin, [*begin[1:], len(names)], strict=True):
            if held and held[0].column("shard")[0].as_py() != names[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)


def searched(rows: DataFrame, queries: list[list[tuple]], model: Model, combine: Combine | AtLeast | CrossFields | Rescue | Expanded, k: int) -> DataFrame:
    """(query, shard, place, score, seen, read) of each task's ``k`` best by query, ties across shards kept; ``rows`` lie by shard.

    A row a query without a place tells how many windows were seen and scored.
    """
    shared = rows.sparkSession.sparkContext.broadcast((queries, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, told = shared.value
        found = [Found(k) for _ in asked]
        for name, rows in shards(batches):
            shard = Shard(name, rows, told)
            for q, (terms, best) in enumerate(zip(asked, found, strict=True)):
                if isinstance(combine, Combine):
                    search_shard(shard, terms, combine, best)
                else:
                    score_shard(shard, q, terms, combine, best)
        out = [(q, shard, place, score, None, None) for q, best in enumerate(found) for score, shard, place in best.rows]
        out += [(q, None, None, None, best.seen, best.read) for q, best in enumerate(found) if best.seen]
        names, types = ["query", "shard", "place", "score", "seen", "read"], [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, "query int, shard string, place int, score double, seen long, read long")


def unpacked(rows: DataFrame, positions: bool = False) -> DataFrame:
    """(field, term, id, dl, tf), and positions if asked for: postings one by one; ``rows`` lie by shard, with those of its ids and dead places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in shards(batches):
            ids = next((r for r in rows.column("ids").to_pylist() if r is not None), None)
            if ids is None:
                continue  # dead places of a shard that isn't asked for
            without = pc.is_null(rows.column("term"))
            live = np.ones(len(ids), bool)
            live[get("places", _whole(rows.filter(pc.and_(without, pc.is_null(rows.column("ids")))), "places"))[0]] = False
            rows = rows.filter(pc.invert(without)).combine_chunks()
            deltas, size = get("places", _whole(rows, "places"))
            places, counts = _summed_from(deltas, size), get("counts", _whole(rows, "counts"))[0]
            taken = live[places]
            each = pa.array(np.repeat(np.arange(len(size)), size)[taken])
            columns = [rows.column("field").take(each).combine_chunks(), rows.column("term").take(each).combine_chunks(), pa.array(ids, pa.string()).take(pa.array(places[taken])), pa.array(get("lengths", _whole(rows, "lengths"))[0][taken], pa.int32()), pa.array(counts[taken], pa.int64())]
            if positions:
                at = _summed_from(get("positions", _whole(rows, "positions"))[0], counts)[np.repeat(taken, counts)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[taken])), pa.int32()), pa.array(at, pa.int32())))
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            out = pa.Table.from_arrays(columns, names=["field", "term", "id", "dl", "tf", *["positions"][:positions]])
            yield from out.to_batches(max_chunksize=20_000)

    return rows.mapInArrow(run, "field string, term string, id string, dl int, tf long" + (", positions array<int>" if positions else ""))


def holding(rows: DataFrame, queries: list[list[str]], fields: list[str]) -> DataFrame:
    """(query, field, shard, place) of documents that have all terms of a query in one field, found by their places alone; ``rows`` lie by shard, dead places among them."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in shards(batches):
            without = pc.is_null(rows.column("term"))
            dead = get("places", _whole(rows.filter(without).combine_chunks(), "places"))[0]
            rows = rows.filter(pc.invert(without)).combine_chunks()
            at = {n: k for k, n in enumerate(zip(rows.column("field").to_pylist(), rows.column("term").to_pylist(), strict=True))}
            deltas, size = get("places", _whole(rows, "places"))
            own = np.split(_summed_from(deltas, size), np.cumsum(size)[:-1]) if len(size) else []
            for f in fields:
                out = []
                for q, terms in enumerate(shared.value):
                    if not terms or any((f, t) not in at for t in terms):
                        continue
                    least, *others = sorted((own[at[f, t]] for t in terms), key=len)
                    found = np.setdiff1d(least, dead, assume_unique=True)
                    for other in others:
                        found = np.intersect1d(found, other, assume_unique=True)
                    out.append((np.full(len(found), q), found))
                if out:
                    q, place = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.repeat(f, len(q)), pa.repeat(name, len(q)), pa.array(place, pa.int32())], names=["query", "field", "shard", "place"])

    return rows.mapInArrow(run, "query int, field string, shard string, place int")


def cut(rows: DataFrame) -> DataFrame:
    """(shard, field, term, place, dl, positions) of the places that each row's ``wanted`` has, all of which are among its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                places, counts, lengths, steps = (get(c, row.column(c))[0] for c in ("places", "counts", "lengths", "positions"))
                wanted = np.sort(np.asarray(row.column("wanted")[0].values))
                at = np.searchsorted(np.cumsum(places), wanted)
                end = np.cumsum(counts)[at]
                own = [np.cumsum(steps[e - n : e]) for e, n in zip(end, counts[at], strict=True)]
                same = [pa.repeat(row.column(c)[0], len(at)) for c in ("shard", "field", "term")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(wanted, pa.int32()), pa.array(lengths[at], pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["shard", "field", "term", "place", "dl", "positions"])

    return rows.select("shard", "field", "term", "places", "counts", "lengths", "positions", "wanted").mapInArrow(run, "shard string, field string, term string, place int, dl int, positions array<int>")
