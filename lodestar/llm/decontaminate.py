"""Benchmark decontamination: documents that repeat passages of test questions and answers.

Texts are normalised to words (ASCII letters lower-cased, everything but digits, ASCII letters and
non-ASCII characters taken as a gap). Every run of ``window`` consecutive words of a benchmark item is a
pattern, an item of fewer words is one pattern itself. All patterns go into one Aho-Corasick automaton,
each document's words pass it once, and the words inside matches are mapped back to offsets in the text.

A word enters the automaton as a code of a few characters, from an alphabet per place in the code, so a match
can't start inside a word; words that no item has share one code that no pattern holds.

What is broadcast is bounded: at most ``MAX_PATTERN_WORDS`` item words an automaton. A larger benchmark
is cut into blocks of items, and documents pass the blocks' automata one after the other, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import fresh, map_rows, packed, unpacked, utf8

WINDOW = 10
#: Words of benchmark items that one automaton holds; some tens of MB in each Python worker.
MAX_PATTERN_WORDS = 200_000

_WORD_BYTE = [48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: Bytes of words stay (A-Z become a-z), all others become a blank.
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if _WORD_BYTE[b] else 32 for b in range(256))
_DIGITS = 60
_UNKNOWN = "\x7f"

_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Matcher:
    """The automaton of some items: which runs of a document's words match, and whose they are."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        texts = [(item, words_of(text)) for item, text in items]
        vocabulary = sorted({w for _, words in texts for w in words})
        self.width = 1
        while _DIGITS**self.width < len(vocabulary):
            self.width += 1
        self.codes = {w: self._code(k) for k, w in enumerate(vocabulary)}
        owners: dict[str, set[str]] = defaultdict(set)
        for item, words in texts:
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners["".join(self.codes[w] for w in words[at : at + window])].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern) // self.width, tuple(who)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def _code(self, k: int) -> str:
        out = []
        for place in range(self.width):
            out.append(chr(256 + 64 * place + k % _DIGITS))
            k //= _DIGITS
        return "".join(out)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (ends exclusive, joined where they touch or overlap) and the items that match."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.any or not words:
            return runs, items
        unknown = _UNKNOWN * self.width
        codes = self.codes
        for end, (length, who) in self.automaton.iter("".join([codes.get(w, unknown) for w in words])):
            stop = (end + 1) // self.width
            start = stop - length
            items.update(who)
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, stop))
        return runs, items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _text_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.array(_WORD_BYTE)[np.frombuffer(text.translate(_FOLD), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(points[edge[2 * a]]), int(points[edge[2 * b - 1]])) for a, b in runs]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, bytes | None]], window: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()  # a worker holds one automaton at a time
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """Blocks of items of at most ``most`` words (a longer item has one to itself), streamed to the driver."""
    block, held = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        raw = text.encode() if text is not None else None
        n = len(words_of(raw))
        if n and item is not None:
            if block and held + n > most:
                yield block
                block, held = [], 0
            block.append((item, raw))
            held += n
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_pattern_words: int = MAX_PATTERN_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids of the items found), hit_spans (code-point offsets in the text) and contaminated.

    Null and empty texts have no words and no hits; a very long text passes in whole; items without words or without an id match nothing;
    repeated items count once, and items that tie for the same words are all listed; repeated documents are judged row by row; an empty
    table gives an empty table, and an empty benchmark hits nothing. Other columns stay, those named like a new one are replaced.
    """
    sc = docs.sparkSession.sparkContext
    hits = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", _RUNS), T.StructField(runs_col := fresh(docs, "_runs"), _RUNS)])
    out = docs
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col, max_pattern_words)):
        shared = sc.broadcast(block)
        key = hashlib.sha256(repr((block, window)).encode()).hexdigest()

        def scan(batch: pa.RecordBatch, shared=shared, key=key, first=number == 0) -> dict:
            matcher = _matcher(key, shared.value, window)
            new: dict[str, list] = {f.name: [] for f in hits}
            before = [([], [])] * batch.num_rows if first else zip(batch.column(runs_col).to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (old_runs, old_items) in zip(utf8(batch.column(text_col)), before, strict=True):
                words = words_of(text)
                runs, items = matcher.scan(words)
                if old_runs:
                    runs = _merged([*runs, *((r["start"], r["end"]) for r in old_runs)])
                new["n_words"].append(len(words))
                new["n_hit"].append(sum(b - a for a, b in runs))
                new["items"].append(sorted(items.union(old_items)))
                new["hit_spans"].append([{"start": a, "end": b} for a, b in _text_spans(text, runs)] if runs else [])
                new[runs_col].append([{"start": a, "end": b} for a, b in runs])
            return new

        out = map_rows(out, scan, hits)
    return out.drop(runs_col).withColumn("contaminated", F.col("n_hit") > 0)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns only, of any name; those with null or empty texts stay."""
    found = find_contamination(packed(docs, "text"), benchmark)
    return unpacked(found.where(~F.col("contaminated")), docs.columns)
