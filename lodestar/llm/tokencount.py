"""Token counts of documents under a SentencePiece BPE model, without making any document's ids.

BPE joins neighbours only into pieces of the model. No piece holds a newline, and none holds a blank after
anything but blanks (both are checked when a model is loaded), so a text falls apart into pre-tokens at exactly those
places, and its token count is the sum of its pre-tokens' counts.

1. Each Arrow batch of documents becomes pre-token frequencies. Pre-tokens that are pieces themselves are in a table of
   the model's own size and are summed at once. So are those that ``COMMON`` documents of the batch have or more: they are counted once a
   batch, and no task gathers a hot one. The others become one row a batch and distinct pre-token, with (document, frequency) entries
   packed in an array.
2. These rows are dealt out by pre-token and sorted, so each distinct pre-token meets all its frequencies in one place and
   goes through the model once; products are summed per document before they are dealt out again.
3. Sums are dealt out by batch, packed as they were, and meet there; only then does each document become a row again.

No row grows with the corpus: a row has fewer than ``COMMON`` documents. Batches are known by task and number, and entries by a document's
place in its batch; rows are sorted by text and id before batches are cut, so a task that runs again, with rows in
whatever order, cuts the same batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import utf8

LIMIT = 4096
#: Documents in a batch of frequencies; an entry has the document's place in 14 bits and a frequency above them.
BATCH_ROWS = 1 << 14
#: Documents of a batch from which on a pre-token is counted there.
COMMON = 64
_PLACE = 14
_MOST = (1 << 16) - 1
#: Entries that are summed in memory before their sums go on.
_FLUSH = 2_000_000

_SPACE = "▁"
_PRE_TOKEN = re.compile(rb"\n[^ \n]*| +[^ \n]*")


def pre_tokens(text: bytes | None) -> list[bytes]:
    """A newline, or else a run of blanks, with what follows up to the next of either."""
    return _PRE_TOKEN.findall(b" " + text.replace(_SPACE.encode(), b" ")) if text else []


class PieceModel:
    """A SentencePiece model that counts pre-tokens."""

    def __init__(self, proto: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(self.model.vocab_size())
        own = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in own):
            raise ValueError("this model has pieces across blanks or newlines; its texts do not fall apart into pre-tokens")
        if self.model.encode(" a  b ", out_type=str) != self.model.encode(f"{_SPACE}a{_SPACE * 2}b{_SPACE}", out_type=str) or self.model.normalize("ﬁ A") != f"{_SPACE}ﬁ{_SPACE}A":
            raise ValueError("this model changes texts before it cuts them")
        words = [p.replace(_SPACE, " ").encode() for p in own if p.startswith(_SPACE)]
        self.known = dict(zip(words, self.count(words), strict=True))

    def count(self, tokens: list[bytes]) -> list[int]:
        """Pieces of each pre-token. The model puts a blank before any text but an empty one."""
        ids = self.model.encode([t[1:].decode() if t[:1] == b" " else t.decode() for t in tokens], num_threads=1)
        return [(len(i) or 1) - (t[:1] == b"\n") for t, i in zip(tokens, ids, strict=True)]


_MODELS: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    if hash(proto) not in _MODELS:
        _MODELS[hash(proto)] = PieceModel(proto)
    return _MODELS[hash(proto)]


def pre_token_rows(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, batch, entries, document): the frequencies of each batch's pre-tokens, and its documents with what is summed already (token null)."""
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key_type = docs.schema[id_col].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        known = model.known
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                entries: dict[bytes, list[int]] = {}
                sizes, sums = [], []
                for place, text in enumerate(utf8(batch.column(1))):
                    total = 0
                    for token, n in Counter(pre_tokens(text)).items():
                        if (pieces := known.get(token)) is not None:
                            total += pieces * n
                            continue
                        held = entries.get(token)
                        if held is None:
                            held = entries[token] = []
                        while n > _MOST:
                            held.append(place | _MOST << _PLACE)
                            n -= _MOST
                        held.append(place | n << _PLACE)
                    sizes.append(len(text or b""))
                    sums.append(total)
                common = [t for t, held in entries.items() if len(held) >= COMMON]
                for token, pieces in zip(common, model.count(common), strict=True):
                    for entry in entries.pop(token):
                        sums[entry & (1 << _PLACE) - 1] += pieces * (entry >> _PLACE)
                n_docs, n_tokens = len(sizes), len(entries)
                lengths = np.fromiter(map(len, entries.values()), np.int32, n_tokens)
                values = np.fromiter(chain.from_iterable(entries.values()), np.int32, int(lengths.sum()))
                offsets = np.concatenate((np.zeros(n_docs + 1, np.int32), np.cumsum(lengths, dtype=np.int32)))
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([none(n_docs, pa.binary()), pa.array(list(entries), pa.binary())]),
                        pa.array(np.full(n_docs + n_tokens, number)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.concat_arrays([document := _documents(batch.column(0), np.arange(n_docs), sizes, sums), none(n_tokens, document.type)]),
                    ],
                    names=["token", "batch", "entries", "document"],
                )
                number += 1

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).sortWithinPartitions(F.xxhash64("text"), "text", "id")
    return own.mapInArrow(frequencies, f"token binary, batch long, entries array<int>, {_DOCUMENT.format(key_type)}")


_DOCUMENT = "document struct<place: int, id: {}, n_bytes: bigint, n: bigint>"


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: its id, n_bytes (UTF-8) and n_tokens, without special tokens.

    Null and empty texts have no bytes and no tokens; a very long text is cut in whole by its task. Rows are counted one by one, so repeated
    rows and ids stay apart; ties are no matter; other columns are left out, whatever their names. An empty table gives an empty table.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key_type = docs.schema[id_col].dataType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        last: tuple[bytes | None, int] = (None, 0)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sums() -> pa.RecordBatch:
            number, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            numbers, code = np.unique(number, return_inverse=True)
            total = np.bincount(code << _PLACE | place, weights=n)
            some = np.flatnonzero(total)
            offsets = np.searchsorted(some, np.arange(len(numbers) + 1) << _PLACE).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(some & ((1 << _PLACE) - 1) | total[some].astype(np.int64) << _PLACE))
            return pa.RecordBatch.from_arrays([pa.array(numbers), packed, pa.nulls(len(numbers), kind)], names=["batch", "sums", "document"])

        for batch in batches:
            kind = batch.schema.field("document").type
            own = batch.filter(batch.column("token").is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("batch"), pa.nulls(own.num_rows, pa.list_(pa.int64())), own.column("document")], names=["batch", "sums", "document"])
            batch = batch.filter(batch.column("token").is_valid())
            if not batch.num_rows:
                continue
            distinct = batch.column("token").dictionary_encode()
            tokens = distinct.dictionary.to_pylist()
            again = tokens[0] == last[0]
            counts = [last[1]] * again + model.count(tokens[again:])
            last = (tokens[-1], counts[-1])
            of_row = np.array(counts, np.int64)[distinct.indices.to_numpy()]
            lengths = batch.column("entries").value_lengths().to_numpy()
            entry = batch.column("entries").flatten().to_numpy()
            number = np.repeat(batch.column("batch").to_numpy(), lengths)
            held.append((number, entry & ((1 << _PLACE) - 1), np.repeat(of_row, lengths) * (entry >> _PLACE)))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                yield sums()
        if held:
            yield sums()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, documents, total = None, [], np.zeros(BATCH_ROWS, np.int64)

        def done() -> pa.RecordBatch:
            whole = pa.concat_arrays(documents)
            place, ids, n_bytes, n = whole.flatten()
            n_tokens = n.to_numpy() + total[place.to_numpy()]
            return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n_tokens)], names=[id_col, "n_bytes", "n_tokens"])

        for batch in batches:
            numbers = batch.column("batch").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, end in zip(edges, edges[1:], strict=False):
                if first == end:
                    continue
                if number is not None and numbers[first] != number:
                    yield done()
                    documents, total = [], np.zeros(BATCH_ROWS, np.int64)
                number = numbers[first]
                part = batch.slice(first, end - first)
                documents.append(part.column("document").filter(part.column("document").is_valid()))
                packed = part.column("sums").flatten().to_numpy()
                np.add.at(total, packed & ((1 << _PLACE) - 1), packed >> _PLACE)
        if number is not None:
            yield done()

    rows = pre_token_rows(docs, model_path, id_col=id_col, text_col=text_col)
    dealt = rows.repartition(F.coalesce(F.xxhash64("token"), F.lit(0)), F.when(F.col("token").isNull(), F.hash("batch", "document.place"))).sortWithinPartitions("token")
    parts = dealt.mapInArrow(products, f"batch long, sums array<long>, {_DOCUMENT.format(key_type)}")
    return parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(totals, f"`{id_col}` {key_type}, n_bytes long, n_tokens long")


def _documents(ids: pa.Array, place: np.ndarray, sizes: list[int], sums: list[int]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["place", "id", "n_bytes", "n"])


def token_digest(docs: DataFrame, model_path: str, *, limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(docs.select("doc_id", "text"), model_path).withColumn("over_limit", F.col("n_tokens") > limit)
