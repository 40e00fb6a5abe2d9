"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters is a blank, and runs of blanks are one. A model per language is
learnt from n-gram counts that Spark sums over a bounded sample of labelled documents: about ``SAMPLE_DOCS`` a language, chosen by hash.
All n-grams of the sample count, so discounts and continuation counts are those of the definition; the model that is broadcast holds
the n-grams of that many documents, whatever the corpus. More documents a language (``sample_docs``) learn from more, up to all of them.

A model is sorted arrays: for each order, the n-grams' 64-bit keys with one interpolated probability a language, and the
contexts' keys with one back-off weight a language; a lookup is a binary search. A document's language has the
lowest cross-entropy per character. Calibration is cross-fitted, at every size alike: the sample is cut into ``FOLDS`` parts by hash, and each document is scored
by models that its own part didn't teach. This gives the temperature that turns cross-entropies into a probability, and
per language the cross-entropy above which a text is rejected as foreign to all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import checkpoint, map_rows, md5_unit

ORDER = 4
#: Labelled documents a language that a model learns from, at most (on average over hashes).
SAMPLE_DOCS = 2000
FOLDS = 5
TEMPERATURES = (5.0, 10.0, 20.0, 40.0, 80.0)
REJECT_SIGMAS = 6.0
UNKNOWN = "und"
#: Characters that are scored at once.
_CHUNK = 1 << 18
_LETTER = np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(0x10000)])
_BLANK = np.uint16(32)


def codes_of(text: str | None) -> np.ndarray:
    """Lower-case letters and single blanks; characters beyond the basic plane are folded into 16 bits."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    far = raw > 0xFFFF
    letter = _LETTER[np.where(far, 0, raw)]
    if far.any():
        letter[far] = [chr(c).isalpha() for c in raw[far].tolist()]
        raw = np.where(far, 0xE000 + raw % 0x1900, raw)
    codes = np.where(letter, raw, 32).astype(np.uint16)
    return codes[(codes != _BLANK) | np.concatenate(([True], codes[:-1] != _BLANK))] if len(codes) else codes


def ngram_keys(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A key for each character, from it and the ``order`` - 1 before it, blanks before the first."""
    padded = np.concatenate((np.full(order - 1, _BLANK), codes)).astype(np.uint64)
    keys = np.zeros(len(codes), np.uint64)
    for k in range(order):
        keys = keys << np.uint64(16) | padded[k : k + len(codes)]
    return keys


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


@dataclass
class Model:
    """Of all languages: per order (1 first) sorted n-grams with probabilities, sorted contexts with back-off weights."""

    langs: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = TEMPERATURES[2]
    limits: np.ndarray | None = None

    def prob(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs)))
        place, found = _at(self.grams[order - 1], keys)
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[found] = self.probs[order - 1][place[found]]
        rest = keys[~found]
        if len(rest):
            lower = self.prob(rest & _mask(order - 1), order - 1)
            place, known = _at(self.contexts[order - 1], rest >> np.uint64(16))
            weight = np.ones_like(lower)
            weight[known] = self.backoff[order - 1][place[known]]
            out[~found] = weight * lower
        return out

    def entropies(self, texts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        """Cross-entropies per character by language, for each of some texts that aren't empty."""
        held: list[np.ndarray] = []
        size = 0
        for codes in texts:
            if held and size + len(codes) > _CHUNK:
                yield from self._entropies(held)
                held, size = [], 0
            held.append(codes)
            size += len(codes)
        if held:
            yield from self._entropies(held)

    def _entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts are summed piece by piece, so a very long one takes no more memory than any other."""
        sums = np.zeros((len(texts), len(self.langs)))
        lengths = np.array([len(c) for c in texts])
        every = np.concatenate([ngram_keys(c) for c in texts]) if len(texts) > 1 else ngram_keys(texts[0])
        text_of = np.repeat(np.arange(len(texts)), lengths)
        for first in range(0, len(every), _CHUNK):
            keys, back = np.unique(every[first : first + _CHUNK], return_inverse=True)
            cost = -np.log(self.prob(keys).astype(np.float64))
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(text_of[first : first + _CHUNK], cost[back, k], len(texts))
        return sums / lengths[:, None]


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's counts of n-grams of the highest order (keys, times)."""
    langs = sorted(counts)
    alphabet = len(np.unique(np.concatenate([k & _mask(1) for k, _ in counts.values()]))) + 1 if counts else 1
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in langs:
        keys, times = counts[lang]
        sort = np.argsort(keys)
        keys, times = keys[sort], times[sort].astype(np.float64)
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append((keys, times))
            if order > 1:  # lower orders count the kinds of n-gram that they end
                keys, kinds = np.unique(keys & _mask(order - 1), return_counts=True)
                times = kinds.astype(np.float64)
    model = Model(langs, [], [], [], [], np.full(len(langs), 1 / alphabet, np.float32))
    for order in range(1, ORDER + 1):
        tables = by_order[order - 1]
        grams = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.zeros(0, np.uint64)
        contexts = np.unique(grams >> np.uint64(16))
        lower = model.prob(grams & _mask(order - 1), order - 1)
        probs = np.empty((len(grams), len(langs)), np.float32)
        backoff = np.ones((len(contexts), len(langs)), np.float32)
        for k, (keys, times) in enumerate(tables):
            once, twice = (times == 1).sum(), (times == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            own, of = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(of, times), np.bincount(of)
            place, known = _at(own, contexts)
            backoff[known, k] = (discount * kinds / total)[place[known]]
            place, known = _at(own, grams >> np.uint64(16))
            sums = np.where(known, total[place], 1.0)
            mine, seen = _at(keys, grams)
            direct = np.where(seen, np.maximum(times[mine] - discount, 0) / sums, 0)
            weight = np.where(known, (discount * kinds / total)[place], 1.0)
            probs[:, k] = direct + weight * lower[:, k]
        model.grams.append(grams)
        model.probs.append(probs)
        model.contexts.append(contexts)
        model.backoff.append(backoff)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model learns from: CRC-32 of the id as text leaves 1 by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The models of the labelled documents that aren't held out. Without any, the model has no language.

    A language whose sample is all in one part (a single document, say) can't be cross-fitted: it has no limit and rejects nothing.
    """
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not share:
        return kneser_ney({})
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    sample = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where(md5_unit("langid", F.col("id")) < bound)
    sample = sample.select("lang", "text", F.floor(md5_unit("langid-fold", F.col("id"), F.md5(F.col("text").cast("binary"))) * FOLDS).cast("int").alias("fold"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, fold, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "text")), strict=True):
                by.setdefault((lang, fold), []).append(codes_of(text))
            for (lang, fold), texts in by.items():
                grams, times = np.unique(np.concatenate([ngram_keys(c) for c in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), fold, np.int32)), pa.array(grams.view(np.int64)), pa.array(times)], names=["lang", "fold", "gram", "times"])

    counts = sample.mapInArrow(counted, "lang string, fold int, gram long, times long").groupBy("lang", "fold", "gram").agg(F.sum("times").alias("times"))
    rows = counts.toArrow()
    lang_of, fold_of, gram, times = (rows.column(c).to_numpy() for c in ("lang", "fold", "gram", "times"))
    gram = gram.view(np.uint64)

    def learnt(some: np.ndarray) -> Model:
        tables = {}
        for lang in sorted(set(lang_of[some].tolist())):
            own = some & (lang_of == lang)
            keys, which = np.unique(gram[own], return_inverse=True)
            tables[lang] = (keys, np.bincount(which, times[own], len(keys)))
        return kneser_ney(tables)

    return _calibrated(learnt(np.ones(len(gram), bool)), [learnt(fold_of != k) for k in range(FOLDS)], sample)


def _calibrated(model: Model, without: list[Model], sample: DataFrame) -> Model:
    """``model`` with temperature and limits from ``sample`` (lang, text, fold), each fold scored by the model that it didn't teach."""
    shared = sample.sparkSession.sparkContext.broadcast(without)
    temps = [f"t{k}" for k in range(len(TEMPERATURES))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"lang": [], "cost": [], **{t: [] for t in temps}}
            texts = [codes_of(t) for t in batch.column("text").to_pylist()]
            langs, folds = batch.column("lang").to_pylist(), batch.column("fold").to_pylist()
            for fold, held in enumerate(shared.value):
                some = [k for k, c in enumerate(texts) if folds[k] == fold and langs[k] in held.langs and (c != _BLANK).any()]
                for row, k in zip(held.entropies(texts[k] for k in some), some, strict=True):
                    mine = held.langs.index(langs[k])
                    out["lang"].append(langs[k])
                    out["cost"].append(row[mine])
                    for name, t in zip(temps, TEMPERATURES, strict=True):
                        out[name].append(float(np.log(np.exp(-t * (row - row[mine])).sum())))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), *[(c, pa.float64()) for c in list(out)[1:]]]))

    rows = sample.mapInArrow(scored, "lang string, cost double, " + ", ".join(f"{t} double" for t in temps))
    stats = rows.groupBy("lang").agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("sd"), F.count("*").alias("n"), *[F.sum(t).alias(t) for t in temps]).collect()
    if stats:
        loss = [round(sum(r[t] for r in stats) / sum(r["n"] for r in stats), 6) for t in temps]
        model.temperature = TEMPERATURES[int(np.argmin(loss))]
        limits = {r["lang"]: r["mean"] + REJECT_SIGMAS * max(r["sd"], 0.05) for r in stats}
        model.limits = np.array([limits.get(lang, np.inf) for lang in model.langs])
    return model


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the prediction's calibrated probability), cross_entropy and rejected.

    Texts without a letter, null and empty ones too, are ``und`` with score 0, rejected; ties go to the first language by name.
    A rejected text of letters keeps its nearest language in lang_pred. Rows are judged one by one; columns named like new ones are replaced; an
    empty table gives an empty table; a model without languages gives ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        held = shared.value
        column = batch.column(text_col)
        lang, score, entropy, rejected = ([x] * batch.num_rows for x in (UNKNOWN, 0.0, None, True))
        some: list[int] = []

        def texts() -> Iterator[np.ndarray]:
            for k in range(batch.num_rows if held.langs else 0):
                codes = codes_of(column[k].as_py())
                if (codes != _BLANK).any():
                    some.append(k)
                    yield codes

        for place, cost in enumerate(held.entropies(texts())):
            k = some[place]
            best = int(np.argmin(cost))
            lang[k], entropy[k] = held.langs[best], float(cost[best])
            score[k] = float(1 / np.exp(-held.temperature * (cost - cost[best])).sum())
            rejected[k] = bool(held.limits is not None and cost[best] > held.limits[best])
        return {"lang_pred": lang, "score": score, "cross_entropy": entropy, "rejected": rejected}

    add = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_rows(docs, run, add)


def language_digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected."""
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def calibration(docs: DataFrame) -> DataFrame:
    """(lang, n, accuracy, mean_score, error, rejected) over the held-out labelled documents; error is how far the mean score is from the accuracy."""
    found = identify(docs.where(held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), train(docs.select("doc_id", "lang", "text"))).where(F.col("lang_pred") != UNKNOWN)
    right = F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))
    rows = found.groupBy("lang").agg(F.count("*").alias("n"), F.round(right, 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum(F.col("rejected").cast("long")).alias("rejected"))
    return rows.withColumn("error", F.round(F.abs(F.col("mean_score") - F.col("accuracy")), 4))
