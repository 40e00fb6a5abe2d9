"""First-stage retrieval of whole query sets: BM25 by field, put together in several ways, and a plain term count.

Scores are rounded to six digits before they order anything, so that sums of doubles in another order give the same ranks; equal scores
are ordered by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.numbers import round_half_up
from lodestar.operators import index as ix
from lodestar.operators import phrases


@dataclass(frozen=True)
class Profile:
    """BM25 parameters; ``factor`` multiplies all scores (k1 + 1 in older engines)."""

    k1: float = 1.2
    b: float = 0.75
    factor: float = 1.0


DEFAULT = Profile()
PAPER = Profile(k1=1.5, b=0.75)


def bm25(profile: Profile, tf: Column, df: Column, dl: Column, n_docs: Column, avg_len: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))
    return idf * (tf / (tf + profile.k1 * (F.lit(1.0 - profile.b) + profile.b * dl / avg_len))) * profile.factor


def top_k(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best rows of each query by score and id, with rank; ``keys`` are further columns of the group."""
    order = Window.partitionBy("query_id", *keys).orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_scores(docs: DataFrame, queries: DataFrame, fields: list[str], *, profile: Profile = DEFAULT, analyzer=tx.tokens, tokens: DataFrame | None = None, stored=None, dataset: str | None = None) -> DataFrame:
    """(query_id, id, field, term, qtf, score): BM25 of each matching term, score without qtf.

    A ``stored`` index (``segments.Index``) is read instead of documents or tokens, of one ``dataset`` if asked for.
    """
    terms = ix.query_terms(queries, analyzer)
    if stored is not None:
        posted = stored.postings(terms, dataset).where(F.col("field").isin(fields))
        fields_of, frequencies = stored.fields, stored.frequencies(terms)
    else:
        tokens = ix.tokenized(docs, fields, analyzer) if tokens is None else tokens
        posted = ix.postings(tokens, terms)
        fields_of, frequencies = ix.field_stats(tokens), ix.document_frequencies(posted)
    few = terms.limit(ix.BROADCAST_ROWS + 1).count() <= ix.BROADCAST_ROWS  # and so are their frequencies, a row per term and field
    stats = posted.join(F.broadcast(frequencies) if few else frequencies, ["field", "term"]).join(F.broadcast(fields_of), "field")  # a row per field
    scored = stats.select("field", "term", "id", bm25(profile, F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avg_len")).alias("score"))
    return scored.join(F.broadcast(terms) if few else terms, "term").select("query_id", "id", "field", "term", "qtf", "score")


def field_scores(scores: DataFrame) -> DataFrame:
    """(query_id, id, field, score) from the scores of terms."""
    return scores.groupBy("query_id", "id", "field").agg(F.sum(F.col("score") * F.col("qtf")).alias("score"))


def _wide(scores: DataFrame, boosts: dict[str, float], terms_per_field: bool = False) -> DataFrame:
    more = [F.sum(F.when(F.col("field") == f, F.col("qtf"))).alias(f"n_{f}") for f in boosts] if terms_per_field else []
    return scores.groupBy("query_id", "id").agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("score") * F.col("qtf"))), F.lit(0.0)).alias(f) for f in boosts], *more)


def _boosted(boosts: dict[str, float]) -> list[Column]:
    return [F.col(f) * F.lit(float(w)) for f, w in boosts.items()]


def best_fields(scores: DataFrame, boosts: dict[str, float], tie_breaker: float = 0.0) -> DataFrame:
    """(query_id, id, score): the best field's score, and ``tie_breaker`` times the others'."""
    every = _boosted(boosts)
    best = F.greatest(*every) if len(every) > 1 else every[0]
    total = reduce(lambda a, b: a + b, every)
    return _wide(scores, boosts).select("query_id", "id", round_half_up(best + tie_breaker * (total - best), 6).alias("score"))


def field_sum(scores: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(query_id, id, score): the fields' scores added."""
    return _wide(scores, boosts).select("query_id", "id", round_half_up(reduce(lambda a, b: a + b, _boosted(boosts)), 6).alias("score"))


def at_least(scores: DataFrame, terms: DataFrame, boosts: dict[str, float], share: float) -> DataFrame:
    """Best fields among those that match floor(share * terms) of the query's terms (repeats counted), one at least."""
    asked = terms.groupBy("query_id").agg(F.greatest(F.floor(F.sum("qtf") * F.lit(share)), F.lit(1)).alias("needed"))
    wide = _wide(scores, boosts, terms_per_field=True).join(ix.small(asked), "query_id")
    enough = [F.when(F.col(f"n_{f}") >= F.col("needed"), F.col(f) * F.lit(float(w))) for f, w in boosts.items()]
    return wide.withColumn("score", round_half_up(F.greatest(*enough), 6)).where(F.col("score").isNotNull()).select("query_id", "id", "score")


def _posted(docs: DataFrame, terms: DataFrame, fields: list[str], analyzer, stored, positions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, frequencies, fields) of some terms, from a stored index or from the documents."""
    if stored is not None:
        within = F.col("field").isin(fields)
        return stored.postings(terms, positions=positions).where(within), stored.frequencies(terms).where(within), stored.fields
    tokens = ix.tokenized(docs, fields, analyzer)
    posted = ix.postings(tokens, terms, positions)
    return posted, ix.document_frequencies(posted), ix.field_stats(tokens)


def cross_fields(docs: DataFrame, queries: DataFrame, boosts: dict[str, float], *, profile: Profile = DEFAULT, analyzer=tx.tokens, stored=None) -> DataFrame:
    """Term-centric scores: each term's best field, document frequencies blended to the largest of any field, all terms needed."""
    terms = ix.query_terms(queries, analyzer)
    posted, frequencies, fields = _posted(docs, terms, list(boosts), analyzer, stored)
    blended = frequencies.groupBy("term").agg(F.max("df").alias("df"))
    stats = posted.join(blended, "term").join(F.broadcast(fields), "field")  # a row per field
    boost = reduce(lambda e, f: e.when(F.col("field") == f, F.lit(float(boosts[f]))), list(boosts)[1:], F.when(F.col("field") == next(iter(boosts)), F.lit(float(next(iter(boosts.values()))))))
    df = F.least(F.col("df"), F.col("n_docs"))
    best = stats.groupBy("term", "id").agg(F.max(boost * bm25(profile, F.col("tf"), df, F.col("dl"), F.col("n_docs"), F.col("avg_len"))).alias("score"))
    asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    found = best.join(ix.small(terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("score") * F.col("qtf")).alias("score"), F.count("*").alias("found"))
    return found.join(ix.small(asked), "query_id").where("found = asked").select("query_id", "id", round_half_up(F.col("score"), 6).alias("score"))


def phrase(docs: DataFrame, queries: DataFrame, boosts: dict[str, float], *, slop: int = 3, profile: Profile = DEFAULT, analyzer=tx.tokens, stored=None, located: bool = False) -> DataFrame:
    """(query_id, id, score): best field's phrase score with slop: BM25 of the idf of all words, repeats counted, and the frequency of sloppy matches (``phrases``).

    Only fields with all of a query's words are matched, found by places in a stored index and else from the rarest word; a document's positions of a query's words meet in one row. A query without words has no rows.
    ``located`` adds shard and place, where a stored index has the document.
    """
    asked = queries.select("query_id", F.posexplode(analyzer(F.col("query"))).alias("at", "term")).groupBy("query_id", "term").agg(F.sort_array(F.collect_list("at")).alias("places"))
    different = asked.groupBy("query_id").agg(F.count("*").alias("different"))
    # one term a query and field at most, so the number of queries tells its size without a look at the postings
    few = F.broadcast if queries.limit(ix.BROADCAST_ROWS // len(boosts) + 1).count() <= ix.BROADCAST_ROWS // len(boosts) else lambda df: df
    if stored is not None:
        frequency, fields, there = stored.frequencies(asked), stored.fields, stored.holding(asked, list(boosts))
    else:
        posted, frequency, fields = _posted(docs, asked, list(boosts), analyzer, None, positions=True)
        rarest = asked.join(frequency, "term").groupBy("query_id", "field").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("n"))
        rarest = rarest.join(few(different), "query_id").where("n = different").select("query_id", "field", "term")
        candidates = posted.select("field", "term", "id").join(few(rarest), ["field", "term"]).select("query_id", "field", "id")
        there = posted.join(candidates, ["field", "id"])
    there = there.join(ix.small(asked), ["query_id", "term"]).join(frequency, ["field", "term"]).join(F.broadcast(fields), "field")  # a row per field
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.size("places")
    at = [c for c in ("shard", "place") if c in there.columns]  # where a stored index has the document
    whole = there.groupBy("query_id", "field", "id", "dl", "avg_len", *at).agg(F.collect_list(F.struct("places", "positions")).alias("words"), F.sum(idf).alias("idf")).join(few(different), "query_id").where(F.size("words") == F.col("different"))
    matched = whole.withColumn("freq", phrases.frequencies(slop)(F.col("words.places"), F.col("words.positions"))).where("freq > 0")
    score = F.col("idf") * F.col("freq") / (F.col("freq") + profile.k1 * (F.lit(1 - profile.b) + profile.b * F.col("dl") / F.col("avg_len"))) * profile.factor
    boost = reduce(lambda e, f: e.when(F.col("field") == f, F.lit(float(boosts[f]))), list(boosts), F.when(F.lit(False), F.lit(0.0)))
    return matched.groupBy("query_id", "id", *at).agg(round_half_up(F.max(score * boost), 6).alias("score")).select("query_id", "id", *(at if located else []), "score")


def rescue(docs: DataFrame, queries: DataFrame, fields: dict[str, float], phrase_fields: dict[str, float], *, profile: Profile = DEFAULT, analyzer=tx.tokens, stored=None) -> DataFrame:
    """Best fields as a must, with three optional clauses added: phrase (x3), cross fields (x2) and 70 % of terms (x1.5)."""
    scores = term_scores(docs, queries, list(fields), profile=profile, analyzer=analyzer, stored=stored)
    must = best_fields(scores, fields)
    more = [(phrase(docs, queries, phrase_fields, profile=profile, analyzer=analyzer, stored=stored), 3.0), (cross_fields(docs, queries, fields, profile=profile, analyzer=analyzer, stored=stored), 2.0), (at_least(scores, ix.query_terms(queries, analyzer), fields, 0.7), 1.5)]
    for k, (clause, boost) in enumerate(more):
        must = must.join(clause.select("query_id", "id", (F.col("score") * boost).alias(f"clause{k}")), ["query_id", "id"], "left")
    total = reduce(lambda a, k: a + F.coalesce(F.col(f"clause{k}"), F.lit(0.0)), range(len(more)), F.col("score"))
    return must.select("query_id", "id", round_half_up(total, 6).alias("score"))


def term_count_search(docs: DataFrame, queries: DataFrame, boosts: dict[str, int], k: int) -> DataFrame:
    """(query_id, id, score, rank): boosted counts of the query's tokens, each occurrence in the query counted."""
    posted = ix.postings(ix.tokenized(docs, list(boosts)), terms := ix.query_terms(queries))
    boost = reduce(lambda e, f: e.when(F.col("field") == f, F.lit(boosts[f])), list(boosts), F.when(F.lit(False), F.lit(0)))
    scored = posted.join(ix.small(terms), "term").groupBy("query_id", "id").agg(F.sum(boost * F.col("tf") * F.col("qtf")).alias("score"))
    return top_k(scored.where("score > 0"), k)


def total_hits(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id").agg(F.count("*").alias("total_hits"))


def without_identical(scored: DataFrame) -> DataFrame:
    """Drops a document that is the query itself, before the best are taken."""
    return scored.where(F.col("id") != F.col("query_id"))


def further_queries(expansion: DataFrame) -> DataFrame:
    """(query_id, query) from the unique expansion terms (query_id, term)."""
    return expansion.select("query_id", "term").distinct().groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("term"))).alias("query"))


def expanded_field_sum(tokens: DataFrame | None, queries: DataFrame, expansion: DataFrame, boosts: dict[str, float], expansion_boosts: dict[str, float], *, profile: Profile = DEFAULT, analyzer=tx.tokens, stored=None) -> DataFrame:
    """Field sums of the query's clauses and of those of its unique expansion terms (query_id, term), with boosts of their own."""
    parts = []
    for asked, weights in ((queries, boosts), (further_queries(expansion), expansion_boosts)):
        wide = _wide(term_scores(None, asked, list(weights), profile=profile, analyzer=analyzer, tokens=tokens, stored=stored), weights)
        parts.append(wide.select("query_id", "id", reduce(lambda a, b: a + b, _boosted(weights)).alias("score")))
    return parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(round_half_up(F.sum("score"), 6).alias("score"))


def mapped_hits(run: DataFrame, docs: DataFrame, dataset: str) -> DataFrame:
    """(query_id, id, rank, score, title, abstract, source): hits as a caller gets them.

    Titles and abstracts that are missing are empty, a missing or empty source is the dataset; a hit whose document isn't there stays. ``docs`` may lack any column but id.
    """
    own = docs.select("id", *[(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "abstract", "source")])
    text = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)).alias(c)
    return run.select("query_id", "id", "rank", "score").join(own, "id", "left").select("query_id", "id", "rank", "score", text("title", ""), text("abstract", ""), text("source", dataset))


def cases(queries: DataFrame, run: DataFrame, size: int) -> DataFrame:
    """(query_id, query, results): every query with its best ``size`` hits (id, score, rank) in order, none for a query that the run lacks."""
    best = run.where(F.col("rank") <= size).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("results"))
    joined = queries.select("query_id", "query").join(best, "query_id", "left")
    return joined.withColumn("results", F.coalesce("results", F.array().cast("array<struct<rank: int, id: string, score: double>>")))
