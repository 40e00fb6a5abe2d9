"""The search engine: whole query sets over one corpus, under one of six architectures.

``Engine`` reads a stored index (``segments.Index``, which ``save`` makes for later sessions), or, where there is none, the documents themselves. ``explain`` adds
the plan's text and the path that led to the results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import index as ix
from lodestar.operators import rerank
from lodestar.operators import retrieval as rt
from lodestar.operators.segments import Index
from lodestar.operators.store import materialized
from lodestar.plans.errors import NotAvailableError, NotFoundError, ValidationError

# Boosts of the fields.
BOOSTS = {"title": 3, "abstract": 2, "text": 1}
PHRASE_BOOSTS = {"title": 8, "abstract": 5, "text": 2}
COLLECTION_BOOSTS = {"title": 1, "text": 1}
COLLECTION_TIE = 0.5
MOST_RESULTS = 50


@dataclass(frozen=True)
class Architecture:
    id: str
    status: str
    strategy: str
    aliases: tuple[str, ...]
    stages: tuple[str, ...]


ARCHITECTURES = {
    a.id: a
    for a in [
        Architecture("baseline", "accepted", "best field of title, abstract and text", ("default", "v0", "v0.1", "bm25"), ("bm25 best fields",)),
        Architecture("query-rescue", "candidate", "baseline with phrase, cross-field and most-terms clauses added", ("query_rescue", "rescue"), ("bm25 best fields", "phrase", "cross fields", "most terms")),
        Architecture("field-sum", "candidate", "sum of the fields' scores", ("field_sum", "summed-fields", "v0.2-candidate"), ("bm25 field sum",)),
        Architecture("coverage-rerank", "candidate", "top 50 by field sum, reranked by coverage of query terms", ("coverage_rerank", "rerank"), ("bm25 field sum", "coverage rerank")),
        Architecture("prf-rerank", "candidate", "top 50 by field sum, reranked by coverage of query and feedback terms", ("prf_rerank", "prf", "rm3"), ("bm25 field sum", "feedback terms", "feedback rerank")),
        Architecture("prf-expand-rerank", "candidate", "top 50 and a second retrieval with feedback terms, merged and reranked", ("prf_expand_rerank", "prf-expanded-rerank", "prf_expand", "rm3-expand"), ("bm25 field sum", "feedback terms", "expanded field sum", "merge", "feedback rerank")),
    ]
}


def resolve(architecture: str | None = None) -> Architecture:
    name = (architecture or "baseline").strip().lower()
    for a in ARCHITECTURES.values():
        if name == a.id or name in a.aliases:
            return a
    raise ValidationError("architecture must be one of " + ", ".join(ARCHITECTURES), "invalid_architecture")


def result_size(value: object = None, default: int = 10) -> int:
    if value is None or value == "":
        return default
    try:
        size = float(str(value))
    except ValueError:
        size = 0.0
    if size != int(size) or not 1 <= size <= MOST_RESULTS:
        raise ValidationError(f"size must be an integer between 1 and {MOST_RESULTS}", "invalid_size")
    return int(size)


def normalized(query: str | None) -> str:
    text = re.sub(r"\s+", " ", (query or "").strip())
    if not text:
        raise ValidationError("q is required", "missing_query")
    return text


class Engine:
    def __init__(self, docs: DataFrame, *, fields: dict[str, float] = BOOSTS, profile: rt.Profile = rt.DEFAULT, analyzer: ix.Analyzer = tx.tokens, stored: Index | None = None) -> None:
        self.docs, self.fields, self.profile, self.analyzer, self.stored = docs, fields, profile, analyzer, stored

    def save(self, path: str) -> Engine:
        """Makes an index of the corpus at ``path``, which has none yet; the engine over it."""
        index = Index.create(self.docs.sparkSession, path, list(self.fields), analyzer=self.analyzer)
        if index.told["segments"]:
            raise FileExistsError(f"{path} has an index")
        return Engine(self.docs, fields=self.fields, profile=self.profile, analyzer=self.analyzer, stored=index.load(self.docs))

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, analyzer: ix.Analyzer = tx.tokens, **options) -> Engine:
        """An engine over the newest version of the index at ``path``, which ``save``, ``Index.load`` or a stream wrote."""
        index = Index.open(spark, path, analyzer=analyzer)
        return cls(index.stored().drop("segment"), stored=index, analyzer=analyzer, **options)

    def count(self, dataset: str | None = None) -> int:
        if self.stored is not None:
            return self.stored.count(dataset)
        return (self.docs if dataset is None else self.docs.where(F.col("dataset") == dataset)).count()

    def scored(self, queries: DataFrame, architecture: str = "field-sum", dataset: str | None = None) -> DataFrame:
        """(query_id, id, score) of all matches at the first stage, of one dataset if asked for; what terms are worth doesn't depend on that."""
        a = resolve(architecture)
        if a.id == "query-rescue":
            found = rt.rescue(self.docs, queries, self.fields, {f: PHRASE_BOOSTS[f] for f in self.fields}, profile=self.profile, analyzer=self.analyzer, stored=self.stored)
        else:
            terms = rt.term_scores(self.docs, queries, list(self.fields), profile=self.profile, analyzer=self.analyzer, stored=self.stored, dataset=dataset)
            found = rt.best_fields(terms, self.fields) if a.id == "baseline" else rt.field_sum(terms, self.fields)
        if dataset is not None and (self.stored is None or a.id == "query-rescue"):
            found = found.join(self.docs.where(F.col("dataset") == dataset).select("id"), "id", "left_semi")
        return found.select("query_id", "id", "score")

    def pool(self, queries: DataFrame, size: int = rerank.POOL_SIZE, *, ignore_identical: bool = False, dataset: str | None = None) -> DataFrame:
        """(query_id, query, id, score, rank, title, abstract): the first stage's best by field sum, with what reranking needs."""
        return materialized(self._with_texts(materialized(self.best(queries, size, "field-sum", ignore_identical=ignore_identical, dataset=dataset)), queries))

    def best(self, queries: DataFrame, size: int, architecture: str, *, ignore_identical: bool = False, dataset: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) of a first stage; an index skips what can't be among the best."""
        if self.stored is None:
            found = self.scored(queries, architecture, dataset)
            return rt.top_k(rt.without_identical(found) if ignore_identical else found, size)
        p, tie = self.profile, 0.0 if architecture == "baseline" else None
        if architecture == "query-rescue":
            phrases = rt.phrase(None, queries, {f: PHRASE_BOOSTS[f] for f in self.fields}, profile=p, analyzer=self.analyzer, stored=self.stored, located=True)
            found = self.stored.rescue(queries, size + ignore_identical, self.fields, phrases, profile=(p.k1, p.b, p.factor), dataset=dataset, analyzer=self.analyzer)
        else:
            found = self.stored.top(queries, size + ignore_identical, self.fields, tie=tie, k1=p.k1, b=p.b, factor=p.factor, dataset=dataset, analyzer=self.analyzer)
        return rt.top_k(rt.without_identical(found).drop("rank"), size) if ignore_identical else found

    def _with_texts(self, ranked: DataFrame, queries: DataFrame) -> DataFrame:
        columns = [c for c in ("title", "abstract", "text") if c in self.docs.columns]
        body = F.coalesce("abstract", "text") if "abstract" in columns else F.col("text")
        """``ranked`` (rows by query, materialized) with queries and texts: documents that it lacks are passed over where they are read."""
        texts = self.docs.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(body, F.lit("")).alias("abstract"))
        return texts.join(ix.small(ranked), "id").join(ix.small(queries.select("query_id", "query")), "query_id").select("query_id", "query", "id", "score", "rank", "title", "abstract")

    def search(self, queries: DataFrame, size: int = 10, architecture: str = "baseline", *, ignore_identical: bool = False, dataset: str | None = None) -> DataFrame:
        """(query_id, id, score, rank), for reranking architectures by their own score; of documents of one dataset, if asked for."""
        a, size = resolve(architecture), result_size(size)
        if a.id in ("baseline", "field-sum", "query-rescue"):
            return self.best(queries, size, a.id, ignore_identical=ignore_identical, dataset=dataset)
        pool = self.pool(queries, max(size, rerank.POOL_SIZE), ignore_identical=ignore_identical, dataset=dataset)
        if a.id == "coverage-rerank":
            ranked = rerank.by_coverage(pool)
        elif a.id == "prf-rerank":
            ranked = rerank.by_feedback(pool)
        else:
            ranked = self.expanded(pool, queries, dataset=dataset)
        return ranked.where(F.col("rank") <= size).select("query_id", "id", F.col("rerank_score").alias("score"), "rank")

    def expanded(self, pool: DataFrame, queries: DataFrame, size: int = rerank.EXPANDED_SIZE, *, dataset: str | None = None) -> DataFrame:
        terms = materialized(rerank.feedback_terms(pool))
        p, more = self.profile, {f: rerank.EXPANSION_BOOSTS[f] for f in self.fields}
        if self.stored is not None:
            again = self.stored.expanded(queries, rt.further_queries(terms), size, self.fields, more, profile=(p.k1, p.b, p.factor), dataset=dataset, analyzer=self.analyzer)
        else:
            found = rt.expanded_field_sum(ix.tokenized(self.docs, list(self.fields), self.analyzer), queries, terms, self.fields, more, profile=p, analyzer=self.analyzer)
            again = rt.top_k(found if dataset is None else found.join(self.docs.where(F.col("dataset") == dataset).select("id"), "id", "left_semi"), size)
        merged = materialized(rerank.merged_pools(pool, again))
        details = self._with_texts(merged.select("query_id", "id", F.lit(0).alias("score"), F.lit(0).alias("rank")), queries)
        return rerank.by_expanded_feedback(merged, details, terms)

    def ask(self, query: str, size: object = None, architecture: str = "baseline") -> dict:
        """One query's results with what was made of it: the facade for interactive use."""
        text, n, a = normalized(query), result_size(size), resolve(architecture)
        asked = self.docs.sparkSession.createDataFrame([("q", text)], "query_id string, query string")
        hits = self.search(asked, n, a.id).orderBy("rank")
        return {"query": query, "normalized": text, "size": n, "architecture": a.id, "strategy": a.strategy, "results": [r.asDict() for r in hits.drop("query_id").collect()]}

    def explain(self, query: str, size: object = None, architecture: str = "baseline") -> dict:
        """``ask`` with the stages of the architecture and the physical plan."""
        answer = self.ask(query, size, architecture)
        asked = self.docs.sparkSession.createDataFrame([("q", answer["normalized"])], "query_id string, query string")
        plan = self.search(asked, answer["size"], answer["architecture"])._jdf.queryExecution().toString()
        return answer | {"stages": list(resolve(architecture).stages), "plan": plan}


# Milestones, the architectures behind them (none: it needs vectors of an external model), other names.
MILESTONES = {"arch-0.1": "baseline", "arch-0.2-prf": "prf-rerank", "arch-0.3-bge": None}
MILESTONE_NAMES = {"v0.1": "arch-0.1", "baseline": "arch-0.1", "prf": "arch-0.2-prf", "prf-rerank": "arch-0.2-prf", "bge": "arch-0.3-bge", "vector-hybrid": "arch-0.3-bge"}


def milestone(name: str) -> Architecture:
    """The architecture that a milestone pins; whatever a caller asks for, a milestone's search uses its own."""
    key = name.strip().lower()
    key = MILESTONE_NAMES.get(key, key)
    if key not in MILESTONES:
        raise NotFoundError(f"unknown milestone {name}")
    if MILESTONES[key] is None:
        raise NotAvailableError("this milestone needs embeddings of an external model")
    return resolve(MILESTONES[key])


def collection_search(docs: DataFrame | None, queries: DataFrame, size: int = 10, *, profile: rt.Profile = rt.DEFAULT, ignore_identical: bool = False, analyzer: ix.Analyzer = tx.tokens, stored: Index | None = None) -> DataFrame:
    """Best fields over title and text, the other field counting half: how collections of (id, title, text) are searched, or an index of them."""
    if stored is not None:
        found = stored.top(queries, size + ignore_identical, COLLECTION_BOOSTS, tie=COLLECTION_TIE, k1=profile.k1, b=profile.b, factor=profile.factor, analyzer=analyzer)
        return rt.top_k(rt.without_identical(found).drop("rank"), size) if ignore_identical else found
    found = rt.best_fields(rt.term_scores(docs, queries, list(COLLECTION_BOOSTS), profile=profile, analyzer=analyzer), COLLECTION_BOOSTS, COLLECTION_TIE)
    return rt.top_k(rt.without_identical(found) if ignore_identical else found, size)


# Boosts of a collection's pool.
POOL_BOOSTS = {"title": 3, "text": 2}


def collection_pool(docs: DataFrame | None, queries: DataFrame, size: int = rerank.POOL_SIZE, *, profile: rt.Profile = rt.DEFAULT, analyzer: ix.Analyzer = tx.tokens, stored: Index | None = None) -> DataFrame:
    """(query_id, id, score, rank): the pool of a collection of (id, title, text), by the sum of both fields."""
    if stored is not None:
        return stored.top(queries, size, POOL_BOOSTS, k1=profile.k1, b=profile.b, factor=profile.factor, analyzer=analyzer)
    return rt.top_k(rt.field_sum(rt.term_scores(docs, queries, list(POOL_BOOSTS), profile=profile, analyzer=analyzer), POOL_BOOSTS), size)
