"""The registered queries: operators applied to the driver's tables, read as a retrieval collection.

Documents are the collection, benchmark items the queries, and a document that holds an item's text is relevant to it; embeddings whose id
divides by 100 are the queries of vector search.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.numbers import dot, round_half_up
from lodestar.operators import compare, embedcache, english, failures, ltr, metrics, rerank, vectorindex, vectors
from lodestar.operators import index as ix
from lodestar.operators import retrieval as rt
from lodestar.operators.segments import Index
from lodestar.operators.store import Folder, materialized, shared_folder
from lodestar.plans.engine import BOOSTS, PHRASE_BOOSTS, Engine, collection_search
from lodestar.plans.engine import collection_pool as pool_of_collection
from lodestar.plans.formats import FORMATS
from lodestar.sources import corpora
from lodestar.streaming import ingest

K = 10
WEIGHTS = [k / 10 for k in range(1, 10)]
LTR_WEIGHTS = {"lexicalScore": 1.0, "anyCoverage": 0.25, "feedbackCoverage": 0.1, "phraseCoverage": 0.05, "vectorScore": 0.2}
PUBLISHED = 0.43

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one scale as a collection."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        read = lambda name: corpora.read_table(spark, f"{sf_dir}/{name}.parquet")
        self.read = read
        self.docs = corpora.table_documents(read("documents"))
        self.queries = corpora.table_queries(read("benchmark"))
        self.documents = f"{sf_dir}/documents.parquet"
        self._held: dict[str, DataFrame] = {}
        self._engine: Engine | None = None

    def _opened(self, name: str, analyzer: ix.Analyzer) -> Engine:
        """The documents' index under an analyzer, with languages as datasets: made by the first query of a session that needs it, and read by later ones until the files change."""
        files = self.spark.read.format("binaryFile").load(self.documents).select("path", "length", "modificationTime")
        state = files.agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "path", "length", "modificationTime")))))).first()[0]  # a row a file
        path = f"{shared_folder(self.spark)}/{name}-{state}"
        index = Index.create(self.spark, path, list(BOOSTS), analyzer=analyzer)
        index = index if index.told["segments"] else index.load(corpora.table_documents(self.read("documents"), "lang"), batch="tables", store=False)
        return Engine(self.docs, stored=index, analyzer=analyzer)

    @property
    def engine(self) -> Engine:
        if self._engine is None:
            self._engine = self._opened("tables", tx.tokens)
        return self._engine

    def english_engine(self) -> Engine:
        return self._opened("english", english.analyzed)

    @property
    def index(self) -> Index:
        return self.engine.stored

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = materialized(make())
        return self._held[name]

    def qrels(self) -> DataFrame:
        return self._once("qrels", lambda: corpora.table_qrels(self.docs, self.queries, self.read("labels")))

    def terms(self, profile: rt.Profile = rt.DEFAULT) -> DataFrame:
        return rt.term_scores(None, self.queries, list(BOOSTS), profile=profile, stored=self.index)

    def baseline(self, k: int = K) -> DataFrame:
        return self._once(f"baseline-{k}", lambda: self.engine.best(self.queries, k, "baseline"))

    def pool(self) -> DataFrame:
        if "pool" not in self._held:
            self._held["pool"] = self.engine.pool(self.queries)
        return self._held["pool"]

    def judged_pool(self) -> DataFrame:
        return self.pool().join(self.qrels(), ["query_id", "id"], "left")

    def hashed(self, docs: DataFrame, text: str) -> DataFrame:
        return vectors.hash_vectors(docs, text)

    def query_vectors(self) -> DataFrame:
        return self.hashed(self.queries.select(F.col("query_id").alias("id"), "query"), "query").withColumnRenamed("id", "query_id")

    def vector_run(self, k: int = 50) -> DataFrame:
        return self._once(f"vectors-{k}", lambda: vectors.nearest(self.hashed(self.docs, "text"), self.query_vectors(), k))

    def embeddings(self) -> tuple[DataFrame, DataFrame]:
        rows = self.read("embeddings")
        docs = rows.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
        return docs, rows.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding", "label")

    def scored(self, run: DataFrame, mode: str = "graded") -> DataFrame:
        return metrics.per_query(self.queries, run, self.qrels(), k=K, mode=mode)

    def classified(self, run: DataFrame) -> DataFrame:
        return failures.classified(self.scored(run))

    def reranked(self) -> DataFrame:
        return self._once("reranked", lambda: rerank.by_coverage(self.pool()).where(F.col("rank") <= K))

    def domains(self) -> DataFrame:
        """(query_id, dataset): queries in groups by length, which stand for datasets in reports."""
        n = F.size(tx.tokens(F.col("query")))
        return self.queries.select("query_id", F.when(n < 30, "short").when(n < 45, "medium").otherwise("long").alias("dataset"))


def _ranked(run: DataFrame) -> DataFrame:
    return run.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score")


def fixture_term_search(t: Tables) -> DataFrame:
    return _ranked(rt.term_count_search(t.docs, t.queries, BOOSTS, K))


def bm25_best_fields(t: Tables) -> DataFrame:
    return _ranked(t.baseline())


def bm25_field_sum(t: Tables) -> DataFrame:
    return _ranked(t.engine.best(t.queries, K, "field-sum"))


def bm25_tie_breaker(t: Tables) -> DataFrame:
    return _ranked(collection_search(None, t.queries, K, stored=t.index))


def bm25_paper_profile(t: Tables) -> DataFrame:
    return _ranked(t.index.top(t.queries, K, BOOSTS, k1=rt.PAPER.k1, b=rt.PAPER.b))


def mapped_hits(t: Tables) -> DataFrame:
    docs = t.docs.join(t.read("documents").select(F.col("doc_id").cast("string").alias("id"), "source"), "id")
    return rt.mapped_hits(_ranked(t.baseline()), docs, "driver-tables").withColumn("abstract", F.md5("abstract"))


def lexical_cases(t: Tables) -> DataFrame:
    """The best 5 of the stored run of each query, also of one that it has nothing for."""
    odd = t.spark.range(1).select(F.lit("none").alias("query_id"), F.lit("no such query").alias("query"))
    found = rt.cases(t.queries.unionByName(odd), t.baseline(), 5)
    return found.select("query_id", F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda r: r["id"]), ",").alias("ids"))


def msm_filter(t: Tables) -> DataFrame:
    return _ranked(t.index.at_least(t.queries, K, BOOSTS, 0.7))


def total_hits(t: Tables) -> DataFrame:
    return rt.total_hits(rt.field_sum(t.terms(), BOOSTS))


def phrase_search(t: Tables) -> DataFrame:
    return _ranked(rt.top_k(rt.phrase(None, t.queries, PHRASE_BOOSTS, stored=t.index), K))


def cross_fields_search(t: Tables) -> DataFrame:
    return _ranked(t.index.cross_fields(t.queries, K, BOOSTS))


def query_rescue(t: Tables) -> DataFrame:
    return _ranked(t.engine.search(t.queries, K, "query-rescue"))


def english_bm25(t: Tables) -> DataFrame:
    """Best fields over stems, a query's words joined to a vocabulary with stems, and not analyzed as a text is, before the index of stems is searched."""
    asked = english.stemmed(t.queries.select(F.col("query_id").alias("id"), "query"), ["query"]).select(F.col("id").alias("query_id"), F.array_join("tokens", " ").alias("query"))
    return _ranked(t.english_engine().stored.top(asked, K, BOOSTS, tie=0.0, analyzer=lambda c: F.filter(F.split(c, " "), lambda w: w != "")))


def bm25_english(t: Tables) -> DataFrame:
    """Best fields from a stored index of stems."""
    return _ranked(t.english_engine().best(t.queries, K, "baseline"))


def english_words(t: Tables) -> DataFrame:
    """How many words each document has by Unicode's boundaries, stopwords left out, and which."""
    words = english.words(F.col("text"))
    return t.docs.select("id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def english_stem(t: Tables) -> DataFrame:
    return english.vocabulary(t.docs, ["text"])


def coverage_rerank(t: Tables) -> DataFrame:
    return _reranked(rerank.by_coverage(t.pool()))


def _reranked(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "id", F.col("original_rank").cast("long").alias("original_rank"), "rerank_score", F.col("rank").cast("long").alias("rank"))


def prf_feedback_terms(t: Tables) -> DataFrame:
    return rerank.feedback_terms(t.pool()).withColumn("place", F.col("place").cast("long"))


def prf_rerank(t: Tables) -> DataFrame:
    return _reranked(rerank.by_feedback(t.pool()))


def prf_expand_merge(t: Tables) -> DataFrame:
    out = t.engine.expanded(t.pool(), t.queries)
    return out.select("query_id", "id", "original_score", "expanded_score", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("original_rank", "expanded_rank")], F.concat_ws("+", "retrieval_sources").alias("sources"), "rerank_score", F.col("rank").cast("long").alias("rank"))


def prf_grid(t: Tables) -> DataFrame:
    runs = rerank.feedback_grid(t.pool(), [0.0, 0.01, 0.02, 0.04, 0.06])
    return metrics.aggregate(metrics.per_query(t.queries, runs, t.qrels(), k=K, keys=("phrase_weight",)), "phrase_weight")


def embedding_cache(t: Tables) -> DataFrame:
    """Local-hash embeddings of the documents by way of a new cache, so that all of them are made; entries other than 0."""
    cache, provider = embedcache.EmbeddingCache(t.spark, f"{shared_folder(t.spark)}/embeddings-{uuid.uuid4()}"), embedcache.LocalHash()
    dense = cache.embedded(t.docs, provider)
    return dense.select("id", F.posexplode("embedding").alias("component", "value")).where("value <> 0").select("id", F.col("component").cast("long").alias("component"), "value")


def embedding_runs(t: Tables) -> DataFrame:
    """What three runs of one cache make: over the documents of one language, over all, and over all again."""
    cache, provider = embedcache.EmbeddingCache(t.spark, f"{shared_folder(t.spark)}/embed-runs-{uuid.uuid4()}"), embedcache.LocalHash()
    english_ones = t.read("documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"), "text")
    try:
        told = [(k, docs.count(), cache.fill(docs, provider), cache.held(provider).count()) for k, docs in enumerate((english_ones, t.docs, t.docs), 1)]
        return t.spark.createDataFrame(told, "run long, asked long, made long, held long")
    finally:
        cache.drop()


def local_hash_embedding(t: Tables) -> DataFrame:
    return vectors.hash_entries(t.docs, "text")


def knn_exact(t: Tables) -> DataFrame:
    return _ranked(vectors.nearest(*t.embeddings(), K))


def _vector_index(t: Tables, search: Callable[[vectorindex.VectorIndex, DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` makes of an index of all vectors and the query set; the index is deleted again."""
    docs, asked = t.embeddings()
    path = f"{shared_folder(t.spark)}/vectors-{uuid.uuid4()}"
    out = materialized(search(vectorindex.VectorIndex.build(docs, path), asked))
    Folder(t.spark, path).delete()
    return out


def knn_bounded(t: Tables) -> DataFrame:
    """Exact search over codes and bounds."""
    return _ranked(_vector_index(t, lambda index, asked: index.nearest(asked, K)))


def knn_bounded_products(t: Tables) -> DataFrame:
    """How many products with vectors that search makes a query, and which share of all it saves."""
    told = _vector_index(t, lambda index, asked: index.products(asked, K))
    return told.select("query_id", "products", "n_rows", round_half_up(1 - F.col("products") / F.col("n_rows"), 4).alias("saved"))


def knn_ivf(t: Tables) -> DataFrame:
    """The best ten codes for each result wanted, ranked by their vectors: a fixed number of products a query, nothing chosen by the queries."""
    return _ranked(_vector_index(t, lambda index, asked: index.nearest(asked, K, rerank=10 * K)))


def knn_ivf_recall(t: Tables) -> DataFrame:
    """The same against exact search: how many neighbours were wanted, and whether at least nine in ten were found."""
    exact, found = vectors.nearest(*t.embeddings(), K), knn_ivf(t)
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_in_ten"))


def filtered_search(t: Tables) -> DataFrame:
    """One language, which the index holds as a dataset of its own."""
    return _ranked(t.engine.search(t.queries, K, dataset="fr"))


def _own_index(t: Tables, fill: Callable[[str], DataFrame]) -> DataFrame:
    """What ``fill`` makes of a path for an index of its own, which is dropped again."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4()}"
    out = materialized(fill(path))
    Index.open(t.spark, path).drop()
    return out


def _changed(t: Tables, path: str) -> list[tuple[str, Index]]:
    """An index through loads of two halves, a load that replaces a third, a removal of one language, and a merge."""
    docs = corpora.table_documents(t.read("documents"), "lang")
    half = F.pmod(F.col("id").cast("long"), F.lit(2)) == 0
    steps = [("create", Index.create(t.spark, path, list(BOOSTS)))]
    steps.append(("load", steps[-1][1].load(docs.where(half), batch="even")))
    steps.append(("load", steps[-1][1].load(docs.where(~half), batch="odd")))
    steps.append(("again", steps[-1][1].load(docs.where(~half), batch="odd")))
    steps.append(("replace", steps[-1][1].load(docs.where(F.pmod(F.col("id").cast("long"), F.lit(3)) == 0), replace=True)))
    steps.append(("remove", steps[-1][1].remove(docs.where("dataset = 'de'"))))
    steps.append(("merge", steps[-1][1].merge()))
    return steps


def index_life(t: Tables) -> DataFrame:
    """Documents, segments and tombstones after each step of an index's life, by the manifest and by counting what is stored."""
    def rows(path: str) -> DataFrame:
        told = [(k, name, i.count(), i.stored().count(), len(i.told["segments"]), len(i.told["tombstones"])) for k, (name, i) in enumerate(_changed(t, path))]
        return t.spark.createDataFrame(told, "step int, name string, n_docs long, n_stored long, segments int, tombstones int")

    return _own_index(t, rows)


def index_after_changes(t: Tables) -> DataFrame:
    """Searches of the same index before and after it is merged."""
    def rows(path: str) -> DataFrame:
        found = [i.top(t.queries, K, BOOSTS, tie=0.0).withColumn("version", F.lit(name)) for name, i in _changed(t, path)[-2:]]
        return found[0].unionByName(found[1]).select("version", "query_id", "id", F.col("rank").cast("long").alias("rank"), "score")

    return _own_index(t, rows)


def streamed_index(t: Tables) -> DataFrame:
    """Best fields over an index that a stream of the documents' files writes, a segment a batch."""
    def rows(path: str) -> DataFrame:
        documents = t.read("documents")
        arriving = ingest.document_stream(t.spark, t.documents, documents.schema, files_per_batch=8)
        ingest.index_stream(corpora.table_documents(arriving, "lang"), path, list(BOOSTS)).awaitTermination()
        return Index.open(t.spark, path).top(t.queries, K, BOOSTS, tie=0.0)

    return _ranked(_own_index(t, rows))


def collection_pool(t: Tables) -> DataFrame:
    return _ranked(pool_of_collection(None, t.queries, stored=t.index))


def knn_ignore_identical(t: Tables) -> DataFrame:
    return _ranked(vectors.nearest(*t.embeddings(), K, ignore_identical=True))


def knn_label_metrics(t: Tables) -> DataFrame:
    docs, asked = t.embeddings()
    run = vectors.nearest(docs, asked, K, ignore_identical=True)
    qrels = asked.select("query_id", "label").join(docs.select("id", "label"), "label").where("id <> query_id").select("query_id", "id", F.lit(1).alias("grade"))
    return metrics.aggregate(metrics.per_query(asked, run, qrels, k=K, mode="binary"))


def minmax_scores(t: Tables) -> DataFrame:
    return vectors.scaled(t.pool()).select("query_id", "id", round_half_up(F.col("scaled"), 6).alias("scaled"))


def blend_linear(t: Tables) -> DataFrame:
    return _ranked(vectors.blended(t.pool(), t.vector_run(), [(0.5, 0.5)], 50))


def rrf(t: Tables) -> DataFrame:
    return _ranked(vectors.reciprocal_ranks([(t.pool(), [1.0]), (t.vector_run(), [1.0])], 50))


def hybrid_sweep(t: Tables) -> DataFrame:
    """Both runs alone, and both fusions at nine weights of the vector side, scored: 20 rows."""
    lexical, near = t.pool().select("query_id", "id", "score", "rank"), t.vector_run()
    linear = vectors.blended(lexical, near, [(1 - w, w) for w in WEIGHTS], K).select(F.concat(F.lit("linear-"), F.format_number("right_weight", 1)).alias("variant"), "query_id", "id", "rank")
    fused = vectors.reciprocal_ranks([(lexical, [1 - w for w in WEIGHTS]), (near, WEIGHTS)], K)
    fused = fused.select(F.concat(F.lit("rrf-"), F.format_number((F.col("variant") + 1) / 10, 1)).alias("variant"), "query_id", "id", "rank")
    alone = [r.select(F.lit(n).alias("variant"), "query_id", "id", "rank") for n, r in (("lexical", lexical), ("vector", near))]
    runs = linear.unionByName(fused).unionByName(alone[0]).unionByName(alone[1])
    return metrics.aggregate(metrics.per_query(t.queries, runs, t.qrels(), k=K, keys=("variant",)), "variant")


def _per_query(mode: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t.scored(t.baseline(), mode).select("query_id", *metrics.METRICS)


def metrics_aggregate(t: Tables) -> DataFrame:
    return metrics.aggregate(t.scored(t.baseline()))


def failure_groups(t: Tables) -> DataFrame:
    return failures.summary(t.classified(t.baseline()))


def failure_examples(t: Tables) -> DataFrame:
    return failures.examples(t.classified(t.baseline())).withColumn("place", F.col("place").cast("long"))


def missing_relevant(t: Tables) -> DataFrame:
    return failures.missing_relevant(t.baseline(), t.qrels()).select("query_id", F.col("place").cast("long").alias("place"), "id", F.col("grade").cast("long").alias("grade"))


def metric_deltas(t: Tables) -> DataFrame:
    return compare.metric_deltas(metrics.aggregate(t.scored(t.baseline())), metrics.aggregate(t.scored(t.reranked())))


def group_deltas(t: Tables) -> DataFrame:
    return compare.group_deltas(t.classified(t.baseline()), t.classified(t.reranked()))


def query_deltas(t: Tables) -> DataFrame:
    return compare.query_deltas(t.classified(t.baseline()), t.classified(t.reranked()))


def decision(t: Tables) -> DataFrame:
    return compare.decision(metric_deltas(t))


def _techniques(t: Tables) -> DataFrame:
    """(technique, dataset, baseline, measured): nDCG per group of queries, of the field sum and of two rerankers over it."""
    pool = t.pool()
    runs = pool.select(F.lit("field-sum").alias("technique"), "query_id", "id", "rank")
    for name, run in (("coverage-rerank", rerank.by_coverage(pool)), ("prf-rerank", rerank.by_feedback(pool))):
        runs = runs.unionByName(run.select(F.lit(name).alias("technique"), "query_id", "id", "rank"))
    scored = metrics.per_query(t.queries, runs, t.qrels(), k=K, mode="linear", keys=("technique",)).join(t.domains(), "query_id")
    each = metrics.aggregate(scored, "technique", "dataset").select("technique", "dataset", F.col("ndcg_at_k").alias("measured"))
    first = each.where("technique = 'field-sum'").select("dataset", F.col("measured").alias("baseline"))
    return each.where("technique <> 'field-sum'").join(first, "dataset")


def portfolio(t: Tables) -> DataFrame:
    return compare.portfolio(_techniques(t))


def mean_of_parts(t: Tables) -> DataFrame:
    """The groups of queries as parts of one collection, by the plain mean."""
    runs = metrics.aggregate(t.scored(t.baseline(), "linear").join(t.domains(), "query_id"), "dataset")
    return compare.mean_of_parts(runs, runs.select(F.lit("all").alias("dataset"), F.col("dataset").alias("part")))


def failure_shares(t: Tables) -> DataFrame:
    return failures.group_shares(t.classified(t.baseline()).join(t.domains(), "query_id"), "dataset")


def technique_classification(t: Tables) -> DataFrame:
    return compare.classify(_techniques(t))


def baseline_matrix(t: Tables) -> DataFrame:
    scored = t.scored(t.baseline(), "linear").join(t.domains(), "query_id")
    runs = metrics.aggregate(scored, "dataset").select("dataset", F.lit(1).alias("generation"), F.lit(False).alias("is_aggregate"), "query_count", "ndcg_at_k")
    datasets = t.domains().select("dataset").distinct().select("dataset", F.lit(1).cast("long").alias("tier"), F.lit(PUBLISHED).alias("published"))
    return compare.baseline_matrix(runs, datasets)


def _features(t: Tables) -> DataFrame:
    pool = t.judged_pool()
    near = pool.select("query_id", "id")
    retrieved = t.docs.join(ix.small(near.select("id").distinct()), "id", "left_semi")  # vectors of what the pools hold are all that is asked for
    docs = t.hashed(retrieved, "text").select("id", F.col("embedding").alias("d"))
    asked = t.query_vectors().select("query_id", F.col("embedding").alias("q"))
    scores = near.join(docs, "id").join(asked, "query_id").select("query_id", "id", round_half_up(dot(F.col("q"), F.col("d")), 6).alias("vector_score"))
    return materialized(ltr.features(pool, vector_scores=scores))


def ltr_features(t: Tables) -> DataFrame:
    return _features(t).withColumn("original_rank", F.col("original_rank").cast("long"))


def ltr_linear_score(t: Tables) -> DataFrame:
    return ltr.by_weights(_features(t), LTR_WEIGHTS).select("query_id", "id", "ltr_score", F.col("rank").cast("long").alias("rank"))


def ltr_coordinate_ascent(t: Tables) -> DataFrame:
    return ltr.cross_validated_ascent(_features(t), t.qrels())


def ltr_boosted_trees(t: Tables) -> DataFrame:
    return ltr.cross_validated_trees(_features(t), t.qrels(), trees=60, rate=0.1, min_leaf=3)


def ltr_report(t: Tables) -> DataFrame:
    return ltr.report(_features(t), t.judged_pool(), t.queries, t.qrels())


def ltr_against_hybrid(t: Tables) -> DataFrame:
    fused = hybrid_sweep(t).where(F.col("variant").rlike("^(linear|rrf)-"))
    return ltr.against_hybrid(ltr_report(t), fused)


def fold_assignment(t: Tables) -> DataFrame:
    return t.docs.select("id", ltr.fold_of(F.col("id")).cast("long").alias("fold"), ltr.fold_of(F.regexp_replace("id", "[0-9]", "x")).cast("long").alias("hash_fold"))


def pool_recall(t: Tables) -> DataFrame:
    return ltr.pool_recall(t.pool(), t.qrels())


def oracle_rank(t: Tables) -> DataFrame:
    out = ltr.oracle_order(t.judged_pool())
    return out.select("query_id", "id", "label", F.col("original_rank").cast("long").alias("original_rank"), F.col("rank").cast("long").alias("rank"))


def normalize_query(t: Tables) -> DataFrame:
    told = t.read("conversations").select("conv_id", "turn", tx.normalize_query(F.concat(F.lit(" "), F.col("text"))).alias("n"))
    return told.select("conv_id", "turn", F.md5("n.normalized").alias("normalized_md5"), F.concat_ws("; ", "n.transformations").alias("transformations"))


def stopword_tokens(t: Tables) -> DataFrame:
    return t.docs.select("id", F.concat_ws(" ", tx.significant_tokens(F.col("title"))).alias("tokens"), F.size(tx.significant_tokens(F.col("text"), tx.FEEDBACK_STOPWORDS)).cast("long").alias("n_text_tokens"))


def bigrams(t: Tables) -> DataFrame:
    return t.docs.select("id", F.explode(tx.bigrams(tx.significant_tokens(F.col("text")))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"))


def dataset_profile_counts(t: Tables) -> DataFrame:
    parts = [(n, df.agg(F.count("*").alias("n"))) for n, df in (("documents", t.docs), ("queries", t.queries), ("qrels", t.qrels()), ("judged_queries", t.qrels().select("query_id").distinct()))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def bm25_ignore_identical(t: Tables) -> DataFrame:
    """Documents whose id is the query's are no answers to it."""
    return _ranked(collection_search(None, t.queries, K, ignore_identical=True, stored=t.index))


def published_delta(t: Tables) -> DataFrame:
    runs = metrics.aggregate(t.scored(t.baseline(), "linear").join(t.domains(), "query_id"), "dataset")
    told = runs.select("dataset", "ndcg_at_k", metrics.reference_comparison(F.col("ndcg_at_k"), F.lit(PUBLISHED), K).alias("c"))
    return told.select("dataset", "ndcg_at_k", "c.delta", "c.relative_delta")


def simpler_preferred(t: Tables) -> DataFrame:
    """Whether feedback terms win over plain coverage on enough groups of queries."""
    return compare.wins(_techniques(t), "coverage-rerank", "prf-rerank")


def weights_metrics(t: Tables) -> DataFrame:
    return metrics.aggregate(t.scored(ltr.by_weights(_features(t), LTR_WEIGHTS)))


def event_arrivals(t: Tables) -> DataFrame:
    return ingest.arrivals(t.read("events"))


_ALL = [
    fixture_term_search, bm25_best_fields, bm25_field_sum, bm25_tie_breaker, bm25_paper_profile, mapped_hits, lexical_cases, msm_filter, total_hits, phrase_search, cross_fields_search,
    query_rescue, english_bm25, bm25_english, english_words, english_stem, coverage_rerank, prf_feedback_terms, prf_rerank, prf_expand_merge, prf_grid, local_hash_embedding, embedding_cache, embedding_runs, knn_exact,
    knn_ignore_identical, knn_label_metrics, minmax_scores, blend_linear, rrf, hybrid_sweep, metrics_aggregate, failure_groups, failure_examples,
    missing_relevant, metric_deltas, group_deltas, query_deltas, decision, technique_classification, baseline_matrix, ltr_features, ltr_linear_score,
    ltr_coordinate_ascent, ltr_report, ltr_against_hybrid, ltr_boosted_trees, fold_assignment, pool_recall, oracle_rank, normalize_query, stopword_tokens, bigrams, dataset_profile_counts,
    event_arrivals, knn_ivf, knn_bounded, knn_bounded_products, filtered_search, index_life, index_after_changes, streamed_index, collection_pool, portfolio, mean_of_parts, failure_shares,
    knn_ivf_recall, bm25_ignore_identical, published_delta, simpler_preferred, weights_metrics, *FORMATS,
]


def _registered(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: _registered(f) for f in _ALL} | {f"metrics_{m.replace('-', '_')}": _registered(_per_query(m)) for m in metrics.MODES}
