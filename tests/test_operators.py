import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.numbers import normalized, round_half_up
from lodestar.operators import compare, english, failures, ltr, metrics, rerank, vectors
from lodestar.operators import retrieval as rt
from lodestar.plans.engine import BOOSTS, Engine, milestone, normalized as normal_query, resolve, result_size
from lodestar.plans.errors import NotAvailableError, NotFoundError, ValidationError
from lodestar.plans.registry import REGISTRY
from lodestar.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def run_of(spark, results):
    return spark.createDataFrame([(q, i, r) for q, ids in results.items() for r, i in enumerate(ids, 1)], "query_id string, id string, rank int")


def qrels_of(spark, qrels):
    return spark.createDataFrame([(q, i, g) for q, m in qrels.items() for i, g in m.items()], "query_id string, id string, grade int")


def scored(spark, results, qrels, queries=None, **options):
    cases = spark.createDataFrame([(q,) for q in queries or sorted(set(results) | set(qrels))], "query_id string")
    return {r.query_id: r for r in metrics.per_query(cases, run_of(spark, results), qrels_of(spark, qrels), **options).collect()}


def test_numbers(spark):
    assert [r.x for r in spark.createDataFrame([(-2.5,), (2.5,), (0.00005,)], "v double").select(round_half_up(F.col("v"), 0).alias("x")).collect()] == [-2.0, 3.0, 0.0]
    assert one(spark, normalized(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8] and one(spark, normalized(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]


def test_text(spark):
    assert one(spark, tx.significant_tokens(F.col("q")), q="what are the heated aircraft laws?") == ["heated", "aircraft", "laws"]
    n = one(spark, tx.normalize_query(F.col("q")), q="  wing   pressure   distribution  ")
    assert n.normalized == "wing pressure distribution" and len(n.transformations) == 2
    assert one(spark, tx.normalize_query(F.col("q")), q="a b").transformations == ["none"]
    assert one(spark, tx.bigrams(F.col("w")), w=["x"]) == [] and one(spark, tx.bigrams(F.col("w")), w=["x", "y", "z"]) == ["x y", "y z"]

    def fnv(s):
        h = 2166136261
        for k in range(0, len(u := s.encode("utf-16-be")), 2):
            h = (h ^ int.from_bytes(u[k : k + 2], "big")) * 16777619 % 2**32
        return h

    for s in ("", "a", "tok:wing", "é😀"):
        assert one(spark, tx.fnv1a(F.col("s")), s=s) == fnv(s)
    assert len(set(tx.COVERAGE_STOPWORDS)) == 92 and len(tx.FEEDBACK_STOPWORDS) == 92 + 22


def test_metrics_of_a_small_ranking(spark):
    r = scored(spark, {"q": ["doc-4", "doc-1", "doc-2"]}, {"q": {"doc-1": 3, "doc-2": 2, "doc-3": 0}}, k=3)["q"]
    assert (r.precision_at_k, r.recall_at_k, r.average_precision, r.reciprocal_rank) == (0.6667, 1.0, round((1 / 2 + 2 / 3) / 2, 4), 0.5)
    ranking, judged = {"q": ["doc-2", "doc-1"]}, {"q": {"doc-1": 3, "doc-2": 1}}
    assert scored(spark, ranking, judged, k=2, mode="binary")["q"].ndcg_at_k == 1 > scored(spark, ranking, judged, k=2)["q"].ndcg_at_k
    with pytest.raises(ValueError):
        metrics.gain(F.lit(1), "other")


def plain_metrics(ids, qrels, k, mode):
    gain = {"binary": lambda g: 1, "linear": lambda g: g, "graded": lambda g: 2**g - 1, "cranfield-reversed": lambda g: 2 ** (5 - g) - 1}[mode]
    gains = {i: (gain(g) if g > 0 else 0) for i, g in qrels.items()}
    relevant = {i for i, g in qrels.items() if g > 0}
    top = ids[:k]
    hits = [i in relevant for i in top]
    dcg = lambda xs: sum(gains.get(i, 0) / math.log2(r + 2) for r, i in enumerate(xs) if gains.get(i, 0) > 0)
    best = dcg(sorted(relevant, key=lambda i: (-gains[i], i))[:k])
    ap = sum(sum(hits[: r + 1]) / (r + 1) for r, h in enumerate(hits) if h)
    values = (sum(hits) / len(top) if top else 0, sum(hits) / len(relevant) if relevant else 0, ap / len(relevant) if relevant else 0, 1 / (hits.index(True) + 1) if any(hits) else 0, dcg(top) / best if best else 0)
    return tuple(math.floor(v * 10000 + 0.5) / 10000 for v in values)


@pytest.mark.parametrize("mode", metrics.MODES)
def test_metrics_of_random_rankings(spark, mode):
    r = random.Random(mode)
    ids = [f"d{k}" for k in range(30)]
    results = {f"q{k}": r.sample(ids, r.randint(0, 20)) for k in range(60)}
    qrels = {f"q{k}": {i: r.randint(-1, 5) for i in r.sample(ids, r.randint(0, 12))} for k in range(60)}
    got = scored(spark, results, qrels, queries=list(results), mode=mode)
    assert len(got) == 60
    for q, row in got.items():
        want = plain_metrics(results[q], qrels[q], 10, mode)
        assert all(abs(row[m] - w) < 1.01e-4 for m, w in zip(metrics.METRICS, want, strict=True)), (q, row, want)


def test_failure_groups(spark):
    results = {"zero": ["x", "y"], "late": ["a", "b", "c", "r1"], "broad": ["r0", "x", "r1", "y"], "none": []}
    qrels = {"zero": {"r": 1}, "late": {"r1": 1}, "broad": {f"r{k}": 1 for k in range(12)}, "none": {"r": 1}}
    cases = spark.createDataFrame([(q,) for q in results], "query_id string")
    groups = failures.classified(metrics.per_query(cases, run_of(spark, results), qrels_of(spark, qrels), k=4))
    assert {r.query_id: r.behavior_group for r in groups.collect()} == {"zero": "zero_relevant_at_k", "late": "late_first_relevant", "broad": "broad_need_low_recall", "none": "zero_relevant_at_k"}
    missing = [r for r in failures.missing_relevant(run_of(spark, results), qrels_of(spark, qrels), k=4).collect() if r.query_id == "broad"]
    assert len(missing) == 10
    rows = {r.query_id: r for r in failures.analysis(run_of(spark, results), qrels_of(spark, qrels), groups, k=4).collect()}
    assert rows["broad"].relevant_retrieved == ["r0", "r1"] and rows["late"].top_non_relevant == ["a", "b", "c"]


POOL = "query_id string, query string, id string, score double, rank int, title string, abstract string"


def test_rerankers(spark):
    pool = spark.createDataFrame([("q", "wing pressure", "a", 10.0, 1, "unrelated", "other words"), ("q", "wing pressure", "b", 9.0, 2, "wing pressure", "pressure of a wing")], POOL)
    first = [r for r in rerank.by_coverage(pool).collect() if r.rank == 1][0]
    assert (first.id, first.original_rank, first.rerank_score) == ("b", 2, round(0.9 + 0.08 * 6, 4))
    ties = spark.createDataFrame([("q", "wing", k, 1.0, n, "same", "same") for n, k in enumerate("cab", 1)], POOL)
    assert [r.id for r in rerank.by_coverage(ties).orderBy("rank").collect()] == ["c", "a", "b"]
    heat = spark.createDataFrame([("q", "thermal expansion", "a", 2.0, 1, "thermal expansion coefficient", "the coefficient of thermal expansion"), ("q", "thermal expansion", "b", 1.0, 2, "thermal", "coefficient measured")], POOL)
    terms = {r.term for r in rerank.feedback_terms(heat).collect()}
    assert "coefficient" in terms and not terms & {"thermal", "expansion"}
    second = spark.createDataFrame([("q", "b", 3.0, 1), ("q", "c", 1.0, 2), ("q", "b", 5.0, 3)], "query_id string, id string, score double, rank int")
    merged = {r.id: r for r in rerank.merged_pools(heat, second).collect()}
    assert (merged["b"].expanded_score, merged["b"].expanded_rank, merged["b"].retrieval_sources) == (5.0, 1, ["original", "expanded"])
    assert merged["c"].original_rank is None and merged["a"].expanded_score == 0


def test_vectors_and_fusion(spark):
    docs = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.1, 0.9]), ("q", [1.0, 0.0])], "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    near = lambda **o: [r.id for r in vectors.nearest(docs, asked, 2, **o).orderBy("rank").collect()]
    assert near() == ["q", "a"] and near(ignore_identical=True, block=1) == ["a", "b"]
    assert vectors.nearest(docs, asked.limit(0), 2).count() == 0
    texts = spark.createDataFrame([("x", "wing pressure distribution"), ("y", "")], "id string, t string")
    dense = {r.id: r.embedding for r in vectors.hash_embeddings(texts, "t", 32).collect()}
    assert abs(np.linalg.norm(dense["x"]) - 1) < 1e-5 and not any(dense["y"]) and len(dense["x"]) == 32
    kind = "query_id string, id string, score double, rank int"
    lexical = spark.createDataFrame([("q", "lexical", 10.0, 1), ("q", "shared", 5.0, 2)], kind)
    vector = spark.createDataFrame([("q", "vector", 1.0, 1), ("q", "shared", 0.8, 2)], kind)
    fused = vectors.reciprocal_ranks([(lexical, [1.0]), (vector, [1.0])], 3).orderBy("rank").collect()
    assert len(fused) == 3 and fused[0].id == "shared"
    assert vectors.blended(lexical, vector, [(0.5, 0.5)], 3).count() == 3


def test_comparison(spark):
    deltas = spark.createDataFrame([(m, 0.1) for m in compare.CORE] + [("precision_at_k", -0.5)], "metric string, delta double")
    assert compare.decision(deltas).first().decision == "candidate_improved_core_metrics"
    rows = [("u", f"d{k}", 0.5, 0.6 if k < 3 else 0.49) for k in range(4)] + [("c", f"d{k}", 0.5, 0.6 if k < 2 else 0.4) for k in range(4)] + [("n", "d0", 0.5, 0.4), ("n", "d1", 0.0, 0.4)]
    got = {r.technique: (r.scope, r.evaluated) for r in compare.classify(spark.createDataFrame(rows, "technique string, dataset string, baseline double, measured double")).collect()}
    assert got == {"u": ("universal", 4), "c": ("domain-conditional", 4), "n": ("dormant", 1)}
    won = compare.wins(spark.createDataFrame([("ltr-bge", "a", 0.0, 2.0), ("bge-hybrid", "a", 0.0, 1.0), ("ltr-bge", "b", 0.0, 1.0), ("bge-hybrid", "b", 0.0, 2.0)], "technique string, dataset string, baseline double, measured double")).first()
    assert (won.evaluated, won.won, won.preferred) == (2, 1, False)


def test_learning_to_rank(spark):
    rows = []
    for q in range(1, 13):
        for k in range(6):
            good = k == 3
            rows.append((str(q), "wing pressure", f"d{k}", 10.0 - k, k + 1, "wing pressure report" if good else "noise", "wing pressure" if good else "other text", 2 if good else None))
    pool = spark.createDataFrame(rows, POOL + ", grade int")
    feats = ltr.features(pool).cache()
    first = feats.where("query_id = '1' and id = 'd3'").first()
    assert (first.label, first.original_rank, first.titleCoverage, first.anyCoverage, first.vectorScore, first.vectorRankReciprocal) == (2, 4, 1.0, 1.0, 0.0, round(1 / 6, 6))
    qrels = spark.createDataFrame([(str(q), "d3", 2) for q in range(1, 13)], "query_id string, id string, grade int")
    for out in (ltr.cross_validated_ascent(feats, qrels, k=1), ltr.cross_validated_trees(feats, qrels, trees=10, rate=0.3, min_leaf=3)):
        top = out.where("rank = 1").collect()
        assert len(top) == 12 and {r.id for r in top} == {"d3"} and {r.fold for r in top} == {0, 1, 2, 3, 4}
    assert ltr.average_weights(ltr.cross_validated_ascent(feats, qrels, k=1)).count() == 13
    model = ltr.learn_trees(feats, folds=2, trees=5, min_leaf=1)
    assert {r.id for r in ltr.by_boosted_trees(feats, model[0]).where("rank = 1").collect()} == {"d3"}
    assert ltr.pool_recall(pool, qrels).first().recall == 1.0
    folds = spark.createDataFrame([("q7",), ("0",), ("abc",), ("12",)], "q string").select("q", ltr.fold_of(F.col("q")).alias("f")).collect()
    h = 0
    for ch in "abc":
        h = (h * 31 + ord(ch)) % 2**32
    assert {r.q: r.f for r in folds} == {"q7": 1, "0": 48 % 5, "abc": h % 5, "12": 1}


DOCS = [("1", "wing pressure distribution", "pressure over a swept wing", "wing pressure distribution pressure over a swept wing"), ("2", "boundary layer", "boundary layer transition on a wing", "boundary layer transition on a wing"), ("3", "heat transfer", "hypersonic heat transfer", "hypersonic heat transfer rates")]


def test_engine_facade(spark, tmp_path):
    engine = Engine(spark.createDataFrame(DOCS, "id string, title string, abstract string, text string"))
    for name in ("baseline", "rescue", "field-sum", "rerank", "prf", "rm3-expand"):
        assert engine.ask("  wing   pressure ", 2, name)["results"][0]["id"] == "1", name
    assert engine.explain("heat", None, "baseline")["plan"] and resolve(" RM3 ").id == "prf-rerank"
    engine.save(f"{tmp_path}/index")
    again = Engine.load(spark, f"{tmp_path}/index")
    assert again.ask("heat transfer")["results"][0]["id"] == "3" and again.count() == 3
    for bad, code in ((lambda: engine.ask("  "), "missing_query"), (lambda: engine.ask("x", 51), "invalid_size"), (lambda: engine.ask("x", "1.5"), "invalid_size"), (lambda: resolve("x"), "invalid_architecture")):
        with pytest.raises(ValidationError) as error:
            bad()
        assert (error.value.code, error.value.status) == (code, 400)
    assert result_size("") == 10 and normal_query(" a  b") == "a b" and milestone("PRF").id == "prf-rerank"
    with pytest.raises(NotAvailableError):
        milestone("bge")
    with pytest.raises(NotFoundError):
        milestone("other")


def test_phrase_and_cross_fields(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, abstract string, text string")
    ask = lambda q: spark.createDataFrame([("q", q)], "query_id string, query string")
    assert {r.id for r in rt.phrase(docs, ask("boundary layer"), BOOSTS).collect()} == {"2"}
    assert rt.phrase(docs, ask("layer boundary"), BOOSTS, slop=0).count() == 0
    assert {r.id for r in rt.phrase(docs, ask("pressure swept"), BOOSTS, slop=3).collect()} == {"1"}
    assert {r.id for r in rt.cross_fields(docs, ask("hypersonic transfer"), BOOSTS).collect()} == {"3"}


def test_english_analyzer(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formaliti": "formal", "electrical": "electr", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky", "is": "is"}
    assert {w: english.stem(w) for w in known} == known
    assert one(spark, english.words(F.col("t")), t="The pilot's wings, and O'Neil's Été") == ["pilot", "wings", "o'neil", "été"]


def test_registry(spark):
    assert REGISTRY.get("beir/arguana").ignore_identical and len(REGISTRY.get("beir/cqadupstack").aggregate_of) == 12
    assert REGISTRY.index_of("beir/scifact") == "beir-scifact-v0" and REGISTRY.index_of("cranfield", override="x") == "x"
    assert REGISTRY.frame(spark).count() == len(REGISTRY.list()) == 28
    with pytest.raises(ValueError):
        REGISTRY.get("none")


def test_stream_appends_what_the_engine_loads(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id string, title string, abstract string, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.document_stream(spark, f"{tmp_path}/in", "id string, title string, abstract string, text string", files_per_batch=1)
    query = ingest.index_stream(stream, f"{tmp_path}/index", list(BOOSTS))
    query.awaitTermination(120)
    assert Engine.load(spark, f"{tmp_path}/index").ask("heat transfer")["results"][0]["id"] == "3"


def test_plans_stay_in_the_engine(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, abstract string, text string")
    asked = spark.createDataFrame([("q", "wing pressure")], "query_id string, query string")
    plan = rt.top_k(rt.field_sum(rt.term_scores(docs, asked, list(BOOSTS)), BOOSTS), 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_stored_index_filters_by_dataset_and_reads_asked_terms(spark, tmp_path):
    docs = spark.createDataFrame([(*d, "a" if d[0] == "1" else "b") for d in DOCS], "id string, title string, abstract string, text string, dataset string")
    plain = Engine(docs)
    plain.save(f"{tmp_path}/index")
    stored = Engine.load(spark, f"{tmp_path}/index")
    queries = spark.createDataFrame([("q", "wing pressure layer"), ("r", "heat")], "query_id string, query string")
    rows = lambda e, *a, **o: sorted(map(tuple, e.search(queries, 5, *a, **o).collect()))
    for architecture in ("baseline", "field-sum", "coverage-rerank", "prf-expand-rerank", "query-rescue"):
        assert rows(stored, architecture) == rows(plain, architecture)
        some = rows(stored, architecture, dataset="b")
        assert some == rows(plain, architecture, dataset="b") and {r[1] for r in some} == {"2", "3"}
    assert {(r[1], r[2]) for r in rows(stored, dataset="b")} < {(r[1], r[2]) for r in rows(stored)}
    plan = stored.search(queries.where("query_id = 'r'"), 5)._jdf.queryExecution().toString()
    assert "EqualTo(term,heat)" in plan


def test_export_of_embedding_input(spark, tmp_path):
    from lodestar.sources import corpora

    docs = spark.createDataFrame(DOCS, "id string, title string, abstract string, text string")
    queries = spark.createDataFrame([("q1", "wing"), ("q2", "heat")], "query_id string, query string")
    corpora.embedding_input(docs, queries, spark.createDataFrame([("q2", "3", 1)], "query_id string, id string, grade int"), f"{tmp_path}/out")
    lines = spark.read.json(f"{tmp_path}/out/documents")
    assert sorted((r.id, r.text) for r in lines.collect()) == [("1", "wing pressure distribution\n" + DOCS[0][3]), ("2", "boundary layer\n" + DOCS[1][3]), ("3", "heat transfer\n" + DOCS[2][3])]
    assert [(r.id, r.text) for r in spark.read.json(f"{tmp_path}/out/queries").collect()] == [("q2", "heat")]
