"""Both learners against plain versions that go through rows one by one."""

import math
import random

import pytest

from lodestar.operators import ltr

FOLDS = 3


def rounded(x, digits):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def make(spark, seed, queries=24, docs=14):
    r = random.Random(seed)
    rows = []
    for q in range(queries):
        for k in range(docs):
            x = [round(r.random(), r.choice((1, 6))) for _ in ltr.FEATURES]
            x[0] = round(1 - k / docs, 6)
            label = int(r.random() < 0.15 + 0.6 * (x[3] > 0.6)) * r.choice((1, 2, 3))
            rows.append((f"q{q + 1}", f"d{k}", label, k + 1, *x))
    schema = "query_id string, id string, label long, original_rank int, " + ", ".join(f"{f} double" for f in ltr.FEATURES)
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def ndcg(rows, judged, weights, k):
    total, queries = 0.0, sorted({r[0] for r in rows})
    for q in queries:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-sum_of(weights, r), r[3]))
        dcg = sum((2 ** r[2] - 1) / math.log2(i + 2) for i, r in enumerate(own[:k]))
        ideal = sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(sorted(judged.get(q, []), reverse=True)[:k]))
        total += rounded(dcg / ideal, 4) if ideal else 0
    return rounded(total / len(queries), 4)


def sum_of(weights, row):
    s = 0.0
    for w, x in zip(weights, row[4:], strict=True):
        s += w * x
    return s


def plain_ascent(rows, judged, steps, k):
    weights = [1.0] + [0.0] * 12
    best = ndcg(rows, judged, weights, k)
    for step in steps:
        for _ in range(4):
            before = list(weights)
            for f in range(13):
                options = []
                for side in (step, -step):
                    trial = list(weights)
                    trial[f] = rounded(weights[f] + side, 6)
                    options.append((ndcg(rows, judged, trial, k), trial))
                for metric, trial in options:
                    if metric > best + 0.00001:
                        best, weights = metric, trial
            if weights == before:
                break
    return weights


def test_ascent_finds_the_weights_of_a_plain_one(spark):
    rows, df = make(spark, 1)
    extra = [("q1", "elsewhere", 3), ("q2", "elsewhere", -1)]
    qrels = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[2]] + extra, "query_id string, id string, grade long")
    judged = {}
    for q, _, g in [(r[0], r[1], r[2]) for r in rows if r[2]] + extra:
        judged.setdefault(q, []).append(max(g, 0))
    climbs = ltr.learn_weights(df, qrels, folds=FOLDS, k=5, steps=(0.5, 0.1), whole=True)
    assert sorted(climbs) == [*range(FOLDS), FOLDS]  # the last is of all queries
    for fold, climb in climbs.items():
        seen = [r for r in rows if (int(r[0][1:]) - 1) % FOLDS != fold]
        assert climb.weights.tolist() == plain_ascent(seen, judged, (0.5, 0.1), 5), fold


def squares(ys):
    return sum((y - sum(ys) / len(ys)) ** 2 for y in ys) if ys else 0.0


def plain_tree(xs, ys, depth, least, most):
    here = squares(ys)
    if depth == 0 or len(ys) < 2 * least or here < 1e-6:
        return rounded(sum(ys) / len(ys), 6)
    best = None
    for f in range(13):
        values = sorted({x[f] for x in xs})
        cuts = min(most, len(values) - 1)
        for p in sorted({k * len(values) // (cuts + 1) for k in range(1, cuts + 1)}):
            t = (values[p - 1] + values[p]) / 2
            left, right = [y for x, y in zip(xs, ys, strict=True) if x[f] <= t], [y for x, y in zip(xs, ys, strict=True) if x[f] > t]
            if min(len(left), len(right)) >= least and (e := round(squares(left) + squares(right), 9)) < round(here, 9) and (best is None or e < best[0]):
                best = (e, f, t)
    if best is None:
        return rounded(sum(ys) / len(ys), 6)
    side = lambda right: [(x, y) for x, y in zip(xs, ys, strict=True) if (x[best[1]] > best[2]) == right]
    return best[1], rounded(best[2], 6), *(plain_tree([x for x, _ in side(k)], [y for _, y in side(k)], depth - 1, least, most) for k in (False, True))


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2 + (x[tree[0]] > tree[1])]
    return tree


@pytest.mark.parametrize(("least", "most"), [(3, 16), (12, 4)])
def test_trees_score_as_plain_ones(spark, least, most):
    rows, df = make(spark, 2)
    ranked = {(r.query_id, r.id): r.ltr_score for r in ltr.cross_validated_trees(df, folds=FOLDS, trees=4, rate=0.3, max_depth=2, min_leaf=least, max_thresholds=most).collect()}
    for fold in range(FOLDS):
        seen = [r for r in rows if (int(r[0][1:]) - 1) % FOLDS != fold]
        xs, ys = [r[4:] for r in seen], [float(r[2]) for r in seen]
        base = sum(ys) / len(ys)
        rest, trees = [y - base for y in ys], []
        for _ in range(4):
            trees.append(plain_tree(xs, rest, 2, least, most))
            rest = [y - 0.3 * value(trees[-1], x) for x, y in zip(xs, rest, strict=True)]
        for r in rows:
            if r not in seen:
                assert abs(ranked[r[0], r[1]] - rounded(base, 6) - 0.3 * sum(value(t, r[4:]) for t in trees)) < 2e-6


def test_trees_are_the_same_however_often_predictions_are_written(spark):
    _, df = make(spark, 3)
    learn = lambda every: ltr.learn_trees(df, folds=2, trees=5, rate=0.3, max_depth=2, min_leaf=3, every=every)
    assert learn(1) == learn(2) == learn(8)


def test_a_level_evaluates_few_trees(spark, monkeypatch):
    """Trees behind the written predictions aren't looked at again, so a long model costs a level no more than a short one."""
    _, df = make(spark, 4, queries=6, docs=8)
    most, plain = [], ltr.histograms
    monkeypatch.setattr(ltr, "histograms", lambda pools, models, since, *rest: most.append(len(models[0]["trees"]) - since) or plain(pools, models, since, *rest))
    models = ltr.learn_trees(df, folds=2, trees=7, max_depth=1, min_leaf=2, every=3)
    assert max(most) == 2 and len(models[0]["trees"]) == 7


def test_a_model_of_all_queries_is_that_of_a_fold_without_any(spark):
    rows, df = make(spark, 9, queries=4)
    grown = dict(trees=3, rate=0.3, max_depth=2, min_leaf=3)
    assert ltr.learn_trees(df, folds=2, whole=True, **grown)[2] == ltr.learn_trees(df, folds=6, **grown)[5]


@pytest.mark.parametrize("model", ["coordinate-ascent", "boosted-trees"])
def test_report(spark, model):
    rows, df = make(spark, 4, queries=12)
    queries = spark.createDataFrame([(f"q{k}", "x") for k in range(1, 14)], "query_id string, query string")  # q13 has no pool
    qrels = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[2]] + [("q13", "d1", 1)], "query_id string, id string, grade int")
    pool = df.selectExpr("query_id", "id", "original_rank as rank", "label as grade")
    options = dict(trees=2, min_leaf=3) if model == "boosted-trees" else dict(steps=(0.5,))
    told = ltr.report(df, pool, queries, qrels, folds=3, k=5, model=model, **options)
    got = {r.run: r for r in told.collect()}
    judged = {q: [r[2] for r in rows if r[0] == q and r[2]] for q in {r[0] for r in rows}}
    assert set(got) == {"first-stage", "oracle", "held-out", "in-sample"} and {r.query_count for r in got.values()} == {13}
    assert got["first-stage"].ndcg_at_k == pytest.approx(ndcg(rows, judged, [1] + [0] * 12, 5) * 12 / 13, abs=1e-4)
    assert got["oracle"].ndcg_at_k == rounded(12 / 13, 4)
    if model == "coordinate-ascent":
        whole = plain_ascent(rows, judged, (0.5,), 5)
        assert got["in-sample"].ndcg_at_k == pytest.approx(ndcg(rows, judged, whole, 5) * 12 / 13, abs=1e-4)
    fused = spark.createDataFrame([("a", 0.01), ("b", 0.02)], "variant string, ndcg_at_k double")
    row = ltr.against_hybrid(told, fused).first()
    assert (row.first_stage_ndcg, row.ltr_ndcg, row.hybrid_ndcg, row.ltr_beats_hybrid) == (got["first-stage"].ndcg_at_k, got["held-out"].ndcg_at_k, 0.02, True)
    assert ltr.against_hybrid(told, fused.limit(0)).first().ltr_beats_hybrid is None


def test_vectors_of_what_the_pools_hold_are_all_that_is_made(spark, sf_dir, monkeypatch):
    from lodestar.operators import vectors
    from lodestar.plans import queries as Q

    asked = []
    monkeypatch.setattr(vectors, "hash_vectors", lambda docs, text, made=vectors.hash_vectors: (asked.append(docs.count()), made(docs, text))[1])
    t = Q.Tables(spark, sf_dir)
    rows = Q._features(t)
    assert asked == [rows.select("id").distinct().count(), t.queries.count()] and asked[0] < t.docs.count()


def test_vectors_are_made_without_a_shuffle(spark):
    from lodestar.operators import vectors

    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate([None, "", "a", "wing body", "x " * 3000] + ["b c"] * 300)], "id string, text string")
    made = vectors.hash_vectors(docs, "text")
    assert "Exchange" not in made._jdf.queryExecution().toString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, vectors.hash_embeddings(docs, "text").collect()))
