"""The stored vector index against exact search."""

import numpy as np
import pytest

from lodestar.operators import vectorindex as V
from lodestar.operators import vectors


def rows(spark, points, kind="double"):
    return spark.createDataFrame([(f"{k:05d}", None if p is None else [float(c) for c in p]) for k, p in enumerate(points)], f"id string, embedding array<{kind}>")


def queries(spark, points):
    return spark.createDataFrame([(f"q{k}", [float(c) for c in p]) for k, p in enumerate(points)], "query_id string, embedding array<double>")


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def clustered(rng, groups, each, width, spread):
    middles = rng.standard_normal((groups, width)) * 3
    return np.concatenate([m + spread * rng.standard_normal((each, width)) for m in middles])


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_same_rows_as_exact_search(spark, tmp_path, spread):
    rng = np.random.default_rng(1)
    points = clustered(rng, 12, 50, 9, spread)
    docs, asked = rows(spark, points), queries(spark, np.concatenate([points[:20] + 0.01, rng.standard_normal((10, 9)), np.zeros((1, 9))]))
    index = V.VectorIndex.build(docs, f"{tmp_path}/index")
    assert index.sizes.sum() == 600 and len(index.centres) == 12
    for k in (1, 7):
        assert got(index.nearest(asked, k)) == got(vectors.nearest(docs, asked, k))
    told = index.products(asked.where("query_id < 'q2'"), 5).collect()
    assert told and all(5 <= r.products < 0.25 * r.n_rows for r in told)


def test_copies_nulls_and_other_lengths(spark, tmp_path):
    rng = np.random.default_rng(2)
    points = [*rng.standard_normal((60, 5)), *[np.ones(5)] * 40, None, None, [], [2.0], [1.0, 2.0, 3.0]]
    docs, asked = rows(spark, points, "float"), queries(spark, [np.ones(5), [1.0], [0.5, 0.5, 0.0, 0.0, 0.0, 9.0]])
    index = V.VectorIndex.build(docs, f"{tmp_path}/index", lists=6)
    assert got(index.nearest(asked, 12)) == got(vectors.nearest(docs.where("embedding is not null"), asked, 12))


def test_few_rows(spark, tmp_path):
    for n in (0, 1, 3):
        docs, asked = rows(spark, np.eye(3)[:n]), queries(spark, np.eye(3))
        assert got(V.VectorIndex.build(docs, f"{tmp_path}/{n}").nearest(asked, 5)) == (got(vectors.nearest(docs, asked, 5)) if n else [])


def test_lists_that_cannot_reach_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = clustered(rng, 40, 30, 8, 0.001)
    index = V.VectorIndex.build(rows(spark, points), f"{tmp_path}/index", lists=40)
    read = []
    real = index._codes
    index._codes = lambda vectors, wanted, *rest: read.append(wanted.sum()) or real(vectors, wanted, *rest)
    index.nearest(queries(spark, points[:1]), 3).count()
    assert sum(read) <= 6  # of 40 lists
    plan = real(points[:1], np.arange(40)[None, :] == 7, np.full(1, -np.inf), 3, None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_recall_of_reranked_codes(spark, tmp_path, sf_dir):
    """On queries that nothing was tuned on, random directions included."""
    rng = np.random.default_rng(4)
    points = rng.standard_normal((3000, 32))
    asked = queries(spark, rng.standard_normal((40, 32)))
    index = V.VectorIndex.build(rows(spark, points), f"{tmp_path}/index")
    exact, found = ({(r.query_id, r.id) for r in x.collect()} for x in (index.nearest(asked, 10), index.nearest(asked, 10, rerank=100)))
    assert len(exact & found) >= 0.9 * len(exact)
    assert all(r.products == 100 for r in index.products(asked, 10, rerank=100).collect())


def test_codes():
    rng = np.random.default_rng(5)
    for width in (1, 2, 7, 64):
        rest = rng.standard_normal((20, width)) * rng.random((20, 1))
        rest[0] = 0
        packed, scale, apart = V.coded(rest)
        assert packed.shape[1] == -(-width // 2)
        assert np.allclose(np.linalg.norm(rest - V.decoded(packed, width) * scale[:, None], axis=1), apart, atol=1e-6)
