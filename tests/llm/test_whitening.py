"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import whitening as W
from lodestar.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, deviation string, extra int"


def plain(vectors):
    """x by row, n, S, eigenvalues, eigenvectors and trace, from the definition."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    d = np.array((fit * n - s) / n, dtype=float)
    e, v = np.linalg.eigh(d.T @ d / n)
    return x, n, s, e[::-1], v[:, ::-1], float(np.trace(d.T @ d / n))


def check(rows, ids, vectors, components):
    x, n, s, e, v, trace = plain(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(set(ids))
    sign = {}
    for i, own in zip(ids, x, strict=True):
        assert sorted(got[i]) == list(range(1, components + 1))
        for c, r in got[i].items():
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True))
            expected = float(np.array([(n * a - b) / n for a, b in zip(own, s, strict=True)]) @ v[:, c - 1]) / np.sqrt(e[c - 1])
            if abs(expected) > 1e-3:
                assert sign.setdefault(c, np.sign(expected * r.whitened)) == np.sign(expected * r.whitened)
            assert abs(expected) == pytest.approx(abs(r.whitened), abs=1e-7)
            assert r.explained == pytest.approx(e[c - 1] / trace, rel=1e-8) and r.identity_error < 1e-8


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    all_rows = df.collect()
    check(W.whitening_digest(df).collect(), [r.vec_id for r in all_rows], [r.embedding for r in all_rows], 16)


def test_odd_rows_copies_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.standard_normal(5)], "x", k) for k in range(60)]
    good += [(100 + k, good[0][1], "y", None) for k in range(40)]  # copies weigh once
    bad = [(900, None, "x", 1), (901, [1.0, None, 0.0, 0.0, 0.0], None, 1), (902, [float("nan"), 0.0, 0.0, 0.0, 0.0], "", 1), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", 1), (904, [0.0, 0.0, float("-inf"), 0.0, 0.0], "", 1)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    check(W.whitening_digest(df).collect(), [r[0] for r in good], [r[1] for r in good], 5)
    applied = W.fit(df).apply(df)
    assert sorted(applied.columns) == ["deviation", "embedding", "extra", "vec_id", "whitened"]
    assert {r.vec_id for r in applied.where("whitened is null and deviation is null").collect()} == {900, 901, 902, 903, 904}


def test_few_rows_have_few_components(spark):
    make = lambda rows: spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(rows)], SCHEMA)
    for rows in ([], [None], [[]], [[0.5, 1.0]], [[0.5, 1.0]] * 4):
        assert W.whitening_digest(make(rows)).count() == 0
    rows = [[0.0, 1.0, 2.0], [1.0, 1.0, 2.0], [5.0, 1.0, 2.0]]
    check(W.whitening_digest(make(rows)).collect(), [0, 1, 2], rows, 1)


def test_equal_eigenvalues_are_all_found(spark):
    rows = [[float(s) if j == k else 0.0 for j in range(6)] for k in range(6) for s in (-3, 3)] + [[0.0] * 6]
    df = spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(rows)], SCHEMA)
    w = W.fit(df)
    assert len(w.eigenvalues) == 6 and np.allclose(w.eigenvalues, w.eigenvalues[0]) and w.identity_error < 1e-10
    assert np.allclose(w.components.T @ w.components, np.eye(6), atol=1e-12)


def test_large_entries_and_other_lengths(spark):
    rows = [[1e10, 0.0], [2e10, 1.0], [3e10, 0.5, 7.0], [3e10, 0.5, 7.0], [1e30, 0.0]]
    df = spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, deviation string, extra int")
    w = W.fit(df)
    assert w.centre.n == 4 and w.width == 3
    out = {r.vec_id: r for r in w.apply(df).collect()}
    assert out[2].whitened == out[3].whitened and all(r.deviation is None for r in out.values())  # beyond a long
    assert W.fit(df.where("vec_id < 0")).centre.n == 0


def test_offset_does_not_cost_digits(spark):
    rng = np.random.default_rng(5)
    rows = (rng.standard_normal((400, 4)) + 2.0**20).tolist()
    df = spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, deviation string, extra int")
    w = W.fit(df)
    x = np.floor(64 * np.array(rows)) + 1_000_000
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(w.eigenvalues, e, rtol=1e-10) and w.identity_error < 1e-10


def test_no_row_is_dropped_by_the_query(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    assert W.whitening_digest(df).select(F.countDistinct("vec_id")).first()[0] == df.count()
