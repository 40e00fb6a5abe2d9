"""Ranked search against the score of every document, from the definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import ranked as R
from lodestar.llm.common import table

DOCS, ITEMS = "doc_id long, text string, score string, query int", "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    own = [(i, Counter(ts := terms(t)), len(ts)) for i, t, *_ in docs]
    own = [d for d in own if d[2]]
    n_docs, n_words = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t, *_ in items:
        asked[i] = asked.get(i, set()) | set(terms(t))
    found = []
    for item, ts in asked.items():
        scored = []
        for i, c, n in own:
            m = 10 + (90 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        found += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


def got(spark, docs, items):
    out = R.ranked_digest(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40))), "", 1) for k in range(n)]
    return docs, [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25))), "") for k in range(20)]


def test_whole_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = R.ranked_digest(docs, items).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, out), key=str) == plain(docs.collect(), items.collect())


def test_ties_copies_nulls_and_clashing_names(spark):
    docs, items = made(1, 200)
    docs += [(1000 + k, docs[3][1], None, None) for k in range(150)]  # one text holds a third of all rows
    docs += [(7, docs[7][1], "", 1)] * 3 + [(None, docs[5][1], "", 1)] * 2 + [(5000, None, "", 1), (5001, "", "", 1), (5002, "-- !", "", 1), (5003, "É Ärger W1 w2_W3", "", 1)]
    items += [(50, docs[3][1], ""), (51, docs[5][1], ""), (52, None, ""), (53, "", ""), (54, "nowhere", ""), (55, "É ÄRGER w1", ""), (56, "w1 w2", ""), (56, "w3 w2", ""), (None, "w4 w1", "")]
    assert got(spark, docs, items) == plain(docs, items)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(R, "CUT", 1000)
    docs, items = made(2, 30)
    rng = random.Random(9)
    docs.append((77, " ".join(f"w{rng.randrange(200)}" for _ in range(400_000)), "", 1))
    assert got(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = made(3, 5)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, [(1, None, "", 1)], items) == []


def test_blocks_of_queries_and_documents(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 40), ("BLOCK_QUERIES", 7), ("BLOCK_DOCS", 16), ("BLOCK_POSTINGS", 100), ("WIDTH", 3)):
        monkeypatch.setattr(R, name, value)
    docs, items = made(4, 300)
    assert got(spark, docs, items) == plain(docs, items)


def test_words_are_maximal_matches():
    for text in ("a" * 10, "ab CD-efÉ \u0085x", "  ", "", "x" * 2000 + " " + "y" * 3000):
        assert [w.decode() for part in R.words(text.encode()) for w in part] == terms(text)


@pytest.mark.parametrize("seed", range(4))
def test_range_maxima(seed):
    rng = np.random.default_rng(seed)
    doc = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in (50, 1, 17, 33)])
    term = np.repeat([0, 1, 3, 4], (50, 1, 17, 33))
    lists = R.Lists.of(doc, term, rng.integers(0, 9, len(doc)), 50, 6)
    for t in range(6):
        for a in range(lists.begin[t], lists.end[t]):
            for b in range(a + 1, lists.end[t] + 1):
                assert lists.maxima(np.array([a]), np.array([b]))[0] == a + lists.worth[a:b].argmax()


def test_intervals_that_cannot_win_are_left_alone():
    """One document is far better than all others: few of many are scored."""
    n = 5000
    worth = np.concatenate([np.full(n, 3), np.full(n, 2)])
    worth[[1234, n + 1234]] = 1000
    lists = R.Lists.of(np.tile(np.arange(n), 2), np.repeat([0, 1], n), worth, n, 2)
    best = R.Best(1)
    assert R.search_block(lists, np.array([0, 1]), [(False, i) for i in range(n)], best) < 2 * R.WIDTH
    assert best.rows == [(-2000, (False, 1234))]
