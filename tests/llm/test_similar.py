import random

import numpy as np
import pytest

from lodestar.llm import common
from lodestar.llm import similar as J
from lodestar.llm import simhash as S
from lodestar.llm.common import table


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """rows: (id, text). Ids that stay, from all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_at_the_bound_and_frequent_shingles(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    licence = [word() for _ in range(120)]
    rows = []
    for size in (5, 6, 9, 20, 60, 300, 2000):
        for _ in range(6):
            words = [word() for _ in range(size)] + (licence if size in (20, 60) else [])
            rows.append(words)
            for cut in (0.03, 0.08, 0.1, 0.11, 0.12, 0.13, 0.2):  # a tail that differs: similarities on both sides of 0.8
                tail = max(1, round(len(words) * cut))
                rows.append(words[:-tail] + [word() for _ in range(tail)])
                rows.append(words[: -2 * tail])
    data = [(k, " ".join(w)) for k, w in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = kept(data)
    assert 100 < len(want) < len(data) - 100
    assert sorted(x.doc_id for x in S.keep_one(docs).collect()) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert sorted(x.doc_id for x in S.keep_one(docs).collect()) == want


def test_a_large_group_in_blocks(spark):
    """300 near copies of one text, of which most pairs are below 0.8, all in one loose component that is cut up."""
    r = random.Random(5)
    first = [f"w{r.randrange(10**6)}" for _ in range(150)]
    data = []
    for k in range(300):
        words = list(first)
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        data.append((k, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = kept(data)
    assert 1 < len(want) < 250
    assert sorted(x.doc_id for x in S.keep_one(docs).collect()) == want
    texts = docs.selectExpr("doc_id as id", "text")
    sets = J.distinct_sets(J.marked(texts))
    loose = S.components(S.linked(J.keyed(sets), J.WORDS, radius=J.RADIUS, block=70))
    for elements in (3000, 100_000):
        roots = {x.node: x.root for x in S.components(J.exact_links(texts, sets, loose, elements=elements)).collect()}
        names = {x.fp: x.first for x in sets.collect()}
        assert len({roots.get(fp, fp) for fp in names}) == len(want)


def test_recall_of_keys_and_prints_at_the_bound():
    r = np.random.default_rng(7)
    met = near = 0
    for _ in range(1500):
        base = r.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = np.unique(base[:100]), np.unique(np.concatenate((base[11:100], base[100:111])))  # 89 of 111: 0.802
        met += (J.keys(a) == J.keys(b)).any()
        near += int(np.bitwise_count(J.wide_print(a).view(np.uint64) ^ J.wide_print(b).view(np.uint64)).sum()) <= J.RADIUS
    assert met >= 1490 and near >= 1495


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_join_deals_hot_and_null_keys_by_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    left = spark.createDataFrame([(k, None if k % 5 == 0 else "hot" if k % 2 else f"k{k}") for k in range(2000)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), (None, 2)] + [(f"k{k}", 3) for k in range(0, 1000, 4)], "r string, v int")
    got = sorted(r.id for r in common.join_checked(left, right, left.k, "r", how).collect())
    names = {x.r for x in right.collect()}
    assert got == [x.id for x in left.orderBy("id").collect() if how == "left" or x.k in names]
