import random
import re

import numpy as np
import pytest
import xxhash

from lodestar.llm import simhash as S
from lodestar.llm.common import table


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """rows: (id, fp). Id by row, of the component."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(rows))]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(table(spark, sf_dir, "documents")).collect()}
    assert got == {i: (f"{fp:016x}", g) for (i, fp), g in zip(fps, brute_groups(fps), strict=True)}


def _cluster(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        fp = r.choice(out)
        for _ in range(r.randint(0, 5)):
            fp ^= 1 << r.randrange(64)
        out.append(fp)
    return out


def test_near_and_near_pairs():
    fps = np.array(_cluster(700, 1), np.uint64)
    q, m = S.near(fps[:300], fps, S.planes(fps))
    want = {(a, b) for a in range(300) for b in range(700) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == want
    left, right = fps[np.arange(0, 699)], fps[np.arange(1, 700)]
    assert S.near_pairs(left, right).tolist() == [k for k in range(699) if int(left[k] ^ right[k]).bit_count() <= 3]


@pytest.mark.parametrize("block", [S.BLOCK, 70])
def test_links_in_blocks_give_the_components_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(S, "pieces", lambda n, radius=3: 5)
    fps = sorted(set(_cluster(900, 2)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    rows = list(zip(signed, fps, strict=True))
    assert [roots.get(x, x) for x in signed] == brute_groups(rows)


def test_pieces_grow_with_the_input():
    assert S.pieces(100) == 4 and S.pieces(10**6) == 5 and S.pieces(10**9) > S.pieces(10**6)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(150000))
    data = [(5, None, 1), (4, "", 1), (9, " \n", 1), (7, "One two", 1), (6, "one  TWO", 1), (6, "one two", 1), (None, "one two", 1), (8, long, 1), (3, "É a b c", 1), (1, "é a b c", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, FP int")
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(data)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert by[(5, "0" * 16)] == by[(9, "0" * 16)] == 4
    assert {r.component_id for r in rows if r.doc_id in (6, 7, None)} == {6}
    assert {r.fingerprint for r in rows if r.doc_id == 8} == {f"{brute_fingerprint(long):016x}"}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in S.keep_one(once).collect()) == sorted({r.component_id for r in rows})
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0
