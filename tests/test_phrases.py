"""Sloppy phrases against a version that keeps no heap, and DuckDB's SQL against both, on random texts of few words."""

import random

import duckdb
import pytest

from lodestar.functions import text as tx
from lodestar.operators import phrases
from lodestar.operators import retrieval as rt
from lodestar.operators.segments import Index
from lodestar.plans.oracles import _index, _with, PHRASES


def plain(query, text, slop):
    """Cursors as [position, place in the query] that are looked through whole at each step."""
    spots = [[i for i, w in enumerate(text) if w == q] for q in query]
    nth = [query[:k].count(q) for k, q in enumerate(query)]
    if not query or any(len(s) <= n for s, n in zip(spots, nth, strict=True)):
        return 0.0
    if len(query) == 1:
        return float(len(spots[0]))
    now = [s[n] for s, n in zip(spots, nth, strict=True)]
    shifted = lambda: [p - k for k, p in enumerate(now)]
    reached, total = max(shifted()), 0.0

    def behind():
        return min(range(len(query)), key=lambda k: (shifted()[k], k))

    k = behind()
    others = min(s for j, s in enumerate(shifted()) if j != k)
    spread = reached - shifted()[k]
    weight = lambda: 1 / (1 + spread) if spread <= slop else 0.0
    while True:
        move = k
        while True:
            later = [p for p in spots[move] if p > now[move]]
            if not later:
                return total + weight()
            now[move] = later[0]
            reached = max(reached, shifted()[move])
            same = [j for j in range(len(query)) if j != move and query[j] == query[move] and now[j] == now[move]]
            if not same:
                break
            move = max(move, same[0])
        if shifted()[k] > others:
            total += weight()
            k = behind()
            others = min(s for j, s in enumerate(shifted()) if j != k)
            spread = reached - shifted()[k]
        else:
            spread = min(spread, reached - shifted()[k])


def by_word(query, text):
    words = sorted(set(query))
    return [[k for k, q in enumerate(query) if q == w] for w in words], [[k for k, t in enumerate(text) if t == w] for w in words]


def test_known_phrases():
    count = lambda q, t, slop: phrases.frequency(*by_word(q.split(), t.split()), slop)
    assert count("a b", "a b", 0) == count("a b", "x a b x", 3) == 1
    assert count("a b", "a b x a b", 0) == 2
    assert count("a b", "b a", 1) == 0 and count("a b", "b a", 2) == pytest.approx(1 / 3)  # two moves turn two words round
    assert count("a b", "a x x b", 1) == 0 and count("a b", "a x x b", 2) == pytest.approx(1 / 3)
    assert count("a a", "a", 3) == 0 and count("a a", "a x a", 1) == 0.5  # no two words stand on one position
    assert count("a", "a b a", 0) == 2 and count("", "a", 3) == 0 and count("a b", "", 3) == 0 and count("a b", "a a", 3) == 0
    assert count("a b a b", " ".join("ab" * 20000), 3) > 9000


def test_random_texts():
    r = random.Random(5)
    repeats = 0
    for _ in range(6000):
        query = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 5))]
        text = [r.choice("abcdxy"[: r.randint(2, 6)]) for _ in range(r.randint(0, 24))]
        slop = r.randint(0, 6)
        got = phrases.frequency(*by_word(query, text), slop)
        assert got == plain(query, text, slop), (query, text, slop)
        repeats += got > 0 and len(set(query)) < len(query)
    assert repeats > 500


def test_same_rows_as_sql(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, n)))
    docs = [(str(k), text(8), text(30), text(60)) for k in range(60)] + [("none", None, None, None), ("empty", "", "", "")]
    queries = [(f"q{k}", " ".join(r.choice("abcdefgh"[: 2 + k % 7]) for _ in range(1 + k % 5))) for k in range(40)] + [("none", None), ("mark", "?!")]
    held, asked = spark.createDataFrame(docs, "id string, title string, abstract string, text string"), spark.createDataFrame(queries, "query_id string, query string")
    got = {(x.query_id, x.id): x.score for x in rt.phrase(held, asked, {"title": 8, "abstract": 5, "text": 2}, analyzer=tx.tokens).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (id VARCHAR, title VARCHAR, abstract VARCHAR, text VARCHAR)")
    con.execute("CREATE TABLE queries (query_id VARCHAR, query VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?)", docs)
    con.executemany("INSERT INTO queries VALUES (?, ?)", queries)
    want = {(q, d): s for q, d, s in con.sql(_with(_index(), PHRASES) + "SELECT query_id, id, score FROM phrases").fetchall()}
    assert len(got) > 500 and got == want


def test_stored_index_gives_the_same(spark, tmp_path, monkeypatch):
    """Shards of few documents, several segments and removed documents: places, positions and statistics are those of the documents that are left."""
    monkeypatch.setattr("lodestar.operators.segments.BLOCK_QUERIES", 7)
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, n)))
    docs = [(str(k), text(8), text(30), text(60)) for k in range(50)] + [("none", None, None, None)]
    queries = [(f"q{k}", " ".join(r.choice("abcdefghz"[: 3 + k % 7]) for _ in range(1 + k % 4))) for k in range(16)] + [("none", None), ("mark", "?!")]
    schema, boosts = "id string, title string, abstract string, text string", {"title": 8, "abstract": 5, "text": 2}
    asked = spark.createDataFrame(queries, "query_id string, query string")
    index = Index.create(spark, f"{tmp_path}/index", list(boosts))
    index = index.load(spark.createDataFrame(docs[:30], schema).repartition(3))
    index = index.load(spark.createDataFrame(docs[30:], schema).repartition(1))
    index = index.remove(spark.createDataFrame([(d[0],) for d in docs[::9]], "id string"))
    left = spark.createDataFrame([d for k, d in enumerate(docs) if k % 9], schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(rt.phrase(None, asked, boosts, stored=index))
    assert len(got) > 100 and got == rows(rt.phrase(left, asked, boosts))
    assert rows(rt.phrase(None, asked, boosts, stored=Index.create(spark, f"{tmp_path}/bare", list(boosts)))) == []


def test_rescue_takes_phrases_with_and_without_places(spark, tmp_path):
    """A replaced document's phrases count where it is now."""
    docs = [(str(k), "a b", "", " ".join("abcd"[(k + n) % 4] for n in range(k % 9))) for k in range(40)]
    schema, boosts = "id string, title string, abstract string, text string", {"title": 2, "abstract": 1, "text": 1}
    index = Index.create(spark, f"{tmp_path}/index", list(boosts)).load(spark.createDataFrame(docs, schema).repartition(2))
    docs[5:9] = [(i, "c d", "a b c", "d") for i, *_ in docs[5:9]]
    index = index.load(spark.createDataFrame(docs[5:9], schema), replace=True)
    asked = spark.createDataFrame([("1", "a b"), ("2", "b c d"), ("3", "d")], "query_id string, query string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    phrases = [rt.phrase(None, asked, boosts, stored=index, located=x) for x in (False, True)]
    assert [p.columns for p in phrases] == [["query_id", "id", "score"], ["query_id", "id", "shard", "place", "score"]]
    want = rows(rt.top_k(rt.rescue(spark.createDataFrame(docs, schema), asked, boosts, boosts), 9))
    assert len(want) > 20 and [rows(index.rescue(asked, 9, boosts, p)) for p in phrases] == [want, want]
    bare = Index.create(spark, f"{tmp_path}/bare", list(boosts))
    assert rows(bare.rescue(asked, 9, boosts, rt.phrase(None, asked, boosts, stored=bare))) == []
