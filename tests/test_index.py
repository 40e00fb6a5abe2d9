"""The stored index against searches of the documents themselves, through loads, removals, replacements, merges and killed writers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import blocks as B
from lodestar.operators import retrieval as rt
from lodestar.operators import segments as S
from lodestar.plans.engine import BOOSTS, Engine
from lodestar.streaming import ingest

SCHEMA = "id string, title string, abstract string, text string, dataset string"


def made(seed, n, first=0, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    text = lambda most: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(most)))
    return [(str(k), text(5), text(20), text(60), rng.choice(["a", "b", None])) for k in range(first, first + n)]


def asked(spark, seed=7, n=6):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"q{k}", " ".join(f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 9)))) for k in range(n)], "query_id string, query string")


def same(spark, index, rows, **options):
    """The index gives what a search of just these rows gives."""
    docs = spark.createDataFrame(rows, SCHEMA)
    queries = asked(spark)
    terms = rt.term_scores(docs, queries, list(BOOSTS))
    sort = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())
    assert sort(index.top(queries, 5, BOOSTS, **options)) == sort(rt.top_k(rt.field_sum(terms, BOOSTS), 5))
    assert sort(index.top(queries, 5, BOOSTS, tie=0.5, **options)) == sort(rt.top_k(rt.best_fields(terms, BOOSTS, 0.5), 5))
    assert index.count() == len(rows)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "SHARD_DOCS", 64)


def test_life_of_an_index(spark, tmp_path, small_blocks):
    path = f"{tmp_path}/index"
    one, two, three = made(1, 150), made(2, 40, 150), made(3, 30, 20)
    empty = S.Index.create(spark, path, list(BOOSTS))
    assert empty.count() == 0 and empty.top(asked(spark), 5, BOOSTS).count() == 0 and S.Index.create(spark, path, list(BOOSTS)).version == 1
    first = empty.load(spark.createDataFrame(one, SCHEMA).repartition(3), batch="one")
    same(spark, first, one)
    assert first.load(spark.createDataFrame(one, SCHEMA), batch="one") is first
    second = first.load(spark.createDataFrame(two, SCHEMA))
    same(spark, second, one + two)
    third = second.remove(spark.createDataFrame([("3",), ("160",), ("none",)], "id string"))
    alive = [r for r in one + two if r[0] not in ("3", "160")]
    same(spark, third, alive)
    fourth = third.load(spark.createDataFrame(three, SCHEMA), replace=True)
    now = [r for r in alive if not 20 <= int(r[0]) < 50] + three
    same(spark, fourth, now)
    assert sorted(map(tuple, fourth.stored().select("id", "text").collect())) == sorted((r[0], r[3]) for r in now)
    same(spark, first, one)  # an older version stays as it was
    with pytest.raises(S.ConflictError):
        first.load(spark.createDataFrame(two, SCHEMA))
    merged = fourth.merge()
    assert len(merged.told["segments"]) == 1 and not merged.told["tombstones"] and S.Index.open(spark, path).version == merged.version
    same(spark, merged, now)
    assert merged.load(spark.createDataFrame(one, SCHEMA), batch="one") is merged
    gone = merged.vacuum()
    assert sum(g.startswith("segments/") for g in gone) == 4  # one more was left by the writer that lost
    same(spark, first.refresh(), now)
    merged.drop()
    with pytest.raises(FileNotFoundError):
        S.Index.open(spark, path)


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    rows = made(4, 20)
    index = S.Index.create(spark, path, list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA))
    with monkeypatch.context() as patch:
        patch.setattr(S.Index, "_next", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            index.load(spark.createDataFrame(made(5, 9, 100), SCHEMA))
    same(spark, index.refresh(), rows)
    (tmp_path / "index" / "manifest" / f"{index.version + 1:09d}.json").write_text('{"fields": [')  # killed while it wrote the manifest
    again = index.refresh()
    assert again.version == index.version
    more = again.load(spark.createDataFrame(made(6, 9, 100), SCHEMA))
    assert more.version == index.version + 2 and index.refresh().count() == 29


def test_datasets_and_postings(spark, tmp_path, small_blocks):
    rows = made(8, 120)
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA)).remove(spark.createDataFrame([("5",)], "id string"))
    terms = spark.createDataFrame([("w1",), ("w30",), ("none",)], "term string")
    for dataset in (None, "a"):
        expected = []
        for i, *texts, own in rows:
            if i != "5" and dataset in (None, own):
                for name, text in zip(BOOSTS, texts, strict=True):
                    words = text.split()
                    expected += [(name, t, i, len(words), words.count(t), [k for k, w in enumerate(words) if w == t]) for t in ("w1", "w30") if t in words]
        assert sorted(map(tuple, index.postings(terms, dataset, positions=True).collect())) == sorted(expected)
        some = {r.id for r in index.top(asked(spark), 100, BOOSTS, dataset=dataset).collect()}
        assert some <= {r[0] for r in rows if r[0] != "5" and dataset in (None, r[4])}
        assert index.count(dataset) == sum(r[0] != "5" and dataset in (None, r[4]) for r in rows)


def test_a_search_reads_its_terms_only(spark, tmp_path):
    """The scan is told the terms, and few pages of many are read for one of them."""
    rng = random.Random(2)
    rows = [(str(k), "t", "", " ".join(f"x{rng.randrange(40000)}" for _ in range(300)), None) for k in range(400)]
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    one = spark.createDataFrame([("q", "x7 x9 o'x\\")], "query_id string, query string")
    told = index.rows(one, ["n"], named=["x7", "o'x\\"])
    assert "In(term, [o'x\\,x7])" in told._jdf.queryExecution().toString()
    read = index.rows(one, ["n"], named=["x7", "x9"])
    assert read.agg(F.sum("n")).first()[0] < 0.01 * index.told["segments"][0]["postings"]
    seen = spark.read.parquet(f"{tmp_path}/index/segments/{index.told['segments'][0]['id']}/packed").where("term = 'x7'")
    seen.collect()
    plan = seen._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 0.2 * 40000  # pages without the term give no rows


def test_windows_that_cannot_win_are_left_alone(spark, tmp_path):
    rows = [(f"{k:04d}", "", "", "rare rare rare" if k == 5 else "rare " + "filler " * 20, None) for k in range(3000)]
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    one = spark.createDataFrame([("q", "rare")], "query_id string, query string")
    assert [r.id for r in index.top(one, 1, BOOSTS).collect()] == ["0005"]
    told = index.windows(one, 1, BOOSTS).first()
    assert told.seen == 12 and told.read == B.FIRST


def test_ties_go_by_id_across_shards(spark, tmp_path, small_blocks):
    rows = [(f"{k:04d}", "same", "", "same", None) for k in random.Random(1).sample(range(1000), 300)]
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA).repartition(4))
    one = spark.createDataFrame([("q", "same same")], "query_id string, query string")
    assert [r.id for r in index.top(one, 7, BOOSTS).orderBy("rank").collect()] == sorted(r[0] for r in rows)[:7]


def test_an_index_without_documents(spark, tmp_path):
    rows = made(3, 40)
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA), store=False)
    same(spark, index, rows)
    for change in (index.stored, lambda: index.load(spark.createDataFrame(rows[:3], SCHEMA), replace=True), lambda: index.remove(spark.createDataFrame([("1",)], "id string"))):
        with pytest.raises(ValueError):
            change()
    assert index.merge() is index and index.refresh().version == index.version


def test_stream_writes_segments(spark, tmp_path):
    rows = made(9, 30)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        ingest.index_stream(ingest.document_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1), f"{tmp_path}/index", list(BOOSTS)).awaitTermination(120)
    engine = Engine.load(spark, f"{tmp_path}/index")
    assert len(engine.stored.told["segments"]) == 3
    same(spark, engine.stored, rows)
    spark.createDataFrame(rows[:4], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.index_stream(ingest.document_stream(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/index", list(BOOSTS), replace=True).awaitTermination(120)
    same(spark, S.Index.open(spark, f"{tmp_path}/index"), rows)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_for_any_statistics(seed):
    """No posting of a block scores more than the block's bound, which some posting reaches."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    tokens = [[f"t{rng.integers(6)}" for _ in range(rng.integers(0, 30))] for _ in range(500)]
    held = pa.table({"id": [str(k) for k in range(500)], "dataset": pa.array([None] * 500, pa.string()), "f": tokens})
    rows = pa.Table.from_batches(list(B._shard_rows(held, ["f"], "s")))
    for model in (B.Model(1.2, 0.75, 1.0, {("f", f"t{k}"): 1.0 + k for k in range(6)}, {"f": 4.0}), B.Model(0.3, 0.1, 2.2, {("f", f"t{k}"): 0.1 for k in range(6)}, {"f": 90.0})):
        shard = B.Shard("s", rows, model)
        for r in shard.row.values():
            own = slice(shard.end[r] - shard.size[r], shard.end[r])
            best = np.zeros(B.SHARD_DOCS // B.WINDOW)
            np.maximum.at(best, shard.places[own] // B.WINDOW, shard.scores[own])
            assert np.allclose(best, shard.bound[r], rtol=1e-12)


def test_manifest_is_plain_text(spark, tmp_path):
    index = S.Index.create(spark, f"{tmp_path}/index", ["text"])
    told = json.loads((tmp_path / "index" / "manifest" / f"{index.version:09d}.json").read_text())
    assert told == {"fields": ["text"], "segments": [], "tombstones": []}
    with pytest.raises(ValueError):
        S.Index.create(spark, f"{tmp_path}/index", ["title"])


def test_tokens_are_the_same_in_arrow(spark):
    import pyarrow as pa

    from lodestar.functions import text as tx

    texts = [None, "", " ", "a", " B-c\tÄé1x\u212a I\u0307 \u0130stanbul", "x" * 300, "end. ", "\u00a0nb\u00a0sp", "ΣΑΣ s", "\x1cA\x1fB\x85C", "line\none\r\ntwo"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.w for r in df.orderBy("k").select(tx.tokens(F.col("t")).alias("w")).collect()] == tx.arrow_tokens(pa.array(texts, pa.string())).to_pylist()


def test_a_custom_analyzer_is_used(spark, tmp_path):
    letters = lambda c: F.split(F.coalesce(c, F.lit("")), "")
    index = S.Index.create(spark, f"{tmp_path}/index", ["t"], analyzer=letters).load(spark.createDataFrame([("1", "abc"), ("2", "xyz"), ("3", None)], "id string, t string"))
    assert [r.id for r in index.top(spark.createDataFrame([("q", "z")], "query_id string, query string"), 5, {"t": 1}).collect()] == ["2"]


def test_formulas_over_shards_are_those_over_matches(spark, tmp_path, monkeypatch):
    """Clauses that need all of a document's scores are put together where the shard is: no row a match, dead documents and datasets left out."""
    rows = made(5, 300)
    index = S.Index.create(spark, f"{tmp_path}/index", list(BOOSTS)).load(spark.createDataFrame(rows, SCHEMA).repartition(3)).remove(spark.createDataFrame([("7",), ("8",)], "id string"))
    docs = spark.createDataFrame([r for r in rows if r[0] not in ("7", "8")], SCHEMA)
    queries = asked(spark, n=8).unionByName(spark.createDataFrame([("short", "w1 w2"), ("twice", "w3 w3 w4"), ("empty", ""), ("unknown", "zzz w1")], "query_id string, query string"))
    terms = rt.term_scores(docs, queries, list(BOOSTS))
    more = spark.createDataFrame([("short", "w5"), ("twice", "w6"), ("twice", "w3"), ("other", "w9")], "query_id string, term string")
    boosts = {"title": 1.4, "text": 0.4}
    expected = {
        "at_least": rt.at_least(terms, rt.ix.query_terms(queries), BOOSTS, 0.5), "cross_fields": rt.cross_fields(docs, queries, BOOSTS),
        "rescue": rt.rescue(docs, queries, BOOSTS, BOOSTS), "expanded": rt.expanded_field_sum(rt.ix.tokenized(docs, list(BOOSTS)), queries, more, BOOSTS, boosts),
    }
    sort = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())
    expected = {name: sort(rt.top_k(df, 5)) for name, df in expected.items()}

    def unpacked(*_):
        raise AssertionError("postings are unpacked one by one")

    monkeypatch.setattr(B, "unpacked", unpacked)
    found = {
        "at_least": index.at_least(queries, 5, BOOSTS, 0.5), "cross_fields": index.cross_fields(queries, 5, BOOSTS),
        "rescue": index.rescue(queries, 5, BOOSTS, rt.phrase(None, queries, BOOSTS, stored=index)), "expanded": index.expanded(queries, rt.further_queries(more), 5, BOOSTS, boosts),
    }
    for name, df in found.items():
        assert sort(df) == expected[name] and expected[name], name


def test_packing_holds_few_arrays_by_token():
    """What a shard takes in numpy: 43 bytes a token, where whole columns of 64 bits for each step took 97."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, each = 500, 800
    words = pa.array([f"t{k}" for k in range(20_000)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), words.take(pa.array(rng.integers(0, 300, n * each))))
    held = pa.table({"id": [str(k) for k in range(n)], "dataset": pa.array([None] * n, pa.string()), "f": lists})
    tracemalloc.start()
    assert sum(b.num_rows for b in B._shard_rows(held, ["f"], "s")) == 302
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * n * each


def _peak(run):
    """The most that ``run`` holds in numpy at once."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sorting_a_field_takes_narrow_arrays():
    """Postings of 32 bits, and no key of 64 bits a token beside its order: 32 bytes a token, 39 before."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, each = 500, 800
    code = rng.integers(0, 300, n * each).astype(np.int32)
    terms = pa.array([f"t{k:03d}" for k in range(300)])
    assert _peak(lambda: B._field_rows(code, np.full(n, each), terms)) < 35 * n * each


def test_more_shards_in_a_task_take_no_more_memory(monkeypatch):
    """A task's memory is that of a shard, however many it packs."""
    import pyarrow as pa

    class Task:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    monkeypatch.setattr(B, "SHARD_TOKENS", 20_000)
    rng = np.random.default_rng(3)
    words = pa.array([f"t{k}" for k in range(2_000)])
    run = B.packed(Task(), ["f"])

    def batch(k):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(101) * 200, pa.int32()), words.take(pa.array(rng.integers(0, 2_000, 20_000))))
        return pa.RecordBatch.from_arrays([pa.array([f"{k}-{i:03d}" for i in range(100)]), pa.nulls(100, pa.string()), lists], names=["id", "dataset", "f"])

    def packed(shards):
        names = set()
        for b in run(batch(k) for k in range(shards)):
            names |= set(b.column("shard").to_pylist())
        assert len(names) == shards

    _peak(lambda: packed(1))  # what modules hold from their first use on
    assert _peak(lambda: packed(12)) < 1.25 * _peak(lambda: packed(2))
