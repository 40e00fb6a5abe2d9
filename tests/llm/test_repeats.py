import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import repeats as R
from lodestar.llm.common import table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: tuple(r)[1:] for r in R.repeats_digest(table(spark, sf_dir, "documents")).collect()}
    want = brute([t for _, t in docs], 400)
    assert [got[i] for i, _ in docs] == want and any(0 < w[1] < w[0] for w in want)


def _corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(5, 30))) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            out.append(r.choice(out))
        elif kind < 0.4 and out:
            t = list(r.choice(out))
            for _ in range(r.randint(1, 3)):
                if t:
                    t[r.randrange(len(t))] = "x"
            out.append("".join(t))
        else:
            out.append(" ".join(r.choice(passages) if r.random() < 0.4 else word() for _ in range(r.randint(0, 12))))
    return [*out, "a" * 700, "ab" * 90, "abc" * 100 + "q" + "abc" * 60, None, "", "short", passages[0] * 40]


@pytest.mark.parametrize(("length", "gram", "group"), [(40, 8, 4096), (40, 8, 3), (25, 24, 5), (16, 1, 4)])
def test_random_corpora(spark, length, gram, group):
    texts = _corpus(length, 150)
    docs = spark.createDataFrame([(k % 140 if k % 7 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, Kept int").repartition(4)
    rows = R.with_repeats(docs, length=length, gram=gram, group=group).collect()
    got = Counter((r.text, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == Counter((t, *w) for t, w in zip(texts, brute(texts, length), strict=True))


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "x" * 300_000 + "y" * 450), (2, "y" * 399)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in R.repeats_digest(docs).orderBy("doc_id").collect()] == [(1, 300450, 300450, 1), (2, 399, 0, 0)]
    assert R.repeats_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "length", "removed"), [(394, 400, 0), (399, 400, 0), (400, 400, 400), (394, 250, 394)])
def test_passages_of_over_fifty_words_planted_across_documents(spark, size, length, removed):
    # 394 bytes: the longest item of the given benchmark
    r = random.Random(size)
    passage = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(size // 6 - 1))
    passage = passage.ljust(size, "i")
    assert len(passage.split()) > 50
    own = lambda k: f"{k}" + " ".join("".join(r.choices("rstuvw", k=5)) for _ in range(40)) + f"{k}"
    texts = [f"{own(k)}{passage}{own(k)}" if k < 4 else own(k) for k in range(6)]
    rows = {r.doc_id: r for r in R.with_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length).collect()}
    assert [rows[k].n_removed for k in range(6)] == [removed] * 4 + [0, 0]
    assert [bytes(rows[k].kept) for k in range(6)] == [(t.replace(passage, "") if removed else t).encode() for t in texts]


def test_benchmark_items_are_shorter_than_what_the_query_removes(spark, sf_dir):
    assert max(len(r.text.encode()) for r in table(spark, sf_dir, "benchmark").collect()) < R.LENGTH


def _around(n):
    # a line of over 64 bytes in different texts: one gram with as many covers
    r = random.Random(7)
    line = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40))
    own = lambda: " ".join("".join(r.choices("rstuvwxyz", k=6)) for _ in range(30))
    return [f"{own()} {line} {own()}" for _ in range(n)]


@pytest.fixture
def apart(spark):
    # tasks stay as they are dealt, small ones too
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_rows_of_a_common_gram_are_many_tasks(spark, apart):
    texts = R._keyed(spark.createDataFrame(list(enumerate(_around(4000))), "doc_id long, text string").repartition(4), "text")
    rows = R.dealt(texts, 400, 64).withColumn("task", F.spark_partition_id()).checkpoint()
    most = rows.groupBy("gram").count().orderBy(F.desc("count"), "gram").first()
    tasks = [r["count"] for r in rows.where(F.col("gram") == most["gram"]).groupBy("task").count().collect()]
    assert most["count"] > 1000 and len(tasks) == 4 and max(tasks) < 0.4 * most["count"]
    other = rows.where(~F.col("common")).groupBy("gram").agg(F.countDistinct("task").alias("n"))
    assert other.where("n > 1").count() == 0
    assert rows.where("common").groupBy("gram", "c1", "c2").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("sampled", [1, 2])
def test_what_the_sample_shows_changes_no_result(spark, monkeypatch, sampled):
    monkeypatch.setattr(R, "SAMPLED", sampled)
    monkeypatch.setattr(R, "COMMON", 0)
    monkeypatch.setattr(R, "COMMON_ROWS", sampled)  # 1: every gram is common
    texts = [*_corpus(3, 80), *_around(12), *_around(12)[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert R.common_grams(R._keyed(docs, "text"), 40, 8)
    rows = {r.doc_id: r for r in R.with_repeats(docs, length=40, gram=8, group=5).collect()}
    got = [(rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, hashlib.sha256(rows[k].kept).hexdigest()) for k in range(len(texts))]
    assert got == brute(texts, 40)


def test_common_grams_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert R.common_grams(R._keyed(docs, "text"), 400, 64) == []
