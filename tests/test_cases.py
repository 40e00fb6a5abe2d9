"""Hits as callers get them, cases of a stored run, and the commands that write."""

import json

from lodestar import cli
from lodestar.operators import retrieval as rt
from lodestar.operators.embedcache import Child, LocalHash, Ollama


def test_hits_have_defaults(spark):
    docs = spark.createDataFrame([("1", "t", None, "s"), ("2", None, "a", ""), ("4", "x", "y", "z")], "id string, title string, abstract string, source string")
    run = spark.createDataFrame([("q", k, i, s) for i, (k, s) in enumerate([("1", 2.0), ("2", None), ("3", 1.0)], 1)], "query_id string, id string, rank int, score double")
    got = {tuple(r) for r in rt.mapped_hits(run, docs, "base").collect()}
    assert got == {("q", "1", 1, 2.0, "t", "", "s"), ("q", "2", 2, None, "", "a", "base"), ("q", "3", 3, 1.0, "", "", "base")}
    assert {r.source for r in rt.mapped_hits(run, docs.select("id"), "base").collect()} == {"base"}
    assert rt.mapped_hits(run.limit(0), docs, "base").count() == 0


def test_cases_of_a_stored_run(spark):
    queries = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "query_id string, query string")
    run = spark.createDataFrame([("1", f"d{k}", 1.0 / k, k) for k in (3, 1, 2)] + [("9", "d", 1.0, 1)], "query_id string, id string, score double, rank int")
    got = {r.query_id: [(h.id, h.rank, h.score) for h in r.results] for r in rt.cases(queries, run, 2).collect()}
    assert got == {"1": [("d1", 1, 1.0), ("d2", 2, 0.5)], "2": [], "3": []}


def test_commands_that_write(spark, sf_dir, tmp_path, capsys):
    for _ in range(2):
        cli.main(["load", sf_dir, "--to", f"{tmp_path}/index"])
        cli.main(["embed", sf_dir, "--to", f"{tmp_path}/cache"])
    said = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [s["documents"] for s in said[::2]] == [n, n] and said[0]["version"] == said[2]["version"]
    assert said[1]["made"] > 0 and said[3]["made"] == 0
    assert cli.provider("ollama", "m", "http://x").embed == Ollama("m", "http://x")
    assert cli.provider("child", "m", "a -b 'c d'").embed == Child("m", ("a", "-b", "c d")) and cli.provider("local-hash", "", None) == LocalHash()
