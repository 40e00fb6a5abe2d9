"""The SQL of this subpackage against its operators: whole small tables, and rows made to reach what those don't hold."""

import duckdb
import pandas as pd
import pytest

from lodestar.llm import packages, ranked, repeats, secrets, urlgraph
from lodestar.llm.oracles import ORACLE_SQL
from lodestar.llm.queries import QUERIES
from tests.llm.test_packages import odd_rows
from tests.llm.test_secrets import TEXTS


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).to_numpy().tolist()))
    assert rows(left) == rows(right)


@pytest.mark.parametrize("name", ["op3_urls", "op6_repeats", "op10_secrets", "op12_ranked", "op13_warc"])
def test_whole_tables(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    same(QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df())


def test_secrets_of_odd_texts(spark):
    texts = TEXTS | {100: "user: bob password: " + "ab12" * 80 + " login=eve " + "x" * 300 + " key_id: abc token=abcd", 101: "=Zk3" + "aB9" * 10 + "=Zk4" + "aB9" * 10 + " account: acme s3://bucket/x"}
    documents = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})
    con = duckdb.connect()
    con.register("documents", documents)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = secrets.secret_digest(docs).toPandas()
    same(found, con.sql(ORACLE_SQL["op10_secrets"]).df())
    assert all(found.spans.str.contains(k).any() for k in secrets.KINDS)


def test_urls_with_links(spark):
    to = lambda *hosts: " ".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    data = [(k, f"http://friend{k}.io/a", to("bad.net", *["fine.io"] * (k % 3))) for k in range(20)]
    data += [(100, "http://bad.net/", to("fine.io")), (101, "http://Sub.Example.NET/en/x?y#z", to("fine.io", "friend1.io")), (102, "x.org//", None), (103, None, to("bad.net"))]
    data += [(104, "http://fine.io", to("far.io") + ' <A HREF = "//far.io/q">'), (105, "https://far.io?q", to("friend2.io")), (106, "http://example.org/fr/a", to("fine.io"))]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(data, columns=["page_id", "url", "html"]))
    found = urlgraph.url_digest(spark.createDataFrame(data, "page_id long, url string, html string")).toPandas()
    same(found, con.sql(ORACLE_SQL["op3_urls"]).df())
    assert set(found.verdict[found.rule.isnull()]) == {"allow", "block"}


def test_repeats_of_odd_texts(spark):
    shared = "".join(f"é{k} " for k in range(150))
    texts = [None, "", "a" * 399, "b" * 401, "c" * 5000, shared + "x" * 50, "y" + shared, "z" * 100 + shared[:350] + "w" * 100, shared[:300] + shared, shared[5:]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    found = repeats.repeats_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    same(found, con.sql(ORACLE_SQL["op6_repeats"]).df())
    assert (found.n_removed > 0).sum() > 4


def test_payloads_of_odd_rows(spark):
    rows = [r for r in odd_rows() if r[2] is None or "\x00" not in r[2]]
    pages = pd.DataFrame([(k, h) for k, _, h, *_ in rows], columns=["page_id", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    left = packages.archive_digest(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, id int"))
    right = con.sql(ORACLE_SQL["op13_warc"]).fetchall()
    assert sorted(map(tuple, left.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(right, key=str)


def test_ranked_ties_and_nulls(spark):
    documents = pd.DataFrame({"doc_id": [5, 3, 9, 4, 7, 8], "text": ["A b c", "a B c", "É a", None, "...", "b b b é É ÉÄ"]})
    benchmark = pd.DataFrame({"item_id": [1, 2, 3, 4], "text": ["a b", "É!", None, "zz"]})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    left = ranked.ranked_digest(spark.createDataFrame(documents), spark.createDataFrame([tuple(r) for r in benchmark.itertuples(index=False)], "item_id long, text string"))
    same(left.toPandas(), con.sql(ORACLE_SQL["op12_ranked"]).df())
