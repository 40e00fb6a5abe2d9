import hashlib
import re

import pytest

from lodestar.llm import decontaminate as D
from lodestar.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    ws = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        iw = words(item_text)
        patterns = [iw[i : i + window] for i in range(max(1, len(iw) - window + 1))] if iw else []
        for p in patterns:
            for i in range(len(ws) - len(p) + 1):
                if ws[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_whole_table_against_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = D.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).collect()
    assert len(rows) == len(docs)
    assert any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, None), (4, "..."), (None, "null id"), (5, "one two three four five six seven eight nine ten eleven"), (30, "é à ü ß ñ ø å æ ç ó í")]
DOCS = [
    (1, "zero ONE two, three four five six seven eight nine ten eleven twelve", 7),
    (2, "a short-item b shortitem short  item", 7),
    (3, None, 7),
    (4, "", 7),
    (5, "é à ü ß ñ ø å æ ç ó í " * 300 + "one two three four five six seven eight nine", 7),
    (5, "null id", 7),
    (None, "short item", None),
]


@pytest.mark.parametrize("most", [D.MAX_PATTERN_WORDS, 12])
def test_cases_blocks_and_spans(spark, most):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, N_Words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.find_contamination(docs, bench, max_pattern_words=most).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        n, hit, items, _, bad = brute(r.text, [i for i in ITEMS if i[0] is not None])
        assert (r.n_words, r.n_hit, len(r["items"]), r.contaminated) == (n, hit, items, bad)
        assert sum(len(words(r.text[s.start : s.end])) for s in r.hit_spans) == hit
    assert D.drop_contaminated(docs, bench).columns == docs.columns
    assert sorted((r.doc_id, r.N_Words) for r in D.drop_contaminated(docs, bench).collect()) == [(3, 7), (4, 7), (5, 7)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, N_Words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination_digest(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination_digest(docs, bench.limit(0)).collect())
