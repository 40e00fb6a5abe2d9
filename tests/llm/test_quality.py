import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from lodestar.llm import quality as Q
from lodestar.llm.common import table


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert Q.repeated_words([w.encode() for w in words]) == brute(" ".join(words))[4]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = Q.quality_digest(table(spark, sf_dir, "documents")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, again, repeats, lines = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (n, chars, symbols, again, repeats, lines)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.any_failed == (r.base_failed or 100 * symbols > 10 * chars or 100 * again > 30 * lines)
        assert r.kept == (not r.base_failed)


def test_bad_domain_and_odd_rows(spark):
    good = " ".join(f"word{k}" for k in range(30))
    data = [(k, "bad", None if k % 2 else "x", 1) for k in range(200)] + [(500, "bad", good, 1)]
    data += [(1000 + k, f"good{k % 20}", good, 1) for k in range(400)] + [(None, None, good, None), (7, None, "", None)] + [(8, "good1", "é\x0bé #  " * 40000, 1)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, Kept int")
    rows = Q.with_verdicts(docs).collect()
    assert len(rows) == len(data)
    assert not any(r.kept for r in rows if r.source == "bad")
    assert all(r.kept for r in rows if (r.source or "bad") != "bad" and r.doc_id != 8)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r.Kept for r in kept.collect()} <= {1, None}
    assert Q.quality_digest(docs.limit(0)).count() == 0


def test_domains_of_symbols_and_of_lines_are_rejected_and_clean_ones_are_not(spark):
    good = " ".join(f"word{k}" for k in range(30))
    symbols, lines = " ".join(f"<b{k}>#" for k in range(30)), "\n".join(f"{w}\nhome" for w in good.split())
    data = [(k, "symbols", symbols if k % 10 else good) for k in range(300)] + [(1000 + k, "lines", lines if k % 10 else good) for k in range(300)]
    data += [(2000 + k, "mixed", (symbols, good, good)[k % 3]) for k in range(300)] + [(3000 + k, f"clean{k % 30}", good) for k in range(600)]
    data += [(4000, "small", symbols), (4001, "small", good)]
    rows = Q.quality_digest(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    source = {d[0]: d[1] for d in data}
    assert not any(r.base_failed for r in rows)
    assert {source[r.doc_id] for r in rows if not r.kept} == {"symbols", "lines"}
    assert {source[r.doc_id] for r in rows if r.kept}.isdisjoint({"symbols", "lines"})
