import public_tokenizers
import pytest
import sentencepiece

from lodestar.llm import tokencount as K
from lodestar.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a ", " a", "\n", "\n\n a\n", "a\nb", "a \n b", "a▁b", "▁", "x\ty\r\nz", "<s> </s> <unk> <0x0A>", "café \U0001f600\U0001f600 中文", "\x00\x01 \x00", "a" * 5000, " " * 3000 + "b", "the the the " * 70000, "ﬁ   　 end", "don't stop, now. (e.g.) http://a.b/c?d=1"]


def test_whole_table_against_the_library(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in table(spark, sf_dir, "documents").collect()}
    rows = K.token_digest(table(spark, sf_dir, "documents"), PATH).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)


def test_odd_texts_repeats_and_clashing_columns(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    data = [(k if k % 5 else None, t, 1) for k, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens int").repartition(3)
    rows = K.token_counts(docs, PATH).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in data)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want


def test_empty_table(spark):
    assert K.token_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_model_that_changes_texts_is_refused():
    with pytest.raises(Exception):
        K.PieceModel(b"no model")


def test_batches_and_counts_do_not_depend_on_the_order_of_rows(spark, sf_dir, monkeypatch):
    """A task that runs again after an executor is lost may get its rows in another order; the rows that it sends must be the same."""
    monkeypatch.setattr(K, "COMMON", 5)
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    docs += docs[:20] + [(None, "a b c"), (None, None), (7, None)]
    sent = []
    for rows in (docs, docs[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        sent.append(sorted((bytes(r.token or b""), r.batch, r.entries or [], str(r.document)) for r in K.pre_token_rows(df, PATH).collect()))
    assert sent[0] == sent[1] and all(len(x[2]) < 5 for x in sent[0])
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((r.n_bytes, r.n_tokens) for r in K.token_counts(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect())
    assert got == sorted((len((t or "").encode()), len(model.encode(t or ""))) for _, t in docs)
