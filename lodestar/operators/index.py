"""Corpus statistics and postings.

Documents are (id, and one text column per field). ``tokenized`` has the token arrays once; postings come from them, for all terms
or for the terms of some queries only, in which case tokens that no query asks for are dropped before anything is counted or dealt out.
An index that later searches read is in ``segments``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx

Analyzer = Callable[[Column], Column]
#: Query terms (or other narrow rows) that a join may broadcast; more are dealt out.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` narrow rows, which is counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tokenized(docs: DataFrame, fields: list[str], analyzer: Analyzer = tx.tokens) -> DataFrame:
    """(id, tokens): a row per document, with a map from field to tokens as an array of structs (field, tokens)."""
    return docs.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyzer(F.col(f)).alias("tokens")) for f in fields])).alias("f")).select("id", "f.field", "f.tokens")


def field_stats(tokens: DataFrame) -> DataFrame:
    """(field, n_docs, avg_len) over documents that have the field."""
    return tokens.where(F.size("tokens") > 0).groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens").cast("double")).alias("avg_len"))


def postings(tokens: DataFrame, terms: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """(field, term, id, dl, tf), and positions if asked for; of ``terms`` (term) only, if given.

    Tokens are dealt out by document alone, so what is counted and summed per document from here on stays where it is.
    """
    each = tokens.select("id", "field", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    if terms is not None:
        each = each.join(small(terms.select("term").distinct()), "term", "left_semi")
    each = each.repartition("id")
    more = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return each.groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"), *more)


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(field, term, df). It asks for tf, so that its plan holds the same exchange as one that reads postings, and that is made once."""
    return posted.groupBy("field", "term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))


def query_terms(queries: DataFrame, analyzer: Analyzer = tx.tokens) -> DataFrame:
    """(query_id, term, qtf): each occurrence of a term in a query is a clause of its own."""
    return queries.select("query_id", F.explode(analyzer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
