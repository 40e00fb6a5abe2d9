"""Quality rules at two levels: of a document, and of its domain.

A document fails by its own words: too few of them, or too many inside repeated windows. Two rules more, for symbols and for lines that
repeat, don't reject a document, but count against its domain. Documents that break any rule are summed per domain, each domain's rate is
shrunk towards an empirical beta prior (by moments over all domains), and domains whose shrunk rate is above a bound reject all their
documents. Small domains stay near the prior, so a few failures don't condemn them.

Only sums per domain are dealt out (a task sends one row a domain, so a hot domain isn't a hot task), and verdicts join
back on the domain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import checkpoint, fresh, join_checked, map_rows, packed, unpacked, utf8

LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30
#: Symbols per word character, and repeated lines per line, above which a document counts against its domain.
MOST_SYMBOLS_PERCENT = 10
MOST_DUP_LINES_PERCENT = 30
#: A domain rejects all its documents if its shrunk rate of failures is above this.
MOST_FAILURES = 0.7
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur twice or more.

    Runs are numbered by doubling: runs of 2, 4 and 8 words from pairs of shorter ones, so equal numbers mean equal runs.
    A run can only repeat where all pairs of neighbours in it do, which most texts settle at once.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    at = ids[:-1] * len(number) + ids[1:]
    _, pair, times = np.unique(at, return_inverse=True, return_counts=True)
    again = np.concatenate(([0], np.cumsum(times[pair] > 1)))
    if not (again[window - 1 :] - again[: -(window - 1)] == window - 1).any():
        return 0
    run, length = pair, 2
    while length < window:
        step = min(length, window - length)
        _, run = np.unique(run[: len(run) - step] * n + run[step:], return_inverse=True)
        length += step
    _, run, times = np.unique(run, return_inverse=True, return_counts=True)
    starts = times[run] > 1
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, np.flatnonzero(starts), 1)
    np.add.at(inside, np.flatnonzero(starts) + window, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The measures of ``BASE``; lines are those with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _BLANK + _INNER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [measure(t) for t in utf8(batch.column(text_col))]
        return dict(zip(BASE.names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in BASE.names], strict=True))

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MOST_SYMBOLS_PERCENT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MOST_DUP_LINES_PERCENT * F.col("n_lines")
    return map_rows(docs, run, BASE).withColumn("base_failed", failed).withColumn("any_failed", F.col("base_failed") | symbols | lines)


def domain_verdicts(failures: DataFrame, *, most: float = MOST_FAILURES) -> DataFrame:
    """``failures`` (domain, n, failed; one row a domain) with the shrunk rate and whether the domain is kept.

    The prior's mean and variance are those of the domains' raw rates; with one domain, or no variance, or more variance than
    a beta has, one document at the mean stands for the prior.
    """
    raw = F.col("failed") / F.col("n")
    prior = failures.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"))
    mean, var = F.col("mean"), F.col("var")
    weight = F.when((var > 0) & (var < mean * (1 - mean)), mean * (1 - mean) / var - 1).otherwise(F.lit(1.0))
    prior = prior.select(F.struct((mean * weight).alias("a"), (weight - mean * weight).alias("b")).alias("p"))
    shrunk = failures.withColumn("prior", prior.scalar())
    rate = (F.col("failed") + F.col("prior.a")) / (F.col("n") + F.col("prior.a") + F.col("prior.b"))
    return shrunk.withColumn("domain_rate", rate).withColumn("domain_kept", F.col("domain_rate") <= most).drop("prior")


def _judged(measured: DataFrame, domain_col: str, most: float) -> DataFrame:
    """``measured`` (checkpointed rows with base_failed and any_failed) with domain_rate, domain_kept and kept."""
    domain = F.col(domain_col).cast("string")
    failures = measured.groupBy(domain.alias("domain")).agg(F.count("*").alias("n"), F.sum(F.col("any_failed").cast("long")).alias("failed"))
    judged = measured.drop("domain_rate", "domain_kept", "kept")
    key = fresh(judged, "_domain")
    verdicts = checkpoint(domain_verdicts(checkpoint(failures), most=most).select(F.col("domain").alias(key), "domain_rate", "domain_kept"))
    return join_checked(judged, verdicts, domain, key).drop(key).withColumn("kept", ~F.col("base_failed") & F.col("domain_kept"))


def with_verdicts(docs: DataFrame, *, text_col: str = "text", domain_col: str = "source", most: float = MOST_FAILURES) -> DataFrame:
    """``docs`` with the measures, base_failed, any_failed, domain_rate, domain_kept and kept.

    Null and empty texts have no words and so fail; a very long text is measured in whole, by its task alone; documents without a domain are
    one domain; repeated rows count and are judged one by one; a domain whose rate equals the bound is kept; columns named like new ones are
    replaced; an empty table gives an empty table. Texts are measured once: rows are checkpointed with their measures.
    """
    return _judged(checkpoint(with_measures(docs, text_col)), domain_col, most)


def quality_digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, any_failed, kept."""
    measured = checkpoint(with_measures(docs.select("doc_id", "source", "text")).drop("text"))
    return _judged(measured, "source", MOST_FAILURES).select("doc_id", *BASE.names, "base_failed", "any_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns only, of any name; null and empty texts fail, so they go."""
    judged = with_verdicts(packed(docs, "text", "source"))
    return unpacked(judged.where("kept"), docs.columns)
