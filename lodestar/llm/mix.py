"""Mixing sources to target weights.

Words are counted per document and summed per source. Sources in code-point order (a null source last) take weights
in turn and share a budget of words; a source's target stops at ``max_rate`` times its words, and what it can't
take is shared by the others by weight until none is above its bound. A source's rate is its target by its words;
each document is emitted floor(rate) times, and once more if a number in [0, 1) hashed from the seed, its id and
its text is below the rate's fraction. Reruns agree, and a document's copies don't depend on any other document's hash.

The shuffle carries one partial sum a source and task; the ordered windows run over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, fresh, join_checked, md5_unit

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, *, source_col: str = "source", size: Column, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """One row a source: source, source_size, target and rate.

    Weighted water-filling: in ascending order of bound by weight, the first sources are at their bounds, and all others
    have one level times their weight. A source of no words has target 0 and rate 0.
    """
    sources = docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
        .withColumn("bound", F.col("source_size") * F.lit(float(max_rate)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
    )
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    at_level = (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = level.withColumn("level", at_level).withColumn("free", F.col("bound") >= F.col("level") * F.col("weight"))
    level = level.withColumn("shared", F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), "source", "level"))).over(every)["level"])
    target = F.least(F.col("bound"), F.coalesce(F.col("shared") * F.col("weight"), F.col("bound")))
    return level.select("source", "source_size", target.alias("target")).withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))


def with_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    A null or empty text has size 0, and a very long one its whole size; null sources are one source; rows repeated in whole take the same
    number of copies, which ties (equal hashes) share too; a column of docs that is named like a new one is replaced. An empty table gives an
    empty table.
    """
    sized = docs.withColumn("size", word_count(F.col(text_col)))
    targets = checkpoint(source_targets(sized, source_col=source_col, size=F.col("size"), **shares))
    key, has = fresh(sized, "_key"), fresh(sized, "_rate")
    targets = targets.select(F.col("source").alias(key), F.col("source_size"), F.col("target"), F.col("rate").alias(has))
    fixed = sized.drop("source_size", "target", "copies")
    joined = join_checked(fixed, targets, F.col(source_col).cast("string"), key)
    whole = F.floor(F.col(has))
    more = md5_unit(seed, F.col(id_col), F.md5(F.col(text_col).cast("binary"))) < F.col(has) - whole
    return joined.withColumn("copies", (whole + more.cast("int")).cast("long")).drop(key, has)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns only."""
    names = docs.columns
    taken = with_copies(docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(names)]), **{k: _inner(names, options.pop(k, default)) for k, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}, **options)
    repeated = taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)])


def _inner(names: list[str], name: str) -> str:
    return f"in_{[c.lower() for c in names].index(name.lower())}"


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    taken = with_copies(docs.select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
