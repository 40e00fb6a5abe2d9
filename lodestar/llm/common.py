"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.store import shared_folder
from lodestar.sources.corpora import read_table


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, written once to the reliable checkpoint folder, so that later steps do not compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration, written to the checkpoint folder and read again; a name has 16 places, which are taken in turn.

    Unlike a checkpoint, a written table brings its true size along; the estimates of a plan that joins its own results
    would be multiplied anew in each round.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at, self.turn = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4()}", 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.turn += 1
        path = f"{self.at}/{name}-{self.turn % 16}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names compare without case, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def md5_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, null parts as ``\\N``; SQL engines agree on it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array | list]], add: T.StructType) -> DataFrame:
    """``df`` with the columns of ``add``, which ``fn`` makes for each Arrow batch; all other columns pass through.

    A column of ``df`` that is named like one of ``add`` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    named = {f.name.lower() for f in add.fields}
    kept = [c for c in df.columns if c.lower() not in named]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], *add.fields])
    made = to_arrow_schema(add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            arrays = [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], f.type) for f in made]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *made.names])

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df`` and all its other columns as one struct, so that no name meets one that an operator makes."""
    named = {c.lower() for c in cols}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in named]
    return df.select(*cols, F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """What ``packed`` took apart, in the order of ``columns``."""
    whole = {c.lower() for c in df.columns}
    inner = {c.lower() for c in df.schema["_rest"].dataType.fieldNames()}
    return df.select(*[(F.col("_rest").getField(c) if c.lower() in inner else F.col(f"`{c}`")).alias(c) for c in columns if c.lower() in inner | whole])


#: Rows of at most some hundred bytes each that a join may broadcast; more are dealt out by key.
BROADCAST_ROWS = 50_000
#: Where rows are dealt out, keys with more than this share of them (fewer than its inverse) are joined by broadcast instead.
COMMON = 1 / 256


def join_checked(left: DataFrame, right: DataFrame, key: Column, right_key: str, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right`` (checkpointed, narrow, one row a ``right_key``) whose key is ``key``; null meets null.

    A ``right`` of few rows is broadcast. Else rows are dealt out by key, but for those whose key is null or common: there are at most
    1 / ``COMMON`` of these keys, so their rows of ``right`` are broadcast and a hot key isn't one task.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key.eqNullSafe(right[right_key]), how)
    own = fresh(left, "_own_key")
    keyed = left.withColumn(own, key)
    counts = keyed.groupBy(own).count()
    counts = checkpoint(counts.withColumnRenamed(own, "key"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    common = [r["key"] for r in counts.where((F.col("count") > COMMON * total) & F.col("key").isNotNull()).select("key").collect()]
    is_common = lambda c: c.isNull() | c.isin(*common) if common else c.isNull()
    few = F.broadcast(right.where(is_common(F.col(right_key))))
    hot = keyed.where(is_common(F.col(own))).join(few, F.col(own).eqNullSafe(few[right_key]), how)
    rest = keyed.where(~is_common(F.col(own))).join(right, F.col(own) == right[right_key], how)
    return hot.unionByName(rest).drop(own)
