"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns report what is plain by itself: assignments to secret-like names, access keys and long hex runs. Weak
candidates are parts of a credential that mean nothing alone: account names, mixed tokens or short assigned values, and
addresses. A weak part is reported only if at most ``SCOPE`` code points lie between it and its complement:

* an identifier next to a secret (weak, assigned or hex),
* a secret next to an identifier (weak, or an access key),
* an endpoint next to both.

Parts are rows keyed by document and scope bucket, one for each bucket that a part covers; a part looks into those buckets and
the two beside them, and semi-joins keep each part once however many complements it has, so no pairs are made and a key holds
at most what fits into a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_ROWS, checkpoint, packed, unpacked

SCOPE = 240
#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: [A-Z0-9]+ and [0-9a-f]+ take whole runs, so asking for the length within the pattern finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
LEAST_WEAK = 4
WEAK_ID = r"""(?i)(?:client_?id|user_?name|user|login|account|key_?id)["']?\x20*[:=]\x20*["']?[a-z0-9_.@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:https?|ftps?|sftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqps?|s3)://[^\s"'<>]+"""
MASK = "[secret]"

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:int>>"


def _matches(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, length of the value), offsets in code points.

    Texts between matches come from split, matches from regexp_extract_all; the offsets are running sums of their lengths.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group) if value_group else hits
    sizes = F.zip_with(F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("len"))), values, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), F.length(v).alias("value")))
    sizes = F.filter(sizes, lambda s: s["len"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["gap"]
        end = begin + s["len"]
        new = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(new)).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(sizes, start, step, lambda s: s["found"])).otherwise(F.array().cast(_SPANS))


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with base spans, weak candidates and a key of the row (null without weak candidates)."""
    text = F.col(text_col).cast("string")
    found = docs.withColumn("_assign", _matches(text, ASSIGN, 0, 2))
    strong = F.filter("_assign", lambda s: s["value"] >= LEAST_ASSIGNED)
    short = F.transform(F.filter("_assign", lambda s: s["value"].between(LEAST_WEAK, LEAST_ASSIGNED - 1)), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    found = found.withColumn("_base", F.array_sort(F.concat(strong, _matches(text, ACCESS, 1), _matches(text, HEX, 2))))
    found = found.withColumn("_weak", F.concat(short, _matches(text, WEAK_ID, 3), _matches(text, WEAK_SECRET, 4), _matches(text, ENDPOINT, 5)))
    found = found.withColumn("_base", F.coalesce("_base", F.array().cast(_SPANS))).withColumn("_weak", F.coalesce("_weak", F.array().cast(_SPANS)))
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("\\N")), text), 256)
    return found.withColumn("_key", F.when(F.size("_weak") > 0, key)).drop("_assign")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """(_key, _more): the weak candidates of each row that have their complements; ``parts`` has _key, _base, _weak."""
    every = parts.where("_key is not null").select("_key", F.explode(F.array_distinct(F.concat("_base", "_weak"))).alias("s")).distinct()
    every = every.select("_key", "s", F.col("s.kind").alias("kind"))
    ids = every.where(F.col("kind").isin(1, 3))
    keys = every.where(F.col("kind").isin(0, 2, 4))

    def buckets(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope))).alias("bucket")

    def beside(weak: DataFrame, other: DataFrame) -> DataFrame:
        start, end = F.col("s.start"), F.col("s.end")
        look = weak.select("_key", "s", buckets(start - scope, end + scope))
        there = other.select("_key", start.alias("from"), end.alias("to"), buckets(start, end)).withColumnsRenamed({"_key": "k", "bucket": "b"})
        near = (F.col("_key") == F.col("k")) & (F.col("bucket") == F.col("b")) & (F.col("from") <= end + scope) & (F.col("to") >= start - scope)
        return look.join(there, near, "left_semi").select("_key", "s").distinct()

    found = [
        beside(every.where("kind = 3"), keys),
        beside(every.where("kind = 4"), ids),
        beside(beside(every.where("kind = 5"), ids), keys),
    ]
    return reduce(DataFrame.unionAll, found).groupBy("_key").agg(F.collect_list("s").alias("_more"))


def with_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with base_spans and spans (base and linked), arrays of (start, kind, end) sorted by start and kind.

    Offsets are code points, ends exclusive; ``KINDS`` names the kinds. Null and empty texts have none; a very long text is scanned in whole,
    and its spans are one row; spans that start together are ordered by kind, then end; repeated rows get the same spans each; columns of docs
    named like new ones are replaced, all others pass through; an empty table gives an empty table. Texts are scanned once: rows are
    checkpointed with what was found.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    parts = checkpoint(_parts(packed(docs.select(*[F.col(f"`{c}`") for c in kept]), id_col, text_col), id_col, text_col))
    found = _joined(parts, checkpoint(_linked(parts, scope)))
    return unpacked(found, [*kept, "base_spans", "spans"])


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """``parts`` (checkpointed) with base_spans and spans; only rows with weak candidates are joined, unless ``more`` is broadcast."""
    few = more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = parts.drop("_weak")
    more = more.withColumnRenamed("_key", "_of")
    if few:
        joined = rows.join(F.broadcast(more), F.col("_key") == F.col("_of"), "left")
    else:
        joined = rows.where("_key is not null").join(more, F.col("_key") == F.col("_of"), "left")
        joined = joined.unionByName(rows.where("_key is null").withColumn("_of", F.lit(None).cast("string")).withColumn("_more", F.lit(None).cast(_SPANS)))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(_SPANS))))
    return joined.withColumn("base_spans", plain(F.col("_base"))).withColumn("spans", plain(spans)).drop("_base", "_more", "_key", "_of")


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    parts = checkpoint(_parts(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", "_key", "_base", "_weak"))
    found = _joined(parts, checkpoint(_linked(parts, SCOPE)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named(F.col("base_spans")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each run of overlapping spans replaced by ``mask``."""
    state = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(runs: Column, s: Column) -> Column:
        last = F.element_at(runs, -1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        wider = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] > s["start"]), wider).otherwise(F.concat(runs, F.array(one)))

    runs = F.aggregate(spans, state, merge)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("long")))
    between = F.zip_with(ends, starts, lambda end, start: F.substr(text, (end + 1).cast("int"), (start - end).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(between, mask)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span masked, and with n_chars (if there) made the new text's length; all rows stay.

    Null and empty texts stay as they are, a very long text is masked in whole, repeated rows are masked alike; columns of any name pass
    through; an empty table gives an empty table.
    """
    kinds = dict(docs.dtypes)
    found = with_spans(packed(docs, "doc_id", "text"))
    found = found.withColumn("changed", F.size("spans") > 0).withColumn("text", masked(F.col("text"), F.col("spans")))
    rest = {c.lower() for c in found.schema["_rest"].dataType.fieldNames()}

    def made(c: str) -> Column:
        old = F.col("_rest").getField(c) if c.lower() in rest else F.col(f"`{c}`")
        return F.when(F.col("changed"), F.length("text").cast(kinds[c])).otherwise(old) if c.lower() == "n_chars" else old

    return found.select(*[made(c).alias(c) for c in docs.columns])
