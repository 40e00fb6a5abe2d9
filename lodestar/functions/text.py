"""Text functions: tokens, stopwords, bigrams, hashes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords of coverage, and those that feedback leaves out as well.
COVERAGE_STOPWORDS = (
    "what are is the a an of to in and or for with on by from has have been be can did does do about at "
    "which that this into it anyone else not so far must when under over based as some using than other possible available could would should "
    "there any just how why if then where who whose such these those was were will shall may might its their but all after before beyond between while "
    "during per via also used use due out up down high low very"
).split()
FEEDBACK_STOPWORDS = COVERAGE_STOPWORDS + (
    "information method methods problem problems results result data effect effects solution solutions "
    "determine determined calculated calculation investigation investigations study studies paper papers"
).split()


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalize_query(query: Column) -> Column:
    """(incoming, normalized, transformations) of a query text; null is empty."""
    incoming = F.coalesce(query.cast("string"), F.lit(""))
    trimmed = F.regexp_replace(incoming, r"^\s+|\s+$", "")
    normal = F.regexp_replace(trimmed, r"\s+", " ")
    done = F.filter(F.array(F.when(trimmed != incoming, F.lit("trimmed leading/trailing whitespace")), F.when(normal != trimmed, F.lit("collapsed repeated internal whitespace"))), lambda x: x.isNotNull())
    return F.struct(incoming.alias("incoming"), normal.alias("normalized"), F.when(F.size(done) == 0, F.array(F.lit("none"))).otherwise(done).alias("transformations"))


def tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


_ALNUM = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def arrow_tokens(texts: pa.Array) -> pa.Array:
    """``tokens`` of an Arrow column, for tasks that go on with the tokens in Python."""
    plain = pa.array([(t or "").lower().encode("ascii", "replace").translate(_ALNUM).decode("ascii").strip() for t in texts.to_pylist()], pa.string())
    found = pc.ascii_split_whitespace(plain)
    return pc.if_else(pc.equal(pc.binary_length(plain), 0), pa.scalar([], pa.list_(pa.string())), found)


def embedding_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: F.length(t) > 1)


def significant_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens of three characters or more that aren't stopwords, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in (COVERAGE_STOPWORDS if stopwords is None else stopwords)])
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def bigrams(words: Column, joint: str = " ") -> Column:
    """Neighbouring pairs; none for fewer than two words."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(joint), b))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def body(fields: list[str]) -> Column:
    """The first of some text columns that isn't null."""
    return F.coalesce(*[F.col(f) for f in fields], F.lit(""))


def feedback_text(title: str = "title", text: str = "abstract") -> Column:
    """Titles count twice."""
    t, b = (F.coalesce(F.col(c), F.lit("")) for c in (title, text))
    return F.concat_ws(" ", t, t, b)


def embedding_text(profile: str = "full", prefix: str = "") -> Column:
    parts = ["title", "abstract", "text"] if profile == "full" else ["title", "abstract"]
    return F.concat(F.lit(prefix), F.concat_ws("\n", *[F.nullif(F.col(p), F.lit("")) for p in parts]))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's UTF-16 units, as an unsigned number."""
    units = F.encode(text, "UTF-16BE")
    places = F.sequence(F.lit(1), F.greatest(F.length(units), F.lit(2)) - 1, F.lit(2))
    unit = lambda k: F.conv(F.hex(F.substr(units, k, F.lit(2))), 16, 10).cast("long")
    folded = F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, k: (h.bitwiseXOR(unit(k)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(F.length(units) == 0, F.lit(2166136261).cast("long")).otherwise(folded)
