"""An English analyzer: words by Unicode's boundaries, possessives off, stopwords out, Porter stems.

``analyzed`` is an analyzer for indexes and searches: each batch of texts has its distinct words stemmed once. ``vocabulary`` and ``stemmed`` join the stems of the whole
corpus' distinct words instead.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import wordbreaks

# The usual English stop list of search engines.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# The suffix rules of Porter (1980), steps 2 to 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_TWO, _THREE = _rules(STEP2), _rules(STEP3)
_FOUR = sorted(STEP4.split(), key=lambda s: -len(s))


def _shape(word: str) -> str:
    """c or v per letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k > 0 and out[k - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _first_of(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, to in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + to if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _first_of(_first_of(word, _TWO), _THREE)
    for suffix in _FOUR:
        if word.endswith(suffix):
            cut = word[: -len(suffix)]
            if _measure(cut) > 1 and (suffix != "ion" or cut[-1:] in ("s", "t")):
                word = cut
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def words(text: Column) -> Column:
    """Words by Unicode's default boundaries, lower-cased, without possessives and stopwords; none for null."""
    owned = lambda w: F.endswith(w, F.lit("'s")) | F.endswith(w, F.lit("’s")) | F.endswith(w, F.lit("＇s"))
    low = F.transform(F.transform(wordbreaks.words(text), F.lower), lambda w: F.when(owned(w), F.substr(w, F.lit(1), F.length(w) - 2)).otherwise(w))
    return F.filter(low, lambda w: ~w.isin(STOPWORDS) & (w != ""))


_kept = functools.lru_cache(2**17)(stem)


def stem_lists(lists: pa.Array) -> pa.Array:
    """An Arrow column of word lists with stems instead; of a batch, each distinct word is stemmed once, and frequent ones are remembered."""
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    stems = pa.array([_kept(w) for w in coded.dictionary.to_pylist()], pa.string())
    offsets = pa.compute.subtract(lists.offsets, lists.offsets[0]) if len(lists) else pa.array([0], pa.int32())
    return pa.ListArray.from_arrays(offsets.cast(pa.int32()), stems.take(coded.indices))


def _stemmed_lists(lists: pa.Array) -> pa.Array:
    return stem_lists(lists)


def analyzed(text: Column) -> Column:
    """Stems of a text's words, in order: an analyzer for ``Index``, ``Engine`` and the searches."""
    return F.arrow_udf(_stemmed_lists, "array<string>")(words(text))


def vocabulary(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(word, stem) of every distinct word."""
    each = docs.select(F.explode(F.array_distinct(F.flatten(F.array(*[words(F.col(f)) for f in fields])))).alias("word")).distinct()
    return each.withColumn("stem", F.pandas_udf(_stems, "string")("word"))


def stemmed(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, tokens): analyzed fields, words replaced by their stems; as ``index.tokenized``."""
    each = docs.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("w")) for f in fields])).alias("f")).select("id", "f.field", F.posexplode_outer("f.w").alias("at", "word"))
    joined = each.join(vocabulary(docs, fields), "word", "left")
    lists = joined.groupBy("id", "field").agg(F.sort_array(F.collect_list(F.when(F.col("stem").isNotNull(), F.struct("at", "stem")))).alias("t"))
    return lists.select("id", "field", F.transform("t", lambda x: x["stem"]).alias("tokens"))
