import random

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lodestar.functions import wordbreaks as wb
from lodestar.operators import english
from lodestar.operators import retrieval as rt
from lodestar.operators.segments import Index

# Samples of Annex 29 and its test file, cut at their boundaries.
PUBLISHED = [
    "The| |quick| |(|“|brown|”|)| |fox| |can’t| |jump| |32.3| |feet|,| |right|?",
    "can't", "3,456.789", "3a", "ab1c", "a_b", "_a_1_", "__", "a:b", "a.b", "1.2", "a|,|b", "1|:|2", "a|.|.|b", "a'b|'", "\r\n", "\n|\r|a", "a|  |b", "äb", "a|\u0001", "̈",
    "カタカナ|ひ|ら|漢|字", "カ_カ", "カ|a", "א\"א", "א'", "א'|1", "א|\"|a", "א'א", "a'|".rstrip("|").replace("'", "|'"), "🇦🇧|🇨", "👩‍👧|a", "a‍👩", "a|🇦🇧|b", "1|_".replace("|", ""), "가나",
    "A­B", "x|​|y", "a|  |b",
]
ALPHABET = list("aZéβж1٣_‿:.,;'’\" \t\n\r\u000b̈‍­​　カアーひ漢אבالك-!") + ["👩", "🏽", "🇦", "🇧", "ℹ", "❤", " ", " ", "가"]


def test_published_samples(spark):
    rows = [(k, s.replace("|", "")) for k, s in enumerate(PUBLISHED)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, t string").select("k", wb.segments(F.col("t")).alias("s")).collect()}
    assert [got[k] for k in range(len(PUBLISHED))] == [s.split("|") for s in PUBLISHED]


CLASSES = "CR LF Newline Extend ZWJ Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet WSegSpace Regional_Indicator".split()


def cut(text: str) -> list[str]:
    """The annex's rules in their order at each place; properties are those of another library."""
    kinds = [next((c for c in CLASSES if regex.fullmatch(rf"\p{{Word_Break={c}}}", ch)), "Other") for ch in text]
    letter, both = ("ALetter", "Hebrew_Letter"), ("MidNumLet", "Single_Quote")
    glued, ends = ("Extend", "Format", "ZWJ"), ("CR", "LF", "Newline")

    def breaks(k: int) -> bool:
        left, right = kinds[k - 1], kinds[k]
        if (left, right) == ("CR", "LF"):
            return False
        if left in ends or right in ends:
            return True
        if left == "ZWJ" and regex.fullmatch(r"\p{Extended_Pictographic}", text[k]):
            return False
        if left == right == "WSegSpace" or right in glued:
            return False
        before = [c for j, c in enumerate(kinds[:k]) if c not in glued or j == 0 or kinds[j - 1] in ends]
        after = [c for c in kinds[k + 1 :] if c not in glued]
        left, far = before[-1], before[-2] if len(before) > 1 else None
        near = after[0] if after else None
        if left in letter and (right in letter or (right in ("MidLetter", *both) and near in letter)):
            return False
        if left in ("MidLetter", *both) and far in letter and right in letter:
            return False
        if left == "Hebrew_Letter" and (right == "Single_Quote" or (right == "Double_Quote" and near == "Hebrew_Letter")):
            return False
        if far == right == "Hebrew_Letter" and left == "Double_Quote":
            return False
        if (left == "Numeric" or left in letter) and (right == "Numeric" or right in letter):
            return False
        if (left in ("MidNum", *both) and far == right == "Numeric") or (left == "Numeric" and right in ("MidNum", *both) and near == "Numeric"):
            return False
        if left == right == "Katakana":
            return False
        joined = ("Numeric", "Katakana", "ExtendNumLet", *letter)
        if (right == "ExtendNumLet" and left in joined) or (left == "ExtendNumLet" and right in joined):
            return False
        flags = 0
        while flags < len(before) and before[-1 - flags] == "Regional_Indicator":
            flags += 1
        return not (right == "Regional_Indicator" and flags % 2 == 1)

    at = [0, *[k for k in range(1, len(text)) if breaks(k)], len(text)]
    return [text[i:j] for i, j in zip(at, at[1:], strict=False)]


def test_the_plain_rules_cut_the_samples():
    assert [cut(s.replace("|", "")) for s in PUBLISHED] == [s.split("|") for s in PUBLISHED]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_are_cut_as_by_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 12))) for _ in range(8000)]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", wb.segments(F.col("t")).alias("s")).collect()
    wrong = [(texts[r.k], cut(texts[r.k]), r.s) for r in found if cut(texts[r.k]) != r.s]
    assert not wrong, (len(wrong), sorted(wrong, key=lambda w: len(w[0]))[:12])


def test_words(spark):
    cases = {
        "The pilot's wings, and O'Neil's Été": ["The", "pilot's", "wings", "and", "O'Neil's", "Été"],
        "3,456.7 m/s v2.0 a_b __ 👩 漢字カナ": ["3,456.7", "m", "s", "v2.0", "a_b", "漢", "字", "カナ"], "": [], "ภาษาไทย ok": ["ภาษาไทย", "ok"],
    }
    got = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", wb.words(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in got} == cases | {None: []}


def test_very_long_words_need_no_stack(spark):
    texts = ["a" * 300_000, "a." * 150_000 + "a", "1," * 150_000 + "1", "a_" * 100_000, "ä" * 100_000, "א\"" * 100_000, "漢" * 50_000]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.size(wb.words(F.col("t"))).alias("n"), F.size(wb.segments(F.col("t"))).alias("s")).collect()
    assert {r.k: r.n for r in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 50_000}


def test_stems_of_lists():
    lists = pa.array([["flies", "wings"], [], ["wings"], ["x"]], pa.list_(pa.string()))
    assert english.stem_lists(lists).to_pylist() == [["fli", "wing"], [], ["wing"], ["x"]]
    assert english.stem_lists(lists.slice(2)).to_pylist() == [["wing"], ["x"]]
    assert english.stem_lists(lists.slice(4)).to_pylist() == english.stem_lists(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_an_index_of_stems(spark, tmp_path):
    rows = [("1", "Flying wings", "the wing's pressure"), ("2", None, "3.5 pressures"), ("3", "", ""), ("4", "été", None)]
    docs = spark.createDataFrame(rows, "id string, title string, text string")
    asked = spark.createDataFrame([("a", "a wing flies"), ("b", "pressured"), ("c", "3.5"), ("d", "the"), ("e", "ÉTÉ")], "query_id string, query string")
    fields = {"title": 2, "text": 1}
    index = Index.create(spark, f"{tmp_path}/index", list(fields), analyzer=english.analyzed).load(docs)
    got = index.top(asked, 5, fields, tie=0.0)
    assert {(r.query_id, r.id) for r in got.collect()} == {("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("e", "4")}
    again = rt.top_k(rt.best_fields(rt.term_scores(docs, asked, list(fields), analyzer=english.analyzed), fields), 5)
    columns = ["query_id", "id", "score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, again.select(columns).collect()))


#: ``TOKEN`` without the short way for usual text.
WHOLE = rf"{wb.WORD}|[{wb._IDEOGRAPHS}&&[^\p{{M}}]]{wb._X}|(?:[{wb.COMPLEX}&&\p{{L}}]{wb._X})++"


@pytest.mark.parametrize("seed", [3, 4])
def test_the_short_way_takes_the_same_words(spark, seed):
    rng = random.Random(seed)
    letters = [*"abZ09_ .,:;'\"-!?\n\t\x00\x7f~`[", "é", "ß", "ſ", "ŉ", "×", "÷", "Ŀ", "ǆ", "́", "‍", "­", "​", " ", " ", "’", "·", "א", "ж", "漢", "か", "カ", "ก", "٣", "👩"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(8000)]
    took = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", took(wb.TOKEN).alias("a"), took(WHOLE).alias("b")).collect()
    assert not [r for r in found if r.a != r.b][:5]


def test_usual_text_takes_the_short_way(spark):
    import time

    texts = spark.createDataFrame([("Wings, and the pilot's été of 3.5 bars.\n" * 4000,)] * 4, "t string").cache()
    texts.count()

    def seconds(pattern):
        began = time.perf_counter()
        texts.select(F.sum(F.size(F.regexp_extract_all("t", F.lit(pattern), 0)))).collect()
        return time.perf_counter() - began

    assert min(seconds(wb.TOKEN) for _ in range(3)) < 0.6 * min(seconds(WHOLE) for _ in range(3))
