"""Words by Unicode's default word boundaries (Annex 29), as regular expressions over property classes that the JVM evaluates.

All repetitions are possessive, which the JVM's matcher runs as loops, so a word of any length needs no stack. A boundary is that of the annex's rules WB1 to WB999;
the characters behind a property are those that the JVM's version of Unicode knows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the annex's word break properties that general categories and scripts don't give.
MID_LETTER = r":··՟״‧︓﹕："
MID_NUM = r",;;։،؍٬߸⁄︐︔﹐﹔，；"
MID_BOTH = r".'‘’․﹒＇．"
MORE_LETTERS = r"˂-˅˒-˗˞˟˥-˫˭˯-˿՚-՜՞֊׳꜈-꜖꜠꜡꞉꞊꭛"
KATAKANA = r"\p{IsKatakana}〱-〵゛゜゠ーｰ"
SPACES = r"\x20  -  -  　"
LINE_ENDS = r"\n\x0B\f\r\x85  "
# Scripts without spaces between words, whose letters have boundaries by dictionary only, and pictographs.
COMPLEX = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsNew_Tai_Lue}\p{IsTai_Le}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}"
PICTOGRAPHS = (
    r"©®‼⁉™ℹ↔-↙↩↪⌚⌛⌨⎈⏏⏩-⏳⏸-⏺Ⓜ▪▫▶◀◻-◾"
    r"☀-★☇-☒☔-⚅⚐-✅✈-✒✔✖✝✡✨✳✴❄❇❌❎❓-❕❗❣-❧"
    r"➕-➗➡➰➿⤴⤵⬅-⬇⬛⬜⭐⭕〰〽㊗㊙\x{1F000}-\x{1F0FF}\x{1F300}-\x{1F3FA}\x{1F400}-\x{1F53D}"
    r"\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}"
)

_GLUED = r"[\p{M}\p{Cf}ﾞﾟ\x{1F3FB}-\x{1F3FF}&&[^​]]"
_X = f"{_GLUED}*+"
_IDEOGRAPHS = r"\p{IsIdeographic}\p{IsHiragana}"
_HEBREW = r"[\p{IsHebrew}&&\p{Lo}]"
_LETTER = rf"[\p{{IsAlphabetic}}{MORE_LETTERS}&&[^{_IDEOGRAPHS}{KATAKANA}{COMPLEX}\p{{M}}ﾞﾟ]]"
_NUMBER = r"[\p{Nd}٫]"
_KANA = f"[{KATAKANA}&&[^\\p{{M}}]]"
_JOINT = r"[\p{Pc} ]"


def _word() -> str:
    """One segment that starts with a letter, number, kana or joining mark: runs of letters and numbers, runs of kana, joining marks between and around them."""
    last_hebrew = rf"{_HEBREW}{_X}'{_X}(?!{_LETTER})"  # a Hebrew letter keeps its mark, which nothing follows
    letters = rf"{_LETTER}++{_X}(?:[{MID_LETTER}{MID_BOTH}]{_X}(?={_LETTER}))?+"
    quoted = rf'{_HEBREW}{_X}"{_X}(?={_HEBREW})'
    numbers = rf"{_NUMBER}++{_X}(?:[{MID_NUM}{MID_BOTH}]{_X}(?={_NUMBER}))?+"
    # a run of letters stops before the last Hebrew one, which may have a mark of its own
    one = rf"(?!{last_hebrew})(?:{quoted}|{numbers}|{_HEBREW}{_X}(?:[{MID_LETTER}{MID_BOTH}]{_X}(?={_LETTER}))?+|{letters.replace(_LETTER + '++', '[' + _LETTER + '&&[^' + _HEBREW + ']]++', 1)})"
    run, kana, joint = f"(?:{one})++", f"(?:{_KANA}++{_X})++", f"(?:{_JOINT}++{_X})++"
    return f"(?=[{_LETTER}{_NUMBER}{_KANA}{_JOINT}])(?:{joint})?+(?:(?:{run}|{kana}){joint})*+(?:{run}(?:{last_hebrew})?+|{last_hebrew}|{kana})?+"


WORD = _word()
#: A picture after a zero-width joiner goes on with the segment.
_JOINED = rf"(?:(?<=‍)(?:(?=[ℹⓂ]){WORD}|[{PICTOGRAPHS}]{_X}))*+"
_FLAG = r"[\x{1F1E6}-\x{1F1FF}]"
SEGMENT = rf"(?s)\r\n|[{LINE_ENDS}]|(?:[{SPACES}]++{_X}|{_FLAG}{_X}(?:{_FLAG}{_X})?+|{WORD}|.{_X}){_JOINED}"
_APART = r"\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F"
#: What ``WORD`` takes of the usual text, told by few and plain classes: Latin letters and digits before an ASCII character, or the end, that no rule joins to them. A mark within words joins only
#: what has a letter or digit behind it.
_USUAL = rf"""[A-Za-z0-9À-ÖØ-öø-ſ]++(?=[.,:;'"]?+(?:[{_APART}]|\z))"""
#: Words as a search engine's standard tokenizer has them: segments with a letter or number, an ideograph or hiragana each, scripts without spaces as runs. No word starts with an ASCII
#: character that stands apart, so the classes of ``WORD`` are asked for what is left by both.
TOKEN = rf"(?![{_APART}])(?:{_USUAL}|{WORD}|[{_IDEOGRAPHS}&&[^\p{{M}}]]{_X}|(?:[{COMPLEX}&&\p{{L}}]{_X})++)"


def segments(text: Column) -> Column:
    """All segments between the boundaries of a text, which together are the text; none for null and the empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEGMENT), 0)


def words(text: Column) -> Column:
    """The segments that hold a letter or number, as they are written; emoji and joining marks alone are none."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), lambda w: w.rlike(r"[\p{IsAlphabetic}\p{Nd}]"))
