"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation becomes one transcript, in which every turn is

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside texts are escaped: a backslash is put between ``<`` and ``|`` (behind those that are there already), and
taken out again when a text is read back. In roles, backslashes and newlines are escaped as well.

Every assistant turn is an example of its own: all turns before it, and the opening of its own, are context, and only its
text is trainable. The operator keeps a conversation once, as segments with a loss flag, since an example is the segments
up to a trainable one: memory grows with a conversation's length, not with its square. ``examples`` explodes them, one row an
assistant turn; a context is written out only where a reader asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
_TAIL = END + "\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its id and segments, an array of (text, loss) whose texts make up the transcript.

    Turns are ordered by turn (nulls first), then role and text, so ties have one order; repeated rows are turns of their
    own; null roles and texts are empty; rows of a null conversation are one conversation; other columns are left
    out. An empty table gives an empty table; a conversation without assistant turns has no trainable segment.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    told = turns.select(F.col(conv_col).alias(conv_col), F.struct(F.col(turn_col).alias("t"), text(role_col).alias("r"), text(text_col).alias("x")).alias("turn"))
    lists = told.groupBy(conv_col).agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def written(turn: Column) -> Column:
        head, body = F.concat(F.lit(START), _role(turn["r"]), F.lit("\n")), escape(turn["x"])
        part = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
        return F.when(turn["r"] == ASSISTANT, F.array(part(head, False), part(body, True), part(F.lit(_TAIL), False))).otherwise(F.array(part(F.concat(head, body, F.lit(_TAIL)), False)))

    return lists.select(conv_col, F.flatten(F.transform("turns", written)).alias("segments"))


def transcript(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a transcript."""
    closed = F.filter(F.split(formatted, END.replace("|", r"\|") + "\n", -1), lambda x: x != "")
    inner = F.transform(closed, lambda x: F.substring(x, len(START) + 1, 2**31 - 1))
    return F.transform(inner, lambda x: F.struct(_role_back(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))


def examples(formatted: DataFrame, *, conv_col: str = "conv_id", context: bool = True) -> DataFrame:
    """One row an assistant turn: conversation, example (its place among the segments), context (if asked for) and target.

    Context and target are as in the transcript; only the target is trainable, and unescaped it is the turn's text.
    """
    each = formatted.select(conv_col, *["segments"][: int(context)], F.posexplode("segments").alias("example", "segment")).where("segment.loss")
    before = [transcript(F.slice("segments", F.lit(1), F.col("example"))).alias("context")] if context else []
    return each.select(conv_col, "example", *before, F.col("segment.text").alias("target"))


def chat_digest(turns: DataFrame) -> DataFrame:
    """One row a conversation, read back from transcripts and examples; see the columns' names.

    Every example's context is made and hashed, one after the other; context_chars sums their lengths, contexts_sha256 is the hash of their hashes.
    """
    formatted = format_conversations(turns)
    told = formatted.select("conv_id", transcript(F.col("segments")).alias("formatted"))
    told = told.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"))
    told = told.select(
        F.col("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        "formatted_chars",
    )
    each = F.struct("example", F.length("context").cast("long").alias("chars"), F.sha2("context", 256).alias("context"), unescape(F.col("target")).alias("text"))
    replies = examples(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    replies = replies.select(
        F.col("conv_id").alias("of"),
        F.array_join(F.transform("all", lambda t: t["text"]), "").alias("loss"),
        F.aggregate("all", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("context_chars"),
        F.array_join(F.transform("all", lambda t: t["context"]), ",").alias("contexts"),
        F.size("all").cast("long").alias("n_examples"),
    )
    joined = told.join(replies, told.conv_id.eqNullSafe(replies.of), "left")
    text, number = lambda c: F.coalesce(c, F.lit("")), lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "conv_id", "n_turns", "turns_sha256", F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars",
        number("n_examples"), number("context_chars"), F.sha2(text("contexts"), 256).alias("contexts_sha256"),
    )
