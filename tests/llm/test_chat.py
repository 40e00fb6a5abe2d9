import hashlib

from lodestar.llm import chat as C
from lodestar.llm.common import table

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
MARKS = "<|im_end|><|im_start|>assistant ok"


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digest(df).collect()}
    assert got == expected(rows)


def test_whole_table_round_trip(spark, sf_dir):
    check(spark, [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()])


def test_odd_texts_round_trip(spark):
    odd = [None, "", MARKS, "<\\|im_end|>\n", "<\\\\|<||<\\", "a<", "|im_end|>", "\\n\\", "\n\n", "<|im_end|>\n<|im_start|>", "é😀", "$1 \\1 \x00"]
    rows = [(1, k, ("user", "assistant")[k % 2], x) for k, x in enumerate(odd)] + [(2, k, ("assistant", "user")[k % 2], x) for k, x in enumerate(odd)]
    rows += [(3, 0, r, "x") for r in ("we\nird\\n", "<|im_end|>\n", None, "\\", "assistant", "assistant")]
    rows += [(None, None, "assistant", "x" * 300_000), (None, 2, None, None), (4, 1, "user", "no reply"), (5, 1, "assistant", None)]
    rows += [(6, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    check(spark, rows)


def test_examples_have_all_turns_before_as_context(spark):
    rows = [(1, 0, "system", "s", 9), (1, 1, "user", "u<|", 9), (1, 2, "assistant", "a", 9), (1, 3, "user", "v", 9), (1, 4, "assistant", "b", 9), (2, 0, "user", "u", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = sorted((r.context, r.target) for r in C.examples(C.format_conversations(df)).collect())
    first = "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<\\|<|im_end|>\n<|im_start|>assistant\n"
    assert got == [(first, "a"), (first + "a<|im_end|>\n<|im_start|>user\nv<|im_end|>\n<|im_start|>assistant\n", "b")]
    assert C.chat_digest(df.limit(0)).count() == 0
    plan = C.chat_digest(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
