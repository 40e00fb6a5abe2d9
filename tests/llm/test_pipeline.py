import hashlib
import math
from collections import Counter

import corpus_pipeline as P
from lodestar.llm import mix, simhash
from lodestar.llm.common import table
from tests.llm import test_decontaminate as contaminated
from tests.llm import test_quality as measured
from tests.llm import test_secrets as found
from tests.llm import test_similar as near


def fill(sizes):
    """Targets by source from plain resharing, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def copies(rows):
    """rows: (doc_id, text, source). Copies of each row, from the rule."""
    size = [len(measured.re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    target = fill(total)
    out = []
    for (i, t, s), _ in zip(rows, size, strict=True):
        rate = target[s] / total[s] if total[s] else 0
        text = "\\N" if t is None else hashlib.md5(t.encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1:{chr(92) + 'N' if i is None else i}:{text}".encode()).hexdigest()[:13], 16) / 16**13
        out.append(math.floor(rate) + (u < rate - math.floor(rate)))
    return out, target, total


def test_run_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect())
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]

    def good(text):
        n, _, _, _, repeats, _ = measured.brute(text)
        return n >= 20 and 100 * repeats <= 30 * n

    docs = [d for d in docs if good(d[1])]
    stay = set(near.kept([d[:2] for d in docs]))
    docs = [d for d in docs if d[0] in stay]
    docs = [d for d in docs if not contaminated.brute(d[1], items)[4]]

    def mask(text):
        out, at = "", 0
        for a, _, b in sorted([*found.base(text), *found.linked(text)]):
            out, at = (out + text[at:a] + "[secret]", b) if a >= at else (out, max(at, b))
        return out + text[at:]

    docs = [(i, mask(t), s) for i, t, s in docs]
    want = Counter({d: n for d, n in zip(docs, copies(docs)[0], strict=True) if n})
    got = P.run(spark, sf_dir)
    assert got.columns == table(spark, sf_dir, "documents").columns
    rows = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_mix_against_brute_force_and_odd_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()]
    want, target, total = copies(rows)
    got = {r.doc_id: r for r in mix.mix_digest(table(spark, sf_dir, "documents")).collect()}
    for (i, _, s), n in zip(rows, want, strict=True):
        assert got[i].taken == got[i].size * n and math.isclose(got[i].target, target[s]) and got[i].source_size == total[s]
    odd = [(1, None, None, 1), (2, "a b", None, 1), (3, "", "empty", 1), (4, "x " * 200_000, "big", 1), (5, "c", "small", 1), (5, "c", "small", 1), (None, "d e", "small", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string, Size int")
    want, target, _ = copies([o[:3] for o in odd])
    mixed = mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == sum((Counter({o: n}) for o, n in zip(odd, want, strict=True)), Counter())
    assert mix.mix_digest(docs.limit(0)).count() == 0 and mix.mix(docs.limit(0)).count() == 0


def test_stages_pass_odd_columns_and_empty_tables(spark, sf_dir):
    good = " ".join(f"word{k}" for k in range(40))
    data = [(1, good, "en", "s", 5, 1), (2, None, None, None, None, None), (3, good + " tail", "en", "s", 5, 2), (None, good[::-1], "en", None, 5, 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, N_Words int")
    for part in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, part, sf_dir)
            assert out.columns == docs.columns, name
            out.collect()
    assert simhash.keep_one(docs).count() <= 4


def test_stages_take_long_empty_and_repeated_rows(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text
    long = " ".join(f"v{k}" for k in range(200_000))
    data = [(1, long, "s"), (1, long, "s"), (2, "", "s"), (3, long + " x", "s"), (4, " ".join(f"u{k}" for k in range(60)) + " " + item, "s"), (5, " ".join(f"z{k}" for k in range(60)) + " password: abcdefgh1", "s"), (5, " ".join(f"z{k}" for k in range(60)) + " password: abcdefgh1", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    stage = dict(P.STAGES)
    out = [sorted((r.doc_id, len(r.text)) for r in stage[n](spark, docs, sf_dir).collect()) for n in ("quality", "near_duplicates", "decontamination", "secrets")]
    size = {d[0]: len(d[1]) for d in data}
    assert out[0] == sorted((d[0], len(d[1])) for d in data if d[1])
    assert out[1] == [(k, size[k]) for k in (1, 2, 4, 5)]
    assert out[2] == sorted((d[0], len(d[1])) for d in data if d[0] != 4)
    masked = size[5] - len("password: abcdefgh1") + len("[secret]")
    assert out[3] == sorted((d[0], masked if d[0] == 5 else len(d[1])) for d in data)
