import binascii
import hashlib
import math

import numpy as np

from lodestar.llm import langid as L
from lodestar.llm.common import table


def plain_kneser_ney(counts, order=L.ORDER):
    """Probabilities of n-grams (strings) of one language, straight from the definition."""
    tables = [counts]
    for n in range(order - 1, 0, -1):
        lower = {}
        for g in tables[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        tables.append(lower)

    def prob(gram, alphabet):
        if not gram:
            return 1 / alphabet
        t = tables[order - len(gram)]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        after = [v for g, v in t.items() if g[:-1] == gram[:-1]]
        if not after:
            return prob(gram[1:], alphabet)
        return max(t.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * prob(gram[1:], alphabet)

    return prob


def test_probabilities_follow_the_definition_and_sum_to_one():
    texts = {"a": "abab abba ab baab", "b": "cabc acb cca bcc"}
    counts, plain = {}, {}
    for lang, text in texts.items():
        keys, times = np.unique(L.ngram_keys(L.codes_of(text)), return_counts=True)
        counts[lang] = (keys, times)
        padded = "   " + text
        grams = [padded[i : i + 4] for i in range(len(text))]
        plain[lang] = plain_kneser_ney({g: grams.count(g) for g in set(grams)})
    model = L.kneser_ney(counts)
    alphabet = "abc "
    for context in ("aba", "zzz", "cab", "   ", "bcc"):
        p = model.prob(np.array([L.ngram_keys(L.codes_of(context + "x"))[-1] & ~np.uint64(0xFFFF) | np.uint64(ord(c)) for c in alphabet], np.uint64))
        for k, lang in enumerate(model.langs):
            assert np.allclose(p[:, k], [plain[lang](context + c, 5) for c in alphabet], rtol=1e-4)
            assert p[:, k].sum() < 1.0001


def test_held_out_accuracy_on_the_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.language_digest(docs).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(test) > 20 and sum(r.lang_pred == langs[r.doc_id] for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    again = L.language_digest(docs.repartition(5)).collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in rows}


def test_odd_texts_and_rejection(spark, sf_dir):
    model = L.train(table(spark, sf_dir, "documents"))
    data = [(1, None), (2, ""), (3, "123 ... !!"), (4, "the that of and " * 60000), (4, "É"), (None, "und die der"), (6, "\U0001d400\U0001d401 中文中文中文中文中文中文中文"), (7, "zzqx xqzz wwkq qqqq kkkk " * 20)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, Score double")
    rows = L.identify(docs, model).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert {r.doc_id for r in rows if r.rejected} >= {1, 2, 3, 6, 7} and not any(r.rejected for r in rows if r.text and r.text.startswith("the"))
    assert L.identify(docs.limit(0), model).count() == 0
    assert L.language_digest(table(spark, sf_dir, "documents").limit(0)).count() == 0


def plain_model(texts_by_lang):
    """cost(text) -> cross-entropies by language, from dictionaries."""
    def clean(text):
        out = []
        for c in text.lower():
            c = c if c.isalpha() else " "
            if c != " " or not out or out[-1] != " ":
                out.append(c)
        return "".join(out)

    langs, alphabet, tables = sorted(texts_by_lang), set(), {}
    for lang in langs:
        top = {}
        for t in map(clean, texts_by_lang[lang]):
            alphabet |= set(t)
            padded = "   " + t
            for i in range(len(t)):
                top[padded[i : i + 4]] = top.get(padded[i : i + 4], 0) + 1
        levels = [top]
        for _ in range(3):
            lower = {}
            for g in levels[-1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            levels.append(lower)
        made = []
        for t in levels:
            once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
            total, kinds = {}, {}
            for g, v in t.items():
                total[g[:-1]] = total.get(g[:-1], 0) + v
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            made.append((t, total, kinds, min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))))
        tables[lang] = made
    size, known = len(alphabet) + 1, {}

    def prob(lang, gram):
        if not gram:
            return 1 / size
        if (lang, gram) not in known:
            t, total, kinds, d = tables[lang][4 - len(gram)]
            n, lower = total.get(gram[:-1]), prob(lang, gram[1:])
            known[lang, gram] = lower if n is None else max(t.get(gram, 0) - d, 0) / n + d * kinds[gram[:-1]] / n * lower
        return known[lang, gram]

    def cost(text):
        t = clean(text)
        padded = "   " + t
        return [-sum(math.log(prob(lang, padded[i : i + 4])) for i in range(len(t))) / len(t) for lang in langs]

    return langs, cost


def test_whole_query_against_brute_force(spark, sf_dir):
    """On every fourth document, whole texts: a small table of its own, not a part of the query."""
    docs = [(r.doc_id, r.lang, r.text) for r in table(spark, sf_dir, "documents").collect() if r.doc_id % 4 == 0]
    got = {r.doc_id: r for r in L.language_digest(spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()}
    out = {i for i, _, _ in docs if binascii.crc32(str(i).encode()) % 3 == 1}
    seen = [d for d in docs if d[0] not in out and d[1] is not None and d[2] is not None]
    unit = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13
    fold = {d[0]: int(unit("langid-fold", d[0], hashlib.md5(d[2].encode()).hexdigest()) * L.FOLDS) for d in seen}
    by = lambda some: {lang: [d[2] for d in some if d[1] == lang] for lang in {d[1] for d in some}}
    langs, cost = plain_model(by(seen))
    costs, losses = {lang: [] for lang in langs}, [0.0] * len(L.TEMPERATURES)
    for k in range(L.FOLDS):
        names, held = plain_model(by([d for d in seen if fold[d[0]] != k]))
        for d in seen:
            if fold[d[0]] == k and d[1] in names and any(c.isalpha() for c in d[2]):
                row, mine = held(d[2]), names.index(d[1])
                costs[d[1]].append(row[mine])
                for t, temp in enumerate(L.TEMPERATURES):
                    losses[t] += math.log(sum(math.exp(-temp * (x - row[mine])) for x in row))
    temp = L.TEMPERATURES[losses.index(min(losses))]
    limit = {lang: sum(c) / len(c) + L.REJECT_SIGMAS * max(0.05, (sum((x - sum(c) / len(c)) ** 2 for x in c) / len(c)) ** 0.5) if c else math.inf for lang, c in costs.items()}
    for i, _, text in docs:
        r = got[i]
        assert r.held_out == (i in out)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        row = cost(text)
        best = row.index(min(row))
        assert r.lang_pred == langs[best] and abs(r.score - 1 / sum(math.exp(-temp * (x - row[best])) for x in row)) < 1e-3
        assert r.rejected == (row[best] > limit[langs[best]]) or abs(row[best] - limit[langs[best]]) < 1e-3


def test_calibration_on_held_out_documents(spark, sf_dir):
    rows = L.calibration(table(spark, sf_dir, "documents")).collect()
    assert rows and all(r.error < 0.1 and r.accuracy > 0.9 for r in rows if r.n >= 10)
