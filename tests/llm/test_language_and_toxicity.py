import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from trackloom.llm import language, queries, toxicity


def test_held_out_languages(spark):
    d = f"{DATA}/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = queries.op7_language(spark, d).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.98


def brute_languages(rows, parts=4, held=2):
    """(lang_pred, score) of (doc_id, text, lang) rows by plain dictionaries, without a core."""
    split = lambda t: [w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w]
    out_of_fold = [r for r in rows if r[2] is not None and (r[0] is None or zlib.crc32(str(r[0]).encode()) % parts != held)]
    words = {}
    for _, text, lang in out_of_fold:
        for w in split(text):
            words.setdefault(lang, Counter())[w] += 1
    langs = sorted(words)
    grams = [{lang: Counter() for lang in langs} for _ in range(5)]
    for lang in langs:
        for w, n in words[lang].items():
            for k in range(1, 5):
                for g in language.grams_of(w, k):
                    grams[k][lang][g] += n

    sums = {id(t): [sum(t[x].values()) for x in langs] for t in (words, *grams[1:])}

    def excess(tables, w):
        total = sums[id(tables)]
        return np.array([np.log1p(tables[x][w] * (max(total) + language.DAMP) / language.SMOOTH / (t + language.DAMP)) for x, t in zip(langs, total, strict=True)])

    @lru_cache(None)
    def of_word(w):
        if any(w in words[x] for x in langs):
            return excess(words, w)
        for k in range(4, 0, -1):
            own = [g for g in language.grams_of(w, k) if any(g in grams[k][x] for x in langs)]
            if own:
                return np.mean([excess(grams[k], g) for g in own], axis=0) * language.GRAM_WEIGHT
        return np.zeros(len(langs))

    out = []
    for _, text, _ in rows:
        found = split(text)
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        total = sum((of_word(w) for w in found), np.zeros(len(langs)))
        odds = np.exp(total - total.max())
        out.append((langs[int(odds.argmax())], float((odds / odds.sum()).max())))
    return out


def test_predictions_against_brute_force(spark):
    rnd = random.Random(4)
    stems = {"aa": "ka lo mi ta".split(), "bb": "ka ru sel dom".split(), "cc": "\u043c\u0438 lo pra sel".split()}
    word = lambda lang: "".join(rnd.choice(stems[lang]) for _ in range(rnd.choice([1, 2, 2, 3, 4])))
    rows = [(i, " ".join(word(lang) for _ in range(rnd.choice([1, 2, 3, 8, 30, 200]))), lang if i % 9 else None) for i in range(300) for lang in [rnd.choices("aa bb cc".split(), [20, 5, 1])[0]]]
    rows += [(900, "kal om zzz qqq", None), (901, "12 - !", "aa"), (902, "\u4e00\u4e8c", None), (None, "sel sel dom", "bb"), (5, "ru", "bb")]
    want = Counter((r[0], p, round(s, 7)) for r, (p, s) in zip(rows, brute_languages(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for core in (1 << 18, 20, 0):
        assert Counter((r.doc_id, r.lang_pred, round(r.score, 7)) for r in language.identify(spark, docs, core=core).collect()) == want


def test_gram_counts():
    words = ["a", "ab", "abca", "\u4e00\u4e8c", "\U0001f600x"]
    n = np.array([1, 2, 3, 4, 5])
    want = Counter()
    for w, times in zip(words, n.tolist(), strict=True):
        for k in range(1, 5):
            for g in language.grams_of(w, k):
                want[g] += times
    found = Counter()
    for grams, total in language.gram_counts(words, n):
        found.update(dict(zip(grams, total.tolist(), strict=True)))
    assert found == want


def test_many_equally_rare_words(spark):
    # No prefix of a language's words is more frequent than the rest; nothing is cut.
    spell = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    rows = [(i, " ".join("x" + spell(40 * i + j) for j in range(40)), "x") for i in range(800)] + [(800 + i, " ".join("y" + spell(40 * i + j) for j in range(40)), "y") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(spark, docs, core=100).collect()
    assert all(r.lang_pred == ("x" if r.doc_id < 800 else "y") for r in found)


def test_languages_of_odd_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr") for i in range(40)]
    odd = [(100, None, None), (101, "", "en"), (102, "12 ... 3", None), (103, "THE DOG", None), (None, "chien", None), (104, "the " * 60_000, None), (105, "qqqq", None)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    found = {r.doc_id: r for r in language.identify(spark, docs).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "en", "fr", "en"]
    assert found[100].score == 0 and found[None].held_out is False and found[105].lang_pred in ("en", "fr")
    blank = language.identify(spark, docs.filter("doc_id = 103")).collect()
    assert [r.lang_pred for r in blank] == ["und"]  # nothing to learn from
    assert language.identify(spark, docs.limit(0)).count() == 0


def test_keep_known_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "s", 7), (2, "...", "en", "s", 3), (3, "dog", None, "s", 3), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = language.keep_known(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "the cat"), (3, "dog")]
    assert sorted(r.doc_id for r in language.keep_known(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()) == [1, 3]  # nothing to learn from


def test_held_out_toxicity(spark):
    d = f"{DATA}/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = [r for r in queries.op10_toxicity(spark, d).collect()]
    assert len(found) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id in toxic]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits / sum(toxic[r.doc_id] for r in held) >= 0.8 and hits / sum(r.predicted for r in held) >= 0.95


def test_risk_falls_and_negatives_stay_low():
    rng = np.random.default_rng(0)
    pos = (rng.random((300, 5)) < [0.6, 0.6, 0.1, 0.1, 0.1]).astype(np.float32)
    neg = (rng.random((1800, 5)) < [0.02, 0.02, 0.1, 0.1, 0.1]).astype(np.float32)
    hidden = (rng.random((200, 5)) < [0.6, 0.6, 0.1, 0.1, 0.1]).astype(np.float32)
    unlabelled = np.concatenate([neg, hidden])
    w, b = toxicity.fit_nnpu(pos, unlabelled, 0.1)
    assert w[:2].min() > 1 and abs(w[2:]).max() < 1
    cut = toxicity.best_cut(pos @ w + b, unlabelled @ w + b, 0.1)
    # Any of the two words is likelier a positive's: 84 % of positives and 4 % of negatives have one.
    assert ((neg @ w + b) > cut).mean() < 0.06 < 0.75 < ((hidden @ w + b) > cut).mean()


def test_the_fit_makes_the_result():
    """Without a step there is no classifier; with steps, held-out texts are told apart."""
    rng = np.random.default_rng(2)
    made = lambda n, toxic: [np.flatnonzero(rng.random(300) < np.where(np.arange(300) < 12, 0.25 if toxic else 0.01, 0.1)) for _ in range(n)]
    pos, unl, held = made(250, True), made(1800, False) + made(200, True), (made(900, False), made(100, True))
    cut = lambda model: [(model.scores(toxicity._matrix(x, model.codes) @ model.weights) >= toxicity.THRESHOLD).mean() for x in held]
    blank, fitted = (toxicity.fit(pos, unl, 0.1, steps) for steps in (0, toxicity.STEPS))
    assert not blank.weights.any() and len(set(cut(blank))) == 1
    low, high = cut(fitted)
    assert low < 0.03 and high > 0.75


def test_the_rest_is_kept_from_going_below_zero():
    """Few positives and many words: the plain corrected risk runs below zero, the non-negative one stays and does better."""
    rng = np.random.default_rng(5)
    made = lambda n, p: (rng.random((n, 120)) < np.where(np.arange(120) < 8, p, 0.2)).astype(np.float32)
    pos, unl = made(40, 0.6), np.concatenate([made(240, 0.1), made(60, 0.6)])
    held = np.concatenate([made(1600, 0.1), made(400, 0.6)])
    truth = np.arange(2000) >= 1600

    def rest_and_error(non_negative):
        w, b = toxicity.fit_nnpu(pos, unl, 0.2, 400, 0, non_negative)
        loss = lambda x: np.logaddexp(0, x @ w + b).mean()
        return loss(unl) - 0.2 * loss(pos), ((held @ w + b > 0) != truth).mean()

    (rest, error), (plain_rest, plain_error) = rest_and_error(True), rest_and_error(False)
    assert plain_rest < -0.1 < rest and error < plain_error


def test_toxicity_of_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(30)) + (" vile" if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, (1000, None), (1001, ""), (1002, "vile " * 30_000), (None, "vile")]], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(300)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(spark, docs, labels).collect()}
    assert [found[i].predicted for i in (0, 1, 4, 1000, 1001, 1002, None)] == [1, 0, 1, 0, 0, 1, 1] and found[None].held_out is False
    none = toxicity.toxicity(spark, docs, labels.filter("toxic = 0")).collect()
    assert len(none) == 304 and all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0
