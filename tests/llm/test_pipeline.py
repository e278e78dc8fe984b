import re

import public_tokenizers
from conftest import DATA
from test_bpe_and_packing import check_packing
from test_language_and_toxicity import brute_languages
from test_secrets_and_html import brute as brute_spans
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from trackloom.llm import secrets


def brute_stages(docs):
    """The documents after each filtering stage, by plain loops."""
    found = brute_languages([(r["doc_id"], r["text"], r["lang"]) for r in docs])
    docs = [r for r, (lang, score) in zip(docs, found, strict=True) if lang != "und" and score >= 0.5]
    yield docs
    groups = {}
    for r in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(r)
    docs = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]
    yield docs
    root = brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs])
    docs = [r for r in docs if root[r["doc_id"]] == r["doc_id"]]
    yield docs


def test_stages_against_brute_force(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = brute_stages([r.asDict() for r in docs.collect()])
    current = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], want, strict=False):
        current = corpus_pipeline.stored(spark, stage(spark, current, d), name)
        assert current.columns == docs.columns
        assert sorted(r.doc_id for r in current.collect()) == sorted(r["doc_id"] for r in expected), name
    before = {r.doc_id: r for r in current.collect()}
    masked = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, current, d).collect()}
    assert set(masked) == set(before)
    for i, r in masked.items():
        if not brute_spans(before[i].text):
            assert r == before[i]
        else:
            assert not brute_spans(r.text) and r.n_chars == len(r.text) and "[secret]" in r.text
    packed = corpus_pipeline.run(spark, d).collect()
    check_packing(packed, {i: r.text for i, r in masked.items()}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 2048)
    assert {r.doc_id for r in packed} == set(masked)


def test_repeated_and_odd_rows(spark):
    rows = [(1, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (2, "same  text", "en", "s", 10), (3, None, None, None, 0), (4, "...", "en", "s", 3), (None, "other words here", "en", "s", 16), (1, "different content of one", "en", "s", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(spark, stage(spark, docs, ""), "t")
    assert sorted((r.doc_id or -1, r.text) for r in docs.collect()) == [(-1, "other words here"), (1, "different content of one"), (2, "same  text")]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_no_languages_long_texts_and_clashing_names(spark):
    names = ["word", "sums", "slice", "print", "digest", "component_id", "a", "rank"]
    rows = [(1, "alpha beta gamma", None), (2, "...", None), (3, None, None), (4, "long " * 200_000 + "end", None), (5, "long " * 200_000 + "end", None), (6, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *("x" for _ in names)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(spark, stage(spark, docs, ""), "t")
        assert docs.columns[5:] == names
    assert sorted(r.doc_id for r in docs.collect()) == [1, 4]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 4} and sum(r.length for r in packed if r.doc_id == 4) > 200_000


def test_mask_of_touching_spans():
    assert secrets.masked("abcdefgh", [(1, 3, "hex"), (2, 5, "assign"), (6, 7, "hex")], "#") == "a#f#h"


def test_rows_are_told_apart_by_their_texts(spark):
    texts = [(None, "alpha beta gamma delta one"), (None, "a river runs through the old town"), (None, "seven small ships sailed at dawn"), (4, "first text of the repeated name"), (4, "quite other words stand under it"), (9, "clean and alone in this table")]
    docs = spark.createDataFrame([*texts, (9, "clean and  alone in this table"), (None, "clean  and alone in this table")], "doc_id long, text string")
    found = [(r.doc_id, " ".join(r.text.split())) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(found, key=str) == sorted(texts, key=str)
