import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from trackloom.llm import bpe, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "A'S don't 12 ½ x²", "<|endoftext|>x<|startoftext|> <|x", "</w> x</w>y", "a" * 3000, "ΣΑΣ ς İ", "é\xa0é\x85b\x1cb\x0b", "中文 🙂👍 각ㄱ", "\n\t ", "͸ᲊ x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(PATH, 100)


def test_ids_are_the_librarys(library, own):
    rnd = random.Random(1)
    letters = "aaabbbccc eeinnostth'\"<|>/w0129éÉßΣσςİ́̀가각ㄱ中文\n\t\x1c 🙂👍.,!*"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += [f"A{chr(c)}b{chr(c)}{chr(c)} x" for c in [*range(0xD800), *range(0x10000, 0x10400)]]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == e.ids, text
        assert own.decode(own.encode(text)) == library.decode(e.ids, skip_special_tokens=False)


def test_query(spark, library):
    d = f"{DATA}/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = queries.op5_bpe(spark, d).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, library):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*ODD, None])] + [(0, "", 5)], "doc_id long, text string, n_tokens int")
    found = bpe.encode_documents(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted([*range(len(ODD) + 1), 0])
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate([*ODD, None])}
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def check_packing(rows, texts, library, most):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, own in pieces.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // most)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * most and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
        assert sum(r.length for r in own) == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(sequences), -(-sum(r.length for r in rows) // most)


def test_packing_query(spark, library):
    d = f"{DATA}/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    used, least = check_packing(queries.op6_packing(spark, d).collect(), texts, library, packing.LENGTH)
    assert used <= 1.02 * least + 1


def test_packing_odd_rows(spark, library):
    texts = dict(enumerate([None, "", "x", "word " * 50, "word " * 31, "a b c"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = packing.pack(spark, docs, most=16, group_pieces=4).collect()
    check_packing(found, texts, library, 16)
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_sum_of_squares_places():
    p = packing.SumOfSquares(10)
    assert [p.place(s) for s in (7, 7, 6, 3, 4, 3)] == [(0, 0), (1, 0), (2, 0), (1, 7), (2, 6), (0, 7)]


def test_packing_of_long_words_repeated_rows_and_clashing_names(spark, library):
    texts = [(1, "x" * 40_000), (2, "y z"), (2, "y z"), (None, "w"), *[(9, "same words here")] * 500]
    names = ["pack_group", "piece", "length", "sequence_id"]
    docs = spark.createDataFrame([(i, t, *(7 for _ in names)) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    found = packing.pack(spark, docs, most=64, group_pieces=100).collect()
    sizes = {t: len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts}
    assert sum(r.length for r in found) == sum(sizes[t] for _, t in texts)
    assert sum(r.doc_id == 9 for r in found) == 500 * -(-sizes["same words here"] // 64)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and own[-1][0] + own[-1][1] <= 64


def test_long_words_are_not_kept():
    cache = bpe.Words(len, 10)
    long = "w" * 1000
    assert cache[long] == 1000 and cache.many(["a", long], lambda keys: [len(k) for k in keys]) == [1, 1000] and long not in cache and "a" in cache
