import hashlib
import random
import re

import pytest
from conftest import DATA

from trackloom.llm import fim, queries

MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, units=r"(?s)."):
    """By code points (or the spans that a pattern gives), as the contract says."""
    text = text or ""
    starts = [m.start() for m in re.finditer(units, text)] + [len(text)]
    n = len(starts) - 1
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or any(m in text for m in MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: starts[a]], text[starts[a] : starts[b]], text[starts[b] :]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()}
    found = queries.op13_fim(spark, f"{DATA}/{sf}").collect()
    assert len(found) == len(texts) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert tuple(r)[1:] == brute(r.doc_id, texts[r.doc_id])


def texts(draw):
    some = ["", "a", "<P", "a<S>", "<" * 70, "<<P>", "é" * 100, "😀\n" * 40, "<M" + "x" * 61 + "<M>", " a  b\n\nc "]
    alphabets = ["ab <P\n", "é😀a", "<PSM>", "a"]
    return some + ["".join(draw.choices(draw.choice(alphabets), k=draw.choice([3, 63, 64, 65, 200, 4_095, 4_097, 9_000]))) for _ in range(60)]


@pytest.mark.parametrize("units", ["codepoints", "words", "lines"])
def test_functions_compose(units):
    draw, machine = random.Random(5), fim.automaton(units)
    found = [t.encode() for t in texts(draw)]
    scan = fim.Scan(found, units)
    for k, text in enumerate(found):
        states, counts = scan.function(k)
        for start in range(machine.states):
            state, n, begins = start, 0, []
            for at, byte in enumerate(text):
                c = machine.kind[byte]
                if machine.ends[state, c]:
                    begins.append(at)
                n, state = n + int(machine.ends[state, c]), int(machine.step[state, c])
            assert (states[start], counts[start]) == (state, n) == scan.run(k, start)
            for unit in {0, n // 2, max(n - 1, 0), n}:
                assert scan.place(k, unit, start) == (begins[unit] if unit < n else len(text))
        assert machine.marked[scan.run(k)[0]] == any(m.encode() in text for m in MARKS)


@pytest.mark.parametrize(("units", "pattern"), [("codepoints", r"(?s)."), ("words", r"[^\x20\x09-\x0D]+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_chunks_of_giant_texts(spark, units, pattern):
    """Texts of all sizes in chunks of 16 bytes: characters, marks and units lie across their borders."""
    rows = list(enumerate(texts(random.Random(9))))
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")
    found = [tuple(r) for r in fim.digests(spark, docs, units=units, chunk=16).collect()]
    assert sorted(found, key=str) == sorted([(i, *brute(i, t, pattern)) for i, t in rows + rows[:20]], key=str)


def test_outputs(spark):
    rows = [(i, f"text number {i} é <x> {'y' * i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = fim.transform_short(docs).withColumn("again", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert {r.doc_id: r.again for r in short} == dict(rows)
    pieces = fim.transform_giant(spark, docs, chunk=10).withColumn("place", fim.in_output()).orderBy("row", "place", "chunk").collect()
    outputs = {}
    for r in pieces:
        outputs[r.doc_id] = outputs.get(r.doc_id, b"") + bytes(r.bytes)
    assert {i: o.decode() for i, o in outputs.items()} == {r.doc_id: r.output for r in short}


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "abc"), (None, None), (7, "x" * 200_000), (7, "x" * 200_000), (8, "ab<P>"), (9, "é" * 65_535 + "<M>"), (10, "a" * 65_535 + "<M>" + "b")]
    docs = spark.createDataFrame([(*r, "f", 3) for r in rows], "doc_id long, text string, form string, chunk int")
    found = fim.digests(spark, docs)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(i, *brute(i, t)) for i, t in rows], key=str)
    assert fim.digests(spark, docs.limit(0)).count() == 0
