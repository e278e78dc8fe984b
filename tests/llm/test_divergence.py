import random
import re
from collections import Counter
from fractions import Fraction

from conftest import DATA
from oracle import connect, same

from trackloom.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    """Every pair over every kept term."""
    counts, docs = {}, {}
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = set()
    for lang, groups in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return [1 + int(Fraction(1_000_000_000 * (count[t] + 5), total)) for t in kept]

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for source in groups:
            far = [(sum(abs(a - b) for a, b in zip(p[source], p[o], strict=True)), o) for o in groups if o != source]
            out_of = [(a - b, t) for a, b, t in zip(p[source], q, kept, strict=True) if groups[source][t] and a > b]
            for part, found in (("pair", far), ("term", out_of)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, source, part, item, value, rank))
    return out


def test_query(spark):
    same(queries.op11_divergence(spark, f"{DATA}/sf0.01"), queries.ORACLES["op11_divergence"], connect(f"{DATA}/sf0.01"))


def test_blocks_and_bounded_tables(spark):
    draw = random.Random(3)
    words = [f"{a}{b}é" for a in "abcdeXYZ" for b in "lmnop"]
    rows = [(" ".join(draw.choices(words[: draw.randint(1, 40)], k=draw.randint(0, 30))), draw.choice(["x", "y", None]), draw.choice([f"s{k}" for k in range(9)])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for block, held in ((2, 50), (64, 1_000)):
        counted = divergence.term_counts(docs, held=held)
        assert counted.groupBy("lang", "source", "term").count().filter("count > 1").count() == 0
        found = divergence.divergence(spark, docs, least_docs=8, top_terms=5, block=block)
        assert {tuple(r) for r in found.collect()} == brute(rows, 8, 5) and found.count() == len(brute(rows, 8, 5))


def test_odd_rows(spark):
    rows = [("a b", None, None), (None, None, None), (None, None, "s"), ("", "de", "s"), ("123 ;", "de", "t"), ("\x00A\x00a", "fr", "s"), ("long" * 50_000, "fr", "t"), ("a", "fr", "u"), ("a", "fr", "u"), ("Ä ä", "it", "one")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, term int, rank string")
    for least in (1, 2, 30):
        found = divergence.divergence(spark, docs, least_docs=least)
        assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "string", "string", "bigint", "int"]
        assert {tuple(r) for r in found.collect()} == brute(rows, least)
    assert divergence.divergence(spark, docs.limit(0)).count() == 0
