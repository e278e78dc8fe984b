import re

import pytest
from conftest import DATA

from trackloom.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def pattern(template):
    """The same template as a backtracking pattern over words in single spaces."""
    out, at = "", 0
    for m in [*licenses.MARK.finditer(template), None]:
        out += "".join(" " + ("licen[cs]e" if w == "license" else "licen[cs]ed" if w == "licensed" else re.escape(w)) for w in words(template[at : m.start() if m else None]))
        if m is None:
            return re.compile(out + "(?= )")
        at, bound = m.end(), licenses.ANY.match(m[2] or "")
        if m[1]:
            out += "(?:" if m[1] == "beginOptional" else ")?"
        else:
            out += "(?: [^ ]+)*?" if bound else "(?:" + "|".join("".join(" " + w for w in words(c)) for c in m[2].split("|")) + ")"


def brute(text):
    found = words(text)
    starts = [(k, label) for phrase, label in PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
    joined = "".join(" " + w for w in found) + " "
    own = {label for label, t in licenses.TEMPLATES.items() if pattern(t).search(joined)}
    base = {label for _, label in starts}
    places = [k for k, _ in starts]
    return len(found), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()}
    found = queries.op12_licenses(spark, f"{DATA}/{sf}").collect()
    assert len(found) == len(texts) and any("-" in r.labels for r in found)
    for r in found:
        assert tuple(r)[1:7] == brute(texts[r.doc_id]) and 0 <= r.score <= 1


def filled(template, region="THE AUTHORS OR COPYRIGHT HOLDERS"):
    """A text of the template: optional regions left out, the first of the alternatives."""
    without = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template, flags=re.S)
    return licenses.MARK.sub(lambda m: region if licenses.ANY.match(m[2]) else m[2].split("|")[0], without)


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates(label):
    scanner = licenses.Scanner({label: licenses.TEMPLATES[label]})

    def run(text):
        found = licenses.words_of(text.encode())
        return scanner.scan(found, b" " + b" ".join(found) + b" ")

    text = filled(licenses.TEMPLATES[label])
    body = words(text)
    places, score = run(f"a b, {text}! c {text.title()}")
    assert score == 1 and any(e - s == len(body) and s == 2 for s, e in places[label]) and len({s for s, _ in places[label]}) == 2
    optional = licenses.MARK.sub(lambda m: "" if m[1] else "x" if licenses.ANY.match(m[2]) else m[2].split("|")[-1], licenses.TEMPLATES[label])
    assert run(optional.replace("licensed", "licenced"))[1] == 1
    for k in range(len(body)):  # a mandatory word that is missing or another
        other = " ".join([*body[:k], "zzz", *body[k + 1 :]])
        if not pattern(licenses.TEMPLATES[label]).search(f" {other} "):
            assert not run(other)[0] and run(other)[1] < 1


def test_replaceable_regions_are_bounded():
    scanner = licenses.Scanner({"t": 'one two <<var;match=".{0,10}">> three <<beginOptional>>four <<var;match="x y|z">> <<beginOptional>>five<<endOptional>><<endOptional>> six'})
    good = ["one two three six", "one two a b c d e three six", "one two abcdefghi three six", "one two three four x y six", "one two three four z five six", "one two one two three six", "one two " * 50 + "three six"]
    bad = ["one two abcdefghij three six", "one two a b c d e f three six", "one two three four six", "one two three four x six", "one two three five six", "one two three", "two three six"]
    for text in good + bad:
        found = text.encode().split()
        places, score = scanner.scan(found, b" " + b" ".join(found) + b" ")
        assert (places != {}) == (text in good) and (score == 1) == (text in good)
    for broken in ("<<beginOptional>>a", '<<var;match="a|b">>'):
        with pytest.raises(ValueError):
            licenses.compiled("t", broken)


def test_odd_rows(spark):
    texts = dict(enumerate([None, "", " ;", "MIT License mit license MIT\tLICENSE", "cc-by cc by by", "GNU General Public Licence", "ſ É mit-license", "released under the mit license " * 20_000, "x" * 300_000 + " Apache License", "Released under the MIT License."]))
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t in texts.items()] + [(None, "CC BY 4.0", "c", 1.0)], "doc_id long, text string, labels string, score double")
    found = {r.doc_id: r for r in licenses.scan(docs, spans=True).collect()}
    for i, t in texts.items():
        assert tuple(found[i])[1:7] == brute(t)
    assert found[None].labels == "cc-by,cc-by-notice" and found[0].score == 0 and found[8].score == 0.5 and found[9].score == 1
    assert found[9].spans[0].asDict() == {"label": "mit-notice", "first_word": 0, "end_word": 5} and licenses.scan(docs.limit(0)).count() == 0
    other = licenses.scan(docs, templates={"own": "apache license"}, phrases={"by by": "b"}).filter("labels <> ''").collect()
    assert sorted((r.doc_id, r.labels) for r in other) == [(4, "b"), (8, "own")]
