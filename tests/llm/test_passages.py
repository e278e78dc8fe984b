import random

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import passages


def test_windows_hold_every_run_once():
    rng = np.random.default_rng(0)
    for n, most, span in ((200, 1 << 60, 10), (150, 12, 10), (60, 1 << 60, 7), (9, 99, 10), (40, 9, 1)):
        v = rng.integers(8, most, n).astype(np.uint64)
        v[n // 2] = v[-1] = 0
        covered = {}
        for a, b, c in zip(*passages.compact_windows(v, span), strict=True):
            for i in range(a, b + 1):
                for j in range(max(b, i + span - 1), c + 1):
                    assert (i, j) not in covered
                    covered[i, j] = b
        assert covered == {(i, j): i + int(np.argmin(v[i : j + 1])) for i in range(n) for j in range(i + span - 1, n) if not (v[i : j + 1] == 0).any()}


def test_shingles_stay_within_texts():
    texts = ["a b c d e f", "", "A  B\tc d e", None, "a b c d"]
    hashes, counts = passages.shingles(pa.array(texts))
    assert counts.tolist() == [2, 0, 1, 0, 0] and hashes[0] == hashes[2]


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def roots(pairs):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in list(up)}


def test_planted_passages_are_found(spark):
    rnd = random.Random(11)
    docs = {i: words(rnd, rnd.randint(20, 600)) for i in range(120)}
    planted = []
    for k in range(15):
        passage = words(rnd, rnd.choice([51, 60, 90, 200]))
        own = rnd.sample(range(100), rnd.choice([2, 3]))
        planted.append(own)
        for j, i in enumerate(own):
            copy = list(passage)
            if j and k % 3 == 0 and len(copy) >= 90:
                copy[len(copy) // 2] = "edited"
            at = rnd.choice([0, len(docs[i])])  # never inside another planted passage
            docs[i][at:at] = copy
    common = words(rnd, 70)
    for i in range(100, 120):  # one passage in many documents
        docs[i] += common
    short = words(rnd, 20)
    for i in range(0, 120, 7):  # a repeated line is no passage
        docs[i] += short
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in docs.items()], "doc_id long, text string, lo int")
    found = passages.repeated_passages(spark, df).collect()
    root = roots([(r.doc_id, r.rep_doc_id) for r in found])
    for own in [*planted, list(range(100, 120))]:
        assert len({root.get(i, ("none", i)) for i in own}) == 1
    clean = set(range(100)) - {i for own in planted for i in own}
    assert not clean & {i for r in found for i in (r.doc_id, r.rep_doc_id)}
    for r in found:
        assert set(docs[r.doc_id][r.start_word : r.end_word]) & set(docs[r.rep_doc_id][r.rep_start_word : r.rep_end_word])


def test_odd_rows(spark):
    text = " ".join(words(random.Random(1), 80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "one two")], "doc_id long, text string")
    found = {(r.doc_id, r.rep_doc_id) for r in passages.repeated_passages(spark, docs).collect()}
    assert found == {(2, 1)}
    assert passages.repeated_passages(spark, docs.limit(0)).count() == 0


def test_exact_repeats_behind_a_variant(spark):
    rnd = random.Random(5)
    docs, wanted = {}, []
    for k in range(40):
        passage = words(rnd, 50)
        variant = list(passage)
        for i in (14, 35) if k % 2 else (24,):  # 36 or 41 of 46 shingles stay
            variant[i] = "edited"
        for j, body in enumerate((variant, passage, passage)):
            docs[10 * k + j] = [*words(rnd, 30), *body, *words(rnd, 30)]
        wanted.append((10 * k + 2, 10 * k + 1))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {(r.doc_id, r.rep_doc_id): r for r in passages.repeated_passages(spark, df).collect()}
    for pair in wanted:
        assert pair in found and found[pair].similarity == 1 and found[pair].start_word <= 30 and found[pair].end_word >= 80


def test_each_stretch_of_a_chain_is_verified(spark):
    rnd = random.Random(6)
    docs, edges = {}, 60
    for k in range(20):
        text = words(rnd, 2 * edges + 150)
        other = [w if i < edges or i >= edges + 150 or i % 8 else "edited" for i, w in enumerate(text)]
        docs[2 * k], docs[2 * k + 1] = text, other
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = passages.repeated_passages(spark, df).collect()
    for k in range(20):
        own = sorted((r.start_word, r.end_word) for r in found if r.doc_id == 2 * k + 1)
        assert len(own) == 2 and own[0][0] == 0 and edges <= own[0][1] <= edges + 12 and edges + 138 <= own[1][0] <= edges + 150 and own[1][1] == 2 * edges + 150


def brute_pairs(docs):
    """(later, earlier) documents with runs of 50 words whose shingle sets reach the similarity, by plain loops over all runs."""
    runs = {}
    for i, w in docs.items():
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        runs[i] = [frozenset(s[k : k + 46]) for k in range(len(s) - 45)]
    grams = {i: set().union(*r) if r else set() for i, r in runs.items()}
    found = set()
    for i in docs:
        for j in docs:
            if j < i and len(grams[i] & grams[j]) >= 41 and any(len(a & b) / len(a | b) >= 0.8 for a in runs[i] for b in runs[j]):
                found.add((i, j))
    return found


def test_links_and_places_against_brute_force(spark):
    rnd = random.Random(8)
    docs = {}
    for k in range(25):
        passage = words(rnd, rnd.choice([50, 51, 56, 64]))
        place = rnd.randrange(7)  # the original may be any of them
        for j in range(7):
            body = list(passage)
            if j != place:
                body[rnd.randrange(len(body))] = f"edit{j}"
                if j % 3 == 0:
                    body.insert(rnd.randrange(len(body)), "more")
            docs[100 * k + j] = [*words(rnd, 20), *body, *words(rnd, 15)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = passages.repeated_passages(spark, df).collect()
    want, have = brute_pairs(docs), {(r.doc_id, r.rep_doc_id) for r in found}
    assert len(want) > 100 and have <= want and len(want - have) <= 0.01 * len(want)
    for r in found:
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.rep_doc_id][r.rep_start_word : r.rep_end_word]
        assert a[:5] == b[:5] and a[-5:] == b[-5:] and len(a) >= 45


def test_verbatim_passages_have_exact_places(spark):
    rnd = random.Random(9)
    docs, passage = {}, words(rnd, 60)
    for i in range(4):
        docs[i] = [*words(rnd, 60 + i), *passage, *words(rnd, 60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = passages.repeated_passages(spark, df).collect()
    assert {(r.doc_id, r.rep_doc_id) for r in found} == {(i, j) for i in range(4) for j in range(i)}
    for r in found:
        assert (r.start_word, r.end_word, r.rep_start_word, r.rep_end_word, r.similarity) == (60 + r.doc_id, 120 + r.doc_id, 60 + r.rep_doc_id, 120 + r.rep_doc_id, 1)


def test_passages_of_crowded_signatures(spark):
    # A hundred documents quote the halves of passages that later ones have whole, each in other surroundings.
    rnd = random.Random(10)
    docs, halves = {}, [words(rnd, 30) for _ in range(4)]
    for i in range(120):
        docs[i] = [*words(rnd, 30), *halves[i % 4], *words(rnd, 30)]
    for i in range(120, 124):
        docs[i] = [*words(rnd, 30), *halves[0], *halves[1], *words(rnd, 30)]
    for i in range(124, 170):
        docs[i] = [*words(rnd, 30), *halves[2], *halves[3], *words(rnd, 30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = passages.repeated_passages(spark, df).collect()
    assert {r.doc_id for r in found} == {*range(121, 124), *range(125, 170)}
    for i in {r.doc_id for r in found}:
        own = [r for r in found if r.doc_id == i]
        assert min(r.start_word for r in own) <= 35 and max(r.end_word for r in own) >= 85
        assert all(docs[i][r.start_word : r.end_word] == docs[r.rep_doc_id][r.rep_start_word : r.rep_end_word] for r in own)


def test_odd_texts_and_columns(spark):
    rnd = random.Random(12)
    own, long = words(rnd, 70), words(rnd, 60_000)
    rows = [(1, " ".join(own)), (2, "x " * 300), (3, "x " * 400), (4, " ".join([*long, *own])), (5, " ".join(long)), (6, " ".join(words(rnd, 90))), (6, " ".join(own))]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, doc int, sign string")
    found = {(r.doc_id, r.rep_doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(spark, docs).collect()}
    assert {f[:2] for f in found} == {(3, 2), (4, 1), (5, 4), (6, 1)}  # equal passages are linked to the first
    assert (5, 4, 0, 60_000) in found and (4, 1, 60_000, 60_070) in found


@pytest.mark.parametrize(("groups", "copies", "edits"), [(20, 12, 3), (2, 120, 3), (1, 240, 4)])
def test_near_variants_of_crowded_signatures(spark, groups, copies, edits):
    # One passage in many variants, the unchanged one in the middle, held against all pairs of runs.
    rnd = random.Random(copies)
    docs, variants = {}, {}
    for g in range(groups):
        passage = words(rnd, 60)
        for i in range(copies):
            own = list(passage)
            for at in rnd.sample(range(60), 0 if i == copies // 2 else edits):
                own[at] = words(rnd, 1)[0]
            variants[g * copies + i] = own
            docs[g * copies + i] = [*words(rnd, rnd.randint(30, 60)), *own, *words(rnd, rnd.randint(30, 60))]
    true = set()
    for g in range(groups):
        table = np.array([variants[g * copies + i] for i in range(copies)])
        for j in range(1, copies):
            same = table[:j] == table[j]
            runs = np.lib.stride_tricks.sliding_window_view(np.lib.stride_tricks.sliding_window_view(same, 5, axis=1).all(2), 46, axis=1).sum(2)
            true |= {(g * copies + j, g * copies + int(i)) for i in np.flatnonzero((runs / (92 - runs) >= 0.8).any(1))}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {(r.doc_id, r.rep_doc_id) for r in passages.repeated_passages(spark, df).collect()}
    root = roots(found)
    assert true and len({j for j, _ in true} & {j for j, _ in found}) >= 0.95 * len({j for j, _ in true})
    assert sum(root.get(j, j) == root.get(i, i) for j, i in true) >= 0.9 * len(true)
    assert len(true & found) >= 0.9 * len(true)
    assert all(j // copies == i // copies for j, i in found)


def test_words_put_in_and_left_out_of_crowded_passages(spark):
    # Each variant lacks or adds one word of its own; in the middle each is like the one before it.
    rnd = random.Random(4)
    passage, docs = words(rnd, 56), {}
    for i in range(90):
        own = list(passage)
        for at in (2, 53):  # variants differ at both ends, so that signatures are crowded
            own[at] = words(rnd, 1)[0]
        if i % 3 == 1:
            own.insert(28, words(rnd, 1)[0])
        elif i % 3 == 2:
            del own[20]
        docs[i] = [*words(rnd, 30), *own, *words(rnd, 30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {(r.doc_id, r.rep_doc_id) for r in passages.repeated_passages(spark, df).collect()}
    assert len({j for j, _ in found}) >= 85


def test_runs_are_met_by_one_shuffle_and_shuffles_go(spark, tmp_path):
    """Links of equal runs and the stretches of near ones come from one pass, whose state lasts from batch to batch;
    texts that go packed come back; and stored tables leave no shuffle behind."""
    import gc

    import numpy as np
    import pyarrow as pa

    from trackloom.llm import passages as op

    texts = ["", "äöü " * 9, "word " * 5000]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([*texts[:2], texts[2]], pa.string())], ["doc_id", "text"])
    packed = list(op._packed([rows]))[0]
    back = list(op._unpacked([pa.RecordBatch.from_arrays([packed.column(0), packed.column(1), pa.array([[], [1], [2]]), packed.column(2)], ["doc", "packed", "marks", "size"])]))
    assert [x for b in back for x in b.column(1).to_pylist()] == texts

    digest = np.array([2, 2, 2, 5, 5, 5], np.int64)
    doc, start, content = np.array([7, 8, 9, 1, 2, 3], np.int64), np.array([0, 3, 4, 46, 46, 47], np.int32), np.array([1, 1, 1, 4, 5, 6], np.int32)
    whole = pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc), pa.array(start), pa.nulls(6, pa.int64()), pa.nulls(6, pa.int32()), pa.array(content)], op.RUNS.replace(" long", "").replace(" int", "").split(", "))
    found = {tuple(r.values()) for k in range(6) for b in op._met_runs([whole.slice(0, k), whole.slice(k)]) for r in b.to_pylist()}
    assert {r[:2] for r in found if r[7] == 1.0} == {(8, 7), (9, 7)}
    assert {(r[0], r[1], r[3], r[5]) for r in found if r[7] is None} == {(2, 1, 46, 46), (3, 1, 47, 46), (3, 2, 47, 46)}

    before = {p for p in _shuffle_files(spark)}
    op.stored(spark, spark.range(100000).repartition(4, "id"), "test")
    gc.collect()
    import time

    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before


def _shuffle_files(spark):
    import pathlib

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for d in manager.localDirsString() for p in pathlib.Path(d).rglob("shuffle_*.data")}
