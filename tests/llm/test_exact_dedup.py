import hashlib
import random
import re

import pyarrow as pa
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same

from trackloom.llm import exact_dedup, queries
from trackloom.llm.exact_dedup import CuckooIndex


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=2000))
def test_index_is_a_dict(steps):
    index, model = CuckooIndex(2), {}
    for add, i in steps:
        if add:
            index.insert(key(i), i)
            model[key(i)] = i
        else:
            assert index.delete(key(i)) == (model.pop(key(i), None) is not None)
    assert len(index) == len(model) and dict(index.items()) == model
    assert all(index.get(key(i)) == model.get(key(i)) for i in range(301))


def test_index_grows_and_verifies():
    index = CuckooIndex(1)
    for i in range(5000):
        index.insert(key(i), i)
    assert all(index.get(key(i)) == i for i in range(5000))
    other = key(7)[:12] + bytes(20)  # the same fingerprint and bucket, another key
    assert index.get(other) is None and not index.delete(other)


def test_oracle(spark):
    d = f"{DATA}/sf0.01"
    same(queries.op1_exact_dedup(spark, d), queries.ORACLES["op1_exact_dedup"], connect(d))


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0]))[0]
        out += [(i, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return sorted(out)


def test_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a b", "ab", "a\tb\n", "é ß", "éß", "", None, " \x0b\x0c", "\xa0", "x" * 50_000])) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, keep_id int, kept boolean")
    found = exact_dedup.exact_dedup(spark, docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(spark, docs).collect()
    assert sum(r.kept for r in found) == 2 and {r.keep_id for r in found} == {1, 2}
    assert exact_dedup.exact_dedup(spark, docs.limit(0)).count() == 0


def test_index_between_runs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.index_of(docs)
    gone = exact_dedup.index_of(docs.filter("doc_id IN (2, 3)"))
    new = exact_dedup.index_of(spark.createDataFrame([(4, "c")], "doc_id long, text string"))
    index = exact_dedup.update_index(index, new, gone)
    asked = spark.createDataFrame([(1, "a "), (2, "b"), (3, "c")], "doc_id long, text string")
    assert {r.doc_id: r.seen for r in exact_dedup.seen(index, asked).collect()} == {1: True, 2: False, 3: True}


def test_deletions_hit_live_keys_and_free_their_slots(monkeypatch):
    """Stored digests, additions, then removals: each last copy is deleted from the index, whose slots are used again."""
    hits, sizes = [], []
    real = CuckooIndex.delete

    def delete(self, k):
        before = sum(self.prints[s] != 0 for s in range(len(self.prints)))
        hits.append(real(self, k))
        sizes.append(before - sum(self.prints[s] != 0 for s in range(len(self.prints))))
        return hits[-1]

    monkeypatch.setattr(CuckooIndex, "delete", delete)
    rows = [(0, key(i), 2) for i in range(50)] + [(1, key(i), 1) for i in range(40, 60)] + [(2, key(i), 2) for i in range(30, 70)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["step", "digest", "n"])
    found = {k: n for b in exact_dedup._apply_changes(iter([batch])) for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {key(i): 2 for i in range(30)} | {key(i): 1 for i in range(40, 50)}
    assert hits == [True] * 20 and sizes == [1] * 20  # 30 to 39 and 50 to 59 lose their last copy; 60 to 69 were never live


def test_odd_changes_of_an_index(spark):
    table = lambda *rows: spark.createDataFrame(rows, "digest binary, group_size long")
    none = table((key(0), 1)).limit(0)
    index = table((key(1), 1), (key(1), 2), (None, 5), (key(2), None), (key(3), 0), (key(4), 1))
    left = {bytes(r.digest): r.group_size for r in exact_dedup.update_index(index, none, table((key(1), 1), (key(9), 3), (None, 1))).collect()}
    assert left == {key(1): 2, key(4): 1} and exact_dedup.update_index(none, none, none).count() == 0
    again = {bytes(r.digest): r.group_size for r in exact_dedup.update_index(none, index, index).collect()}
    assert again == {}
