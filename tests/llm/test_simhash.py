import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from conftest import DATA

from trackloom.llm import components, queries, simhash


def brute_print(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fingerprint)."""
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if i < j and (x ^ y).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


def test_query_against_brute_force(spark):
    d = f"{DATA}/sf0.001"
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute_components(docs)
    found = queries.op2_simhash(spark, d).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in docs}
    assert {r.doc_id: r.component_id for r in found} == want


def planted(rng, n):
    base = rng.integers(0, 1 << 63, n, np.uint64)
    chain = [base]
    for _ in range(5):
        chain.append(chain[-1] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    center = int(base[0])
    crowd = [center ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 5), replace=False)) for _ in range(1500)]
    return np.unique(np.concatenate([*chain, np.array(crowd, np.uint64)]))


def signed(p):
    return int(np.uint64(p).view(np.int64))


def found_roots(spark, prints):
    edges = simhash.links(spark, spark.createDataFrame([(signed(p),) for p in prints], "print long"))
    root = {r.node: r.root for r in components.components(spark, edges).collect()}
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(root.get(signed(p), signed(p)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_links_keep_all_components(spark, monkeypatch):
    prints = planted(np.random.default_rng(3), 120)
    want = brute_components([(i, int(p)) for i, p in enumerate(prints)])
    assert found_roots(spark, prints) == want
    rows = prints[:400]
    batch = lambda x: pa.RecordBatch.from_arrays(list(x.columns), x.schema.names)
    dealt = pa.Table.from_batches(simhash._cell_rows([pa.RecordBatch.from_arrays([pa.array(rows.view(np.int64))], ["print"])])).sort_by([("choice", "ascending"), ("cell", "ascending"), ("near", "ascending")])
    for crowd, size in ((1, 7), (5, 3), (1024, 50)):  # cells that go on over batches, and crowded ones
        monkeypatch.setattr(simhash, "CROWD", crowd)
        out = pa.Table.from_batches(simhash._link_batches(map(batch, dealt.to_batches(max_chunksize=size))), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())])).to_pylist()
        crowded = {r["a"] for r in out if r["b"] is None}
        pairs = [(r["a"], r["b"]) for r in out if r["b"] is not None]
        around = {}
        for p in crowded:
            for x in [0, *(1 << i for i in range(64))]:
                around.setdefault(int(np.int64(p).view(np.uint64)) ^ x, []).append(p)
        pairs += [(p, min(g)) for g in around.values() for p in g]
        up = {signed(p): signed(p) for p in rows}

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            up[root(a)] = root(b)
        own = brute_components([(i, int(p)) for i, p in enumerate(rows)])
        assert all((own[i] == own[j]) == (root(signed(rows[i])) == root(signed(rows[j]))) for i in range(len(rows)) for j in range(0, i, 7))


def test_coordinates_of_close_prints():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    a, b = simhash.coordinates(x), simhash.coordinates(y)
    assert a.min() >= 0 and a.max() <= 2 and np.abs(a - b).sum(1).max() <= 2
    assert (simhash.cells(x) == simhash.cells(y)).any(0).all()


def test_crowd_links(spark):
    rng = np.random.default_rng(4)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 12, 60, np.uint64), np.uint64(1 << 63) | rng.integers(0, 1 << 9, 40, np.uint64)]))
    edges = simhash.crowd_links(spark.createDataFrame([(signed(p),) for p in prints], "a long"))
    root = {r.node: r.root for r in components.components(spark, edges).collect()}
    own = brute_components([(i, int(p)) for i, p in enumerate(prints)])
    names = [root.get(signed(p), signed(p)) for p in prints]
    assert all((own[i] == own[j]) == (names[i] == names[j]) for i in range(len(prints)) for j in range(i))


def test_odd_rows(spark):
    rnd = random.Random(2)
    texts = [None, "", " \x0b", "one", "one two", "ONE two", "É one two", "a b c", "a b c", " ".join(rnd.choice("abcdef") for _ in range(30_000)), "\xa0x y z w"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, print string")
    found = {r.doc_id: r for r in simhash.near_dedup(spark, docs).collect()}
    prints = [(i, brute_print(t)) for i, t in enumerate(texts)]
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints)
    assert simhash.near_dedup(spark, docs.limit(0)).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 400)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in components.components(spark, edges).collect()}
    assert found == {i: 1 for i in range(2, 401)} | {1001: 1000}


def test_components_around_a_hub(spark):
    edges = spark.createDataFrame([(5000, i) for i in range(600)] + [(700 + i, 5000 + i) for i in range(50)], "a long, b long")
    found = {r.node: r.root for r in components.components(spark, edges).collect()}
    assert found == {i: 0 for i in range(1, 600)} | {5000: 0, 700: 0} | {5000 + i: 700 + i for i in range(1, 50)}
