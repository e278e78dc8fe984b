"""Operator 3: approximate nearest neighbours by NN-descent.

A neighbour graph over the distinct vectors starts from blocks of rows that
random hyperplanes order alike, and is refined in Spark joins: each node's
neighbours and reverse neighbours meet at the node, are compared with each other
and offered to one another where they beat the present farthest neighbour. Rounds
stop when few edges change. A query starts at its own node and walks the graph
greedily, a beam of the best nodes found so far at a time, by joins of the
frontier with the nodes' neighbour lists. What the beam holds at the end is
scored exactly on the original vectors.

Equal vectors are one node with its smallest ids, as many as a result can hold,
so a vector with a third of all rows costs what any other does. Reverse
neighbours are a bounded sample of each node (a hub is no hot key), and a member
gets the best few offers of each meeting: both only steer the search, whose
recall against brute force is tested.

Results for odd rows: vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do vectors of another length than the
most common one; rows that repeat a vec_id count as one; ties go to the smaller
vec_id; with fewer candidates than asked for all are returned; an empty table
gives no rows. Other columns of the input are not looked at. ``exact_nearest`` looks at
every row instead of walking the graph, for the same results without a miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bucketed, shuffle_parts, stored, text_rows, whole_groups

NEIGHBOURS, REVERSE, OFFERS, OLD = 24, 16, 8, 8
SEED_TABLES, SEED_BLOCK, SEED_KEEP = 6, 1024, 12
ROUNDS, SETTLED = 5, 0.02
BEAM, STEPS = 192, (1, 24, 48, 64, 64)
EVERY, TOP = 50, 5
FOLD_KEYS = 1 << 15


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> vec_id, dim, key, raw: the usable vectors as bytes of doubles."""
    for batch in batches:
        ids, dims, keys, raws = [], [], [], []
        for vec_id, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = own.values
            if vec_id is None or values is None or not len(values) or values.null_count:
                continue
            vector = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
            if np.isfinite(vector).all() and vector.any():
                ids.append(vec_id)
                dims.append(len(vector))
                raws.append(vector.tobytes())
                keys.append(hashlib.blake2b(raws[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "dim", "key", "raw"])


NODES = "key binary, ids array<long>, raw binary"


def _fold_copies(batches: Iterator[pa.RecordBatch], limit: int, keep: int) -> Iterator[pa.RecordBatch]:
    """(key, ids, raw) -> one row per key with its smallest ids."""
    found: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.list_(pa.int64())), pa.array([v[1] for v in found.values()], pa.binary())], ["key", "ids", "raw"])

    for batch in batches:
        for key, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(found) >= limit and key not in found:
                yield out()
                found.clear()
            have = found.setdefault(key, [[], raw])
            have[0] = sorted({*have[0], *ids})[:keep]
    yield out()


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of doubles at unit length, in single precision."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids, raw) -> the same with the node's name and its unit vector."""
    for batch in batches:
        if batch.num_rows:
            raws = batch.column(2).to_pylist()
            units = _units(np.frombuffer(b"".join(raws)).reshape(len(raws), -1))
            first = pa.array([x[0] for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([first, *batch.columns, pa.array([u.tobytes() for u in units], pa.binary())], ["node", "key", "ids", "raw", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _seed_keys(batches, dim: int, bits: int) -> Iterator[pa.RecordBatch]:
    """node, vec -> a row for each table with its hyperplane code and place."""
    planes = np.random.default_rng(977).standard_normal((SEED_TABLES, dim, bits + 1)).astype(np.float32)
    for batch in batches:
        vectors = _matrix(batch.column(1))
        for table in range(SEED_TABLES):
            sides = vectors @ planes[table]
            code = ((sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), table, np.int32)), pa.array(code), pa.array(sides[:, bits].astype(np.float64)), *batch.columns], ["table", "code", "place", "node", "vec"])


EDGES = "node long, other long, sim float, fresh boolean, place int"


def _edge_batch(a, b, sim, fresh, place=None) -> pa.RecordBatch:
    place = np.zeros(len(a), np.int32) if place is None else place.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32()), pa.array(fresh, pa.bool_()), pa.array(place)], ["node", "other", "sim", "fresh", "place"])


def _block_edges(nodes: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(nodes) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(nodes)), k)
    return _edge_batch(nodes[rows], nodes[best.ravel()], sims[rows, best.ravel()], np.ones(len(rows), bool))


def _seed_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order -> edges within blocks of SEED_BLOCK rows, each half overlapping the next."""
    nodes, vectors = np.empty(0, np.int64), None
    half = SEED_BLOCK // 2
    for batch in batches:
        if not batch.num_rows:
            continue
        own = _matrix(batch.column(4))
        nodes, vectors = np.concatenate([nodes, batch.column(3).to_numpy()]), own if vectors is None else np.concatenate([vectors, own])
        at = 0
        while len(nodes) - at >= SEED_BLOCK + half:
            yield _block_edges(nodes[at : at + SEED_BLOCK], vectors[at : at + SEED_BLOCK], k)
            at += half
        nodes, vectors = nodes[at:], vectors[at:]
    if len(nodes) > 1:
        yield _block_edges(nodes, vectors, k)


def _keep_best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Edges sorted by node -> each node's k best with their place; an edge seen before stays no longer fresh."""
    for node, other, sim, fresh, _ in whole_groups(batches, 1):
        node, other, sim, fresh = (x.to_numpy(zero_copy_only=False) for x in (node, other, sim, fresh))
        order = np.lexsort((fresh, other, node))
        first = np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(other[order]) != 0)])
        own = order[first]
        own = own[np.lexsort((other[own], -sim[own], node[own]))]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(node[own]) != 0]))
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        own, rank = own[rank < k], rank[rank < k]
        yield _edge_batch(node[own], other[own], sim[own], fresh[own], rank)


def keep_best(edges: DataFrame, k: int) -> DataFrame:
    return edges.repartition("node").sortWithinPartitions("node").mapInArrow(lambda b: _keep_best(b, k), EDGES)


def members(graph: DataFrame, reverse: int, old: int | None = None) -> DataFrame:
    """center, member, fresh: each node with its neighbours and a sample of its reverse neighbours; who is
    both comes twice. Of neighbours and reverse ones that are not fresh, ``old`` are enough each where it is given."""
    order = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("node", "other"))
    back = graph.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reverse)
    if old is not None:
        graph, back = graph.filter(F.col("fresh") | (F.col("place") < old)), back.filter(F.col("fresh") | (F.col("rank") <= old))
    return graph.select(F.col("node").alias("center"), F.col("other").alias("member"), "fresh").union(back.select("other", "node", "fresh"))


def _once(center: np.ndarray, member: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
    """Rows ordered by center and member, each pair once; one that is not fresh stands for a fresh one."""
    order = np.lexsort((np.zeros(len(center)) if fresh is None else fresh, member, center))
    return order[np.concatenate([[True], (np.diff(center[order]) != 0) | (np.diff(member[order]) != 0)])]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """center, member, fresh, vec, worst (sorted by center) -> offers among each center's members."""
    for center, member, fresh, vec, worst in whole_groups(batches, 1):
        center, member, fresh, worst = (x.to_numpy(zero_copy_only=False) for x in (center, member, fresh, worst))
        own = _once(center, member, fresh)
        vectors = _matrix(vec)[own]
        center, member, fresh, worst = center[own], member[own], fresh[own], worst[own]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(center) != 0]))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(center)], strict=True):
            if b - a < 2 or not fresh[a:b].any():
                continue
            sims = vectors[a:b] @ vectors[a:b].T
            sims[~(fresh[a:b, None] | fresh[a:b])] = -2
            np.fill_diagonal(sims, -2)
            k = min(OFFERS, b - a - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(b - a), k), best.ravel()
            won = sims[i, j] > worst[a + i]
            out.append((member[a + i[won]], member[a + j[won]], sims[i, j][won]))
        if out:
            node, other, sim = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _edge_batch(node, other, sim, np.ones(len(node), bool))


def build_graph(spark: SparkSession, nodes: DataFrame, count: int, dim: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph of nodes (node, vec): node, other, sim, fresh."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / SEED_BLOCK)))))
    keyed = nodes.select("node", "vec").mapInArrow(lambda b: _seed_keys(b, dim, bits), "table int, code long, place double, node long, vec binary")
    parts = max(1, min(shuffle_parts(spark), SEED_TABLES * count // (4 * SEED_BLOCK)))
    ordered = keyed.repartitionByRange(parts, "table", "code", "place").sortWithinPartitions("table", "code", "place")
    graph = stored(spark, keep_best(ordered.mapInArrow(lambda b: _seed_batches(b, min(k, SEED_KEEP)), EDGES), k), "graph")
    for _ in range(rounds):
        worst = graph.groupBy("node").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
        state = nodes.select("node", "vec").join(worst, "node", "left").select(F.col("node").alias("member"), "vec", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        meeting = members(graph, REVERSE, OLD).join(state, "member").select("center", "member", "fresh", "vec", "worst")
        offers = meeting.repartition("center").sortWithinPartitions("center").mapInArrow(_meet, EDGES)
        graph = stored(spark, keep_best(graph.withColumn("fresh", F.lit(False)).unionByName(offers), k), "graph")
        if graph.filter("fresh").count() < SETTLED * count * k:
            break
    return graph


def _pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """center, member, vec sorted by center -> node, ids, vecs."""
    for center, member, vec in whole_groups(batches, 1):
        center, ids = center.to_numpy(), member.to_numpy()
        own = _once(center, ids)
        center, ids, raw = center[own], ids[own], vec.take(pa.array(own)).to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], np.diff(center) != 0])).tolist()
        ends = [*starts[1:], len(center)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(center[starts]), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([b"".join(raw[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())],
            ["node", "ids", "vecs"],
        )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, vec, ids, vecs -> the similarities of an expanded node's neighbours."""
    for batch in batches:
        out = []
        for query, vec, ids, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(ids, np.int64)
            sims = np.frombuffer(vecs, np.float32).reshape(len(own), -1) @ np.frombuffer(vec, np.float32)
            out.append((np.full(len(own), query), own, sims))
        if out:
            query, node, sim = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(node), pa.array(sim, pa.float32()), pa.array(np.zeros(len(node), np.int32))], ["query", "node", "sim", "state"])


BEAMS = "query long, node long, sim float, state int"


def _beam(batches: Iterator[pa.RecordBatch], beam: int, step: int) -> Iterator[pa.RecordBatch]:
    """Candidates sorted by query -> the beam; state 1: to expand now, 2: expanded."""
    for query, node, sim, state in whole_groups(batches, 1):
        query, node, sim, state = (x.to_numpy() for x in (query, node, sim, state))
        order = np.lexsort((-state, node, query))
        own = order[np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(node[order]) != 0)])]
        own = own[np.lexsort((node[own], -sim[own], query[own]))]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(query[own]) != 0]))
        sizes = np.diff(np.append(starts, len(own)))
        rank = np.arange(len(own)) - np.repeat(starts, sizes)
        own, at = own[rank < beam], np.minimum(sizes, beam)
        new = np.where(state[own] > 0, 2, 0)
        waiting = np.cumsum(new == 0)
        before = np.repeat(np.concatenate([[0], waiting[np.cumsum(at)[:-1] - 1]]), at)
        new[(new == 0) & (waiting - before <= step)] = 1
        yield pa.RecordBatch.from_arrays([pa.array(query[own]), pa.array(node[own]), pa.array(sim[own]), pa.array(new.astype(np.int32))], ["query", "node", "sim", "state"])


def search(spark: SparkSession, lists: DataFrame, queries: DataFrame, beam: int = BEAM, steps: tuple = STEPS) -> DataFrame:
    """Greedy walks. lists: node, ids, vecs; queries: query, node, vec. Gives query, node, sim."""
    found = queries.select("query", "node", F.lit(2.0).cast("float").alias("sim"), F.lit(0).alias("state"))
    for step in steps:
        ordered = found.repartition("query").sortWithinPartitions("query")
        beams = stored(spark, ordered.mapInArrow(lambda b, s=step: _beam(b, beam, s), BEAMS), "beams")
        front = beams.filter("state = 1").join(queries.select("query", "vec"), "query").join(lists, "node")
        found = beams.unionByName(front.select("query", "vec", "ids", "vecs").mapInArrow(_walk, BEAMS))
    return found.groupBy("query", "node").agg(F.max("sim").alias("sim"))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a), np.frombuffer(b)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            scores.append(float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])


def folded_nodes(spark: SparkSession, vectors: DataFrame, top: int) -> tuple[DataFrame, DataFrame, int]:
    """The usable rows, the distinct vectors as nodes, and their dimension."""
    rows = text_rows(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = stored(spark, rows.mapInArrow(_clean_batches, "vec_id long, dim int, key binary, raw binary"), "vectors")
    common = clean.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    clean = clean.filter(F.col("dim") == dim)
    folded = clean.select("key", F.array("vec_id").alias("ids"), "raw").mapInArrow(lambda b: _fold_copies(b, FOLD_KEYS, top + 1), NODES)
    # Sorted, so that a vector's rows follow each other and an index that is handed on splits none.
    copies = folded.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _fold_copies(b, FOLD_KEYS, top + 1), NODES)
    nodes = stored(spark, copies.mapInArrow(_node_batches, "node long, key binary, ids array<long>, raw binary, vec binary"), "nodes")
    return clean, nodes, dim


def ranked(pairs: DataFrame, top: int) -> DataFrame:
    """query, query_raw, ids, raw of nodes that may be near -> the results, scored exactly."""
    each = pairs.select("query", F.explode("ids").alias("vec_id"), "query_raw", "raw").filter("query <> vec_id")
    scored = each.mapInArrow(_cosines, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of every ``every``-th row."""
    clean, nodes, dim = folded_nodes(spark, vectors, top)
    graph = build_graph(spark, nodes, nodes.count(), dim)
    around = members(graph, REVERSE).join(nodes.select(F.col("node").alias("member"), "vec"), "member").select("center", "member", "vec")
    packed = around.repartition("center").sortWithinPartitions("center").mapInArrow(_pack_lists, "node long, ids binary, vecs binary")
    asked = clean.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "key").distinct()
    queries = stored(spark, asked.join(nodes, "key").select("query", "node", "vec", F.col("raw").alias("query_raw")), "queries")
    # Dealt by node once, so that a step moves its frontier only.
    with bucketed(spark, packed, "node") as lists:
        beams = stored(spark, search(spark, lists, queries), "found")
    # The beam's best, and every copy that can be among the nearest.
    return ranked(beams.join(queries.select("query", "query_raw"), "query").join(nodes.select("node", "ids", "raw"), "node"), top)


# -- the exact way: the queries against all nodes, block by block --------------

QUERY_BLOCK, NODE_BLOCK = 1024, 4096


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, vec) -> blocks of ids and vectors as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], ["ids", "vecs"])


def _unit_block(data: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(data).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: More than sums of double products can be off, for each dimension.
ROUNDING = 4 * np.finfo(float).eps


def _block_best(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """(query ids, query vectors, node ids, node vectors) -> each query's nearest nodes of the block, and all that
    rounding cannot tell from the last of them."""
    for batch in batches:
        for q_ids, q_vecs, n_ids, n_vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            q, n = np.frombuffer(q_ids, np.int64), np.frombuffer(n_ids, np.int64)
            own, others = _unit_block(q_vecs, len(q)), _unit_block(n_vecs, len(n))
            sims = own @ others.T
            k = min(keep, len(n))
            last = np.partition(sims, len(n) - k, axis=1)[:, len(n) - k]
            row, at = np.nonzero(sims >= last[:, None] - ROUNDING * own.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(n[at]), pa.array(sims[row, at])], ["query", "node", "sim"])


def exact_nearest(spark: SparkSession, vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """The same results by looking at every row, in double precision: the queries' blocks meet the nodes' blocks,
    and of each block the best ``top + 1`` (a query's own vector may be one), with all that are within rounding of
    the last, go on to be scored. No limit leaves a row out."""
    clean, nodes, dim = folded_nodes(spark, vectors, top)
    asked = clean.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "key").distinct()
    queries = stored(spark, asked.join(nodes, "key").select("query", F.col("raw").alias("query_raw")), "queries")
    q = queries.select("query", "query_raw").mapInArrow(lambda b: _blocks(b, QUERY_BLOCK), "ids binary, vecs binary").toDF("q_ids", "q_vecs")
    n = nodes.select("node", "raw").mapInArrow(lambda b: _blocks(b, NODE_BLOCK), "ids binary, vecs binary")
    met = n.crossJoin(q).select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(lambda b: _block_best(b, top + 1), "query long, node long, sim double")
    own = Window.partitionBy("query")
    placed = met.withColumn("rank", F.row_number().over(own.orderBy(F.desc("sim"), "node")))
    last = F.min(F.when(F.col("rank") <= top + 1, F.col("sim"))).over(own)
    near = placed.withColumn("last", last).filter(F.col("sim") >= F.col("last") - float(ROUNDING * dim)).select("query", "node")
    return ranked(near.join(queries, "query").join(nodes.select("node", "ids", "raw"), "node"), top)
