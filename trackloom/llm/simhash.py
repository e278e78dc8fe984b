"""Operator 2: SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets a table of its Hamming distances to many
reference fingerprints (pivots). By the triangle inequality fingerprints within
``MOST`` bits differ by that at most in every distance.

A pivot and its copies with one block of bits turned over make this sharper: the
difference of the two distances says how many bits of that block differ from the
pivot. These block coordinates of a pair within two bits differ by two in all, so
they are equal in at least four of six bands of blocks. For each choice of four
bands, fingerprints with equal coordinates form a cell; every pair that can link
meets in one. A random pivot's distance orders the rows of a cell, which are compared
within a window of two in it; pairs whose greatest difference over all pivots is
larger are discarded, and the survivors are verified.

A cell of more than ``CROWD`` fingerprints is not held: its fingerprints are linked
through their one-bit neighbours, by an aggregation over all of them. Two
fingerprints within two bits have a common neighbour within one bit of both, and
all around one neighbour are within two bits of each other, so linking each to the
least one at every neighbour connects exactly what links. Links are spanning
forests, not all pairs.

Results for odd rows: a null or empty text has fingerprint zero and is linked
like any other; with one or two words the whole sequence is the only shingle;
equal texts, and repeated rows, share a fingerprint and a component; an empty
table gives no rows. A null doc_id takes part, but gives no component its name
while another document can. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import stored, text_rows, text_slices, utf8_of
from .components import components

WORDS, SEED, BITS = 3, 42, 64
MOST = 2
PIVOTS = 16
#: Blocks of neighbouring bits, and how many of them make each band.
BLOCKS, BANDS = 32, (6, 6, 5, 5, 5, 5)
#: Rows of a cell that are held and compared at most.
CROWD = 1024


def bit_counts(digests: list[bytes]) -> np.ndarray:
    """How many of the digests have each bit set, highest first."""
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(0, dtype=np.uint32)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8."""
    found = text.lower().split()  # bytes: lowers A-Z, splits at blanks only
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        counts += bit_counts(list(map(xxhash.xxh64_digest, shingles[at : at + (1 << 16)], repeat(SEED))))
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), _signed([fingerprint(t) for t in utf8_of(batch.column(1))])], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint's bits as a long) of each row."""
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, print long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the same random ones in every run."""
    return np.random.default_rng(20_011).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def block_pivots() -> np.ndarray:
    """One reference fingerprint, and its copies with one block turned over each."""
    size = BITS // BLOCKS
    masks = [((1 << size) - 1) << size * k for k in range(BLOCKS)]
    return pivots(1)[0] ^ np.array([0, *masks], np.uint64)


def coordinates(prints: np.ndarray) -> np.ndarray:
    """How many bits of each block differ from the reference, from the distances to the block pivots."""
    table = np.bitwise_count(prints[:, None] ^ block_pivots()).astype(np.int16)
    return (table[:, :1] - table[:, 1:] + BITS // BLOCKS) // 2


def cells(prints: np.ndarray) -> np.ndarray:
    """(choices, rows): the cell of each fingerprint for each choice of bands that must agree."""
    found = coordinates(prints).astype(np.int64)
    base, codes, widths, at = BITS // BLOCKS + 1, [], [], 0
    for size in BANDS:
        codes.append(found[:, at : at + size] @ base ** np.arange(size))
        widths.append(base**size)
        at += size
    out = []
    for choice in combinations(range(len(BANDS)), len(BANDS) - MOST):
        code = np.zeros(len(prints), np.int64)
        for band in choice:
            code = code * widths[band] + codes[band]
        out.append(code)
    return np.array(out)


ROWS = "choice int, cell long, near int, print long"


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print -> a row for each choice of bands, with the distance to a random pivot."""
    first = pivots(2)[1]
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        found = cells(prints)
        near = np.bitwise_count(prints ^ first).astype(np.int32)
        k, n = found.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), pa.array(found.ravel()), pa.array(np.tile(near, k)), pa.array(np.tile(prints.view(np.int64), k))], ["choice", "cell", "near", "print"]
        )


def linked_pairs(prints: np.ndarray, near: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same group that link. Rows are sorted by group and near."""
    table = np.bitwise_count(prints[:, None] ^ pivots()).astype(np.int8)
    rows = np.arange(len(prints) - 1)
    left, right = [], []
    for lag in range(1, len(prints)):
        rows = rows[rows + lag < len(prints)]
        other = rows + lag
        rows = rows[(group[rows] == group[other]) & (near[other] - near[rows] <= MOST)]
        if not len(rows):
            break
        other = rows + lag
        close = np.abs(table[rows] - table[other]).max(1) <= MOST
        a, b = rows[close], other[close]
        sure = np.bitwise_count(prints[a] ^ prints[b]) <= MOST
        left.append(a[sure])
        right.append(b[sure])
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new


EDGES = "a long, b long"


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by choice, cell and near -> links, and the fingerprints of crowded cells (without b).
    Of a cell that goes on in the next batch, CROWD rows are held at most."""

    def work(choice, cell, near, prints) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(choice) != 0) | (np.diff(cell) != 0)]))
        sizes = np.diff(np.append(starts, len(choice)))
        group = np.repeat(np.arange(len(starts)), sizes)
        few = np.flatnonzero(((sizes > 1) & (sizes <= CROWD))[group])
        if len(few):
            a, b = linked_pairs(prints[few].view(np.uint64), near[few], group[few])
            touched = np.unique(np.concatenate([a, b]))
            root = forest(len(touched), np.searchsorted(touched, a), np.searchsorted(touched, b))
            own = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[few[touched[own]]]), pa.array(prints[few[touched[root[own]]]])], ["a", "b"])
        yield from crowd(prints[(sizes > CROWD)[group]])

    def crowd(prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(prints):
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.nulls(len(prints), pa.int64())], ["a", "b"])

    kept: list[np.ndarray] | None = None
    wide = None  # the crowded cell that the last batch ended in
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if wide is not None:
            go_on = (rows[0] == wide[0]) & (rows[1] == wide[1])
            yield from crowd(rows[3][go_on])
            rows = [x[~go_on] for x in rows]
        if not len(rows[0]):
            continue
        wide = None
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from work(*(x[:cut] for x in rows))
        kept = [x[cut:] for x in rows]
        if len(kept[0]) > CROWD:
            wide = kept[0][0], kept[1][0]
            yield from crowd(kept[3])
            kept = None
    if kept is not None:
        yield from work(*kept)


def crowd_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (a) of crowded cells within two bits of each other."""
    bits = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = prints.select("a").distinct().select("a", F.explode(bits).alias("bit")).select("a", F.col("a").bitwiseXOR(F.col("bit")).alias("at"))
    return around.groupBy("at").agg(F.min("a").alias("b"), F.collect_list("a").alias("all")).filter("size(all) > 1").select(F.explode("all").alias("a"), "b").filter("a <> b").distinct()


def links(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (print) within ``MOST`` bits."""
    rows = prints.select("print").mapInArrow(_cell_rows, ROWS)
    dealt = rows.repartition("choice", "cell").sortWithinPartitions("choice", "cell", "near", "print")
    found = stored(spark, dealt.mapInArrow(_link_batches, EDGES), "links")
    crowded = found.filter("b IS NULL")
    pairs = found.filter("b IS NOT NULL")
    return pairs if crowded.isEmpty() else pairs.union(crowd_links(crowded))


def grouped(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id and print of each row; and of each print its component_id, its
    smallest doc_id (least) and whether it is the component's first.

    A print is its own node: rows that share a doc_id, or have none, link
    through their texts only.
    """
    found = stored(spark, fingerprints(docs, id_col, text_col), "prints")
    distinct = stored(spark, found.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    named = components(spark, links(spark, distinct)).withColumnRenamed("node", "print")
    roots = stored(spark, distinct.join(named, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "least"), "roots")
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "print")).alias("first")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"), first)
    return found, roots.join(names, "root").select("print", "component_id", "least", (F.col("print") == F.col("first.print")).alias("first"))


def with_print(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The same rows with the fingerprint of each text."""
    at = docs.columns.index(text_col)

    def kernel(batches):
        for batch in text_slices(batches, at):
            prints = _signed([fingerprint(t) for t in utf8_of(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, name])

    return text_rows(docs).mapInArrow(kernel, StructType([*docs.schema.fields, StructField(name, LongType())]))


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each row of ``docs``."""
    found, prints = grouped(spark, docs, id_col, text_col)
    return found.join(prints, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
