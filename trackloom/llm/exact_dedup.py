"""Operator 1: exact dedup over a cuckoo-filter index.

A text's content is the SHA-256 of its UTF-8 bytes without blanks. Each shard
of digests has a ``CuckooIndex``: short fingerprints in buckets of four, beside
each the stored key. A fingerprint miss proves a digest new; a hit is verified
against the full key in the bucket; a digest whose last live copy goes is taken
out; when kicks run out, the table doubles and refills from the stored keys.

Equal digests are first folded within each map task (an index that is handed on
when full), so a digest with a third of all rows is a few rows when shuffled.

Results for odd rows: a null text counts as empty, and empty texts are equal to
each other. Rows that repeat a doc_id are rows like others; of rows equal in
text length and doc_id the first read stays, so each group keeps exactly one
row. A null doc_id comes after all others. An empty table gives no rows. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_parts, slices, stored, text_rows, utf8_of

SLOTS = 4
MAX_KICKS = 500
#: Live digests of a map task's index before it is handed on.
FOLD_KEYS = 1 << 16
#: Rows that are folded by one task of the second round, as an average.
SHARD_ROWS = 1 << 20
#: A text is hot from this share of the rows, so there are as many hot ones at most.
HOT_ROWS, HOT_SHARE = 10_000, 10_000
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = 1 << 63


class CuckooIndex:
    """Cuckoo filter with stored keys: insert, look up and delete digests.

    Keys are byte strings of 10 or more uniformly random bytes (digests). Each
    slot holds a 16-bit fingerprint and, in the bucket's content, the key with
    its value, against which every hit is verified.
    """

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.content: list = [None] * (buckets * SLOTS)

    def __len__(self) -> int:
        return self.size

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") or 1
        first = int.from_bytes(key[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second) if second != first else (first,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        """The value of a live key, or None."""
        slot = self._slot(key)
        return self.content[slot][1] if slot >= 0 else None

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live, or replace a live key's value."""
        slot = self._slot(key)
        if slot >= 0:
            self.content[slot] = (key, value)
            return
        entry = (key, value)
        while (entry := self._place(entry)) is not None:
            self._grow()
        self.size += 1

    def _place(self, entry: tuple):
        """Put an entry in; the entry that found no place, if kicks run out."""
        mark, bucket, second = self._places(entry[0])
        for b in (bucket, second):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = mark, entry
                    return None
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.content[slot] = self.content[slot], entry
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = mark, entry
                    return None
        return entry

    def _grow(self) -> None:
        """Double the table and refill it from the stored keys."""
        kept = [x for x in self.content if x is not None]
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._place(x) is None for x in kept):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False if it was not there."""
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return (x for x in self.content if x is not None)


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, BLANKS)).digest()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([digest(t) for t in utf8_of(batch.column(2))], pa.binary()),
                pc.utf8_length(batch.column(2)).fill_null(0).cast(pa.int64()),
            ],
            ["row_id", "doc_id", "digest", "points"],
        )


GROUPS = "digest binary, group_size long, points long, keep_id long, keep_row long"


def _fold(rows: Iterator[tuple], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Fold (digest, size, points, doc_id, row_id) into one row per digest."""
    index = CuckooIndex()
    for key, size, points, doc_id, row_id in rows:
        rank = (-points, NO_ID if doc_id is None else doc_id, row_id)
        group = index.get(key)
        if group is None:
            if limit and len(index) >= limit:
                yield from _groups(index)
                index = CuckooIndex()
            index.insert(key, [size, rank])
        else:
            group[0] += size
            group[1] = min(group[1], rank)
    yield from _groups(index)


def _groups(index: CuckooIndex, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    found = list(index.items())
    for at in range(0, len(found), rows):
        part = found[at : at + rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in part], pa.binary()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([-v[1][0] for _, v in part], pa.int64()),
                pa.array([None if v[1][1] == NO_ID else v[1][1] for _, v in part], pa.int64()),
                pa.array([v[1][2] for _, v in part], pa.int64()),
            ],
            ["digest", "group_size", "points", "keep_id", "keep_row"],
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)


def _fold_map(batches):
    yield from _fold(((d, 1, p, i, r) for d, p, i, r in _rows(batches)), FOLD_KEYS)


def _fold_shard(batches):
    yield from _fold(_rows(batches), None)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, digest, points (code points) of each row."""
    rows = text_rows(docs).select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digest_batches, "row_id long, doc_id long, digest binary, points long")


def groups(found: DataFrame, rows: int) -> DataFrame:
    """One row for each digest: group_size and the row that stays. ``rows``: how many rows there are;
    they are dealt to so many shards that an index stays small."""
    folded = found.select("digest", "points", "doc_id", "row_id").mapInArrow(_fold_map, GROUPS)
    shards = max(shuffle_parts(found.sparkSession), -(-rows // SHARD_ROWS))
    return folded.repartition(shards, "digest").mapInArrow(_fold_shard, GROUPS)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``."""
    found = stored(spark, digests(docs, id_col, text_col), "digests")
    rows = found.count()
    copies = stored(spark, groups(found, rows).filter("group_size > 1").select("digest", "group_size", "keep_id", "keep_row"), "copies")
    hot = copies.filter(F.col("group_size") > max(HOT_ROWS, rows // HOT_SHARE))
    if hot.isEmpty():
        joined = found.join(copies, "digest", "left")
    else:  # hot texts are few, and their rows stay where they are
        rest = found.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(copies, "digest", "left")
        joined = found.join(F.broadcast(hot), "digest").unionByName(rest)
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


# -- an index that is kept between runs -------------------------------------


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The live digests of a table: digest, group_size. Null texts count as empty; an empty table has none."""
    found = stored(docs.sparkSession, digests(docs, id_col, text_col), "digests")
    return groups(found, found.count()).select("digest", "group_size")


def _apply_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of step, digest and count, by step: stored digests and additions are inserted, removals count
    down, and a digest that loses its last copy is deleted from the index, which frees its slot."""
    index = CuckooIndex()
    for step, key, count in _rows(batches):
        live = index.get(key)
        if step < 2:
            index.insert(key, (live or 0) + count)
        elif live is not None:  # removing what is not live changes nothing
            if live > count:
                index.insert(key, live - count)
            else:
                index.delete(key)
    found = list(index.items())
    for at in range(0, len(found), 1 << 15):
        part = found[at : at + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["digest", "group_size"])


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """An index after documents came and went: additions count up, removals
    count down, and a digest without live copies is deleted. All of them are
    tables of digest and group_size, as ``index_of`` gives them; removing what
    is not live changes nothing that is. Null digests and counts that are null or
    not over zero are left out; a digest that a table repeats counts with the sum.
    Empty tables change nothing."""
    steps = None
    for step, table in enumerate((index, added, removed)):
        own = table.filter("digest IS NOT NULL AND group_size > 0").groupBy("digest").agg(F.sum("group_size").alias("n")).select(F.lit(step).alias("step"), "digest", "n")
        steps = own if steps is None else steps.unionByName(own)
    steps = stored(index.sparkSession, steps, "changes")
    shards = max(shuffle_parts(index.sparkSession), -(-steps.count() // SHARD_ROWS))
    return steps.repartition(shards, "digest").sortWithinPartitions("step", "digest").mapInArrow(_apply_changes, "digest binary, group_size long")


def seen(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and whether its text is live in the index; null texts ask as the empty one. The index has a row a digest."""
    own = digests(docs, id_col, text_col)
    return own.join(index.select("digest", F.lit(True).alias("live")), "digest", "left").select("doc_id", F.coalesce("live", F.lit(False)).alias("seen"))
