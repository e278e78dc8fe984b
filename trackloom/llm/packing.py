"""Operator 6: best-fit packing by sums of squares.

Each document's ids end in one separator. Documents over the sequence length
are cut into full pieces and a rest; the pieces of all documents, longest first,
go where the sum of the squared counts of open sequences per residual gap
becomes smallest. Only lengths matter for that, so what is packed is a narrow
table of pieces, dealt at random (repeated rows too) into groups of about ``group_pieces``; a group
holds enough lengths to leave one or two sequences open, whatever the size of
the corpus.

Results for odd rows: a null or empty text is its separator alone; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import stored, text_rows, text_slices

LENGTH = 2048
SEPARATOR = 0
#: Pieces that are packed together.
GROUP_PIECES = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    encoder = bpe.load(path)
    for batch in text_slices(batches):
        ids, ends = encoder.encode_column(batch.column(1))
        at, out = 0, ([], [], [], [], [])
        for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
            own = np.append(ids[at:end], SEPARATOR).astype("<u4")
            at = end
            for piece, start in enumerate(range(0, len(own), most)):
                part = own[start : start + most]
                for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


def pieces(docs: DataFrame, path: str | None = None, most: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = path or bpe.default_path()
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _piece_batches(batches, path, most), PIECES)


class SumOfSquares:
    """Sequences of one length; ``place`` gives the sequence and the place in it."""

    def __init__(self, length: int):
        self.length, self.made = length, 0
        self.counts = np.zeros(length + 1, np.int64)  # open sequences by gap
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        counts, whole = self.counts, self.length
        gaps = np.flatnonzero(counts[size:]) + size
        if len(gaps):
            # n^2 becomes (n-1)^2 where it leaves, m^2 becomes (m+1)^2 where it comes; a full sequence counts nowhere.
            rest = gaps - size
            into = int(gaps[np.argmin(1 - 2 * counts[gaps] + np.where(rest > 0, 2 * counts[rest] + 1, 0))])
            sequence = self.open[into].pop()
            counts[into] -= 1
        else:
            into, sequence = whole, self.made
            self.made += 1
        rest = into - size
        if rest:
            self.open[rest].append(sequence)
            counts[rest] += 1
        return sequence, whole - into


def _pack_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted by group and falling length."""
    group, packer = None, None
    for batch in batches:
        sequences, offsets = [], []
        for g, size in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if g != group:
                group, packer = g, SumOfSquares(most)
            sequence, offset = packer.place(size)
            sequences.append((g << 32) + sequence)
            offsets.append(offset)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, most: int = LENGTH, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its place in its document and in its sequence."""
    found = stored(spark, pieces(docs, path, most, id_col, text_col), "pieces")
    count = max(1, -(-found.count() // group_pieces))
    dealt = found.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(count)).cast("long").alias("pack_group"), "*")
    ordered = dealt.repartition(count, "pack_group").sortWithinPartitions("pack_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(lambda batches: _pack_batches(batches, most), f"{PIECES}, sequence_id long, offset long")
