"""Operator 13: the fill-in-middle transformation, by a parallel automaton scan.

A text is cut into prefix, middle and suffix at counts of units (code points,
words or lines), and put together again in one of two orders between marks, or
left plain. An automaton over bytes counts the units and finds whether the text
holds a mark already. It is never run from a text's beginning: each piece of a
text gives, for every state it may be entered in, the state it is left in and the
units that end in it. Two such functions compose to one, and composing is
associative: bytes compose to lines of 64, lines to blocks of 4,096, blocks to
chunks. Composing from the left then gives the state and the count at which any
piece is entered, so that a cut is found by going down to the one block, line and
byte that holds it.

Texts of up to ``CHUNK`` bytes are transformed where they are, without a shuffle.
A longer one is dealt out in chunks of that size: chunks give their functions,
which are composed by text in a narrow table; the chunks that hold a cut find its
byte; and the output is a sequence of pieces, hashed as a stream. No task holds
more than some chunks of a giant text once it has left its row.

Results for odd rows: a null or empty text is plain, with n 0; so is a text that
holds a mark, its own or one across a chunk's border; a null doc_id is drawn for
as the empty string; repeated rows are each transformed, alike; extra columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_parts, stored, text_rows, text_slices, trim, utf8_of

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: What is hashed with a document's number to draw for it.
SEED = "1:"
#: Bytes of a chunk of a longer text.
CHUNK = 1 << 16
#: Pieces that are composed to one of the next level.
FAN = 64
#: Orders of the parts (0 prefix, 1 middle, 2 suffix) in the output.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


@dataclass(frozen=True)
class Automaton:
    """``step[state, class]`` is the next state and ``ends[state, class]`` the units that begin by a byte of
    ``kind``; state 0 begins. The last class changes nothing and fills up lines. ``marked[state]``: a mark was seen."""

    kind: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    marked: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)


def _mark_states(marks: tuple[str, ...]) -> tuple[list[bytes], bytes]:
    heads = sorted({m.encode()[:k] for m in marks for k in range(len(m.encode()))}, key=lambda h: (len(h), h))
    return heads, bytes(sorted({b for m in marks for b in m.encode()}))


@lru_cache(maxsize=8)
def automaton(units: str = "codepoints", marks: tuple[str, ...] = MARKS) -> Automaton:
    """The product of an automaton that counts units and one that finds marks."""
    heads, letters = _mark_states(marks)
    whole = {m.encode() for m in marks}
    # Classes of bytes: each letter of a mark, continuation bytes, white space, line ends, others.
    other, continued, blank, line = range(len(letters), len(letters) + 4)
    kind = np.full(256, other, np.uint8)
    kind[0x80:0xC0] = continued
    kind[[0x20, *range(0x09, 0x0E)]] = blank
    kind[0x0A] = line
    kind[list(letters)] = np.arange(len(letters))
    classes = line + 2
    inside = 2 if units in ("words", "lines") else 1  # whether a unit is open
    count = inside * (len(heads) + 1)
    step, ends = np.zeros((count, classes), np.uint8), np.zeros((count, classes), np.uint8)
    for state in range(count):
        open_, at = divmod(state, len(heads) + 1)
        for c in range(classes):
            if c == classes - 1:
                step[state, c] = state
                continue
            if units == "codepoints":
                now, begins = 0, c != continued
            elif units == "words":
                now = int(c not in (blank, line))
                begins = now > open_
            else:  # a line ends behind its line end; the next byte begins another
                now, begins = int(c != line), not open_
            to = at
            if at < len(heads):
                seen = heads[at] + (bytes([letters[c]]) if c < len(letters) else b"\xff")
                to = len(heads) if any(seen.endswith(m) for m in whole) else max(k for k, h in enumerate(heads) if seen.endswith(h))
            step[state, c], ends[state, c] = now * (len(heads) + 1) + to, begins
    return Automaton(kind, step, ends, np.array([s % (len(heads) + 1) == len(heads) for s in range(count)]))


@lru_cache(maxsize=8)
def _runs(units: str, marks: tuple[str, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many bytes are looked up at once, and the functions of all such runs of classes."""
    machine = automaton(units, marks)
    classes = machine.step.shape[1]
    width = next(w for w in (4, 2, 1) if classes**w <= 1 << 16)
    state, count = machine.step.T, machine.ends.T.astype(np.int32)
    for _ in range(width.bit_length() - 1):
        n, s = state.shape
        first = np.repeat(state, n, axis=0)
        state, count = np.take_along_axis(np.tile(state, (n, 1)), first, 1), np.repeat(count, n, axis=0) + np.take_along_axis(np.tile(count, (n, 1)), first, 1)
    return width, np.ascontiguousarray(state), np.ascontiguousarray(count)


def compose(state: np.ndarray, count: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Functions of runs of ``fan`` (a power of two) neighbours: by halves, each pair to one."""
    while fan > 1:
        first, second = state[0::2], state[1::2]
        count = count[0::2] + np.take_along_axis(count[1::2], first, 1)
        state = np.take_along_axis(second, first, 1)
        fan //= 2
    return state, count


class Scan:
    """The functions of several texts, by lines of FAN bytes and blocks of FAN lines."""

    def __init__(self, texts: list[bytes], units: str = "codepoints", marks: tuple[str, ...] = MARKS):
        self.machine, self.texts = automaton(units, marks), texts
        width, state, count = _runs(units, marks)
        classes, states = self.machine.step.shape[1], self.machine.states
        sizes = np.array([len(t) for t in texts], np.int64)
        lines = -(-sizes // FAN)
        padded = np.full(int(lines.sum()) * FAN, classes - 1, np.uint8)
        at = np.concatenate([[0], np.cumsum(lines)])
        for text, line in zip(texts, at[:-1].tolist(), strict=True):
            padded[line * FAN : line * FAN + len(text)] = self.machine.kind[np.frombuffer(text, np.uint8)]
        self.padded, self.line_at = padded, at
        code = padded.reshape(-1, width)
        code = (code @ (classes ** np.arange(width - 1, -1, -1, dtype=np.int32))).astype(np.int32)
        self.lines = compose(state[code], count[code], FAN // width)
        blocks = -(-lines // FAN)
        self.block_at = np.concatenate([[0], np.cumsum(blocks)])
        own = np.arange(len(self.lines[0])) + np.repeat(self.block_at[:-1] * FAN - at[:-1], lines)
        state, count = np.tile(np.arange(states, dtype=np.uint8), (int(blocks.sum()) * FAN, 1)), np.zeros((int(blocks.sum()) * FAN, states), np.int32)
        state[own], count[own] = self.lines
        self.blocks = compose(state, count, FAN)

    def function(self, k: int) -> tuple[list[int], list[int]]:
        """States and counts at the end of a text for each state at its beginning."""
        states, counts = list(range(self.machine.states)), [0] * self.machine.states
        for b in range(self.block_at[k], self.block_at[k + 1]):
            step, ends = self.blocks[0][b].tolist(), self.blocks[1][b].tolist()
            counts = [n + ends[s] for s, n in zip(states, counts, strict=True)]
            states = [step[s] for s in states]
        return states, counts

    def run(self, k: int, state: int = 0) -> tuple[int, int]:
        """State and count at the end of a text that is entered in a state."""
        count = 0
        for b in range(self.block_at[k], self.block_at[k + 1]):
            count += int(self.blocks[1][b, state])
            state = int(self.blocks[0][b, state])
        return state, count

    def place(self, k: int, unit: int, state: int = 0) -> int:
        """The byte at which a unit (from 0) of a text begins; its length where it has fewer."""
        for (steps, ends), first, last in ((self.blocks, self.block_at[k], self.block_at[k + 1]), (self.lines, None, None)):
            if first is None:
                first, last = self.line_at[k] + (b - self.block_at[k]) * FAN, min(self.line_at[k + 1], self.line_at[k] + (b - self.block_at[k] + 1) * FAN)
            for b in range(int(first), int(last)):
                if unit < ends[b, state]:
                    break
                unit -= int(ends[b, state])
                state = int(steps[b, state])
            else:
                return len(self.texts[k])
        at = b * FAN
        for byte in range(FAN):
            c = self.padded[at + byte]
            if self.machine.ends[state, c]:
                if unit == 0:
                    return (b - int(self.line_at[k])) * FAN + byte
                unit -= 1
            state = self.machine.step[state, c]
        raise AssertionError("a line has fewer units than its function says")


@dataclass(frozen=True)
class Draws:
    """What is drawn for a document."""

    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST
    seed: str = SEED

    def of(self, doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
        """Form, units of the prefix, units of prefix and middle."""
        digest = hashlib.sha256(f"{self.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return "plain" if not n or marked or h3 % 100 >= self.rate else "spm" if h4 % 100 < self.suffix_first else "psm", a, b


def assembled(parts: tuple[bytes, bytes, bytes], form: str, marks: tuple[str, ...] = MARKS) -> bytes:
    """The output of prefix, middle and suffix."""
    if form == "plain":
        return b"".join(parts)
    begins = (marks[0].encode(), marks[2].encode(), marks[1].encode())
    return b"".join(begins[p] + parts[p] for p in ORDERS[form])


SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _short_batches(batches: Iterator[pa.RecordBatch], draws: Draws, units: str, marks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = utf8_of(batch.column(1))
        scan, rows = Scan(texts, units, marks), []
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
            state, n = scan.run(k)
            form, a, b = draws.of(doc_id, n, bool(scan.machine.marked[state]))
            if form == "plain":
                rows.append((n, form, None, None, text))
                continue
            cut, end = scan.place(k, a), scan.place(k, b)
            rows.append((n, form, a, b - a, assembled((text[:cut], text[cut:end], text[end:]), form, marks)))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        columns[-1] = columns[-1].view(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def transform_short(docs: DataFrame, draws: Draws = Draws(), units: str = "codepoints", marks: tuple[str, ...] = MARKS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (units), output of the texts of a chunk at most."""
    rows = _id_and_text(docs, id_col, text_col).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk)
    return rows.mapInArrow(lambda batches: _short_batches(batches, draws, units, marks), f"{SHAPE}, output string")


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The exact text of an output, from it and its form alone."""
    prefix, suffix, middle = marks
    before = F.substring_index(output, middle, 1)  # all but the middle: no part holds a mark
    first, second = (prefix, suffix), (suffix, prefix)
    halves = {f: (F.substring_index(F.substring_index(before, b, 1), a, -1), F.substring_index(before, b, -1)) for f, (a, b) in (("psm", first), ("spm", second))}
    last = F.substring_index(output, middle, -1)
    return F.when(form == "psm", F.concat(halves["psm"][0], last, halves["psm"][1])).when(form == "spm", F.concat(halves["spm"][1], last, halves["spm"][0])).otherwise(output)


# Giant texts, by chunks.


def _chunk_batches(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each text by chunks, under a key of the row: the task and a number."""
    from pyspark import TaskContext

    task, row = TaskContext.get().partitionId(), 0
    for batch in text_slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8_of(batch.column(1)), strict=True):
            row += 1
            starts = range(0, len(text), chunk)
            for lot in range(0, len(starts), FAN):
                own = starts[lot : lot + FAN]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}:{row}"] * len(own)), pa.array([doc_id] * len(own), pa.int64()), pa.array([at // chunk for at in own], pa.int64()), pa.array([text[at : at + chunk] for at in own], pa.binary())],
                    ["row", "doc_id", "chunk", "bytes"],
                )


def _function_batches(batches: Iterator[pa.RecordBatch], units: str, marks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 3):
        scan = Scan(batch.column(3).to_pylist(), units, marks)
        found = [scan.function(k) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["row", "doc_id", "chunk", "states", "counts"]
        )


def _entered_batches(batches: Iterator[pa.RecordBatch], units: str, marks: tuple[str, ...], draws: Draws) -> Iterator[pa.RecordBatch]:
    """Sorted by row and falling chunk number in ``whole``: each chunk's state and count at its beginning, and,
    as chunk -1, those at the end of the text with what is drawn for it. One function is held at a time."""
    marked = automaton(units, marks).marked
    row = doc_id = None
    state = count = 0

    def ended() -> tuple:
        return (row, doc_id, -1, state, count, *draws.of(doc_id, count, bool(marked[state])))

    trim()
    for batch in batches:
        out = []
        for own, own_id, chunk, states, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != row:
                if row is not None:
                    out.append(ended())
                row, doc_id, state, count = own, own_id, 0, 0
            out.append((row, doc_id, chunk, state, count, None, None, None))
            state, count = states[state], count + counts[state]
        if out:
            yield _entered(out)
    if row is not None:
        yield _entered([ended()])


ENTERED = "row string, doc_id long, chunk long, state int, before long, form string, a long, b long"
ENTERED_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def _entered(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), ENTERED_TYPES, strict=True)], ["row", "doc_id", "chunk", "state", "before", "form", "a", "b"])


PIECES = "row string, doc_id long, n long, form string, prefix_chars long, middle_chars long, part int, chunk long, bytes binary"


def _piece_batches(batches: Iterator[pa.RecordBatch], units: str, marks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Chunks with their state and count at the beginning, cut where a part ends in them. A mark stands before
    each part, as chunk -1 of it, brought by the text's first chunk."""
    for batch in text_slices(batches, 3):
        texts = batch.column(3).to_pylist()
        scan, rows = Scan(texts, units, marks), []
        for k, (row, doc_id, chunk, text, state, before, n, form, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            shape = (row, doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a)
            if form == "plain":
                rows.append((*shape, 0, chunk, text))
                continue
            if chunk == 0:
                rows += [(*shape, p, -1, m.encode()) for p, m in zip((0, 2, 1), marks, strict=True)]
            # A unit before the chunk's first is cut before it, one behind its last behind it.
            cut, end = (0 if unit < before else scan.place(k, unit - before, state) for unit in (a, b))
            rows += [(*shape, p, chunk, piece) for p, piece in enumerate((text[:cut], text[cut:end], text[end:])) if piece]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "part", "chunk", "bytes"])


def transform_giant(
    spark: SparkSession, docs: DataFrame, draws: Draws = Draws(), units: str = "codepoints", marks: tuple[str, ...] = MARKS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The outputs of the texts of more than a chunk, by pieces: row (a key of the text), doc_id, n, form,
    prefix_chars, middle_chars, part (0 prefix, 1 middle, 2 suffix), chunk, bytes. ``in_output`` orders them."""
    rows = _id_and_text(docs, id_col, text_col).filter(F.octet_length("text") > chunk)
    chunks = stored(spark, rows.mapInArrow(lambda b: _chunk_batches(b, chunk), "row string, doc_id long, chunk long, bytes binary").repartition(shuffle_parts(spark), "row", "chunk"), "chunks")
    functions = chunks.mapInArrow(lambda b: _function_batches(b, units, marks), "row string, doc_id long, chunk long, states array<int>, counts array<long>")
    ordered = functions.repartition(shuffle_parts(spark), "row").sortWithinPartitions("row", "chunk")
    entered = stored(spark, ordered.mapInArrow(lambda b: _entered_batches(b, units, marks, draws), ENTERED), "entered")
    whole = entered.filter("chunk = -1").select("row", F.col("before").alias("n"), "form", "a", "b")
    placed = entered.filter("chunk >= 0").select("row", "chunk", "state", "before").join(whole, "row")
    told = chunks.join(placed, ["row", "chunk"]).select("row", "doc_id", "chunk", "bytes", "state", "before", "n", "form", "a", "b")
    return told.mapInArrow(lambda b: _piece_batches(b, units, marks), PIECES)


def in_output() -> Column:
    """The place of a piece's part in the output."""
    orders = [F.when(F.col("form") == form, F.element_at(F.array(*(F.lit(order.index(p)) for p in range(3))), F.col("part") + 1)) for form, order in ORDERS.items()]
    return F.coalesce(*orders, F.col("part"))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by way, row and place: SHA-256 of each way's stream of pieces, one piece held at a time."""
    key = digest = shape = None

    def ended() -> pa.RecordBatch:
        values = [*key, *shape, digest.hexdigest()]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["way", "row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "sha256"])

    trim()
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if values[:2] != key:
                if key is not None:
                    yield ended()
                key, shape, digest = values[:2], values[2:7], hashlib.sha256()
            digest.update(values[7])
    if key is not None:
        yield ended()


def giant_digests(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of outputs by pieces. The text is
    restored from the pieces of the output: without its marks, the parts by number."""
    shape = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    ways = F.explode(F.when(F.col("chunk") < 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("way")
    both = pieces.select(ways, "row", *shape, "bytes", F.when(F.col("chunk") < 0, F.lit(-1)).otherwise(F.col("chunk")).alias("chunk"), "part", in_output().alias("place"))
    both = both.withColumn("place", F.when(F.col("way") == 0, F.col("place")).otherwise(F.col("part")))
    ordered = both.repartition(shuffle_parts(spark), "row", "way").sortWithinPartitions("way", "row", "place", "chunk").select("way", "row", *shape, "bytes")
    found = ordered.mapInArrow(_digest_batches, "way int, row string, doc_id long, n long, form string, prefix_chars long, middle_chars long, sha256 string")
    sha = {w: F.max(F.when(F.col("way") == w, F.col("sha256"))) for w in (0, 1)}
    return found.groupBy("row", *shape).agg(sha[0].alias("output_sha256"), sha[1].alias("restored_sha256")).drop("row")


def digests(spark: SparkSession, docs: DataFrame, draws: Draws = Draws(), units: str = "codepoints", marks: tuple[str, ...] = MARKS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n, form, units of prefix and middle, and the SHA-256 of the output and of the text restored from it."""
    how = {"draws": draws, "units": units, "marks": marks, "chunk": chunk, "id_col": id_col, "text_col": text_col}
    short = transform_short(docs, **how)
    short = short.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"))
    return short.unionByName(giant_digests(spark, transform_giant(spark, docs, **how)))
