"""Operator 9: substring dedup by compact windows.

A text is a row of five-word shingles; what is compared are runs of ``SPAN``
shingles (50 words). Two runs of similarity 0.8 differ in five shingles at most,
so they share an unbroken stretch of ``STRETCH`` shingles, and any hash function's
least shingle of that stretch is the same in both texts. The Cartesian tree of a
function's hashes groups all runs with the same least shingle into one compact
window (left, centre, right); windows of ``STRETCH`` shingles and more are all that
is needed, so every pair that can reach the similarity collides under every
function. Windows meet by signature; the interval join then asks that the windows
of all functions overlap, at the same offset, in a stretch of that length.

Within a signature, windows with the same 46 shingles about their centre are a
class, whose members are linked to its first one. Classes are linked pairwise
where the ten shingles before or after the centre agree too (a shared stretch has
one or the other). Signatures of more than ``PAIRS`` classes are linked through
their ``LEADERS`` largest classes; signatures frequent within a map task are linked
there first and send their leaders on, so no group grows with the corpus faster
than its tasks. Windows of such signatures are searched again by their runs. Where no
earlier document is verified, all runs around a window are grouped by a digest of
their shingles, and linked to the first of the equal ones. Near runs are met by gaps:
two runs of similarity 0.8 whose larger unbroken part holds the window differ by one
word written, left out or put in, and so agree in all but one of ``len(GAPS)`` parts.
The digests of a run without one part, its rest taken at once and one shingle later,
are grouped; of equal runs in a group only the first takes part, and each is linked to
the first of its group and to those just before it. These links are verified like the
others.

Links are verified on the shingles (32-bit hashes) of both texts, a stretch of
SPAN at a time. What is returned begins and ends with a shingle that both have, and
holds only runs that reach the similarity, joined where they meet.

Results for odd rows: a null, empty or short text has no passage; repeats within
one document are not reported; rows that repeat a doc_id count as one document,
whose passages are those of any of its texts; of equal passages the one with the
smaller doc_id is the representative; a null doc_id takes no part; an empty table
gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, SLICE_BYTES, forget, release, slices, text_rows, text_slices, utf8_of, whole_groups
from ._common import stored as written

SHINGLE, SPAN, STRETCH, FUNCTIONS = 5, 46, 21, 2
SIMILARITY = 0.8
#: Classes of a signature up to which all pairs are linked; leaders of a signature with more;
#: equal signatures of a slice from which they are linked within it first.
PAIRS, LEADERS, FREQUENT = 32, 8, 32
#: Difference of offsets within one passage.
SHIFT = 12
#: Shingles about a centre that a shared stretch must hold on one side.
SIDE = STRETCH // 2
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder; the shuffles behind it, which hold as much as the input, go at once."""
    out = written(spark, df, name)
    release(spark)
    return out


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX[k]
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles end to end, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    bounds = lists.offsets.to_numpy()
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    own = np.array([xxhash.xxh64_intdigest(w, 9) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[words.indices.to_numpy()]
    total = np.zeros(max(0, len(own) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += mixed(own[k : len(own) - SHINGLE + 1 + k], k)
    sizes = np.diff(bounds)
    counts = np.maximum(0, sizes - SHINGLE + 1)
    starts = bounds[:-1] - bounds[0]
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return mixed(total[at], 5) | np.uint64(1), counts


def running(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of each run of ``width`` values, in linear time."""
    pick, fill = (np.minimum, np.uint64((1 << 64) - 1)) if least else (np.maximum, np.uint64(0))
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, fill)]).reshape(-1, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def compact_windows(values: np.ndarray, span: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, centre, right of all compact windows of at least ``span`` values.

    A value of zero parts documents: no window holds one. Among equal values the
    leftmost is the parent.
    """
    none = np.empty(0, np.int64)
    if len(values) < span:
        return none, none, none
    least = running(values, span, True)
    edge = np.full(span - 1, 0, np.uint64)
    chosen = np.flatnonzero((running(np.concatenate([edge, least, edge]), span, False) == values) | (values == 0))
    held = values[chosen].tolist()
    left, right, stack = np.zeros(len(chosen), np.int64), np.full(len(chosen), len(values) - 1), []
    places = chosen.tolist()
    for i, v in enumerate(held):
        while stack and held[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    keep = (right - left + 1 >= span) & (values[chosen] != 0)
    return left[keep], chosen[keep], right[keep]


def _laid_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each place, first place of each text, and which places hold shingles: one zero parts texts."""
    row_of = np.repeat(np.arange(len(counts)), counts + 1)
    first = np.cumsum(counts + 1) - counts - 1
    body = np.ones(len(row_of), bool)
    body[first + counts] = False
    return row_of, first, body


def _digests(hashes: np.ndarray, body: np.ndarray):
    """A function that gives digests of the places from a to b (exclusive)."""
    values = np.zeros(len(body), np.uint64)
    values[body] = mixed(hashes, 6)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return lambda a, b: mixed(sums[b] - sums[a], 7)


WINDOWS = "sign long, doc long, mid int, context long, extent int"
#: Flags beside the two sides' lengths in ``extent``: the row stands for a slice's class; it is of a signature frequent in its slice.
STANDS, OF_MANY = 1 << 16, 1 << 17


def _contexts(digest, mid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Digests of what surrounds each centre: 46 shingles (32 bits), ten before and ten after it
    with the centre (15 bits each, zero where the text has fewer)."""
    at = np.clip(mid - SPAN // 2, lo, hi - SPAN)
    run = mixed(digest(at, at + SPAN) + (mid - at).astype(np.uint64), 4) >> np.uint64(33)
    before = digest(np.maximum(lo, mid - SIDE), mid + 1) >> np.uint64(49) | np.uint64(1)
    after = digest(mid, np.minimum(hi, mid + SIDE + 1)) >> np.uint64(49) | np.uint64(1)
    before[mid - SIDE < lo] = 0
    after[mid + SIDE >= hi] = 0
    return (run << np.uint64(32) | before << np.uint64(16) | after).astype(np.int64)


def _ranked(sign: np.ndarray, context: np.ndarray, doc: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by signature and falling class size: (order, the class of each, its first
    row, the rank of the class in its signature), all in that order."""
    order = np.lexsort((mid, doc, context >> 32, sign))
    s, c = sign[order], context[order] >> 32
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 0) | (np.diff(c) != 0)]))
    sizes = np.diff(np.append(starts, len(s)))
    by_size = np.lexsort((doc[order][starts], -sizes, s[starts]))
    starts, sizes = starts[by_size], sizes[by_size]
    rows = np.repeat(starts, sizes) + np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    class_sign = s[starts]
    new = np.concatenate([[True], np.diff(class_sign) != 0])
    rank = np.arange(len(starts)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(starts))))
    firsts = np.cumsum(sizes) - sizes
    return order[rows], np.repeat(np.arange(len(starts)), sizes), firsts, rank


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the signatures, centres and surroundings of each document's compact windows."""
    for batch in text_slices(batches):
        hashes, counts = shingles(batch.column(1))
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not (counts >= SPAN).any():
            continue
        row_of, first, body = _laid_out(counts)
        digest = _digests(hashes, body)
        values = np.zeros(len(row_of), np.uint64)
        found = []
        for k in range(FUNCTIONS):
            values[body] = mixed(hashes, k) | np.uint64(8)
            left, mid, right = compact_windows(values)
            long = counts[row_of[mid]] >= SPAN
            left, mid, right = left[long], mid[long], right[long]
            row = row_of[mid]
            extent = np.minimum(mid - left, SPAN) << 8 | np.minimum(right - mid, SPAN)
            found.append(((values[mid] & ~np.uint64(7)) | np.uint64(k), row, mid - first[row], _contexts(digest, mid, first[row], first[row] + counts[row]), extent))
        sign, row, mid, context, extent = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = docs[row]
        names, at, sizes = np.unique(sign, return_inverse=True, return_counts=True)
        many = np.flatnonzero(sizes[at] > FREQUENT)
        if len(many):
            # Frequent here: a group of its own for this slice, whose largest classes also stand for it among all slices.
            order, of_class, firsts, rank = _ranked(sign[many], context[many], doc[many], mid[many])
            stand = many[order[firsts[rank < LEADERS]]]
            extra = sign[stand], doc[stand], mid[stand], context[stand], extent[stand] | STANDS
            salt = mixed(names ^ docs[:1].astype(np.uint64) * MIX[6], 5)  # by the first document of the slice
            sign, extent = sign.copy(), extent.copy()
            sign[many] = (salt[at[many]] & ~np.uint64(7)) | (sign[many] & np.uint64(7))
            extent[many] |= OF_MANY
            sign, doc, mid, context, extent = (np.concatenate(x) for x in zip((sign, doc, mid, context, extent), extra, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(doc), pa.array(mid.astype(np.int32)), pa.array(context), pa.array(extent.astype(np.int32))], ["sign", "doc", "mid", "context", "extent"])


LINKS = "doc long, rep long, offset int, mid int, extent int, function int"


def _linked(sign, doc, mid, context, extent) -> Iterator[pa.RecordBatch]:
    """Links of whole signatures; rows without a rep mark windows whose partners may not all be among them."""
    order, of_class, firsts, rank = _ranked(sign, context, doc, mid)
    sign, doc, mid, context, extent = (x[order] for x in (sign, doc, mid, context, extent))
    first_of = firsts[of_class]
    rows = np.arange(len(sign))
    left, right = [rows[rows != first_of]], [first_of[rows != first_of]]
    # Between classes: their first rows, in order of rank within each signature.
    before, after = (context >> 16) & 0xFFFF, context & 0xFFFF
    class_sign = sign[firsts]
    group = np.cumsum(np.concatenate([[0], np.diff(class_sign) != 0]))
    classes = np.bincount(group)
    crowded = classes[group] > PAIRS
    alike = lambda i, j: (doc[i] != doc[j]) & (((before[i] == before[j]) & (before[i] != 0)) | ((after[i] == after[j]) & (after[i] != 0)))
    index = np.arange(len(firsts))
    for lag in range(1, int(min(classes.max(), PAIRS))):
        own = index[~crowded & (rank >= lag)]
        if not len(own):
            break
        i, j = firsts[own], firsts[own - lag]
        keep = alike(i, j)
        left.append(i[keep])
        right.append(j[keep])
    if crowded.any():
        for lead in range(LEADERS):
            own = index[crowded & (rank > lead)]
            i, j = firsts[own], firsts[own - rank[own] + lead]
            keep = alike(i, j)
            left.append(i[keep])
            right.append(j[keep])
    a, b = np.concatenate(left), np.concatenate(right)
    keep = doc[a] != doc[b]
    a, b = a[keep], b[keep]
    later = doc[a] > doc[b]
    a, b = np.where(later, a, b), np.where(later, b, a)
    sides = np.minimum(extent[a] & 0xFF00, extent[b] & 0xFF00) | np.minimum(extent[a] & 0xFF, extent[b] & 0xFF)
    function = sign & 7
    # Of crowded signatures: windows that some other class shares a side with. Of those frequent in a slice: all.
    open_rows = extent & OF_MANY != 0
    if crowded.any():
        wide = crowded[of_class]
        shared = np.zeros(len(sign), bool)
        for side in (before, after):
            code = sign[wide] * 31 + side[wide]
            _, at, n = np.unique(code, return_inverse=True, return_counts=True)
            shared[wide] |= (n[at] > 1) & (side[wide] != 0)
        open_rows |= shared
    marks = np.flatnonzero(open_rows & (extent & STANDS == 0))
    for at in range(0, len(a), 16 * BATCH_ROWS):
        i, j = a[at : at + 16 * BATCH_ROWS], b[at : at + 16 * BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(doc[j]), *(pa.array(x.astype(np.int32)) for x in (mid[i] - mid[j], mid[i], sides[at : at + 16 * BATCH_ROWS], function[i]))], ["doc", "rep", "offset", "mid", "extent", "function"])
    if len(marks):
        none = pa.nulls(len(marks), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(doc[marks]), pa.nulls(len(marks), pa.int64()), none, pa.array(mid[marks].astype(np.int32)), none, pa.array(function[marks].astype(np.int32))], ["doc", "rep", "offset", "mid", "extent", "function"])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by signature -> links of documents."""
    for columns in whole_groups(batches, 1):
        sign, doc, mid, context, extent = (c.to_numpy() for c in columns)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(sign) != 0]))
        sizes = np.diff(np.append(starts, len(sign)))
        keep = np.repeat(sizes > 1, sizes)
        if keep.any():
            yield from _linked(*(x[keep] for x in (sign, doc, mid, context, extent)))


SPOTS = "doc long, rep long, place int, rep_place int"


def _spot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted by document pair -> the stretches to verify: where the windows of all functions overlap."""
    for columns in whole_groups(batches, 2):
        doc, rep, offset, mid, extent, function = (c.to_numpy() for c in columns)
        order = np.lexsort((mid, offset, rep, doc))
        doc, rep, offset, mid, extent, function = (x[order] for x in (doc, rep, offset, mid, extent, function))
        lo, hi = mid - (extent >> 8), mid + (extent & 0xFF)
        met = np.zeros(len(doc), bool)
        for lag in range(1, min(len(doc), 7)):
            i, j = slice(None, -lag), slice(lag, None)
            both = (doc[i] == doc[j]) & (rep[i] == rep[j]) & (offset[i] == offset[j]) & (function[i] != function[j])
            a, b = np.maximum(lo[i], lo[j]), np.minimum(hi[i], hi[j])
            both &= (b - a + 1 >= STRETCH) & (a <= mid[i]) & (mid[j] <= b)
            met[i] |= both
            met[j] |= both
        # Stretches lie on a grid of the representative's places: many documents ask for the same ones.
        doc, rep, offset, cell = doc[met], rep[met], offset[met], (mid[met] - offset[met]) // SPAN
        order = np.lexsort((offset, cell, rep, doc))
        doc, rep, offset, cell = doc[order], rep[order], offset[order], cell[order]
        if len(doc):
            once = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(rep) != 0) | (np.diff(cell) != 0) | (np.diff(offset) != 0)])
            doc, rep, offset, cell = doc[once], rep[once], offset[once], cell[once]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rep), *(pa.array(x.astype(np.int32)) for x in (cell * SPAN + offset, cell * SPAN))], ["doc", "rep", "place", "rep_place"])


#: Shingles before a stretch, and from its start on, that runs with a place in it and shifts can reach.
BEFORE, AFTER = SPAN - 1 + SHIFT, 2 * SPAN - 1 + SHIFT
WIDTH = BEFORE + AFTER
CONTEXT_BYTES = 1 << 20
AROUND = "at_doc long, at_place int, around binary"


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, places) -> the shingles around each place as 32-bit hashes, zero outside the text."""
    for batch in text_slices(batches, most=CONTEXT_BYTES):
        hashes, counts = shingles(batch.column(1))
        starts = np.cumsum(counts) - counts
        lists = batch.column(2)
        places = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        row = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy()))
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        short = ((hashes >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
        for at in range(0, len(places), BATCH_ROWS):
            p, r = places[at : at + BATCH_ROWS].astype(np.int64), row[at : at + BATCH_ROWS]
            index = p[:, None] + np.arange(-BEFORE, AFTER)
            inside = (index >= 0) & (index < counts[r][:, None])
            around = np.where(inside, short[np.where(inside, starts[r][:, None] + index, 0)], np.uint32(0))
            raw = pa.Array.from_buffers(pa.binary(4 * WIDTH), len(p), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(docs[r]), pa.array(p.astype(np.int32)), raw], ["at_doc", "at_place", "around"])


def compared(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(B, n) shingles of both sides, zero outside the texts -> for each run of SPAN places how many
    of its shingles the other side's run about the same place shares, -1 where it leaves the text; and
    where each shingle lies on the other side, relative to its own place (SHIFT + 1 where nowhere)."""
    n = own.shape[1]
    padded = np.pad(other, ((0, 0), (SHIFT, SHIFT)))
    mine, theirs = np.full(own.shape, SHIFT + 1, np.int8), np.zeros(padded.shape, bool)
    for s in sorted(range(-SHIFT, SHIFT + 1), key=abs, reverse=True):
        same = (own == padded[:, SHIFT + s : SHIFT + s + n]) & (own != 0)
        mine[same] = s
        theirs[:, SHIFT + s : SHIFT + s + n] |= same
    window = lambda x: (lambda c: c[:, SPAN:] - c[:, :-SPAN])(np.pad(np.cumsum(x, axis=1, dtype=np.int16), ((0, 0), (1, 0))))
    ahead, back = window(mine <= SHIFT), window(theirs)
    most = np.lib.stride_tricks.sliding_window_view(back, 2 * SHIFT + 1, axis=1).max(2)
    common = np.minimum(ahead, most)
    common[window(own != 0) < SPAN] = -1
    return common, mine


FOUND = "doc long, rep long, offset int, lo int, hi int, rep_lo int, rep_hi int, similarity double"
FOUND_NAMES = ["doc", "rep", "offset", "lo", "hi", "rep_lo", "rep_hi", "similarity"]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with both sides' shingles -> the shingles of the runs that reach the similarity."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            doc, rep, place, rep_place = (batch.column(i).to_numpy() for i in range(4))
            own, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, WIDTH) for i in (4, 5))
            common, shift = compared(own, other)
            similarity = common / (2 * SPAN - common)
            row, run = np.nonzero(similarity >= SIMILARITY)
            if not len(row):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(run) > SPAN)]))
            ends = np.append(starts[1:], len(row)) - 1
            best = np.maximum.reduceat(similarity[row, run], starts)
            # From the first to the last shingle that both sides have.
            r, a, b = row[starts], run[starts], run[ends] + SPAN
            inside = (np.arange(WIDTH) >= a[:, None]) & (np.arange(WIDTH) < b[:, None]) & (shift[r] <= SHIFT)
            a, b = inside.argmax(1), WIDTH - 1 - inside[:, ::-1].argmax(1)
            lo, hi = place[r] - BEFORE + a, place[r] - BEFORE + b + 1
            rep_lo, rep_hi = rep_place[r] - BEFORE + a + shift[r, a], rep_place[r] - BEFORE + b + shift[r, b] + 1
            columns = [pa.array(doc[r]), pa.array(rep[r]), *(pa.array(x.astype(np.int32)) for x in (place[r] - rep_place[r], lo, hi, rep_lo, rep_hi)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, FOUND_NAMES)


# -- exact runs about windows whose partners were not all looked at -----------


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, lo, hi, mark), sorted by document: found shingles, or a mark's place and function -> marks, and whether they are open: outside of all that is found."""
    for columns in whole_groups(batches, 1):
        doc, lo, hi, mark = (c.to_numpy(zero_copy_only=False) for c in columns)
        far = doc.astype(np.float64)
        order = np.lexsort((-hi, mark, lo, doc))  # intervals (mark -1) before marks of the same place
        doc, lo, hi, mark, far = (x[order] for x in (doc, lo, hi, mark, far))
        starts = np.concatenate([[True], np.diff(doc) != 0])
        group = np.cumsum(starts)
        reach = np.maximum.accumulate(group * (1 << 32) + np.where(mark < 0, hi, 0).astype(np.int64)) - group * (1 << 32)
        keep = mark >= 0
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array((lo[keep].astype(np.int64) * 8 + mark[keep])), pa.array((reach <= lo)[keep])], ["doc", "mark", "open"])


RUNS = "digest long, doc long, start int, rep long, rep_start int, content int"
#: Lowest bit of a digest: that of a run without a gap.
GAPPED = np.uint64(1)
#: Shingles of a run that a gap leaves out, and where gaps begin: an edited word breaks five
#: shingles, which lie in the gap that begins at or before the first of them.
GAP = 2 * SHINGLE
GAPS = range(0, SPAN - GAP + 1, GAP - SHINGLE + 1)
#: Rows of a digest that each is linked to beside the first: those before it.
NEXT = 8


def _codes(lists: pa.ListArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks (place and function) of each text, and the row of each."""
    codes = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    at_row = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy()))
    fits = codes >> 3 < counts[at_row]
    return codes[fits], at_row[fits]


def _marked(values: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Whether the least value of each stretch of ``width`` places is at one of the places."""
    least = running(values, width, True)
    own = np.full(len(values), (1 << 64) - 1, np.uint64)
    own[places] = values[places]
    return (least != 0) & (running(own, width, True) == least)


def _firsts(digest: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by digest, document and start; and for each the first of its digest, in that order."""
    order = np.lexsort((start, doc, digest))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(digest[order]) != 0]))
    return order, np.repeat(starts, np.diff(np.append(starts, len(order))))


def _run_rows(digest, doc, start, rep, rep_start, gapped: bool, content: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS; of those that are their own representative no rep is given. Others of their representative's document are left out."""
    alone = (doc == rep) & (start == rep_start)
    if not gapped:
        kept = alone | (doc != rep)
        digest, doc, start, rep, rep_start, content, alone = (x[kept] for x in (digest, doc, start, rep, rep_start, content, alone))
    digest = digest | GAPPED if gapped else digest & ~GAPPED
    for k in range(0, len(doc), 8 * BATCH_ROWS):
        part = slice(k, k + 8 * BATCH_ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(digest[part].view(np.int64)),
                pa.array(doc[part]),
                pa.array(start[part].astype(np.int32)),
                pa.array(rep[part], mask=alone[part]),
                pa.array(rep_start[part].astype(np.int32), mask=alone[part]),
                pa.array((content[part] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            ],
            ["digest", "doc", "start", "rep", "rep_start", "content"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> the text compressed, and its size."""
    codec = pa.Codec("zstd", 1)
    for batch in slices(batches):
        texts = utf8_of(batch.column(1))
        packed = pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array([len(x) for x in texts], pa.int32())], ["doc_id", "packed", "size"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed, other columns, size) -> the text in the place of the packed one, a few megabytes at once."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1).to_numpy()
        at = 0
        while at < len(sizes):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, "right")))
            part = batch.slice(at, to - at)
            texts = pa.array([codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(part.column(1).to_pylist(), sizes[at:to].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), texts.cast(pa.string()), *part.columns[2:-1]], ["doc", "text", *part.schema.names[2:-1]])
            at = to


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed text, open marks, all marks, size) -> a digest of each run of SPAN shingles whose least one is
    an open mark; equal runs of a slice are linked to its first, which alone goes on (without rep).
    Then, of the different runs of a slice whose first or last stretch has a marked shingle as its
    least, the digests without each gap of the other part."""
    for batch in text_slices(_unpacked(batches)):
        hashes, counts = shingles(batch.column(1))
        row_of, first, body = _laid_out(counts)
        if len(row_of) < SPAN:
            continue
        digest = _digests(hashes, body)
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(row_of) - SPAN + 1
        runs, head, tail = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        values = np.zeros(len(row_of), np.uint64)
        marks = [_codes(batch.column(c), counts) for c in (2, 3)]
        for k in range(FUNCTIONS):
            values[body] = mixed(hashes, k) | np.uint64(8)
            (places, _), (all_places, _) = ((first[rows[codes & 7 == k]] + (codes[codes & 7 == k] >> 3), None) for codes, rows in marks)
            runs |= _marked(values, places, SPAN)
            stretch = _marked(values, all_places, STRETCH)
            head |= stretch[:n]
            tail |= stretch[SPAN - STRETCH :]
        at = np.flatnonzero(runs)
        if len(at):
            order, one = _firsts(digest(at, at + SPAN), docs[row_of[at]], at)
            at = at[order]
            place, doc = at - first[row_of[at]], docs[row_of[at]]
            own = digest(at, at + SPAN)
            yield from _run_rows(own, doc, place, doc[one], place[one], False, own)
        whole = running(values, SPAN, True) != 0
        for part, gaps in ((head, [g for g in GAPS if g + GAP - SHINGLE >= STRETCH]), (tail, [g for g in GAPS if g <= SPAN - STRETCH - SHINGLE])):
            at = np.flatnonzero(part & whole)
            if not len(at):
                continue
            order, one = _firsts(digest(at, at + SPAN), docs[row_of[at]], at)
            at = at[order[one == np.arange(len(at))]]
            for gap in gaps:
                for late in (0, 1):
                    fits = at[at + SPAN + late <= first[row_of[at]] + counts[row_of[at]]]
                    key = mixed(digest(fits, fits + gap) + mixed(digest(fits + gap + GAP + late, fits + SPAN + late), 3) + np.uint64(gap), 4)
                    place, doc = fits - first[row_of[fits]], docs[row_of[fits]]
                    yield from _run_rows(key, doc, place, doc, place, True, digest(fits, fits + SPAN))


class _GappedRuns:
    """Digests without a gap, sorted with content, document and start -> the stretches to verify of
    each content's first run with the first of its digest and with those just before it. Keeps a few rows between batches."""

    def __init__(self):
        self.last = self.seen = None

    def __call__(self, digest, content, doc, start) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[self.seen != (digest[0], content[0])], (np.diff(digest) != 0) | (np.diff(content) != 0)])
        self.seen = digest[-1], content[-1]
        digest, doc, start = digest[new], doc[new], start[new]
        if not len(doc):
            return
        order = np.lexsort((start, doc, digest))
        digest, doc, start = digest[order], doc[order], start[order]
        # Ahead go the first run of the digest that the last batch ended in, and its last ones.
        ahead = 0 if self.last is None else len(self.last[0])
        if ahead:
            digest, doc, start = (np.concatenate([x, y]) for x, y in zip(self.last, (digest, doc, start), strict=True))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(digest) != 0]))
        one = np.repeat(starts, np.diff(np.append(starts, len(digest))))
        carried = np.unique(np.concatenate([one[-1:], np.arange(max(one[-1], len(digest) - NEXT), len(digest))]))
        self.last = tuple(x[carried] for x in (digest, doc, start))
        new = np.arange(ahead, len(digest))
        new = new[one[new] != new]  # the first of a digest has none before it
        if not len(new):
            return
        rows, rep = np.tile(new, NEXT + 1), np.concatenate([one[new], *(np.maximum(new - lag, one[new]) for lag in range(1, NEXT + 1))])
        own = doc[rows] != doc[rep]
        rows, rep = rows[own], rep[own]
        later = doc[rows] > doc[rep]
        rows, rep = np.where(later, rows, rep), np.where(later, rep, rows)
        if not len(rows):
            return
        offset, cell = start[rows] - start[rep], start[rep] // SPAN
        asked = np.unique(np.stack([doc[rows], doc[rep], cell * SPAN + offset, cell * SPAN]), axis=1)
        none = pa.nulls(asked.shape[1], pa.int32())
        places = [pa.array(x.astype(np.int32)) for x in asked[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(asked[0]), pa.array(asked[1]), none, places[0], none, places[1], none, pa.nulls(asked.shape[1], pa.float64())], FOUND_NAMES)


class _EqualRuns:
    """Runs sorted by digest, document and start -> each one's link to the first with the same digest. Keeps a row between batches."""

    def __init__(self):
        self.last = None

    def __call__(self, digest, doc, start) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], np.diff(digest) != 0]))
        one = np.repeat(starts, np.diff(np.append(starts, len(digest))))
        rep, rep_start = doc[one], start[one]
        if self.last is not None and self.last[0] == digest[0]:
            rep[one == 0], rep_start[one == 0] = self.last[1:]
        self.last = digest[-1], rep[-1], rep_start[-1]
        own = doc != rep
        yield _exact_batch(doc[own], start[own], rep[own], rep_start[own])


def _met_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS sorted by digest, content, document and start -> links of equal runs, and (without a
    similarity) the stretches to verify of runs that agree but for a gap. Holds a batch at a time."""
    equal, gapped = _EqualRuns(), _GappedRuns()
    for batch in batches:
        linked = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        if linked.any():
            doc, start, rep, rep_start = (batch.column(i).filter(pa.array(linked)).to_numpy() for i in range(1, 5))
            yield _exact_batch(doc, start, rep, rep_start)
        digest, doc, start, content = (batch.column(i).to_numpy()[~linked] for i in (0, 1, 2, 5))
        own = digest & 1 == 1
        if not own.all():
            yield from equal(digest[~own], doc[~own], start[~own])
        if own.any():
            yield from gapped(digest[own], content[own], doc[own], start[own])


def _exact_batch(doc, start, rep, rep_start) -> pa.RecordBatch:
    columns = [pa.array(doc), pa.array(rep), *(pa.array(x.astype(np.int32)) for x in (start - rep_start, start, start + SPAN, rep_start, rep_start + SPAN)), pa.array(np.ones(len(doc)))]
    return pa.RecordBatch.from_arrays(columns, FOUND_NAMES)


def _by_runs(spark: SparkSession, rows: DataFrame, marks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Links of equal runs about the marked windows that lie in no passage found; and the stretches
    to verify of runs about all marked windows that agree but for a gap."""
    marks = marks.select("doc", F.col("mid").alias("lo"), F.col("mid").alias("hi"), F.col("function").alias("mark"))
    own = found.select("doc", "lo", "hi", F.lit(-1).alias("mark")).join(marks.select("doc").distinct(), "doc", "left_semi")
    open_marks = own.union(marks).repartition("doc").sortWithinPartitions("doc").mapInArrow(_uncovered, "doc long, mark long, open boolean")
    wanted = stored(spark, open_marks.groupBy("doc").agg(F.collect_set(F.expr("CASE WHEN open THEN mark END")).alias("open"), F.collect_set("mark").alias("marks")), "marks")
    if wanted.isEmpty():
        return None
    # Runs meet by one shuffle, and are not written before it; texts, whose shuffle is there beside it, go packed.
    packed = rows.mapInArrow(_packed, "doc_id long, packed binary, size int")
    runs = packed.join(wanted, packed["doc_id"] == wanted["doc"]).select("doc_id", "packed", "open", "marks", "size").mapInArrow(_run_batches, RUNS)
    met = stored(spark, runs.repartition("digest").sortWithinPartitions("digest", "content", "doc", "start").mapInArrow(_met_runs, FOUND), "met")
    forget(spark, wanted)
    return met.filter("similarity IS NOT NULL"), met.filter("similarity IS NULL").select("doc", "rep", F.col("lo").alias("place"), F.col("rep_lo").alias("rep_place")).dropDuplicates()


def _verified(spark: SparkSession, rows: DataFrame, spots: DataFrame, repeated: bool) -> DataFrame:
    """The runs that reach the similarity within the stretches of both documents."""
    asked = spots.select(F.col("doc").alias("ask_doc"), "place").union(spots.select("rep", "rep_place")).groupBy("ask_doc").agg(F.collect_set("place").alias("places"))
    places = rows.join(asked, rows["doc_id"] == asked["ask_doc"]).select("doc_id", "text", "places").mapInArrow(_context_batches, AROUND)
    around = stored(spark, places.dropDuplicates() if repeated else places, "around")
    own = around.select(F.col("at_doc").alias("doc"), F.col("at_place").alias("place"), F.col("around").alias("own"))
    other = around.select(F.col("at_doc").alias("rep"), F.col("at_place").alias("rep_place"), F.col("around").alias("other"))
    sides = spots.join(own, ["doc", "place"]).join(other, ["rep", "rep_place"])
    near = stored(spark, sides.select("doc", "rep", "place", "rep_place", "own", "other").mapInArrow(_verify_batches, FOUND), "near")
    forget(spark, around)
    return near


PASSAGES = "doc_id long, start_word int, end_word int, rep_doc_id long, rep_start_word int, rep_end_word int, similarity double"


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by document pair -> passages: runs of like offset that meet are one."""
    for columns in whole_groups(batches, 2):
        doc, rep, offset, lo, hi, rep_lo, rep_hi, similarity = (c.to_numpy() for c in columns)
        order = np.lexsort((offset, rep, doc))
        apart = (np.diff(doc[order]) != 0) | (np.diff(rep[order]) != 0) | (np.diff(offset[order]) > SHIFT)
        cluster = np.cumsum(np.concatenate([[0], apart]))
        again = np.lexsort((lo[order], cluster))
        order, cluster = order[again], cluster[again]
        doc, rep, lo, hi, rep_lo, rep_hi, similarity = (x[order] for x in (doc, rep, lo, hi, rep_lo, rep_hi, similarity))
        far = cluster.astype(np.int64) << 32
        starts = np.flatnonzero(np.concatenate([[True], (lo + far)[1:] > np.maximum.accumulate(hi + far)[:-1]]))
        least, most = (lambda x: np.minimum.reduceat(x, starts)), (lambda x: np.maximum.reduceat(x, starts))
        words = np.int32(SHINGLE - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[starts], least(lo), most(hi) + words, rep[starts], least(rep_lo), most(rep_hi) + words, most(similarity))],
            ["doc_id", "start_word", "end_word", "rep_doc_id", "rep_start_word", "rep_end_word", "similarity"],
        )


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of 50 words or more that a document shares with one of a smaller
    doc_id: where it is (words, the end exclusive), and where that representative has it."""
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    windows = rows.mapInArrow(_window_batches, WINDOWS)
    links = stored(spark, windows.repartition("sign").sortWithinPartitions("sign").mapInArrow(_link_batches, LINKS), "links")
    pairs = links.filter("rep IS NOT NULL").repartition("doc", "rep").sortWithinPartitions("doc", "rep")
    spots = stored(spark, pairs.mapInArrow(_spot_batches, SPOTS), "spots")
    marks = stored(spark, links.filter("rep IS NULL").select("doc", "mid", "function"), "marked")
    forget(spark, links)
    repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    found = near = _verified(spark, rows, spots, repeated)
    again = _by_runs(spark, rows, marks, near)
    forget(spark, marks)
    if again is not None:
        equal, gapped = again
        gapped = stored(spark, gapped.join(spots, ["doc", "rep", "place", "rep_place"], "left_anti"), "gapped")
        found = near.union(equal).union(_verified(spark, rows, gapped, repeated))
        forget(spark, gapped)
    forget(spark, spots)
    return found.repartition("doc", "rep").sortWithinPartitions("doc", "rep").mapInArrow(_join_batches, PASSAGES)
