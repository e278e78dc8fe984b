"""Operator 7: language ID with word-first backoff.

Words of the training rows are counted by language over the whole corpus. A
document's language is the one with the greatest sum of log frequencies of its
words. A word that no training row has is scored by the longest character n-grams
of it (with word borders) that the training words have: four letters, then three,
two, one; n-gram counts are those of the words, weighted by them. What counts is the
log of a word's rate in a language above a floor that all languages share, so a word
that a language lacks says the same of a large and of a small one.

No word and no n-gram is left out. The ``core`` most frequent words are broadcast,
and most documents are settled by them: where the lead of the best language is
greater than all that the other words could take back, nothing else is looked up.
The words of the remaining documents are scored by joins with the tables of all
words and n-grams. Neither the size of the core nor which way a document takes
changes its language; a score can change by less than e^-40.

Results for odd rows: a null text, and one without a letter, is ``und`` with
score 0; so is everything if no row has a language to learn from. Of languages
that score alike the first by name is taken. A null doc_id is in no fold of its
own: it is not held out. Repeated rows are judged each; an empty table gives no
rows. Columns that are not asked for are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import forget, stored, text_rows, text_slices, whole_groups

#: Words, and bytes of scores, that are broadcast at most; how many they are changes no result.
CORE, CORE_BYTES = 1 << 18, 32 << 20
LONGEST = 4
#: Rows of a task's counts before they are folded and handed on; words whose n-grams are counted at once.
FOLD_ROWS, GRAM_WORDS = 600_000, 1 << 16
NO_LETTERS = r"[^\p{L}]+"
UNKNOWN = "und"
#: An n-gram says less than a word: neighbours share letters.
GRAM_WEIGHT = 0.5
#: Counts of a word that nobody has, in the largest language; counts by which a small language's rates are damped.
SMOOTH, DAMP = 0.1, 1000
#: Nats of lead beyond all doubt.
SURE = 40.0
#: Steps of an octave by which words are ranked for the core.
STEPS = 8


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts, F.lit(-1))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words end to end, the words, and where each text ends."""
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), NO_LETTERS, " "))
    bounds = lists.offsets.to_numpy()
    found = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, bounds[1:] - bounds[0]


COUNTS = "lang string, word string, n long"


def _folded(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, word, n, folded within the task."""
    parts: list[pa.Table] = []
    rows = 0
    for batch in text_slices(batches):
        codes, words, ends = words_of(batch.column(1))
        if not len(codes):
            continue
        langs = batch.column(0).dictionary_encode()
        keys = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(ends, prepend=0)) * len(words) + codes
        keys, sums = np.unique(keys, return_counts=True)
        table = pa.table({"lang": langs.dictionary.take(pa.array(keys // len(words))).cast(pa.string()), "word": words.take(pa.array(keys % len(words))).cast(pa.string()), "n": pa.array(sums, pa.int64())})
        parts.append(table.filter(pc.not_equal(table.column("word"), "")))
        rows += parts[-1].num_rows
        if rows >= FOLD_ROWS:
            parts = [_folded(parts)]
            rows = parts[0].num_rows
            if rows >= FOLD_ROWS // 2:
                yield from parts[0].to_batches(max_chunksize=1 << 16)
                parts, rows = [], 0
    if parts:
        yield from _folded(parts).to_batches(max_chunksize=1 << 16)


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def gram_counts(words: list[str], n: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """(n-grams, counts) of each length of words that are counted n times each."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(points, return_inverse=True)
    if len(letters) >= 1 << 16:  # four codes make one key of 64 bits
        if len(words) == 1:
            pairs = [(g, int(n[0])) for k in range(1, LONGEST + 1) for g in grams_of(words[0], k)]
            yield [p[0] for p in pairs], np.array([p[1] for p in pairs], np.int64)
            return
        for part in (slice(0, len(words) // 2), slice(len(words) // 2, None)):
            yield from gram_counts(words[part], n[part])
        return
    codes = codes.astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word_of, times = np.repeat(np.arange(len(words)), sizes), np.repeat(n, sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k in range(1, LONGEST + 1):
        starts = np.flatnonzero((place > 0) & (place < sizes[word_of] - 1) if k == 1 else place + k <= sizes[word_of])
        if not len(starts):
            continue
        key = np.zeros(len(starts), np.uint64)
        for j in range(k):
            key = key << np.uint64(16) | codes[starts + j]
        found, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, times[starts]).astype(np.int64)
        chars = np.stack([letters[(found >> np.uint64(16 * (k - 1 - j)) & np.uint64(0xFFFF)).astype(np.int64)] for j in range(k)], axis=1)
        text = chars.astype("<u4").tobytes().decode("utf-32-le")
        yield [text[i : i + k] for i in range(0, len(text), k)], total


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) -> lang, n-gram, n."""

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        codes = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = rows.filter(pa.array(codes == i))
            for grams, total in gram_counts(own.column("word").to_pylist(), own.column("n").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(total)], ["lang", "word", "n"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GRAM_WORDS:
            yield from counted(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from counted(pa.Table.from_batches(held))


class Rates:
    """What turns counts into scores: the log of a rate above the floor, by language."""

    def __init__(self, langs: list[str], totals: list[float]):
        self.langs = langs
        self.scale = [(max(totals, default=0) + DAMP) / SMOOTH / (x + DAMP) for x in totals]
        self.totals = totals

    def excess(self, counts: np.ndarray) -> np.ndarray:
        """(rows, languages) counts -> scores; zero where the language lacks the word."""
        return np.log1p(counts * np.array(self.scale))

    def columns(self, weight: float = 1.0):
        """The same of rows lang, n: an array of all languages' scores, as an aggregate."""
        each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in self.langs]
        return F.array(*(F.log1p(n * s) * weight for n, s in zip(each, self.scale, strict=True)))

    def most(self, count: float) -> float:
        """No word that is counted at most so often scores more."""
        return max((float(np.log1p(min(count, t) * s)) for t, s in zip(self.totals, self.scale, strict=True)), default=0.0)


class Core:
    """The broadcast part of the model: the scores of the most frequent words."""

    def __init__(self, rates: Rates, words: pa.Array, scores: np.ndarray, doubt: float):
        self.langs, self.words, self.scores, self.doubt = rates.langs, words, scores, doubt


class Model:
    """A core of frequent words, and the tables of all words and n-grams (word, scores)."""

    def __init__(self, core: Core, words: DataFrame | None = None, grams: DataFrame | None = None):
        self.core, self.words, self.grams = core, words, grams


def _totals(langs: list[str], rows: list, size: int | None = None) -> list[float]:
    by = {r["lang"]: r["n"] for r in rows if size is None or r["size"] == size}
    return [float(by.get(x, 0)) for x in langs]


def train(spark: SparkSession, rows: DataFrame, core: int = CORE) -> Model:
    """Learn from all rows of (lang, text)."""
    partial = rows.select("lang", "text").mapInArrow(_count_words, COUNTS)
    counts = stored(spark, partial.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row for each language
    langs = sorted(r["lang"] for r in sums)
    if not langs:
        return Model(Core(Rates([], []), pa.array([], pa.string()), np.zeros((0, 0)), 0.0))
    rates = Rates(langs, _totals(langs, sums))
    every = counts.groupBy("word").agg(F.sum("n").alias("n"), rates.columns().alias("scores"))
    step = F.floor(F.log2("n") * STEPS)
    kinds = counts.groupBy("word").agg(F.sum("n").alias("n")).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows at most
    cut, held = None, 0
    for r in kinds:
        held += r["count"]
        if held > min(core, CORE_BYTES // (8 * len(langs))):
            break
        cut = r["step"]
    chosen = every.filter(step >= cut) if cut is not None else every.limit(0)
    table = chosen.select("word", "scores").toArrow()  # ``core`` rows at most
    scores = np.asarray(table.column("scores").combine_chunks().flatten(), np.float64).reshape(-1, len(langs))
    sized = counts.mapInArrow(_count_grams, COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = stored(spark, sized.withColumn("size", F.length("word")), "grams")
    by_size = grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()  # a row for each language and length
    sizes = [Rates(langs, _totals(langs, by_size, k)) for k in range(1, LONGEST + 1)]
    scored = grams.groupBy("word", "size").agg(*(r.columns(GRAM_WEIGHT).alias(f"s{k}") for k, r in enumerate(sizes, 1)))
    pick = F.when(F.col("size") == 1, F.col("s1"))
    for k in range(2, LONGEST + 1):
        pick = pick.when(F.col("size") == k, F.col(f"s{k}"))
    # No word beyond the core scores more: its counts are under the cut, or its n-grams' mean is one n-gram's at most.
    doubt = max(rates.most(float("inf") if cut is None else 2 ** (cut / STEPS)), *(GRAM_WEIGHT * r.most(float("inf")) for r in sizes))
    return Model(Core(rates, table.column("word").combine_chunks(), scores, doubt), every.select("word", "scores"), scored.select(F.col("word").alias("gram"), "size", pick.alias("scores")))


JUDGED = "slice long, row int, doc_id long, text_key long, held_out boolean, lang_pred string, score double, sums binary, word string, rows binary"


def _ended(sums: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its share, for each row of sums."""
    odds = np.exp(sums - sums.max(1, keepdims=True))
    odds /= odds.sum(1, keepdims=True)
    return odds.argmax(1), odds.max(1)


def _judge_batches(batches: Iterator[pa.RecordBatch], core: Core) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, held_out, text) -> a row each, open (without a language) where the words
    beyond the core could decide; then a row for each such word of a slice, with the open rows that
    have it, as often as they do."""
    langs, number = np.array(core.langs, object), 0
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    for batch in text_slices(batches, 3):
        n, slice_id, number = batch.num_rows, first + number, number + 1
        codes, words, ends = words_of(batch.column(3))
        word = np.asarray(pc.not_equal(words, "").fill_null(False)) if len(words) else np.zeros(0, bool)
        row_of = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        lettered = np.bincount(row_of[word[codes]], minlength=n) > 0
        pred, score, sums = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros((n, len(langs)))
        extra = None
        if len(langs) and len(codes):
            at = pc.index_in(words.cast(pa.string()), core.words).fill_null(-1).to_numpy()
            known = at >= 0
            for i in range(len(langs)):
                column = np.where(known, core.scores[at, i], 0) if len(core.scores) else np.zeros(len(at))
                sums[:, i] = np.bincount(row_of, column[codes], minlength=n)
            beyond = (word & ~known)[codes]
            missing = np.bincount(row_of[beyond], minlength=n)
            best, share = _ended(sums, core.langs)
            top = np.sort(sums, axis=1)
            lead = top[:, -1] - top[:, -2] if len(langs) > 1 else np.full(n, np.inf)
            opened = (missing > 0) & (lead <= missing * core.doubt + SURE)
            pred[lettered], score[lettered] = langs[best[lettered]], share[lettered]
            pred[opened], score[opened] = None, 0
            asked = np.flatnonzero(beyond)
            asked = asked[opened[row_of[asked]]]
            if len(asked):
                order = np.argsort(codes[asked], kind="stable")
                c, r = codes[asked][order], row_of[asked][order].astype(np.int32)
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(c) != 0]))
                raw = [r[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(c)], strict=True)]
                extra = words.take(pa.array(c[cuts])).cast(pa.string()), pa.array(raw, pa.binary())
        here = lambda m: pa.array(np.full(m, slice_id, np.int64))
        raw_sums = pa.array([None if p is not None else s.tobytes() for p, s in zip(pred, sums, strict=True)], pa.binary())
        names = [x.split()[0] for x in JUDGED.split(", ")]
        own = [here(n), pa.array(np.arange(n, dtype=np.int32)), *batch.columns[:3], pa.array(pred.tolist(), pa.string()), pa.array(score), raw_sums, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(own, names)
        if extra:
            m = len(extra[0])
            none = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([here(m), *none, *extra], names)


ANSWERS = "doc_id long, text_key long, held_out boolean, lang_pred string, score double"


def _finish_batches(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """(slice, row, doc_id, text_key, held_out, sums, rows, scores), sorted by slice -> the open rows' answers."""
    names = np.array(langs, object)
    for columns in whole_groups(batches, 1):
        table = pa.table(columns, ["slice", "row", "doc_id", "text_key", "held_out", "sums", "rows", "scores"])
        slices = table.column("slice").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(slices) != 0]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slices)], strict=True):
            part = table.slice(a, b - a)
            docs, words = part.filter(pc.is_valid(part.column("row"))), part.filter(pc.is_valid(part.column("rows")))
            if not docs.num_rows:
                continue
            rows = docs.column("row").to_numpy()
            order = np.argsort(rows)
            sums = np.frombuffer(b"".join(docs.column("sums").to_pylist()), np.float64).reshape(len(rows), -1).copy()
            for at, scores in zip(words.column("rows").to_pylist(), words.column("scores").to_pylist(), strict=True):
                if scores is not None:
                    np.add.at(sums, order[np.searchsorted(rows[order], np.frombuffer(at, np.int32))], np.array(scores))
            best, share = _ended(sums, langs)
            yield pa.RecordBatch.from_arrays(
                [*(docs.column(c).combine_chunks() for c in ("doc_id", "text_key", "held_out")), pa.array(names[best].tolist(), pa.string()), pa.array(share)], ["doc_id", "text_key", "held_out", "lang_pred", "score"]
            )


def scored_words(model: Model, words: DataFrame) -> DataFrame:
    """word, scores of distinct words: by their own counts, else by the mean of their longest
    n-grams that are known; words without any are left out."""
    asked = words.join(model.words, "word", "left")
    known = asked.filter("scores IS NOT NULL")
    new = asked.filter("scores IS NULL").select("word")
    edged, size = F.concat(F.lit(" "), "word", F.lit(" ")), len(model.core.langs)
    cut = lambda text, k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    # The shortest edged word has three characters.
    grams = F.concat(cut(F.col("word"), 1), *(F.when(F.length(edged) >= k, cut(edged, k)).otherwise(F.array().cast("array<string>")) for k in range(2, LONGEST + 1)))
    met = new.select("word", F.explode(grams).alias("gram")).join(model.grams, "gram")
    means = met.groupBy("word", "size").agg(F.array(*(F.avg(F.col("scores")[i]) for i in range(size))).alias("scores"))
    best = means.groupBy("word").agg(F.max_by("scores", "size").alias("scores"))
    return known.select("word", "scores").unionByName(best)


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, text_key (a hash of the text), held_out, lang_pred and score of each row."""
    core = spark.sparkContext.broadcast(model.core)  # bounded by ``core`` words
    text = F.col(text_col).cast("string")
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), (fold(id_col, parts) == held).alias("held_out"), text.alias("text"))
    judged = stored(spark, rows.mapInArrow(lambda b: _judge_batches(b, core.value), JUDGED), "judged")
    answers = ["doc_id", "text_key", "held_out", "lang_pred", "score"]
    ended = judged.filter("lang_pred IS NOT NULL").select(answers)
    asked = judged.filter("word IS NOT NULL")
    if asked.isEmpty():
        return ended
    scores = scored_words(model, asked.select("word").distinct())
    words = asked.select("slice", "word", "rows").join(scores, "word", "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = judged.filter("word IS NULL AND lang_pred IS NULL").select("slice", "row", "doc_id", "text_key", "held_out", "sums", none("binary", "rows"), none("array<double>", "scores"))
    both = left.unionByName(words.select("slice", none("int", "row"), none("long", "doc_id"), none("long", "text_key"), none("boolean", "held_out"), none("binary", "sums"), "rows", F.col("scores").cast("array<double>").alias("scores")))
    langs = model.core.langs
    return ended.unionByName(both.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda b: _finish_batches(b, langs), ANSWERS))


def labelled(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", parts: int = 4, held: int = 2) -> DataFrame:
    """lang and text of all rows out of the held-out fold that have a language."""
    return text_rows(docs).filter((fold(id_col, parts) != held) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, core: int = CORE) -> DataFrame:
    """Learn from all rows out of the held-out fold, and judge every row."""
    model = train(spark, labelled(docs, text_col, lang_col, id_col, parts, held), core)
    return predict(spark, docs, model, id_col, text_col, parts, held).drop("text_key")


def keep_known(spark: SparkSession, docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """The rows, as they are, whose language is known with a score of ``least`` or more.
    Where there is no language to learn, those with a letter stay."""
    model = train(spark, labelled(docs, text_col, lang_col, id_col, parts, held))
    if not model.core.langs:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    found = predict(spark, docs, model, id_col, text_col, parts, held)
    gone = found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    gone = stored(spark, gone, "rejected")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")
