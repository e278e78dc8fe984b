"""Operator 11: an audit of how far the sources of a language diverge.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A term that
enough documents of a language hold is kept there; each group (language, source)
and each language as a whole gives every kept term a smoothed share p in exact
integers. A pair of sources is as far apart as the sum of |p - q| over all kept
terms.

Most sources lack most terms, so the sum is not taken term by term. With c the
share that a group gives a term it lacks, a pair starts at V times |c - d|, as if
both lacked all V terms. An inverted index of terms then corrects that start:

* a term of one source alone corrects |c - d| to |p - d|. That needs no term of
  the other side, so equal p of a group are counted first and meet the groups of
  the language, not the postings;
* a term of both corrects what the two one-sided corrections have made of it to
  |p - q|; only postings of the same term meet, and only nonzero corrections leave.

Texts are read once by an Arrow kernel that counts terms in bounded tables before
anything is shuffled; the counts are summed by (language, source, term), so that
neither a frequent term nor a hot source goes to one task. Postings of a term meet
in blocks of ``BLOCK`` by ``BLOCK`` sources, whatever the number of sources. The
result itself holds a row for each ordered pair of sources of a language.

Results for odd rows: null text, language and source count as empty strings; a
text without terms makes its group appear; repeated rows count each; equal values
rank by the item's UTF-8 bytes; where a language keeps no term its pairs have
value 0; a language of one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import forget, stored, text_rows, text_slices, utf8_of

#: A term is kept in a language where so many of its documents hold it.
LEAST_DOCS = 30
#: Added to each count, and what the shares are multiplied by.
SMOOTH, SCALE = 5, 1_000_000_000
#: Ranks of terms that are reported.
TOP_TERMS = 50
#: Sources whose postings of one term meet at a time.
BLOCK = 64
#: Terms that a task counts before it hands the counts on.
HELD_TERMS = 400_000
#: Bytes that belong to terms, A-Z lower-cased; all others become spaces.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _strings(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _emptied(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        terms = [None, *counts]
        columns = [_strings([lang] * len(terms)), _strings([source] * len(terms)), _strings(terms), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs[t] for t in counts)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
    held.clear()


def _count_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of the documents that hold them by group, and a row without a term for each group."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0
    for batch in text_slices(batches, 2):
        for lang, source, text in zip(*(utf8_of(c) for c in batch.columns), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            terms = text.translate(TERM_BYTES).split()
            counts.update(terms)
            docs.update(set(terms))
            size += len(counts)
            if size > most:
                yield from _emptied(held)
                size = 0
    yield from _emptied(held)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n, docs: how often a group holds a term, and in how many documents.
    A row with a null term stands for each group."""
    rows = text_rows(docs).select(*(F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(lambda batches: _count_batches(batches, held), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str = "kept", smooth: int = SMOOTH, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kept)), exact; null where nothing is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1L + (CAST({scale} AS DECIMAL(12,0)) * (CAST({count} AS DECIMAL(20,0)) + {smooth})) div (CAST({total} AS DECIMAL(20,0)) + {smooth} * CAST({kept} AS DECIMAL(16,0))) END")


def _blocks(groups: DataFrame, low: bool, *columns: str) -> DataFrame:
    """Rows once for each block that theirs meets, as the lower or the upper of the two."""
    if low:
        return groups.select("lang", *columns, F.expr("source_no div size").alias("low"), F.explode(F.expr("sequence(source_no div size, last div size)")).alias("high"))
    return groups.select("lang", *columns, F.explode(F.expr("sequence(0L, source_no div size)")).alias("low"), F.expr("source_no div size").alias("high"))


def _named(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{side}_{c}" for c in columns})


def _corrections(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, first, second (numbers of sources) and what is to be summed to their distance."""
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    own = ("source_no", "none")
    a, b = _named(_blocks(groups, True, *own, "kept"), "a", *own), _named(_blocks(groups, False, *own), "b", *own)
    start = a.join(b, ["lang", "low", "high"]).filter("a_source_no < b_source_no").select("lang", F.col("a_source_no").alias("first"), F.col("b_source_no").alias("second"), (F.col("kept") * gap("a_none", "b_none")).alias("part"))

    # Equal shares of a group correct alike: they are counted first, and meet every block of the language's groups.
    shares = postings.groupBy("lang", *own, "last", "size", "p").agg(F.count("*").alias("times"))
    a = _named(shares.withColumn("block", F.explode(F.expr("sequence(0L, last div size)"))).withColumn("home", F.expr("source_no div size")), "a", *own, "p")
    b = _named(groups.select("lang", *own, F.expr("source_no div size").alias("block"), F.explode(F.expr("sequence(0L, last div size)")).alias("home")), "b", *own)
    sided = a.join(b, ["lang", "block", "home"]).filter("a_source_no <> b_source_no").select(
        "lang", F.least("a_source_no", "b_source_no").alias("first"), F.greatest("a_source_no", "b_source_no").alias("second"), (F.col("times") * (gap("a_p", "b_none") - gap("a_none", "b_none"))).alias("part")
    )

    held = (*own, "p")
    a, b = _named(_blocks(postings, True, "term", *held), "a", *held), _named(_blocks(postings, False, "term", *held), "b", *held)
    both = a.join(b, ["lang", "term", "low", "high"]).filter("a_source_no < b_source_no").select(
        "lang", F.col("a_source_no").alias("first"), F.col("b_source_no").alias("second"), (gap("a_p", "b_p") - gap("a_p", "b_none") - gap("b_p", "a_none") + gap("a_none", "b_none")).alias("part")
    )
    return start.unionByName(sided.filter("part <> 0")).unionByName(both.filter("part <> 0"))


def divergence(
    spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, smooth: int = SMOOTH, scale: int = SCALE, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source of the language is (part
    ``pair``, all of them), and by which terms the source stands out of it (part ``term``)."""
    counts = stored(spark, term_counts(docs, text_col, lang_col, source_col), "term-counts")
    terms = counts.filter("term IS NOT NULL")
    kept = stored(spark, terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    found = terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.select("*", (F.row_number().over(order) - 1).cast("long").alias("source_no"), (F.count("*").over(Window.partitionBy("lang")) - 1).alias("last"), F.lit(block).cast("long").alias("size"))
    groups = stored(spark, groups.withColumn("none", share("0", "total", "kept", smooth, scale)), "source-groups")
    postings = found.join(groups, ["lang", "source"])
    postings = stored(spark, postings.withColumns({"p": share("n", "total", "kept", smooth, scale), "q": share("in_lang", "lang_total", "kept", smooth, scale)}).drop("n", "in_lang", "total", "lang_total", "kept"), "postings")
    forget(spark, counts, kept)

    far = _corrections(postings, groups).groupBy("lang", "first", "second").agg(F.coalesce(F.sum("part"), F.lit(0)).alias("value"))
    names = groups.select("lang", "source", "source_no")
    both = far.select("lang", F.explode(F.array(F.struct(F.col("first").alias("source_no"), F.col("second").alias("item_no")), F.struct(F.col("second").alias("source_no"), F.col("first").alias("item_no")))).alias("x"), "value").select("lang", "x.*", "value")
    pairs = both.join(names, ["lang", "source_no"]).join(names.select("lang", F.col("source").alias("item"), F.col("source_no").alias("item_no")), ["lang", "item_no"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    stands_out = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(stands_out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms))
