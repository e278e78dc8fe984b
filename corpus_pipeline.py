"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Only decisions are
joined: the texts move in the two dedup stages, once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import exact_dedup, language, packing, secrets, simhash
from trackloom.llm._common import forget, stored

KEY, ID = "_text_key", "_kept_id"
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose words tell no language from the
    others: the best one's share is under ``LEAST_SHARE``. Where no document says its
    language there is nothing to learn from, and only those without a letter go."""
    return language.keep_known(spark, docs, LEAST_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays. Of rows that repeat both
    doc_id and text, one stays."""
    found = stored(spark, exact_dedup.exact_dedup(spark, docs), "decisions")
    kept = found.filter("kept").select(F.col("doc_id").alias(ID), "text_sha256")
    blanks = exact_dedup.BLANKS.decode()
    keyed = docs.withColumn(KEY, F.sha2(F.translate(F.coalesce("text", F.lit("")), blanks, ""), 256))
    staying = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(KEY) == F.col("text_sha256")), "left_semi")
    return single(found.groupBy("doc_id", "text_sha256").count(), staying, {"doc_id": "doc_id", "text_sha256": KEY}).select(docs.columns)


def single(counts: DataFrame, docs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """docs with one row of each key that is counted more than once; other rows as they are."""
    twice = counts.filter("count > 1").select(*(F.col(c).alias(f"_twice_{i}") for i, c in enumerate(keys)))
    if twice.isEmpty():
        return docs
    same = [F.col(c).eqNullSafe(F.col(f"_twice_{i}")) for i, c in enumerate(keys.values())]
    return docs.join(twice, same, "left_anti").unionByName(docs.join(twice, same, "left_semi").dropDuplicates(list(keys.values())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component stays. Where a doc_id
    is null or repeated, the fingerprint tells its rows apart."""
    found, prints = simhash.grouped(spark, docs)
    kept = stored(spark, prints.filter("first").select(F.col("least").alias(ID), F.col("print").alias("_kept_print")), "decisions")
    vague = stored(spark, found.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_vague_id")), "vague")
    if vague.isEmpty():
        return docs.join(kept, F.col("doc_id") == F.col(ID), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_vague_id"))
    plain = docs.join(vague, same, "left_anti").join(kept, F.col("doc_id") == F.col(ID), "left_semi")
    told = simhash.with_print(docs.join(vague, same, "left_semi"), KEY)
    staying = told.join(kept, F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(KEY) == F.col("_kept_print")), "left_semi")
    return plain.unionByName(staying.dropDuplicates(["doc_id", KEY]).select(docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the training sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what the next one has read is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
            if before is not None:
                forget(spark, before)
            before = docs
    return docs
