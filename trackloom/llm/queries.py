"""Queries opN_<name>: the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact_dedup, fim, html_text, language, licenses, nndescent, packing, passages, secrets, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.near_dedup(spark, table(spark, sf_dir, "documents"))


def op3_nndescent(spark, sf_dir):
    return nndescent.nearest(spark, table(spark, sf_dir, "embeddings"))


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.identify(spark, table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_passages(spark, sf_dir):
    return passages.repeated_passages(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark, sf_dir):
    return divergence.divergence(spark, table(spark, sf_dir, "documents"))


def op12_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_fim(spark, sf_dir):
    return fim.digests(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_nndescent": op3_nndescent,
    "op4_html_text": op4_html_text,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_passages": op9_passages,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_licenses": op12_licenses,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY length(text) DESC, doc_id)""",
    "op11_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        f AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, k.n AS lang_n
            FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (
            SELECT f.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (f.total::HUGEINT + 5 * kept) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (v.total::HUGEINT + 5 * kept) AS q
            FROM f JOIN v ON v.lang = f.lang),
        far AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
        y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
        SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50""",
}
