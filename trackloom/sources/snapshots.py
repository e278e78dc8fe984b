"""Versions of a database or model: all tables of a version appear at once, and are checked when read."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in place at once: written beside and renamed."""
    at, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(beside, at)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a manifest: a few lines


def digest(table: DataFrame) -> dict:
    """Rows of a table and an order-free digest of them, from one aggregate."""
    from pyspark.sql import functions as F

    row = F.xxhash64(*(F.col(c).cast("string") for c in sorted(table.columns)))
    r = table.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(table.schema.fields, key=lambda f: f.name))
    return {"rows": r["n"], "digest": hashlib.sha256(f"{schema}|{r['n']}|{r['s']}".encode()).hexdigest()}


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], name: str | None = None) -> str:
    """Write all tables as a new version, then name it as the current one: a reader sees the old version
    or the whole new one, and a failed write leaves the old one as it is."""
    version = name or uuid.uuid4().hex
    manifest = {}
    for table, df in tables.items():
        path = f"{folder}/versions/{version}/{table}"
        df.write.parquet(path)
        manifest[table] = digest(spark.read.parquet(path))
    _write_text(spark, f"{folder}/versions/{version}/manifest.json", json.dumps(manifest, sort_keys=True))
    _write_text(spark, f"{folder}/current", version)
    return version


def load(spark: SparkSession, folder: str, version: str | None = None, check: bool = False) -> dict[str, DataFrame]:
    """The tables of a version, the current one by default; ``check`` compares them with the manifest."""
    version = version or _read_text(spark, f"{folder}/current").strip()
    manifest = json.loads(_read_text(spark, f"{folder}/versions/{version}/manifest.json"))
    tables = {t: spark.read.parquet(f"{folder}/versions/{version}/{t}") for t in manifest}
    for t, want in manifest.items() if check else ():
        if digest(tables[t]) != want:
            raise ValueError(f"table {t} of version {version} is not what was written")
    return tables
