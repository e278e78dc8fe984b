"""Point lookups, counts, DML and merge over the model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import pair_id
from trackloom.operators.ranks import numbered


def with_rows(pairs: DataFrame) -> DataFrame:
    """Pairs that hold matches; empty ones are markers."""
    return pairs.filter("n_rows > 0")


def exists(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The keys that the table has."""
    return keys.join(table.select(key).distinct(), key, "left_semi")


def rows_for(table: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Row count of each entity, 0 where it has none."""
    counts = table.groupBy(key).agg(F.count("*").alias("n"))
    return entities.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def oriented(matches: DataFrame, first: Column, second: Column) -> DataFrame:
    """Matches as asked for: columns swap where the pair is asked in reverse."""
    swap = first > second
    return matches.withColumn("own", F.when(swap, F.col("idx2")).otherwise(F.col("idx1"))).withColumn("other", F.when(swap, F.col("idx1")).otherwise(F.col("idx2")))


def append_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert with generated ids after the present greatest one."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    rows = numbered(new, *new.columns).join(F.broadcast(last)).withColumn(key, F.col("_last") + F.col("_n"))
    return table.unionByName(rows.select(table.columns))


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed values win where they are not null."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    values = [F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in table.columns]
    return table.join(new, key, "left").select(values)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    return table.filter(F.lit(False))


#: Tables whose rows go with those of another.
CASCADE = {"images": ("keypoints", "descriptors"), "cameras": ()}


def clear(database: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """A database whose named tables, and those that hang on them, are empty."""
    gone = {x for n in names for x in (n, *CASCADE.get(n, ()))}
    return {n: cleared(t) if n in gone else t for n, t in database.items()}


def flagged(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key, with whether the table has it."""
    have = table.select(key).distinct().withColumn("_known", F.lit(True))
    return keys.join(have, key, "left").select(key, F.coalesce("_known", F.lit(False)).alias("known"))


def where_equal(table: DataFrame, column: str, value) -> DataFrame:
    return table.filter(F.col(column) == F.lit(value))


def with_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with the intrinsics of their camera."""
    return images.join(cameras, "camera_id")


def append_matches(matches: DataFrame, new: DataFrame) -> DataFrame:
    """Matches with those of new pairs, smaller image first; pairs that are there are left as they are."""
    turned = F.col("image_id1") > F.col("image_id2")
    pick = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    right = new.filter("image_id1 <> image_id2").select(pick("image_id1", "image_id2", "image_id1"), pick("image_id2", "image_id1", "image_id2"), pick("idx1", "idx2", "idx1"), pick("idx2", "idx1", "idx2"))
    have = matches.select("image_id1", "image_id2").distinct()
    return matches.unionByName(right.join(have, ["image_id1", "image_id2"], "left_anti").distinct())


def migrated(table: DataFrame, schema) -> DataFrame:
    """A table in another schema: columns it lacks are null, others are left out."""
    return table.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def split_cameras(images: DataFrame, cameras: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Every chosen image gets a copy of its camera under a new id."""
    last = cameras.agg(F.coalesce(F.max("camera_id"), F.lit(0)).alias("_last"))
    picked = numbered(images.filter(chosen).select("image_id", F.col("camera_id").alias("_old")), "image_id").join(F.broadcast(last))
    new = picked.select("image_id", "_old", (F.col("_last") + F.col("_n")).alias("_new"))
    out = images.join(new.select("image_id", "_new"), "image_id", "left")
    kept = out.select(*(F.coalesce("_new", "camera_id").alias("camera_id") if c == "camera_id" else F.col(c) for c in images.columns))
    copies = cameras.join(new.select(F.col("_old").alias("camera_id"), "_new"), "camera_id").withColumn("camera_id", F.col("_new")).drop("_new")
    return kept, cameras.unionByName(copies.select(cameras.columns))


def merged_ids(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """source, old id, new id: both inputs re-keyed from 1, the first before the second."""
    both = first.select(F.lit(1).alias("source"), F.col(key).alias("old_id"), "name").union(second.select(F.lit(2), key, "name"))
    return numbered(both, "source", "old_id").withColumnRenamed("_n", "new_id")


def clashing_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names that both inputs have; a merge with any is refused."""
    return first.select("name").union(second.select("name")).groupBy("name").count().filter("count > 1").select("name")


def merged_pairs(pairs: DataFrame, ids: DataFrame, source: int) -> DataFrame:
    """Pairs under their new ids; empty markers do not survive."""
    own = ids.filter(F.col("source") == source).select("old_id", "new_id")
    a, b = own.select(F.col("old_id").alias("image_id1"), F.col("new_id").alias("n1")), own.select(F.col("old_id").alias("image_id2"), F.col("new_id").alias("n2"))
    found = with_rows(pairs).join(a, "image_id1").join(b, "image_id2")
    return found.select(pair_id(F.col("n1"), F.col("n2")).alias("pair_id"), F.least("n1", "n2").alias("image_id1"), F.greatest("n1", "n2").alias("image_id2"), "n_rows")


def load_filter(pairs: DataFrame, least: int, ignored: int | None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs with enough inliers, and the images they touch."""
    kept = pairs.filter(F.col("n_rows") >= least)
    if ignored is not None:
        kept = kept.filter(F.col("config") != ignored)
    if names is not None:
        for side in ("image_id1", "image_id2"):
            kept = kept.join(names.select(F.col("image_id").alias(side)), side, "left_semi")
    return kept, kept.select(F.explode(F.array("image_id1", "image_id2")).alias("image_id")).distinct()


def shared_cameras(images: DataFrame, policy: str) -> DataFrame:
    """image_id, camera_id of found images (image_id, folder): one camera for all, for each folder, or for each image."""
    if policy == "all":
        return images.select("image_id", F.lit(1).cast("long").alias("camera_id"))
    if policy == "image":
        return numbered(images.select("image_id"), "image_id", name="camera_id")
    folders = numbered(images.select("folder").distinct(), "folder", name="camera_id")
    return images.join(folders, "folder").select("image_id", "camera_id")
