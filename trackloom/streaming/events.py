"""Windows over event time, and the registration trigger as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind and window; rows later than the watermark go."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    sums = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


TRIGGERS = "model_id long, images long, points long, fired boolean"


def global_triggers(growth: DataFrame, image_ratio: float = 1.1, image_step: int = 5, point_ratio: float = 1.1, point_step: int = 250_000) -> DataFrame:
    """Which registrations set a global refinement off: growth of images or points
    since the last one by a ratio or a step. growth: model_id, seq, images, points."""

    def run(pdf: pd.DataFrame, images: int, points: int) -> tuple[pd.DataFrame, int, int]:
        out = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            fired = r.images >= images * image_ratio or r.images >= images + image_step or r.points >= points * point_ratio or r.points >= points + point_step
            if fired:
                images, points = int(r.images), int(r.points)
            out.append((r.model_id, r.images, r.points, bool(fired)))
        return pd.DataFrame(out, columns=["model_id", "images", "points", "fired"]), images, points

    def kernel(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        images, points = state.get if state.exists else (0, 0)
        for pdf in parts:
            out, images, points = run(pdf, images, points)
            yield out
        state.update((images, points))

    if not growth.isStreaming:  # one row a registered image; a model's rows follow each other in one task
        return growth.groupBy("model_id").applyInPandas(lambda pdf: run(pdf, 0, 0)[0], TRIGGERS)
    return growth.groupBy("model_id").applyInPandasWithState(kernel, TRIGGERS, "images long, points long", "append", GroupStateTimeout.NoTimeout)
