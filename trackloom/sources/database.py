"""Ingest of an embedded feature database (SQLite) into Parquet tables.

The file is read once, in batches, by the process that holds it; blobs become
rows, so that everything after is columnar.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

MAX_IMAGES = 2147483647
BATCH = 256


def _keypoints(rows) -> Iterator[dict]:
    for image, n, cols, data in rows:
        own = np.frombuffer(data, "<f4").reshape(n, cols)
        six = np.zeros((n, 6), np.float32)
        six[:, :2] = own[:, :2]
        if cols == 6:
            six[:, 2:] = own[:, 2:]
        elif cols == 4:  # scale and orientation
            s, o = own[:, 2], own[:, 3]
            six[:, 2], six[:, 3], six[:, 4], six[:, 5] = s * np.cos(o), -s * np.sin(o), s * np.sin(o), s * np.cos(o)
        else:
            six[:, 2] = six[:, 5] = 1
        yield {"image_id": np.full(n, image), "idx": np.arange(n, dtype=np.int32), **{c: six[:, i] for i, c in enumerate(("x", "y", "a11", "a12", "a21", "a22"))}}


def _descriptors(rows) -> Iterator[dict]:
    for image, n, cols, data in rows:
        own = np.frombuffer(data, np.uint8).reshape(n, cols).astype(np.int16)
        yield {"image_id": np.full(n, image), "idx": np.arange(n, dtype=np.int32), "descriptor": list(own)}


def _matches(rows) -> Iterator[dict]:
    for pair, n, _, data in rows:
        own = np.frombuffer(data, "<u4").reshape(n, 2).astype(np.int32)
        second = pair % MAX_IMAGES
        yield {"pair_id": np.full(n, pair), "image_id1": np.full(n, (pair - second) // MAX_IMAGES), "image_id2": np.full(n, second), "idx1": own[:, 0], "idx2": own[:, 1]}


BLOBS = {
    "keypoints": ("SELECT image_id, rows, cols, data FROM keypoints WHERE rows > 0", _keypoints),
    "descriptors": ("SELECT image_id, rows, cols, data FROM descriptors WHERE rows > 0", _descriptors),
    "matches": ("SELECT pair_id, rows, cols, data FROM matches WHERE rows > 0", _matches),
    "inlier_matches": ("SELECT pair_id, rows, cols, data FROM two_view_geometries WHERE rows > 0", _matches),
}
PLAIN = {
    "images": "SELECT image_id, name, camera_id FROM images",
    "two_view_geometries": "SELECT pair_id, rows AS n_rows, config FROM two_view_geometries WHERE rows > 0",
}


def ingest(database: str, folder: str) -> list[str]:
    """Write the database's tables as Parquet; gives the tables written."""
    written = []
    with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as con:
        cursor = con.execute("SELECT camera_id, model, width, height, params, prior_focal_length FROM cameras")
        cameras = [(c, m, w, h, np.frombuffer(p, "<f8").tolist(), bool(f)) for c, m, w, h, p, f in cursor]
        names = ["camera_id", "model", "width", "height", "params", "prior_focal_length"]
        tables = {"cameras": iter([{n: [r[i] for r in cameras] for i, n in enumerate(names)}] if cameras else [])}
        for name, sql in PLAIN.items():
            cursor = con.execute(sql)
            columns = [c[0] for c in cursor.description]
            tables[name] = ({c: [r[i] for r in rows] for i, c in enumerate(columns)} for rows in iter(lambda cur=cursor: cur.fetchmany(BATCH * 64), []))
        for name, (sql, decode) in BLOBS.items():
            tables[name] = decode(con.execute(sql))
        for name, parts in tables.items():
            Path(folder, name).mkdir(parents=True, exist_ok=True)
            writer = None
            for part in parts:
                batch = pa.table(part)
                writer = writer or pq.ParquetWriter(Path(folder, name, "part-0.parquet"), batch.schema)
                writer.write_table(batch)
            if writer:
                writer.close()
                written.append(name)
    return written
