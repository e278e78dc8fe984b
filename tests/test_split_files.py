"""Binary files by blocks: the same rows as the readers of whole files, at every block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.sources import model_binary as mb
from trackloom.sources import split_files as sf

POINTS = [(i * 3 + 1, i / 7, -i / 3, 2.5, i % 256, 1, 2, 0.25, list(range(i % 9)), [5] * (i % 9)) for i in range(200)]
IMAGES = [(i + 1, [1.0, 0.0, 0.0, 0.5], [0.0, i / 2, 1.0], 1, f"a{'é' * (i % 4)}{i}.jpg", [0.5 * k for k in range(i % 6)], [1.5] * (i % 6), [None if k % 2 else k for k in range(i % 6)]) for i in range(60)]
CAMERAS = [(i + 1, i % 3, 640, 480, [float(k) for k in range(sf.CAMERA_MODELS[i % 3][1])]) for i in range(20)]
SEEN = [(i, list(range(i % 5))) for i in range(50)]


def same(spark, path, kind, most):
    got = sf.read(spark, str(path), kind, most)
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(mb.read(spark, str(path), kind).select(*got.columns).collect(), key=key)
    return got


@pytest.mark.parametrize("most", [1, 100, 1500, 1 << 20])
def test_blocks_of_models(spark, tmp_path, most):
    files = {"points": mb.encode_points(POINTS), "images": mb.encode_images(IMAGES), "cameras": mb.encode_cameras(CAMERAS), "visibility": mb.encode_visibility([p for _, p in SEEN])}
    for kind, data in files.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "one two.bin").write_bytes(data)
        (tmp_path / kind / "none.bin").write_bytes(b"\0" * 8)
        same(spark, tmp_path / kind, kind, most)


@pytest.mark.parametrize("most", [1, 64, 1 << 20])
def test_blocks_of_dense_files(spark, tmp_path, most):
    grid = np.arange(7 * 5 * 3, dtype="f4").reshape(7, 5, 3)
    (tmp_path / "a.map").write_bytes(mb.encode_map(grid))
    (tmp_path / "a.graph").write_bytes(mb.encode_consistency(5, 7, 1, [(i, i % 5, list(range(i % 4))) for i in range(7)]))
    (tmp_path / "text.ply").write_bytes(mb.encode_ply([(i / 2, 1.0, 2.0, i, 3, 4) for i in range(30)]))
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 9\nproperty double x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    body = np.zeros(9, [("x", ">f8"), ("y", ">f4"), ("z", ">f4")])
    body["x"], body["z"] = np.arange(9), 2.5
    (tmp_path / "big.ply").write_bytes(head + body.tobytes() + b"\x03" + bytes(12))
    for name, kind in (("a.map", "map"), ("a.graph", "consistency"), ("text.ply", "ply"), ("big.ply", "ply")):
        assert same(spark, tmp_path / name, kind, most).count() in (35, 7, 30, 9)


def test_index_is_kept_and_blocks_are_tasks(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(mb.encode_points(POINTS))
    index = sf.block_index(spark, str(tmp_path / "p.bin"), "points", 1000)
    index.write.parquet(str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    blocks = sorted(kept.collect(), key=lambda r: r["start"])
    assert [b["start"] for b in blocks[1:]] == [b["end"] for b in blocks[:-1]] and sum(b["rows"] for b in blocks) == len(POINTS)
    got = sf.read(spark, str(tmp_path / "p.bin"), "points", index=kept)
    assert got.count() == len(POINTS) and got.select(F.spark_partition_id()).distinct().count() == len(blocks) > 10


@pytest.mark.parametrize(("kind", "data"), [("points", mb.encode_points(POINTS)), ("images", mb.encode_images(IMAGES)), ("cameras", mb.encode_cameras(CAMERAS)), ("map", mb.encode_map(np.zeros((4, 3, 2))))])
def test_cut_files_raise(spark, tmp_path, kind, data):
    (tmp_path / "cut.bin").write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends inside a record"):
        sf.read(spark, str(tmp_path / "cut.bin"), kind, 100).count()


@pytest.mark.parametrize(("kind", "rows", "encoded"), [("points", POINTS, mb.encode_points(POINTS)), ("images", IMAGES, mb.encode_images(IMAGES)), ("cameras", CAMERAS, mb.encode_cameras(CAMERAS)), ("visibility", SEEN, mb.encode_visibility([p for _, p in SEEN]))])
def test_written_by_parts(spark, tmp_path, kind, rows, encoded):
    schema = mb.FORMATS[kind][1]
    df = spark.createDataFrame(rows, schema).withColumn("extra", F.lit(1)).repartition(7)
    sf.write(df, str(tmp_path / "out.bin"), kind)
    assert (tmp_path / "out.bin").read_bytes() == encoded
    sf.write(df.limit(0), str(tmp_path / "none.bin"), kind)
    assert (tmp_path / "none.bin").read_bytes() == b"\0" * 8
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.bin", "out.bin"]


def test_maps_and_clouds_written_by_parts(spark, tmp_path):
    grid = np.arange(6 * 4 * 2, dtype="f4").reshape(6, 4, 2)
    cells = spark.createDataFrame([(r, c, grid[r, c].tolist()) for r in range(6) for c in range(4)], mb.MAP_ROWS).repartition(5)
    sf.write_map(cells, f"file://{tmp_path}/a.map")
    assert (tmp_path / "a.map").read_bytes() == mb.encode_map(grid)
    with pytest.raises(ValueError, match="every cell"):
        sf.write_map(cells.filter("row <> 2"), f"{tmp_path}/b.map")
    cloud = spark.createDataFrame([(float(i), 0.5, -1.0, 0.0, 1.0, 0.0, i % 256, 2, 3) for i in range(300)], "x double, y double, z double, nx double, ny double, nz double, r int, g int, b int")
    sf.write_cloud(cloud.repartition(4), f"{tmp_path}/c.ply", "x")
    back = sf.read(spark, f"{tmp_path}/c.ply", "ply", 500).drop("path").orderBy("x").collect()
    assert [tuple(r) for r in back] == [tuple(map(float, r)) for r in cloud.orderBy("x").collect()]


def test_files_over_two_gigabytes(spark, tmp_path):
    width, height = 1000, 800_000
    head = f"{width}&{height}&1&".encode()
    with open(tmp_path / "wide.map", "wb") as out:
        out.write(head)
        out.truncate(len(head) + 4 * width * height)  # a file with a hole: 3.2 GB that take no place
        out.seek(-4 * width, 2)
        out.write(np.arange(width, dtype="<f4").tobytes())
    index = sf.block_index(spark, f"{tmp_path}/wide.map", "map", 1 << 20).cache()
    assert index.count() > 3000 and index.agg(F.sum("rows")).first()[0] == height
    last = sf.read(spark, f"{tmp_path}/wide.map", "map", index=index.filter("first + rows = 800000")).filter("row = 799999")
    assert sorted((r["col"], r["values"][0]) for r in last.collect()) == [(i, float(i)) for i in range(width)]
