"""Binary model, point-cloud and dense-map files.

Files are read by Spark's binaryFile source, so any file system works; each file
is decoded in the task that reads it. Little-endian throughout.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trackloom.sources.schemas import CAMERA_MODELS

CAMERA_ROWS = "camera_id long, model int, width long, height long, params array<double>"
IMAGE_ROWS = "image_id long, qvec array<double>, tvec array<double>, camera_id long, name string, xs array<double>, ys array<double>, points array<long>"
POINT_ROWS = "point3d_id long, x double, y double, z double, r int, g int, b int, error double, images array<long>, idxs array<int>"
NO_POINT = (1 << 64) - 1


def decode_cameras(data: bytes) -> Iterator[tuple]:
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
        n = CAMERA_MODELS[model][1]
        yield camera, model, width, height, list(struct.unpack_from(f"<{n}d", data, at + 24))
        at += 24 + 8 * n


def encode_cameras(rows: list[tuple]) -> bytes:
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<iiQQ", *r[:4]) + struct.pack(f"<{len(r[4])}d", *r[4]) for r in rows)


POINT2D = np.dtype([("x", "<f8"), ("y", "<f8"), ("p", "<u8")])
ELEMENT = np.dtype([("i", "<u4"), ("j", "<u4")])


def decode_images(data: bytes) -> Iterator[tuple]:
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        head = struct.unpack_from("<I7dI", data, at)
        end = data.index(b"\0", at + 64)
        (n,) = struct.unpack_from("<Q", data, end + 1)
        own = np.frombuffer(data, POINT2D, n, end + 9)
        points = [None if p == NO_POINT else int(p) for p in own["p"].tolist()]
        yield head[0], list(head[1:5]), list(head[5:8]), head[8], data[at + 64 : end].decode(), own["x"].tolist(), own["y"].tolist(), points
        at = end + 9 + n * POINT2D.itemsize


def encode_images(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for image, q, t, camera, name, xs, ys, points in rows:
        own = np.zeros(len(xs), POINT2D)
        own["x"], own["y"], own["p"] = xs, ys, [NO_POINT if p is None else p for p in points]
        out += [struct.pack("<I7dI", image, *q, *t, camera), name.encode() + b"\0", struct.pack("<Q", len(xs)), own.tobytes()]
    return b"".join(out)


def decode_points(data: bytes) -> Iterator[tuple]:
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        head = struct.unpack_from("<Q3d3BdQ", data, at)
        own = np.frombuffer(data, ELEMENT, head[8], at + 51)
        yield *head[:8], own["i"].tolist(), own["j"].tolist()
        at += 51 + head[8] * ELEMENT.itemsize


def encode_points(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        own = np.zeros(len(r[8]), ELEMENT)
        own["i"], own["j"] = r[8], r[9]
        out += [struct.pack("<Q3d3BdQ", *r[:8], len(own)), own.tobytes()]
    return b"".join(out)


#: Property types of PLY headers.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def decode_ply(data: bytes) -> Iterator[tuple]:
    """x, y, z, nx, ny, nz, r, g, b of the vertices, absent properties as 0."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii").split("\n")
    form, count, names, kinds, vertex = "ascii", 0, [], [], False
    for words in (x.split() for x in lines):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            vertex = words[1] == "vertex"
            count = int(words[2]) if vertex else count
        elif words[:1] == ["property"] and vertex:
            names.append(words[-1])
            kinds.append(PLY_TYPES[words[1]])
    if form == "ascii":
        rows = [x.split() for x in data[body:].decode("ascii").split("\n") if x.strip()][:count]
        table = {n: np.array([float(r[i]) for r in rows]) for i, n in enumerate(names)}
    else:
        order = "<" if "little" in form else ">"
        own = np.frombuffer(data, np.dtype([(n, order + k) for n, k in zip(names, kinds, strict=True)]), count, body)
        table = {n: own[n].astype(float) for n in names}
    zero = np.zeros(count)
    wanted = [table.get(n, zero) for n in ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue")]
    yield from zip(*(w.tolist() for w in wanted), strict=True)


PLY_ROWS = "x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"


def encode_ply(rows: list[tuple]) -> bytes:
    """ASCII PLY of x, y, z, r, g, b rows."""
    head = ["ply", "format ascii 1.0", f"element vertex {len(rows)}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
    return "\n".join([*head, *(" ".join(map(str, r)) for r in rows), ""]).encode()


def decode_map(data: bytes) -> Iterator[tuple]:
    """row, col, values of a dense map: text sizes ``w&h&d&``, then float32 planes."""
    parts = data.split(b"&", 3)
    width, height, depth = (int(x) for x in parts[:3])
    own = np.frombuffer(parts[3], "<f4").reshape(depth, height, width)
    for row in range(height):
        for col in range(width):
            yield row, col, own[:, row, col].tolist()


MAP_ROWS = "row int, col int, values array<float>"
FORMATS = {"cameras": (decode_cameras, CAMERA_ROWS), "images": (decode_images, IMAGE_ROWS), "points": (decode_points, POINT_ROWS), "ply": (decode_ply, PLY_ROWS), "map": (decode_map, MAP_ROWS)}


def read(spark: SparkSession, path: str, kind: str, rows: int = 20_000) -> DataFrame:
    """Rows of binary files of a kind, with the file's path, in batches of ``rows``."""
    decode, schema = FORMATS[kind]
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for row in decode(bytes(data)):
                    held.append((file, *row))
                    if len(held) == rows:
                        yield pd.DataFrame(held, columns=["path", *names])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(kernel, f"path string, {schema}")


def encode_map(values: np.ndarray) -> bytes:
    """The dense map of an array (height, width, depth)."""
    height, width, depth = values.shape
    return f"{width}&{height}&{depth}&".encode() + np.ascontiguousarray(values.transpose(2, 0, 1), "<f4").tobytes()


def decode_consistency(data: bytes) -> Iterator[tuple]:
    """row, col, images of a consistency graph: text sizes, then ``col row n image..`` as int32."""
    own = np.frombuffer(data.split(b"&", 3)[3], "<i4")
    at = 0
    while at + 2 < len(own):
        n = int(own[at + 2])
        yield int(own[at + 1]), int(own[at]), own[at + 3 : at + 3 + n].tolist()
        at += 3 + n


def encode_consistency(width: int, height: int, depth: int, rows: list[tuple]) -> bytes:
    """The consistency graph of (row, col, images) rows."""
    flat = [x for row, col, images in rows for x in (col, row, len(images), *images)]
    return f"{width}&{height}&{depth}&".encode() + np.array(flat, "<i4").tobytes()


def encode_visibility(points: list[list[int]]) -> bytes:
    """The images of each fused point: a count, then a list each."""
    return struct.pack("<Q", len(points)) + b"".join(struct.pack(f"<I{len(p)}I", len(p), *p) for p in points)


def decode_visibility(data: bytes) -> Iterator[tuple]:
    """point, images of a visibility file."""
    at = 8
    for point in range(struct.unpack_from("<Q", data)[0]):
        (n,) = struct.unpack_from("<I", data, at)
        yield point, list(struct.unpack_from(f"<{n}I", data, at + 4))
        at += 4 + 4 * n


def encode_mesh(vertices: list[tuple], faces: list[tuple]) -> bytes:
    """ASCII PLY of a mesh: x, y, z vertices and triangles of their numbers."""
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_index", "end_header"]
    return "\n".join([*head, *(" ".join(map(str, v)) for v in vertices), *(f"3 {a} {b} {c}" for a, b, c in faces), ""]).encode()


FORMATS |= {"consistency": (decode_consistency, "row int, col int, images array<int>"), "visibility": (decode_visibility, "point long, images array<int>")}


def found_format(spark: SparkSession, folder: str) -> str:
    """``binary`` where a model's folder has all three binary files, ``text`` where it has all text
    files; binary wins. Raises where it has neither."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = {str(f.getPath().getName()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    for kind, end in (("binary", "bin"), ("text", "txt")):
        if {f"{x}.{end}" for x in ("cameras", "images", "points3D")} <= names:
            return kind
    raise FileNotFoundError(f"{folder} holds no model")
