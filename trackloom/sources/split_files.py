"""Large binary files, read by several tasks and written by several tasks.

A file is first walked over record heads, in one task a file: what comes of it is an
index, a row for each block of about ``most`` bytes with the record that it starts with.
Then every block is a task of its own, which reads its byte range only and decodes it
as a small file of the same kind. Maps and binary point clouds have records of one
size, so their index comes from the header alone. Writers encode by partition, in
order; the parts are then joined as streams, so no task holds a file.

Files are opened through Arrow's file systems, so a path may name any of them.

Defined results: a file without records gives no rows; a record longer than ``most``
is a block alone; a file that ends inside a record raises ``ValueError``; null numbers
and names cannot be written and raise.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.rounds import cut, drop
from trackloom.sources import model_binary as mb
from trackloom.sources.schemas import CAMERA_MODELS

#: Bytes of a block, and of what is copied at once when parts are joined.
BLOCK, COPY = 64 << 20, 8 << 20
#: Tasks of one read at most; further blocks share tasks.
TASKS = 10_000
INDEX_ROWS = "path string, first long, start long, end long, rows long, head binary"
PART_ROWS = "part int, path string, rows long, bytes long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# -- walking over records -------------------------------------------------------------


def _exact(file: io.BufferedReader, n: int) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the file ends inside a record")
    return data


def _skip(file: io.BufferedReader, head: int, rest: int) -> int:
    file.seek(rest, io.SEEK_CUR)
    return head + rest


def _camera(file) -> int:
    return _skip(file, 24, 8 * CAMERA_MODELS[struct.unpack_from("<ii", _exact(file, 24))[1]][1])


def _image(file) -> int:
    _exact(file, 64)
    name = 1
    while _exact(file, 1) != b"\0":
        name += 1
    return _skip(file, 72 + name, struct.unpack("<Q", _exact(file, 8))[0] * mb.POINT2D.itemsize)


def _point(file) -> int:
    return _skip(file, 51, struct.unpack_from("<Q", _exact(file, 51), 43)[0] * mb.ELEMENT.itemsize)


def _seen(file) -> int:
    return _skip(file, 4, 4 * struct.unpack("<I", _exact(file, 4))[0])


def _pixel(file) -> int:
    return _skip(file, 12, 4 * struct.unpack("<3i", _exact(file, 12))[2])


def _line(file) -> int:
    line = file.readline()
    if not line:
        raise ValueError("the file ends inside a record")
    return len(line)


def _walked(file, size: int, at: int, count: int | None, step: Callable, most: int) -> Iterator[tuple[int, int, int, int]]:
    """first, start, end, rows of the blocks of ``count`` records, or of all to the end."""
    first, start, rows, number = 0, at, 0, 0
    while number < count if count is not None else at < size:
        at, number, rows = at + step(file), number + 1, rows + 1
        if at > size:
            raise ValueError("the file ends inside a record")
        if at - start >= most:
            yield first, start, at, rows
            first, start, rows = number, at, 0
    if rows:
        yield first, start, at, rows


def _ply_head(file) -> tuple[bytes, int, np.dtype | None]:
    """Header, count of vertices and the type of one; None where they are text."""
    lines, words, form, count, fields, vertex = [], [], "ascii", 0, [], False
    while words[:1] != ["end_header"]:
        lines.append(file.readline())
        if not lines[-1]:
            raise ValueError("the header has no end")
        words = lines[-1].decode("ascii").split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            vertex = words[1] == "vertex"
            count = int(words[2]) if vertex else count
        elif words[:1] == ["property"] and vertex:
            fields.append((words[-1], mb.PLY_TYPES[words[1]]))
    order = "<" if "little" in form else ">"
    return b"".join(lines), count, None if form == "ascii" else np.dtype([(n, order + k) for n, k in fields])


def _sizes(file) -> tuple[bytes, list[int]]:
    """The text sizes ``w&h&d&`` that a dense file begins with."""
    head = b""
    while head.count(b"&") < 3:
        head += _exact(file, 1)
    return head, [int(x) for x in head.split(b"&")[:3]]


STEPS = {"cameras": _camera, "images": _image, "points": _point, "visibility": _seen}


def blocks(file: io.BufferedReader, size: int, kind: str, most: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """first, start, end, rows, head of the blocks of one open file. The rows of a map's block are
    pixel rows, and its start and end are those of the first plane."""
    if kind in STEPS:
        (count,) = struct.unpack("<Q", _exact(file, 8))
        yield from ((*b, b"") for b in _walked(file, size, 8, count, STEPS[kind], most))
        return
    if kind == "ply":
        head, count, vertex = _ply_head(file)
        if vertex is None:
            yield from ((*b, head) for b in _walked(file, size, len(head), count, _line, most))
            return
        per, width, planes = max(1, most // vertex.itemsize), vertex.itemsize, 1
    else:
        head, (columns, count, planes) = _sizes(file)
        if kind == "consistency":
            yield from ((*b, head) for b in _walked(file, size, len(head), None, _pixel, most))
            return
        per, width = max(1, most // max(1, 4 * columns * planes)), 4 * columns
    if len(head) + count * width * planes > size:
        raise ValueError("the file ends inside a record")
    for first in range(0, count, per):
        rows = min(per, count - first)
        yield first, len(head) + first * width, len(head) + (first + rows) * width, rows, head


def _small(source, kind: str, first: int, start: int, end: int, rows: int, head: bytes) -> bytes:
    """A block as a file of its own."""
    if kind == "map":
        columns, height, planes = (int(x) for x in head.split(b"&")[:3])
        parts = [source.read_at(end - start, start + p * 4 * columns * height) for p in range(planes)]
        return f"{columns}&{rows}&{planes}&".encode() + b"".join(parts)
    data = source.read_at(end - start, start)
    if kind == "ply":
        return re.sub(rb"(element\s+vertex\s+)\d+", rb"\g<1>%d" % rows, head) + data
    return (head if kind == "consistency" else struct.pack("<Q", rows)) + data


def block_index(spark: SparkSession, path: str, kind: str, most: int = BLOCK) -> DataFrame:
    """The blocks of all files under a path: path, first, start, end, rows, head. One task walks a file."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, size in zip(pdf["path"], pdf["length"], strict=True):
                system, inner = opened(name)
                with system.open_input_file(inner) as source:
                    held = []
                    for block in blocks(io.BufferedReader(source, 1 << 20), size, kind, most):
                        held.append((name, *block))
                        if len(held) == 4096:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names)

    names = [x.split()[0] for x in INDEX_ROWS.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInPandas(kernel, INDEX_ROWS)


def read(spark: SparkSession, path: str, kind: str, most: int = BLOCK, index: DataFrame | None = None, rows: int = 20_000) -> DataFrame:
    """Rows of binary files of a kind with the file's path, a task for each block. ``index`` is a kept
    ``block_index`` of the same files; without one it is made and stored."""
    decode, schema = mb.FORMATS[kind]
    names = ["path", *(x.split()[0] for x in schema.split(", "))]
    shifted = {"map": 0, "visibility": 0}.get(kind)
    index = cut(block_index(spark, path, kind, most)) if index is None else index

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, first, start, end, count, head in pdf.itertuples(index=False):
                system, inner = opened(name)
                with system.open_input_file(inner) as source:
                    data = _small(source, kind, first, start, end, count, bytes(head))
                held = []
                for row in decode(data):
                    held.append((name, *row) if shifted is None else (name, row[shifted] + first, *row[1:]))
                    if len(held) == rows:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return index.repartition(max(1, min(index.count(), TASKS))).mapInPandas(kernel, f"path string, {schema}")


# -- writing ---------------------------------------------------------------------------


def _joined(df: DataFrame, path: str, order: list[str], encode: Callable[[pd.DataFrame], bytes], head: Callable[[int], bytes]) -> None:
    """One file of a table: parts by ranges of the order, then one stream of a head and the parts.

    Each attempt of a task writes a part of its own name, and only the parts that the finished tasks
    report are joined; the file appears whole, by a move. Parts are deleted at the end."""
    spark = df.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, inner = opened(folder)
        name, rows, size, out = f"{inner}/{part:06d}-{uuid.uuid4().hex}", 0, 0, None
        for pdf in batches:
            if len(pdf):
                if out is None:
                    system.create_dir(inner, recursive=True)
                    out = system.open_output_stream(name)
                data = encode(pdf)
                out.write(data)
                rows, size = rows + len(pdf), size + len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame([(part, name, rows, size)], columns=["part", "path", "rows", "bytes"])

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(kernel, PART_ROWS))
    # A row that stands for the head, so that a table without rows has a file too.
    every = parts.union(spark.range(1).selectExpr("-1", "CAST(NULL AS STRING)", "0L", "0L"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A row for each part, as many as the write had partitions.
        table = pd.concat(list(batches)).sort_values("part")
        system, inner = opened(path)
        made = f"{inner}.{uuid.uuid4().hex}"
        system.create_dir(inner.rsplit("/", 1)[0] or "/", recursive=True)
        with system.open_output_stream(made) as out:
            out.write(head(int(table["rows"].sum())))
            for name in table["path"].iloc[1:]:
                with system.open_input_file(name) as source:
                    while data := source.read(COPY):
                        out.write(data)
        system.move(made, inner)
        yield table.assign(path=path)

    every.repartition(1).mapInPandas(join, PART_ROWS).agg(F.sum("bytes")).collect()
    drop(parts)
    system, inner = opened(folder)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def write(df: DataFrame, path: str, kind: str) -> None:
    """One binary model file of cameras, images, points or visibility, in the order of its first column.
    Other columns than those of the kind are left out."""
    encode = {"cameras": mb.encode_cameras, "images": mb.encode_images, "points": mb.encode_points}.get(kind)
    names = [x.split()[0] for x in mb.FORMATS[kind][1].split(", ")]

    def body(pdf: pd.DataFrame) -> bytes:
        rows = list(pdf.itertuples(index=False, name=None))
        return (encode(rows) if encode else mb.encode_visibility([r[1] for r in rows]))[8:]

    own = df.select(*names)
    if kind == "images":
        # Long arrays with nulls would reach pandas as floats; -1 has the bits that stand for no point.
        own = own.withColumn("points", F.transform("points", lambda p: F.coalesce(p, F.lit(-1))))
    _joined(own, path, names[:1], body, lambda n: struct.pack("<Q", n))


#: Properties of the vertices that are written.
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def write_cloud(df: DataFrame, path: str, *order: str) -> None:
    """A binary PLY of x, y, z, nx, ny, nz, r, g, b rows in an order."""

    def body(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(len(pdf), VERTEX)
        for own, column in zip(VERTEX.names, ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"), strict=True):
            out[own] = pdf[column]
        return out.tobytes()

    def head(n: int) -> bytes:
        kinds = {"f": "float", "u": "uchar"}
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {kinds[VERTEX[c].kind]} {c}" for c in VERTEX.names), "end_header", ""]
        return "\n".join(lines).encode()

    _joined(df, path, list(order), body, head)


def write_map(df: DataFrame, path: str) -> None:
    """A dense map of (row, col, values) rows: every cell once, values of one length."""
    width, height, least, depth, cells = df.agg(F.max("col") + 1, F.max("row") + 1, F.min(F.size("values")), F.max(F.size("values")), F.count("*")).first()
    if not cells or cells != width * height or least != depth:
        raise ValueError("a dense map needs every cell once, with values of one length")
    planes = df.select("row", "col", F.posexplode("values").alias("plane", "value"))
    _joined(planes, path, ["plane", "row", "col"], lambda pdf: pdf["value"].to_numpy("<f4").tobytes(), lambda n: f"{width}&{height}&{depth}&".encode())
