"""Views that read relational tables as the tables of a multi-view model.

Each view is one SELECT that Spark SQL and DuckDB both run, so queries and their
oracle SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.geometry import pair_id
from trackloom.operators.stats import shared_points

VIEWS = {
    "cameras": """SELECT n_nationkey+1 AS camera_id, 1 AS model, 1000 AS width, 800 AS height, 500e0+20*n_nationkey AS f,
        500e0 AS cx, 400e0 AS cy, (n_nationkey % 2 = 0) AS prior_focal FROM nation""",
    "images": """SELECT s_suppkey+1 AS image_id, s_name AS name, s_nationkey+1 AS camera_id, cos(5e-2*s_suppkey) AS qw, 0e0 AS qx, 0e0 AS qy,
        sin(5e-2*s_suppkey) AS qz, CAST(s_suppkey%10-5 AS DOUBLE) AS tx, CAST(CAST(floor(s_suppkey/10e0) AS BIGINT)%10-5 AS DOUBLE) AS ty,
        CAST(s_suppkey%7-3 AS DOUBLE) AS tz, (s_acctbal >= 0) AS registered, 47e0+(s_suppkey%10)*1e-3+s_suppkey*s_suppkey*1e-8 AS lat,
        8e0+CAST(floor(s_suppkey/10e0) AS BIGINT)*1e-3 AS lon, CAST(s_suppkey%50 AS DOUBLE) AS alt FROM supplier""",
    "points3d": """SELECT p_partkey+1 AS point3d_id, (p_partkey%100)/10e0-5 AS x, (p_partkey%37)/4e0-5 AS y, CAST(p_size AS DOUBLE) AS z,
        CAST(p_size*5%256 AS INT) AS r, CAST(p_partkey%256 AS INT) AS g, CAST(p_partkey%97 AS INT) AS b,
        CASE WHEN p_partkey%11=0 THEN NULL ELSE (p_partkey%97)/10e0 END AS error, CAST(p_partkey%20 AS INT) AS global_opt_num FROM part""",
    "tracks": """SELECT point3d_id, image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY point3d_id)-1 AS INT) AS idx
        FROM (SELECT DISTINCT l_partkey+1 AS point3d_id, l_suppkey+1 AS image_id FROM lineitem) AS t""",
    "observed": """SELECT t.point3d_id, t.image_id, t.idx, i.camera_id, i.registered, p.x, p.y, p.z, c.f, c.cx, c.cy,
        (1-2*i.qz*i.qz)*p.x-2*i.qw*i.qz*p.y+i.tx AS px, 2*i.qw*i.qz*p.x+(1-2*i.qz*i.qz)*p.y+i.ty AS py, p.z+i.tz AS depth,
        -((1-2*i.qz*i.qz)*i.tx+2*i.qw*i.qz*i.ty) AS ox, -(-2*i.qw*i.qz*i.tx+(1-2*i.qz*i.qz)*i.ty) AS oy, -i.tz AS oz
        FROM tracks AS t JOIN images AS i ON t.image_id = i.image_id JOIN cameras AS c ON i.camera_id = c.camera_id JOIN points3d AS p ON t.point3d_id = p.point3d_id""",
    "points2d": """SELECT point3d_id, image_id, idx, registered, depth, f, cx, cy, px, py,
        f*px/nullif(depth, 0e0)+cx+((7*point3d_id+13*image_id)%21-10) AS u, f*py/nullif(depth, 0e0)+cy+((5*point3d_id+3*image_id)%21-10) AS v FROM observed""",
    "edges": """SELECT a.image_id AS src, a.idx AS src_idx, b.image_id AS dst, b.idx AS dst_idx, a.point3d_id
        FROM tracks AS a JOIN tracks AS b ON a.point3d_id = b.point3d_id AND a.image_id <> b.image_id""",
    "pairs": """SELECT src*2147483647+dst AS pair_id, src AS image_id1, dst AS image_id2, count(*) AS n_rows,
        CAST(2+(src*2147483647+dst)%6 AS INT) AS config FROM edges WHERE src < dst GROUP BY src, dst""",
    "descriptors": """SELECT CAST(label+1 AS BIGINT) AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS idx, vec_id, embedding AS descriptor FROM embeddings""",
    "lidar": """SELECT l_orderkey*8+l_linenumber AS lidar_id, (l_extendedprice-1000*floor(l_extendedprice/1000e0))/100e0-5 AS x, l_discount*100-5 AS y, l_quantity AS z,
        l_tax*10 AS nx, 1e0 AS ny, l_discount*10-5e-1 AS nz FROM lineitem""",
    "journal": """SELECT row_number() OVER (ORDER BY ts, event_id) AS revision, event_type AS kind, user_id AS entity, event_id FROM events""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needs(name: str) -> list[str]:
    """A view and the views under it, lowest first."""
    found: list[str] = []
    for other in re.findall(r"(?:FROM|JOIN) (\w+)", VIEWS[name]):
        if other in VIEWS:
            found += [x for x in needs(other) if x not in found]
    return [*found, name]


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view over the parquet tables of ``sf_dir``; views under it that are given are not read anew."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "pairs":
        return _pairs(view(spark, sf_dir, "tracks"))
    views = needs(name)
    text = "WITH " + ", ".join(f"{v} AS (SELECT * FROM {{{v}}})" if v in given else f"{v} AS ({VIEWS[v]})" for v in views) + f" SELECT * FROM {name}"
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`" if m[2] in BASE else m[0], text), **given)


def _pairs(tracks: DataFrame) -> DataFrame:
    """The view ``pairs`` without its edges one by one."""
    key = pair_id(F.col("image_id1"), F.col("image_id2"))
    found = shared_points(tracks).withColumn("pair_id", key)
    return found.select("pair_id", "image_id1", "image_id2", F.col("shared").alias("n_rows"), (2 + F.col("pair_id") % 6).cast("int").alias("config"))


def oracle(text: str, *names: str) -> str:
    """DuckDB SQL that starts from views."""
    views: list[str] = []
    for name in names:
        views += [v for v in needs(name) if v not in views]
    rest = text.strip()
    own = ", " + rest[5:].lstrip() if rest.upper().startswith("WITH ") else " " + rest
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + own if views else rest
