"""Queries of poses, cameras, keypoints, places and other scalar families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import cameras as cam
from trackloom.functions import geometry as geo
from trackloom.functions import scalars as sc
from trackloom.operators import stats
from trackloom.operators.rounds import cut
from trackloom.plans.adapters import view
from trackloom.plans.base import DIGITS, cols, query, rounded
from trackloom.plans.registry import ECEF_SQL, located

#: A pose that turns about all axes: the images' own, with two fixed parts and normalised.
TURNED_SQL = """WITH i AS (SELECT image_id, qw/sqrt(105e-2) AS w, 1e-1/sqrt(105e-2) AS x, 2e-1/sqrt(105e-2) AS y, qz/sqrt(105e-2) AS z, tx, ty, tz FROM images),
    r AS (SELECT *, 1-2*(y*y+z*z) AS r00, 2*(x*y-w*z) AS r01, 2*(x*z+w*y) AS r02, 2*(x*y+w*z) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-w*x) AS r12,
        2*(x*z-w*y) AS r20, 2*(y*z+w*x) AS r21, 1-2*(x*x+y*y) AS r22 FROM i)"""


def t_cols():
    return cols("tx", "ty", "tz")


def q_cols():
    return cols("w", "x", "y", "z")


def turned(spark, d):
    q = geo.normalized((F.col("qw"), F.lit(0.1), F.lit(0.2), F.col("qz")))
    return view(spark, d, "images").select("image_id", *(c.alias(n) for c, n in zip(q, "wxyz", strict=True)), *t_cols())


def named(values, names):
    return [(F.round(v, DIGITS) + 0.0).alias(n) for v, n in zip(values, names.split(), strict=True)]


@query("SELECT event_id, isnan(x) AS nan, isinf(x) AS inf FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('-infinity' AS DOUBLE) ELSE value END AS x FROM events) AS t")
def f02_finite(spark, d):
    e = F.col("event_id")
    x = F.when(e % 7 == 0, float("nan")).when(e % 11 == 0, float("-inf")).otherwise(F.col("value"))
    return view(spark, d, "events").select("event_id", F.isnan(x).alias("nan"), (sc.is_infinite(x) & ~F.isnan(x)).alias("inf"))


@query(
    """SELECT event_id, round((1/(1+exp(-(2*10e0*value/100-10e0)*5e-1))-1/(1+exp(5e0)))/(1/(1+exp(-5e0))-1/(1+exp(5e0))), 6) AS scaled FROM events"""
)
def f10_scale_sigmoid(spark, d):
    return rounded(view(spark, d, "events").select("event_id", sc.scale_sigmoid(F.col("value") / 100, 0.5, 10.0).alias("scaled")))


@query(
    """WITH p AS (SELECT point3d_id, x-1e0 AS a, y AS b, z-20 AS c FROM points3d), q AS (SELECT *, b*b-4*a*c AS d FROM p WHERE a <> 0)
    SELECT point3d_id, round(-b/a, 6)+0e0 AS linear, round(CASE WHEN d < 0 THEN -b/(2*a) ELSE least((-b-sqrt(greatest(d, 0)))/(2*a), (-b+sqrt(greatest(d, 0)))/(2*a)) END, 6)+0e0 AS low,
    round(CASE WHEN d < 0 THEN -b/(2*a) ELSE greatest((-b-sqrt(greatest(d, 0)))/(2*a), (-b+sqrt(greatest(d, 0)))/(2*a)) END, 6)+0e0 AS high, round(CASE WHEN d < 0 THEN sqrt(-d)/abs(2*a) ELSE 0 END, 6) AS imaginary FROM q""",
    "points3d",
)
def f12_roots(spark, d):
    a, b, c = F.col("x") - 1, F.col("y"), F.col("z") - 20
    return view(spark, d, "points3d").filter(a != 0).select("point3d_id", *named((sc.linear_root(a, b), *sc.quadratic_roots(a, b, c)), "linear low high imaginary"))


@query("SELECT o_orderkey, printf('%08d_%s_%.3f', o_orderkey, o_orderstatus, o_totalprice) AS name FROM orders")
def f20_printf(spark, d):
    return view(spark, d, "orders").select("o_orderkey", F.format_string("%08d_%s_%.3f", "o_orderkey", "o_orderstatus", "o_totalprice").alias("name"))


@query(
    """SELECT p_partkey, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r, lower(p_brand) AS low, contains(p_type, 'E') AS has_e FROM part"""
)
def f25_trims(spark, d):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return view(spark, d, "part").select("p_partkey", F.ltrim(padded).alias("l"), F.rtrim(padded).alias("r"), F.lower("p_brand").alias("low"), F.contains("p_type", F.lit("E")).alias("has_e"))


@query("SELECT p_partkey, p_size || ', ' || p_partkey || ', ' || p_brand AS csv, p_size = 7 OR p_partkey = 7 AS has_seven, p_size = p_partkey AS twice FROM part")
def f28_lists(spark, d):
    numbers = F.array(F.col("p_size").cast("long"), "p_partkey")
    text = sc.doubles_to_csv(F.array(F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), "p_brand"))
    return view(spark, d, "part").select("p_partkey", text.alias("csv"), F.array_contains(numbers, F.lit(7).cast("long")).alias("has_seven"), sc.has_duplicate(numbers).alias("twice"))


@query(
    TURNED_SQL
    + """ SELECT image_id, round(w, 6) AS iw, round(-x, 6) AS ix, round(-y, 6) AS iy, round(-z, 6)+0e0 AS iz, round(w*w-x*x-y*y-z*z, 6) AS cw, round(2*w*x, 6) AS cx, round(2*w*y, 6) AS cy, round(2*w*z, 6) AS cz,
    round(r00+2*r01+3*r02, 6) AS px, round(r10+2*r11+3*r12, 6) AS py, round(r20+2*r21+3*r22, 6) AS pz FROM r""",
    "images",
)
def f41_quaternions(spark, d):
    one = geo.rotated(q_cols(), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return turned(spark, d).select("image_id", *named((*geo.inverted(q_cols()), *geo.hamilton(q_cols(), q_cols()), *one), "iw ix iy iz cw cx cy cz px py pz"))


@query(TURNED_SQL + " SELECT image_id, round(atan2(r21, r22), 6) AS ax, round(asin(-r20), 6) AS ay, round(atan2(r10, r00), 6) AS az, round(abs(w), 6) AS qw, round(x*sign(w), 6) AS qx, round(y*sign(w), 6) AS qy, round(z*sign(w), 6) AS qz FROM r WHERE abs(w) > 1e-3", "images")
def f42_euler(spark, d):
    rows = geo.rotation(q_cols())
    back = geo.from_rotation(rows)
    sign = F.when(back[0] < 0, -1.0).otherwise(1.0)
    return turned(spark, d).filter("abs(w) > 1e-3").select("image_id", *named((*geo.euler(rows), *(c * sign for c in back)), "ax ay az qw qx qy qz"))


@query(
    """WITH v AS (SELECT point3d_id, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM points3d WHERE z > 0)
    SELECT point3d_id, round(x, 6)+0e0 AS tx, round(y, 6)+0e0 AS ty, round(z, 6)+0e0 AS tz, round(z+y*y/(1+z), 6)+0e0 AS r00, 3e0-3e0 AS off FROM v""",
    "points3d",
)
def f44_unit_rotation(spark, d):
    """The rotation from the z axis to each point's direction takes the axis there."""
    z = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = geo.rotation_between(z, cols(*"xyz"))
    off = geo.dot(rows[0], rows[1])
    return view(spark, d, "points3d").filter("z > 0").select("point3d_id", *named((*(geo.dot(r, z) for r in rows), rows[0][0], F.round(off, 9) + 0.0), "tx ty tz r00 off"))


@query(
    TURNED_SQL
    + """ SELECT image_id, round(-(r00*tx+r10*ty+r20*tz), 6)+0e0 AS ix, round(-(r01*tx+r11*ty+r21*tz), 6)+0e0 AS iy, round(-(r02*tx+r12*ty+r22*tz), 6)+0e0 AS iz,
    round(r00*tx+r01*ty+r02*tz+tx, 6)+0e0 AS cx, round(r10*tx+r11*ty+r12*tz+ty, 6)+0e0 AS cy, round(r20*tx+r21*ty+r22*tz+tz, 6)+0e0 AS cz, round(cos(acos(least(1e0, abs(w)))*0.25e0), 6) AS sw, round(0.25e0*tx, 6)+0e0 AS sx FROM r""",
    "images",
)
def f46_poses(spark, d):
    """Inverse, pose after itself, and a quarter of the way from the identity."""
    _, back = geo.inverse_pose(q_cols(), t_cols())
    _, twice = geo.chained_pose(q_cols(), t_cols(), q_cols(), t_cols())
    q, t = geo.interpolated_pose(tuple(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)), (F.lit(0.0),) * 3, q_cols(), t_cols(), 0.25)
    return turned(spark, d).select("image_id", *named((*back, *twice, F.abs(q[0]), t[0]), "ix iy iz cx cy cz sw sx"))


@query(
    """WITH o AS (SELECT a.point3d_id, a.image_id AS image_id1, b.image_id AS image_id2, a.depth AS d1, b.depth AS d2, sqrt(power(a.ox-b.ox, 2)+power(a.oy-b.oy, 2)+power(a.oz-b.oz, 2)) AS base
        FROM observed AS a JOIN observed AS b ON a.point3d_id = b.point3d_id AND a.image_id < b.image_id)
    SELECT image_id1, image_id2, round(max(base), 6) AS baseline, count(*) FILTER (WHERE d1 > 2.220446049250313e-16 AND d2 > 2.220446049250313e-16 AND d1 < 1000*base AND d2 < 1000*base) AS in_front FROM o GROUP BY image_id1, image_id2""",
    "observed",
)
def f47_cheirality(spark, d):
    return rounded(stats.cheirality(view(spark, d, "observed")))


#: Rays of observations in a moderate field of view.
RAYS = "SELECT point3d_id, image_id, px/depth AS u, py/depth AS v, f, cx, cy FROM observed WHERE depth > 0.5e0 AND abs(px/depth) < 5e-1 AND abs(py/depth) < 5e-1"


def rays(spark, d):
    o = view(spark, d, "observed").filter("depth > 0.5").select("point3d_id", "image_id", (F.col("px") / F.col("depth")).alias("u"), (F.col("py") / F.col("depth")).alias("v"), *cols("f", "cx", "cy"))
    return o.filter("abs(u) < 0.5 AND abs(v) < 0.5")


@query(
    f"""WITH r AS ({RAYS}), s AS (SELECT *, u*u+v*v AS r2, sqrt(u*u+v*v) AS r, atan(sqrt(u*u+v*v)) AS t FROM r)
    SELECT point3d_id, image_id, round(f*u+cx, 6) AS pinhole, round(f*u*(1+1e-1*r2)+cx, 6) AS simple_radial, round(f*v*(1+1e-1*r2-2e-2*r2*r2)+cy, 6) AS radial,
    round(f*(u*(1+1e-1*r2-2e-2*r2*r2)+2*1e-3*u*v+2e-3*(r2+2*u*u))+cx, 6) AS opencv, round(f*(CASE WHEN r > 1e-12 THEN u*t*(1+1e-1*t*t+2e-2*power(t, 4))/r ELSE u END)+cx, 6) AS fisheye,
    round(f*(CASE WHEN r > 1e-12 THEN u*atan(2*r*tan(4e-1))/(8e-1*r) ELSE u END)+cx, 6) AS fov FROM s""",
    "observed",
)
def f55_world_to_image(spark, d):
    f, cx, cy = cols("f", "cx", "cy")
    own = {"PINHOLE": [f, f, cx, cy], "SIMPLE_RADIAL": [f, cx, cy, 0.1], "RADIAL": [f, cx, cy, 0.1, -0.02], "OPENCV": [f, f, cx, cy, 0.1, -0.02, 0.001, 0.002], "RADIAL_FISHEYE": [f, cx, cy, 0.1, 0.02], "FOV": [f, f, cx, cy, 0.8]}
    found = {m: cam.world_to_image(m, p, F.col("u"), F.col("v")) for m, p in own.items()}
    return rounded(rays(spark, d).select("point3d_id", "image_id", *(found[m][1 if m == "RADIAL" else 0].alias(n) for m, n in zip(own, "pinhole simple_radial radial opencv fisheye fov".split(), strict=True))))


@query(f"SELECT point3d_id, image_id, model, round(u+3e-7, 5)+0e0 AS u, round(v+3e-7, 5)+0e0 AS v FROM ({RAYS}) AS r, (SELECT unnest(['FULL_OPENCV', 'THIN_PRISM_FISHEYE', 'FOV']) AS model) AS m", "observed")
def f55_image_to_world(spark, d):
    """Pixels of three distorted models lead back to their rays."""
    f, cx, cy = cols("f", "cx", "cy")
    own = {
        "FULL_OPENCV": [f, f, cx, cy, 0.05, -0.02, 0.001, 0.002, 0.01, 0.01, 0.005, 0.001],
        "THIN_PRISM_FISHEYE": [f, f, cx, cy, 0.05, 0.01, 0.001, 0.002, 0.001, 0.001, 0.001, 0.002], "FOV": [f, f, cx, cy, 0.8],
    }
    r = rays(spark, d)
    out = None
    for model, params in own.items():
        x, y = cam.world_to_image(model, params, F.col("u"), F.col("v"))
        pixels = r.select("point3d_id", "image_id", f, cx, cy, x.alias("x"), y.alias("y"))
        u, v = cam.image_to_world(model, params, F.col("x"), F.col("y"))
        part = pixels.select("point3d_id", "image_id", F.lit(model).alias("model"), (F.round(u + 3e-7, 5) + 0.0).alias("u"), (F.round(v + 3e-7, 5) + 0.0).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT camera_id, round((f+f*11e-1)/2, 6) AS focal, round(f*5e-1, 6) AS fx, round(f*11e-1*25e-2, 6) AS fy, round(cx*5e-1, 6) AS cx, round(cy*25e-2, 6) AS cy, round(4/((f+f*11e-1)/2), 9) AS threshold, f/1000 < 6e-1 AS bogus FROM cameras", "cameras")
def f57_cameras(spark, d):
    """Mean focal length, parameters of a rescaled image, a threshold on the image plane."""
    f, cx, cy = cols("f", "cx", "cy")
    params = [f, f * 1.1, cx, cy]
    fx, fy, x, y = cam.rescaled("PINHOLE", params, 0.5, 0.25)
    bogus = geo.bogus_camera(f, cx, cy, F.col("width"), F.col("height"), 0.6, 10.0)
    return view(spark, d, "cameras").select("camera_id", *named((cam.focal_mean("PINHOLE", params), fx, fy, x, y), "focal fx fy cx cy"), F.round(cam.world_threshold("PINHOLE", params, 4.0), 9).alias("threshold"), bogus.alias("bogus"))


ENU_SQL = ECEF_SQL + """, o AS (SELECT x AS x0, y AS y0, z AS z0 FROM e WHERE image_id = (SELECT min(image_id) FROM e)), c AS (SELECT image_id, x-x0 AS dx, y-y0 AS dy, z-z0 AS dz, radians(47e0) AS la, radians(8e0) AS lo FROM e, o)"""


@query(ENU_SQL + " SELECT image_id, round(-sin(lo)*dx+cos(lo)*dy, 4)+0e0 AS east, round(-sin(la)*cos(lo)*dx-sin(la)*sin(lo)*dy+cos(la)*dz, 4)+0e0 AS north, round(cos(la)*cos(lo)*dx+cos(la)*sin(lo)*dy+sin(la)*dz, 4)+0e0 AS up FROM c", "images")
def f60_enu(spark, d):
    """East, north and up of each image relative to the first one."""
    first = located(spark, d).orderBy("image_id").limit(1).select(*(F.col(c).alias(f"{c}0") for c in "xyz"))
    found = geo.enu(cols(*"xyz"), cols("x0", "y0", "z0"), F.lit(47.0), F.lit(8.0))
    return located(spark, d).join(F.broadcast(first)).select("image_id", *((F.round(c, 4) + 0.0).alias(n) for c, n in zip(found, ("east", "north", "up"), strict=True)))


@query("SELECT image_id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 3)+0e0 AS alt FROM images", "images")
def f60_enu_to_ellipsoid(spark, d):
    """There and back over the plane of the first image."""
    first = located(spark, d).orderBy("image_id").limit(1).select(*(F.col(c).alias(f"{c}0") for c in "xyz"))
    origin = cols("x0", "y0", "z0")
    plane = located(spark, d).join(F.broadcast(first)).select("image_id", *origin, *(c.alias(n) for c, n in zip(geo.enu(cols(*"xyz"), origin, F.lit(47.0), F.lit(8.0)), "enu", strict=True)))
    lat, lon, alt = geo.geodetic(*geo.enu_inverse(cols(*"enu"), origin, F.lit(47.0), F.lit(8.0)))
    return plane.select("image_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), (F.round(alt, 3) + 0.0).alias("alt"))


@query(
    """WITH s AS (SELECT point3d_id, 2*(6e-1*x-8e-1*y)+1 AS mx, 2*(8e-1*x+6e-1*y)-2 AS my, 2*z+3 AS mz, x, y, z FROM points3d)
    SELECT point3d_id, round(mx, 6)+0e0 AS x, round(my, 6)+0e0 AS y, round(mz, 6)+0e0 AS z, round(x, 6)+0e0 AS bx, round(y, 6)+0e0 AS by, round(z, 6)+0e0 AS bz FROM s""",
    "points3d",
)
def f61_moved_points(spark, d):
    """A similarity moves the points, and its inverse takes them back."""
    half = (0.8**0.5, 0.0, 0.0, 0.2**0.5)
    move = geo.Similarity(2.0, half, (1.0, -2.0, 3.0))
    moved = move.point(cols(*"xyz"))
    return view(spark, d, "points3d").select("point3d_id", *named((*moved, *move.inverse().point(moved)), "x y z bx by bz"))


@query("SELECT point3d_id, image_id, round(2*depth, 6)+0e0 AS depth, round(f*px/depth+cx, 4)+0e0 AS u FROM observed WHERE depth > 0.5e0", "observed")
def f61_moved_poses(spark, d):
    """Moving points and poses alike leaves pixels where they are; depths grow by the scale."""
    move = geo.Similarity(2.0, (0.8**0.5, 0.0, 0.0, 0.2**0.5), (1.0, -2.0, 3.0))
    im = view(spark, d, "images").select("image_id", "qw", "qx", "qy", "qz", *t_cols())
    q, t = move.pose(cols("qw", "qx", "qy", "qz"), t_cols())
    poses = im.select("image_id", *(c.alias(n) for c, n in zip((*q, *t), "aw ax ay az bx by bz".split(), strict=True)))
    rows = view(spark, d, "observed").filter("depth > 0.5").join(poses, "image_id")
    seen = geo.to_camera(cols("aw", "ax", "ay", "az"), cols("bx", "by", "bz"), move.point(cols(*"xyz")))
    u, _ = geo.project(seen, *cols("f", "cx", "cy"))
    return rows.select("point3d_id", "image_id", (F.round(seen[2], DIGITS) + 0.0).alias("depth"), (F.round(u, 4) + 0.0).alias("u"))


@query(
    """WITH c AS (SELECT -((1-2*qz*qz)*tx+2*qw*qz*ty) AS ox, -(-2*qw*qz*tx+(1-2*qz*qz)*ty) AS oy, -tz AS oz FROM images WHERE registered),
    b AS (SELECT 10/sqrt(power(max(ox)-min(ox), 2)+power(max(oy)-min(oy), 2)+power(max(oz)-min(oz), 2)) AS s, avg(ox) AS mx, avg(oy) AS my, avg(oz) AS mz FROM c)
    SELECT point3d_id, round(s*(x-mx), 5)+0e0 AS x, round(s*(y-my), 5)+0e0 AS y, round(s*(z-mz), 5)+0e0 AS z FROM points3d, b""",
    "images points3d",
)
def f62_normalized_model(spark, d):
    """The model scaled to an extent of ten about the mean of its cameras."""
    centers = view(spark, d, "images").filter("registered").select(*(c.alias(n) for c, n in zip(geo.center(cols("qw", "qx", "qy", "qz"), t_cols()), "xyz", strict=True)))
    moved = stats.normalized_points(view(spark, d, "points3d"), centers, 10.0)
    return moved.select("point3d_id", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


@query(
    """WITH n AS (SELECT image_id, radians(lat) AS la, radians(lon) AS lo, alt, 6378137e0/sqrt(1-(1-6356752.314245e0*6356752.314245e0/(6378137e0*6378137e0))*sin(radians(lat))*sin(radians(lat))) AS r FROM images)
    SELECT image_id, round(1e-3*(6e-1*r*cos(la)*cos(lo)-8e-1*r*cos(la)*sin(lo))+5, 4) AS x, round(1e-3*(8e-1*r*cos(la)*cos(lo)+6e-1*r*cos(la)*sin(lo))+6, 4) AS y, round(1e-3*alt, 6) AS z FROM n""",
    "images",
)
def f64_model_coordinates(spark, d):
    to_model = geo.Similarity(1e-3, (0.8**0.5, 0.0, 0.0, 0.2**0.5), (5.0, 6.0, 7.0))
    x, y, z = geo.model_coordinates(to_model, *cols("lat", "lon", "alt"))
    return view(spark, d, "images").select("image_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 6).alias("z"))


@query(
    """WITH c AS (SELECT image_id, -((1-2*qz*qz)*tx+2*qw*qz*ty) AS ox, -(-2*qw*qz*tx+(1-2*qz*qz)*ty) AS oy, -tz AS oz, 1-2*qz*qz AS c, 2*qw*qz AS s, (1000-cx)/f AS xh, (800-cy)/f AS yh, -cx/f AS xl, -cy/f AS yl FROM images AS i JOIN cameras AS k ON i.camera_id = k.camera_id)
    SELECT image_id, round(ox+40*(c*xh+s*yh), 5)+0e0 AS x1, round(oy+40*(-s*xh+c*yh), 5)+0e0 AS y1, round(ox+40*(c*xl+s*yl), 5)+0e0 AS x3, round(oy+40*(-s*xl+c*yl), 5)+0e0 AS y3, round(oz+40, 5)+0e0 AS z FROM c""",
    "images cameras",
)
def f67_frustum(spark, d):
    """Corners of each image's view 40 m ahead, which with the centre bound its five planes."""
    rows = view(spark, d, "images").join(F.broadcast(view(spark, d, "cameras")), "camera_id")
    _, one, _, three, _ = geo.frustum_corners(cols("qw", "qx", "qy", "qz"), t_cols(), *cols("f", "cx", "cy"), F.col("width"), F.col("height"), 40.0)
    return rows.select("image_id", *((F.round(c, 5) + 0.0).alias(n) for c, n in zip((one[0], one[1], three[0], three[1], one[2]), ("x1", "y1", "x3", "y3", "z"), strict=True)))


@query(
    """SELECT point3d_id, image_id, round(-d/k*(u-cx)/f+3e-7, 5)+0e0 AS x, round(-d/k*(v-cy)/f+3e-7, 5)+0e0 AS y, round(-d/k+3e-7, 5)+0e0 AS z
    FROM (SELECT *, -(1e-1*px+2e-1*py+9e-1*depth) AS d, 1e-1*(u-cx)/f+2e-1*(v-cy)/f+9e-1 AS k FROM points2d WHERE depth > 0.5e0 AND abs(u) < 5000 AND abs(v) < 5000) AS t WHERE abs(k) > 1e-2""",
    "points2d",
)
def f68_ray_plane(spark, d):
    """Where each feature's ray meets the plane through its point."""
    p = view(spark, d, "points2d").filter("depth > 0.5 AND abs(u) < 5000 AND abs(v) < 5000")
    normal = tuple(F.lit(x) for x in (0.1, 0.2, 0.9))
    plane = (*normal, geo.plane_offset(normal, cols("px", "py", "depth")))
    k = normal[0] * (F.col("u") - F.col("cx")) / F.col("f") + normal[1] * (F.col("v") - F.col("cy")) / F.col("f") + normal[2]
    found = geo.on_plane(*cols("u", "v", "f", "cx", "cy"), plane)
    return p.filter(F.abs(k) > 1e-2).select("point3d_id", "image_id", *((F.round(c + 3e-7, 5) + 0.0).alias(n) for c, n in zip(found, "xyz", strict=True)))


@query(
    """SELECT a.point3d_id, a.image_id AS image_id1, b.image_id AS image_id2, round(power(8e-1*a.px/a.depth+6e-1*a.py/a.depth-(b.py/b.depth-1e-2), 2)/2, 6) AS error
    FROM observed AS a JOIN observed AS b ON a.point3d_id = b.point3d_id AND a.image_id < b.image_id WHERE a.depth > 0.5e0 AND b.depth > 0.5e0""",
    "observed",
)
def f70_sampson(spark, d):
    """Sampson errors of all matches under a sideways move and a turn about the axis."""
    e = geo.essential(tuple(F.lit(x) for x in (0.8**0.5, 0.0, 0.0, 0.2**0.5)), (F.lit(3.0), F.lit(0.0), F.lit(0.0)))
    o = view(spark, d, "observed").filter("depth > 0.5").withColumn("u", F.col("px") / F.col("depth")).withColumn("v", F.col("py") / F.col("depth"))
    both = stats.co_observations(o, "u", "v")
    error = geo.sampson(e, cols("u1", "v1"), (F.col("u2") + 0.01, F.col("v2") - 0.01))
    return rounded(both.select("point3d_id", "image_id1", "image_id2", error.alias("error")))


@query(
    """WITH k AS (SELECT lidar_id, 1+abs(x) AS a11, y*1e-1 AS a12, x*1e-1 AS a21, 1+abs(y) AS a22, x, y FROM lidar)
    SELECT lidar_id, round((sqrt(a11*a11+a21*a21)+sqrt(a12*a12+a22*a22))/2, 6) AS scale, round(atan2(a21, a11), 6)+0e0 AS turn, round(atan2(-a12, a22)-atan2(a21, a11), 6)+0e0 AS shear, round(x*15e-1, 6)+0e0 AS x, round(a22*8e-1, 6) AS b22 FROM k""",
    "lidar",
)
def f72_keypoint_shapes(spark, d):
    """Scale, orientation and shear of affine keypoints, and their values in a rescaled image."""
    x, y = cols("x", "y")
    a = 1 + F.abs(x), y * 0.1, x * 0.1, 1 + F.abs(y)
    k = view(spark, d, "lidar").select("lidar_id", "x", *(c.alias(n) for c, n in zip(a, ("a11", "a12", "a21", "a22"), strict=True)))
    shapes = k.select("lidar_id", "x", "a22", *named(geo.keypoint_shape(*cols("a11", "a12", "a21", "a22")), "scale turn shear"))
    return stats.rescaled_keypoints(shapes, 1.5, 0.8).select("lidar_id", "scale", "turn", "shear", (F.round("x", DIGITS) + 0.0).alias("x"), F.round("a22", DIGITS).alias("b22"))


@query(
    """SELECT src, dst, src_idx, dst_idx, round((1+dst_idx%3)/CAST(1+src_idx%3 AS DOUBLE), 6) AS scale, round((dst-src)*1e-2, 6) AS angle,
    round(dst_idx-(1+dst_idx%3)/CAST(1+src_idx%3 AS DOUBLE)*(cos((dst-src)*1e-2)*src_idx-sin((dst-src)*1e-2)*point3d_id), 4)+0e0 AS tx FROM edges WHERE src < dst""",
    "edges",
)
def f74_match_transforms(spark, d):
    e = view(spark, d, "edges").filter("src < dst")
    real = lambda c: F.col(c).cast("double")
    one = (real("src_idx"), real("point3d_id"), (1 + F.col("src_idx") % 3).cast("double"), real("src") * 0.01)
    two = (real("dst_idx"), real("point3d_id"), (1 + F.col("dst_idx") % 3).cast("double"), real("dst") * 0.01)
    scale, angle, tx, _ = geo.match_transform(one, two)
    return e.select("src", "dst", "src_idx", "dst_idx", F.round(scale, 6).alias("scale"), F.round(angle, 6).alias("angle"), (F.round(tx, 4) + 0.0).alias("tx"))


@query(
    """WITH g AS (SELECT event_id, value/100 AS g FROM events), b AS (SELECT event_id, unnest([g-25e-2, g, g+25e-2]) AS v, unnest(['r', 'g', 'b']) AS c FROM g), s AS (SELECT event_id, c, CASE WHEN v > 87e-2 THEN 0 ELSE greatest(0, least(1, 15e-1-4*abs(v-5e-1))) END AS v FROM b)
    SELECT event_id, round(max(CASE WHEN c = 'r' THEN v END), 6) AS r, round(max(CASE WHEN c = 'g' THEN v END), 6) AS g, round(max(CASE WHEN c = 'b' THEN v END), 6) AS b FROM s GROUP BY event_id"""
)
def f76_jet(spark, d):
    return view(spark, d, "events").select("event_id", *named(geo.jet(F.col("value") / 100), "r g b"))


@query(
    """SELECT image_id, row_number() OVER (ORDER BY hash_key, image_id) AS place FROM (SELECT image_id, (image_id*7919) % 1009 AS hash_key FROM images) AS t WHERE image_id % 3 <> 0""",
    "images",
)
def r02_training_images(spark, d):
    """A fixed shuffle of the images that may train a vocabulary."""
    im = view(spark, d, "images").filter("image_id % 3 <> 0").withColumn("key", F.col("image_id") * 7919 % 1009)
    return im.select("image_id", F.row_number().over(Window.orderBy("key", "image_id")).alias("place"))


PAIR_SQL = """WITH m AS (SELECT a.image_id AS image_id1, b.image_id AS image_id2, cos(1e-1*(b.image_id-a.image_id)) AS c, sin(1e-1*(b.image_id-a.image_id)) AS s, a.tx AS x, a.ty AS y, a.tz AS z, b.tx AS x2, b.ty AS y2, b.tz AS z2,
    ca.f AS f1, ca.cx AS cx1, ca.cy AS cy1, cb.f AS f2, cb.cx AS cx2, cb.cy AS cy2 FROM pairs AS p JOIN images AS a ON p.image_id1 = a.image_id JOIN images AS b ON p.image_id2 = b.image_id JOIN cameras AS ca ON a.camera_id = ca.camera_id JOIN cameras AS cb ON b.camera_id = cb.camera_id),
    t AS (SELECT *, x2-(c*x-s*y) AS tx, y2-(s*x+c*y) AS ty, z2-z AS tz FROM m), u AS (SELECT *, tx/n AS ux, ty/n AS uy, tz/n AS uz FROM (SELECT *, CASE WHEN sqrt(tx*tx+ty*ty+tz*tz) > 1e-9 THEN sqrt(tx*tx+ty*ty+tz*tz) END AS n FROM t) AS t)"""


def _image_pairs(spark, d):
    """Image pairs with their relative pose (q0 to q3, t0 to t2) and both cameras."""
    pose = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    names = ("image_id", *pose, "f", "cx", "cy", "ox", "oy", "oz")
    i = view(spark, d, "images").join(view(spark, d, "cameras"), "camera_id").select("image_id", *pose, "f", "cx", "cy", *(c.alias(n) for c, n in zip(geo.center(cols(*pose[:4]), cols(*pose[4:])), ("ox", "oy", "oz"), strict=True)))
    i = cut(i)  # its size is known then: the estimate for a join would send the pairs through a shuffle for each end
    one, two = (i.select(*(F.col(n).alias(f"{n}{k}") for n in names)) for k in (1, 2))
    apart = geo.norm(geo.minus(cols("ox1", "oy1", "oz1"), cols("ox2", "oy2", "oz2"))) > 1e-9
    both = view(spark, d, "pairs").select("image_id1", "image_id2").join(one, "image_id1").join(two, "image_id2").filter(apart)
    q, t = geo.relative_pose(cols("qw1", "qx1", "qy1", "qz1"), cols("tx1", "ty1", "tz1"), cols("qw2", "qx2", "qy2", "qz2"), cols("tx2", "ty2", "tz2"))
    return both.select("image_id1", "image_id2", *(F.col(f"{n}{k}") for k in (1, 2) for n in ("f", "cx", "cy")), *(c.alias(f"q{k}") for k, c in enumerate(q)), *(c.alias(f"t{k}") for k, c in enumerate(t)))


@query(
    PAIR_SQL
    + """ SELECT image_id1, image_id2, round(-uz*s, 6)+0e0 AS e11, round(-uz*c, 6)+0e0 AS e12, round(uy, 6)+0e0 AS e13, round(ux*s-uy*c, 6)+0e0 AS e31, round(uy*s+ux*c, 6)+0e0 AS e32,
    round(-(c*ux+s*uy), 6)+0e0 AS ox, round(s*ux-c*uy, 6)+0e0 AS oy, round(-uz, 6)+0e0 AS oz, round(ux, 6)+0e0 AS px, round(uy, 6)+0e0 AS py, round(uz, 6)+0e0 AS pz FROM u WHERE n IS NOT NULL""",
    "pairs images cameras",
)
def f69_essential_epipoles(spark, d):
    """Essential matrices of known poses, and the epipoles of both images."""
    q, t = cols("q0", "q1", "q2", "q3"), cols("t0", "t1", "t2")
    e, (first, second) = geo.essential(q, t), geo.epipoles(q, t)
    wanted = (*e[0], *e[2][:2], *first, *second)
    return _image_pairs(spark, d).select("image_id1", "image_id2", *((F.round(c, DIGITS) + 0.0).alias(n) for c, n in zip(wanted, "e11 e12 e13 e31 e32 ox oy oz px py pz".split(), strict=True)))


@query(
    PAIR_SQL
    + """ SELECT image_id1, image_id2, round(f2*(1e-1*c+2e-1*s-tx/2e1)/(1-tz/2e1)+cx2, 4)+0e0 AS x, round(f2*(1e-1*s-2e-1*c-ty/2e1)/(1-tz/2e1)+cy2, 4)+0e0 AS y FROM u WHERE n IS NOT NULL""",
    "pairs images cameras",
)
def f69_plane_homography(spark, d):
    """Where a pixel of the first image lies in the second, through a plane 20 before the first camera."""
    plane = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    h = geo.plane_homography(cols("q0", "q1", "q2", "q3"), cols("t0", "t1", "t2"), plane, F.lit(20.0), cols("f1", "cx1", "cy1"), cols("f2", "cx2", "cy2"))
    at = (F.col("cx1") + 0.1 * F.col("f1"), F.col("cy1") - 0.2 * F.col("f1"), F.lit(1.0))
    x, y, low = (geo.dot(r, at) for r in h)
    return _image_pairs(spark, d).select("image_id1", "image_id2", (F.round(x / low, 4) + 0.0).alias("x"), (F.round(y / low, 4) + 0.0).alias("y"))


@query(
    """WITH v AS (SELECT o.point3d_id, o.image_id, f*px/depth+cx-u AS ru, f*py/depth+cy-v AS rv, f/depth AS a, -f*px/(depth*depth) AS b, -f*py/(depth*depth) AS e, 1-2*qz*qz AS c, 2*qw*qz AS s, px-tx AS vx, py-ty AS vy, depth-tz AS vz
    FROM points2d AS o JOIN images AS i ON o.image_id = i.image_id WHERE depth > 5e-1)
    SELECT point3d_id, image_id, round(ru, 4)+0e0 AS ru, round(rv, 4)+0e0 AS rv, round(a*c, 4)+0e0 AS ux, round(-a*s, 4)+0e0 AS uy, round(b, 4)+0e0 AS uz, round(vy*b, 4)+0e0 AS u1, round(vz*a-vx*b, 4)+0e0 AS u2, round(-vy*a, 4)+0e0 AS u3,
    round(a*s, 4)+0e0 AS vx, round(a*c, 4)+0e0 AS vy, round(e, 4)+0e0 AS vz, round(vy*e-vz*a, 4)+0e0 AS v1, round(-vx*e, 4)+0e0 AS v2, round(vx*a, 4)+0e0 AS v3 FROM v""",
    "points2d images",
)
def m15_visual_evaluation(spark, d):
    """Residuals of all observations and their derivatives by point and by turn of the camera."""
    poses = view(spark, d, "images").select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    o = view(spark, d, "points2d").filter("depth > 0.5").join(poses, "image_id")
    cam, f = cols("px", "py", "depth"), F.col("f")
    (by_u, turn_u, _), (by_v, turn_v, _) = geo.projection_rows(cols("qw", "qx", "qy", "qz"), cols("tx", "ty", "tz"), cam, f)
    found = [c - F.col(n) for c, n in zip(geo.project(cam, f, *cols("cx", "cy")), "uv", strict=True)]
    wanted = zip((*found, *by_u, *turn_u, *by_v, *turn_v), "ru rv ux uy uz u1 u2 u3 vx vy vz v1 v2 v3".split(), strict=True)
    return o.select("point3d_id", "image_id", *((F.round(c, 4) + 0.0).alias(n) for c, n in wanted))
