"""Poses, projections, cameras, ellipsoids and planes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a point behind the camera costs, and the two ellipsoids' axes.
BEHIND = 1.7976931348623157e308
EPS = 2.220446049250313e-16
ELLIPSOIDS = {"WGS84": (6378137.0, 6356752.314245), "GRS80": (6378137.0, 6356752.314140)}
#: Ids on either side of a pair are below this.
MAX_IMAGES = 2147483647

Vector = tuple[Column, ...]


def pair_id(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("long") * MAX_IMAGES + F.greatest(a, b)


def pair_images(pair: Column) -> tuple[Column, Column]:
    second = pair % MAX_IMAGES
    return ((pair - second) / MAX_IMAGES).cast("long"), second


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def normalized(q: Vector) -> Vector:
    """A unit quaternion; a zero one becomes (1, x, y, z)."""
    n = norm(q)
    zero = n == 0
    return (F.when(zero, 1.0).otherwise(q[0] / F.nullif(n, F.lit(0.0))), *(F.when(zero, c).otherwise(c / F.nullif(n, F.lit(0.0))) for c in q[1:]))


def inverted(q: Vector) -> Vector:
    return (q[0], -q[1], -q[2], -q[3])


def hamilton(a: Vector, b: Vector) -> Vector:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def rotation(q: Vector) -> tuple[Vector, Vector, Vector]:
    """Rows of the rotation matrix of a unit quaternion."""
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def rotated(q: Vector, p: Vector) -> Vector:
    return tuple(dot(row, p) for row in rotation(q))


def center(q: Vector, t: Vector) -> Vector:
    """A camera's projection centre, -R't."""
    return tuple(-c for c in rotated(inverted(q), t))


def to_camera(q: Vector, t: Vector, p: Vector) -> Vector:
    return tuple(a + b for a, b in zip(rotated(q, p), t, strict=True))


def project(cam: Vector, f: Column, cx: Column, cy: Column) -> Vector:
    """Pixel of a camera-frame point under a pinhole with one focal length."""
    z = F.nullif(cam[2], F.lit(0.0))
    return f * cam[0] / z + cx, f * cam[1] / z + cy


def squared_error(pixel: Vector, projected: Vector, depth: Column, square=None) -> Column:
    """``square`` is a function of a column, the product with itself unless another is given."""
    d = minus(pixel, projected)
    return F.when(depth < EPS, BEHIND).otherwise(sum((square(x) for x in d[1:]), square(d[0])) if square else dot(d, d))


def relative_pose(q1: Vector, t1: Vector, q2: Vector, t2: Vector) -> tuple[Vector, Vector]:
    q = hamilton(normalized(q2), inverted(normalized(q1)))
    return q, tuple(a - b for a, b in zip(t2, rotated(q, t1), strict=True))


def ray_angle(c1: Vector, c2: Vector, p: Vector) -> Column:
    """Angle between the rays from two centres to a point, at most a right angle;
    0 where a ray has no length."""
    base, a, b = (dot(d, d) for d in (minus(c1, c2), minus(p, c1), minus(p, c2)))
    low = F.sqrt(a * b) * 2
    angle = F.abs(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a + b - base) / F.nullif(low, F.lit(0.0))))))
    return F.when(low == 0, 0.0).otherwise(F.least(angle, F.lit(3.141592653589793) - angle))


def bogus_camera(f: Column, cx: Column, cy: Column, width: Column, height: Column, low: float, high: float) -> Column:
    ratio = f / F.greatest(width, height)
    return (ratio < low) | (ratio > high) | (cx < 0) | (cx > width) | (cy < 0) | (cy > height)


def ecef(lat: Column, lon: Column, alt: Column, ellipsoid: str = "WGS84") -> Vector:
    a, b = ELLIPSOIDS[ellipsoid]
    e2 = (a * a - b * b) / (a * a)
    la, lo = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - e2) + alt) * F.sin(la)


def geodetic(x: Column, y: Column, z: Column, ellipsoid: str = "WGS84", rounds: int = 10) -> Vector:
    """Latitude, longitude (degrees) and altitude, by a fixed number of rounds."""
    a, b = ELLIPSOIDS[ellipsoid]
    e2 = (a * a - b * b) / (a * a)
    r = F.sqrt(x * x + y * y)
    first = F.atan2(z, r * (1 - e2))

    def step(lat):
        n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        return F.atan2(z + e2 * n * F.sin(lat), r)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda acc, _: step(acc))
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), r / F.cos(lat) - n


def enu(p: Vector, origin: Vector, lat0: Column, lon0: Column) -> Vector:
    """East, north, up of an ECEF point relative to another one."""
    d = minus(p, origin)
    la, lo = F.radians(lat0), F.radians(lon0)
    return (
        -F.sin(lo) * d[0] + F.cos(lo) * d[1],
        -F.sin(la) * F.cos(lo) * d[0] - F.sin(la) * F.sin(lo) * d[1] + F.cos(la) * d[2],
        F.cos(la) * F.cos(lo) * d[0] + F.cos(la) * F.sin(lo) * d[1] + F.sin(la) * d[2],
    )


def opencv_distorted(u: Column, v: Column, k1: float, k2: float, p1: float, p2: float) -> Vector:
    uv, r2 = u * v, u * u + v * v
    radial = k1 * r2 + k2 * r2 * r2
    return u + u * radial + 2 * p1 * uv + p2 * (r2 + 2 * u * u), v + v * radial + 2 * p2 * uv + p1 * (r2 + 2 * v * v)


def plane_offset(normal: Vector, p: Vector) -> Column:
    return -dot(normal, p)


def is_ground(nx: Column, ny: Column, nz: Column) -> Column:
    return (F.abs(ny) > 10 * F.abs(nx)) & (F.abs(ny) > 10 * F.abs(nz))


def hamming_weight(h: Column, sigma: float = 16.0, most: int = 24) -> Column:
    return F.when(h <= most, F.exp(-(h * h) / (sigma * sigma))).otherwise(0.0)


def unit_root(values: Column) -> Column:
    """L1-root normalisation of a descriptor."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(values, lambda x: F.sqrt(F.abs(x) / F.nullif(total, F.lit(0.0))))


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_bits(values: Column, thresholds: Column | None = None) -> Column:
    """64-bit signature: bit i is set where value i is above its threshold."""
    above = F.transform(values, lambda x: (x > 0).cast("long")) if thresholds is None else F.zip_with(values, thresholds, lambda x, t: (x > t).cast("long"))
    return F.aggregate(F.transform(above, lambda x, i: F.call_function("shiftleft", x, i)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def slerp(a: Vector, b: Vector, t) -> Vector:
    """Spherical interpolation of unit quaternions, the short way round."""
    d = dot(a, b)
    angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
    near = F.abs(d) >= 1 - EPS
    low = F.nullif(F.sin(angle), F.lit(0.0))
    one = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / low)
    two = F.when(near, F.lit(t)).otherwise(F.sin(t * angle) / low) * F.when(d < 0, -1.0).otherwise(1.0)
    return tuple(one * x + two * y for x, y in zip(a, b, strict=True))


def inverse_pose(q: Vector, t: Vector) -> tuple[Vector, Vector]:
    back = inverted(normalized(q))
    return back, tuple(-c for c in rotated(back, t))


def chained_pose(q1: Vector, t1: Vector, q2: Vector, t2: Vector) -> tuple[Vector, Vector]:
    """First pose one, then pose two."""
    second = normalized(q2)
    return hamilton(second, normalized(q1)), tuple(a + b for a, b in zip(rotated(second, t1), t2, strict=True))


def interpolated_pose(q1: Vector, t1: Vector, q2: Vector, t2: Vector, t: float) -> tuple[Vector, Vector]:
    return slerp(normalized(q1), normalized(q2), t), tuple(a + (b - a) * t for a, b in zip(t1, t2, strict=True))


def from_rotation(rows: tuple[Vector, Vector, Vector]) -> Vector:
    """The quaternion of a rotation matrix, by the greatest of its trace and diagonal."""
    (a, b, c), (d, e, f), (g, h, i) = rows
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x)) * 2
    w, x, y, z = root(1 + a + e + i), root(1 + a - e - i), root(1 - a + e - i), root(1 - a - e + i)
    over = lambda n, s: n / F.nullif(s, F.lit(0.0))
    by = [
        (w / 4, over(h - f, w), over(c - g, w), over(d - b, w)),
        (over(h - f, x), x / 4, over(b + d, x), over(c + g, x)),
        (over(c - g, y), over(b + d, y), y / 4, over(f + h, y)),
        (over(d - b, z), over(c + g, z), over(f + h, z), z / 4),
    ]
    pick = F.when(a + e + i > 0, 0).when((a >= e) & (a >= i), 1).when(e >= i, 2).otherwise(3)
    return tuple(F.when(pick == 0, by[0][k]).when(pick == 1, by[1][k]).when(pick == 2, by[2][k]).otherwise(by[3][k]) for k in range(4))


def euler(rows: tuple[Vector, Vector, Vector]) -> Vector:
    """Angles about x, y and z of a rotation matrix."""
    return F.atan2(rows[2][1], rows[2][2]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -rows[2][0]))), F.atan2(rows[1][0], rows[0][0])


def rotation_between(a: Vector, b: Vector) -> tuple[Vector, Vector, Vector]:
    """The matrix that turns direction a into b; the identity where they are opposite."""
    na, nb = norm(a), norm(b)
    u, w = tuple(x / na for x in a), tuple(x / nb for x in b)
    v, c = cross(u, w), dot(u, w)
    k = F.when(c == -1, 0.0).otherwise(1 / F.nullif(1 + c, F.lit(0.0)))
    on = F.when(c == -1, 0.0).otherwise(1.0)
    zero = F.lit(0.0)
    skew = ((zero, -v[2], v[1]), (v[2], zero, -v[0]), (-v[1], v[0], zero))
    square = tuple(tuple(sum((skew[i][m] * skew[m][j] for m in range(3)), zero) for j in range(3)) for i in range(3))
    return tuple(tuple((1.0 if i == j else 0.0) + on * skew[i][j] + k * square[i][j] for j in range(3)) for i in range(3))


class Similarity:
    """scale * R * x + t, of columns or numbers."""

    def __init__(self, scale, q: Vector, t: Vector):
        number = lambda x: x if isinstance(x, Column) else F.lit(float(x))
        self.scale, self.q, self.t = number(scale), tuple(map(number, q)), tuple(map(number, t))

    def point(self, p: Vector) -> Vector:
        return tuple(self.scale * a + b for a, b in zip(rotated(self.q, p), self.t, strict=True))

    def inverse(self) -> Similarity:
        back = inverted(self.q)
        return Similarity(1 / self.scale, back, tuple(-c / self.scale for c in rotated(back, self.t)))

    def pose(self, q: Vector, t: Vector) -> tuple[Vector, Vector]:
        """The pose that sees a moved model as the given one sees it unmoved."""
        back = self.inverse()
        return hamilton(normalized(q), back.q), tuple(self.scale * (a + b) for a, b in zip(rotated(q, back.t), t, strict=True))


def enu_inverse(e: Vector, origin: Vector, lat0: Column, lon0: Column) -> Vector:
    """ECEF of an east, north, up point relative to an origin."""
    la, lo = F.radians(lat0), F.radians(lon0)
    return (
        -F.sin(lo) * e[0] - F.sin(la) * F.cos(lo) * e[1] + F.cos(la) * F.cos(lo) * e[2] + origin[0],
        F.cos(lo) * e[0] - F.sin(la) * F.sin(lo) * e[1] + F.cos(la) * F.sin(lo) * e[2] + origin[1],
        F.cos(la) * e[1] + F.sin(la) * e[2] + origin[2],
    )


def model_coordinates(to_model: Similarity, lat: Column, lon: Column, alt: Column) -> Vector:
    """Model coordinates of a place on earth: the altitude is the model's z, not the earth's radius."""
    x, y, _ = to_model.point(ecef(lat, lon, F.lit(0.0)))
    return x, y, to_model.scale * alt


def sampson(e: tuple[Vector, Vector, Vector], x1: Vector, x2: Vector) -> Column:
    """Squared Sampson error of a match under an essential or fundamental matrix."""
    a = tuple(r[0] * x1[0] + r[1] * x1[1] + r[2] for r in e)
    b = tuple(e[0][k] * x2[0] + e[1][k] * x2[1] + e[2][k] for k in range(2))
    d = x2[0] * a[0] + x2[1] * a[1] + a[2]
    return d * d / F.nullif(a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1], F.lit(0.0))


def transfer_error(h: tuple[Vector, Vector, Vector], x1: Vector, x2: Vector) -> Column:
    """Squared distance of a match from its place under a homography."""
    a = tuple(r[0] * x1[0] + r[1] * x1[1] + r[2] for r in h)
    low = F.nullif(a[2], F.lit(0.0))
    d = (a[0] / low - x2[0], a[1] / low - x2[1])
    return dot(d, d)


def essential(q: Vector, t: Vector) -> tuple[Vector, Vector, Vector]:
    """[t]x R of a relative pose, t of unit length."""
    n = F.nullif(norm(t), F.lit(0.0))
    u = tuple(c / n for c in t)
    r = rotation(q)
    return tuple(tuple(u[(i + 1) % 3] * r[(i + 2) % 3][j] - u[(i + 2) % 3] * r[(i + 1) % 3][j] for j in range(3)) for i in range(3))


def epipoles(q: Vector, t: Vector) -> tuple[Vector, Vector]:
    """Where each camera of a relative pose sees the other one, as unit rays: in the first, in the second."""
    n = F.nullif(norm(t), F.lit(0.0))
    u = tuple(c / n for c in t)
    r = rotation(q)
    return tuple(-sum((r[i][j] * u[i] for i in range(1, 3)), r[0][j] * u[0]) for j in range(3)), u


def plane_homography(q: Vector, t: Vector, normal: Vector, distance, one: Vector, two: Vector) -> tuple[Vector, Vector, Vector]:
    """Homography that the plane (unit normal, distance) in the first camera's frame induces between two pinhole images (f, cx, cy)."""
    r = rotation(q)
    m = tuple(tuple(r[i][j] - t[i] * normal[j] / distance for j in range(3)) for i in range(3))
    left = (*(tuple(two[0] * m[i][j] + two[1 + i] * m[2][j] for j in range(3)) for i in range(2)), m[2])
    return tuple((a / one[0], b / one[0], c - (a * one[1] + b * one[2]) / one[0]) for a, b, c in left)


def projection_rows(q: Vector, t: Vector, cam: Vector, f: Column) -> list[tuple[Vector, Vector, Vector]]:
    """Derivatives of a pinhole pixel, for u and for v: by the world point, by a small turn of the camera, by its translation."""
    r, low = rotation(q), F.nullif(cam[2], F.lit(0.0))
    turned = minus(cam, t)
    out = []
    for k in range(2):
        by_move = tuple(f / low if i == k else (-f * cam[k] / (low * low) if i == 2 else F.lit(0.0)) for i in range(3))
        out.append((tuple(dot(by_move, tuple(r[i][j] for i in range(3))) for j in range(3)), cross(turned, by_move), by_move))
    return out


def keypoint_shape(a11: Column, a12: Column, a21: Column, a22: Column) -> Vector:
    """Scale, orientation and shear of a keypoint's affine shape."""
    turn = F.atan2(a21, a11)
    return (F.sqrt(a11 * a11 + a21 * a21) + F.sqrt(a12 * a12 + a22 * a22)) / 2, turn, F.atan2(-a12, a22) - turn


def match_transform(one: Vector, two: Vector) -> Vector:
    """Scale, angle and translation that take a feature (x, y, scale, orientation) to its match."""
    scale, angle = two[2] / one[2], two[3] - one[3]
    c, s = F.cos(angle), F.sin(angle)
    return scale, angle, two[0] - scale * (c * one[0] - s * one[1]), two[1] - scale * (s * one[0] + c * one[1])


def frustum_corners(q: Vector, t: Vector, f: Column, cx: Column, cy: Column, width, height, reach: float) -> list[Vector]:
    """The camera's centre and the four corners of its view at a depth, in world coordinates."""
    back = inverted(q)
    c = center(q, t)
    low = ((F.lit(0.0) - cx) / f, (F.lit(0.0) - cy) / f)
    high = ((width - cx) / f, (height - cy) / f)
    rays = [(high[0], high[1]), (high[0], low[1]), (low[0], low[1]), (low[0], high[1])]
    return [c, *(tuple(a + reach * b for a, b in zip(c, rotated(back, (x, y, F.lit(1.0))), strict=True)) for x, y in rays)]


def plane_through(a: Vector, b: Vector, c: Vector) -> Vector:
    """Normal and offset of the plane through three points."""
    n = cross(minus(b, a), minus(c, a))
    return (*n, -dot(n, a))


def on_plane(u: Column, v: Column, f: Column, cx: Column, cy: Column, plane: Vector) -> Vector:
    """Where a pixel's ray meets a plane, in the camera's frame."""
    x, y = (u - cx) / f, (v - cy) / f
    z = -plane[3] / F.nullif(plane[0] * x + plane[1] * y + plane[2], F.lit(0.0))
    return z * x, z * y, z


def jet(gray: Column) -> Vector:
    """Red, green and blue (0 to 1) of a gray value: three ramps a quarter apart, cut at 0.87."""
    ramp = lambda x: F.when(x > 0.87, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - 4 * F.abs(x - 0.5))))
    return ramp(gray - 0.25), ramp(gray), ramp(gray + 0.25)
