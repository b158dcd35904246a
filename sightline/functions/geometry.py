"""Column functions for poses, projection, voxels and colours.

Everything here builds JVM expressions; nothing runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]

# Fixed values
VOXEL_M = 0.02
AXIS_BITS = 21
AXIS_HALF = 1 << (AXIS_BITS - 1)
AXIS_MASK = (1 << AXIS_BITS) - 1
NORM_FLOOR = 1e-12
PARALLEL_DOT = 0.9995


# -------------------------------------------------------------------- colour

def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def unpack_rgb(packed: Column) -> tuple[Column, Column, Column]:
    byte = F.lit(255).cast("long")
    return tuple(F.shiftright(packed, s).bitwiseAND(byte) for s in (16, 8, 0))


def colour_hex(packed: Column) -> Column:
    return F.lower(F.lpad(F.hex(packed), 6, "0"))


def parse_hex(text: Column) -> Column:
    return F.conv(F.ltrim(text, F.lit("#")), 16, 10).cast("long")


def golden_hue(ident: Column) -> Column:
    """Hue in [0, 1) that separates neighbouring ids."""
    return F.pmod(ident * F.lit(0.61803398875), F.lit(1.0))


# -------------------------------------------------------------------- voxels

def cell_index(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def cell_centre(i: Column, size: float) -> Column:
    return (i.cast("double") + F.lit(0.5)) * F.lit(float(size))


def voxel_key(x: Column, y: Column, z: Column, size: float = VOXEL_M, mode: str = "clip") -> Column:
    """21 bits per axis in one long. Out-of-range cells are clipped or raise."""
    parts = []
    for v in (x, y, z):
        i = cell_index(v, size)
        if mode == "clip":
            i = F.greatest(F.lit(-AXIS_HALF).cast("long"), F.least(i, F.lit(AXIS_HALF - 1).cast("long")))
        elif mode == "error":
            i = F.when((i >= -AXIS_HALF) & (i < AXIS_HALF), i).otherwise(
                F.raise_error(F.lit("voxel index out of range")).cast("long")
            )
        else:
            raise ValueError(mode)
        parts.append(i + AXIS_HALF)
    a, b, c = parts
    return F.shiftleft(a, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(b, AXIS_BITS)).bitwiseOR(c)


def voxel_index(key: Column) -> tuple[Column, Column, Column]:
    mask = F.lit(AXIS_MASK).cast("long")
    return tuple(
        F.shiftright(key, s).bitwiseAND(mask) - AXIS_HALF for s in (2 * AXIS_BITS, AXIS_BITS, 0)
    )


def shift_key(key: Column, di: int, dj: int, dk: int) -> Column:
    """Key of the cell moved by whole steps along the axes."""
    return key + F.lit((di << 2 * AXIS_BITS) + (dj << AXIS_BITS) + dk).cast("long")


# --------------------------------------------------------------------- poses

def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm([p - q for p, q in zip(a, b)])


def rotation_of(q: Vec) -> list[list[Column]]:
    """Rotation matrix of a quaternion (x, y, z, w); identity when it vanishes."""
    n = norm(q)
    zero = n < NORM_FLOOR
    x, y, z, w = [F.when(zero, F.lit(1.0 if k == 3 else 0.0)).otherwise(v / n) for k, v in enumerate(q)]
    one, two = F.lit(1.0), F.lit(2.0)
    return [
        [one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w)],
        [two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w)],
        [two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y)],
    ]


def camera_to_world(p: Vec, rot: Sequence[Vec], t: Vec) -> list[Column]:
    return [dot(row, p) + o for row, o in zip(rot, t)]


def world_to_camera(p: Vec, rot: Sequence[Vec], t: Vec) -> list[Column]:
    d = [a - b for a, b in zip(p, t)]
    return [dot([rot[r][c] for r in range(3)], d) for c in range(3)]


def quat_product(a: Vec, b: Vec) -> list[Column]:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def slerp(a: Vec, b: Vec, s: Column) -> list[Column]:
    """Shortest-arc interpolation; nearly parallel ends fall back to a straight blend."""
    d = dot(a, b)
    sign = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    c = F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(c)
    close = c > PARALLEL_DOT
    den = F.when(close, F.lit(1.0)).otherwise(F.sin(angle))
    wa = F.when(close, F.lit(1.0) - s).otherwise(F.sin((F.lit(1.0) - s) * angle) / den)
    wb = F.when(close, s).otherwise(F.sin(s * angle) / den) * sign
    blend = [p * wa + q * wb for p, q in zip(a, b)]
    n = norm(blend)
    return [v / n for v in blend]


# ---------------------------------------------------------------- projection

def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    return [(u - F.lit(cx)) / F.lit(fx) * depth, (v - F.lit(cy)) / F.lit(fy) * depth, depth]


def project(cam: Vec, fx: float, fy: float, cx: float, cy: float, rounding: str = "truncate") -> tuple[Column, Column]:
    """Pixel of a camera-frame point; NULL behind the camera."""
    z = F.when(cam[2] > 0, cam[2])
    u = F.lit(fx) * cam[0] / z + F.lit(cx)
    v = F.lit(fy) * cam[1] / z + F.lit(cy)
    as_pixel = {
        "truncate": lambda c: c.cast("long"),
        "rint": lambda c: F.rint(c).cast("long"),
        "round": lambda c: F.round(c).cast("long"),
    }[rounding]
    return as_pixel(u), as_pixel(v)


def depth_metres(raw: Column) -> Column:
    """Millimetres to metres, 0 means no reading."""
    return F.when(raw != 0, raw / F.lit(1000.0))


def footprint_px(z: Column, fx: float, size: float = VOXEL_M, near: float = 0.1) -> Column:
    """Image area covered by one voxel seen at depth z."""
    return F.pow(F.lit(size * fx) / F.greatest(z, F.lit(near)), F.lit(2.0))


def splat_radius(z: Column, fx: float, size: float = VOXEL_M, most: int = 12) -> Column:
    """Pixels around a drawn point; ``most`` keeps points right before the camera from covering the image."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.lit(0.5 * size * fx) / z))).cast("int")


# ------------------------------------------------------------------- scoring

def tolerant_iou(p: Column, r: Column) -> Column:
    """P*R / (P + R - P*R), 0 when both are 0."""
    num = p * r
    den = p + r - num
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def unit_vector(v: Column) -> Column:
    """Array scaled to length 1 with the norm floored."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(NORM_FLOOR)))


def vector_dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid_weight(area: Column, anchor: float, scale: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(area - F.lit(anchor)) / F.lit(scale)))


def fused_score(w: Column, iou: Column, closeness: Column) -> Column:
    """Large masks trust overlap, small ones trust the distance of the centres."""
    return w * (F.lit(1.0) + iou) + (F.lit(1.0) - w) * closeness
