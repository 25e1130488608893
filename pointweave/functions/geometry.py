"""Camera, splat and mask geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Real spherical-harmonic factors by degree.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH4 = (2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def rotation(q: Column) -> list[Column]:
    """Row-major 3x3 rotation of a quaternion (w, x, y, z), normalised first."""
    length = F.sqrt(sum((q[i] * q[i] for i in range(4)), F.lit(0.0)))
    w, x, y, z = (q[i] / length for i in range(4))
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def covariance(q: Column, s: Column) -> list[Column]:
    """Upper six of R S S R^T for a quaternion and three scales: xx, xy, xz, yy, yz, zz."""
    r = rotation(q)
    at = lambda i, j: sum((r[3 * i + k] * r[3 * j + k] * s[k] * s[k] for k in range(3)), F.lit(0.0))
    return [at(0, 0), at(0, 1), at(0, 2), at(1, 1), at(1, 2), at(2, 2)]


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def projection(fovx: Column, fovy: Column, near: float = 0.01, far: float = 100.0) -> Column:
    """Row-major 4x4 perspective matrix that looks along +z."""
    z = F.lit(0.0)
    rows = [1 / F.tan(fovx / 2), z, z, z, z, 1 / F.tan(fovy / 2), z, z, z, z, F.lit(far / (far - near)), F.lit(-far * near / (far - near)), z, z, F.lit(1.0), z]
    return F.array(*[r.cast("double") for r in rows])


def to_view(r: Column, t: Column, p: Column) -> list[Column]:
    """World to camera: R p + t, R row-major."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def pixel(x: Column, z: Column, focal: Column, centre: Column) -> Column:
    """Image coordinate, cut toward zero."""
    return (x * focal / z + centre).cast("long")


def splat(view: list[Column], cov: list[Column], focal: tuple[Column, Column], tan: tuple[Column, Column]) -> dict[str, Column]:
    """A splat's 2D covariance (low-passed by 0.3), its inverse and its radius in pixels.

    The view position is held to 1.3 times the view's opening; ``cov`` is in camera axes.
    """
    x, y, z = view
    hold = lambda v, t: F.greatest(-1.3 * t, F.least(1.3 * t, v / z)) * z
    hx, hy = hold(x, tan[0]), hold(y, tan[1])
    j00, j02, j11, j12 = focal[0] / z, -focal[0] * hx / (z * z), focal[1] / z, -focal[1] * hy / (z * z)
    xx, xy, xz, yy, yz, zz = cov
    a = j00 * j00 * xx + 2 * j00 * j02 * xz + j02 * j02 * zz + 0.3
    b = j00 * j11 * xy + j00 * j12 * xz + j02 * j11 * yz + j02 * j12 * zz
    c = j11 * j11 * yy + 2 * j11 * j12 * yz + j12 * j12 * zz + 0.3
    det = a * c - b * b
    mid = (a + c) / 2
    largest = mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    return {"det": det, "conic_a": c / det, "conic_b": -b / det, "conic_c": a / det, "radius": F.ceil(3 * F.sqrt(largest)).cast("int")}


def tile_rect(x: Column, y: Column, radius: Column, tiles_x: Column, tiles_y: Column, side: int = 16) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) of the tiles that a splat's square may touch, end exclusive."""
    hold = lambda v, most: F.least(most, F.greatest(F.lit(0), v.cast("int")))
    return hold((x - radius) / side, tiles_x), hold((y - radius) / side, tiles_y), hold((x + radius + side - 1) / side, tiles_x), hold((y + radius + side - 1) / side, tiles_y)


def sh(degree: int, c: Column, d: list[Column]) -> Column:
    """Spherical-harmonic colour of one channel: coefficients ``c`` in order, direction ``d``."""
    x, y, z = d
    out = SH0 * c[0]
    if degree > 0:
        out = out - SH1 * y * c[1] + SH1 * z * c[2] - SH1 * x * c[3]
    if degree > 1:
        basis = [x * y, y * z, 2 * z * z - x * x - y * y, x * z, x * x - y * y]
        out = out + sum((k * b * c[4 + i] for i, (k, b) in enumerate(zip(SH2, basis, strict=True))), F.lit(0.0))
    if degree > 2:
        basis = [y * (3 * x * x - y * y), x * y * z, y * (4 * z * z - x * x - y * y), z * (2 * z * z - 3 * x * x - 3 * y * y), x * (4 * z * z - x * x - y * y), z * (x * x - y * y), x * (x * x - 3 * y * y)]
        out = out + sum((k * b * c[9 + i] for i, (k, b) in enumerate(zip(SH3, basis, strict=True))), F.lit(0.0))
    if degree > 3:  # directions are of unit length here
        p, q = 7 * z * z - 1, 7 * z * z - 3
        even = x * x - y * y
        basis = [x * y * even, y * z * (3 * x * x - y * y), x * y * p, y * z * q, 35 * z * z * z * z - 30 * z * z + 3, x * z * q, even * p, x * z * (x * x - 3 * y * y), x * x * (x * x - 3 * y * y) - y * y * (3 * x * x - y * y)]
        out = out + sum((k * b * c[16 + i] for i, (k, b) in enumerate(zip(SH4, basis, strict=True))), F.lit(0.0))
    if not 0 <= degree <= 4:
        raise ValueError(f"no spherical harmonics of degree {degree}")
    return out


def rgb_to_sh(x: Column) -> Column:
    return (x - 0.5) / SH0


def sh_to_rgb(x: Column) -> Column:
    return F.least(F.greatest(x * SH0 + 0.5, F.lit(0.0)), F.lit(1.0))


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], tolerance: float = 20.0) -> Column:
    """Whether any side lies within ``tolerance`` of the crop's side but not of the image's."""
    any_ = F.lit(False)
    for b, c, i in zip(box, crop, image, strict=True):
        any_ = any_ | ((F.abs(b - c) <= tolerance) & ~(F.abs(b - i) <= tolerance))
    return any_


def point_grid(spark, side: int):
    """(i, x, y): the centres of a side x side grid over the unit square, row by row."""
    step = 1.0 / side
    return spark.range(side * side).select(F.col("id").alias("i"), ((F.col("id") % side + 0.5) * step).alias("x"), ((F.floor(F.col("id") / side) + 0.5) * step).alias("y"))


def crop_boxes(spark, width: int, height: int, layers: int, overlap: float):
    """(layer, x0, y0, x1, y1): the whole image, then 2^i by 2^i overlapping crops a layer."""
    rows = [(0, 0, 0, width, height)]
    for layer in range(1, layers + 1):
        n = 2**layer
        shared = int(overlap * min(width, height) * (2 / n))
        w, h = (int(math.ceil((shared * (n - 1) + side) / n)) for side in (width, height))
        for i in range(n):
            for j in range(n):
                x, y = int((w - shared) * i), int((h - shared) * j)
                rows.append((layer, x, y, min(x + w, width), min(y + h, height)))
    return spark.createDataFrame(rows, "layer int, x0 int, y0 int, x1 int, y1 int")


def gaussian_window(size: int, sigma: float) -> list[float]:
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(w) for x in w]


def to_width_height(box: list[Column]) -> list[Column]:
    """x0, y0, x1, y1 as x0, y0, width, height."""
    return [box[0], box[1], box[2] - box[0], box[3] - box[1]]


def uncrop(box: list[Column], crop: list[Column]) -> list[Column]:
    """A crop's box in the image."""
    return [box[0] + crop[0], box[1] + crop[1], box[2] + crop[0], box[3] + crop[1]]
