"""Column builders over boxes STRUCT<x0, y0, x1, y1>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def x_center(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def y_center(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def intersects(a: Column, b: Column) -> Column:
    """Touching boxes do."""
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def intersection_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def scaled(b: Column, page_width: Column, page_height: Column, grid: int = 1000) -> Column:
    """Whole numbers on a grid x grid page, ties to even, clamped, right and bottom not before left and top."""
    sx, sy = F.lit(float(grid)) / page_width, F.lit(float(grid)) / page_height
    on = lambda v, s: F.least(F.lit(grid), F.greatest(F.lit(0), F.bround(v * s).cast("int")))
    left, top = on(b["x0"], sx), on(b["y0"], sy)
    return F.struct(left.alias("x0"), top.alias("y0"), F.greatest(left, on(b["x1"], sx)).alias("x1"), F.greatest(top, on(b["y1"], sy)).alias("y1"))


def crop(b: Column, image_width: Column, image_height: Column, padding: int) -> Column:
    return F.struct(
        F.greatest(F.lit(0), b["x0"].cast("int") - padding).alias("x0"), F.greatest(F.lit(0), b["y0"].cast("int") - padding).alias("y0"), F.least(image_width.cast("int"), b["x1"].cast("int") + padding).alias("x1"), F.least(image_height.cast("int"), b["y1"].cast("int") + padding).alias("y1")
    )


def position_label(b: Column, page_width: Column, page_height: Column) -> Column:
    """One of nine places by the centre, cut at 0.33 and 0.67."""
    third = lambda v, a, m, z: F.when(v < 0.33, a).when(v < 0.67, m).otherwise(z)
    return F.concat_ws("-", third(y_center(b) / page_height, "top", "middle", "bottom"), third(x_center(b) / page_width, "left", "center", "right"))
