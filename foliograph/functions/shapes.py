"""Units, colours and paths of drawn shapes, as column expressions. Whole pixels round halves to the even one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DPI, EMU_PER_INCH = 96, 914400


def whole(c: Column) -> Column:
    return F.rint(c).cast("int")


def pt_to_px(pt: Column) -> Column:
    return whole(pt * DPI / 72)


def chars_to_px(chars: Column, digit_width: Column | float = 7.0) -> Column:
    """A column's width in characters, with 5 pixels of padding."""
    return whole(chars * digit_width + 5)


def emu_to_px(emu: Column) -> Column:
    return whole(emu / EMU_PER_INCH * DPI)


def tinted(channel: Column, tint: Column) -> Column:
    """A colour channel nearer to black (tint under 0) or to white."""
    dark, light = F.greatest(whole(channel * (1 + tint)), F.lit(0)), F.least(whole(channel * (1 - tint) + 255 * tint), F.lit(255))
    return F.when(tint < 0, dark).when(tint > 0, light).otherwise(channel.cast("int"))


def ends(x0: Column, y0: Column, x1: Column, y1: Column, flip_h: Column, flip_v: Column) -> Column:
    """Where a straight connector begins and ends: one flip alone turns the diagonal."""
    turned = flip_h != flip_v
    return F.array(F.struct(F.when(turned, x1).otherwise(x0).alias("x"), y0.alias("y")), F.struct(F.when(turned, x0).otherwise(x1).alias("x"), y1.alias("y")))


def bent(points: Column) -> Column:
    """An elbow with its bend halfway: four points from two ends."""
    a, b = points[0], points[1]
    mid = (a["x"] + b["x"]) / 2
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(a["x"], a["y"]), at(mid, a["y"]), at(mid, b["y"]), at(b["x"], b["y"]))


def curved(points: Column, steps: int = 16) -> Column:
    """A cubic curve along the elbow, as steps + 1 points."""
    p = bent(points)

    def at(i):
        t = i / steps
        weights = (F.pow(1 - t, F.lit(3)), 3 * F.pow(1 - t, F.lit(2)) * t, 3 * (1 - t) * F.pow(t, F.lit(2)), F.pow(t, F.lit(3)))
        along = lambda c: sum((w * p[k][c] for k, w in enumerate(weights)), F.lit(0.0))
        return F.struct(along("x").alias("x"), along("y").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def turned(box: Column, pivot: Column, degrees: Column) -> Column:
    """A box moved by turning its centre about another's, clockwise; its size stays."""
    c = lambda b, lo, hi: (b[lo] + b[hi]) / 2
    t = F.radians(degrees)
    px, py = c(pivot, "x_min", "x_max"), c(pivot, "y_min", "y_max")
    dx, dy = c(box, "x_min", "x_max") - px, c(box, "y_min", "y_max") - py
    x, y = px + dx * F.cos(t) - dy * F.sin(t), py + dx * F.sin(t) + dy * F.cos(t)
    w, h = (box["x_max"] - box["x_min"]) / 2, (box["y_max"] - box["y_min"]) / 2
    return F.struct(whole(x - w).alias("x_min"), whole(y - h).alias("y_min"), whole(x + w).alias("x_max"), whole(y + h).alias("y_max"))


# Outlines of preset shapes in a unit square.
ARROW = [(0.0, 0.3), (0.55, 0.3), (0.55, 0.1), (1.0, 0.5), (0.55, 0.9), (0.55, 0.7), (0.0, 0.7)]
PRESETS = {
    "triangle": [(0.5, 0.0), (1.0, 1.0), (0.0, 1.0)],
    "rtTriangle": [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)],
    "diamond": [(0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5)],
    "parallelogram": [(0.25, 0.0), (1.0, 0.0), (0.75, 1.0), (0.0, 1.0)],
    "trapezoid": [(0.2, 0.0), (0.8, 0.0), (1.0, 1.0), (0.0, 1.0)],
    "chevron": [(0.0, 0.0), (0.75, 0.0), (1.0, 0.5), (0.75, 1.0), (0.0, 1.0), (0.25, 0.5)],
    "homePlate": [(0.0, 0.0), (0.75, 0.0), (1.0, 0.5), (0.75, 1.0), (0.0, 1.0)],
    "rightArrow": ARROW,
}
POLYGONS = {"pentagon": 5, "hexagon": 6, "heptagon": 7, "octagon": 8}
STARS = {"star4": (4, 0.42), "star5": (5, 0.38), "star6": (6, 0.55)}
BORDERS = {"hair": 1, "thin": 1, "dashed": 1, "dotted": 1, "slantDashDot": 1, "mediumDashed": 2, "medium": 2, "double": 2, "thick": 3}
HEADS = ("triangle", "stealth", "arrow", "diamond", "oval")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def around(n: int, radius) -> Column:
    """n points about the middle of the unit square, the first straight up; radius: of the i-th, as a function of i."""
    angle = lambda i: i * (2 * math.pi / n) - math.pi / 2
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(0.5 + radius(i) * F.cos(angle(i)), 0.5 + radius(i) * F.sin(angle(i))))


def polygon(n: int) -> Column:
    """A regular polygon in the unit square, a corner straight up."""
    return around(n, lambda i: F.lit(0.5))


def star(n: int, inner: float) -> Column:
    """A star of n outer points, and inner ones at a part of their radius."""
    return around(2 * n, lambda i: F.when(i % 2 == 0, 0.5).otherwise(0.5 * inner))


def mirrored_x(points: Column) -> Column:
    return F.transform(points, lambda p: point(1.0 - p["x"], p["y"]))


def mirrored_y(points: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"], 1.0 - p["y"]))


def swapped(points: Column) -> Column:
    return F.transform(points, lambda p: point(p["y"], p["x"]))


def outline(preset: Column, box: Column) -> Column:
    """The corners of a preset shape in a box (x_min, y_min, x_max, y_max); the box's own for any other preset."""
    lit = lambda corners: F.array(*[point(F.lit(x), F.lit(y)) for x, y in corners])
    arrow = lit(ARROW)
    unit = F.when(preset == "leftArrow", mirrored_x(arrow)).when(preset == "downArrow", swapped(arrow)).when(preset == "upArrow", mirrored_y(swapped(arrow)))
    for name, corners in PRESETS.items():
        unit = unit.when(preset == name, lit(corners))
    for name, n in POLYGONS.items():
        unit = unit.when(preset == name, polygon(n))
    for name, (n, inner) in STARS.items():
        unit = unit.when(preset == name, star(n, inner))
    unit = unit.otherwise(lit([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]))
    w, h = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
    return F.transform(unit, lambda p: point(box["x_min"] + p["x"] * w, box["y_min"] + p["y"] * h))


def head_kind(kind: Column) -> Column:
    """The kind of a line's end; null without one. Kinds that aren't known are triangles."""
    return F.when(kind.isNull() | (kind == "none"), None).when(kind.isin(*HEADS), kind).otherwise("triangle")


def arrowhead(tip: Column, other: Column, size: Column, kind: Column) -> Column:
    """The corners of an arrowhead at tip that points away from other; an oval's are those of its box. None if the line has no length."""
    dx, dy = tip["x"] - other["x"], tip["y"] - other["y"]
    length = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / length, dy / length
    base = lambda k: (tip["x"] - ux * size * k, tip["y"] - uy * size * k)
    side = lambda s: point(base(1)[0] - uy * size * 0.5 * s, base(1)[1] + ux * size * 0.5 * s)
    tip_ = point(tip["x"], tip["y"])
    oval = F.array(point(tip["x"] - size * 0.5, tip["y"] - size * 0.5), point(tip["x"] + size * 0.5, tip["y"] + size * 0.5))
    shape = F.when(kind == "oval", oval).when(kind == "diamond", F.array(tip_, side(1), point(*base(2)), side(-1))).otherwise(F.array(tip_, side(1), side(-1)))
    return F.when(length >= 1e-6, shape)


def dashes(a: Column, b: Column, on: int = 6, off: int = 4) -> Column:
    """The strokes of a dashed line from a to b, each as (x0, y0, x1, y1)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.sqrt(dx * dx + dy * dy)

    def stroke(i):
        lo = i * (on + off)
        hi = F.least(lo + on, length)
        return F.struct((a["x"] + dx / length * lo).alias("x0"), (a["y"] + dy / length * lo).alias("y0"), (a["x"] + dx / length * hi).alias("x1"), (a["y"] + dy / length * hi).alias("y1"))

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), F.ceil(length / (on + off)).cast("int") - 1), stroke)).otherwise(F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>)"))


def marker(at: Column, symbol: Column, r: int = 4) -> Column:
    """The corners of a chart's marker about a point; a circle's, and any other's, are those of its box."""
    p = lambda x, y: point(at["x"] + x * r, at["y"] + y * r)
    out = F.when(symbol == "diamond", F.array(p(0, -1), p(1, 0), p(0, 1), p(-1, 0))).when(symbol == "triangle", F.array(p(0, -1), p(1, 1), p(-1, 1)))
    out = out.when(symbol == "square", F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1)))
    return out.when(symbol.isin("x", "plus", "star"), F.array(p(-1, 0), p(1, 0), p(0, -1), p(0, 1))).otherwise(F.array(p(-1, -1), p(1, 1)))


def calibrated(rect: Column, reference_off: Column, off: Column, ext: Column) -> Column:
    """Where a shape lies, by the distance of its own offset (x, y; EMU) from that of a picture whose box is known."""
    x, y = rect["x_min"] + emu_to_px(off["x"] - reference_off["x"]), rect["y_min"] + emu_to_px(off["y"] - reference_off["y"])
    w, h = (F.greatest(F.lit(1), emu_to_px(ext[c])) for c in "xy")
    return F.struct(x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + h).alias("y_max"))


def opacity(thousandths: Column) -> Column:
    """Of a colour's alpha in thousandths of a per cent, as text; 1 where there is none or it isn't a number."""
    return F.coalesce(thousandths.try_cast("int") / 100_000, F.lit(1.0))


def transform_of(flip_h: Column, flip_v: Column, rot: Column) -> Column:
    """A shape's flips and clockwise degrees, from the texts of its transform."""
    yes = lambda c: F.coalesce(c == "1", F.lit(False))
    return F.struct(yes(flip_h).alias("flip_h"), yes(flip_v).alias("flip_v"), F.coalesce(rot.try_cast("int") / 60_000, F.lit(0.0)).alias("degrees"))


def flipped(box: Column, inner: Column, flip_h: Column, flip_v: Column) -> Column:
    """A part of a picture's box after the picture is mirrored."""
    x = lambda c, o: F.when(flip_h, box["x_min"] + box["x_max"] - inner[o]).otherwise(inner[c])
    y = lambda c, o: F.when(flip_v, box["y_min"] + box["y_max"] - inner[o]).otherwise(inner[c])
    return F.struct(x("x_min", "x_max").alias("x_min"), y("y_min", "y_max").alias("y_min"), x("x_max", "x_min").alias("x_max"), y("y_max", "y_min").alias("y_max"))


def row_height(points: Column, hidden: Column, default: Column) -> Column:
    """A row's height in pixels: its own, or the sheet's, or 15 points; nothing if hidden."""
    own = F.coalesce(F.nullif(points, F.lit(0)), F.nullif(default, F.lit(0)), F.lit(15.0))
    return F.when(F.coalesce(hidden, F.lit(False)), 0).otherwise(pt_to_px(own))


def default_width(declared: Column, base: Column) -> Column:
    """A sheet's column width in characters."""
    return F.coalesce(F.nullif(declared, F.lit(0)), F.nullif(base, F.lit(0)), F.lit(8.43))


def column_width(chars: Column, hidden: Column, default: Column, digit_width: Column | float = 7.0) -> Column:
    return F.when(F.coalesce(hidden, F.lit(False)), 0).otherwise(chars_to_px(F.coalesce(F.nullif(chars, F.lit(0)), default), digit_width))


def border_width(style: Column) -> Column:
    """In pixels; null without a style, 1 for one that isn't known."""
    out = F.when(style.isNull(), None)
    for name, width in BORDERS.items():
        out = out.when(style == name, width)
    return out.otherwise(1)
