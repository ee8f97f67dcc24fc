"""Colours of themes, cells and charts, as column expressions over hexadecimal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import tinted

# The order of a theme's colours, and names that stand for others.
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
ALIASES = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}
SERIES = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7")


def channels(colour: Column) -> Column:
    """(r, g, b) of the last six digits; null if they aren't hexadecimal."""
    part = lambda i: F.conv(F.substr(F.right(colour, F.lit(6)), F.lit(i), F.lit(2)), 16, 10).cast("int")
    return F.when(F.right(colour, F.lit(6)).rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hexadecimal(rgb: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(rgb[c].cast("long")), 2, "0") for c in "rgb"])


def theme_index(name: Column) -> Column:
    """The place of a colour's name, or of what it stands for, in the theme; null if it has none."""
    known = F.coalesce(*[F.when(name == a, F.lit(b)) for a, b in ALIASES.items()], name)
    return F.nullif(F.array_position(F.array(*map(F.lit, THEME)), known), F.lit(0)).cast("int") - 1


def resolved(kind: Column, rgb: Column, index: Column, tint: Column, theme: Column) -> Column:
    """(r, g, b) of a cell's colour: its own, or the theme's by index, tinted; null for palettes and what isn't in the theme."""
    base = channels(F.get(theme, index))
    one = lambda c: tinted(base[c], F.coalesce(tint, F.lit(0.0)))
    themed = F.when(base.isNotNull(), F.struct(one("r").alias("r"), one("g").alias("g"), one("b").alias("b")))
    return F.when(kind == "rgb", channels(rgb)).when(kind == "theme", themed)


def fill(pattern: Column, colour: Column) -> Column:
    """A cell's colour counts only under a solid pattern."""
    return F.when(pattern == "solid", colour)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lightness_changed(colour: Column, mod: Column, off: Column) -> Column:
    """A colour (six digits) whose lightness is multiplied and moved, each in thousandths of a per cent."""
    m, o = F.coalesce(mod / 100000.0, F.lit(1.0)), F.coalesce(off / 100000.0, F.lit(0.0))

    def parts(c: Column) -> Column:
        r, g, b = (c[k] / 255.0 for k in "rgb")
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("hi"), F.least(r, g, b).alias("lo"), m.alias("m"), o.alias("o"))

    def turned(p: Column) -> Column:
        span, light = p["hi"] - p["lo"], (p["hi"] + p["lo"]) / 2.0
        strength = F.when(span == 0, 0.0).when(light <= 0.5, span / (p["hi"] + p["lo"])).otherwise(span / (2.0 - p["hi"] - p["lo"]))
        turn = F.when(span == 0, 0.0).when(p["r"] == p["hi"], (p["g"] - p["b"]) / span).when(p["g"] == p["hi"], 2.0 + (p["b"] - p["r"]) / span).otherwise(4.0 + (p["r"] - p["g"]) / span)
        return F.struct((turn / 6.0).alias("hue"), strength.alias("s"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), light * p["m"] + p["o"])).alias("new"))

    def edges(p: Column) -> Column:
        top = F.when(p["new"] <= 0.5, p["new"] * (1.0 + p["s"])).otherwise(p["new"] + p["s"] - p["new"] * p["s"])
        return F.struct(p["hue"].alias("hue"), p["s"].alias("s"), p["new"].alias("new"), top.alias("top"), (2.0 * p["new"] - top).alias("low"))

    def shown(p: Column) -> Column:
        def channel(shift: Column) -> Column:
            t = p["hue"] + shift - F.floor(p["hue"] + shift)
            value = F.when(t < 1 / 6, p["low"] + (p["top"] - p["low"]) * t * 6.0).when(t < 0.5, p["top"]).when(t < 2 / 3, p["low"] + (p["top"] - p["low"]) * (2 / 3 - t) * 6.0).otherwise(p["low"])
            return F.lpad(F.hex(F.rint(F.when(p["s"] == 0, p["new"]).otherwise(value) * 255).cast("long")), 2, "0")

        return F.array_join(F.transform(F.array(F.lit(1 / 3), F.lit(0.0), F.lit(-1 / 3)), channel), "")

    return let(let(let(let(channels(colour), parts), turned), edges), shown)


def series_colour(own: Column, place: Column) -> Column:
    """A series' own colour, or the next of the palette."""
    return F.coalesce(own, F.element_at(F.array(*map(F.lit, SERIES)), (place % len(SERIES) + 1).cast("int")))
