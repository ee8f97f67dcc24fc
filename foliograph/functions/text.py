"""Previews, hints and data URLs of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_preview(name: Column, grid: Column, rows: int = 5, cols: int = 8) -> Column:
    """A table's name and its first rows and cells."""
    lines = F.transform(F.slice(grid, 1, rows), lambda r: F.array_join(F.slice(r, 1, cols), " | "))
    return F.concat_ws("\n", name, F.array_join(lines, "\n"))


def preview(kind: Column, name: Column, text: Column, grid: Column) -> Column:
    return F.when(kind == "Text", F.left(text, F.lit(200))).when(kind == "Table", grid_preview(name, grid)).otherwise(name)


def layout_hint(page: Column, bbox: Column, row: Column, col: Column) -> Column:
    """Where a node is: its page and box, its cell, or nothing."""
    at = lambda f: bbox.getField(f).cast("string")
    boxed = F.concat(F.lit("page "), page.cast("string"), F.lit(" bbox "), at("x_min"), F.lit(","), at("y_min"), F.lit(","), at("x_max"), F.lit(","), at("y_max"))
    cell = F.concat(F.lit("row "), row.cast("string"), F.lit(" col "), col.cast("string"))
    return F.coalesce(boxed, cell, F.lit(""))


def pixel_path(kind: Column, capture: Column, image: Column) -> Column:
    """The picture that shows a node; vector metafiles don't count."""
    return F.when(kind == "Table", capture).when((kind == "Image") & ~F.lower(image).rlike(r"\.(wmf|emf)$"), image)


def data_url(content: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))
