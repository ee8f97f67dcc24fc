"""Stored results by session, and the pictures that are attached to a deck's slides.

sessions: (session_id, filename, enriched, grouped, stored_at, result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
LONGEST = 200
IDENTITY = ("filename", "enriched", "grouped")


def safe_filename(name: Column, suffix: Column) -> Column:
    """A file's own name without folders and unsafe characters; 'original' and the suffix if nothing is left of it."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"/+$", ""), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(last, UNSAFE, "_"), r"(?U)^\s+|\s+$", "")
    return F.when(clean.rlike(r"^\.*$"), F.concat(F.lit("original"), suffix)).otherwise(F.left(clean, F.lit(LONGEST)))


def stored(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """sessions with new results: one of the same identity is overwritten and keeps its session_id."""
    old = sessions.groupBy(*IDENTITY).agg(F.min("session_id").alias("had_"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in IDENTITY]
    joined = new.alias("n").join(old.alias("o"), same[0] & same[1] & same[2], "left")
    fresh = joined.select(F.coalesce("o.had_", "n.session_id").alias("session_id"), *[F.col(f"n.{c}") for c in new.columns if c != "session_id"])
    return sessions.join(fresh.select("session_id"), "session_id", "left_anti").unionByName(fresh)


def listed(sessions: DataFrame) -> DataFrame:
    """Newest first, without the results themselves."""
    return sessions.select("session_id", F.coalesce("filename", "session_id").alias("filename"), "enriched", "grouped", "stored_at").orderBy(F.desc("stored_at"), "session_id")


def deleted(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") != session_id)


def with_urls(nodes: DataFrame, session_id: str, folder: str) -> DataFrame:
    """nodes with capture_url and image_url for pictures inside a session's folder."""
    root = folder.rstrip("/") + "/"
    url = lambda c: F.when(F.startswith(c, F.lit(root)) & ~F.contains(c, F.lit("/../")), F.concat(F.lit(f"/files/{session_id}/"), F.substr(c, F.lit(len(root) + 1))))
    return nodes.withColumn("capture_url", url(F.col("capture_path"))).withColumn("image_url", url(F.col("image_path")))


def slide_image_problems(slides: DataFrame, images: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Why pictures (slide_index, path, width, height) can't be attached to slides (slide_index, slide_width, slide_height): rows (slide_index, problem); none if all fit."""
    images = images.withColumn("seen_", F.count("*").over(W.partitionBy("slide_index")))
    both = slides.withColumn("s_", F.lit(True)).join(images.withColumn("i_", F.lit(True)), "slide_index", "full_outer")
    aspect = F.abs(F.col("width") / F.col("height") / (F.col("slide_width") / F.col("slide_height")) - 1)
    problem = (
        F.when(F.col("i_").isNull(), "slide without picture").when(F.col("s_").isNull(), "picture without slide").when(F.col("seen_") > 1, "several pictures")
        .when(~F.lower("path").rlike(r"\.(png|jpe?g)$"), "neither PNG nor JPEG").when(aspect > tolerance, "other aspect ratio")
    )
    return both.select("slide_index", problem.alias("problem")).where("problem is not null").distinct()


def with_slide_images(slides: DataFrame, images: DataFrame) -> DataFrame:
    """slides with slide_image_path: all of them or, if anything is wrong, none."""
    wrong = slide_image_problems(slides, images).agg((F.count("*") > 0).alias("wrong_"))
    out = slides.join(images.groupBy("slide_index").agg(F.min("path").alias("path_")), "slide_index", "left").join(F.broadcast(wrong), F.lit(True))  # wrong is one row
    return out.withColumn("slide_image_path", F.when(~F.col("wrong_"), F.col("path_"))).drop("path_", "wrong_")
