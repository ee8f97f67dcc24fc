from pyspark.sql import functions as F

from foliograph.operators import sessions


def test_safe_filenames(spark):
    names = ["a/b/../보고서 1.pdf", "..", "", None, "x:y?.pdf", "n" * 300, " s .docx "]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(sessions.safe_filename(F.col("n"), F.lit(".pdf")))
    assert [r[0] for r in df.collect()] == ["보고서 1.pdf", "original.pdf", "original.pdf", "original.pdf", "x_y_.pdf", "n" * 200, "s .docx"]


def test_sessions(spark):
    schema = "session_id string, filename string, enriched boolean, grouped boolean, stored_at int, result string"
    had = spark.createDataFrame([("s1", "a", False, False, 1, "x"), ("s2", "a", True, False, 2, "y")], schema)
    new = spark.createDataFrame([("s3", "a", False, False, 5, "z"), ("s4", "b", False, False, 4, "w")], schema)
    out = sessions.stored(had, new)
    assert [r["session_id"] for r in sessions.listed(out).collect()] == ["s1", "s4", "s2"]
    assert {r["session_id"]: r["result"] for r in sessions.deleted(out, "s2").collect()} == {"s1": "z", "s4": "w"}


def test_slide_images(spark):
    slides = spark.createDataFrame([(0, 100, 50), (1, 100, 50)], "slide_index int, slide_width int, slide_height int")
    images = lambda *rows: spark.createDataFrame(rows, "slide_index int, path string, width int, height int")
    good = images((0, "a.png", 1000, 500), (1, "b.JPG", 1004, 500))
    assert sessions.slide_image_problems(slides, good).count() == 0
    assert [r["slide_image_path"] for r in sessions.with_slide_images(slides, good).orderBy("slide_index").collect()] == ["a.png", "b.JPG"]
    bad = images((0, "a.gif", 1000, 500), (2, "b.png", 10, 5))
    assert sorted(map(tuple, sessions.slide_image_problems(slides, bad).collect())) == [(0, "neither PNG nor JPEG"), (1, "slide without picture"), (2, "picture without slide")]
    assert all(r["slide_image_path"] is None for r in sessions.with_slide_images(slides, bad).collect())


def test_urls(spark):
    df = spark.createDataFrame([("/s/x/a.png", "/t/b.png"), ("/s/x/../c.png", None)], "capture_path string, image_path string")
    assert [(r["capture_url"], r["image_url"]) for r in sessions.with_urls(df, "id", "/s/x").collect()] == [("/files/id/a.png", None), (None, None)]
