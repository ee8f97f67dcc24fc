"""Lines, fragments and outlines of pages."""

from pyspark.sql import functions as F

from foliograph.functions import shapes
from foliograph.operators import geometry, pages


def test_table_candidates(spark):
    h = lambda p, o, y, lo=10.0, hi=90.0: (p, o, "h", lo, hi, y)
    v = lambda p, o, x, lo=10.0, hi=50.0: (p, o, "v", lo, hi, x)
    rows = [h(1, 0, 10.0), h(1, 1, 30.0), h(1, 2, 50.0), v(1, 3, 10.0), v(1, 4, 90.0)]  # a grid
    rows += [h(2, 0, 10.0), h(2, 1, 100.0), h(2, 2, 200.0, 12.0, 88.5)]  # rules
    rows += [h(3, 0, 10.0), v(3, 1, 200.0), h(3, 2, 60.0, 30.0, 60.0)]  # neither
    rows += [h(4, 0, 10.0), h(4, 1, 50.0), v(4, 2, 10.0), v(4, 3, 90.0)]  # a border: two level lines of one length
    df = spark.createDataFrame(rows, "page long, ord int, kind string, lo double, hi double, at double")
    got = sorted((r["page"], r["mode"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in pages.table_candidates(df).collect())
    assert got == [(1, "grid", 8.0, 8.0, 92.0, 52.0), (2, "ruled_rows", 8.0, 8.0, 92.0, 202.0), (4, "ruled_rows", 8.0, 8.0, 92.0, 52.0)]


def test_fragments(spark):
    b = lambda p, o, t, x0, x1, size=10.0, base=20.0, font="f": (p, o, t, x0, 10.0, x1, 20.0, font, size, base, True)
    rows = [b(1, 0, "Hel", 0.0, 10.0), b(1, 1, "lo", 10.5, 20.0), b(1, 2, "world", 22.0, 40.0), b(1, 3, "far", 60.0, 70.0), b(2, 0, "a", 0.0, 5.0), b(2, 1, "b", 6.0, 9.0), b(3, 0, "a", 0.0, 5.0), b(3, 1, "12", 6.0, 9.0), b(3, 2, "x", 9.0, 12.0, 11.0)]
    blocks = spark.createDataFrame(rows, "page long, ord int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, baseline double, level boolean")
    walls = spark.createDataFrame([(2, 5.0, 0.0, 6.0, 30.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["page"], r["ord"], r["text"], r["x1"], r["n"]) for r in pages.joined_fragments(blocks, walls).collect())
    assert got == [(1, 0, "Hello world", 40.0, 3), (1, 3, "far", 70.0, 1), (2, 0, "a", 5.0, 1), (2, 1, "b", 9.0, 1), (3, 0, "a", 5.0, 1), (3, 1, "12", 9.0, 1), (3, 2, "x", 12.0, 1)]


def test_line_order(spark):
    rows = [(1, "head", 0, 0, 0, 100, 20), (1, "K", 1, 60, 100, 70, 110), (1, "Q", 2, 20, 101, 30, 111), (1, "tall", 3, 0, 0, 10, 400), (1, "V", 4, 90, 99, 95, 109)]
    df = spark.createDataFrame(rows, "page long, id string, ord int, a int, b int, c int, d int").select("page", "id", "ord", geometry.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("bbox"))
    assert [r["id"] for r in pages.line_order(df).orderBy("place").collect()] == ["head", "Q", "K", "tall", "V"]


def test_outline(spark):
    texts = spark.createDataFrame([("d", "t1", 0, 0, "1 Intro", 0.0, 0.0, 10.0, 10.0), ("d", "t2", 1, 0, "INTRO ", 0.0, 500.0, 10.0, 510.0), ("d", "t3", 2, 1, "in Intro we", 0.0, 0.0, 1.0, 1.0)], "doc string, id string, ord int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    entries = spark.createDataFrame([("d", 0, 1, "Intro", 0, 0.0, 480.0), ("d", 1, 1, "intro", 0, None, None), ("d", 2, 2, "Intro", 1, None, None)], "doc string, ord int, level int, title string, page int, x double, y double")
    assert [r["id"] for r in pages.outline_matches(entries, texts).orderBy("ord").collect()] == ["t2", "t1", None]


def test_turned(spark):
    one = geometry.box(F.lit(10), F.lit(0), F.lit(20), F.lit(10))
    row = spark.range(1).select(shapes.turned(one, geometry.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), F.lit(90.0)).alias("b")).first()
    assert tuple(row["b"]) == (0, 10, 10, 20)
