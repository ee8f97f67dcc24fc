"""Graph operators on rows written by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions import numbers
from foliograph.operators import cells, enrich, geometry, graph, headings, windows


def nodes_of(spark, rows):
    return spark.createDataFrame([("d", a, i, n, t, x) for i, (a, n, t, x) in enumerate(rows)], "doc string, artifact string, ord int, id string, type string, text string")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_captions_and_references(spark):
    n = nodes_of(spark, [("a", "c1", "Text", "표 1. 결과"), ("a", "t", "Table", None), ("a", "c2", "Text", "Figure 2: x"), ("a", "i", "Image", None), ("a", "r", "Text", "see TABLE 1, table1 and figure. 2"), ("a", "no", "Text", "Table9"), ("b", "x", "Text", "see Table 1")])
    c = graph.caption_edges(n)
    assert pairs(c, "source", "target") == [("c1", "t"), ("c2", "i"), ("c2", "t")]
    assert pairs(graph.reference_edges(n, c), "source", "target") == [("r", "i"), ("r", "t")]
    once = graph.finalize(n, graph.parent_edges(n))
    assert graph.finalize(n, once).count() == once.count()
    assert pairs(graph.ambiguous_captions(c), "source") == [("c2",)]


def test_hierarchy_against_a_stack(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for a in range(12):
        stack = []
        for o in range(30):
            level, out, ident = rng.choice([None, None, 0, 1, 2, 3]), rng.random() < 0.1, None if rng.random() < 0.1 else f"n{a}-{o}"
            if level is None and ident is None:
                level = 1
            rows.append(("d", f"a{a}", o, ident, level, out))
            if out:
                parent = f"a{a}"
            else:
                if level is not None:
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                parent = (stack[-1][1] or f"a{a}") if stack else f"a{a}"
                if level is not None:
                    stack.append((level, ident))
            if ident:
                want[ident] = parent
    df = spark.createDataFrame(rows, "doc string, artifact string, ord int, id string, level int, excluded boolean")
    assert {r["id"]: r["parent"] for r in headings.hierarchy(df).collect()} == want


def test_numbered_and_enumerated(spark):
    n = nodes_of(spark, [("a", "1", "Text", "1\nIntroduction"), ("a", "3", "Text", "3\nModel"), ("a", "31", "Text", "3.1 A"), ("a", "32", "Text", "3.2 B"), ("a", "321", "Text", "3.2.1 C"), ("a", "row", "Text", "1 512 512"), ("b", "51", "Text", "5.1 Alone")]).withColumn("is_toc", F.lit(False))
    assert pairs(headings.numbered_nesting(n), "id", "parent") == [("31", "3"), ("32", "3"), ("321", "32")]
    e = nodes_of(spark, [("a", "i1", "Text", "1) x"), ("a", "i2", "Text", "2) x"), ("a", "d", "Text", "- y"), ("a", "i3", "Text", "3) x"), ("a", "j", "Text", "1) z")]).withColumn("is_toc", F.lit(False)).withColumn("parent", F.lit("p"))
    assert [r["ids"] for r in headings.enumerated_runs(e).collect()] == [["i1", "i2", "i3"]]


def test_window_stops_at_anchors(spark):
    n = nodes_of(spark, [("a", "A", "Table", None), ("a", "cA", "Text", "x"), ("a", "B", "Table", None), ("a", "cB", "Text", "x"), ("a", "C", "Image", None), ("a", "cC", "Text", "x")])
    got = pairs(windows.context_windows(n), "anchor", "candidate")
    assert got == [("A", "cA"), ("B", "cA"), ("B", "cB"), ("C", "cB"), ("C", "cC")]
    assert pairs(windows.context_windows(n, anchors=("Text",), boundaries=()), "anchor", "candidate") == sorted((x, y) for x in ("cA", "cB", "cC") for y in ("cA", "cB", "cC") if x != y)


def test_touching_ranges_merge_until_none_touch(spark):
    rows = [("s", "a", 4, 4, 17, 12), ("s", "b", 18, 2, 18, 10), ("s", "c", 5, 3, 11, 3), ("t", "a", 1, 1, 5, 5), ("t", "b", 7, 1, 10, 5)]
    df = spark.createDataFrame(rows, "sheet string, name string, r0 int, c0 int, r1 int, c1 int")
    assert pairs(cells.merged_ranges(df), "sheet", "r0", "c0", "r1", "c1") == [("s", 4, 2, 18, 12), ("t", 1, 1, 5, 5), ("t", 7, 1, 10, 5)]
    r = spark.createDataFrame([("R2C3:R4C5",), ("R7C1",), ("x",)], "t string").select(cells.parsed_range(F.col("t")).alias("r")).select("r.*")
    assert [tuple(x) for x in r.collect()] == [(2, 3, 4, 5), (7, 1, 7, 1), (None, None, None, None)]


def test_components_and_suppression(spark):
    df = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 2, "b"), ("s", 4, 4, "c"), ("s", 1, 2, "d")], "sheet string, row int, col int, value string")
    assert pairs(cells.component_texts(df), "n", "text") == [(1, "c"), (3, "a / d / b")]
    b = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (1, 2, 5, 5, 95, 95), (1, 3, 200, 200, 210, 210)], "page int, id int, x0 int, y0 int, x1 int, y1 int")
    b = b.select("page", "id", geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))
    assert pairs(geometry.suppressed(b), "id") == [(1,), (3,)]


@pytest.mark.parametrize("value,fmt,want", [(1.7846, "0.00", "1.78"), (0.99655, "0%", "100%"), (-9.714, "[Blue]\\▽0%;[Red]\\△0%", "△971%"), (17256, "#,##0", "17,256"), (None, "0", ""), (3.0, None, "3"), (True, "0", "True"), (dt.date(2026, 9, 4), "yyyy-mm-dd", "2026-09-04"), (dt.date(2026, 9, 4), "yyyy-mm", "2026-09"), (-2, "0.0", "-2.0"), (0, '0;-0;"none"', "none")])
def test_number_formats(value, fmt, want):
    assert numbers.display(value, fmt) == want


def test_integrity(spark):
    e = spark.createDataFrame([("d", "PARENT_OF", "a", "b"), ("d", "PARENT_OF", "b", "c"), ("d", "PARENT_OF", "c", "b"), ("d", "NEXT", "a", "b"), ("d", "NEXT", "a", "c")], "doc string, type string, source string, target string")
    n = spark.createDataFrame([("d", "a"), ("d", "b")], "doc string, id string")
    assert pairs(graph.dangling(n, e), "end") == [("c",)]
    assert pairs(graph.fan_in(e), "target", "n") == [("b", 2)]
    assert pairs(graph.next_degree(e), "id", "side", "n") == [("a", "out", 2)]


def test_reparenting_in_order(spark):
    n = spark.createDataFrame([("d", x, a, "Text", i) for i, (x, a) in enumerate([("h", "s"), ("g", "s"), ("x", "s"), ("o", "t"), ("nat", "s")])], "doc string, id string, artifact string, type string, ord int")
    e = spark.createDataFrame([("d", "PARENT_OF", "s", x, None) for x in ("h", "g", "x")] + [("d", "PARENT_OF", "t", "o", None), ("d", "PARENT_OF", "s", "nat", "outline")], "doc string, type string, source string, target string, structural_source string")
    asks = [("d", "x", "h", 1), ("d", "h", "x", 2), ("d", "o", "h", 3), ("d", "nat", "h", 4), ("d", "x", "h", 5), ("d", "q", "h", 6), ("d", "g", "g", 7)]
    out = enrich.reparented(n, e, spark.createDataFrame(asks, "doc string, id string, parent string, ord int"))
    assert [r["outcome"] for r in out.orderBy("ord").collect()] == ["applied", "cycle", "artifact_boundary", "native_hierarchy", "already_parent", "missing_parent", "cycle"]
    assert ("x", "h", "s") in [(r["target"], r["source"], r["reparented_from"]) for r in enrich.with_reparents(e, out).collect()]


def test_judgments(spark):
    n = nodes_of(spark, [("a", "c", "Text", "cap"), ("a", "T", "Table", None), ("a", "h", "Text", "head"), ("a", "I", "Image", None)])

    def judge(questions):
        if any(q["anchor"] == "I" for q in questions):
            raise OSError("remote")
        return [{"edges": [{"context_index": 0, "edge_type": "CAPTION_OF", "rationale": "r"}, {"context_index": 9, "edge_type": "REFERENCES"}, {"context_index": 1, "edge_type": "HEADING_PARENT", "rationale": "h"}]} for _ in questions]

    edges, heads = enrich.proposals(windows.context_windows(n, anchors=("Table",)), n, judge)
    assert pairs(edges, "type", "source", "target") == [("CAPTION_OF", "c", "T")]
    assert pairs(heads, "id", "parent") == [("T", "h")]
    asked = enrich.judged(enrich.anchor_questions(windows.context_windows(n), n), judge, enrich.PROPOSAL, batch=1)
    assert pairs(asked, "key", "status", "error") == [("I", "error", "OSError"), ("T", "parsed", None)]


def test_groups_and_merges(spark):
    e = spark.createDataFrame([("d", "PARENT_OF", "s", x) for x in "abc"], "doc string, type string, source string, target string")
    g = spark.createDataFrame([("d", "s", 0, ["a", "b"]), ("d", "s", 1, ["b", "c"])], "doc string, parent string, n int, members array<string>")
    nodes, edges = enrich.grouped(e, g)
    assert pairs(nodes, "id") == [("content:d:grp0",)]
    assert pairs(edges, "source", "target") == [("content:d:grp0", "a"), ("content:d:grp0", "b"), ("s", "c"), ("s", "content:d:grp0")]
    n = nodes_of(spark, [("a", x, "Text", x) for x in "abc"]).withColumn("bbox", geometry.box(F.lit(1), F.lit(2), F.col("ord") + 5, F.lit(6)))
    m = spark.createDataFrame([("d", 1, "a", 1), ("d", 1, "b", 0)], "doc string, group int, id string, place int")
    out, left = enrich.merged_texts(n, e, m)
    assert pairs(out, "id", "text") == [("a", "b\na"), ("c", "c")] and pairs(left, "target") == [("a",), ("c",)]
