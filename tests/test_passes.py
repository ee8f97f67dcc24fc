"""Judged passes with judges whose answers are known, and the sink and the trace."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.operators import passes, trace


@pytest.fixture(scope="module")
def graph_of(spark):
    rows = [("art", None, "Artifact", -1), ("h", "1 Head", "Text", 0), ("p", "words of it", "Text", 1), ("a", "E =", "Text", 2), ("b", "mc2", "Text", 3), ("s", "1.1 Sub", "Text", 4), ("c", "Figure 1. both", "Text", 5), ("i", None, "Image", 6), ("j", None, "Image", 7)]
    nodes = spark.createDataFrame([("d", "art", o, n, t, x, 0) for n, x, t, o in rows], "doc string, artifact string, ord int, id string, type string, text string, page int")
    nodes = nodes.withColumn("bbox", F.struct((F.col("ord") * 10).alias("x_min"), F.lit(0).alias("y_min"), (F.col("ord") * 10 + 5).alias("x_max"), F.lit(9).alias("y_max")))
    under = [("d", "PARENT_OF", "art", r[0]) for r in rows[1:]] + [("d", "CAPTION_OF", "c", "i"), ("d", "CAPTION_OF", "c", "j")]
    return nodes, spark.createDataFrame(under, "doc string, type string, source string, target string")


def merges(questions):
    return [{"should_merge": [m["id"] for m in q["members"]] == ["a", "b"], "merged_text": "E = mc2"} for q in questions]


def heads(questions):
    out = []
    for q in questions:
        ids = [m["id"] for m in q["members"]]
        out.append({"parent_index": ids.index("h"), "rationale": "x"} if q["anchor"].startswith(("words", "E =", "Fig")) and "h" in ids else {"parent_index": 99})
    return out


def pairs(df, kind="PARENT_OF"):
    return {(r["source"], r["target"]) for r in df.where(F.col("type") == kind).collect()}


def test_fragments(spark, graph_of):
    nodes, edges = graph_of
    lines = spark.createDataFrame([("d", "k", "a", 0), ("d", "k", "b", 1), ("d", "l", "h", 0), ("d", "l", "p", 1)], "doc string, cluster string, id string, place int")
    out, left, calls = passes.merge_fragments(nodes, edges, lines, merges)
    assert {r["id"]: r["text"] for r in out.collect()}["a"] == "E = mc2" and out.where("id = 'b'").isEmpty()
    assert ("art", "b") not in pairs(left) and calls.count() == 2
    out, left, calls = passes.merge_fragments(nodes, edges, lines, lambda qs: 1 / 0)
    assert out.count() == nodes.count() and {r["error"] for r in calls.collect()} == {"ZeroDivisionError"}


def test_regions(spark, graph_of):
    nodes, edges = graph_of
    regions = spark.createDataFrame([("d", "k", 0, n, i) for i, n in enumerate("hpab")], "doc string, cluster string, chunk int, id string, place int")
    said = {"groups": [{"indices": [0, 1]}, {"indices": [1, 2]}, {"indices": [3]}, {"indices": [2, 9]}]}
    out, _, _ = passes.merge_regions(nodes, edges, regions, lambda qs: [said] * len(qs))
    assert {r["id"]: r["text"] for r in out.collect() if r["merged_from"]} == {"h": "1 Head\nwords of it"}


def test_headings_in_two_rounds(spark, graph_of):
    nodes, edges = graph_of
    out, outcomes, calls = passes.text_headings(nodes, edges, heads)
    got = pairs(out)
    assert {("h", "p"), ("h", "a"), ("art", "h")} <= got and ("art", "p") not in got
    assert {r["reparented_from"] for r in out.where("target = 'p'").collect()} == {"art"}
    assert calls.count() > 0 and outcomes.where("outcome = 'applied'").count() >= 2


def test_captions_and_groups(spark, graph_of):
    nodes, edges = graph_of
    out, calls = passes.confirm_captions(nodes, edges, lambda qs: [{"confirmed": [1, 7]}] * len(qs))
    assert pairs(out, "CAPTION_OF") == {("c", "j")} and calls.count() == 1
    assert pairs(passes.confirm_captions(nodes, edges, lambda qs: [None] * len(qs))[0], "CAPTION_OF") == {("c", "i"), ("c", "j")}
    new, out, _ = passes.group_siblings(nodes, edges, lambda qs: [{"groups": [{"members": [0, 1, 50], "group_type": "intro"}, {"members": [2]}]}] * len(qs))
    (g,) = new.collect()
    assert g["group_type"] == "intro" and {("art", g["id"]), (g["id"], "h"), (g["id"], "p")} <= pairs(out) and ("art", "h") not in pairs(out)


def test_all_passes_and_their_trace(spark, graph_of, tmp_path):
    nodes, edges = graph_of
    with trace.trace(str(tmp_path), nodes, edges) as t:
        out, links, calls = passes.enriched(nodes, edges, {"headings": heads, "captions": lambda qs: [{"confirmed": [0]}] * len(qs), "anchors": lambda qs: [{"edges": []}] * len(qs)})
        t.calls(calls)
    assert pairs(links, "CAPTION_OF") == {("c", "i")} and ("h", "s") in pairs(links)
    said = [json.loads(x) for p in Path(t.path, "calls").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["pass"] for x in said} == {"headings", "captions"} and all(x["candidate_ids"] for x in said) and not t.failed
    t.save("before/nodes", nodes)  # it is there already
    assert len(t.failed) == 1


class Log:
    """A session that writes down what it is told."""

    def __init__(self, path):
        self.path = path

    def run(self, statement, rows=()):
        with open(self.path, "a") as f:
            f.write(json.dumps([statement, list(rows)]) + "\n")

    def close(self):
        pass


def test_push(spark, graph_of, tmp_path):
    nodes, edges = graph_of
    at = str(tmp_path / "log")
    trace.push(nodes.coalesce(1), edges.coalesce(1), lambda: Log(at), ("text", "bbox"), batch=3)
    said = [json.loads(x) for x in Path(at).read_text().splitlines()]
    assert sum("CONSTRAINT" in s for s, _ in said) == 6
    sent = [r for s, rows in said if "MERGE (n:" in s for r in rows]
    assert {r["id"] for r in sent} == {r["id"] for r in nodes.collect()} and max(len(rows) for _, rows in said) == 3
    links = [(r["source"], r["target"]) for s, rows in said if "MATCH" in s for r in rows]
    assert len(links) == edges.count() and [i for i, (s, _) in enumerate(said) if "MATCH" in s][0] > max(i for i, (s, _) in enumerate(said) if "MERGE (n:" in s)
