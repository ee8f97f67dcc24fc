"""The judged passes over a document graph, in order: merges of texts, relations of anchors, headings of texts, groups, captions.

Each pass is a few joins that make questions, one call of a judge for each batch of them (``enrich.judged``), and joins that apply the answers.
A judge is any function from a list of questions to a list of answers; a question that fails leaves its part of the graph as it is. Every
pass also returns its calls, which ``trace`` keeps.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from . import enrich, graph, headings, windows
from .enrich import Judge

CALL = ("doc", "key", "question", "status", "error")
MERGE = "should_merge boolean, merged_text string"
REGION = "groups array<struct<indices:array<int>,rationale:string>>"
HEADING = "parent_index int, rationale string"
CAPTION = "confirmed array<int>"
SIBLINGS = "groups array<struct<members:array<int>,group_type:string>>"


def _asked(questions: DataFrame, judge: Judge, answer: str, batch: int = enrich.BATCH) -> DataFrame:
    return cut(enrich.judged(questions, judge, answer, batch))  # a judge is asked once, whatever reads its answers


def _members(clusters: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """clusters (doc, *key, id, place) as questions: the texts of each, in their places."""
    own = clusters.join(nodes.select("doc", "id", F.left("text", F.lit(200)).alias("text")), ["doc", "id"])
    by = own.groupBy("doc", *key).agg(F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("members"))
    return by.select("doc", F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), F.to_json(F.struct("members")).alias("question"))


def _ids(asked: DataFrame) -> DataFrame:
    return asked.where("status = 'parsed'").withColumn("ids", F.transform(F.from_json(F.get_json_object("question", "$.members"), "array<struct<place:int,id:string>>"), lambda m: m["id"]))


def merge_fragments(nodes: DataFrame, edges: DataFrame, lines: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls) after texts of one line (doc, cluster, id, place) that a judge calls one expression are merged."""
    calls = _asked(_members(lines, nodes, ["cluster"]), judge, MERGE)
    yes = _ids(calls).where("answer.should_merge").select("doc", F.concat("doc", F.lit("/"), "key").alias("group"), "answer.merged_text", F.posexplode("ids").alias("place", "id"))
    out, left = enrich.merged_texts(nodes, edges, yes.select("doc", "group", "id", "place"), " ")
    said = yes.where("place = 0 and merged_text <> ''").select("doc", F.col("merged_text").alias("said_"), "group")
    first = yes.join(nodes.select("doc", "id", "ord"), ["doc", "id"]).groupBy("doc", "group").agg(F.min_by("id", "ord").alias("id")).join(said, ["doc", "group"]).select("doc", "id", "said_")
    out = out.join(first, ["doc", "id"], "left").withColumn("text", F.coalesce("said_", "text")).drop("said_")
    return out, left, calls.select(*CALL)


def merge_regions(nodes: DataFrame, edges: DataFrame, regions: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls) after the groups that a judge finds in regions (doc, cluster, chunk, id, place) are merged, by lines.

    Groups of fewer than two, with indices that aren't there, or that share a text with a group before them don't count.
    """
    calls = _asked(_members(regions, nodes, ["cluster", "chunk"]), judge, REGION, enrich.REGION_BATCH)
    got = _ids(calls).select("doc", "key", "ids", F.posexplode("answer.groups").alias("n", "g"))
    got = got.select("doc", "key", "n", "ids", F.array_distinct("g.indices").alias("at")).where("size(at) >= 2 and forall(at, i -> i >= 0 and i < size(ids))")
    flat = got.select("doc", "key", "n", F.explode(F.expr("transform(at, i -> ids[i])")).alias("id"), F.size("at").alias("size"))
    fresh = F.min("n").over(W.partitionBy("doc", "id")) == F.col("n")
    whole = flat.withColumn("fresh", fresh).groupBy("doc", "key", "n").agg(F.bool_and("fresh").alias("ok")).where("ok")
    groups = flat.join(whole, ["doc", "key", "n"]).join(nodes.select("doc", "id", F.col("ord").alias("place")), ["doc", "id"])
    out, left = enrich.merged_texts(nodes, edges, groups.select("doc", F.concat_ws("/", "doc", "key", F.col("n").cast("string")).alias("group"), "id", "place"))
    return out, left, calls.select(*CALL)


def heading_questions(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """One question for each text: the candidates (doc, id, candidate) for its heading, in document order."""
    texts = nodes.select("doc", F.col("id").alias("candidate"), "ord", F.left("text", F.lit(200)).alias("text"))
    own = candidates.join(texts, ["doc", "candidate"]).groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("place"), F.col("candidate").alias("id"), "text"))).alias("members"))
    about = own.join(nodes.select("doc", "id", F.left("text", F.lit(200)).alias("anchor")), ["doc", "id"])
    return about.select("doc", F.col("id").alias("key"), F.to_json(F.struct("anchor", "members")).alias("question"))


def heading_choices(candidates: DataFrame, nodes: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """(choices (doc, id, parent), calls) of a judge for texts; an index that isn't there is no choice."""
    calls = _asked(heading_questions(candidates, nodes), judge, HEADING)
    got = _ids(calls).where("answer.parent_index >= 0 and answer.parent_index < size(ids)")
    return got.select("doc", F.col("key").alias("id"), F.expr("ids[answer.parent_index]").alias("parent")).where("id <> parent"), calls.select(*CALL)


def text_headings(nodes: DataFrame, edges: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, outcomes, calls): texts under the headings that a judge chooses, in two rounds.

    The first offers each text its neighbours and the open headings before it; of a run of list items only the first is asked, and its
    answer holds for all. The second asks again for texts still under their artifact, with the nearest heading that the first round
    confirmed in their scope.
    """
    texts = nodes.where("type = 'Text'")
    runs = headings.enumerated_runs(with_parents(nodes, edges)).select("doc", "first_id", F.explode("ids").alias("id")).where("id <> first_id")
    near = windows.context_windows(nodes, anchors=("Text",), boundaries=()).select("doc", F.col("anchor").alias("id"), "candidate")
    marked = headings.open_headings(nodes).select("doc", "id", F.col("heading").alias("candidate"))
    asked = near.unionByName(marked).where("id <> candidate").distinct().join(runs.select("doc", "id"), ["doc", "id"], "left_anti")
    first, calls = heading_choices(asked, nodes, judge)
    first = first.unionByName(runs.join(first.withColumnRenamed("id", "first_id"), ["doc", "first_id"]).select("doc", "id", "parent")).where("id <> parent")
    outcomes = cut(enrich.reparented(nodes, _native(edges), ordered(first, texts)))
    moved = cut(enrich.with_reparents(_native(edges), outcomes))
    done = outcomes.where("outcome = 'applied'").select("doc", "id")
    flat = moved.where("type = 'PARENT_OF'").join(nodes.where("type = 'Artifact'").select("doc", F.col("id").alias("source")), ["doc", "source"], "left_semi").select("doc", F.col("target").alias("id"))
    confirmed = outcomes.where("outcome = 'applied'").select("doc", F.col("parent").alias("id")).distinct()
    again = headings.confirmed_heading(nodes, confirmed).join(flat, ["doc", "id"], "left_semi").join(done, ["doc", "id"], "left_anti").select("doc", "id", F.col("heading").alias("candidate"))
    second, more = heading_choices(again, nodes, judge)
    later = cut(enrich.reparented(nodes, moved, ordered(second, texts)))
    out = enrich.with_reparents(moved.drop("reparented_from"), later).withColumnRenamed("reparented_from", "later_")
    out = out.join(moved.where("reparented_from is not null").select("doc", "target", F.col("reparented_from").alias("before_")), ["doc", "target"], "left")
    out = out.select("doc", "type", "source", "target", "structural_source", F.when(F.col("type") == "PARENT_OF", F.coalesce("before_", "later_")).alias("reparented_from"))
    return out, outcomes.unionByName(later), calls.unionByName(more)


def _native(edges: DataFrame) -> DataFrame:
    have = "structural_source" in edges.columns
    return edges.select("doc", "type", "source", "target", (F.col("structural_source") if have else F.lit(None).cast("string")).alias("structural_source"))


def ordered(choices: DataFrame, nodes: DataFrame) -> DataFrame:
    return choices.join(nodes.select("doc", "id", "ord"), ["doc", "id"]).select("doc", "id", "parent", "ord")


def with_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with parent and is_toc, where they aren't there."""
    up = edges.where("type = 'PARENT_OF'").groupBy("doc", F.col("target").alias("id")).agg(F.max("source").alias("parent"))
    out = nodes.drop("parent").join(up, ["doc", "id"], "left")
    return out if "is_toc" in nodes.columns else out.withColumn("is_toc", F.lit(False))


def confirm_captions(nodes: DataFrame, edges: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """(edges, calls): of captions with several targets only those stay that a judge confirms; without an answer all do."""
    many = graph.ambiguous_captions(edges).select("doc", "source")
    own = edges.where("type = 'CAPTION_OF'").join(many, ["doc", "source"], "left_semi").join(nodes.select("doc", F.col("id").alias("target"), "ord"), ["doc", "target"])
    own = own.groupBy("doc", "source").agg(F.array_sort(F.collect_set(F.struct(F.col("ord").alias("place"), F.col("target").alias("id")))).alias("members"))
    about = own.join(nodes.select("doc", F.col("id").alias("source"), F.col("text").alias("caption")), ["doc", "source"])
    calls = _asked(about.select("doc", F.col("source").alias("key"), F.to_json(F.struct("caption", "members")).alias("question")), judge, CAPTION)
    got = _ids(calls).select("doc", F.col("key").alias("source"), "ids", F.explode_outer("answer.confirmed").alias("i"))
    confirmed = got.select("doc", "source", F.expr("case when i >= 0 and i < size(ids) then ids[i] end").alias("target"))
    return enrich.resolved_captions(edges, confirmed), calls.select(*CALL)


def group_siblings(nodes: DataFrame, edges: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group nodes, edges, calls): siblings that a judge finds to be of one kind get a group of their own under their parent."""
    regions = enrich.sibling_regions(edges, nodes).select("doc", F.concat_ws("/", "parent", F.col("page").cast("string")).alias("region"), "parent", F.posexplode("ids").alias("place", "id"))
    calls = _asked(_members(regions, nodes, ["region"]), judge, SIBLINGS, enrich.REGION_BATCH)
    found = _ids(calls).select("doc", F.col("key").alias("region"), "ids", F.posexplode("answer.groups").alias("k", "g"))
    found = found.join(regions.select("doc", "region", "parent").distinct(), ["doc", "region"])
    members = F.expr("transform(filter(array_distinct(g.members), i -> i >= 0 and i < size(ids)), i -> ids[i])")
    groups = found.select("doc", "region", "k", "parent", members.alias("members"), F.col("g.group_type").alias("group_type")).where("size(members) >= 2")
    groups = cut(groups.withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("region", "k"))))
    new, out = enrich.grouped(edges, groups.select("doc", "parent", "n", "members"))
    kind = groups.select("doc", F.concat(F.lit("content:"), "doc", F.lit(":grp"), F.col("n").cast("string")).alias("id"), "group_type")
    return new.join(kind, ["doc", "id"]), out, calls.select(*CALL)


def enriched(nodes: DataFrame, edges: DataFrame, judges: dict[str, Judge], lines: DataFrame | None = None, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls) after every pass for which there is a judge, in the order regions, lines, anchors, headings, captions, groups.

    Numbered headings are nested after the judged ones, as their pattern is certain.
    """
    calls = []

    def kept(name: str, rows: DataFrame) -> None:
        calls.append(rows.withColumn("pass", F.lit(name)))

    for name, clusters, merge in (("regions", regions, merge_regions), ("lines", lines, merge_fragments)):
        if name in judges and clusters is not None:
            nodes, edges, rows = merge(nodes, edges, clusters, judges[name])
            nodes, edges = cut(nodes.drop("merged_from")), cut(edges)
            kept(name, rows)
    edges = _native(edges)
    if "anchors" in judges:
        near = cut(windows.without_captions(windows.row_siblings(windows.context_windows(nodes), nodes) if "row" in nodes.columns else windows.context_windows(nodes).select("doc", "artifact", "anchor", "candidate"), edges))
        near = near.join(nodes.select("doc", F.col("id").alias("candidate"), "ord"), ["doc", "candidate"])
        more, picks = enrich.proposals(near, nodes, judges["anchors"])
        asked = picks.select("doc", "id", "parent").join(nodes.select("doc", "id", "ord"), ["doc", "id"])
        moved = enrich.with_reparents(edges, enrich.reparented(nodes, edges, asked)).drop("reparented_from")
        edges = cut(moved.unionByName(more.drop("rationale"), allowMissingColumns=True).distinct())
    if "headings" in judges:
        edges, _, rows = text_headings(nodes, edges, judges["headings"])
        edges = cut(edges.drop("reparented_from"))
        kept("headings", rows)
    nested = headings.numbered_nesting(with_parents(nodes, edges))
    outcomes = enrich.reparented(nodes, edges.withColumn("structural_source", F.lit(None).cast("string")), ordered(nested, nodes))
    edges = cut(enrich.with_reparents(edges, outcomes).drop("reparented_from"))
    if "captions" in judges:
        edges, rows = confirm_captions(nodes, edges, judges["captions"])
        kept("captions", rows)
    if "groups" in judges:
        new, edges, rows = group_siblings(nodes, edges, judges["groups"])
        nodes = nodes.unionByName(new, allowMissingColumns=True)
        kept("groups", rows)
    none = nodes.sparkSession.createDataFrame([], "doc string, key string, question string, status string, error string, pass string")
    return nodes, edges, functools.reduce(DataFrame.unionByName, calls, none)
