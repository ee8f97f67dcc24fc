"""Heading hierarchy, numbered nesting, enumerated runs and nearest-heading joins, as window expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut

# Patterns of section numbers, list items and heading markers.
NUMBERED = r"^(\d+(?:\.\d+)*)\s+[A-Za-z]"
ENUMERATED = r"^(\d+)\)(?!\s*\d)"
FAMILIES = {"numbered": r"^(\d{1,2})[.\s]+(?!\d)\S", "circled": r"^[①-⑳]", "angled": r"^<[^<>]{1,40}>$"}
#: Up to so many levels, or depths of numbers, each is a window expression; beyond, a scope is folded in one pass.
MOST_COLUMNS = 24


def scope() -> W:
    return W.partitionBy("doc", "artifact").orderBy("ord")


def before() -> W:
    return scope().rowsBetween(W.unboundedPreceding, -1)


def hierarchy(events: DataFrame, owns_body: bool = True) -> DataFrame:
    """events (doc, artifact, ord, id, level, excluded) with parent, structural.

    The parent of a heading is the last heading before it of a lesser level, that of a body node the last heading; the
    artifact where there is none. An event without id is a barrier: what would hang under it stays
    under the artifact. Excluded events hang under the artifact and are no headings. Levels are any whole numbers.
    """
    known = sorted(r[0] for r in events.where("level is not null and not excluded").select("level").distinct().limit(MOST_COLUMNS + 1).collect())
    if len(known) > MOST_COLUMNS:
        return _folded(events, owns_body)
    types = dict(events.dtypes)
    none = F.lit(None).cast(f"struct<ord:{types['ord']},at:{types['id']}>")
    heading = F.col("level").isNotNull() & ~F.col("excluded")
    df = events
    for k, level in enumerate(known):
        df = df.withColumn(f"l{k}_", F.last(F.when(heading & (F.col("level") == level), F.struct("ord", F.col("id").alias("at"))), True).over(before()))
    nearest = lambda n: F.greatest(*[F.col(f"l{j}_") for j in range(n)]) if n > 1 else F.col("l0_") if n else none
    at = F.when(F.col("excluded"), none).when(F.col("level").isNull(), nearest(len(known)) if owns_body else none)
    for k, level in enumerate(known):
        at = at.when(F.col("level") == level, nearest(k))
    df = df.withColumn("at_", at).where("id is not null")
    # Under a barrier nothing is proven; without any heading above, a heading is at the top of its scope.
    structural = ~F.col("excluded") & F.when(F.col("at_").isNull(), F.col("level").isNotNull()).otherwise(F.col("at_.at").isNotNull())
    return df.select(*events.columns, F.coalesce("at_.at", F.col("artifact").cast(types["id"])).alias("parent"), structural.alias("structural"))


def _folded(events: DataFrame, owns_body: bool) -> DataFrame:
    """hierarchy() for scopes of very many levels: one pass over a scope's events with the open headings."""
    types = dict(events.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: list[tuple[int, str | None]] = []
        parents, proven = [], []
        for artifact, ident, level, excluded in pdf.sort_values("ord")[["artifact", "id", "level", "excluded"]].itertuples(index=False):
            heading = not excluded and not pd.isna(level)
            while heading and open_ and open_[-1][0] >= level:
                open_.pop()
            above = open_[-1] if open_ and not excluded and (heading or owns_body) else None
            parents.append(artifact if above is None or above[1] is None else above[1])
            proven.append(not excluded and (heading if above is None else above[1] is not None))
            if heading:
                open_.append((level, ident if isinstance(ident, str) else None))
        out = pdf.sort_values("ord").assign(parent=parents, structural=proven)
        return out[out["id"].notna()]

    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + f", parent {types['id']}, structural boolean"
    return events.groupBy("doc", "artifact").applyInPandas(run, schema)


def section_number(text: Column) -> Column:
    n = F.regexp_extract(text, NUMBERED, 1)
    return F.when(n != "", n)


def numbered_nesting(nodes: DataFrame) -> DataFrame:
    """'N.M Title' under the nearest open 'N' of its artifact: rows (doc, id, parent).

    With p the number without its last part: of the headings before whose number doesn't begin with 'p.', the last is the parent if its
    number is p. Headings that begin with one p and follow each other are a run, by their first parts, so that heading is the one
    before the run: a lag at its start, carried on, for each depth that occurs.
    """
    heads = nodes.where("type = 'Text' and not coalesce(is_toc, false)").withColumn("number", section_number(F.col("text"))).where("number is not null")
    heads = heads.withColumn("parts_", F.split("number", "[.]"))
    deep = sorted(r[0] - 1 for r in heads.select(F.size("parts_")).distinct().collect() if r[0] > 1)
    before_run = F.lit(None).cast(f"struct<number:string,id:{dict(nodes.dtypes)['id']}>")
    here = scope().rowsBetween(W.unboundedPreceding, 0)
    pick = F.when(F.lit(False), before_run)
    for k in deep:
        heads = heads.withColumn("key_", F.when(F.size("parts_") > k, F.array_join(F.slice("parts_", 1, k), ".")))
        same = F.lag("key_").over(scope()).eqNullSafe(F.col("key_")) & (F.row_number().over(scope()) > 1)
        prior = F.struct(F.lag("number").over(scope()).alias("number"), F.lag("id").over(scope()).alias("id"))
        heads = heads.withColumn("start_", F.when(~same, prior)).withColumn(f"b{k}_", F.last("start_", True).over(here))
        pick = pick.when(F.size("parts_") == k + 1, F.col(f"b{k}_"))
    p = F.array_join(F.expr("slice(parts_, 1, size(parts_) - 1)"), ".")
    return heads.withColumn("at_", pick).where((F.size("parts_") > 1) & (F.col("at_.number") == p)).select("doc", "id", F.col("at_.id").alias("parent"))


def enumerated_runs(nodes: DataFrame) -> DataFrame:
    """Runs of 'n)' texts that count up by one under one parent: rows (doc, artifact, run, n, first_id, ids)."""
    n = F.regexp_extract("text", ENUMERATED, 1)
    df = nodes.where("type = 'Text'").withColumn("item", F.when(n != "", n.cast("int"))).withColumn("heading_", section_number(F.col("text")).isNotNull() | F.coalesce("is_toc", F.lit(False)))
    df = df.where("item is not null or heading_")
    prev = F.lag("item").over(scope())
    same = (F.col("item") == prev + 1) & F.lag("parent").over(scope()).eqNullSafe(F.col("parent"))
    df = df.withColumn("new_", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    df = df.withColumn("run", F.sum("new_").over(scope().rowsBetween(W.unboundedPreceding, 0))).where("item is not null")
    runs = df.groupBy("doc", "artifact", "run").agg(F.count("*").alias("n"), F.min_by("id", "ord").alias("first_id"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    return runs.where("n >= 2")


def families(text: Column) -> Column:
    """Which kinds of heading markers a text of up to 60 code points has."""
    return F.when(F.length(text) <= 60, F.array_compact(F.array(*[F.when(text.rlike(p), f) for f, p in FAMILIES.items()]))).otherwise(F.array().cast("array<string>"))


def open_headings(nodes: DataFrame) -> DataFrame:
    """Each text's nearest marker before it of each family, at any distance: rows (doc, id, family, heading).

    A text with a section number only gets a section number.
    """
    df = nodes.where("type = 'Text'").withColumn("own_", families(F.col("text")))
    for f in FAMILIES:
        df = df.withColumn(f"{f}_", F.last(F.when(F.array_contains("own_", f), F.col("id")), True).over(before()))
    pick = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"{f}_").alias("heading")) for f in FAMILIES])
    df = df.select("doc", "id", "own_", F.explode(pick).alias("p")).where("p.heading is not null")
    return df.where("not array_contains(own_, 'numbered') or p.family = 'numbered'").select("doc", "id", "p.family", "p.heading")


def confirmed_heading(nodes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The nearest heading before each text that is one of the confirmed (doc, id): rows (doc, id, heading)."""
    mark = confirmed.select("doc", "id").distinct().withColumn("yes_", F.lit(True))
    df = nodes.join(mark, ["doc", "id"], "left").withColumn("heading", F.last(F.when(F.col("yes_"), F.col("id")), True).over(before()))
    return df.where("type = 'Text' and heading is not null").where(section_number(F.col("text")).isNull()).select("doc", "id", "heading")


def depths(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """rows (doc, id, depth) along (doc, id, parent): a root has 0, whatever the depth. Pointer doubling; what leads to a cycle has null."""
    up = parents.groupBy("doc", "id").agg(F.max("parent").alias("parent"))
    here = nodes.select("doc", "id").distinct().join(up, ["doc", "id"], "left").select("doc", "id", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    most = up.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step <= most:
        far = here.select("doc", F.col("id").alias("to"), F.col("to").alias("far"), F.col("depth").alias("more"))
        here = cut(here.join(far, ["doc", "to"], "left").select("doc", "id", F.col("far").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        step *= 2
        if here.where("to is not null").isEmpty():
            break
    return here.select("doc", "id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))
