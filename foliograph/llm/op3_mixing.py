"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order, are cut into blocks. Block i of a source of weight w is released at
floor(i / w) and due at ceil((i + 1) / w). Earliest deadline first gives every slot a block, and as the weights sum to 1,
every block lies in its window: at every slot of a phase, each source has had less than one block more or less than its
share. The weights are fractions and never rounded, so that this holds over the whole phase, however long. When a source
runs out a new phase begins, in which the others share its weight; so all documents are placed.

The order in a source comes from buckets of a hash of doc_id, counted first and ranked each on its own, so that one
source may hold any part of the rows. The driver gets a count for each source, nothing for each document, and makes
a slot of 8 bytes for each block; documents get theirs by a join on runs of ``RUN`` blocks.

Defined results: a null source is a source of its own; sources without a weight share what the others leave in
proportion to the square root of their rows; a null doc_id counts as 0 in the order; rows that repeat are placed each; an empty table gives no rows; texts are not
read; other columns are kept, and those that have the name of one of the four new ones are replaced; a source of weight 0 comes after all others.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized, table

BLOCK, BUCKET_ROWS, SEED, RUN = 64, 2000, 3, 256


def parts(weights: dict, frame: int) -> dict:
    """Weights as whole numbers of slots that sum to frame, at least 1 each, by largest remainders."""
    frame = max(frame, 8 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * frame for s, w in weights.items()}
    got = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (exact[s] - got[s], str(s)), reverse=True)
    i = 0
    while sum(got.values()) < frame:
        got[order[i % len(order)]] += 1
        i += 1
    while sum(got.values()) > frame:
        s = max(got, key=lambda s: (got[s] - exact[s] if got[s] > 1 else -math.inf, str(s)))
        got[s] -= 1
    return got


def frame_of(got: dict) -> list:
    """The source of each slot of a frame, by earliest deadline among the released blocks."""
    f = sum(got.values())
    names = sorted(got, key=str)
    wait = [(0, n) for n in range(len(names))]  # release, source
    done, ready, out = [0] * len(names), [], []
    heapq.heapify(wait)
    for t in range(f):
        while wait and wait[0][0] <= t:
            _, n = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(done[n] + 1) * f // got[names[n]]), n))
        due, n = heapq.heappop(ready)
        assert due > t
        out.append(names[n])
        done[n] += 1
        if done[n] < got[names[n]]:
            heapq.heappush(wait, (done[n] * f // got[names[n]], n))
    return out


def phase_of(left: dict, weights: dict) -> tuple[dict, int]:
    """(slots of each source, length) until a source without blocks left is due, by earliest deadline and exact weights."""
    exact = {s: Fraction(weights[s]) for s in left if weights[s] > 0} or dict.fromkeys(left, Fraction(1))
    unit = math.lcm(*(x.denominator for x in exact.values()))
    names = sorted(exact, key=str)
    part = [int(exact[s] * unit) for s in names]
    f = sum(part)
    own = {s: array("q") for s in left}
    slots, most = [own[s] for s in names], [left[s] for s in names]
    wait, ready, t = [(0, n) for n in range(len(names))], [], 0  # release, source; deadline, source
    while True:
        while wait and wait[0][0] <= t:
            _, n = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(len(slots[n]) + 1) * f // part[n]), n))
        due, n = heapq.heappop(ready)
        assert due > t
        if len(slots[n]) == most[n]:
            return own, t
        slots[n].append(t)
        heapq.heappush(wait, (len(slots[n]) * f // part[n], n))
        t += 1


def schedule(blocks: dict, weights: dict, frame: int | None = None) -> dict:
    """For each source its phases: (first block, first slot, frame length, slots of a frame).

    A phase is one frame by the exact weights; with a frame length, frames of weights rounded to its slots, repeated.
    """
    left = {s: n for s, n in blocks.items() if n}
    had = dict.fromkeys(left, 0)
    out: dict = {s: [] for s in left}
    slot = 0
    while left and not frame:
        own, length = phase_of(left, weights)
        for s in list(left):
            if len(own[s]):
                out[s].append((had[s], slot, length, own[s]))
            had[s] += len(own[s])
            left[s] -= len(own[s])
            if not left[s]:
                del left[s]
        slot += length
    while left:
        got = parts({s: weights[s] for s in left}, frame)
        order = frame_of(got)
        own: dict = {s: [] for s in left}
        for i, s in enumerate(order):
            own[s].append(i)
        for s in left:
            out[s].append((had[s], slot, len(order), own[s]))
        whole = min(left[s] // got[s] for s in left)
        took = {s: whole * got[s] for s in left}
        slot += whole * len(order)
        for s in order:
            if took[s] == left[s]:
                break
            took[s] += 1
            slot += 1
        for s in list(left):
            had[s] += took[s]
            left[s] -= took[s]
            if not left[s]:
                del left[s]
    return out


def slots_of(phases: list, n: int) -> np.ndarray:
    """The slot of each of a source's n blocks."""
    out = np.empty(n, np.int64)
    for (first, slot, frame, slots), end in zip(phases, [*(p[0] for p in phases[1:]), n]):
        frames, at = np.divmod(np.arange(end - first), len(slots))
        out[first:end] = slot + frames * frame + np.asarray(slots, np.int64)[at]
    return out


def weights_of(rows: dict, given: dict | None) -> dict:
    """The given weights (shares of 1); sources without one share the rest by the square root of their rows."""
    given = {s: w for s, w in (given or {}).items() if s in rows}
    rest = {s: math.sqrt(n) for s, n in rows.items() if s not in given}
    share = max(1 - sum(given.values()), 1e-3 * len(rest)) if rest else 0
    return given | {s: w / sum(rest.values()) * share for s, w in rest.items()}


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, frame: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with block (of its source), slot, place (in the block) and position (slot * block length + place)."""
    spark = docs.sparkSession
    rows = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    n = sum(rows.values())
    buckets = min(1 << 20, max(1, math.ceil(n / BUCKET_ROWS)))
    blocks = {s: math.ceil(k / block) for s, k in rows.items()}
    slots = {s: slots_of(p, blocks[s]) for s, p in schedule(blocks, weights_of(rows, weights), frame).items()}
    runs = [(s, i, x[i * RUN : (i + 1) * RUN].tolist()) for s, x in slots.items() for i in range(math.ceil(len(x) / RUN))]
    placed = spark.createDataFrame(runs, "s_ string, run_ long, slots_ array<long>")
    h = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), F.lit(seed))
    lost = {"block", "slot", "place", "position"}
    names = [c for c in docs.columns if c.lower() not in lost]
    # The row goes through as one column, so that none of its names can meet one of these.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source"), F.col("doc_id"), h.alias("h"))
    keyed = keyed.withColumn("bucket", F.expr(f"cast(shiftrightunsigned(h, 11) / {float(1 << 53)!r}D * {buckets} as int)"))
    size = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)")
    offsets = size.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    ranked = keyed.withColumn("rank", F.expr("row_number() over (partition by source, bucket order by h, doc_id)"))
    ranked = ranked.join(sized(offsets, 64, buckets * max(1, len(rows))), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    at = ranked.withColumn("at", F.expr("before + rank - 1"))
    at = at.withColumn("block", F.expr(f"at div {block}")).withColumn("place", F.expr(f"at % {block}"))
    at = at.join(sized(placed, 8 * RUN + 64, len(runs)), F.col("source").eqNullSafe(F.col("s_")) & (F.expr(f"block div {RUN}") == F.col("run_")))
    at = at.withColumn("slot", F.expr(f"get(slots_, cast(block % {RUN} as int))"))
    return at.select("row.*", "block", "slot", "place", F.expr(f"slot * {block} + place").alias("position"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
