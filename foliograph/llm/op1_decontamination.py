"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's 5-gram hashes are winnowed: of any six consecutive grams, which are one window of ten words, the
least is kept, the leftmost of equals. Equal windows keep equal grams, so every shared span of ten words
or more meets in a fingerprint. Documents' fingerprints are joined with the benchmark's, and a hit is extended word
by word to both sides; it counts if ten words in a row agree.

Before the join, documents' grams are looked up in a bitmap of the benchmark's fingerprints. It has ``SLOTS`` bits, or as many more as
keep it at most a quarter full, up to ``MOST_SLOTS`` (512 KiB); for a larger benchmark all grams go on to the join, which gives the same rows.
What passes the bitmaps is gathered in a file for each ``ROWS_A_FILE`` documents.

An item of fewer than ten words is one window of that length: its hash is joined with those of
all stretches of as many words. There are at most nine such lengths.

Defined results: an empty table gives no rows, and without items nothing is hit; a null or empty text has no words, is not hit and hits
nothing; equal rows of one doc_id all get that document's result, and different texts of one doc_id are documents of their own; an item_id that repeats counts once, with the windows
of all its rows; items without item_id and documents without doc_id hit and are hit by nothing. Extra columns stay out of it. The arrays of a text's words and grams are held whole, some 100 bytes for each word of the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, with_given_ids, with_own_ids, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K, SLOTS, MOST_SLOTS = 5, 1 << 17, 1 << 22
ROWS_A_FILE = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def positions(last: str) -> str:
    """1 to last, or none if last is under 1."""
    return f"case when {last} >= 1 then sequence(1, {last}) else array() end"


def kept(window: int) -> str:
    """Whether the gram at p is the leftmost least of a whole window of grams: column g."""
    s = window - K + 1
    return f"exists(case when size(g) >= {s} then sequence(greatest(1, p - {s - 1}), least(p, size(g) - {s - 1})) else array() end, j -> array_position(slice(g, j, {s}), array_min(slice(g, j, {s}))) = p - j + 1)"


def in_bitmap(bits: list[int] | None, h: str) -> str:
    """Whether the slot of hash h is set; SQL text."""
    if bits is None:
        return "true"
    longs = ", ".join(f"{x}L" if x > -(1 << 63) else "shiftleft(1L, 63)" for x in bits)
    return f"(shiftrightunsigned(get(array({longs}), cast(shiftright({h} & {len(bits) * 64 - 1}L, 6) as int)), cast({h} & 63L as int)) & 1L) = 1L"


def bitmap(fps: DataFrame) -> list[int] | None:
    """The bits as 64-bit integers, or None if MOST_SLOTS would be too few. At most MOST_SLOTS / 4 slots come to the driver."""
    n, slots = fps.select("fp").distinct().count(), SLOTS
    while slots < 4 * n:
        slots *= 2
    if slots > MOST_SLOTS:
        return None
    longs = [0] * (slots // 64)
    for (s,) in fps.select(F.expr(f"fp & {slots - 1}L")).distinct().collect():
        longs[s >> 6] |= 1 << (s & 63)
    return [x - (1 << 64) if x >> 63 else x for x in longs]


def cut(w: DataFrame, window: int, lengths: list[int], bits: dict[int, list[int] | None]) -> DataFrame:
    """Adds found: the kept fingerprints (kind, fp, p, before, after) of column w that pass the bitmaps.

    kind: the window's length, under ``window`` for the stretches that short items are compared with.
    """
    w = w.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    w = w.withColumn("g", F.expr(f"transform({positions(f'size(h) - {K - 1}')}, i -> xxhash64(slice(h, i, {K})))"))
    hit = F.expr(f"filter({positions('size(g)')}, p -> {in_bitmap(bits.get(window), 'element_at(g, p)')} and {kept(window)})")
    ext = window - K
    full = F.transform(hit, lambda p: F.struct(F.lit(window).alias("kind"), F.expr("0L").alias("fp"), p.alias("p")))
    w = w.withColumn("at", full)
    parts = [F.expr(f"transform(at, x -> struct(x.kind as kind, element_at(g, x.p) as fp, x.p as p, slice(w, greatest(1, x.p - {ext}), x.p - greatest(1, x.p - {ext})) as before, slice(w, x.p, {window}) as after))")]
    for n in lengths:
        some = f"filter({positions(f'size(h) - {n - 1}')}, p -> {in_bitmap(bits.get(n), f'xxhash64(slice(h, p, {n}))')})"
        parts.append(F.expr(f"transform({some}, p -> struct({n} as kind, xxhash64(slice(h, p, {n})) as fp, p as p, cast(array() as array<string>) as before, slice(w, p, {n}) as after))"))
    return w.withColumn("found", F.concat(*parts) if len(parts) > 1 else parts[0])


def agree(a: str, b: str, n: int, back: bool) -> str:
    """How many words of arrays a and b agree from their near ends, up to n."""
    at = (lambda x: f"get({x}, size({x}) - i)") if back else (lambda x: f"get({x}, {K} + i - 1)")
    return f"aggregate(sequence(1, {n}), 0, (had, i) -> case when had = i - 1 and {at(a)} = {at(b)} then i else had end)"


def hits(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, n_words; spans of hit words: doc_id, item_id, a, b, the last not included)."""
    item = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    item = item.withColumn("n", F.size("w"))
    lengths = sorted(r[0] for r in item.where(f"n < {window}").select("n").distinct().collect())
    # Written before it is exploded: a filter on what is exploded would be moved down to the texts and cut them anew for each gram.
    long = written(cut(item.where(f"n >= {window}"), window, [], {}).select("item_id", "found"), "item-fingerprints")
    ref = long.select("item_id", F.explode("found").alias("f")).select("item_id", "f.*")
    if lengths:
        short = item.where(f"n < {window}").selectExpr("item_id", "n as kind", "xxhash64(transform(w, x -> xxhash64(x))) as fp", "1 as p", "cast(array() as array<string>) as before", "w as after")
        ref = ref.unionByName(short)
    ref = written(ref, "items")
    bits = {n: bitmap(ref.where(F.col("kind") == n)) for n in [window, *lengths]}
    cuts = cut(docs.select("doc_id", words(F.col("text")).alias("w")), window, lengths, bits)
    seen = cuts.select("doc_id", F.size("w").cast("long").alias("n_words"), "found")
    if None not in bits.values():
        # Few files: Hadoop's local file system starts a chmod for each that it makes, and a process just started is seen with all of the
        # executor's memory. Without a bitmap the rows are a multiple of the texts and stay where they are.
        seen = seen.repartition(docs.count() // ROWS_A_FILE + 1)
    seen = written(seen, "fingerprints")
    got = seen.where("doc_id is not null").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    ref = ref.select("item_id", "kind", "fp", F.col("before").alias("ib"), F.col("after").alias("ia"))
    met = got.join(ref, ["kind", "fp"])
    ext = window - K
    long = met.where(f"kind = {window} and slice(after, 1, {K}) = slice(ia, 1, {K})")
    long = long.withColumn("l", F.expr(agree("before", "ib", ext, True))).withColumn("r", F.expr(agree("after", "ia", ext, False)))
    spans = long.where(f"l + r >= {ext}").selectExpr("doc_id", "item_id", "p - l as a", f"p + {K} + r as b")
    if lengths:
        spans = spans.union(met.where(f"kind < {window} and after = ia").selectExpr("doc_id", "item_id", "p as a", "p + kind as b"))
    return seen.select("doc_id", "n_words"), written(spans, "spans")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    docs, ids = with_own_ids(docs.select("doc_id", "text"))
    seen, spans = hits(docs, items, window)
    n_hit = spans.select("doc_id", "a", "b").distinct().select("doc_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("p")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items_hit = spans.select("doc_id", F.col("item_id").cast("string").alias("i")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("item_ids"))
    found = n_hit.join(items_hit, "doc_id")
    none = F.expr("cast(array() as array<string>)")
    out = seen.join(found, "doc_id", "left").withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    out = out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
    return with_given_ids(out, ids)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = """
with docs as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
items as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)),
lens as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lens where len(w) >= n)),
hit as (select doc_id, item_id, n, i from dw join iw using (n, s)),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join pos using (doc_id) left join own using (doc_id)
"""
