"""Operators on documents against plain sequential versions, on texts with every odd case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import kernel as K
from foliograph.llm import op1_decontamination as op1
from foliograph.llm import op2_minhash_dedup as op2
from foliograph.llm import op5_syncmers as op5
from foliograph.llm import op6_repeated_bytes as op6
from foliograph.llm import op7_substring_dedup as op7

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, kept string"


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["été", "Ünïcode", "X", "."]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(120), say(45)
    near = base.split()
    near[7] = "changed"
    out = [None, "", "   \n\t ", "one", "one", base, base, " ".join(near), base.upper(), passage + " " + say(30), say(40) + "\n" + passage, say(12) + "\t" + passage + say(9), "aa " * 90, "aa " * 90, say(4000), say(300), "日本語の文 " * 30, say(3), say(19), say(20)]
    return list(enumerate(out))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "clash", None) for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def expected_op7(rows, window):
    seen, out = set(), {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window,batches", [(20, 2), (5, 4), (1, 1)])
def test_substring_dedup(spark, window, batches):
    rows = texts()
    got = by_id(op7.dedup(docs_of(spark, rows).withColumn("n_removed", F.lit("x")), window, batches))
    want = expected_op7(rows, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want


def test_index_finds_what_earlier_batches_had(spark):
    index = op7.FingerprintIndex(spark, fan_in=2)
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "fp long")
    assert index.add(df(1, 2, 2)).collect() == [(2,)]
    assert [r[0] for r in index.add(df(1, 3)).collect()] == [1]
    index.compact()
    assert [lv for lv, _ in index.runs] == [1]
    assert {tuple(r) for r in spark.table(index.runs[0][1]).collect()} == {(1, 2), (2, 2), (3, 1)}
    for _, name in index.runs:  # as in a session that doesn't know the runs
        spark.sql(f"drop table {name}")
    again = op7.FingerprintIndex(spark, index.path)
    assert again.runs == index.runs and again.buckets == index.buckets
    assert sorted(r[0] for r in again.add(df(3, 2, 9)).collect()) == [2, 3]
    with op7.whole_buckets(spark):
        plan = again.older(spark.table(again.runs[-1][1]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_batches_added_one_by_one(spark):
    rows = texts()
    want, got = expected_op7(rows, 20), {}
    index = op7.FingerprintIndex(spark, fan_in=2)
    for low in (0, 7, 14):
        part, before = [r for r in rows if low <= r[0] < low + 7], [r for r in rows if r[0] < low]
        index = op7.FingerprintIndex(spark, index.path) if low else index
        out = op7.dedup(docs_of(spark, part), 20, 1, index=index, before=docs_of(spark, before))
        got |= {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in by_id(out).items()}
    assert got == want


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("foliograph.llm.shared.BROADCAST_BYTES", 0)
    monkeypatch.setattr("foliograph.llm.repeats.HOT", 10**9)  # every class is hot
    rows = texts()
    got = by_id(op7.dedup(docs_of(spark, rows)))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == expected_op7(rows, 20)


def test_different_texts_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = docs_of(spark, [(1, a), (2, a), (2, b), (2, b), (None, b)])
    lost = sorted((r["doc_id"] or 0, r["text"][0], r["n_removed"]) for r in op7.dedup(docs).collect())
    assert lost == [(0, "b", 0), (1, "a", 0), (2, "a", 60), (2, "b", 0), (2, "b", 0)]
    gone = sorted((r["doc_id"] or 0, r["n_bytes"] - r["n_removed"]) for r in op6.removed(docs.where("doc_id is null or text like 'a%' or doc_id = 1"), 40).collect())
    assert gone == [(0, len(b)), (1, 0), (2, 0)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in op6.removed(docs.where("doc_id > 0").dropDuplicates(["doc_id", "text"]), 40).collect()) == [(1, len(a)), (2, 0), (2, len(a))]
    near = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in op2.near_duplicates(docs).collect())
    assert near == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True)]
    bench = spark.createDataFrame([(7, " ".join(a.split()[:12]))], "item_id long, text string")
    hit = sorted((r["doc_id"] or 0, r["n_hit"]) for r in op1.contamination(docs, bench).collect())
    assert hit == [(0, 0), (1, 12), (2, 0), (2, 0), (2, 12)]


def test_substring_dedup_of_nothing(spark):
    assert op7.dedup(docs_of(spark, []).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("width", [400, 24, 5])
def test_repeated_bytes(spark, width):
    rows = texts()
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[s : s + width] for b in raw.values() for s in range(len(b) - width + 1))
    want = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g))
    got = by_id(op6.removed(docs_of(spark, rows), width))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == want


def test_repeated_bytes_of_nothing(spark):
    assert op6.removed(docs_of(spark, [])).count() == 0


def shingles(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[s : s + 5]) for s in range(len(w) - 4)} or ({tuple(w)} if w else set())


def expected_op2(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark):
    rows = texts()
    rng = random.Random(6)
    base = [f"v{i}" for i in range(400)]
    for i in range(40):  # a group of near copies whose copies are less alike than each and the first
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(400)] = f"x{rng.random()}"
        rows.append((100 + i, " ".join(w)))
    got = by_id(op2.near_duplicates(docs_of(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == expected_op2(rows)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_rare_shingles_lose_no_link(spark, percent):
    """Many texts with one passage, unlike but for it, and pairs among them at every likeness around the threshold."""
    rng = random.Random(percent)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = say(60), []
    for i in range(60):
        one = say(rng.randrange(20, 90)) + passage + say(rng.randrange(5, 60))
        two = list(one)
        for _ in range(i % 7):
            two[rng.randrange(len(two))] = "changed"
        rows += [(2 * i, " ".join(one), 2 * i), (2 * i + 1, " ".join(two), 2 * i + 1)]
    rest = spark.createDataFrame(rows, "rep long, text string, comp long")
    pairs = op2.rare_pairs(rest.select("rep", "comp"), rest.select("rep", "text"), percent, 5)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert len(got) < 200  # of 7,140 pairs that share the passage
    linked = {(r.a, r.b) for r in op2.confirmed(pairs, rest.select("rep", "text"), percent, 5).collect()}
    sets = [shingles(t) for _, t, _ in rows]
    all_pairs = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert linked == all_pairs and all_pairs


def test_near_duplicates_of_nothing(spark):
    assert op2.near_duplicates(docs_of(spark, [])).count() == 0
    got = op2.near_duplicates(docs_of(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [(0, True), (3, True), (3, True)]


def expected_op1(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for k, t in items:
        w = cut(t)
        if w and k is not None:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s : s + n]), set()).add(k)
    out = {}
    for i, t in rows:
        w, gone, ids = cut(t), set(), set()
        for n in range(1, window + 1):
            for s in range(len(w) - n + 1):
                hit = wins.get(tuple(w[s : s + n]))
                if hit:
                    gone.update(range(s, s + n))
                    ids |= hit
        out[i] = (len(w), len(gone), sorted(map(str, ids)))
    return out


def test_decontamination(spark):
    rows = texts()
    passage = rows[9][1].split()
    items = [(1, " ".join(passage[3:30])), (2, " ".join(passage[20:32]).upper() + "!"), (12, " ".join(passage[5:15])), (3, "one"), (4, "w1 w2"), (5, None), (6, ""), (7, "... !!"), (None, "one"), (8, "aa " * 30), (8, "w3 w4 w5"), (9, " ".join(f"q{i}" for i in range(10)))]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    got = by_id(op1.contamination(docs_of(spark, rows), bench))
    assert {i: (r["n_words"], r["n_hit"], r["item_ids"]) for i, r in got.items()} == expected_op1(rows, items)


def test_fingerprints_of_many_partitions_are_few_files(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(40)) + (" the planted words of an item of the benchmark here" if i % 7 == 0 else "")) for i in range(200)]
    items = [("a", "say the planted words of an item of the benchmark here again"), ("b", "planted words of")]
    made, write = {}, op1.written
    monkeypatch.setattr(op1, "written", lambda df, what: made.setdefault(what, write(df, what)))
    docs = docs_of(spark, rows).repartition(40)
    got = by_id(op1.contamination(docs, spark.createDataFrame(items, "item_id string, text string")))
    assert {i: (r["n_words"], r["n_hit"], r["item_ids"]) for i, r in got.items()} == expected_op1(rows, items)
    assert len(made["fingerprints"].inputFiles()) <= 4
    # A benchmark that no bitmap holds: nothing is moved, and the rows are the same.
    made.clear()
    monkeypatch.setattr(op1, "MOST_SLOTS", 0)
    got = by_id(op1.contamination(docs, spark.createDataFrame(items, "item_id string, text string")))
    assert {i: (r["n_words"], r["n_hit"], r["item_ids"]) for i, r in got.items()} == expected_op1(rows, items)
    assert len(made["fingerprints"].inputFiles()) == 40


def test_decontamination_of_and_by_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op1.contamination(docs_of(spark, []), none).count() == 0
    assert [r["contaminated"] for r in op1.contamination(docs_of(spark, [(1, "a b")]), none).collect()] == [False]


def test_fingerprints(spark):
    rows = texts()
    got = by_id(op5.with_next(docs_of(spark, rows)))
    assert len(got) == len(rows)
    plain = {i: t or "" for i, t in rows}
    for i, _ in rows:
        t, n = plain[i], plain[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] != got[14]["fingerprint"] and got[5]["near_next"] == 1
    assert got[14]["near_edited"] > 0.15 > got[14]["near_next"]
    assert by_id(op5.fingerprints(docs_of(spark, rows)))[14]["fingerprint"] == got[14]["fingerprint"]


def test_fingerprints_at_the_limit_of_short_texts(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200))
    sizes = [505, 511, 512, 515, 500, 520, 490, 530]
    got = by_id(op5.with_next(docs_of(spark, [(i, text[:n]) for i, n in enumerate(sizes)])))
    assert all(got[i]["near_next"] > 0.85 for i in range(len(sizes) - 1))
    # The edit shortens the text from 540 to 490 bytes, of which 270 are kept.
    (r, _) = op5.with_next(docs_of(spark, [(1, text[:540]), (2, text[600:820])])).orderBy("doc_id").collect()
    assert r["near_edited"] > 0.3
    assert [f.count("|") for f in (got[0]["fingerprint"], got[2]["fingerprint"])] == [1, 0]


def plain_sketch(t, k, inner):
    """The closed syncmers of a text, string by string, and the least 64 of their hashes with their first places."""
    b = t.encode()
    h = lambda s: int(K.Ranges(op5.BYTES[np.frombuffer(s, np.uint8)], K.BASE_2).of(np.array([0]), np.array([len(s)]))[0]) >> 16
    rank = lambda s: int(K.ngrams(op5.BYTES[np.frombuffer(s, np.uint8)], inner)[0])
    found = {}
    for p in range(len(b) - k + 1):
        own = [rank(b[p + i : p + i + inner]) for i in range(k - inner + 1)]
        if own.index(min(own)) in (0, len(own) - 1):
            found.setdefault(h(b[p : p + k]), p)
    if not found and b:
        found = {h(b): 0}
    return sorted(found.items())[:64]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    least = sorted({x for x, _ in a} | {x for x, _ in b})[:64]
    pairs = sorted((dict(a)[x], dict(b)[x]) for x in least if x in dict(a) and x in dict(b))
    best = []
    for i, (_, q) in enumerate(pairs):
        best.append(1 + max([best[j] for j in range(i) if pairs[j][1] < q], default=0))
    return max(best, default=0) / len(least)


def test_fingerprints_by_plain_loops(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"é{rng.randrange(300)}" for _ in range(n))
    base = say(250)
    rows = list(enumerate([base, base[200:] + base[:200], say(60), "", "short", "shorter", say(20), "ab" * 300, base + say(40), say(700)]))
    got = by_id(op5.with_next(docs_of(spark, rows)))
    kinds = lambda t: [plain_sketch(t, 24, 8)] + ([plain_sketch(t, 6, 3)] if len(t.encode()) < 512 else [])
    for i, t in rows:
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        own, other = kinds(t), kinds(n)
        assert got[i]["fingerprint"] == "|".join(" ".join(f"{x:012x}@{p:x}" for x, p in s) for s in own if s)
        kind = min(len(own), len(other)) - 1
        assert got[i]["near_next"] == pytest.approx(plain_likeness(own[kind], other[kind]))
        ed = kinds(edited)
        kind = min(len(own), len(ed)) - 1
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own[kind], ed[kind]))


def test_large_ids_and_null_ids_in_ranges(spark):
    big = (1 << 62) + 1
    rows = [(big + 2 * i, f"text {i}") for i in range(40)] + [(None, "no id")]
    got = {r["doc_id"]: r for r in op5.with_next(docs_of(spark, rows)).collect()}
    assert len(got) == 41
    assert got[big]["edited_sha256"] == hashlib.sha256(b"texttex").hexdigest() or got[big]["edited_sha256"] == hashlib.sha256("text 0"[:3].encode() + "text 1"[:3].encode()).hexdigest()


def test_recall_of_near_copies_at_the_threshold():
    """Of pairs of sets alike by 0.80 to 0.90, the share that meets in a bucket."""
    rng = np.random.default_rng(3)
    met = {80: [], 85: []}
    for low in met:
        for _ in range(1500):
            n, like = int(rng.integers(50, 600)), rng.uniform(low / 100, low / 100 + 0.05)
            both = int(round(2 * n * like / (1 + like)))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = np.append(a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            keys = op2.band_keys(op2.signatures([np.sort(a), np.sort(b)]))
            met[low].append((keys[0] == keys[1]).any())
    assert np.mean(met[85]) >= 0.999 and np.mean(met[80]) >= 0.99


def test_fingerprints_of_few(spark):
    assert op5.with_next(docs_of(spark, [])).count() == 0
    (r,) = op5.with_next(docs_of(spark, [(7, "only this text")])).collect()
    assert r["near_next"] == 1
    assert op5.with_next(docs_of(spark, [(7, "a text"), (7, "a text"), (9, None)])).count() == 3
