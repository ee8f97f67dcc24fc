"""Trained operators, mixing and chat formatting."""

import itertools
import json
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from foliograph.llm import labelled
from foliograph.llm import op3_mixing as op3
from foliograph.llm import op4_quality_crf as op4
from foliograph.llm import op8_chat_format as op8
from foliograph.llm import op9_licences as op9
from foliograph.llm import op10_toxicity as op10

ROWS = [(0, None), (1, ""), (2, "\n\n"), (3, "a"), (4, "x y " * 5000), (4, "x y " * 5000), (None, "z"), (5, "Some plain words in a line.\nAnd another line of words.")]
DOCS = "doc_id long, text string, lang string, source string, score double"


def some_docs(spark):
    return spark.createDataFrame([(i, t, None, None, 0.1) for i, t in ROWS], DOCS)


def accuracy(spark, out, labels, label):
    held = out.where(labelled.held_out()).join(labels, "doc_id").select("score", label).collect()
    cut = 0.3 if label == "quality" else 0.5
    return sum((r["score"] >= cut) == (r[label] == 1) for r in held) / len(held)


def test_held_out_is_the_checksum(spark):
    ids = [r[0] for r in spark.range(200).where(labelled.held_out("id")).collect()]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]


@pytest.mark.parametrize("label,least", [("quality", 0.95), ("toxic", 0.9)])
def test_held_out_accuracy(spark, label, least):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = op4.slim(docs, op4.train(docs, labels)) if label == "quality" else op10.toxicity(docs, op10.train(docs, labels))
    assert accuracy(spark, out, labels, label) >= least


@pytest.mark.parametrize("pairs", [[], [(3, 1)], [(3, 1), (5, 0), (4, None), (None, 1), (5, 1), (99, 0)]])
def test_scores_of_odd_rows(spark, pairs):
    docs = some_docs(spark)
    labels = spark.createDataFrame([(i, y, y) for i, y in pairs], "doc_id long, quality int, toxic int")
    for out in (op4.quality(docs, op4.train(docs, labels)), op10.toxicity(docs, op10.train(docs, labels))):
        scores = [r["score"] for r in out.collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert op4.slim(docs.limit(0), op4.train(docs, labels)).count() == 0


def random_model(rng):
    return op4.Model(rng.normal(0, 0.7, (3, op4.N, op4.BINS)), 0.3, rng.normal(0, 1, 2), (1.0, 0.0))


def weight_of(m, bins, labels):
    """The log-weight of a labelling of one chain, feature by feature."""
    total, n = 0.0, len(labels)
    for i in range(n):
        if labels[i]:
            total += m.bias
            for f in range(op4.N):
                total += m.emission[1][f, bins[f, i]]
                total += m.emission[0][f, bins[f, i - 1]] if i else 0
                total += m.emission[2][f, bins[f, i + 1]] if i + 1 < n else 0
        if i and labels[i] == labels[i - 1]:
            total += m.stay[0 if labels[i] else 1]
    return total


def test_marginals_of_all_labellings():
    rng = np.random.default_rng(1)
    m, first = random_model(rng), np.array([0, 8, 9, 14])
    bins, size = rng.integers(0, op4.BINS, (op4.N, 14)), rng.integers(1, 50, 14)
    got = op4.good_share(m, bins, size, first)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        every = list(itertools.product((0, 1), repeat=int(b - a)))
        w = np.exp([weight_of(m, bins[:, a:b], y) for y in every])
        marginal = (np.array(every) * w[:, None]).sum(axis=0) / w.sum()
        assert got[k] == pytest.approx((marginal * size[a:b]).sum() / size[a:b].sum())


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    m, first = random_model(rng), np.array([0, 5, 9])
    bins, label, weight = rng.integers(0, op4.BINS, (op4.N, 9)), rng.integers(0, 2, 9).astype(float), np.repeat([0.6, 0.9], [5, 4])

    def value(theta):
        own = op4.Model(theta[:-3].reshape(3, op4.N, op4.BINS), theta[-3], theta[-2:], (1.0, 0.0))
        out = 0.0
        for a, b in zip(first[:-1], first[1:]):
            every = [weight_of(own, bins[:, a:b], y) for y in itertools.product((0, 1), repeat=int(b - a))]
            out += weight[a] * (weight_of(own, bins[:, a:b], label[a:b].astype(int)) - np.logaddexp.reduce(every))
        return out

    theta = np.concatenate([m.emission.ravel(), [m.bias], m.stay])
    got = op4.gradient(m, bins, first, label, weight)
    used = [int(s * op4.N * op4.BINS + f * op4.BINS + bins[f, i]) for s in range(3) for f in (0, 5, 12) for i in (0, 4, 6)]
    for at in [*used, len(theta) - 3, len(theta) - 2, len(theta) - 1]:
        step = np.zeros(len(theta))
        step[at] = 1e-5
        assert got[at] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-5, abs=1e-6)


def plain_features(text):
    """Words, their first seven bytes, neighbours and pairs with one word between, as tuples."""
    w, cur = [], b""
    for c in (text or "").encode():
        if chr(c).isalnum() and c < 128 or c >= 128:
            cur += bytes([c + 32 if 65 <= c <= 90 else c])
        elif cur:
            w, cur = [*w, cur], b""
    w += [cur] if cur else []
    return {("w", x) for x in w} | {("s", x[:7]) for x in w} | {(1, a, b) for a, b in zip(w, w[1:])} | {(2, a, b) for a, b in zip(w, w[2:])}


def test_features_by_a_plain_list():
    texts = ["", "One two, THREE two", "one two three two", "abcdefgh abcdefgi", "été_x 12", "a b c d e f g", "x"]
    import pyarrow as pa

    data, off = op10.K.buffers(pa.array(texts))
    text, coord = op10.features(data, off, 40)
    own = [set(coord[text == i].tolist()) for i in range(len(texts))]
    plain = [plain_features(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in plain]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(own[i] & own[j]) == len(plain[i] & plain[j])


def test_ftrl_step_by_step():
    rng, bits = random.Random(4), 6
    rows = [np.array(sorted(rng.sample(range(64), rng.randint(0, 9))), np.int64) for _ in range(300)]
    y = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    alpha, beta, l1, l2 = 0.7, 1.0, 2.0, 1.5
    got = op10.fit(rows, y, bits, 3, alpha, beta, l1, l2)
    z, n, up = Counter(), Counter(), min(4.0, (1 - y.mean()) / y.mean())

    def w(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for own, label in zip(rows, y):
            at = [*own.tolist(), "bias"]
            had = {i: w(i) for i in at}
            g = (1 / (1 + math.exp(-sum(had.values()))) - label) * (up if label else 1)
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * had[i]
                n[i] += g * g
    want = {i: w(i) for i in range(64) if w(i)}
    assert dict(zip(got.at.tolist(), got.w.tolist())) == pytest.approx(want)
    assert got.bias == pytest.approx(w("bias")) and 0 < len(want) < 64


def plain_schedule(blocks, weights):
    """Slot by slot: of the blocks released, the one with the earliest deadline; a source that is due and has none left ends a phase."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        exact = {s: Fraction(weights[s]) for s in left if weights[s]} or {s: Fraction(1) for s in left}
        total, done, t = sum(exact.values()), dict.fromkeys(exact, 0), 0
        while True:
            ready = [(math.ceil((done[s] + 1) * total / w), str(s), s) for s, w in exact.items() if math.floor(done[s] * total / w) <= t]
            due, _, s = min(ready, key=lambda x: x[:2])
            assert due > t
            if done[s] == left[s]:
                break
            done[s] += 1
            out.append(s)
            t += 1
        left = {s: n - done.get(s, 0) for s, n in left.items() if n > done.get(s, 0)}
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0.0}, {"a": 0.01, "b": 0.97, "c": 0.01, "d": 0.01}])
def test_phases_slot_by_slot(weights):
    blocks = {"a": 130, "b": 40, "c": 7, "d": 21}
    plan = op3.schedule(blocks, weights)
    got = {t: s for s, p in plan.items() for t in op3.slots_of(p, blocks[s]).tolist()}
    assert [got[t] for t in range(len(got))] == plain_schedule(blocks, weights)


def test_mixing_and_scores_of_clashing_columns(spark):
    names = ["phases", "block", "slot", "place", "position", "row", "h", "bucket", "rank", "s", "b", "s_", "run_", "slots_", "before", "at", "score"]
    docs = spark.createDataFrame([(i, "x y z " * i, "ab"[i % 2], *["own"] * len(names)) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = op3.mixed(docs, block=4)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.collect()
    assert {r["phases"] + r["rank"] + r["at"] for r in rows} == {"ownownown"} and sorted(r["position"] for r in rows)[:2] == [0, 1]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    scored = op4.quality(docs, op4.train(docs, labels))
    assert sorted(scored.columns) == sorted(docs.columns) and dict(scored.dtypes)["score"] == "double" and scored.count() == 30


def simulated(blocks, weights, frame):
    """Slot by slot: the source of each slot, phases as in schedule()."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        order = op3.frame_of(op3.parts({s: weights[s] for s in left}, frame))
        k = 0
        while left[order[k % len(order)]]:
            left[order[k % len(order)]] -= 1
            out.append(order[k % len(order)])
            k += 1
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("frame", [12, 60, 840])
def test_schedule(frame):
    blocks, weights = {"a": 301, "b": 40, None: 7, "d": 1}, {"a": 0.5, "b": 0.3, None: 0.15, "d": 0.05}
    want = simulated(blocks, weights, frame)
    got = {}
    for s, phases in op3.schedule(blocks, weights, frame).items():
        for j in range(blocks[s]):
            b0, s0, f, slots = [p for p in phases if p[0] <= j][-1]
            got[s0 + (j - b0) // len(slots) * f + slots[(j - b0) % len(slots)]] = s
    assert [got[t] for t in range(len(got))] == want


def test_less_than_a_block_of_deviation():
    got = op3.parts({"a": 0.41, "b": 0.33, "c": 0.2, "d": 0.06}, 840)
    done, f = Counter(), sum(got.values())
    for t, s in enumerate(op3.frame_of(got), 1):
        done[s] += 1
        assert all(abs(done[x] - got[x] * t / f) < 1 for x in got)


def test_less_than_a_block_of_deviation_from_the_weights():
    rows = {"hot": 1_500_000} | {f"s{i}": 150_000 for i in range(20)} | {"tiny": 64}
    blocks, weights = {s: -(-n // op3.BLOCK) for s, n in rows.items()}, op3.weights_of(rows, {"tiny": 1e-5})
    plan = op3.schedule(blocks, weights)
    slots = {s: op3.slots_of(p, blocks[s]) for s, p in plan.items()}
    assert sorted(t for x in slots.values() for t in x.tolist()) == list(range(sum(blocks.values())))
    end, total = min(p[1][1] for p in plan.values() if len(p) > 1), sum(weights.values())
    assert end > 50_000
    for s, x in slots.items():
        share, done, t = weights[s] / total, 0, 0
        for at in [*x[x < end].tolist(), end]:
            assert share * at - done < 1 + 1e-6 and done - share * t < 1 + 1e-6  # before the block, and after the one before it
            done, t = done + 1, at + 1


def test_weights_of_nothing_come_last(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "t") for i in range(100)], "doc_id long, source string, text string")
    rows = op3.mixed(df, {"a": 1.0, "b": 0.0}, block=4).collect()
    assert len({r["position"] for r in rows}) == 100 and max(r["slot"] for r in rows if r["source"] == "a") < min(r["slot"] for r in rows if r["source"] == "b")


def test_mixing_places_every_row(spark):
    rows = [(i if i % 97 else None, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None, "t") for i in range(3000)] + [(5, "s5", "t")] * 3
    out = op3.mixed(spark.createDataFrame(rows, "doc_id long, source string, score string"), {"hot": 0.2}, block=8).collect()
    assert len(out) == len(rows) == len({r["position"] for r in out})
    last = Counter()
    for r in out:
        last[r["source"]] = max(last[r["source"]], r["block"])
    blocks = Counter()
    for r in {(r["source"], r["block"], r["slot"]) for r in out}:
        blocks[r[0]] += 1
    assert all(blocks[s] == last[s] + 1 for s in last)
    assert op3.mixed(spark.createDataFrame([], "doc_id long, source string")).count() == 0


TEXTS = ["", "plain", "<|im_end|>", "<\\|x|> <\\\\|", "a|b<|", "<", "<\\", "line\nline", "é😀", op8.TRICK, "\\n \\"]


def test_escapes_are_reversible():
    for t in TEXTS:
        assert op8.unescape(op8.escape(t)) == t and "<|" not in op8.escape(t)
        assert op8.unescape_role(op8.escape_role(t)) == t and "\n" not in op8.escape_role(t)


def test_conversations_are_read_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", x, "extra") for c in (1, 2, None) for t, x in enumerate(TEXTS)] + [(3, None, None, None, "e"), (3, 1, "assistant", "b", "e"), (3, 1, "assistant", "b", "e"), (3, 1, "assistant", "a", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in op8.formatted(df, typed=False).collect()}
    assert [x[1] for x in op8.read_back(got[1]["formatted"])] == TEXTS
    learnt = [op8.unescape(got[2]["formatted"][x["start"] : x["stop"]]) for x in got[2]["loss"]]
    assert learnt == [x for t, x in enumerate(TEXTS) if t % 2]
    assert op8.read_back(got[3]["formatted"]) == [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert op8.formatted(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "look <|x|>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "audio", "ref": "b.wav", "seconds": 0.1}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "text", "text": "end"}]
    df = spark.createDataFrame([(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", "[not parts]")], "conv_id long, turn long, role string, text string")
    (r,) = op8.formatted(df).collect()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 3), ("document", "c.pdf", 512)]
    for a in r["attachments"]:
        assert r["formatted"].startswith(f"<|{a['kind']}|>" * a["tokens"], a["place"])
    assert r["tokens"] == 4 + 3 + 512 + len("look <|x|>") + 1 + len("end") + len("[not parts]")


ODD = ['[{"type": "text", "text": 5}]', '[{"type": "image", "width": "wide"}]', '[{"type": "image", "width": 1e300}]', '[{"type": "audio", "seconds": -1}]', '[{"type": "audio", "ref": {}}]', '[{"type": ["text"]}]', '[1, 2]', "[", "[]", '[{"type": "document", "pages": true}]', "[" * 5000]


@pytest.mark.parametrize("kind", ["string", "int", "long", "decimal(5,0)", "double"])
def test_malformed_parts_are_texts(spark, kind):
    df = spark.createDataFrame([(c, 0, "user", t) for c, t in enumerate(ODD)] + [(99, 0, "user", "x" * 3_000_000)], "conv_id int, turn long, role string, text string")
    got = {int(r["conv_id"]): r for r in op8.formatted(df.withColumn("conv_id", df["conv_id"].cast(kind))).collect()}
    assert [op8.read_back(got[c]["formatted"]) for c in range(len(ODD))] == [[("user", t)] for t in ODD]
    assert len(got[99]["formatted"]) > 3_000_000


#: Statements that are in no template, and their families; sentences that name no licence.
UNSEEN = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("Distributed under the terms of the MIT license.", ""),
    ("Licensed to you under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law", "Apache-2.0"),
    ("The library is released under the 3-clause BSD license, like its parent project.", "BSD"),
    ("You can redistribute this file and/or modify it under the terms of the\nGNU General Public License as published by the Free Software Foundation;\neither version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
    ("Text of this page is available under a Creative Commons Attribution 4.0 International License unless noted.", "CC-BY"),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("Copyright (c) 2019 The Authors. All rights reserved.", "proprietary"),
    ("The council issued a licence for the market in the public square.", ""),
    ("General permission to enter the building is not granted to the public.", ""),
    ("Der Kurs beginnt mit einer Pause und endet mit einem Test.", ""),
    ("The version of the software that we used is free of known errors.", ""),
]


def test_licences_of_texts_that_are_no_templates(spark):
    docs = spark.createDataFrame([(i, "Some words first.\n\n" + t + "\n\nAnd more words after it.") for i, (t, _) in enumerate(UNSEEN)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in op9.licences(docs).collect()}
    right = [got[i] == f for i, (_, f) in enumerate(UNSEEN)]
    assert sum(right) >= 11, [(t, got[i]) for i, (t, f) in enumerate(UNSEEN) if got[i] != f]


def test_every_paragraph_of_a_template_has_an_anchor():
    rng, rare = random.Random(9), set(op9.anchors())
    for t in (t for ts in op9.TEMPLATES.values() for t in ts):
        own = sorted(set(op9.words_of(t)))
        for _ in range(300):
            assert rare & set(rng.sample(own, math.ceil(op9.HOLDS * len(own) - 1e-9)))


def test_licences(spark):
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "a\nReleased under the MIT License.\nb", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "her licence to drive was taken", 6: None, 7: "", 8: "All rights reserved.", 9: "nothing here", 10: "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."}
    docs = spark.createDataFrame([(i, t, "x") for i, t in lines.items()] + [(2, lines[2], "x"), (None, lines[1], "x")], "doc_id long, text string, family string")
    rows = op9.licences(docs).collect()
    got = {r["doc_id"]: r["licences"] for r in rows}
    assert len(rows) == 12
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "GPL-3.0", 4: "CC-BY-NC", 5: "", 6: "", 7: "", 8: "proprietary", 9: "", 10: "Apache-2.0,MIT", None: ""}
    assert op9.licences(docs.limit(0)).count() == 0


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_wrapped_licences(spark):
    texts = [(t, f) for f, t in WRAPPED.items()]
    texts += [("Some code.\n\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n *\n * More text.", f) for t, f in texts]
    texts += [(t.replace(" ", "\n"), f) for f, t in WRAPPED.items()]
    texts += [(WRAPPED["MIT"] + "\n\n" + WRAPPED["GPL-3.0"], "GPL-3.0,MIT"), (WRAPPED["BSD"] + "\nReleased under the MIT License.\nher licence to drive\nwas taken", "BSD,MIT")]
    texts += [("the driver lost her\nlicense and had to renew it\nat the office of the town", ""), (WRAPPED["MIT"].replace("\n", "\n\n"), "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op9.licences(docs).collect()}
    assert [got[i]["licences"] for i in range(len(texts))] == [f for _, f in texts]
    assert [got[i]["n_confirmed"] for i in range(6)] == [1] * 6 and got[9]["n_confirmed"] == got[10]["n_confirmed"] == 2
