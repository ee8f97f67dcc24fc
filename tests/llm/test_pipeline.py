"""The pipeline against sequential stages, each on what the stage before it kept."""

import corpus_pipeline as cp
import pytest

from .test_cleaning import expected_op1, expected_op2, expected_op7

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_are_those_asked_for():
    assert [f.__name__ for _, f in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminated", "mixing"]


def test_columns(steps):
    for s in steps[1:-1]:
        assert s.columns == steps[0].columns


def test_quality_keeps_good_documents(spark, steps):
    kept = {i for i, _ in rows_of(steps[1])}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = [r["doc_id"] in kept for r in labels if r["quality"] == 1], [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)  # of 68 labels to learn from, 14 are bad


def test_one_of_each_group_stays(steps):
    rows = rows_of(steps[1])
    assert rows_of(steps[2]) == [(i, t) for i, t in rows if expected_op2(rows, 80)[i][2]]


def test_passages_go(steps):
    rows = rows_of(steps[2])
    want = expected_op7(rows, 20)
    assert rows_of(steps[3]) == [(i, want[i][2] if want[i][1] else t) for i, t in rows if not want[i][1] or want[i][1] < want[i][0]]


def test_leaks_go(spark, steps):
    rows = rows_of(steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = expected_op1(rows, items)
    assert rows_of(steps[4]) == [(i, t) for i, t in rows if not hit[i][1]]


def test_all_that_is_left_is_mixed(spark, steps):
    assert rows_of(steps[5]) == rows_of(steps[4])
    assert len({r["position"] for r in steps[5].collect()}) == steps[4].count()
    assert rows_of(cp.run(spark, SF)) == rows_of(steps[5])
