"""Every stage of the pipeline on odd rows, on columns with clashing names, and on nothing."""

import os
from collections import Counter

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TWICE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, " \n", None, "s", 2),
    (900_004, TWICE, "en", None, 62), (900_004, TWICE, "en", None, 62), (900_005, TWICE, "de", "s", 62),
    (900_006, "lorem ipsum dolor " * 20_000 + "a@b.cd", "en", "s", 360_006),
]
EXTRA = ["1 as _row", "2 as _doc", "3 as score", "4 as _taken", "5 as spans", "6 as tokens"]


def odd(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.unionAll(spark.createDataFrame(ODD, docs.schema)).selectExpr("*", *EXTRA)


@needs_tables
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = odd(spark)
    given = Counter(r.doc_id for r in docs.collect())
    found = stage(spark, docs, SMALL)
    rows = found.collect()
    got = Counter(r.doc_id for r in rows)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert all((r["_row"], r["_doc"], r["score"], r["_taken"], r["spans"], r["tokens"]) == (1, 2, 3, 4, 5, 6) for r in rows)
    if name == "mixing":
        assert found.columns[len(docs.columns) :] == ["mix_epoch", "mix_tokens"]
        assert set(got) <= set(given) - {None, 900_001, 900_002, 900_003} and all(r.mix_tokens > 0 for r in rows)
        return
    assert len(found.columns) == len(docs.columns) and all(n <= given[i] for i, n in got.items())
    if name == "near_duplicates":
        assert [got[i] for i in (None, 900_001, 900_002, 900_003, 900_004, 900_005, 900_006)] == [1, 1, 1, 1, 1, 0, 1]
    if name in ("decontamination", "pii"):
        assert all(got[r[0]] == given[r[0]] for r in ODD)
    if name == "pii":
        texts = {r.doc_id: r.text for r in rows}
        assert texts[900_001] is None and texts[900_002] == "" and texts[900_006].endswith("dolor <EMAIL>")


@needs_tables
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_nothing(spark, name, stage):
    none = odd(spark).limit(0)
    found = stage(spark, none, SMALL)
    assert found.columns[: len(none.columns)] == none.columns and found.count() == 0
