"""The registered learners read every training row."""

import os

import pytest

from graticule.plans import queries as engine

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_learners_read_all_training_rows(spark, monkeypatch):
    want = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 5 <> 0").select("vec_id").collect()}
    assert max(want) >= 500
    learned, trained = set(), set()
    monkeypatch.setattr(engine.learn.StructuredLearner, "learn", lambda self, idx, label, features: learned.add(idx))
    monkeypatch.setattr(engine.learn, "predict_structured", lambda samples, *_: samples.selectExpr("idx", "0 as score"))
    monkeypatch.setattr(engine.DeepClassifier, "train", lambda self, df: trained.update(r.idx for r in df.select("idx").collect()) or [{"epoch": 0, "loss": 0.0, "accuracy": 0.0}])
    engine.online_structured(spark, SF)
    engine.deep_epochs(spark, SF)
    assert learned == trained == want
