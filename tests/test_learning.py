import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import evaluate, learn, match
from graticule.operators.transform import augmentation
from graticule.operators.deep import DeepClassifier, TrainingConfig, neuron_count, parameter_count
from graticule.schemas import Split, find_split
from graticule.sources.vectors import memory_samples
from test_encoders import BOTTOM_RIGHT, HORIZONTAL, TOP_LEFT, VERTICAL

DIGITS = find_split("digits")


@pytest.mark.parametrize("split, labels", [(DIGITS, [1, 7]), (find_split("letters"), [1, 26])])
def test_learns_what_it_saw(spark, split, labels):
    df = memory_samples(spark, [[255, 0, 0, 0], [0, 0, 0, 255]], labels, 2, 2)
    protos = learn.train_baseline(df, 2, 2, split)
    r = learn.evaluate_baseline(df, protos, 2, 2, split).first()
    assert (r.correct, r.total, r.accuracy) == (2, 2, 1.0)


def test_structured_learns_strokes(spark):
    images = [TOP_LEFT.tolist(), BOTTOM_RIGHT.tolist()] * 20
    df = memory_samples(spark, images, [1, 26] * 20, 28, 28)
    split = find_split("letters")
    learner = learn.StructuredLearner(split).train(df)
    r = evaluate.evaluation(learn.predict_structured(df, learner.prototypes(spark), split)).first()
    assert (r.correct, r.total) == (40, 40)
    assert learner.assigned.sum() == 40 and (learner.assigned[0] > 0).all()


def test_deep_learns_bars(spark):
    df = memory_samples(spark, [HORIZONTAL.tolist(), VERTICAL.tolist()] * 20, [0, 1] * 20, 28, 28)
    model = DeepClassifier(Split("binary", 2), TrainingConfig(3, 8, 4, 0.003, 7, False))
    assert (model.parameters, model.neurons) == (4130, 2330)
    assert len(model.train(df)) == 3
    assert model.evaluate(df)["accuracy"] >= 0.95


def test_deep_sizes():
    assert [parameter_count(c) for c in (2, 10, 26, 47)] == [4130, 8938, 18554, 31175]
    assert [neuron_count(c) for c in (2, 10)] == [2330, 2338]


def test_deep_gradients_are_averaged_over_parts(spark):
    df = memory_samples(spark, [HORIZONTAL.tolist(), VERTICAL.tolist()] * 20, [0, 1] * 20, 28, 28)
    model = DeepClassifier(Split("binary", 2), TrainingConfig(4, 8, 4, 0.003, 7, True), parts=2)
    assert [e["epoch"] for e in model.train(df)] == [1, 2, 3, 4]
    assert model.evaluate(df)["accuracy"] >= 0.9


def test_ties_go_to_the_lowest_class(spark):
    scores = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.5), (1, 4, float("nan")), (1, 7, 0.1), (2, 5, float("nan"))], "idx long, label int, score double")
    assert {r.idx: r.predicted for r in match.top_class(scores).collect()} == {0: 1, 1: 7, 2: 0}


def test_memory_rules():
    m = learn.Memory(capacity=2, novelty=0.5)
    a, b, c = (np.array(e) for e in ((1, 0), (2, 0), (4, 0)))
    m.reinforce(a, -0.5)
    assert not len(m.events)
    for e in (a, b, c):
        m.reinforce(e, 1.0)
    assert m.events.tolist() == [[2, 0], [4, 0]]
    m.reinforce(c, -0.5)
    assert m.weights[1] == pytest.approx(1 - 0.35 * 0.5) and m.evaluate(c) == m.weights[1]
    m.remember(a)
    assert len(m.events) == 2


@pytest.mark.parametrize("novelty, rate", [(-0.1, 0.1), (1.1, 0.1), (float("nan"), 0.1), (0.5, 0.0), (0.5, float("inf"))])
def test_parameters_are_checked(novelty, rate):
    with pytest.raises(ValueError):
        learn.check_parameters(novelty, rate)


def test_label_outside_split(spark):
    df = memory_samples(spark, [[1, 2, 3, 4]], [0], 2, 2)
    with pytest.raises(Exception):
        learn.train_baseline(df, 2, 2, find_split("letters")).collect()


def test_match_batches_equals_match(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 1 << 48, (30, 2)))]
    events = spark.createDataFrame(rows, "idx long, lo long, hi long")
    protos = spark.createDataFrame([(k % 3, int(a), int(b), 1.0) for k, (a, b) in enumerate(rng.integers(0, 1 << 48, (9, 2)))], "label int, lo long, hi long, weight float")
    want = {r.idx: r.predicted for r in match.match(events, protos).collect()}
    batched = match.match_batches(events.selectExpr("idx", "struct(lo, hi) as event"), protos)
    assert {r.idx: r.predicted for r in batched.collect()} == want


def test_evaluation_of_nothing_and_gate(spark):
    empty = spark.createDataFrame([], "actual int, predicted int")
    assert tuple(evaluate.evaluation(empty).first()) == (0, 0, 0.0)
    assert evaluate.floor_of(0.85) > 0.85
    df = spark.createDataFrame([(0.85,), (0.851,)], "a double")
    assert [r[0] for r in df.select(evaluate.passes(df.a, 0.85)).collect()] == [False, True]
    assert evaluate.full_confusion(empty).count() == 100


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([(1, 2, 34)], "actual int, predicted int, n long")
    lines = evaluate.confusion_text(counts).splitlines()
    assert lines[1].startswith("confusion matrix") and lines[4].split() == ["1", "0", "0", "34"] + ["0"] * 7
    assert evaluate.csv_line(DIGITS, 10, 5, 1.23456, 0.5, 4, 0.8) == "digits,10,10,5,1.235,0.500,4,80.00"
    assert evaluate.epoch_line(1, 0.123456, 0.5, 2.0) == "epoch=1 loss=0.12346 train_accuracy=50.00% seconds=2.000"
    runs = spark.createDataFrame([("digits", 10, 1000, 5, 1234.5, 0.5, 4, 80.0)], "split string, classes int, train_samples long, test_samples long, train_seconds double, test_seconds double, correct long, accuracy_percent double")
    evaluate.write_report(runs, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().train_seconds == "1234.500"


def payload(lo, hi):
    return frozenset([k for k in range(48) if lo >> k & 1] + [48 + k for k in range(48) if hi >> k & 1])


class PlainMemory:
    """The stated rules on sets and lists, one step at a time."""

    def __init__(self, capacity, novelty=0.78, rate=0.35):
        self.capacity, self.novelty, self.rate, self.kept = capacity, novelty, rate, []

    def like(self, event):
        return [len(event & e) / max(1, len(event | e)) for e, _ in self.kept]

    def score(self, event):
        return max((s * w for s, (_, w) in zip(self.like(event), self.kept)), default=0.0)

    def reinforce(self, event, reward):
        like = self.like(event)
        if not like or max(like) < self.novelty:
            if reward > 0:
                self.kept = (self.kept + [[event, 1.0]])[-self.capacity :]
            return
        best = like.index(max(like))
        self.kept[best][1] = min(1.0, max(0.0, self.kept[best][1] + self.rate * reward))

    def remember(self, event):
        if len(self.kept) < self.capacity:
            self.kept.append([event, 1.0])


def drawn(n, seed=3):
    rng = np.random.default_rng(seed)
    shapes = rng.integers(0, 256, (6, 8, 8))
    shapes[shapes < 150] = 0
    images = [np.where(rng.random((8, 8)) < 0.15, rng.integers(0, 256, (8, 8)), shapes[i % 6]).ravel().tolist() for i in range(n)]
    return images, [int(x) for x in rng.integers(0, 3, n)]


@pytest.mark.parametrize("capacity, epochs", [(256, 1), (5, 2)])
def test_baseline_equals_a_plain_fold(spark, capacity, epochs):
    from graticule.operators.encode import encode_images_batch

    images, labels = drawn(90)
    df = memory_samples(spark, images, labels, 8, 8)
    memories = {}
    for _ in range(epochs):
        for r in encode_images_batch(df, 8, 8, 1.3).orderBy("idx").select("label", "event.lo", "event.hi").collect():
            memories.setdefault(r.label, PlainMemory(capacity)).reinforce(payload(r.lo, r.hi), 1.0)
    got = {}
    for r in learn.train_baseline(df, 8, 8, DIGITS, epochs=epochs, capacity=capacity).orderBy("label", "slot").collect():
        got.setdefault(r.label, []).append((payload(r.lo, r.hi), round(r.weight, 5)))
    assert got == {label: [(e, round(w, 5)) for e, w in m.kept] for label, m in memories.items()}


def test_structured_equals_a_plain_fold(spark, monkeypatch):
    """Banks of three fill up, so every branch of the choice of an expert is met."""
    from graticule.operators.encode import encode_features_batch
    from graticule.sources.vectors import enlarge

    monkeypatch.setattr(learn, "BANK", 3)
    split = Split("three", 3)
    images, labels = drawn(80, 8)
    df = enlarge(memory_samples(spark, images, labels, 8, 8), 8, 8)
    learner = learn.StructuredLearner(split).train(df)
    banks = [[[PlainMemory(3) for _ in range(5)] for _ in range(4)] for _ in range(3)]
    taken = [[0] * 4 for _ in range(3)]

    def score(label, expert, event):
        total = np.float32(0)
        for c, weight in enumerate((1, 1, 1, 1, 0.5)):
            total = np.float32(total + np.float32(weight) * np.float32(banks[label][expert][c].score(event[c])))
        return np.float32(total / np.float32(4.5))

    for r in encode_features_batch(df, *augmentation(F.col("idx"), 0)).orderBy("idx").select("idx", "label", "features").collect():
        event = [payload(e.lo, e.hi) for e in r.features]
        idle = [e for e in range(4) if not taken[r.label][e]]
        room = [e for e in range(4) if len(banks[r.label][e][0].kept) < 3] or [0, 1, 2, 3]
        expert = idle[0] if idle else sorted(room, key=lambda e: (-score(r.label, e, event), e))[0]
        for c in range(5):
            banks[r.label][expert][c].remember(event[c])
        taken[r.label][expert] += 1
        if r.idx % 16 == 0:
            best = sorted(((x, e) for x in range(3) for e in range(4)), key=lambda p: (-score(*p, event), *p))[0]
            if best[0] != r.label:
                for c in range(5):
                    banks[best[0]][best[1]][c].reinforce(event[c], -0.5)
    assert learner.assigned.tolist() == taken
    got = {}
    for r in learner.prototypes(spark).collect():
        got.setdefault((r.label, r.expert, r.channel), {})[r.slot] = (payload(r.lo, r.hi), round(r.weight, 5))
    want = {(x, e, c): {k: (ev, round(w, 5)) for k, (ev, w) in enumerate(banks[x][e][c].kept)} for x in range(3) for e in range(4) for c in range(5) if banks[x][e][c].kept}
    assert got == want
