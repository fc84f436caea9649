"""Golden bits, and the relational encoders against their numpy twins."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graticule.functions import encoders as E
from graticule.functions import geometry as G
from graticule.functions.similarity import NAMES, similarity, similarity_np
from graticule.operators import encode, transform
from graticule.sources.vectors import memory_samples

SHAPES = [(1, 64), (2, 2), (8, 8), (28, 28), (4, 16)]


def bits(event):
    value = int(event[0]) | int(event[1]) << 48
    return {k for k in range(96) if value >> k & 1}


def one(image, rows, columns, multiplier=1.0):
    return bits(E.encode_images(np.array([image]), rows, columns, multiplier)[0])


def stroke(rows, columns):
    image = np.zeros((28, 28), dtype=int)
    image[rows, columns] = 255
    return image.ravel()


TOP_LEFT, BOTTOM_RIGHT = stroke(4, slice(3, 11)), stroke(slice(3, 11), 23)
HORIZONTAL, VERTICAL = stroke(slice(12, 16), slice(5, 23)), stroke(slice(5, 23), slice(12, 16))


def test_grid():
    assert G.grid_shape(28, 28) == (10, 9)
    assert G.grid_cells(2, 2) == (0, 4, 45, 49)


@pytest.mark.parametrize("multiplier", [1.0, 1.3])
def test_two_by_two(multiplier):
    assert one([255, 0, 0, 0], 2, 2, multiplier) == {0}
    assert one([0, 0, 0, 255], 2, 2, multiplier) == {49}
    assert one([0] * 4, 2, 2, multiplier) == set()


def test_full_image():
    assert one([255] * 4, 2, 2) == {0, 4, 45, 49}
    assert one([255] * 4, 2, 2, 1.3) == set()


def test_bars():
    assert one(HORIZONTAL, 28, 28, 1.3) == set(range(37, 44)) | set(range(46, 53))
    assert one(VERTICAL, 28, 28, 1.3) == {13, 21, 22, 30, 31, 39, 40, 48, 49, 57, 58, 66, 67}


def test_tiles_and_patches():
    moved = E.center(np.array([TOP_LEFT, BOTTOM_RIGHT]))
    tiles = E.encode_tiles(moved)
    assert [bits(t) for t in tiles[0]] == [{45, 46, 47, 93, 94, 95}, {40, 41, 88, 89}, set(), set()]
    assert [bits(t) for t in tiles[1]] == [set(), {32, 40, 80, 88}, set(), {0, 8, 48, 56}]
    lit = E.lit_patches(moved)
    assert {k: bits(p) for k, p in enumerate(lit[0]) if bits(p)} == {5: {45, 46, 47, 48}, 6: {42, 43, 44, 45}}
    assert {k: bits(p) for k, p in enumerate(lit[1]) if bits(p)} == {6: {21, 28, 35, 42}, 10: {0, 7, 14, 21}}


def test_shift_truncates_toward_zero(spark):
    df = memory_samples(spark, [TOP_LEFT.tolist(), BOTTOM_RIGHT.tolist(), [0] * 784], [1, 2, 3], 28, 28)
    rows = transform.centering_shift(df, dx=1).orderBy("idx").collect()
    assert [(r.down, r.across) for r in rows] == [(9, 8), (7, -8), (0, 0)]


@pytest.mark.parametrize("image, rows, columns, multiplier", [([1], 2, 2, 1.0), ([1] * 4, 2, 2, 0.0), ([1] * 4, 2, 2, float("nan")), ([1] * 4, 2, 2, float("inf"))])
def test_malformed_is_rejected(image, rows, columns, multiplier):
    with pytest.raises(ValueError):
        E.encode_images(np.array([image]), rows, columns, multiplier)


def test_detector_bank():
    assert len(G.detector_bank()) == 36
    assert bin(G.pattern(5)).count("1") == 22
    assert [len({b for d, _, b in G.detector_bank() if d == k}) for k in range(6)] == [5, 5, 3, 3, 5, 5]


@pytest.mark.parametrize("rows, columns", SHAPES)
def test_relational_equals_numpy(spark, rows, columns):
    rng = np.random.default_rng(rows * 100 + columns)
    images = rng.integers(0, 256, (12, rows * columns)) * (rng.random((12, rows * columns)) < 0.5)
    df = memory_samples(spark, images.tolist(), [0] * 12, rows, columns)
    for multiplier in (1.0, 1.3):
        want = [tuple(map(int, e)) for e in E.encode_images(images, rows, columns, multiplier)]
        for run in (encode.encode_images, encode.encode_images_batch):
            got = [(r.event.lo, r.event.hi) for r in run(df, rows, columns, multiplier).orderBy("idx").collect()]
            assert got == want


def test_relational_features_equal_numpy(spark):
    rng = np.random.default_rng(3)
    images = np.concatenate([rng.integers(0, 256, (4, 784)) * (rng.random((4, 784)) < 0.2), [TOP_LEFT, BOTTOM_RIGHT, np.zeros(784, dtype=int)]])
    df = memory_samples(spark, images.tolist(), [0] * len(images), 28, 28)
    want = E.encode_features(images).tolist()
    for run in (encode.encode_features, encode.encode_features_batch):
        got = [[[e.lo, e.hi] for e in r.features] for r in run(df).orderBy("idx").collect()]
        assert got == want


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 27), st.integers(0, 27)), max_size=20), st.integers(-1, 1), st.integers(-1, 1))
def test_centering_keeps_ink_inside(points, dx, dy):
    image = np.zeros((1, 784), dtype=int)
    for r, c in points:
        image[0, r * 28 + c] = 200
    out = E.center(image, dx, dy)
    assert out.shape == image.shape and out.sum() <= image.sum()
    if dx == dy == 0:
        assert out.sum() == image.sum()


def test_border_ink_is_clipped_by_extra_shift():
    image = np.zeros((1, 784), dtype=int)
    image[0, ::28] = 255  # a full column
    assert E.center(image, 0, 1).sum() == 27 * 255


@pytest.mark.parametrize("kind", NAMES)
def test_similarity_columns_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    pairs = [tuple(int(x) for x in rng.integers(0, 1 << 48, 4)) for _ in range(20)] + [(0, 0, 0, 0), (0, 0, 5, 1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long, c long, d long")
    got = [r.s for r in df.select("i", similarity(F.col("a"), F.col("b"), F.col("c"), F.col("d"), kind).alias("s")).orderBy("i").collect()]
    a = np.array(pairs)
    want = similarity_np(a[:, :2], a[:, 2:], kind)
    assert np.allclose(got, want) and np.allclose(want, similarity_np(a[:, 2:], a[:, :2], kind))
    assert ((want >= 0) & (want <= 1)).all() and want[-2] == 0
