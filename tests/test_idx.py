import struct

import pytest

from graticule.schemas import find_split
from graticule.sources.idx import IMAGES, LABELS, load_idx, load_split, write_idx


def pair(tmp_path, pixels, labels, rows=2, columns=2, stem="x"):
    names = str(tmp_path / f"{stem}-images"), str(tmp_path / f"{stem}-labels")
    write_idx(*names, zip(pixels, labels), len(pixels), rows, columns)
    return names


def test_round_trip_and_limit(spark, tmp_path):
    names = pair(tmp_path, [[255, 0, 0, 0], [0, 0, 0, 255]], [1, 7])
    rows = load_idx(spark, *names).orderBy("idx").collect()
    assert [(r.idx, r.rows, r.columns, r.pixels, r.label) for r in rows] == [(0, 2, 2, [255, 0, 0, 0], 1), (1, 2, 2, [0, 0, 0, 255], 7)]
    assert load_idx(spark, *names, limit=1).count() == 1
    assert load_idx(spark, *names, limit=9).count() == 2


def test_many_partitions(spark, tmp_path):
    names = pair(tmp_path, [[i % 256] * 4 for i in range(50)], [i % 10 for i in range(50)])
    df = spark.read.format("idx").options(images=names[0], labels=names[1], target="28").load() if load_idx(spark, *names) else None
    assert df.rdd.getNumPartitions() == 8
    assert [r.pixels[0] for r in df.orderBy("idx").collect()] == [i % 256 for i in range(50)]


@pytest.mark.parametrize("images, labels", [
    (struct.pack(">I", 0), struct.pack(">2I", LABELS, 0)),
    (struct.pack(">4I", 7, 0, 2, 2), struct.pack(">2I", LABELS, 0)),
    (struct.pack(">4I", IMAGES, 0, 2, 2), struct.pack(">2I", 7, 0)),
    (struct.pack(">4I", IMAGES, 1, 2, 2) + bytes(4), struct.pack(">2I", LABELS, 2) + bytes(2)),
    (struct.pack(">4I", IMAGES, 0, 0, 2), struct.pack(">2I", LABELS, 0)),
    (struct.pack(">4I", IMAGES, 2, 2, 2) + bytes(7), struct.pack(">2I", LABELS, 2) + bytes(2)),
    (struct.pack(">4I", IMAGES, 2, 2, 2) + bytes(8), struct.pack(">2I", LABELS, 2) + bytes(1)),
    (struct.pack(">4I", IMAGES, 1, 2, 2) + bytes(4), struct.pack(">2I", LABELS, 1) + b"\x0a"),
])
def test_faults_are_raised(spark, tmp_path, images, labels):
    (tmp_path / "i").write_bytes(images)
    (tmp_path / "l").write_bytes(labels)
    with pytest.raises(Exception):
        load_idx(spark, str(tmp_path / "i"), str(tmp_path / "l")).collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(RuntimeError, match="could not open"):
        load_idx(spark, str(tmp_path / "none"), str(tmp_path / "none"))


def test_faults_beyond_the_limit_are_not_seen(spark, tmp_path):
    (tmp_path / "i").write_bytes(struct.pack(">4I", IMAGES, 2, 1, 1) + bytes(1))
    (tmp_path / "l").write_bytes(struct.pack(">2I", LABELS, 2) + b"\x03")
    assert load_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"), limit=1).first().label == 3


def test_split_labels(spark, tmp_path):
    for label, ok in ((1, True), (26, True), (0, False), (27, False)):
        stem = tmp_path / f"d{label}"
        stem.mkdir()
        write_idx(str(stem / "emnist-letters-train-images-idx3-ubyte"), str(stem / "emnist-letters-train-labels-idx1-ubyte"), [([1, 2, 3, 4], label)], 1, 2, 2)
        if ok:
            assert load_split(spark, str(stem), "letters", True).first().label == label
        else:
            with pytest.raises(Exception):
                load_split(spark, str(stem), "letters", True).collect()


def test_split_catalogue():
    assert find_split("balanced").classes == 47
    with pytest.raises(ValueError):
        find_split("not-a-split")


def test_records_must_be_as_the_headers_say(tmp_path):
    names = str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(ValueError, match="pixels"):
        write_idx(*names, [([1, 2, 3], 0)], 1, 2, 2)
    with pytest.raises(ValueError, match="headers"):
        write_idx(*names, [([1, 2, 3, 4], 0)], 2, 2, 2)
