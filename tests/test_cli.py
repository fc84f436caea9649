import pytest

from graticule import cli
from graticule.sources.idx import write_idx
from test_encoders import BOTTOM_RIGHT, TOP_LEFT


def test_defaults_and_last_wins():
    o = cli.parse_options("digits", ["--epochs", "2", "--epochs", "3"])
    assert (o["epochs"], o["threshold"], o["novelty"], o["learning_rate"], o["minimum_accuracy"]) == (3, 1.30, 0.78, 0.35, 0.0)
    deep = cli.parse_options("deep", ["--no-augment"])
    assert (deep["epochs"], deep["batch_size"], deep["time_steps"], deep["learning_rate"], deep["no_augment"], deep["split"].name) == (5, 64, 8, 0.001, True, "mnist")


@pytest.mark.parametrize("args", [["--epochs", "0"], ["--epochs", "-1"], ["--epochs", "1x"], ["--epochs"], ["--nothing", "1"], ["--minimum-accuracy", "0"], ["--minimum-accuracy", "1.1"], ["--novelty", "1.5"], ["--threshold", "0"], ["--threshold", "inf"], ["--learning-rate", "x"]])
def test_bad_options(args):
    with pytest.raises(ValueError):
        cli.parse_options("digits", args)
    assert cli.main(["digits", *args]) == 1


def test_split_lists():
    assert [s.name for s in cli.parse_splits("letters,mnist,")] == ["letters", "mnist"]
    assert cli.parse_splits("") == []
    for bad in (",letters", "letters,,mnist", "other"):
        with pytest.raises(ValueError):
            cli.parse_splits(bad)


def test_help(capsys):
    assert cli.main(["battery", "--help", "--nonsense"]) == 0
    assert "--architecture" in capsys.readouterr().out


def strokes(folder):
    images, labels = [TOP_LEFT.tolist(), BOTTOM_RIGHT.tolist()] * 8, [1, 5] * 8
    for part in ("train", "t10k"):
        write_idx(f"{folder}/{part}-images-idx3-ubyte", f"{folder}/{part}-labels-idx1-ubyte", zip(images, labels), len(images), 28, 28)
    for part in ("train", "test"):
        write_idx(f"{folder}/emnist-digits-{part}-images-idx3-ubyte", f"{folder}/emnist-digits-{part}-labels-idx1-ubyte", zip(images, labels), len(images), 28, 28)


def test_programs(spark, tmp_path, capsys):
    strokes(tmp_path)
    assert cli.main(["digits", "--data-dir", str(tmp_path), "--test-limit", "10"], spark) == 0
    out = capsys.readouterr().out
    assert "training samples: 16\ntest samples: 10\n" in out and "correct: 10/10\naccuracy: 100.00%" in out
    for architecture in ("structured", "baseline"):
        assert cli.main(["battery", "--data-dir", str(tmp_path), "--splits", "digits", "--architecture", architecture, "--minimum-accuracy", "0.9"], spark) == 0
        assert "digits,10,16,16," in capsys.readouterr().out
    assert cli.main(["deep", "--data-dir", str(tmp_path), "--split", "digits", "--epochs", "1", "--no-augment"], spark) == 0
    assert "parameters=8938" in capsys.readouterr().out
    assert cli.main(["battery", "--data-dir", str(tmp_path), "--splits", ""], spark) == 0


def test_gate_fails(spark, tmp_path):
    strokes(tmp_path)
    write_idx(f"{tmp_path}/t10k-images-idx3-ubyte", f"{tmp_path}/t10k-labels-idx1-ubyte", [(TOP_LEFT.tolist(), 5)], 1, 28, 28)
    assert cli.main(["digits", "--data-dir", str(tmp_path), "--minimum-accuracy", "0.5"], spark) == 1
    assert cli.main(["digits", "--data-dir", str(tmp_path / "none")], spark) == 1
