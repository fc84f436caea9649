"""Command lines of the three experiments: ``digits``, ``battery`` and ``deep``.

Options are taken in order, the last of equals counts, ``--help`` ends at once, and any fault ends with status 1.
"""

from __future__ import annotations

import math
import sys
import time

from .operators import evaluate as V
from .operators.deep import DeepClassifier, TrainingConfig
from .operators.learn import StructuredLearner, predict_baseline, predict_structured, train_baseline
from .schemas import PAYLOAD, SPLITS, Split, find_split
from .sources.idx import load_digits, load_split

CAPACITY = 256


def _size(least: int):
    def parse(text: str, option: str) -> int:
        if not (text.isascii() and text.isdigit()) or int(text) < least:
            raise ValueError(f"invalid value for {option}")
        return int(text)

    return parse


def _float(most: float = math.inf):
    def parse(text: str, option: str) -> float:
        try:
            value = float(text) if text == text.strip() and "_" not in text else math.nan
        except ValueError:
            value = math.nan
        if not math.isfinite(value) or not 0 < value <= most:
            raise ValueError(f"invalid value for {option}")
        return value

    return parse


def _text(text: str, option: str) -> str:
    return text


def parse_splits(text: str, option: str = "--splits") -> list[Split]:
    """A comma-separated list; a trailing comma is accepted, an empty name elsewhere is not, and "" names none."""
    parts = text.split(",")
    if parts and parts[-1] == "":
        parts.pop()
    return [find_split(p) for p in parts]


def _architecture(text: str, option: str) -> str:
    if text not in ("structured", "baseline"):
        raise ValueError(f"invalid value for {option}")
    return text


_COMMON = {"--data-dir": (_text, "data"), "--train-limit": (_size(0), 0), "--test-limit": (_size(0), 0), "--minimum-accuracy": (_float(1.0), 0.0)}
_LEARNER = {"--epochs": (_size(1), 1), "--threshold": (_float(), 1.30), "--novelty": (_float(1.0), 0.78), "--learning-rate": (_float(), 0.35)}
OPTIONS = {
    "digits": _COMMON | _LEARNER,
    "battery": _COMMON | _LEARNER | {"--splits": (parse_splits, list(SPLITS)), "--architecture": (_architecture, "structured")},
    "deep": _COMMON | {"--split": (lambda t, o: find_split(t), find_split("mnist")), "--epochs": (_size(1), 5), "--batch-size": (_size(1), 64), "--time-steps": (_size(1), 8), "--learning-rate": (_float(), 0.001), "--no-augment": (None, False)},
}


class Help(Exception):
    """--help was given."""


def parse_options(program: str, args: list[str]) -> dict:
    known = OPTIONS[program]
    found = {name.lstrip("-").replace("-", "_"): default for name, (_, default) in known.items()}
    rest = iter(args)
    for option in rest:
        if option == "--help":
            raise Help
        if option in known and known[option][0] is None:
            found[option.lstrip("-").replace("-", "_")] = True
            continue
        value = next(rest, None)
        if value is None:
            raise ValueError(f"missing value for {option}")
        if option not in known:
            raise ValueError(f"unknown option: {option}")
        found[option.lstrip("-").replace("-", "_")] = known[option][0](value, option)
    return found


def usage(program: str) -> str:
    return "\n".join([f"Usage: graticule {program} [options]", *(f"  {name}" for name in OPTIONS[program]), "  --help"]) + "\n"


def _gate(accuracy: float, floor: float, what: str = "") -> bool:
    if accuracy < V.floor_of(floor):
        print(f"{what}accuracy {accuracy:g} is below required minimum {floor:g}", file=sys.stderr)
        return False
    return True


def run_digits(spark, o: dict) -> int:
    train, test = load_digits(spark, o["data_dir"], True, o["train_limit"]), load_digits(spark, o["data_dir"], False, o["test_limit"])
    rows, columns = train.select("rows", "columns").first()
    split = Split("digits", 10)
    print(f"training samples: {train.count()}\ntest samples: {test.count()}\nspike event bits: {PAYLOAD + 32}\npayload bits: {PAYLOAD}\nprototype capacity/class: {CAPACITY}\nnovelty threshold: {o['novelty']:g}\nlearning rate: {o['learning_rate']:g}")
    protos = train_baseline(train, rows, columns, split, o["threshold"], o["novelty"], o["learning_rate"], o["epochs"], CAPACITY).cache()
    preds = predict_baseline(test, protos, rows, columns, split, o["threshold"]).cache()
    r = V.evaluation(preds).first()
    print(f"\ncorrect: {r.correct}/{r.total}\naccuracy: {r.accuracy * 100:.2f}%")
    print(V.confusion_text(V.confusion(preds)), end="")
    return 0 if _gate(r.accuracy, o["minimum_accuracy"]) else 1


def run_battery(spark, o: dict) -> int:
    print(f"architecture={o['architecture']} event_bits={PAYLOAD + 32} payload_bits={PAYLOAD} queue_depth={CAPACITY} threshold={o['threshold']:g} novelty={o['novelty']:g} learning_rate={o['learning_rate']:g} epochs={o['epochs']}\n\n{V.CSV_HEADER}")
    for split in o["splits"]:
        train, test = load_split(spark, o["data_dir"], split, True, o["train_limit"]), load_split(spark, o["data_dir"], split, False, o["test_limit"])
        n_train, n_test, t0 = train.count(), test.count(), time.perf_counter()
        if o["architecture"] == "structured":
            protos = StructuredLearner(split, o["novelty"], o["learning_rate"]).train(train, o["epochs"]).prototypes(spark)
            t1 = time.perf_counter()
            preds = predict_structured(test, protos, split)
        else:
            rows, columns = train.select("rows", "columns").first()
            protos = train_baseline(train, rows, columns, split, o["threshold"], o["novelty"], o["learning_rate"], o["epochs"], CAPACITY).cache()
            protos.count()
            t1 = time.perf_counter()
            preds = predict_baseline(test, protos, rows, columns, split, o["threshold"])
        r = V.evaluation(preds).first()
        print(V.csv_line(split, n_train, n_test, t1 - t0, time.perf_counter() - t1, r.correct, r.accuracy), flush=True)
        if not _gate(r.accuracy, o["minimum_accuracy"], f"{split.name} "):
            return 1
    return 0


def run_deep(spark, o: dict) -> int:
    split = o["split"]
    train, test = load_split(spark, o["data_dir"], split, True, o["train_limit"]), load_split(spark, o["data_dir"], split, False, o["test_limit"])
    config = TrainingConfig(o["epochs"], o["batch_size"], o["time_steps"], o["learning_rate"], augment=not o["no_augment"])
    model, t0 = DeepClassifier(split, config), time.perf_counter()
    epochs = model.train(train)
    t1 = time.perf_counter()
    result = model.evaluate(test)
    print(V.deep_report(split, train.count(), result["total"], config.time_steps, model.parameters, model.neurons, epochs, result, t1 - t0, time.perf_counter() - t1), end="")
    return 0 if _gate(result["accuracy"], o["minimum_accuracy"]) else 1


RUNS = {"digits": run_digits, "battery": run_battery, "deep": run_deep}


def main(args: list[str] | None = None, spark=None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    program = args[0] if args else ""
    try:
        if program not in RUNS:
            raise ValueError(f"first argument must be one of {', '.join(RUNS)}")
        options = parse_options(program, args[1:])
        if spark is None:
            from .session import local_session

            spark = local_session()
        return RUNS[program](spark, options)
    except Help:
        print(usage(program), end="")
        return 0
    except Exception as error:  # noqa: BLE001  every fault is a message and status 1
        print(f"{program}: {str(error).splitlines()[0] if str(error) else error!r}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
