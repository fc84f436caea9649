"""Projections and predicates on samples: label ranges, ink boxes, centring, augmentation, limits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.geometry import AUGMENT, INK
from ..schemas import Split


def class_index(label: Column, split: Split) -> Column:
    """label - offset; raises where that is no class of the split."""
    at = label.cast("int") - split.offset
    return F.when((at >= 0) & (at < split.classes), at).otherwise(F.raise_error(F.concat(F.lit(f"label outside split {split.name}: "), label.cast("string"))))


def public_label(index: Column, split: Split) -> Column:
    return (index + split.offset).cast("int")


def check_labels(samples: DataFrame, split: Split) -> DataFrame:
    """``samples`` whose reading fails at a label outside the split."""
    return samples.withColumn("label", public_label(class_index(F.col("label"), split), split))


def check_pixels(samples: DataFrame) -> DataFrame:
    """``samples`` whose reading fails at an image with other than rows * columns pixels."""
    fits = (F.col("rows") > 0) & (F.col("columns") > 0) & (F.size("pixels") == F.col("rows") * F.col("columns"))
    return samples.withColumn("pixels", F.when(fits, F.col("pixels")).otherwise(F.raise_error(F.lit("image dimensions do not match its pixel data"))))


def first_rows(samples: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order; 0 for all. A predicate on idx, which sources can prune by."""
    return samples.where(F.col("idx") < n) if n else samples


def every_nth(samples: DataFrame, n: int = 16) -> DataFrame:
    """The rows at which hard negatives are tried."""
    return samples.where(F.col("idx") % n == 0)


def explode_pixels(samples: DataFrame) -> DataFrame:
    """idx, r, c, pixel of every pixel."""
    flat = samples.select("idx", "columns", F.posexplode("pixels").alias("at", "pixel"))
    return flat.select("idx", F.expr("cast(at div columns as int)").alias("r"), F.expr("cast(at % columns as int)").alias("c"), "pixel")


def ink_box(samples: DataFrame, ink: int = INK) -> DataFrame:
    """``samples`` with top, bottom, left, right of the pixels above ``ink``; nulls without any."""
    columns = F.col("columns")

    def box(at: Column) -> Column:
        rows = F.transform(at, lambda i: F.floor(i / columns).cast("int"))
        across = F.transform(at, lambda i: (i % columns).cast("int"))
        return F.struct(F.array_min(rows).alias("top"), F.array_max(rows).alias("bottom"), F.array_min(across).alias("left"), F.array_max(across).alias("right"))

    at = F.filter(F.transform("pixels", lambda p, i: F.when(p > ink, i)), lambda i: i.isNotNull())
    found = samples.withColumn("_box", let(at, box))
    return found.withColumns({k: F.col(f"_box.{k}") for k in ("top", "bottom", "left", "right")}).drop("_box")


def centering_shift(samples: DataFrame, ink: int = INK, dx: Column | int = 0, dy: Column | int = 0) -> DataFrame:
    """``samples`` with ``down`` and ``across``: what centres the ink's box, truncated toward zero, plus (dx, dy); 0 without ink."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    half = lambda size, a, b: F.expr(f"cast(({size} - 1 - {a} - {b}) div 2 as int)")
    boxed = ink_box(samples, ink)
    move = lambda middle, extra: F.when(F.col("top").isNull(), F.lit(0)).otherwise(middle + as_col(extra)).cast("int")
    return boxed.withColumns({"down": move(half("rows", "top", "bottom"), dy), "across": move(half("columns", "left", "right"), dx)})


def translate(samples: DataFrame, down: str = "down", across: str = "across") -> DataFrame:
    """``samples`` with every pixel moved; what leaves the frame is lost and 0 fills in."""
    size = F.struct("rows", "columns", F.col(down).alias("down"), F.col(across).alias("across"), "pixels")

    def move(x: Column) -> Column:
        def pixel(i: Column) -> Column:
            r = F.floor(i / x["columns"]).cast("int") - x["down"]
            c = (i % x["columns"]).cast("int") - x["across"]
            inside = (r >= 0) & (r < x["rows"]) & (c >= 0) & (c < x["columns"])
            return F.when(inside, F.get(x["pixels"], r * x["columns"] + c)).otherwise(F.lit(0))

        return F.transform(F.sequence(F.lit(0), x["rows"] * x["columns"] - 1), pixel)

    return samples.withColumn("pixels", let(size, move))


def center(samples: DataFrame, ink: int = INK, dx: Column | int = 0, dy: Column | int = 0) -> DataFrame:
    """``samples`` with the ink's box centred, then moved by (dx, dy)."""
    return translate(centering_shift(samples, ink, dx, dy)).select(*samples.columns)


def augmentation(idx: Column, epoch: Column | int) -> tuple[Column, Column]:
    """(dx, dy) of a row in an epoch: five moves in turn."""
    turn = ((idx + epoch) % len(AUGMENT)).cast("int")
    pick = lambda axis: F.get(F.array(*[F.lit(m[axis]) for m in AUGMENT]), turn)
    return pick(0), pick(1)
