"""Bounded, repeatable training samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the id is in the fold kept from training; a null id is not, and is not trained on either."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 3, part: int = 1, most_bytes: int = 32 << 20) -> list[tuple[str, int]]:
    """Whole texts of up to ``per_class`` rows of each value of ``label`` (0, 1), outside the held-out fold, as (text, label).

    The ids come first, in the order of a hash of the id; of these, in that order, each class takes the rows whose
    texts still fit into ``most_bytes``. So what reaches the driver is bounded, by rows and not within a text. Null
    labels and texts are left out; an id with several labels counts with its smallest, one with several texts with its least.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    ids: dict[int, int] = {}
    for y in (1, 0):
        for row in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            ids[row.doc_id] = y
    return [(t, y) for _, t, y in fitting_texts(docs, list(ids.items()), "int", most_bytes)]


def fitting_texts(docs: DataFrame, chosen: list[tuple], kind: str, most_bytes: int) -> list[tuple]:
    """(id, whole text, class) of the ``chosen`` (id, class), in that order, of each class those that still fit into ``most_bytes``."""
    spark = docs.sparkSession
    pick = spark.createDataFrame(chosen, f"doc_id bigint, y {kind}")
    with_text = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(pick), "doc_id")
    sizes = {r.doc_id: r.n for r in with_text.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    taken: dict = {}
    kept = []
    for doc_id, y in chosen:
        size = sizes.get(doc_id)
        if size is not None and taken.get(y, 0) + size <= most_bytes:
            taken[y] = taken.get(y, 0) + size
            kept.append((doc_id, y))
    fits = spark.createDataFrame(kept, f"doc_id bigint, y {kind}")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(fits), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.text, r.y) for r in rows)
