"""A bounded sample of labelled texts, for classifiers that are fitted on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hashed_share, if_small, sample_fraction

#: Characters of a text that a classifier learns from at most; of a longer text, so many from a hashed place on.
CHARS_PER_TEXT = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 3000, chars_per_class: int = 20_000_000, fold: int = 0, folds: int = 5) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, labels (0 or 1) and weights of about ``rows_per_class`` labelled rows of each class, with about
    ``chars_per_class`` characters at most.

    Rows with crc32(id as text) mod ``folds`` = ``fold`` are held out, as are NULL ids
    and labels other than 0 and 1. Which rows are taken is decided by hashes of id and
    text, so the sample is the same in every run, and a long text has the chance of a
    short one. Rows that repeat id, label and text count once. A weight is the class's share of all
    labelled ids over its share of the sample. With no labelled row all three are empty.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc_mod("id", folds) != fold)).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = known.filter(hashed_share(F.col("id"), _share("y", sizes, rows_per_class), 11))
    length = F.length("text")
    place = F.pmod(F.xxhash64("text", F.lit(6)), F.greatest(length - CHARS_PER_TEXT, F.lit(1))) + 1
    text = F.when(length > CHARS_PER_TEXT, F.substring("text", place.cast("int"), F.lit(CHARS_PER_TEXT))).otherwise(F.col("text"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text IS NOT NULL").join(if_small(picks), "id").select("id", text.alias("text"), "y")
    # texts of a class may be longer, or their ids more often repeated, than the bounds allow
    most = {r["y"]: (r["n"], r["c"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()}
    over = {y: min(sample_fraction(n, 2 * rows_per_class), sample_fraction(c, chars_per_class)) for y, (n, c) in most.items()}
    if any(x < 1 for x in over.values()):
        share = F.lit(1.0)
        for y, x in over.items():
            share = F.when(F.col("y") == y, F.lit(x)).otherwise(share)
        rows = rows.filter(hashed_share(F.concat_ws("/", "id", F.xxhash64("text")), share, 12))
    got = rows.distinct().toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy().astype(np.float64)
    weights = np.ones(len(y))
    total = sum(sizes.values())
    for k, n in sizes.items():
        if (y == k).any():
            weights[y == k] = (n / total) / ((y == k).sum() / len(y))
    return got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), y, weights


def _share(column: str, sizes: dict[int, int], wanted: float):
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col(column) == y, F.lit(sample_fraction(n, wanted))).otherwise(share)
    return share
