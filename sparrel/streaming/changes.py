"""Streams: windowed aggregation with late data, and applying change rows to a table by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, width: str, delay: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by tumbling windows; rows later than ``delay`` are dropped once their window is closed."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by sessions: rows of a key with no gap as long as ``gap``."""
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def latest(batch: DataFrame, keys: list[str], order: tuple[str, ...] | list[str]) -> DataFrame:
    """The last change of each key, in order of ``order`` and then of all columns; changes with a NULL key stay all."""
    held = F.max(F.struct(*order, *(c for c in batch.columns if c not in order)))
    known = [F.col(k).isNotNull() for k in keys]
    bound = known[0]
    for k in known[1:]:
        bound = bound & k
    last = batch.filter(bound).groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(held.alias("__last")).select("__last.*").select(batch.columns)
    return last.unionByName(batch.filter(~bound))


def apply_changes(path: str, keys: list[str], updates: list[str], order: tuple[str, ...] | list[str] = (), compact_every: int = 20):
    """For foreachBatch: a batch's last change of each key replaces the row with that key. The state is read by ``current``.

    A batch is written as a folder of its own, so a batch costs its own size. Every
    ``compact_every`` batches the table is written anew. A batch that runs again writes
    the same folder again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c in (*keys, *updates)]
        latest(batch, keys, order).select(columns).withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/b{number}")
        if number and number % compact_every == 0:
            now = current(spark, path, keys, number, compact_every).withColumn("__batch", F.lit(number).cast("long"))
            now.write.mode("overwrite").parquet(f"{path}/v{number}")

    return run


def current(spark: SparkSession, path: str, keys: list[str], number: int, compact_every: int = 20) -> DataFrame:
    """The table after batch ``number``: the last whole version and the batches after it, the last row of each key."""
    base = (number - 1) // compact_every * compact_every if number else 0
    folders = [f"{path}/v{base}"] if base else []
    folders += [f"{path}/b{k}" for k in range(base + 1 if base else 0, number + 1)]
    return latest(spark.read.parquet(*folders), keys, ["__batch"]).drop("__batch")


def publish(changes: DataFrame, row_filter: Column | None = None, columns: list[str] | None = None, operations: tuple[str, ...] = ("INSERT", "UPDATE", "DELETE")) -> DataFrame:
    """What a publication sends of changes (op, old struct, new struct): rows that pass its filter, columns of its list.

    ``row_filter`` is over r.*. An update of which only the old row passes is sent as a
    DELETE, one of which only the new row passes as an INSERT.
    """
    held = changes.filter(F.col("op").isin(*operations))
    if row_filter is not None:
        passes = lambda side: F.col(f"__{side}") & F.col(side).isNotNull()
        for side in ("old", "new"):
            held = held.withColumn("r", F.col(side)).withColumn(f"__{side}", F.coalesce(row_filter, F.lit(False)))
        before, after = passes("old"), passes("new")
        op = F.when(before & after, F.col("op")).when(before, F.lit("DELETE")).when(after, F.lit("INSERT"))
        held = held.select(op.alias("op"), F.when(before, F.col("old")).alias("old"), F.when(after, F.col("new")).alias("new")).filter("op IS NOT NULL")
    if columns is not None:
        narrow = lambda side: F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.{c}").alias(c) for c in columns)))
        held = held.select("op", narrow("old").alias("old"), narrow("new").alias("new"))
    return held
