"""Parts, merges and resumption, keyed by the source row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def shard(rows: DataFrame, world: int, index: str = "source_index") -> DataFrame:
    """Adds ``rank``: rows are dealt by their number modulo the ranks."""
    return rows.withColumn("rank", F.pmod(F.col(index), F.lit(world)).cast("int"))


def expected(start: int, end: int, rank: int, world: int) -> int:
    """Rows of [start, end) that a rank gets."""
    first = start + (rank - start) % world
    return max(0, -(-(end - first) // world))


def wrong_rank(parts: DataFrame, world: int, index: str = "source_index") -> DataFrame:
    """Rows that lie in another rank's part."""
    return parts.where(F.pmod(F.col(index), F.lit(world)) != F.col("rank"))


def merge(parts: list[DataFrame], index: str = "source_index", ordered: bool = False) -> DataFrame:
    """Union of parts with one row per index.  Equal repeats collapse; different ones, by value, fail.

    Least and greatest row of an index are compared as values, nulls and their
    places included, so their types must have an order (no maps).  ``ordered``
    deals rows to tasks by ranges of the index, so that a sort by it moves none.
    """
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    if ordered:
        rows = rows.repartitionByRange(index)
    values = [c for c in rows.columns if c != index]
    one = rows.select(index, F.struct(*values).alias("v")).groupBy(index).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    fail = F.raise_error(F.concat(F.lit("conflicting results for index "), F.col(index).cast("string"))).cast("boolean")
    return one.where(F.when(~F.col("lo").eqNullSafe(F.col("hi")), fail).otherwise(True)).select(index, *[F.col("lo").getField(c).alias(c) for c in values])


def conflicts(parts: list[DataFrame], index: str = "source_index") -> DataFrame:
    """Indices that come with different rows, and how many."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    values = [c for c in rows.columns if c != index]
    return rows.select(index, F.struct(*values).alias("v")).distinct().groupBy(index).agg(F.count("*").alias("variants")).where("variants > 1")


def pending(rows: DataFrame, *done: DataFrame, index: str = "source_index") -> DataFrame:
    """Rows whose index is in none of the finished tables."""
    keys = reduce(lambda a, b: a.union(b), [d.select(index) for d in done]).distinct()
    return rows.join(keys, index, "left_anti")


def combine(datasets: list[DataFrame]) -> DataFrame:
    """One training set from several."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def split(rows: DataFrame, size: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a seeded hash of the key: the same split on every run.

    ``size`` is the share of the validation rows if it is below 1, else their
    number; then those with the smallest hashes are found by a bounded top-k.
    Rows of one key stay together.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    if size < 1:
        return rows.where(draw >= size), rows.where(draw < size)
    drawn = F.struct(draw.alias("draw"), F.col(key).cast("string").alias("key"))
    edge = rows.select(drawn.alias("_at")).orderBy("_at").limit(int(size)).agg(F.max("_at").alias("_edge"))
    marked = rows.crossJoin(F.broadcast(edge))  # one row
    held = F.coalesce(drawn <= F.col("_edge"), F.lit(False))
    return marked.where(~held).drop("_edge"), marked.where(held).drop("_edge")


def first_rows(rows: DataFrame, n: int, index: str = "row_index") -> DataFrame:
    """The first n rows in source order, after scores are attached.

    The n-th smallest index is found by a bounded top-k; rows are then filtered by it.
    """
    edge = rows.select(index).orderBy(index).limit(n).agg(F.max(index).alias("_edge"))
    return rows.crossJoin(F.broadcast(edge)).where(F.col(index) <= F.col("_edge")).drop("_edge")
