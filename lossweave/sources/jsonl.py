"""JSONL sources with the line number as an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCORE_COLUMNS = ("sample_id", "sequence_token_count", "response_token_count", "baseline_response_target_nll_sum", "token_scores")
SCORE_SCHEMA = "_source_index long, _score_method string, sample_id string, sequence_token_count int, response_token_count int, baseline_response_target_nll_sum double, token_scores array<double>"
#: What a score row's index and method are told by.
KEY_SCHEMA = "_source_index long, _score_method string, sample_id string"
ERROR_COLUMNS = ("source_index", "line_number", "sample_id", "error_type", "error")
ERROR_SCHEMA = "source_index long, line_number long, sample_id string, error_type string, error string"


def lines(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """(line_index, value) of all physical lines, files in the order given.

    Lines are numbered in two passes: each task counts its rows, the small table
    of counts gives every task's first number, and the rows are numbered where
    they are.  No row crosses the network.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    parts = []
    for k, path in enumerate(paths):
        one = reader.text(path).select(F.lit(k).alias("f"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
        parts.append(one)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    runs = rows.groupBy("f", "p", "b").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    # One row per input split: small, and bounded by the number of splits.
    runs = runs.withColumn("before", F.coalesce(F.expr("sum(n) over (order by f, p, b rows between unbounded preceding and 1 preceding)"), F.lit(0)))
    out = rows.join(F.broadcast(runs.select("f", "p", "b", "first", "before")), ["f", "p", "b"])
    return out.select((F.col("before") + F.col("m") - F.col("first")).alias("line_index"), "value")


def in_range(rows: DataFrame, start: int = 0, limit: int | None = None, rank: int = 0, world: int = 1, index: str = "line_index") -> DataFrame:
    """Lines start..start+limit that belong to a rank; filters on the number only, so it runs before any parsing."""
    out = rows.where(F.col(index) >= start)
    if limit is not None:
        out = out.where(F.col(index) < start + limit)
    return out if world == 1 else out.where(F.pmod(F.col(index), F.lit(world)) == rank)


def strict(rows: DataFrame) -> DataFrame:
    """Records of (line_index, value); the first bad line fails the query with its 1-based number."""
    from lossweave.operators.records import parse

    p = parse(rows)
    fail = F.raise_error(F.concat(F.lit("line "), (F.col("line_index") + 1).cast("string"), F.lit(": "), F.col("bad")))
    return p.withColumn("record", F.parse_json(F.when(F.col("bad").isNull(), F.col("value")).otherwise(fail.cast("string")))).drop("bad")


#: Lines that are put in order together when an order is checked.
BLOCK = 1_000_000


def _increasing(rows: DataFrame, keys: DataFrame, key: str, what: str) -> DataFrame:
    """rows, failing where ``key`` does not grow from line to line.

    ``keys`` are line_index and key of the same lines: only they are put in
    order, and rows stay where they are.  Lines are compared within blocks of
    ``BLOCK``; a block's first line is compared with the largest key of all
    blocks before, a table of one row per block.
    """
    keys = keys.withColumn("_block", F.floor(F.col("line_index") / BLOCK))
    w = Window.partitionBy("_block").orderBy("line_index")
    tops = keys.groupBy("_block").agg(F.max(key).alias("_top"))
    tops = tops.select("_block", F.expr("max(_top) over (order by _block rows between unbounded preceding and 1 preceding)").alias("_above"))
    marked = keys.join(F.broadcast(tops), "_block").withColumn("_before", F.coalesce(F.lag(key).over(w), "_above"))
    wrong = marked.where(F.col("_before") >= F.col(key)).agg(F.min("line_index").alias("_wrong"))
    fail = F.raise_error(F.concat(F.lit(f"{what}: index not increasing at line "), (F.col("_wrong") + 1).cast("string"))).cast("boolean")
    return rows.crossJoin(F.broadcast(wrong)).where(F.when(F.col("_wrong").isNotNull(), fail).otherwise(True)).select(*rows.columns)


def scores(spark: SparkSession, path: str, method: str | None = None, public: bool = True, strict: bool = False) -> DataFrame:
    """Score rows in file order: index column ``source_index``, increasing.

    A public file has no index column; it is then the decimal sample_id.  Blank
    lines are skipped; ``strict`` makes them errors and ends lines at \\n alone.
    """
    rows = lines(spark, path, "\n" if strict else None)
    if strict:
        blank = F.raise_error(F.concat(F.lit("blank score row at line "), (F.col("line_index") + 1).cast("string"))).cast("boolean")
        rows = rows.where(F.when(F.col("value").rlike("^\\s*$"), blank).otherwise(True))
    else:
        rows = rows.where(F.trim("value") != "")
    index = F.coalesce("_source_index", F.try_to_number("sample_id", F.lit("99999999999999999")).cast("long")) if public else F.col("_source_index")
    bad = F.when(index.isNull(), "no index")
    if method is not None:
        bad = F.coalesce(bad, F.when(~F.col("_score_method").eqNullSafe(method), "other score method"))
    fail = F.raise_error(F.concat(F.lit("score line "), (F.col("line_index") + 1).cast("string"), F.lit(": "), bad))
    read = lambda schema: rows.withColumn("s", F.from_json("value", schema)).select("line_index", "s.*").withColumn("source_index", F.when(bad.isNull(), index).otherwise(fail.cast("long")))
    return _increasing(read(SCORE_SCHEMA), read(KEY_SCHEMA).select("line_index", "source_index"), "source_index", "score file")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """Error rows, with exactly their keys, increasing, and line_number = source_index + 1."""
    rows = lines(spark, path)
    keys = F.json_object_keys("value")
    rows = rows.withColumn("e", F.from_json("value", ERROR_SCHEMA)).withColumn("_keys", keys).select("line_index", "_keys", "e.*")
    names = [c.split()[0] for c in ERROR_SCHEMA.split(", ")]
    bad = F.when(~F.col("_keys").eqNullSafe(F.array(*map(F.lit, names))), "unexpected keys").when(~F.col("line_number").eqNullSafe(F.col("source_index") + 1), "line_number is not source_index + 1")
    fail = F.raise_error(F.concat(F.lit("error line "), (F.col("line_index") + 1).cast("string"), F.lit(": "), bad))
    rows = rows.withColumn("source_index", F.when(bad.isNull(), F.col("source_index")).otherwise(fail.cast("long"))).drop("_keys")
    return _increasing(rows, rows.select("line_index", "source_index"), "source_index", "error file")
