"""Sinks: ordered JSONL with a manifest, published by rename."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, functions as F

from lossweave.plans.provenance import sibling
from lossweave.sources.files import Files
from lossweave.sources.jsonl import ERROR_COLUMNS, SCORE_COLUMNS


def as_lines(rows: DataFrame, columns: tuple[str, ...] = SCORE_COLUMNS, order: str = "source_index") -> DataFrame:
    """One JSON object per row with exactly these keys in this order; range-sorted, so files concatenate in order."""
    return rows.select(order, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).orderBy(order).select("value")


def write_ordered(rows: DataFrame, path: str, columns: tuple[str, ...] = SCORE_COLUMNS, order: str = "source_index", single: bool = False) -> None:
    """A folder of part files whose names sort in row order, or one file; replaces an older one only when all is written."""
    files, staged = Files(rows.sparkSession), f"{path}.staged"
    as_lines(rows, columns, order).write.mode("overwrite").text(staged)
    if single:
        files.join(staged, path)
        files.delete(staged)
    else:
        files.swap(staged, path)


def publish(good: DataFrame, bad: DataFrame, output: str, manifest: dict[str, Any], semantics: str, single: bool = False) -> dict[str, Any]:
    """Score file, error file and, last, the manifest of a finished run."""
    spark, errors = good.sparkSession, sibling(output, "errors")
    write_ordered(good, output, single=single)
    write_ordered(bad, errors, ERROR_COLUMNS, single=single)
    done = manifest | {"output_records": spark.read.text(output).count(), "error_records": spark.read.text(errors).count(), "score_semantics": semantics}
    Files(spark).write(sibling(output, "manifest"), json.dumps(done, ensure_ascii=False, indent=2, allow_nan=False))
    return done
