"""Dataset registry: name to file, formatting and columns."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.sources.files import Files

SUFFIXES = (".json", ".jsonl")


def lookup(registry: dict[str, Any], names: list[str]) -> list[dict[str, Any]]:
    """Entries of the named datasets; only local files without sub-sampling have positional scores."""
    out = []
    for name in names:
        if name not in registry:
            raise KeyError(f"unknown dataset {name!r}")
        entry = registry[name]
        if "file_name" not in entry or entry.get("num_samples"):
            raise ValueError(f"dataset {name!r} is not a local file, or is sub-sampled")
        out.append({"name": name, **entry})
    return out


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(Files(spark).read(path))


def files(spark: SparkSession, path: str) -> list[str]:
    """The file, or a folder's JSON and JSONL files by name."""
    names = Files(spark).names(path)
    if names is None:
        return [path]
    found = [f"{path.rstrip('/')}/{x}" for x in names if x.endswith(SUFFIXES)]
    if not found:
        raise FileNotFoundError(f"no {' or '.join(SUFFIXES)} files in {path}")
    return found


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, record) of a dataset in file order: JSONL lines, or the elements of JSON arrays."""
    from lossweave.sources.jsonl import lines

    found = files(spark, path)
    if all(x.endswith(".jsonl") for x in found):
        out = lines(spark, found).where(F.trim("value") != "")
        return out.select(F.col("line_index").alias("row_index"), F.parse_json("value").alias("record"))
    parts = []
    for k, x in enumerate(found):
        text = spark.read.text(x, wholetext=not x.endswith(".jsonl"))
        items = text.select(F.posexplode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("i", "record")) if not x.endswith(".jsonl") else lines(spark, x).select(F.col("line_index").alias("i"), F.parse_json("value").alias("record"))
        parts.append(items.select(F.lit(k).alias("f"), F.col("i").cast("long").alias("i"), "record"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    sizes = out.groupBy("f").agg((F.max("i") + 1).alias("n"))
    before = sizes.select("f", F.coalesce(F.expr("sum(n) over (order by f rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("before"))
    return out.join(F.broadcast(before), "f").select((F.col("before") + F.col("i")).alias("row_index"), "record")
