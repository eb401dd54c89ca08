"""Joins of samples with scores; contracts are checked, never silently filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossweave.functions import ranking as R

REQUIRED = ("sample_id", "sequence_token_count", "response_token_count", "token_scores")


def require(scores: DataFrame) -> DataFrame:
    """The score columns under the names that a sample carries them by."""
    missing = [c for c in REQUIRED if c not in scores.columns]
    if missing:
        raise ValueError(f"score file lacks columns {missing}")
    return scores.select("*", *[F.col(c).alias(f"_selection_{c}") for c in REQUIRED]).drop(*REQUIRED)


def sample_index(sample_id: Column) -> Column:
    """Sample id as the number of its source row; null if it is none."""
    return F.when(sample_id.rlike("^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$"), F.regexp_replace(F.trim(sample_id), "_", "").cast("long"))


def attach(samples: DataFrame, scores: DataFrame, index: str = "row_index") -> DataFrame:
    """Inner join on the row number.

    Score files may be sparse: rows without scores go.  Scores for rows that do
    not exist, and two scores for one row, are errors.
    """
    total = samples.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("_total"))
    s = require(scores).withColumn("_at", sample_index(F.col("_selection_sample_id")))
    s = s.crossJoin(F.broadcast(total))  # one row
    fail = F.raise_error(F.concat(F.lit("score for no source row: "), F.coalesce("_selection_sample_id", F.lit("null")))).cast("long")
    s = s.withColumn("_at", F.when(F.col("_at").between(0, F.col("_total") - 1), F.col("_at")).otherwise(fail)).drop("_total")
    keep = ["_at", *[f"_selection_{c}" for c in REQUIRED]]
    # Counted on the join's own key, so the rows move once.
    s = s.select(*keep, F.count("*").over(Window.partitionBy("_at")).alias("_times"))
    twice = F.raise_error(F.concat(F.lit("two scores for row "), F.col("_at").cast("string"))).cast("boolean")
    s = s.where(F.when(F.col("_times") > 1, twice).otherwise(True)).drop("_times")
    return samples.join(s, samples[index] == F.col("_at")).drop("_at")


def contract(full_sequence: Column, full_response: Column, cut_sequence: Column, cut_response: Column, sequence: Column, response: Column, n_scores: Column) -> tuple[Column, Column]:
    """(whether the scores cover the whole sample, what is wrong or null)."""
    full = (sequence == full_sequence) & (response == full_response)
    cut = (sequence == cut_sequence) & (response == cut_response)
    return full, F.when(~full & ~cut, "score/tokenization mismatch").when(n_scores != response, "score array length mismatch")


def pair_scores(nll: DataFrame, reference: DataFrame, index: str = "source_index") -> DataFrame:
    """Full outer join of two dense score files by ordinal, with ``violation`` naming what keeps a pair from use."""
    a = nll.select(F.col(index).alias("i"), F.col("sample_id").alias("a_id"), F.col("sequence_token_count").alias("a_seq"), F.col("response_token_count").alias("a_resp"), F.col("baseline_response_target_nll_sum").alias("a_sum"), F.col("token_scores").alias("nll"))
    b = reference.select(F.col(index).alias("j"), F.col("sample_id").alias("b_id"), F.col("sequence_token_count").alias("b_seq"), F.col("response_token_count").alias("b_resp"), F.col("token_scores").alias("reference"))
    both = a.join(b, F.col("i") == F.col("j"), "full_outer")
    violation = (
        F.when(F.col("i").isNull() | F.col("j").isNull(), "row on one side only")
        .when(~F.col("a_id").eqNullSafe(F.col("b_id")), "sample ids differ")
        .when((F.col("a_seq") != F.col("b_seq")) | (F.col("a_resp") != F.col("b_resp")), "token counts differ")
        .when((F.size("nll") != F.col("a_resp")) | (F.size("reference") != F.col("b_resp")), "score array length mismatch")
        .when(~R.scores_valid(F.col("nll")) | ~R.scores_valid(F.col("reference")), "scores must be finite")
        .when(F.exists("nll", lambda x: x < 0), "losses must be non-negative"))
    return both.withColumns({"index": F.coalesce("i", "j"), "violation": violation})


def fail_on(rows: DataFrame, violation: str = "violation", keep: str = "index") -> DataFrame:
    """rows, failing at the first violation."""
    fail = F.raise_error(F.concat(F.lit("row "), F.col(keep).cast("string"), F.lit(": "), F.col(violation))).cast("boolean")
    return rows.where(F.when(F.col(violation).isNotNull(), fail).otherwise(True)).drop(violation)
