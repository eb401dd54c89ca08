"""Which tokens keep their label: masks by configuration, and the statistics of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions import ranking as R
from lossweave.functions import sequences as S
from lossweave.functions.templates import THINK_CLOSE, THINK_OPEN
from lossweave.functions.tokenizers import Encode
from lossweave.operators.alignment import contract
from lossweave.plans.config import ScopedSelection, Selection


def ignored(scores: Column, eligible: Column, config: Selection, sample_id: Column) -> Column:
    """Mask over the scores of the tokens to ignore."""
    if isinstance(config, ScopedSelection):
        if config.random_mask_zero_count:
            return R.random_control(scores, eligible, sample_id, config.random_mask_seed)
        return R.nonpositive(scores, eligible)
    if config.mode == "fraction":
        return R.bottom_fraction(scores, eligible, config.ignore_rate, config.normalization_exponent)
    return {"nonpositive": R.nonpositive, "nonzero": R.nonzero, "positive": R.positive}[config.mode](scores, eligible)


def selection_error(scores: Column, kept: Column, eligible: Column, config: Selection) -> Column:
    """Why a sample cannot be selected from; null if it can."""
    error = F.when(~R.scores_valid(scores), "scores must be finite and not empty")
    if isinstance(config, ScopedSelection):
        return F.when((R.count_true(eligible) > 0) & ~R.scores_valid(scores), "scores must be finite and not empty")
    error = error.when(R.count_true(kept) == 0, "no retained response content token")
    if config.mode == "fraction":
        error = error.when(R.rate_too_small(scores, kept, config.ignore_rate), "ignore_rate is below the non-positive share")
    return error


def train_examples(samples: DataFrame, config: Selection, cutoff: int, encode: Encode | None = None, train_on_prompt: bool = False, eos: int | None = None, initial: list[int] | None = None) -> DataFrame:
    """input_ids, attention_mask, labels, n_retained, n_ignored and error per sample.

    samples: ``encoded`` turns and the ``_selection_*`` columns; other columns
    pass through.  ``eos``: a token that ends the sequence.  ``initial``: ids
    before the first turn.  ``encode`` is needed for the think scope.
    """
    initial = initial or []
    head = F.array(*[F.lit(i) for i in initial]).cast("array<int>")
    reserved = len(initial) + (eos is not None)
    encoded = F.col("encoded")
    out = samples.withColumn("_places", S.layout(encoded, F.lit(cutoff), reserved))
    places = F.col("_places")
    n = S.totals(encoded, places, reserved)
    seq, resp, scores = F.col("_selection_sequence_token_count"), F.col("_selection_response_token_count"), F.col("_selection_token_scores")
    full, wrong = contract(n["full_sequence"], n["full_response"], n["cut_sequence"], n["cut_response"], seq, resp, F.size(scores))
    out = out.withColumns({"_full": full, "_error": wrong})
    out = out.withColumn("_kept", S.retained(encoded, places, F.col("_full")))
    kept = F.col("_kept")
    if isinstance(config, ScopedSelection) and config.selection_scope == "think":
        if encode is None:
            raise ValueError("the think scope needs a tokenizer")
        opening, closing = encode(F.lit(THINK_OPEN)), encode(F.lit(THINK_CLOSE))
        flags = F.transform(encoded, lambda x: R.think_span(F.slice(x["target"], F.lit(1), x["content"]), opening, closing))
        scope = S.scoped(encoded, places, F.col("_full"), flags)
        out = out.withColumn("_eligible", F.zip_with(kept, scope, lambda a, b: a & F.coalesce(b, F.lit(False))))
    else:
        out = out.withColumn("_eligible", kept)
    eligible = F.col("_eligible")
    out = out.withColumn("error", F.coalesce("_error", selection_error(scores, kept, eligible, config)))
    ok = F.col("error").isNull()
    out = out.withColumn("_ignored", F.when(ok, ignored(scores, eligible, config, F.col("_selection_sample_id"))))
    tail = F.array(*([F.lit(eos)] if eos is not None else [])).cast("array<int>")
    ids = F.concat(head, S.token_ids(encoded, places), tail)
    shown = F.concat(F.transform(head, lambda x: F.lit(S.IGNORE)), S.labels(encoded, places, F.col("_ignored"), F.col("_full"), train_on_prompt), tail)
    out = out.withColumns({"input_ids": F.when(ok, ids), "labels": F.when(ok, shown), "n_retained": F.when(ok, R.count_true(kept)), "n_ignored": F.when(ok, R.count_true(F.col("_ignored")))})
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).drop("_places", "_full", "_error", "_kept", "_eligible", "_ignored")


def statistics(examples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Samples, retained and ignored tokens and their rate (0 where none is retained)."""
    rate = F.coalesce(F.try_divide(F.sum("n_ignored"), F.sum("n_retained")), F.lit(0.0))
    return examples.groupBy(*(by or [])).agg(F.count("*").alias("samples"), F.sum("n_retained").alias("retained"), F.sum("n_ignored").alias("ignored"), rate.alias("rate"))
