"""One score per response token: corpus statistics in SQL, models behind an Arrow interface."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


class Scorer(Protocol):
    """A model behind the Arrow interface; built once per Python worker."""

    def __call__(self, token_ids: list[int], response_positions: list[int], target_positions: list[int]) -> tuple[list[float], float]:
        """(one score per response position, sum of the targets' losses)."""


SCORED = "source_index long, sample_id string, sequence_token_count int, response_token_count int, baseline_response_target_nll_sum double, token_scores array<double>"


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column; its numbers become Python ones all at once, not one by one."""
    if column.null_count or column.values.null_count:
        yield from column.to_pylist()
        return
    off = column.offsets.to_numpy()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield column.values[i:j].to_numpy().tolist()


def score_each(samples: DataFrame, build: Callable[[], Scorer], transform: str = "signed", fail_fast: bool = False) -> DataFrame:
    """Score rows of encoded samples by any model, with ``failure``: what went wrong with a sample, or null.

    A failed sample has neither scores nor a sum and the others go on; with
    ``fail_fast`` it fails the task.
    """

    def one(scorer, ids, r, t):
        values, total = scorer(ids, r, t)
        if len(values) != len(r) or not all(map(math.isfinite, (*values, total))):
            raise RuntimeError("the scorer returned other than one finite score per response token")
        return [max(0.0, float(x)) if transform == "positive" else float(x) for x in values], float(total), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = build()
        for batch in batches:
            rows = []
            for sample in zip(*(_lists(batch.column(i)) for i in (2, 3, 4)), strict=True):
                try:
                    rows.append(one(scorer, *sample))
                except Exception as e:
                    if fail_fast:
                        raise
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            scores, sums, failures = zip(*rows, strict=True) if rows else ((), (), ())
            sizes = [pc.list_value_length(batch.column(i)).cast(pa.int32()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(sums, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(failures, pa.string())],
                                             [x.split()[0] for x in f"{SCORED}, failure string".split(", ")])

    return samples.select("source_index", "sample_id", "token_ids", "response_positions", "target_positions").mapInArrow(run, f"{SCORED}, failure string")


def score_with(samples: DataFrame, build: Callable[[], Scorer], transform: str = "signed") -> DataFrame:
    """Score rows of encoded samples by any model; one that it fails on fails the query."""
    return score_each(samples, build, transform, True).drop("failure")


def losses_scorer(losses: Callable[[list[int]], list[float]]) -> Callable[[], Scorer]:
    """Token likelihood losses: losses(ids)[p] is the loss of predicting position p."""

    def build():
        def one(ids, r, t):
            loss = losses(ids)
            return [loss[p] for p in r], math.fsum(loss[p] for p in t)

        return one

    return build


def gradient_scorer(gate_gradients: Callable[[list[int], list[int]], tuple[list[float], float]]) -> Callable[[], Scorer]:
    """Value-gate gradients: the score is minus the derivative of the targets' loss sum by the token's gate."""

    def build():
        def one(ids, r, t):
            gradient, total = gate_gradients(ids, t)
            return [-gradient[p] for p in r], total

        return one

    return build


def ablation_scorer(losses: Callable[[list[int], int | None], list[float]]) -> Callable[[], Scorer]:
    """Value-gate ablation: later targets' losses with one token's gate closed, minus those without; 0 without later targets."""

    def build():
        def one(ids, r, t):
            base, out = losses(ids, None), []
            for p in r:
                later = [q for q in t if q > p]
                changed = losses(ids, p) if later else []
                out.append(math.fsum(changed[q] for q in later) - math.fsum(base[q] for q in later) if later else 0.0)
            return out, math.fsum(base[q] for q in t)

        return one

    return build


def unigram_losses(tokens: DataFrame, token: str = "tok") -> DataFrame:
    """(token, n, nll): add-one smoothed loss of each distinct token in the corpus.

    One shuffle, with counts combined before it; the total is one row.
    """
    counts = tokens.groupBy(token).agg(F.count("*").alias("n"))
    size = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.crossJoin(F.broadcast(size)).select(token, "n", (-F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds")).cast("double"))).alias("nll"))


def bigram_losses(tokens: DataFrame, sample: str, position: str, token: str = "tok") -> DataFrame:
    """tokens with nll: loss of each token after the one before it, add-one smoothed over the corpus."""
    w = Window.partitionBy(sample).orderBy(position)
    pairs = tokens.withColumn("before", F.coalesce(F.lag(token).over(w), F.lit("")))
    both = pairs.groupBy("before", token).agg(F.count("*").alias("n2"))
    ctx = both.groupBy("before").agg(F.sum("n2").alias("n1"))
    kinds = both.select(token).distinct().agg(F.count("*").alias("kinds"))
    table = both.join(ctx, "before").crossJoin(F.broadcast(kinds))
    table = table.select("before", token, (-F.log((F.col("n2") + 1) / (F.col("n1") + F.col("kinds")).cast("double"))).alias("nll"))
    return pairs.join(table, ["before", token])


def later_sums(tokens: DataFrame, sample: str, position: str, value: str, into: str = "later") -> DataFrame:
    """For each position of a sample, the sum of the values after it, in rows: a suffix window that spills."""
    w = Window.partitionBy(sample).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def deletion_metrics(tokens: DataFrame, sample: str, position: str, base: str, deleted: str) -> DataFrame:
    """Sum, mean and positive part of loss changes over the targets after each position."""
    w = Window.partitionBy(sample).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    delta = F.col(deleted) - F.col(base)
    return tokens.withColumns({"delta_sum": F.coalesce(F.sum(delta).over(w), F.lit(0.0)), "delta_mean": F.coalesce(F.avg(delta).over(w), F.lit(0.0)), "delta_positive": F.coalesce(F.sum(F.greatest(delta, F.lit(0.0))).over(w), F.lit(0.0))})


def soft_capped(logit: Column, cap: float) -> Column:
    """Logits bounded by a smooth cap."""
    return F.tanh(logit / cap) * cap


@F.arrow_udf(DoubleType())
def exact_sum(values: pa.Array) -> pa.Array:
    """Correctly rounded sum of an array of doubles, where a fold would lose bits."""
    return pa.array([None if v is None else math.fsum(v) for v in values.to_pylist()], pa.float64())


REGISTRY: dict[str, Callable[..., Any]] = {"entropy": losses_scorer, "gradient": gradient_scorer, "ablation": ablation_scorer}


def scorer(kind: str, *args) -> Callable[[], Scorer]:
    if kind not in REGISTRY:
        raise ValueError(f"unknown scorer {kind!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[kind](*args)
