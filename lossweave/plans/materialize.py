"""Whole runs: score files, count-matched masks and training sets."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.functions import ranking as R
from lossweave.functions import sequences as S
from lossweave.functions.tokenizers import Encode
from lossweave.operators import alignment, merging, records, scorers, selection
from lossweave.plans import provenance
from lossweave.plans.config import Scoring, Selection, guard, load
from lossweave.sources import jsonl, publish, registry
from lossweave.sources.files import Files

SCORED = ("source_index", *jsonl.SCORE_COLUMNS)
#: Seconds that the chunks scored by one Spark job take together, by the pace of those before; a slower chunk has its own.
JOB_SECONDS = 30


def encoded_samples(spark: SparkSession, run: Scoring, encode: Encode, bos: int | None = None) -> DataFrame:
    """Every line of the input's range as an encoded sample or a classified error."""
    lines = jsonl.in_range(jsonl.lines(spark, run.input), run.start_index, run.limit)
    parsed = records.parse(lines).withColumnRenamed("line_index", "source_index")
    name = F.col("source_index").cast("string")
    if run.id_field:
        name = F.coalesce(F.try_variant_get("record", f"$['{run.id_field}']", "string"), name)
    talks = records.conversations(parsed.withColumn("sample_id", name), run.messages_field, run.prompt_field, run.response_field, run.system_field)
    return records.encode(talks, run.template, encode, bos, run.truncate_to_length, run.max_model_len)


def _encoded_parts(spark: SparkSession, run: Scoring, encode: Encode, bos: int | None, parts: str, files: Files) -> DataFrame:
    """Encoded samples and classified errors of the run's range, each encoded once, in folders of ``chunk_rows`` lines."""
    at = f"{parts}/samples"
    if not files.exists(f"{at}/_SUCCESS"):
        samples = encoded_samples(spark, run, encode, bos)
        # Places stand for the positions, which take twice the room of the ids.
        keep = ("source_index", "sample_id", "token_ids", "places", "error_type", "error")
        samples.select(*keep, F.expr(f"source_index div {run.chunk_rows}").alias("chunk")).write.mode("overwrite").option("compression", "zstd").partitionBy("chunk").parquet(at)
    kept = spark.read.schema(f"source_index long, sample_id string, token_ids array<int>, places array<{S.PLACE}>, error_type string, error string, chunk long").parquet(at)
    return kept.withColumns({"response_positions": S.response_positions(F.col("places")), "target_positions": S.target_positions(F.col("places"))}).drop("places")


def _scored_chunks(files: Files, scores: str) -> set[int]:
    """Chunks whose scores are durable: of folders ``chunk=k`` and ``chunk=first-last`` that are whole; what a cut-off job left of others goes."""
    done: set[int] = set()
    for name in files.names(scores) or ():
        if not files.exists(f"{scores}/{name}/_SUCCESS"):
            files.delete(f"{scores}/{name}")
            continue
        first, _, last = name.removeprefix("chunk=").partition("-")
        done.update(range(int(first), int(last or first) + 1))
    return done


def score(spark: SparkSession, run: Scoring, encode: Encode, build: Callable[[], scorers.Scorer], bos: int | None = None) -> dict:
    """Score file, error file and manifest.

    Samples are encoded once and scored chunk by chunk, in jobs of one chunk or
    of as many as take ``JOB_SECONDS`` together; a job's scores are durable as
    soon as they are written.  An earlier run with the same settings
    is gone on with, whether it was cut off (its parts are kept) or finished
    (its output is kept): only rows without a score are scored.  Settings that
    differ are an error, as is an output without a manifest; ``overwrite`` starts
    afresh.  A sample that the scorer fails on has no row and is counted as
    ``failed_records`` in the result, for a later run to score; with
    ``fail_fast`` it ends the run.
    """
    files = Files(spark)
    parts, errors, note = (provenance.sibling(run.output, x) for x in ("parts", "errors", "manifest"))
    if run.overwrite:
        for path in (run.output, errors, note, parts):
            files.delete(path)
    for path in (run.output, errors, note):
        files.recover(path)
    total = jsonl.lines(spark, run.input).count()
    plan = provenance.manifest(run, files, total)
    before, bad_before = [], []
    if files.exists(run.output):
        if not files.exists(note):
            raise ValueError(f"existing output has no manifest: {note}")
        provenance.check_resume(json.loads(files.read(note)), plan, run.workspace)
        if run.id_field is not None:
            raise ValueError("an output whose ids are a field's values does not tell its rows' lines; pass overwrite")
    if files.exists(errors):
        bad_before.append(jsonl.errors(spark, errors).select(*jsonl.ERROR_COLUMNS))
    if files.exists(parts):
        if not files.exists(f"{parts}/plan.json"):
            raise ValueError(f"parts without their settings: {parts}")
        provenance.check_resume(json.loads(files.read(f"{parts}/plan.json")), plan, run.workspace)
    else:
        files.write(f"{parts}/plan.json", json.dumps(plan))
    if files.exists(run.output):
        old = jsonl.scores(spark, run.output).select(*SCORED)
        old.write.mode("overwrite").option("compression", "zstd").parquet(f"{parts}/before")  # parsed and checked whole, once, before any model is loaded
        before.append(spark.read.schema(old.schema).parquet(f"{parts}/before"))
    samples = _encoded_parts(spark, run, encode, bos, parts, files)
    good, bad = records.split_errors(samples)
    chunks = range(plan["start_index"] // run.chunk_rows, -(-plan["end_index"] // run.chunk_rows)) if plan["end_index"] > plan["start_index"] else ()
    done = _scored_chunks(files, f"{parts}/scores")
    left, size = [k for k in chunks if k not in done], 1
    while left:
        # A job writes one folder, named by its first and last chunk: chunks that follow each other.
        now = [k for i, k in enumerate(left[:size]) if k == left[0] + i]
        left, first, last, began = left[len(now) :], now[0], now[-1], time.monotonic()
        todo = good.where(F.col("chunk").between(first, last))
        if before:
            inside = F.col("source_index").between(first * run.chunk_rows, (last + 1) * run.chunk_rows - 1)
            todo = merging.pending(todo, *[d.where(inside) for d in before])
        if run.partitions:
            todo = todo.repartition(run.partitions)
        at = f"{parts}/scores/chunk={first}" + (f"-{last}" if last > first else "")
        scorers.score_each(todo, build, run.score_transform, run.fail_fast).write.mode("overwrite").option("compression", "zstd").parquet(at)
        size = max(1, min(4 * len(now), int(len(now) * JOB_SECONDS / max(time.monotonic() - began, 0.001))))
        for n in (k - chunks[0] + 1 for k in now):
            if run.progress_interval and n % run.progress_interval == 0:
                print(f"scored {n} of {len(chunks)} parts", file=sys.stderr, flush=True)
    new = spark.createDataFrame([], f"{scorers.SCORED}, failure string, chunk string")
    if chunks:
        new = spark.read.schema(new.schema).option("basePath", f"{parts}/scores").parquet(f"{parts}/scores")
        stray = F.raise_error(F.concat(F.lit("row of another part: "), F.col("source_index").cast("string"))).cast("boolean")
        edge = lambda at: F.element_at(F.split("chunk", "-"), at).cast("long")
        new = new.where(F.when(~F.expr(f"source_index div {run.chunk_rows}").between(edge(1), edge(-1)), stray).otherwise(True))
    failed = new.where("failure is not null").count()
    out = publish.publish(
        merging.merge([*before, new.where("failure is null").select(*SCORED)], ordered=True), merging.merge([*bad_before, bad.select(*jsonl.ERROR_COLUMNS)]), run.output, plan, run.score_semantics, run.single_file)
    files.delete(parts)
    return out | ({"failed_records": failed} if failed else {})


def count_matched_masks(nll: DataFrame, reference: DataFrame, strict: bool = True) -> DataFrame:
    """Mask rows: as many lowest-loss tokens at 0 as the reference has non-positive scores, all others at 1."""
    both = alignment.pair_scores(nll, reference)
    if strict:
        both = alignment.fail_on(both)
    ignored = R.count_matched(F.col("nll"), F.col("reference"))
    mask = F.transform(ignored, lambda x: F.when(x, 0.0).otherwise(1.0))
    return both.select(F.col("index").alias("source_index"), F.col("a_id").alias("sample_id"), F.col("a_seq").alias("sequence_token_count"), F.col("a_resp").alias("response_token_count"), F.col("a_sum").alias("baseline_response_target_nll_sum"), mask.alias("token_scores"))


def mask_totals(masks: DataFrame) -> DataFrame:
    """Records, response tokens, masked and trained tokens, and the masked share."""
    zero = F.size(F.filter("token_scores", lambda x: x <= 0))
    return masks.agg(F.count("*").alias("records"), F.sum("response_token_count").alias("response_tokens"), F.sum(zero).alias("masked"), (F.sum("response_token_count") - F.sum(zero)).alias("trained"), (F.sum(zero) / F.sum("response_token_count")).alias("mask_rate"))


def materialize_masks(spark: SparkSession, nll: str, reference: str, output: str, expected: int | None = None, overwrite: bool = False, single: bool = False) -> dict:
    """Mask file and manifest; a finished one of the same sources is used again."""
    files = Files(spark)
    if provenance.reusable(files, output, {"nll": nll, "reference": reference}, overwrite):
        return json.loads(files.read(provenance.sibling(output, "manifest")))
    masks = count_matched_masks(jsonl.scores(spark, nll, strict=True), jsonl.scores(spark, reference, strict=True))
    totals = mask_totals(masks).first().asDict()
    if expected is not None and totals["records"] != expected:
        raise ValueError(f"{totals['records']} records, expected {expected}")
    publish.write_ordered(masks, output, single=single)
    done = {"method": "sequence_equal_count_lowest_nll", "nll": files.fingerprint(nll), "reference": files.fingerprint(reference), "score_semantics": "binary_train_mask; 0=ignore, 1=train", **totals}
    files.write(provenance.sibling(output, "manifest"), json.dumps(done, indent=2))
    return done


def training_set(rows: DataFrame, scores: DataFrame, config: Selection, template: str, encode: Encode, cutoff: int, bos: int | None = None, max_samples: int | None = None, train_on_prompt: bool = False, eos: int | None = None) -> DataFrame:
    """Examples of one dataset: rows (row_index, record) joined with their scores, encoded and masked."""
    joined = alignment.attach(rows, scores)
    if max_samples is not None:
        joined = merging.first_rows(joined, max_samples)
    talks = records.conversations(joined.withColumn("bad", F.lit(None).cast("string")))
    # Only scored rows must be sound; naming a score column keeps the check above the join.
    talks = alignment.fail_on(talks.withColumn("_why", F.when(F.col("_selection_sample_id").isNotNull(), F.col("error"))), "_why", "row_index").drop("error_type", "error")
    encoded = talks.withColumn("encoded", S.encoded_turns(F.col("turns"), F.col("system"), template, encode, bos))
    return selection.train_examples(encoded, config, cutoff, encode, train_on_prompt, eos)


#: Columns of a written training set.
EXAMPLE = ("dataset", "row_index", "input_ids", "attention_mask", "labels", "n_retained", "n_ignored")


def select(spark: SparkSession, settings: str, output: str, encode: Encode, overrides: list[str] = (), scoped: bool = False, bos: int | None = None) -> dict[str, dict]:
    """Training set of a settings file, and the statistics of each of its splits.

    A sample that cannot be used fails the run with its dataset, row and reason.
    With ``val_size`` (a share, or a number of rows) the output has the folders
    train and validation, else it is the training set.  It is put in place when
    all is written; an existing one is replaced only with ``overwrite_cache``.
    ``preprocessing_batch_size`` is the number of rows a Python tokenizer gets
    at a time; how many run at once follows from the input's partitions, so
    ``preprocessing_num_workers`` changes nothing.
    """
    files = Files(spark)
    training, config = load(files.read(settings), overrides, scoped)
    guard(training)
    staged = f"{output}.staged"
    if files.exists(output) and not training.get("overwrite_cache"):
        raise FileExistsError(f"{output} exists; set overwrite_cache")
    names = [x.strip() for x in training["dataset"].split(",")] if isinstance(training["dataset"], str) else list(training["dataset"])
    folder, cutoff, most = training.get("dataset_dir", "data"), int(training["cutoff_len"]), training.get("max_samples")
    parts = []
    for entry in registry.lookup(registry.load(spark, f"{folder}/dataset_info.json"), names):
        rows = registry.rows(spark, f"{folder}/{entry['file_name']}")
        scores = jsonl.scores(spark, config.score_path(entry["name"], names))
        made = training_set(rows, scores, config, training["template"], encode, cutoff, bos, most, bool(training.get("train_on_prompt", False)))
        made = made.withColumns({"dataset": F.lit(entry["name"]), "_where": F.concat(F.lit(f"{entry['name']}, "), F.col("row_index").cast("string"))})
        parts.append(alignment.fail_on(made, "error", "_where").select(*EXAMPLE))
    whole, held = merging.combine(parts), float(training.get("val_size") or 0)
    splits = {"": whole}
    if held:
        train, validation = merging.split(whole.withColumn("_key", F.concat_ws(":", "dataset", "row_index")), held, "_key", int(training.get("seed", 42)))
        splits = {"train": train.drop("_key"), "validation": validation.drop("_key")}
    # The setting belongs to the session and is put back.
    name, batch = "spark.sql.execution.arrow.maxRecordsPerBatch", training.get("preprocessing_batch_size")
    before = spark.conf.get(name)
    try:
        if batch:
            spark.conf.set(name, str(int(batch)))
        for split, rows in splits.items():
            rows.write.mode("overwrite").parquet(f"{staged}/{split}".rstrip("/"))
    finally:
        spark.conf.set(name, before)
    files.swap(staged, output)
    return {split or "train": selection.statistics(spark.read.parquet(f"{output}/{split}".rstrip("/"))).first().asDict() for split in splits}
