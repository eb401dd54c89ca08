"""Command line: ``python -m lossweave.cli score|mask|select``."""

from __future__ import annotations

import argparse
import functools
import importlib
import json
import sys

from pyspark.sql import SparkSession


def _object(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


#: Settings of a model that a scorer's builder gets by name.
MODEL_OPTIONS = ("activation_checkpoint_min_length", "lm_head_chunk_size", "cuda_cache_cleanup_interval")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lossweave")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("score", help="one score per response token")
    s.add_argument("method", choices=["entropy", "gradient", "ablation"])
    for name in ("input", "output"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--model-dir", default="")
    s.add_argument("--template", default="auto")
    s.add_argument("--scorer", required=True, help="module:function that builds a scorer")
    s.add_argument("--tokenizer", default="lossweave.functions.tokenizers:code_points", help="module:function that builds a tokenizer")
    s.add_argument("--bos", type=int)
    s.add_argument("--messages-field", default="messages")
    s.add_argument("--system-field", default="system")
    for name in ("prompt-field", "response-field", "id-field"):
        s.add_argument(f"--{name}")
    s.add_argument("--start-index", type=int, default=0)
    s.add_argument("--limit", type=int)
    s.add_argument("--max-model-len", type=int, default=32768)
    s.add_argument("--truncate-to-length", type=int)
    s.add_argument("--score-transform", choices=["signed", "positive"], default="signed")
    s.add_argument("--ablated-gate-value", type=float)
    s.add_argument("--dtype")
    s.add_argument("--overwrite", action="store_true")
    s.add_argument("--fail-fast", action="store_true")
    s.add_argument("--device", default="auto")
    s.add_argument("--attn-implementation", default="auto")
    s.add_argument("--trust-remote-code", action="store_true")
    s.add_argument("--configs", help="folder of training settings that name a model's template")
    s.add_argument("--workspace", help="folder name from which on input and model paths count")
    s.add_argument("--data-parallel-size", type=int, help="tasks that score at a time; by default as many as the input has")
    s.add_argument("--chunk-rows", type=int, default=1_000_000, help="lines whose scores become durable together")
    s.add_argument("--single-file", action="store_true", help="one output file instead of a folder of ordered parts")
    s.add_argument("--progress-interval", type=int, default=1, help="parts of --chunk-rows lines after which progress is told")
    for name in MODEL_OPTIONS:
        s.add_argument(f"--{name.replace('_', '-')}", type=int, help="handed to the scorer's builder if given")
    m = sub.add_parser("mask", help="count-matched likelihood masks")
    for name in ("nll", "reference", "output"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--expected-records", type=int)
    m.add_argument("--overwrite", action="store_true")
    m.add_argument("--progress-interval", type=int, help="taken, but masks are one Spark job, whose progress Spark shows itself")
    m.add_argument("--single-file", action="store_true")
    t = sub.add_parser("select", help="training set with ignored labels")
    t.add_argument("config")
    t.add_argument("overrides", nargs="*")
    t.add_argument("--scoped", action="store_true")
    t.add_argument("--output", required=True)
    t.add_argument("--tokenizer", default="lossweave.functions.tokenizers:code_points")
    t.add_argument("--bos", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lossweave").getOrCreate()
    if a.command == "score":
        from lossweave.functions.templates import resolve
        from lossweave.plans.config import Scoring
        from lossweave.plans.materialize import score

        dtype = a.dtype or ("float32" if a.method == "ablation" else "bfloat16")
        run = Scoring(input=a.input, output=a.output, template=resolve(a.model_dir, a.template, a.input, a.configs), messages_field=a.messages_field, prompt_field=a.prompt_field, response_field=a.response_field, system_field=a.system_field, id_field=a.id_field,
                      start_index=a.start_index, limit=a.limit, max_model_len=a.max_model_len, truncate_to_length=a.truncate_to_length, score_transform=a.score_transform, method=a.method, ablated_gate_value=a.ablated_gate_value, dtype=dtype, overwrite=a.overwrite, fail_fast=a.fail_fast,
                      model_dir=a.model_dir, device=a.device, attn_implementation=a.attn_implementation, trust_remote_code=a.trust_remote_code, workspace=a.workspace, chunk_rows=a.chunk_rows, partitions=a.data_parallel_size, single_file=a.single_file, progress_interval=a.progress_interval)
        options = {x: getattr(a, x) for x in MODEL_OPTIONS if getattr(a, x) is not None}
        build = functools.partial(_object(a.scorer), **options)
        print(json.dumps(score(spark, run, _object(a.tokenizer)(), build, a.bos)))
    elif a.command == "mask":
        from lossweave.plans.materialize import materialize_masks

        print(json.dumps(materialize_masks(spark, a.nll, a.reference, a.output, a.expected_records, a.overwrite, a.single_file)))
    else:
        from lossweave.functions.templates import NOTHINK_CHAT
        from lossweave.plans.config import load
        from lossweave.plans.materialize import select
        from lossweave.sources.files import Files

        files = Files(spark)
        training, _ = load(files.read(a.config), a.overrides, a.scoped)
        chat = training.get("template") == "qwen3_nothink"
        if chat and not training.get("output_dir"):
            raise ValueError("qwen3_nothink training needs output_dir")
        print(json.dumps(select(spark, a.config, a.output, _object(a.tokenizer)(), a.overrides, a.scoped, a.bos)))
        if chat:
            files.write(f"{training['output_dir']}/chat_template.jinja", NOTHINK_CHAT)
    return 0


if __name__ == "__main__":
    sys.exit(main())
