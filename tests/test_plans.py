"""Files, runs, merging and settings."""

import json
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lossweave.functions.templates import resolve
from lossweave.functions.tokenizers import code_points
from lossweave.operators import alignment, merging, scorers
from lossweave.plans import provenance
from lossweave.plans.config import ScopedSelection, Scoring, Selection, guard, load
from lossweave.plans.materialize import materialize_masks, score, training_set
from lossweave.sources import jsonl, registry
from lossweave.sources.files import Files


def losses():
    return scorers.losses_scorer(lambda ids: [float(i % 5) for i in range(len(ids))])()


def test_lines_keep_their_numbers(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(texts[:1500]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(texts[1500:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = jsonl.lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).orderBy("line_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_index, r.value) for r in got] == list(enumerate(texts))
    rows = spark.range(10).withColumnRenamed("id", "line_index")
    assert [sorted(r.line_index for r in jsonl.in_range(rows, 2, 7, k, 3).collect()) for k in range(3)] == [[3, 6], [4, 7], [2, 5, 8]]
    assert [merging.expected(2, 9, k, 3) for k in range(3)] == [2, 2, 3]


def test_score_run_and_resume(spark, tmp_path):
    rows = [{"prompt": "question", "response": "answer"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"prompt": "p", "response": "rr", "id": "x1"}]
    src, out = tmp_path / "in.jsonl", tmp_path / "out.jsonl"
    src.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    run = Scoring(str(src), str(out), template="qwen3_nothink", single_file=True)
    done = score(spark, run, code_points(), losses)
    got = [json.loads(x) for x in out.read_text().splitlines()]
    assert [g["sample_id"] for g in got] == ["0", "2"] and list(got[0]) == list(jsonl.SCORE_COLUMNS)
    assert got[0]["response_token_count"] == 6 == len(got[0]["token_scores"])
    errors = [json.loads(x) for x in (tmp_path / "out.errors.jsonl").read_text().splitlines()]
    assert [(e["source_index"], e["line_number"], e["error_type"]) for e in errors] == [(1, 2, "ValueError"), (3, 4, "ValueError")]
    assert (done["output_records"], done["error_records"], done["end_index"]) == (2, 2, 4) and json.loads((tmp_path / "out.manifest.json").read_text()) == done
    assert [r.source_index for r in jsonl.scores(spark, str(out)).orderBy("source_index").collect()] == [0, 2]
    assert jsonl.errors(spark, str(tmp_path / "out.errors.jsonl")).count() == 2

    masks = tmp_path / "masks.jsonl"
    one = materialize_masks(spark, str(out), str(out), str(masks), expected=2, single=True)
    got = [json.loads(x) for x in masks.read_text().splitlines()]
    assert one["records"] == 2 and all(set(g["token_scores"]) <= {0.0, 1.0} for g in got)
    assert materialize_masks(spark, str(out), str(out), str(masks)) == json.loads((tmp_path / "masks.manifest.json").read_text())
    with pytest.raises(ValueError):
        materialize_masks(spark, str(out), str(out), str(tmp_path / "m2.jsonl"), expected=3)

    data = registry.rows(spark, str(src))
    made = training_set(data, jsonl.scores(spark, str(masks)), Selection(score_file="x", ignore_zero_scores_only=True), "qwen3_nothink", code_points(), 1000)
    assert made.where("error is null").count() == 2
    assert training_set(data, jsonl.scores(spark, str(masks)), Selection(score_file="x", ignore_zero_scores_only=True), "qwen3_nothink", code_points(), 1000, max_samples=1).count() == 1


def lengths(path):
    return {json.loads(x)["sample_id"]: json.loads(x)["response_token_count"] for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()}


def test_a_cut_off_run_goes_on(spark, tmp_path):
    """Chunks that were written stay; only the others are scored; other settings, or an output without a manifest, are errors."""
    src, out, seen = tmp_path / "in.jsonl", tmp_path / "out.jsonl", tmp_path / "seen"
    src.write_text("".join(json.dumps({"prompt": "p", "response": "r" * (i + 1)}) + "\n" for i in range(9)))
    run = Scoring(str(src), str(out), template="qwen3_nothink", chunk_rows=4)

    def watched(stop):
        def build():
            known = losses()

            def one(ids, r, t):
                if len(r) >= stop:
                    raise RuntimeError("the model is gone")
                with open(seen, "a") as f:
                    f.write(f"{len(r)}\n")
                return known(ids, r, t)

            return one

        return build

    with pytest.raises(Exception, match="the model is gone"):
        score(spark, replace(run, fail_fast=True), code_points(), watched(6))
    assert not out.exists() and set(map(int, seen.read_text().split())) >= {1, 2, 3, 4}
    with pytest.raises(ValueError, match="cannot resume"):
        score(spark, replace(run, max_model_len=99), code_points(), losses)
    seen.write_text("")
    assert score(spark, run, code_points(), watched(9))["failed_records"] == 1
    assert set(map(int, seen.read_text().split())) == {5, 6, 7, 8} and lengths(out) == {str(i): i + 1 for i in range(8)}
    seen.write_text("")
    done = score(spark, run, code_points(), watched(99))
    assert seen.read_text().split() == ["9"] and "failed_records" not in done and lengths(out) == {str(i): i + 1 for i in range(9)}
    with pytest.raises(ValueError, match="cannot resume"):
        score(spark, replace(run, limit=5), code_points(), losses)
    assert score(spark, replace(run, limit=0, overwrite=True), code_points(), losses)["output_records"] == 0
    (tmp_path / "out.manifest.json").unlink()
    with pytest.raises(ValueError, match="no manifest"):
        score(spark, run, code_points(), losses)


def test_small_chunks_share_jobs(spark, tmp_path, monkeypatch):
    """Jobs follow the work, not the number of chunks; each sample is scored once; what a cut-off job left is done again."""
    from lossweave.plans import materialize

    src, out, jobs, read = tmp_path / "in.jsonl", tmp_path / "out.jsonl", [], []
    src.write_text("".join(json.dumps({"prompt": "p", "response": "r" * (i + 1)}) + "\n" for i in range(40)))
    run = Scoring(str(src), str(out), template="qwen3_nothink", chunk_rows=1)
    score_each, scores = scorers.score_each, jsonl.scores

    def counted(samples, *rest):
        jobs.append(sorted(r.source_index for r in samples.collect()))
        return score_each(samples, *rest)

    def some():
        known = losses()

        def one(ids, r, t):
            if len(r) % 3 == 0:
                raise RuntimeError("no memory")
            return known(ids, r, t)

        return one

    monkeypatch.setattr(scorers, "score_each", counted)
    monkeypatch.setattr(jsonl, "scores", lambda *a, **b: read.append(a) or scores(*a, **b))
    assert score(spark, run, code_points(), some)["failed_records"] == 13
    assert sorted(sum(jobs, [])) == list(range(40)) and len(jobs) <= 8 and not read
    jobs.clear()
    assert score(spark, run, code_points(), losses)["output_records"] == 40
    assert sorted(sum(jobs, [])) == list(range(2, 40, 3)) and len(jobs) <= 8 and len(read) == 1
    assert lengths(out) == {str(i): i + 1 for i in range(40)}
    files = Files(spark)
    for name, whole in (("chunk=0", True), ("chunk=1-3", True), ("chunk=4-9", False)):
        files.write(f"{tmp_path}/parts/{name}/{'_SUCCESS' if whole else 'part-0'}", "")
    assert materialize._scored_chunks(files, f"{tmp_path}/parts") == {0, 1, 2, 3} and files.names(f"{tmp_path}/parts") == ["chunk=0", "chunk=1-3"]


def test_slow_chunks_keep_their_jobs(spark, tmp_path, monkeypatch):
    """Chunks that take long are durable one by one."""
    from lossweave.plans import materialize

    src, jobs, score_each = tmp_path / "in.jsonl", [], scorers.score_each
    src.write_text("".join(json.dumps({"prompt": "p", "response": "r"}) + "\n" for _ in range(6)))
    monkeypatch.setattr(materialize, "JOB_SECONDS", 0)
    monkeypatch.setattr(scorers, "score_each", lambda samples, *rest: jobs.append(samples.count()) or score_each(samples, *rest))
    assert score(spark, Scoring(str(src), str(tmp_path / "out.jsonl"), template="qwen3_nothink", chunk_rows=2), code_points(), losses)["output_records"] == 6
    assert jobs == [2, 2, 2]


def test_files_swap_and_recover(spark, tmp_path):
    files, path = Files(spark), f"file://{tmp_path}/a.json"
    files.write(path, '"é"')
    files.write(path, "2")
    assert files.read(path) == "2" and files.names(f"file://{tmp_path}") == ["a.json"] and files.names(path) is None
    files.rename(path, f"{path}.old")
    files.recover(path)
    assert files.read(path) == "2" and files.fingerprint(path)["size"] == 1
    with pytest.raises(Exception):
        files.swap(f"{path}.missing", path)
    assert files.read(path) == "2"


def test_mask_inputs_are_strict(spark, tmp_path):
    row = json.dumps({"sample_id": "0", "sequence_token_count": 2, "response_token_count": 1, "baseline_response_target_nll_sum": 0.5, "token_scores": [0.5]})
    path = tmp_path / "s.jsonl"
    path.write_text(row + "\n\n" + row.replace('"0"', '"1"') + "\n")
    assert jsonl.scores(spark, str(path)).count() == 2
    with pytest.raises(PySparkException, match="blank score row at line 2"):
        jsonl.scores(spark, str(path), strict=True).collect()


def test_templates_are_resolved(tmp_path):
    model = tmp_path / "run7" / "checkpoint-20"
    model.mkdir(parents=True)
    kind = lambda k: (model / "config.json").write_text(json.dumps({"model_type": k}))
    for k, want in (("codellama", "llama3"), ("gemma3", "gemma3"), ("gemma4_text", "gemma4"), ("mimo", "mimo"), ("qwen2", "qwen3_nothink"), ("qwen3", "qwen3_nothink")):
        kind(k)
        assert resolve(str(model)) == want
    assert resolve(str(model), input_path="/data/OpenMath.jsonl") == "qwen3"
    (tmp_path / "configs" / "selective").mkdir(parents=True)
    (tmp_path / "configs" / "selective" / "run7.yml").write_text("template: mimo  # a remark\n")
    assert resolve(str(model), configs=str(tmp_path / "configs")) == "mimo"
    (model / "training_template.json").write_text('{"training_template": "gemma3"}')
    assert resolve(str(model), configs=str(tmp_path / "configs")) == "gemma3" and resolve(str(model), "llama3") == "llama3"
    (model / "training_template.json").unlink()
    kind("other")
    with pytest.raises(ValueError):
        resolve(str(model))


def test_order_is_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "BLOCK", 3)
    row = lambda i: json.dumps({"sample_id": str(i), "sequence_token_count": 2, "response_token_count": 1, "baseline_response_target_nll_sum": 0.5, "token_scores": [0.5]})
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(map(row, (0, 1, 3, 4, 7, 8, 9))))
    assert jsonl.scores(spark, str(path)).count() == 7
    for bad in ((0, 1, 1), (0, 1, 2, 2, 5), (5, 6, 7, 1), ("x", 1)):
        path.write_text("\n".join(map(row, bad)))
        with pytest.raises(PySparkException):
            jsonl.scores(spark, str(path)).collect()


def test_scores_are_not_moved_to_check_their_order(spark, tmp_path):
    """Only lines' numbers and indices are put in order, however long the rows."""
    path = tmp_path / "s.jsonl"
    path.write_text(json.dumps({"sample_id": "3", "sequence_token_count": 2, "response_token_count": 1, "baseline_response_target_nll_sum": 0.5, "token_scores": [0.5]}))
    plan = jsonl.scores(spark, str(path))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange *\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("token_scores" in x or "value" in x for x in moved)


def test_a_run_moves_and_keeps_little(spark, tmp_path):
    """Samples are kept with places instead of positions, and a score file takes one shuffle of the scores."""
    src, out = tmp_path / "in.jsonl", tmp_path / "out.jsonl"
    src.write_text("".join(json.dumps({"prompt": "p", "response": "r" * 5}) + "\n" for _ in range(3)))

    def gone(ids, r, t):
        raise RuntimeError("the model is gone")

    with pytest.raises(Exception, match="the model is gone"):
        score(spark, Scoring(str(src), str(out), template="qwen3_nothink", fail_fast=True), code_points(), lambda: gone)
    assert not any("positions" in c for c in spark.read.parquet(f"{out}.parts/samples").columns)
    rows = spark.range(20).selectExpr("id as source_index", "array(id) as token_scores")
    ordered = merging.merge([rows], ordered=True).orderBy("source_index")
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert [r.source_index for r in ordered.collect()] == list(range(20))
    column = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32()))
    assert list(scorers._lists(column.slice(1))) == [[1, 2], [], [3]] and list(scorers._lists(pa.array([[1, None], None]))) == [[1, None], None]


def test_scorers(spark):
    grad = scorers.gradient_scorer(lambda ids, t: ({2: -1.25, 3: 2.5}, 3.0))()
    assert grad([1, 2, 3, 4], [2, 3], [2, 3]) == ([1.25, -2.5], 3.0)
    base = {None: [0, 0, 1.0, 2.0, 3.0], 2: [0, 0, 9.0, 1.0, 2.0], 3: [0, 0, 9.0, 9.0, 4.0], 4: []}
    ablate = scorers.ablation_scorer(lambda ids, p: base[p])()
    assert ablate([0] * 5, [2, 3, 4], [2, 3, 4]) == ([-2.0, 1.0, 0.0], 6.0)
    d = spark.createDataFrame([([1e16, 1.0, -1e16],)], "v array<double>")
    assert d.select(scorers.exact_sum("v")).first()[0] == 1.0
    with pytest.raises(ValueError):
        scorers.scorer("other")


def parts(spark, rows):
    return spark.createDataFrame(rows, "source_index long, v string")


def test_merging(spark):
    a, b = parts(spark, [(0, "a"), (2, "c"), (4, "e")]), parts(spark, [(1, "b"), (3, "d"), (4, "e")])
    assert sorted(map(tuple, merging.merge([a, b]).collect())) == list(enumerate("abcde"))
    bad = parts(spark, [(4, "x")])
    assert [(r.source_index, r.variants) for r in merging.conflicts([a, b, bad]).collect()] == [(4, 2)]
    with pytest.raises(PySparkException):
        merging.merge([a, bad]).collect()
    moved = [spark.createDataFrame([(1, *r)], "source_index long, x string, y array<double>") for r in (("a", None), (None, None), ("a", [1.0, None]), ("a", [None, 1.0]))]
    for i, one in enumerate(moved):
        assert merging.merge([one, one]).count() == 1
        for other in moved[:i]:
            with pytest.raises(PySparkException, match="conflicting"):
                merging.merge([one, other]).collect()
    assert [r.source_index for r in merging.pending(a, b).orderBy("source_index").collect()] == [0, 2]
    assert merging.wrong_rank(merging.shard(a, 2).withColumn("rank", F.lit(1)), 2).count() == 3


def test_attach_rejects_foreign_scores(spark):
    rows = spark.range(5).withColumnRenamed("id", "row_index")
    s = spark.createDataFrame([("1", 3, 1, [0.5]), ("3", 3, 1, [0.5])], "sample_id string, sequence_token_count int, response_token_count int, token_scores array<double>")
    assert sorted(r.row_index for r in alignment.attach(rows, s).collect()) == [1, 3]
    for bad in ("5", "-1", "x"):
        with pytest.raises(PySparkException):
            alignment.attach(rows, s.withColumn("sample_id", F.lit(bad))).collect()
    with pytest.raises(ValueError):
        alignment.attach(rows, s.drop("token_scores"))
    with pytest.raises(PySparkException, match="two scores for row 1"):
        alignment.attach(rows, s.union(s.where("sample_id = '1'"))).collect()


def test_settings(tmp_path):
    for bad in ({"ignore_rate": 2.0}, {"ignore_rate": 0.1, "ignore_zero_scores_only": True}, {"ignore_zero_scores_only": True, "train_zero_scores_only": True}, {}, {"ignore_rate": 0.5, "normalization_exponent": 1.5}):
        with pytest.raises(ValueError):
            Selection(score_file="x", **bad)
    with pytest.raises(ValueError):
        Selection(ignore_rate=0.5)
    with pytest.raises(ValueError):
        ScopedSelection(score_file="x", ignore_zero_scores_only=True, random_mask_zero_count=True)
    config, chosen = load("dataset: d\ncutoff_len: 8\nselective_training: {ignore_rate: 0.5, score_file: s}", ["cutoff_len=16", "selective_training.ignore_rate=0.25"])
    assert config == {"dataset": "d", "cutoff_len": 16} and chosen.ignore_rate == 0.25 and chosen.score_path("d", ["d"]) == "s"
    with pytest.raises(ValueError):
        chosen.score_path("d", ["d", "e"])
    with pytest.raises(ValueError):
        guard({"packing": True})
    guard({"stage": "sft"})
    assert Scoring("a", "b.jsonl", method="ablation", ablated_gate_value=0.5, dtype="float32").score_method == "value_gate_0p5_future_response_target_nll_delta_float32_signed_raw_v2"
    for bad in ({"output": "b.txt"}, {"limit": -1}, {"truncate_to_length": 1}, {"truncate_to_length": 100, "max_model_len": 100}):
        with pytest.raises(ValueError):
            Scoring(**{"input": "a", "output": "b.jsonl", **bad})
    Scoring("a", "b.jsonl", limit=0, truncate_to_length=2)
    old = {"input": "/mnt/a/work/x", "n": 1, "attn_implementation": "e"}
    provenance.check_resume(old, {"input": "/data/work/x", "n": 1, "attn_implementation": "f"}, "work")
    with pytest.raises(ValueError):
        provenance.check_resume(old, {**old, "n": 2})
    assert provenance.sibling("/a/b.jsonl", "errors") == "/a/b.errors.jsonl"


def loss_builder(lm_head_chunk_size=0):
    assert lm_head_chunk_size == 7  # as the command line says
    return losses()


def test_command_line(spark, tmp_path, capsys):
    """Scores, then masks, then a training set with a validation split; what cannot be used fails the run."""
    from lossweave import cli

    data = tmp_path / "data"
    data.mkdir()
    rows = [{"prompt": "question", "response": "answer" * (1 + k % 3)} for k in range(20)]
    (data / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (data / "dataset_info.json").write_text(json.dumps({"a": {"file_name": "a.jsonl"}}))
    scores, masks, out = tmp_path / "s.jsonl", tmp_path / "m.jsonl", tmp_path / "out"
    assert cli.main(["score", "entropy", "--input", str(data / "a.jsonl"), "--output", str(scores), "--template", "qwen3_nothink", "--scorer", "tests.test_plans:loss_builder", "--lm-head-chunk-size", "7", "--chunk-rows", "8"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["output_records"] == 20 and said.err.count("of 3 parts") == 3
    assert cli.main(["mask", "--nll", str(scores), "--reference", str(scores), "--output", str(masks), "--progress-interval", "5"]) == 0
    settings = tmp_path / "run.yaml"
    settings.write_text(f"dataset: a\ndataset_dir: {data}\ntemplate: qwen3_nothink\ncutoff_len: 100\noutput_dir: {tmp_path}/model\nval_size: 4\npreprocessing_batch_size: 3\nselective_training: {{ignore_zero_scores_only: true, score_file: {masks}}}\n")
    capsys.readouterr()
    assert cli.main(["select", str(settings), "--output", str(out)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["train"]["samples"], told["validation"]["samples"]) == (16, 4) and (tmp_path / "model" / "chat_template.jinja").exists()
    read = {s: {r.row_index for r in spark.read.parquet(f"{out}/{s}").collect()} for s in ("train", "validation")}
    assert not read["train"] & read["validation"] and read["train"] | read["validation"] == set(range(20))
    with pytest.raises(FileExistsError):
        cli.main(["select", str(settings), "--output", str(out)])
    with pytest.raises(Exception, match="a, [0-9]+: score/tokenization mismatch"):
        cli.main(["select", str(settings), "overwrite_cache=true", "template=qwen3", "--output", str(out)])
    assert spark.read.parquet(f"{out}/train").count() == 16
    assert cli.main(["select", str(settings), "overwrite_cache=true", "val_size=0.0", "--output", str(out)]) == 0
    assert spark.read.parquet(str(out)).count() == 20


def test_token_info(spark):
    from lossweave.functions import tokenizers as K

    d = spark.createDataFrame([("<s>aé日😀",), ("<s>",)], "t string")
    ids = K.code_points()(d.t)
    at = F.transform(F.slice(ids, 4, F.size(ids)), lambda x, i: i + 3)
    for decode in (K.code_point_texts(), K.arrow_texts(lambda rows: [[chr(x - 10) for x in r] for r in rows])):
        got = [[tuple(x) for x in r[0]] for r in d.select(K.token_info(ids, at, decode)).collect()]
        assert got == [[(i, i + 3, ord(c) + 10, c) for i, c in enumerate("aé日😀")], []]
