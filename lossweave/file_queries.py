"""Queries whose rows pass through files: lines, registries, whole scoring and masking runs, resuming.

Each writes its files to a fresh folder that all executors share and returns
what is read back from the published ones.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.functions import tokenizers as K
from lossweave.operators import merging, scorers
from lossweave.plans import provenance
from lossweave.plans.config import Scoring
from lossweave.plans.materialize import materialize_masks, score
from lossweave.queries import _SC, _add, _score_rows, _table, scored
from lossweave.sources import jsonl, publish, registry
from lossweave.sources.files import Files, scratch

CODE_POINTS = K.code_points()
MAX_LEN = 20_000


def _input(spark: SparkSession, sf_dir: str) -> str:
    """Documents as a JSONL file, one line each in the order of their ids; every sixth blank, broken, without response, or as messages."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("lang", F.lit("none")).alias("l"))
    k, text, lang = F.col("doc_id") % 6, F.col("t"), F.col("l")
    said = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    line = (F.when(k == 0, F.to_json(F.struct(lang.alias("prompt"), text.alias("response"))))
            .when(k == 1, F.to_json(F.struct(lang.alias("problem"), text.alias("generated_solution"))))
            .when(k == 2, F.lit("")).when(k == 3, F.concat(F.lit("{"), lang)).when(k == 4, F.to_json(F.struct(lang.alias("prompt"))))
            .otherwise(F.to_json(F.struct(F.array(said("system", lang), said("user", lang), said("assistant", text)).alias("messages")))))
    path = f"{scratch(spark, 'run')}/in.jsonl"
    d.select("doc_id", line.alias("value")).orderBy("doc_id").select("value").write.text(path)
    return path


# The same in SQL: n (line, kind, prompt, response, number of tokens or null), r (good rows).
_RUN = f"""
n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id % 6 AS k, coalesce(lang, 'none') AS l, coalesce(text, '') AS t FROM documents),
q AS (SELECT *, length('<|im_start|>user' || chr(10) || l || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) + CASE WHEN k = 5 THEN length('<|im_start|>system' || chr(10) || l || '<|im_end|>' || chr(10)) ELSE 0 END AS lead FROM n),
e AS (SELECT *, CASE WHEN k = 2 THEN 'ValueError' WHEN k = 3 THEN 'JSONDecodeError' WHEN k = 4 THEN 'ValueError' WHEN regexp_full_match(t, '\\s*') THEN 'EmptyResponseError'
      WHEN lead + length(t) + length('<|im_end|>' || chr(10)) >= {MAX_LEN} THEN 'SequenceTooLongError' END AS error_type FROM q),
r AS (SELECT *, list_transform(string_split(t, ''), lambda c: (unicode(c) + 10) % 5) AS s FROM e WHERE error_type IS NULL)"""
_ROWS = """SELECT CAST(i AS VARCHAR) AS sample_id, CAST(lead + length(t) + length('<|im_end|>' || chr(10)) AS INT) AS sequence_token_count, CAST(length(t) AS INT) AS response_token_count,
CAST(list_sum(s) AS DOUBLE) AS score_sum, sha256(array_to_string(list_transform(s, lambda x: CAST(x AS VARCHAR)), '')) AS scores FROM r"""


def _losses(ids: list[int]) -> list[float]:
    return [float(x % 5) for x in ids]


def _only(left: int | None):
    """A scorer that fails on samples by the remainder of their length: on those of ``left``, or on all others."""
    def build():
        known = scorers.losses_scorer(_losses)()

        def one(ids, r, t):
            if (len(ids) % 3 == 0) == (left == 0):
                raise RuntimeError("out of memory, say")
            return known(ids, r, t)

        return one

    return build


def _published(spark: SparkSession, path: str) -> DataFrame:
    s = jsonl.scores(spark, path)
    digits = F.array_join(F.transform("token_scores", lambda x: x.cast("int").cast("string")), "")
    return s.select("sample_id", "sequence_token_count", "response_token_count", F.aggregate("token_scores", F.lit(0.0), lambda a, x: a + x).alias("score_sum"), F.sha2(digits, 256).alias("scores"))


def _plan(spark: SparkSession, sf_dir: str, **options) -> Scoring:
    path = _input(spark, sf_dir)
    return Scoring(path, path.replace("in.jsonl", "out.jsonl"), template="qwen3_nothink", max_model_len=MAX_LEN, chunk_rows=400, **options)


def _run(spark: SparkSession, sf_dir: str, **options) -> tuple[Scoring, dict]:
    run = _plan(spark, sf_dir, **options)
    return run, score(spark, run, CODE_POINTS, scorers.losses_scorer(_losses))


@_add("q_file_lines", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_index, sha256(coalesce(text, '')) AS line FROM documents QUALIFY line_index >= 5 AND line_index < 705 AND line_index % 3 = 1")
def q_file_lines(spark, sf_dir):
    """Numbered lines of a file of many parts, the range and rank taken before any parsing."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    path = f"{scratch(spark, 'lines')}/in.jsonl"
    d.select("doc_id", F.to_json(F.struct("t")).alias("value")).orderBy("doc_id").select("value").write.text(path)
    some = jsonl.strict(jsonl.in_range(jsonl.lines(spark, path), 5, 700, 1, 3))
    return some.select("line_index", F.sha2(F.variant_get("record", "$.t", "string"), 256).alias("line"))


@_add("q_file_registry", """SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS row_index, doc_id FROM documents""")
def q_file_registry(spark, sf_dir):
    """Named datasets of a registry: JSONL parts in a folder, and one JSON array."""
    d = _table(spark, sf_dir, "documents").select("doc_id")
    root, files = scratch(spark, "data"), Files(spark)
    even = d.where("doc_id % 2 = 0").select("doc_id", F.to_json(F.struct("doc_id")).alias("value")).orderBy("doc_id")
    edge = even.agg(F.expr("percentile_approx(doc_id, 0.4)")).first()[0] or 0
    for k, part in enumerate((even.where(F.col("doc_id") <= edge), even.where(F.col("doc_id") > edge))):
        part.orderBy("doc_id").select("value").write.text(f"{root}/even/{k}.parts")
        files.join(f"{root}/even/{k}.parts", f"{root}/even/{k}.jsonl")
        files.delete(f"{root}/even/{k}.parts")
    odd = d.where("doc_id % 2 = 1").agg(F.to_json(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: F.struct(x.alias("doc_id")))).alias("value"))
    odd.coalesce(1).write.text(f"{root}/odd.parts")
    files.join(f"{root}/odd.parts", f"{root}/odd.json")
    files.write(f"{root}/dataset_info.json", json.dumps({"even": {"file_name": "even"}, "odd": {"file_name": "odd.json"}}))
    parts = [registry.rows(spark, f"{root}/{x['file_name']}").withColumn("dataset", F.lit(x["name"])) for x in registry.lookup(registry.load(spark, f"{root}/dataset_info.json"), ["even", "odd"])]
    return merging.combine(parts).select("dataset", "row_index", F.variant_get("record", "$.doc_id", "long").alias("doc_id"))


@_add("q_run_scores", f"WITH {_RUN} {_ROWS}")
def q_run_scores(spark, sf_dir):
    """A whole scoring run, read back from the published file."""
    return _published(spark, _run(spark, sf_dir)[0].output)


@_add("q_run_errors", f"WITH {_RUN} SELECT i AS source_index, i + 1 AS line_number, CAST(i AS VARCHAR) AS sample_id, error_type FROM e WHERE error_type IS NOT NULL")
def q_run_errors(spark, sf_dir):
    """The error file of a run."""
    return jsonl.errors(spark, provenance.sibling(_run(spark, sf_dir)[0].output, "errors")).select("source_index", "line_number", "sample_id", "error_type")


@_add("q_run_manifest", f"""WITH {_RUN} SELECT count(*) AS total_records, least(count(*), 150) AS end_index, count(*) FILTER (i >= 10 AND i < 150 AND error_type IS NULL) AS output_records,
count(*) FILTER (i >= 10 AND i < 150 AND error_type IS NOT NULL) AS error_records, 'per_response_content_token_negative_log_likelihood' AS score_semantics, 'token_nll' AS scorer_kind FROM e""")
def q_run_manifest(spark, sf_dir):
    """The manifest of a run over lines 10..149."""
    run, _ = _run(spark, sf_dir, start_index=10, limit=140)
    m = json.loads(Files(spark).read(provenance.sibling(run.output, "manifest")))
    names = ("total_records", "end_index", "output_records", "error_records", "score_semantics", "scorer_kind")
    return spark.createDataFrame([tuple(m[k] for k in names)], "total_records long, end_index long, output_records long, error_records long, score_semantics string, scorer_kind string")


@_add("q_run_resumed", f"WITH {_RUN} {_ROWS}")
def q_run_resumed(spark, sf_dir):
    """A run whose scorer fails on a third of the samples, then one that scores what is left and fails on anything else."""
    run = _plan(spark, sf_dir)
    score(spark, run, CODE_POINTS, _only(0))
    score(spark, replace(run, fail_fast=True), CODE_POINTS, _only(None))
    return _published(spark, run.output)


@_add("q_mask_file", f"WITH {_SC} SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg(CASE WHEN rk <= k THEN '0' ELSE '1' END, '' ORDER BY i) AS mask FROM (SELECT *, count(*) FILTER (x <= 0) OVER (PARTITION BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY (conv_id * 13 + i * 29) % 17, i) AS rk FROM u) GROUP BY conv_id")
def q_mask_file(spark, sf_dir):
    """Count-matched masks from two score files, published and read back; the second call finds them finished."""
    root = scratch(spark, "masks")
    rows = _score_rows(spark, sf_dir).where("response_token_count > 0")
    publish.write_ordered(rows, f"{root}/reference.jsonl")
    publish.write_ordered(rows.withColumn("token_scores", F.transform("token_scores", lambda _, i: ((F.col("source_index") * 13 + i * 29) % 17) / F.lit(8.0))), f"{root}/nll.jsonl", single=True)
    n = scored(spark, sf_dir).where(F.size("s") > 0).count()
    done = materialize_masks(spark, f"{root}/nll.jsonl", f"{root}/reference.jsonl", f"{root}/masks.jsonl", n)
    assert materialize_masks(spark, f"{root}/nll.jsonl", f"{root}/reference.jsonl", f"{root}/masks.jsonl") == done
    digits = F.array_join(F.transform("token_scores", lambda x: x.cast("int").cast("string")), "")
    return jsonl.scores(spark, f"{root}/masks.jsonl").select("sample_id", digits.alias("mask"))


@_add("q_merge_nulls", "SELECT doc_id AS source_index, CASE WHEN doc_id % 3 <> 0 THEN lang END AS a, CASE WHEN doc_id % 5 <> 0 THEN source END AS b FROM documents")
def q_merge_nulls(spark, sf_dir):
    """Parts that overlap, with nulls in any place: equal rows by value are one."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("a"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("b"))
    return merging.merge([d.where("source_index % 2 = 0"), d.where("source_index % 3 > 0"), d])


@_add("q_conflicting_nulls", "SELECT doc_id AS source_index, CAST(2 AS BIGINT) AS variants FROM documents WHERE doc_id % 7 = 0")
def q_conflicting_nulls(spark, sf_dir):
    """Rows that differ only by where their null stands conflict."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"))
    one, none = F.lit("x"), F.lit(None).cast("string")
    moved = F.col("source_index") % 7 == 0
    return merging.conflicts([d.select("source_index", one.alias("a"), none.alias("b")), d.select("source_index", F.when(moved, none).otherwise(one).alias("a"), F.when(moved, one).alias("b"))])
