"""Selection, sequences and records against hand-computed cases and plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lossweave.functions import ranking as R
from lossweave.functions import sequences as S
from lossweave.functions import templates as T
from lossweave.functions.tokenizers import arrow, code_points
from lossweave.operators import records, selection
from lossweave.plans.config import ScopedSelection, Selection


def arrays(spark, *columns):
    names = [f"c{i}" for i in range(len(columns))]
    kinds = ["array<boolean>" if c and isinstance(c[0], bool) else "array<int>" if c and isinstance(c[0], int) else "array<double>" for c in columns]
    return spark.createDataFrame([columns], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def on(mask):
    return {i for i, x in enumerate(mask) if x}


@pytest.mark.parametrize("nll,ref,want", [([4.0, 1.0, 3.0, 2.0], [2.0, -1.0, 0.0, 3.0], {1, 3}), ([1.0, 1.0, 1.0, 2.0], [-1.0, 1.0, 1.0, 1.0], {0}), ([1.0, 2.0], [1.0, 1.0], set()), ([1.0, 2.0], [0.0, -1.0], {0, 1})])
def test_count_matched(spark, nll, ref, want):
    assert on(arrays(spark, nll, ref).select(R.count_matched(F.col("c0"), F.col("c1"))).first()[0]) == want


def test_modes(spark):
    d = arrays(spark, [0.0, -0.2, 0.0, 0.1])
    every = R.all_of(F.col("c0"))
    r = d.select(R.nonpositive(F.col("c0"), every), R.nonzero(F.col("c0"), every), R.positive(F.col("c0"), every), R.normalized(F.col("c0"), 1.0)).first()
    assert (on(r[0]), on(r[1]), on(r[2])) == ({0, 1, 2}, {1, 3}, {3})
    assert arrays(spark, [4.0, 1.0]).select(R.normalized(F.col("c0"), 0.5)).first()[0] == pytest.approx([4 / math.sqrt(2), 1.0])


def test_bottom_fraction(spark):
    d = arrays(spark, [0.0, 0.0, 2.0, 1.0, 3.0])
    assert on(d.select(R.bottom_fraction(F.col("c0"), R.all_of(F.col("c0")), 0.41, 0.0)).first()[0]) == {0, 1, 3}
    assert d.select(R.rate_too_small(F.col("c0"), R.all_of(F.col("c0")), 0.39)).first()[0]
    d = arrays(spark, [4.0, 3.0, 2.0, 0.0], [True, True, False, False])
    assert on(d.select(R.bottom_fraction(F.col("c0"), F.col("c1"), 0.5, 1.0)).first()[0]) == {0}


def test_lowest_equals_sorting(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        n = rng.randint(1, 12)
        rows.append(([rng.choice([0.0, -0.0, 1.0, -1.5, 2.25]) for _ in range(n)], [rng.random() < 0.7 for _ in range(n)], rng.randint(0, n)))
    d = spark.createDataFrame(rows, "v array<double>, ok array<boolean>, k int").select("*", R.lowest(F.col("v"), F.col("ok"), F.col("k")).alias("m"))
    for r in d.collect():
        some = [i for i in range(len(r.v)) if r.ok[i]]
        k = min(r.k, len(some))
        if r.k <= len(some):
            assert on(r.m) == set(sorted(some, key=lambda i: (r.v[i], i))[:k])


def test_random_control(spark):
    s = [5.0, 0.0, 2.0, -0.1, 3.0]
    d = arrays(spark, s, [False, True, True, True, True])
    got = on(d.select(R.random_control(F.col("c0"), F.col("c1"), F.lit("random-count"), 42)).first()[0])
    rank = sorted([1, 2, 3, 4], key=lambda i: (hashlib.sha256(f"42\0random-count\0{i}".encode()).digest(), i))
    assert got == set(rank[:2])


@pytest.mark.parametrize("ids,want", [([30, 7, 8, 31, 9], {1, 2}), ([7, 8, 31], set()), ([30, 7, 8, 9], {1, 2, 3}), ([31, 30, 5, 31, 30, 6, 31], {2})])
def test_think_span(spark, ids, want):
    assert on(arrays(spark, ids, [30], [31]).select(R.think_span(F.col("c0"), F.col("c1"), F.col("c2"))).first()[0]) == want


def test_fitted_lengths(spark):
    def plain(s, t, c):
        most = c if t * 2 < c else c - s if s * 2 < c else int(c * (t / (s + t)))
        k = min(most, t)
        return min(max(c - k, 0), s), k

    ks, kt = S.fitted_lengths(F.col("s"), F.col("t"), F.col("c"))
    rows = [(s, t, c) for s in range(0, 30, 3) for t in range(0, 30, 2) for c in range(1, 50, 4)]
    for r in spark.createDataFrame(rows, "s int, t int, c int").select("*", ks.alias("ks"), kt.alias("kt")).collect():
        assert (r.ks, r.kt) == plain(r.s, r.t, r.c)


PAIR = "encoded array<struct<source:array<int>,target:array<int>,content:int>>, _selection_sequence_token_count int, _selection_response_token_count int, _selection_token_scores array<double>, _selection_sample_id string"


def examples(spark, turns, seq, resp, scores, config, cutoff=16, encode=None, **more):
    d = spark.createDataFrame([(turns, seq, resp, scores, "7")], PAIR)
    return selection.train_examples(d, config, cutoff, encode, **more).first()


@pytest.mark.parametrize("mode,scores,cutoff,counts,ids,labels,n", [
    ("ignore_zero_scores_only", [0.0, -1.0], 16, (5, 2), [10, 11, 20, 21, 99], [-100, -100, -100, -100, 99], (2, 2)),
    ("train_zero_scores_only", [0.0, 1.0], 16, (5, 2), [10, 11, 20, 21, 99], [-100, -100, 20, -100, 99], (2, 1)),
    ("ignore_zero_scores_only", [0.0, 1.0], 4, (4, 2), [10, 11, 20, 21], [-100, -100, -100, 21], (2, 1))])
def test_labels(spark, mode, scores, cutoff, counts, ids, labels, n):
    r = examples(spark, [([10, 11], [20, 21, 99], 2)], *counts, scores, Selection(score_file="x", **{mode: True}), cutoff)
    assert (r.input_ids, r.labels, r.attention_mask, (r.n_retained, r.n_ignored)) == (ids, labels, [1] * len(ids), n)


def test_labels_think_scope(spark):
    encode = lambda text: F.when(text == "<think>", F.array(F.lit(30))).otherwise(F.array(F.lit(31)))
    r = examples(spark, [([10, 11], [30, 20, 21, 31, 22, 23, 99], 6)], 9, 6, [5.0, 0.0, 2.0, 5.0, -0.1, 0.0], ScopedSelection(score_file="x", ignore_zero_scores_only=True), encode=encode)
    assert (r.labels, r.n_retained, r.n_ignored) == ([-100, -100, 30, -100, 21, 31, 22, 23, 99], 6, 1)


def test_labels_of_several_turns(spark):
    turns = [([1, 2], [3, 4, 99], 2), ([5], [6, 7, 8, 99], 3), ([9], [10, 99], 1)]
    config = Selection(score_file="x", ignore_zero_scores_only=True)
    r = examples(spark, turns, 13, 6, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], config, 100, eos=77)
    assert r.error == "score/tokenization mismatch"
    full = sum(len(s) + len(t) for s, t, _ in turns)
    r = examples(spark, turns, full, 6, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], config, 100)
    assert r.labels == [-100, -100, 3, -100, 99, -100, -100, 7, -100, 99, -100, -100, 99] and (r.n_retained, r.n_ignored) == (6, 4)
    r = examples(spark, turns, full + 1, 6, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], config, 100, eos=77)
    assert r.labels[-1] == 77 and r.input_ids[-1] == 77
    cut = examples(spark, turns, full, 6, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], config, 8)
    assert len(cut.input_ids) <= 8 and cut.n_retained < 6
    assert examples(spark, turns, full, 6, [float("nan")] * 6, config, 100).error
    assert examples(spark, turns, full, 6, [1.0] * 5, config, 100).error == "score array length mismatch"


LINES = ['{"prompt":"a","response":"b"}', "", "  ", "{bad", "[1]", '{"prompt":5,"instruction":"x","output":"y"}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"},{"role":"assistant","content":"b"}]}',
         '{"messages":[{"role":"user","content":"q"},{"role":"system","content":"s"},{"role":"assistant","content":"a"}]}', '{"messages":[{"role":"tool","content":"q"}]}', '{"messages":[{"role":"user","content":3}]}', '{"messages":["x"]}',
         '{"prompt":"a","response":"\\u00a0\\t"}', '{"system":1,"prompt":"a","response":"b"}', '{"messages":[{"role":"system","content":"s1"},{"role":"system","content":"s2"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"system":"no"}', '{"messages":[],"problem":"p","generated_solution":"g","system":"yes"}', '{"prompt":"a"}', "null"]
KINDS = [None, "blank line", "blank line", "malformed JSON", "record is not an object", None, "incomplete user/assistant pairs", "system message after the first turn", "unsupported message role", "every message content must be a string", "every message must be an object",
         "assistant response is empty", "system must be a string", None, None, "no response field", "record is not an object"]


def test_records(spark):
    d = spark.createDataFrame(list(enumerate(LINES)), "source_index long, value string")
    out = records.conversations(records.parse(d)).orderBy("source_index").collect()
    assert [r.error for r in out] == KINDS
    assert out[13].system == "s1\n\ns2" and out[14].system == "yes" and [tuple(t) for t in out[5].turns] == [("x", "y")]
    good, bad = records.split_errors(records.conversations(records.parse(d)).withColumn("sample_id", F.col("source_index").cast("string")))
    assert good.count() == 4 and {(r.source_index, r.line_number) for r in bad.collect()} == {(i, i + 1) for i, k in enumerate(KINDS) if k}
    long = records.encode(records.conversations(records.parse(d)), "qwen3_nothink", code_points(), max_len=10).where("source_index = 0").first()
    assert long.error_type == "SequenceTooLongError"
    g = records.encode(records.conversations(records.parse(d)), "gemma4", code_points(), bos=1).where("source_index = 0").first()
    assert g.error_type == "ValueError"


def test_gemma3_ids(spark):
    d = spark.createDataFrame([([("hi", "yo")], "be brief")], "turns array<struct<user:string,assistant:string>>, system string")
    e = d.select(S.encoded_turns(F.col("turns"), F.col("system"), "gemma3", code_points(), bos=1).alias("e")).first().e[0]
    ids = lambda t: [ord(c) + 10 for c in t]
    assert e.source == [1, *ids("<start_of_turn>user\nbe brief\n\nhi<end_of_turn>\n<start_of_turn>model\n")]
    assert e.target == ids("yo<end_of_turn>\n") and e.content == 2
    assert d.select(S.end_isolated(S.encoded_turns(F.col("turns"), F.col("system"), "gemma3", code_points()), "gemma3", code_points())).first()[0]


def test_arrow_tokenizer(spark):
    encode = arrow(lambda texts: [[len(w) for w in t.split()] for t in texts])
    assert spark.createDataFrame([("ab c",), (None,)], "t string").select(encode(F.col("t")).alias("x")).collect()[0].x == [2, 1]


def test_templates():
    assert set(T.TEMPLATES) == {"gemma3", "gemma4", "llama3", "mimo", "qwen3", "qwen3_nothink"}
    assert T.resolve("", "qwen3") == "qwen3"
    with pytest.raises(ValueError):
        T.resolve("", "other")
