"""Queries over the fixture tables, each with the SQL that gives the same rows.

Scores are dyadic functions of sample, position and token length, so that both
engines hold them exactly; masks are shown as strings of 0 and 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossweave.functions import ranking as R
from lossweave.functions import sequences as S
from lossweave.functions import templates as T
from lossweave.functions import tokenizers as K
from lossweave.operators import alignment, merging, records, scorers, selection
from lossweave.plans.config import ScopedSelection, Selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CODE_POINTS = K.code_points()


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turns, system, error of every conversation; a conversation is as long as one sample, so it is gathered."""
    c = _table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    typed = F.transform("m", lambda x: F.struct(F.lit(True).alias("object"), x["role"].alias("role"), x["text"].alias("content")))
    m = m.select("conv_id", typed.alias("typed"))
    talk = F.transform(F.filter("typed", lambda x: x["role"] != "system"), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    said = F.transform(F.filter("typed", lambda x: x["role"] == "system"), lambda x: x["content"])
    m = m.withColumns({"talk": talk, "system": F.when(F.size(said) > 0, F.array_join(said, "\n\n"))})
    m = m.withColumn("error", F.coalesce(records.message_error(F.col("typed")), records.pairing_error(F.col("talk"))))
    empty = F.exists("talk", lambda x: (x["role"] == "assistant") & x["content"].rlike(records.BLANK))
    m = m.withColumn("error", F.coalesce("error", F.when(empty, "assistant response is empty")))
    return m.withColumn("turns", F.when(F.col("error").isNull(), records.turns_of(F.col("talk")))).drop("typed", "talk")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, tok (pieces of all responses), s (scores) of valid conversations."""
    v = samples(spark, sf_dir).where("error is null")
    v = v.select("conv_id", F.flatten(F.transform("turns", lambda t: K.pieces(t["assistant"]))).alias("tok"))
    return v.withColumn("s", F.transform("tok", lambda w, i: ((F.col("conv_id") * 31 + i * 17 + F.length(w) * 7) % 21 - 10) / F.lit(4.0)))


def shown(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda x: x.cast("int").cast("string")), "")


# The same in SQL: e (samples), sc (scores), u (one row a token).
_E = r"""
m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, m, list_filter(m, lambda x: x.role <> 'system') AS c, list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: x.content) AS sy FROM m),
e AS (SELECT conv_id, c, CASE WHEN len(sy) > 0 THEN array_to_string(sy, chr(10) || chr(10)) END AS system,
      CASE WHEN len(list_filter(range(2, len(m) + 1), lambda i: m[i].role = 'system' AND m[i - 1].role <> 'system')) > 0 THEN 'system message after the first turn'
           WHEN len(c) = 0 OR len(c) % 2 <> 0 THEN 'incomplete user/assistant pairs'
           WHEN len(list_filter(range(1, len(c) + 1), lambda i: c[i].role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'roles do not alternate'
           WHEN len(list_filter(c, lambda x: x.role = 'assistant' AND trim(x.content) = '')) > 0 THEN 'assistant response is empty' END AS error FROM c)"""
_SC = _E + r""",
t AS (SELECT conv_id, flatten(list_transform(list_filter(c, lambda x: x.role = 'assistant'), lambda x: list_filter(regexp_split_to_array(x.content, '[ \t\n\r]+'), lambda w: w <> ''))) AS tok FROM e WHERE error IS NULL),
sc AS (SELECT conv_id, tok, list_transform(tok, lambda w, i: ((conv_id * 31 + (i - 1) * 17 + length(w) * 7) % 21 - 10) / CAST(4.0 AS DOUBLE)) AS s FROM t),
u AS (SELECT conv_id, unnest(tok) AS w, unnest(s) AS x, unnest(range(len(s))) AS i, len(s) AS n FROM sc)"""


@_add("q_conv_validate", f"WITH {_E} SELECT conv_id, error, CAST(CASE WHEN error IS NULL THEN len(c) // 2 END AS INT) AS n_turns FROM e")
def q_conv_validate(spark, sf_dir):
    return samples(spark, sf_dir).select("conv_id", "error", F.size("turns").alias("n_turns"))


@_add("q_error_counts", f"WITH {_E} SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM e GROUP BY 1")
def q_error_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


def _record_lines(spark, sf_dir):
    """Documents as JSON lines whose field names and types vary with the id."""
    d = _table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    text, lang = F.col("text"), F.coalesce("lang", F.lit("none"))
    line = (F.when(k == 0, F.to_json(F.struct(text.alias("prompt"), lang.alias("response"))))
            .when(k == 1, F.to_json(F.struct(text.alias("problem"), lang.alias("generated_solution"))))
            .when(k == 2, F.to_json(F.struct(F.col("doc_id").alias("prompt"), text.alias("instruction"), lang.alias("output"))))
            .when(k == 3, F.to_json(F.struct(F.col("doc_id").alias("prompt"), lang.alias("response"))))
            .when(k == 4, F.to_json(F.struct(text.alias("prompt"))))
            .otherwise(F.to_json(F.struct(text.alias("prompt"), F.lit(" \t ").alias("response")))))
    return d.select("doc_id", line.alias("value"))


@_add("q_fields_coalesce", """SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'no prompt field' WHEN doc_id % 6 = 4 THEN 'no response field' WHEN doc_id % 6 = 5 THEN 'assistant response is empty' END AS error,
CASE WHEN doc_id % 6 < 3 THEN sha256(text) END AS prompt, CASE WHEN doc_id % 6 < 3 THEN coalesce(lang, 'none') END AS response FROM documents""")
def q_fields_coalesce(spark, sf_dir):
    out = records.conversations(records.parse(_record_lines(spark, sf_dir)))
    turn = F.get("turns", F.lit(0))
    return out.select("doc_id", "error", F.sha2(turn["user"], 256).alias("prompt"), turn["assistant"].alias("response"))


@_add("q_too_long_filter", f"""WITH {_E} SELECT conv_id, CASE WHEN n >= 3000 THEN 'SequenceTooLongError' END AS error_type, CAST(n AS INT) AS n_tokens FROM
(SELECT conv_id, coalesce(length('<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10)), 0) + list_sum(list_transform(c, lambda x: length(x.content) + CASE WHEN x.role = 'user' THEN length('<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) ELSE length('<|im_end|>' || chr(10)) END)) AS n FROM e WHERE error IS NULL)""")
def q_too_long_filter(spark, sf_dir):
    v = samples(spark, sf_dir).where("error is null").withColumn("error_type", F.lit(None).cast("string"))
    out = records.encode(v, "qwen3_nothink", CODE_POINTS, max_len=3000)
    return out.select("conv_id", "error_type", F.size("token_ids").alias("n_tokens"))


def _rendered(name: str):
    def run(spark, sf_dir):
        v = samples(spark, sf_dir).where("error is null")
        end = T.TEMPLATES[name].end
        text = F.concat(T.system_block(name, F.col("system")), F.array_join(F.transform("turns", lambda t, i: F.concat(T.prompt_text(name, t["user"], F.col("system"), i == 0), T.response_text(name, t["assistant"]), F.lit(end))), ""))
        return v.select("conv_id", F.sha2(text, 256).alias("rendered"), F.char_length(text).cast("long").alias("n_chars"))

    return run


def _rendered_sql(system: str, user: str, response: str) -> str:
    """system: text before the first turn; user, response: of message x at place i (1-based)."""
    return f"""WITH {_E}, r AS (SELECT conv_id, ({system}) || array_to_string(list_transform(c, lambda x, i: CASE WHEN x.role = 'user' THEN {user} ELSE {response} END), '') AS t FROM e WHERE error IS NULL)
SELECT conv_id, sha256(t) AS rendered, length(t) AS n_chars FROM r"""


_NL = "chr(10)"
_IM_USER = f"'<|im_start|>user' || {_NL} || x.content || '<|im_end|>' || {_NL} || '<|im_start|>assistant' || {_NL}"
_IM_SYSTEM = f"'<|im_start|>system' || {_NL} || %s || '<|im_end|>' || {_NL}"
_BARE = "NOT contains(x.content, '<think>') AND NOT contains(x.content, '</think>')"
_THINK = f"CASE WHEN {_BARE} THEN '<think>' || {_NL} || {_NL} || '</think>' || {_NL} || {_NL} ELSE '' END || x.content || '<|im_end|>' || {_NL}"
_DEFAULT = "coalesce(nullif(system, ''), 'You are a helpful assistant.')"
for _name, _sql in {
    "qwen3": _rendered_sql(f"coalesce({_IM_SYSTEM % 'system'}, '')", _IM_USER, _THINK),
    "qwen3_nothink": _rendered_sql(f"coalesce({_IM_SYSTEM % 'system'}, '')", _IM_USER, f"x.content || '<|im_end|>' || {_NL}"),
    "mimo": _rendered_sql(_IM_SYSTEM % _DEFAULT, _IM_USER, _THINK),
    "llama3": _rendered_sql(f"coalesce('<|start_header_id|>system<|end_header_id|>' || {_NL} || {_NL} || system || '<|eot_id|>', '')", f"'<|start_header_id|>user<|end_header_id|>' || {_NL} || {_NL} || x.content || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {_NL} || {_NL}", "x.content || '<|eot_id|>'"),
    "gemma3": _rendered_sql("''", f"'<start_of_turn>user' || {_NL} || CASE WHEN i = 1 THEN coalesce(system || {_NL} || {_NL}, '') ELSE '' END || x.content || '<end_of_turn>' || {_NL} || '<start_of_turn>model' || {_NL}", f"x.content || '<end_of_turn>' || {_NL}"),
    "gemma4": _rendered_sql(f"'<|turn>system' || {_NL} || '<|think|>' || {_DEFAULT} || '<turn|>' || {_NL}", f"'<|turn>user' || {_NL} || x.content || '<turn|>' || {_NL} || '<|turn>model' || {_NL}", f"x.content || '<turn|>' || {_NL}"),
}.items():
    _add(f"q_template_{_name}", _sql)(_rendered(_name))


@_add("q_native_thought", """WITH d AS (SELECT doc_id, doc_id % 6 AS k, coalesce(text, '') AS t, '<|channel>thought' || chr(10) AS o, '<channel|>' AS c FROM documents),
x AS (SELECT doc_id, o, c, CASE k WHEN 0 THEN o || t || c || t WHEN 1 THEN ' ' || o || t || c WHEN 2 THEN o || t || c || t || o || t || c WHEN 3 THEN o || t || c || '<think>' || t WHEN 4 THEN o || t ELSE t END AS r FROM d)
SELECT doc_id, starts_with(r, o) AND (length(r) - length(replace(r, o, ''))) / length(o) = 1 AND (length(r) - length(replace(r, c, ''))) / length(c) = 1 AND NOT contains(r, '<think>') AND NOT contains(r, '</think>') AS ok FROM x""")
def q_native_thought(spark, sf_dir):
    """Blocks around the whole text: sound, after a space, twice, with foreign tags, open, absent."""
    d = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    t, opened, closed = F.col("t"), F.lit(T.THOUGHT_OPEN), F.lit(T.THOUGHT_CLOSE)
    block = F.concat(opened, t, closed)
    text = (F.when(F.col("k") == 0, F.concat(block, t)).when(F.col("k") == 1, F.concat(F.lit(" "), block)).when(F.col("k") == 2, F.concat(block, t, block))
            .when(F.col("k") == 3, F.concat(block, F.lit("<think>"), t)).when(F.col("k") == 4, F.concat(opened, t)).otherwise(t))
    return d.select("doc_id", T.native_thought_ok(text).alias("ok"))


@_add("q_infer_seqlen", """WITH g AS (SELECT s, t, c FROM (SELECT unnest(range(0, 41)) AS s), (SELECT unnest(range(0, 41)) AS t), (SELECT unnest(range(1, 61)) AS c)),
k AS (SELECT s, t, c, least(CASE WHEN t * 2 < c THEN c WHEN s * 2 < c THEN c - s ELSE CAST(floor(CAST(c AS DOUBLE) * (CAST(t AS DOUBLE) / CAST(s + t AS DOUBLE))) AS INT) END, t) AS kt FROM g)
SELECT CAST(s AS INT) AS s, CAST(t AS INT) AS t, CAST(c AS INT) AS c, CAST(least(greatest(c - kt, 0), s) AS INT) AS ks, CAST(kt AS INT) AS kt FROM k""")
def q_infer_seqlen(spark, sf_dir):
    g = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(40))).alias("s")).select("s", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("t")).select("s", "t", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("c"))
    ks, kt = S.fitted_lengths(F.col("s"), F.col("t"), F.col("c"))
    return g.select("s", "t", "c", ks.alias("ks"), kt.alias("kt"))


# Turns by code points under a budget: tl (lengths), rec (kept lengths), for qwen3_nothink.
_CUT = 900
_REC = _E.replace("\nm AS", "RECURSIVE m AS", 1) + f""",
tl AS (SELECT conv_id, t, c[2 * t + 1].content AS ut, c[2 * t + 2].content AS rt, CASE WHEN t = 0 THEN coalesce('<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10), '') ELSE '' END
         || '<|im_start|>user' || chr(10) || c[2 * t + 1].content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS src, c[2 * t + 2].content || '<|im_end|>' || chr(10) AS tgt
       FROM (SELECT conv_id, c, system, unnest(range(len(c) // 2)) AS t FROM e WHERE error IS NULL)),
ln AS (SELECT conv_id, t, length(src) AS s, length(tgt) AS g, length(rt) AS c, coalesce(sum(length(rt)) OVER (PARTITION BY conv_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM tl),
rec(conv_id, t, used, ks, kt) AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ln
  UNION ALL SELECT r.conv_id, l.t, r.used + least(greatest(({_CUT} - r.used) - x.kt, 0), l.s) + x.kt, least(greatest(({_CUT} - r.used) - x.kt, 0), l.s), x.kt
  FROM rec r JOIN ln l ON l.conv_id = r.conv_id AND l.t = r.t + 1,
  LATERAL (SELECT least(CASE WHEN l.g * 2 < {_CUT} - r.used THEN {_CUT} - r.used WHEN l.s * 2 < {_CUT} - r.used THEN {_CUT} - r.used - l.s
           ELSE CAST(floor(CAST({_CUT} - r.used AS DOUBLE) * (CAST(l.g AS DOUBLE) / CAST(l.s + l.g AS DOUBLE))) AS BIGINT) END, l.g) AS kt) x WHERE r.used < {_CUT})"""


def _encoded(spark, sf_dir):
    v = samples(spark, sf_dir).where("error is null")
    return v.select("conv_id", S.encoded_turns(F.col("turns"), F.col("system"), "qwen3_nothink", CODE_POINTS).alias("encoded"))


@_add("q_truncate_multiturn", f"""WITH {_REC} SELECT r.conv_id, CAST(r.t AS INT) AS turn, CAST(r.ks AS INT) AS source, CAST(r.kt AS INT) AS target, CAST(least(l.c, r.kt) AS INT) AS content, CAST(r.used - r.kt AS INT) AS start, CAST(l.o AS INT) AS score_offset
FROM rec r JOIN ln l ON l.conv_id = r.conv_id AND l.t = r.t""")
def q_truncate_multiturn(spark, sf_dir):
    v = _encoded(spark, sf_dir).select("conv_id", F.explode(S.layout(F.col("encoded"), F.lit(_CUT))).alias("p"))
    return v.select("conv_id", "p.turn", "p.source", "p.target", "p.content", "p.start", F.col("p.offset").alias("score_offset"))


@_add("q_token_positions", f"""WITH {_REC.replace(str(_CUT), '1000000000')}, p AS (SELECT r.conv_id, r.used, r.kt, l.c, r.used - r.kt AS start FROM rec r JOIN ln l ON l.conv_id = r.conv_id AND l.t = r.t)
SELECT conv_id, CAST(max(used) AS INT) AS n_tokens, CAST(sum(c) AS INT) AS n_response, CAST(sum(kt) AS INT) AS n_target, CAST(sum(c * start + c * (c - 1) // 2) AS BIGINT) AS response_sum, CAST(sum(kt * start + kt * (kt - 1) // 2) AS BIGINT) AS target_sum FROM p GROUP BY conv_id""")
def q_token_positions(spark, sf_dir):
    v = _encoded(spark, sf_dir).withColumn("p", S.layout(F.col("encoded")))
    p = F.col("p")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    r, t = S.response_positions(p), S.target_positions(p)
    return v.select("conv_id", F.size(S.token_ids(F.col("encoded"), p)).alias("n_tokens"), F.size(r).alias("n_response"), F.size(t).alias("n_target"), total(r).alias("response_sum"), total(t).alias("target_sum"))


def _with_scores(v: DataFrame) -> DataFrame:
    """Whole-sequence scores for encoded turns, as a score file would bring them."""
    n = S.totals(F.col("encoded"), S.layout(F.col("encoded")))
    v = v.withColumns({"_selection_sequence_token_count": n["full_sequence"], "_selection_response_token_count": n["full_response"], "_selection_sample_id": F.col("conv_id").cast("string")})
    return v.withColumn("_selection_token_scores", F.transform(F.sequence(F.lit(0), F.col("_selection_response_token_count") - 1), lambda i: ((F.col("conv_id") * 31 + i * 17) % 21 - 10) / F.lit(4.0)))


@_add("q_labels", f"""WITH {_REC}, k AS (SELECT r.conv_id, r.t, r.ks, r.kt, l.o, least(l.c, r.kt) AS c, tl.tgt FROM rec r JOIN ln l ON l.conv_id = r.conv_id AND l.t = r.t JOIN tl ON tl.conv_id = r.conv_id AND tl.t = r.t),
tk AS (SELECT conv_id, t, ks, c, o, j, tgt[j + 1] AS ch FROM (SELECT *, unnest(range(kt)) AS j FROM k WHERE kt > 0)),
lb AS (SELECT conv_id, t, j, j < c AS kept, j < c AND (conv_id * 31 + (o + j) * 17) % 21 - 10 <= 0 AS ign, ch FROM tk),
tx AS (SELECT conv_id, t, string_agg(CASE WHEN ign THEN '-100' ELSE CAST(unicode(ch) + 10 AS VARCHAR) END, ',' ORDER BY j) AS lt FROM lb GROUP BY conv_id, t),
al AS (SELECT k.conv_id, string_agg(CASE WHEN ks > 0 AND kt > 0 THEN repeat('-100,', CAST(ks AS INT) - 1) || '-100,' || lt WHEN ks > 0 THEN repeat('-100,', CAST(ks AS INT) - 1) || '-100' ELSE lt END, ',' ORDER BY k.t) AS labels FROM k LEFT JOIN tx ON tx.conv_id = k.conv_id AND tx.t = k.t WHERE ks + kt > 0 GROUP BY k.conv_id)
SELECT al.conv_id, sha256(labels) AS labels, CAST(s.r AS INT) AS n_retained, CAST(s.g AS INT) AS n_ignored FROM al JOIN (SELECT conv_id, count(*) FILTER (kept) AS r, count(*) FILTER (ign) AS g FROM lb GROUP BY conv_id) s ON s.conv_id = al.conv_id""")
def q_labels(spark, sf_dir):
    out = selection.train_examples(_with_scores(_encoded(spark, sf_dir)), Selection(ignore_zero_scores_only=True, score_file="-"), _CUT)
    return out.select("conv_id", F.sha2(F.array_join(F.transform("labels", lambda x: x.cast("string")), ","), 256).alias("labels"), "n_retained", "n_ignored")


def _normalized_sql(beta: int) -> str:
    return f"WITH {_SC} SELECT conv_id, CAST(i AS INT) AS i, round(x / pow(n - i, {beta}), 9) AS v FROM u"


def _normalized(beta: float):
    def run(spark, sf_dir):
        v = scored(spark, sf_dir)
        return v.select("conv_id", F.posexplode(R.normalized(F.col("s"), beta)).alias("i", "v")).withColumn("v", F.round("v", 9))

    return run


_add("q_normalize_b0", _normalized_sql(0))(_normalized(0.0))
_add("q_normalize_b1", _normalized_sql(1))(_normalized(1.0))


def _masked(mask):
    def run(spark, sf_dir):
        v = scored(spark, sf_dir).withColumn("mask", mask(F.col("s"), F.col("conv_id")))
        return v.select("conv_id", R.count_true(F.col("mask")).cast("long").alias("n_ignored"), shown(F.col("mask")).alias("mask"))

    return run


def _masked_sql(test: str, ranked: str = "u") -> str:
    return f"WITH {_SC}, z AS (SELECT conv_id, i, CASE WHEN {test} THEN 1 ELSE 0 END AS g FROM {ranked}) SELECT conv_id, CAST(sum(g) AS BIGINT) AS n_ignored, string_agg(CAST(g AS VARCHAR), '' ORDER BY i) AS mask FROM z GROUP BY conv_id"


_add("q_nonpositive", _masked_sql("x <= 0"))(_masked(lambda s, _: R.nonpositive(s, R.all_of(s))))
_add("q_reverse_zero", _masked_sql("x <> 0"))(_masked(lambda s, _: R.nonzero(s, R.all_of(s))))
_add("q_reverse_nonpositive", _masked_sql("x > 0"))(_masked(lambda s, _: R.positive(s, R.all_of(s))))
_add("q_bottom_fraction", _masked_sql("rk <= ceil(CAST(0.75 AS DOUBLE) * n)", "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY x / (n - i), i) AS rk FROM u)"))(_masked(lambda s, _: R.bottom_fraction(s, R.all_of(s), 0.75, 1.0)))
_add("q_random_mask", _masked_sql("rk <= k", "(SELECT *, count(*) FILTER (x <= 0) OVER (PARTITION BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('42' || chr(0) || conv_id || chr(0) || i), i) AS rk FROM u)"))(_masked(lambda s, c: R.random_control(s, R.all_of(s), c, 42)))
_add("q_seq_equal_nll_mask", _masked_sql("rk <= k", "(SELECT *, count(*) FILTER (x <= 0) OVER (PARTITION BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY (conv_id * 13 + i * 29) % 17, i) AS rk FROM u)"))(
    _masked(lambda s, c: R.count_matched(F.transform(s, lambda _, i: ((c * 13 + i * 29) % 17) / F.lit(8.0)), s)))
_add("q_rate_check", f"WITH {_SC} SELECT conv_id, CAST(0.5 AS DOUBLE) + 1e-12 < CAST(count(*) FILTER (x <= 0) AS DOUBLE) / count(*) AS too_small FROM u GROUP BY conv_id")(
    lambda spark, sf_dir: scored(spark, sf_dir).select("conv_id", R.rate_too_small(F.col("s"), R.all_of(F.col("s")), 0.5).alias("too_small")))
_add("q_positive_clip", f"WITH {_SC} SELECT conv_id, sum(greatest(x, 0)) AS total, count(*) FILTER (x > 0) AS n_positive FROM u GROUP BY conv_id")(
    lambda spark, sf_dir: scored(spark, sf_dir).select("conv_id", R.clipped(F.col("s"), "positive").alias("p")).select("conv_id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("p", lambda x: x > 0)).cast("long").alias("n_positive")))


def _thinking(spark, sf_dir):
    """Whole responses of every turn with a reasoning block that is closed, open, absent, or closed before it opens."""
    v = samples(spark, sf_dir).where("error is null")
    k = F.col("conv_id") % 4

    def text(a):
        return F.when(k == 0, F.concat(F.lit("ab<think>"), a, F.lit("</think>"), a)).when(k == 1, F.concat(F.lit("<think>"), a)).when(k == 2, a).otherwise(F.concat(F.lit("</think><think>"), a, F.lit("</think>x<think>y</think>")))

    return v.select("conv_id", F.transform("turns", lambda t: text(t["assistant"])).alias("texts"))


_THOUGHT = _E + """,
th AS (SELECT conv_id, unnest(range(len(c) // 2)) AS turn, unnest(list_transform(list_filter(c, lambda x: x.role = 'assistant'), lambda x: x.content)) AS a FROM e WHERE error IS NULL),
tt AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'ab<think>' || a || '</think>' || a WHEN 1 THEN '<think>' || a WHEN 2 THEN a ELSE '</think><think>' || a || '</think>x<think>y</think>' END AS t FROM th),
ts AS (SELECT conv_id, turn, t, instr(t, '<think>') AS o FROM tt),
tb AS (SELECT conv_id, turn, t, CASE WHEN o > 0 THEN o + 7 END AS f, CASE WHEN o > 0 AND instr(substring(t, o + 7), '</think>') > 0 THEN o + 7 + instr(substring(t, o + 7), '</think>') - 1 WHEN o > 0 THEN length(t) + 1 END AS l FROM ts)"""


@_add("q_think_span", f"WITH {_THOUGHT} SELECT conv_id, CAST(turn AS INT) AS turn, CAST(coalesce(l - f, 0) AS INT) AS n, CASE WHEN l > f THEN CAST(f - 1 AS INT) END AS first FROM tb")
def q_think_span(spark, sf_dir):
    v = _thinking(spark, sf_dir).select("conv_id", F.posexplode("texts").alias("turn", "text")).withColumn("ids", CODE_POINTS(F.col("text")))
    v = v.withColumn("m", R.think_span(F.col("ids"), CODE_POINTS(F.lit(T.THINK_OPEN)), CODE_POINTS(F.lit(T.THINK_CLOSE))))
    at = F.array_position("m", F.lit(True)) - 1
    return v.select("conv_id", "turn", R.count_true(F.col("m")).alias("n"), F.when(at >= 0, at.cast("int")).alias("first"))


@_add("q_think_select", f"""WITH {_THOUGHT}, z AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tb),
x AS (SELECT conv_id, unnest(range(length(t))) AS i, base, f, l FROM z)
SELECT conv_id, CAST(count(*) AS INT) AS n_retained, CAST(count(*) FILTER (i >= f - 1 AND i < l - 1 AND (conv_id * 31 + (base + i) * 17) % 21 - 10 <= 0) AS INT) AS n_ignored FROM x GROUP BY conv_id""")
def q_think_select(spark, sf_dir):
    turns = F.transform("texts", lambda t: F.struct(F.lit("q").alias("user"), t.alias("assistant")))
    v = _thinking(spark, sf_dir).select("conv_id", turns.alias("turns"), F.lit(None).cast("string").alias("system"))
    v = v.select("conv_id", S.encoded_turns(F.col("turns"), F.col("system"), "qwen3_nothink", CODE_POINTS).alias("encoded"))
    out = selection.train_examples(_with_scores(v), ScopedSelection(ignore_zero_scores_only=True, score_file="-"), 1_000_000, CODE_POINTS)
    return out.select("conv_id", "n_retained", "n_ignored")


def _score_rows(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).select(F.col("conv_id").alias("source_index"), F.col("conv_id").cast("string").alias("sample_id"), (F.size("s") + 5).alias("sequence_token_count"), F.size("s").alias("response_token_count"), F.lit(0.0).alias("baseline_response_target_nll_sum"), F.col("s").alias("token_scores"))


@_add("q_attach_scores", f"WITH {_SC} SELECT e.conv_id, len(e.c) AS n_messages, len(sc.s) AS n_scores FROM e JOIN sc ON sc.conv_id = e.conv_id WHERE e.conv_id % 3 <> 0")
def q_attach_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("row_index")).agg(F.count(F.when(F.col("role") != "system", 1)).alias("n_messages"))
    out = alignment.attach(rows, _score_rows(spark, sf_dir).where("source_index % 3 <> 0"))
    return out.select(F.col("row_index").alias("conv_id"), "n_messages", F.size("_selection_token_scores").cast("long").alias("n_scores"))


@_add("q_contract_check", f"""WITH {_REC}, f AS (SELECT conv_id, sum(s + g) AS fs, sum(c) AS fr FROM ln GROUP BY conv_id), k AS (SELECT r.conv_id, sum(r.ks + r.kt) AS cs, sum(least(l.c, r.kt)) AS cr FROM rec r JOIN ln l ON l.conv_id = r.conv_id AND l.t = r.t GROUP BY r.conv_id),
x AS (SELECT f.conv_id, fs, fr, cs, cr, CASE f.conv_id % 3 WHEN 1 THEN cs ELSE fs END AS es, CASE f.conv_id % 3 WHEN 0 THEN fr WHEN 1 THEN cr ELSE fr + 1 END AS er FROM f JOIN k ON k.conv_id = f.conv_id)
SELECT conv_id, es = fs AND er = fr AS full_contract, CASE WHEN NOT (es = fs AND er = fr) AND NOT (es = cs AND er = cr) THEN 'score/tokenization mismatch' END AS error FROM x""")
def q_contract_check(spark, sf_dir):
    v = _encoded(spark, sf_dir).withColumn("p", S.layout(F.col("encoded"), F.lit(_CUT)))
    v = v.select("conv_id", *[c.alias(k) for k, c in S.totals(F.col("encoded"), F.col("p")).items()])
    k = F.col("conv_id") % 3
    seq = F.when(k == 1, F.col("cut_sequence")).otherwise(F.col("full_sequence"))
    resp = F.when(k == 0, F.col("full_response")).when(k == 1, F.col("cut_response")).otherwise(F.col("full_response") + 1)
    full, error = alignment.contract(F.col("full_sequence"), F.col("full_response"), F.col("cut_sequence"), F.col("cut_response"), seq, resp, resp)
    return v.select("conv_id", full.alias("full_contract"), error.alias("error"))


@_add("q_pair_violations", f"WITH {_SC} SELECT CASE WHEN conv_id % 4 = 0 THEN 'row on one side only' WHEN conv_id % 4 = 1 THEN 'token counts differ' WHEN conv_id % 4 = 2 AND len(list_filter(s, lambda x: x < 0)) > 0 THEN 'losses must be non-negative' ELSE 'ok' END AS violation, count(*) AS n FROM sc GROUP BY 1")
def q_pair_violations(spark, sf_dir):
    a = _score_rows(spark, sf_dir)
    k = F.col("source_index") % 4
    nll = a.withColumn("token_scores", F.when(k == 2, F.col("token_scores")).otherwise(F.transform("token_scores", lambda x: F.abs(x))))
    ref = a.where(k != 0).withColumn("sequence_token_count", F.col("sequence_token_count") + (k == 1).cast("int"))
    return alignment.pair_scores(nll, ref).groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count("*").alias("n"))


@_add("q_mask_stats", f"WITH {_SC} SELECT count(DISTINCT conv_id) AS records, count(*) AS response_tokens, count(*) FILTER (x <= 0) AS masked, count(*) FILTER (x > 0) AS trained, CAST(count(*) FILTER (x <= 0) AS DOUBLE) / count(*) AS mask_rate FROM u")
def q_mask_stats(spark, sf_dir):
    from lossweave.plans.materialize import count_matched_masks, mask_totals

    a = _score_rows(spark, sf_dir)
    return mask_totals(count_matched_masks(a.withColumn("token_scores", F.transform("token_scores", lambda x: F.abs(x))), a))


@_add("q_ignored_rate_by_label", r"""WITH d AS (SELECT d.doc_id, l.quality, list_filter(regexp_split_to_array(d.text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
x AS (SELECT doc_id, quality, CAST(len(w) AS BIGINT) AS n, CAST(len(list_filter(list_transform(w, lambda v, i: (doc_id * 31 + (i - 1) * 17 + length(v) * 7) % 21 - 10), lambda s: s <= 0)) AS BIGINT) AS g FROM d)
SELECT quality, count(*) AS samples, CAST(sum(n) AS BIGINT) AS retained, CAST(sum(g) AS BIGINT) AS ignored, coalesce(CAST(sum(g) AS DOUBLE) / nullif(sum(n), 0), 0.0) AS rate FROM x GROUP BY quality""")
def q_ignored_rate_by_label(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", K.pieces(F.col("text")).alias("w"))
    s = F.transform("w", lambda v, i: ((F.col("doc_id") * 31 + i * 17 + F.length(v) * 7) % 21 - 10) / F.lit(4.0))
    d = d.select("quality", F.size("w").alias("n_retained"), R.count_true(R.nonpositive(s, R.all_of(F.col("w")))).alias("n_ignored"))
    return selection.statistics(d, ["quality"])


@_add("q_unigram_nll", f"""WITH {_SC}, wc AS (SELECT w, count(*) AS n FROM u GROUP BY w), z AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM wc)
SELECT conv_id, count(*) AS n, round(sum(-ln((wc.n + 1) / CAST(total + kinds AS DOUBLE))), 4) AS nll FROM u JOIN wc ON wc.w = u.w, z GROUP BY conv_id""")
def q_unigram_nll(spark, sf_dir):
    t = scored(spark, sf_dir).select("conv_id", F.explode("tok").alias("tok"))
    return t.join(scorers.unigram_losses(t).drop("n"), "tok").groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum("nll"), 4).alias("nll"))


@_add("q_bigram_nll", f"""WITH {_SC}, b AS (SELECT conv_id, w, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY i), '') AS p FROM u),
c2 AS (SELECT p, w, count(*) AS n2 FROM b GROUP BY p, w), c1 AS (SELECT p, CAST(sum(n2) AS BIGINT) AS n1 FROM c2 GROUP BY p), z AS (SELECT count(DISTINCT w) AS kinds FROM c2)
SELECT conv_id, count(*) AS n, round(sum(-ln((n2 + 1) / CAST(n1 + kinds AS DOUBLE))), 4) AS nll FROM b JOIN c2 ON c2.p = b.p AND c2.w = b.w JOIN c1 ON c1.p = b.p, z GROUP BY conv_id""")
def q_bigram_nll(spark, sf_dir):
    t = scored(spark, sf_dir).select("conv_id", F.posexplode("tok").alias("i", "tok"))
    return scorers.bigram_losses(t, "conv_id", "i").groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum("nll"), 4).alias("nll"))


@_add("q_suffix_future_sum", f"WITH {_SC}, f AS (SELECT conv_id, i, coalesce(sum(x) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM u) SELECT conv_id, CAST(i AS INT) AS i, later FROM f")
def q_suffix_future_sum(spark, sf_dir):
    t = scored(spark, sf_dir).select("conv_id", F.posexplode("s").alias("i", "x"))
    return scorers.later_sums(t, "conv_id", "i", "x").select("conv_id", "i", "later")


@_add("q_deletion_metrics", f"""WITH {_SC}, f AS (SELECT conv_id, i, x * 0.5 - abs(x) AS d FROM u), w AS (SELECT conv_id, i, coalesce(sum(d) OVER o, 0) AS delta_sum, coalesce(avg(d) OVER o, 0) AS delta_mean, coalesce(sum(greatest(d, 0)) OVER o, 0) AS delta_positive FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT conv_id, CAST(i AS INT) AS i, delta_sum, round(delta_mean, 6) AS delta_mean, delta_positive FROM w""")
def q_deletion_metrics(spark, sf_dir):
    t = scored(spark, sf_dir).select("conv_id", F.posexplode("s").alias("i", "x")).withColumns({"a": F.abs("x"), "b": F.col("x") * 0.5})
    return scorers.deletion_metrics(t, "conv_id", "i", "a", "b").select("conv_id", "i", "delta_sum", F.round("delta_mean", 6).alias("delta_mean"), "delta_positive")


@_add("q_softcap", "SELECT doc_id, round(tanh(n_chars / CAST(3000.0 AS DOUBLE)) * CAST(3000.0 AS DOUBLE), 6) AS capped FROM documents")
def q_softcap(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(scorers.soft_capped(F.col("n_chars").cast("double"), 3000.0), 6).alias("capped"))


@_add("q_resume_antijoin", f"WITH {_E} SELECT conv_id FROM e WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 1")
def q_resume_antijoin(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return merging.pending(rows, rows.where("conv_id % 3 = 0"), rows.where("conv_id % 5 = 1"), index="conv_id")


@_add("q_merge_parts", f"WITH {_SC} SELECT conv_id AS source_index, CAST(conv_id AS VARCHAR) AS sample_id, len(s) AS n FROM sc")
def q_merge_parts(spark, sf_dir):
    a = _score_rows(spark, sf_dir)
    parts = [a.where(f"source_index % 3 = {k}") for k in range(3)] + [a.where("source_index % 7 = 0")]
    return merging.merge(parts).select("source_index", "sample_id", F.size("token_scores").cast("long").alias("n"))


@_add("q_conflicts", f"WITH {_SC} SELECT conv_id AS source_index, CAST(2 AS BIGINT) AS variants FROM sc WHERE conv_id % 7 = 0")
def q_conflicts(spark, sf_dir):
    a = _score_rows(spark, sf_dir)
    changed = a.where("source_index % 7 = 0").withColumn("sample_id", F.concat("sample_id", F.lit("x")))
    return merging.conflicts([a, a.where("source_index % 5 = 0"), changed])


@_add("q_shard_counts", "SELECT CAST(conv_id % 3 AS INT) AS rank, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id >= 2 GROUP BY 1")
def q_shard_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id >= 2")
    return merging.shard(rows, 3, "conv_id").groupBy("rank").agg(F.count("*").alias("n"))


@_add("q_max_samples", "SELECT conv_id AS row_index FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0) ORDER BY conv_id LIMIT 10")
def q_max_samples(spark, sf_dir):
    """The first ten scored samples: the limit is the feature."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_index")).distinct().where("row_index % 3 <> 0")
    return merging.first_rows(rows, 10)


@_add("q_token_info", """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(length(text) AS INT) AS n, CAST(length(text) * (length(text) + 5) // 2 AS BIGINT) AS places, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) + 10)), 0) AS BIGINT) AS ids, md5(text) AS texts FROM t""")
def q_token_info(spark, sf_dir):
    """Places, ids and texts of the tokens after a mark of three."""
    d = _table(spark, sf_dir, "documents").select("doc_id", CODE_POINTS(F.concat(F.lit("<s>"), F.coalesce("text", F.lit("")))).alias("ids"))
    at = F.transform(F.slice("ids", 4, F.size("ids")), lambda x, i: i + 3)
    d = d.select("doc_id", K.token_info(F.col("ids"), at, K.code_point_texts()).alias("info"))
    total = lambda name: F.aggregate("info", F.lit(0).cast("long"), lambda s, x: s + x[name])
    return d.select("doc_id", F.size("info").alias("n"), total("sequence_token_index").alias("places"), total("token_id").alias("ids"), F.md5(F.array_join(F.transform("info", lambda x: x["token_text"]), "").cast("binary")).alias("texts"))


@_add("q_split_count", """SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || conv_id)[1:8], CAST(conv_id AS VARCHAR)) > 25 THEN 'train' ELSE 'validation' END AS part FROM (SELECT DISTINCT conv_id FROM conversations)""")
def q_split_count(spark, sf_dir):
    """Train and a validation set of 25 rows, marked."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    train, held = merging.split(rows, 25, "conv_id")
    return merging.combine([train.withColumn("part", F.lit("train")), held.withColumn("part", F.lit("validation"))])


@_add("q_dataset_split", """SELECT conv_id, CASE WHEN CAST('0x' || substring(md5('42|' || conv_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) >= 0.2 THEN 'train' ELSE 'validation' END AS part FROM (SELECT DISTINCT conv_id FROM conversations)""")
def q_dataset_split(spark, sf_dir):
    """Train and validation by a seeded hash: rows of both, marked."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    train, held = merging.split(rows, 0.2, "conv_id")
    return merging.combine([train.withColumn("part", F.lit("train")), held.withColumn("part", F.lit("validation"))])


@_add("q_exact_sum", f"WITH {_SC} SELECT conv_id, list_sum(s) AS total FROM sc")
def q_exact_sum(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", scorers.exact_sum("s").alias("total"))


@_add("q_arrow_scorer", f"WITH {_REC.replace(str(_CUT), '1000000000')} SELECT conv_id AS source_index, CAST(sum(s + g) AS INT) AS sequence_token_count, CAST(sum(c) AS INT) AS response_token_count, CAST(sum(g) AS DOUBLE) AS nll FROM ln GROUP BY conv_id")
def q_arrow_scorer(spark, sf_dir):
    """Any model behind the Arrow interface; here every token has loss one."""
    v = samples(spark, sf_dir).where("error is null").withColumn("error_type", F.lit(None).cast("string"))
    v = records.encode(v, "qwen3_nothink", CODE_POINTS, max_len=1 << 30).select(F.col("conv_id").alias("source_index"), F.col("conv_id").cast("string").alias("sample_id"), "token_ids", "response_positions", "target_positions")
    out = scorers.score_with(v, scorers.losses_scorer(lambda ids: [1.0] * len(ids)))
    return out.select("source_index", "sequence_token_count", "response_token_count", F.col("baseline_response_target_nll_sum").alias("nll"))


from lossweave import file_queries  # noqa: E402, F401  (registers its queries here)
